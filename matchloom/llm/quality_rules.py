"""Quality rules: base counts of a text and modified Kneser-Ney perplexities, of its symbols and of its words, with bands for
each language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, grams, grouped, mix, modest_batches, order_of, per_batch, small_side, stash, tidy, utf8
from .lm_scores import Backoff, press_keys
from .word_model import BITS as WORD_BITS
from .word_model import coded, press_places, seeded, swept, with_nats

ORDER, BITS = 4, 6


@dataclass(frozen=True)
class QualityRules:
    """Fewest words, greatest share of repeated words (per cent), width of the perplexity bands in spreads of the
    language's own log perplexities (median to a quartile) with least spreads (by symbol, and by word), bytes of
    models of symbols in one broadcast, order of the model of words, least words of one of its blocks, and about how many
    bytes of texts its dictionary is taken from."""

    min_words: int = 50
    max_repeat: int = 50
    upper: float = 7.0
    lower: float = 7.0
    least_spread: float = 0.005
    least_word_spread: float = 0.5
    model_bytes: int = 128 << 20
    word_order: int = 2
    block_words: int = 1_000_000
    sample_bytes: int = 32 << 20


def symbols() -> np.ndarray:
    """byte -> one of 64 symbols. 0 bounds texts; then white space and line ends, a-z, capitals (vowel or not), digits,
    marks, and the bytes of other scripts folded by their low bits. So there are at most 64^4 n-grams of four symbols in
    any corpus, and a model has a bounded size. What is folded here is told apart by the model of words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 52 + b % 12
        elif b >= 0x80:
            out[b] = 40 + b % 12
        elif c == "\n":
            out[b] = 2
        elif b <= 32 or b == 127:
            out[b] = 1
        elif c.islower():
            out[b] = 3 + b - ord("a")
        elif c.isupper():
            out[b] = 29 + (c in "AEIOU")
        elif c.isdigit():
            out[b] = 31
        else:
            out[b] = 32 + ".,!|#*%".find(c) + 1
    return out


TABLE = symbols()
IS_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
IS_CHAR = np.array([(b & 0xC0) != 0x80 and not (b == 32 or 9 <= b <= 13) for b in range(256)])


def keys_of(text: bytes) -> np.ndarray:
    """Keys of the n-grams that end at each symbol and at the text's end: ORDER symbols of BITS bits, oldest highest."""
    own = np.zeros(len(text) + ORDER, np.uint32)
    own[ORDER - 1 : -1] = TABLE[np.frombuffer(text, np.uint8)]
    out = np.zeros(len(text) + 1, np.uint32)
    for k in range(ORDER):
        out = (out << np.uint32(BITS)) | own[k : k + len(out)]
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def with_hash(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce("lang", F.lit("")).alias("lang"), "text", F.xxhash64("text").alias("t_"))


def copies_of(docs: DataFrame) -> DataFrame:
    """``lang, t_, copies``: in how many rows the language has the text, of texts that it has in more than one."""
    return small_side(stash(with_hash(docs).groupBy("lang", "t_").agg(F.count("*").alias("copies")).where("copies > 1")))


def with_copies(docs: DataFrame, copied: DataFrame, *more: Column) -> DataFrame:
    """``lang, text, copies``: in how many rows the language has the text."""
    return with_hash(docs, *more).join(copied, ["lang", "t_"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("t_")


def ngram_counts(docs: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """``lang, key, n`` over the different texts of each language, so that copies add nothing; each task sums its own
    n-grams before the shuffle. Texts with equally many copies are summed together and divided by that number, which
    moves no texts."""
    schema = pa.schema([("lang", pa.string()), ("copies", pa.int64()), ("key", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in per_batch(batches, 512):
            own: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, copies, text in zip(batch.column("lang").to_pylist(), batch.column("copies").to_pylist(), utf8(batch.column("text")), strict=True):
                if text:
                    own.setdefault((lang, copies), []).append(keys_of(text))
            for kind, parts in own.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                if kind in total:
                    k, n = summed(np.concatenate([total[kind][0], k]), np.concatenate([total[kind][1], n]))
                total[kind] = k, n
        for (lang, copies), (k, n) in total.items():
            yield batch_of(schema, ([lang] * len(k), [copies] * len(k), k.astype(np.int32), n))

    parts = with_copies(docs, copies_of(docs) if copied is None else copied).mapInArrow(tidy(run), "lang string, copies long, key int, n long")
    # the sum of n / copies is a whole number but for the last bits
    return parts.groupBy("lang", "key").agg(F.round(F.sum(F.col("n") / F.col("copies"))).cast("long").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's three discounts for counts of 1, 2 and more, from the counts of counts; index 0 is unused."""
    c = [float((n == k).sum()) for k in range(1, 5)]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] + c[1] else 0.5
    made = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] and c[k] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1))])


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted arrays of a modified, interpolated Kneser-Ney model from the counts of its highest order: ``k<order>`` the
    keys, ``p<order>`` their log probabilities, ``c<order>`` and ``g<order>`` contexts and their log back-off weights.
    Lower orders count the different symbols to the left. A key holds its n-gram itself, so hashes don't collide."""
    base, counted = {}, (keys.astype(np.uint32), n.astype(np.float64))
    by_order = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        k, _ = by_order[order + 1]
        by_order[order] = summed(k & np.uint32((1 << BITS * order) - 1), np.ones(len(k)))
    prob = np.full(1 << BITS, 1.0 / (1 << BITS))  # below all orders: uniform
    low_keys = np.arange(1 << BITS, dtype=np.uint32)
    for order in range(1, ORDER + 1):
        k, c = by_order[order]
        d = discounts(c)[np.minimum(c, 3).astype(int)]
        ctx = k >> np.uint32(BITS)
        first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        sizes = np.diff(np.r_[first, len(ctx)])
        all_c, all_d = np.add.reduceat(c, first), np.add.reduceat(d, first)
        weight = all_d / all_c
        under = prob[np.searchsorted(low_keys, k & np.uint32((1 << BITS * (order - 1)) - 1))] if order > 1 else prob[k]
        prob, low_keys = (c - d) / np.repeat(all_c, sizes) + np.repeat(weight, sizes) * under, k
        base |= {f"k{order}": k, f"p{order}": np.log(prob).astype(np.float32), f"c{order}": ctx[first], f"g{order}": np.log(weight).astype(np.float32)}
    return base


class Tops(dict):
    """language -> for each context of the highest order the place of its first key in the model and a bit for each symbol
    that follows it, so a key's place is found without a search; of at most LIMIT languages at a time."""

    LIMIT = 16

    def __init__(self, models: dict[str, dict[str, np.ndarray]]) -> None:
        self.models = models

    def __missing__(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= self.LIMIT:
            self.clear()
        k = self.models[lang][f"k{ORDER}"]
        context, size = (k >> np.uint32(BITS)).astype(np.int64), 1 << BITS * (ORDER - 1)
        n = np.bincount(context, minlength=size)
        bits = np.zeros(size, np.uint64)
        np.bitwise_or.at(bits, context, np.uint64(1) << (k & np.uint32((1 << BITS) - 1)).astype(np.uint64))
        self[lang] = (np.cumsum(n) - n).astype(np.int32), bits
        return self[lang]


def log_probs(model: dict[str, np.ndarray], keys: np.ndarray, top: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Log probability of the last symbol of each key, by back-off from the highest order. ``top``: where its keys are; if
    all keys are there, as those of the model's own texts, that is all."""
    if top is not None:
        first, bits = top
        context = keys >> np.uint32(BITS)
        symbol, own = (keys & np.uint32((1 << BITS) - 1)).astype(np.uint64), bits[context]
        if (own >> symbol & np.uint64(1)).all():
            return model[f"p{ORDER}"][first[context] + np.bitwise_count(own & ((np.uint64(1) << symbol) - np.uint64(1)))].astype(np.float64)
    out, open_ = np.zeros(len(keys)), np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        k = keys[open_] & np.uint32((1 << BITS * order) - 1)
        at = np.minimum(np.searchsorted(model[f"k{order}"], k), len(model[f"k{order}"]) - 1)
        hit = model[f"k{order}"][at] == k
        out[open_[hit]] += model[f"p{order}"][at[hit]]
        open_, k = open_[~hit], k[~hit]
        if not len(open_):
            return out
        ctx = k >> np.uint32(BITS)
        at = np.minimum(np.searchsorted(model[f"c{order}"], ctx), len(model[f"c{order}"]) - 1)
        out[open_] += np.where(model[f"c{order}"][at] == ctx, model[f"g{order}"][at], 0.0)
    out[open_] += -np.log(1 << BITS)
    return out


WHITE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and how many each text has: a word's bytes as the digits
    of a number, mixed. In pieces of about PIECE bytes that end at white space."""
    global POWERS
    data = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, places, at = [], [], 0
    while at < len(data):
        to = at + PIECE
        white = WHITE.search(data, to) if to < len(data) else None
        to = white.start() if white else len(data)
        own = np.frombuffer(data, np.uint8, to - at, at)
        inside = np.zeros(len(own) + 2, bool)
        inside[1:-1] = ~IS_SPACE[own]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = turns[::2], turns[1::2] - turns[::2]
        if len(starts):
            while sizes.max() > len(POWERS):
                POWERS = np.r_[POWERS, POWERS * POWERS[-1] * POWERS[1]]
            first = np.cumsum(sizes) - sizes
            digits = own[inside[1:-1]].astype(np.uint64) + np.uint64(1)
            digits *= POWERS[np.arange(len(digits)) - np.repeat(first, sizes)]
            hashes.append(mix(np.add.reduceat(digits, first)))
            places.append(starts + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(places), ends), prepend=0)


def base_counts(text: bytes, n_words: int, windows: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbol characters, repeated lines, words in repeated three-word windows; ``windows``:
    the hashes of these, in their order."""
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated, own = 0, np.sort(windows)
    twice = own[1:][own[1:] == own[:-1]]
    if len(twice):
        again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows)
        covered = np.zeros(n_words, bool)
        for k in range(3):
            covered[again + k] = True
        repeated = int(covered.sum())
    return n_words, int(bytes_[IS_CHAR].sum()), int(bytes_[IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated


FIELDS = ("doc_id", "lang", "copies", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "word_ppl")
KINDS = {"lang": ("string", pa.string()), "log_ppl": ("double", pa.float64()), "word_ppl": ("double", pa.float64())}


def language_groups(counts: DataFrame, rules: QualityRules) -> list[list[str]]:
    """Languages by groups whose models are of bounded size together (one that is larger alone is a group of its own: at
    most 64^4 n-grams and their lower orders)."""
    groups: list[list[str]] = [[]]
    room = rules.model_bytes
    for r in counts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect():  # a row for each language
        size = 12 * r.n
        if groups[-1] and size > room:
            groups.append([])
            room = rules.model_bytes
        groups[-1].append(r.lang)
        room -= size
    return groups


def models_of(counts: DataFrame, languages: list[str]) -> dict[str, dict[str, np.ndarray]]:
    """The models of one group, from one sorted read of its counts."""
    t = counts.where(F.col("lang").isin(languages)).orderBy("lang", "key").toArrow()
    langs, keys, n = t.column("lang").to_numpy(), t.column("key").to_numpy(), t.column("n").to_numpy()
    ends = np.r_[np.flatnonzero(langs[1:] != langs[:-1]) + 1, len(langs)] if len(langs) else np.empty(0, int)
    return {langs[a]: kneser_ney(keys[a:b], n[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)} if len(langs) else {}


def dictionary(docs: DataFrame, size: int, rules: QualityRules) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and numbers of the most frequent words in about ``sample_bytes`` of the texts, taken by their hashes.
    It only makes the keys of n-grams of such words smaller (see ``word_model``), whatever is in it."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 512):
            own, sizes = word_hashes(utf8(batch.column("text")))
            each, n = np.unique(seeded(own, sizes, batch.column("lang").to_pylist()), return_counts=True)
            yield batch_of(schema, (each.view(np.int64), n))

    one_of = max(1, size // rules.sample_bytes)
    sample = with_hash(docs).where(F.col("text").isNotNull() & (F.pmod("t_", F.lit(one_of)) == 0)).select("lang", "text")
    often = sample.mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = often.orderBy(F.desc("n"), "word").limit(1 << WORD_BITS).select("word").toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64)  # at most 2^17 numbers
    order = np.argsort(words)
    return words[order], order.astype(np.uint64)


def scored(docs: DataFrame, rules: QualityRules, keys: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """Base counts and log perplexities of every text: by symbol and by word of the model of symbols, and by word of the
    model of words (``lm_ppl``). The driver holds the models of symbols of one group of languages at a time, and each group
    is one broadcast; the words go on as blocks (see ``word_model``)."""
    scratch, copied = scratch or Scratch(docs.sparkSession), copies_of(docs)
    counts = scratch(ngram_counts(docs, copied))
    groups = language_groups(counts, rules)
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, size, rules))
    block_words, parts = Backoff(block_words=rules.block_words, part_words=2_000_000, row=500).sizes(size // 6)  # about so many words
    fields = (*FIELDS, *keys)
    kinds = [KINDS.get(c, ("long", pa.int64())) for c in fields]
    schema = pa.schema([("block", pa.int64()), *((c, pa.list_(t)) for c, (_, t) in zip(fields, kinds, strict=True)), ("numbers", pa.list_(pa.binary())), ("words", pa.binary())])
    source = with_copies(docs, copied, F.col("doc_id"), *[F.xxhash64("text").alias(f"key{k}") for k in range(len(keys))]).withColumn("text", F.coalesce("text", F.lit("")))
    out = None
    for k, group in enumerate(groups):
        shared = docs.sparkSession.sparkContext.broadcast(models_of(counts, group))

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            models, made, total = shared.value, 0, 0
            tops = Tops(models)
            rows: list[tuple] = []
            hashes: list[np.ndarray] = []

            def block() -> pa.RecordBatch:
                every = seeded(np.concatenate(hashes), [r[3] for r in rows], [r[1] for r in rows])
                first, places, _ = grouped(every)
                codes = coded(every[first], *known.value)
                order = order_of(codes)  # frequent words first: most places are small numbers
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                number = (k << 24 | TaskContext.get().partitionId()) << 24 | made
                return batch_of(schema, ([number], *([list(x)] for x in zip(*rows, strict=True)), [press_places(rank[places])], [press_keys(codes[order])]))

            for batch in per_batch(batches, 64):
                further = [batch.column(f"key{j}").to_pylist() for j in range(len(keys))]
                texts = utf8(batch.column("text"))
                every, sizes = word_hashes(texts)
                hashes.append(every)
                total += len(every)
                windows, starts = grams(every, 3), np.cumsum(sizes) - sizes
                for doc_id, g, copies, t, start, size, *more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "copies")), texts, starts.tolist(), sizes.tolist(), *further, strict=True):
                    base = base_counts(t, size, windows[start : start + max(0, size - 2)])
                    nats = float(-log_probs(models[g], keys_of(t), tops[g]).sum()) if t and g in models else None
                    rows.append((doc_id, g, copies, *base, nats if nats is None else nats / (len(t) + 1), nats / base[0] if nats is not None and base[0] else None, *more))
                if total >= block_words or len(rows) >= 100_000:
                    yield block()
                    rows, hashes, total, made = [], [], 0, made + 1
            if rows:
                yield block()

        own = source
        if len(groups) > 1:  # the last group also has the languages without a model: texts that are all empty
            others = [x for g in groups[:-1] for x in g]
            own = source.where(F.col("lang").isin(group) if k < len(groups) - 1 else ~F.col("lang").isin(others))
        listed = ", ".join(f"{c} array<{t}>" for c, (t, _) in zip(fields, kinds, strict=True))
        own = own.mapInArrow(tidy(run), f"block long, {listed}, numbers array<binary>, words binary")
        out = own if out is None else out.unionByName(own)
    with swept(docs.sparkSession):
        blocks = docs.sparkSession.table(scratch.by(out, "block", parts))
    rows = blocks.select("block", *fields).join(with_nats(blocks, rules.word_order, parts, scratch), "block")
    rows = rows.select(F.inline(F.arrays_zip(*fields, "nats")))
    return rows.select(*(c for c in fields if c != "copies"), F.when(F.col("n_words") > 0, F.col("nats") / F.col("n_words")).alias("lm_ppl"))


def distance(ppl: str, middle: str) -> Column:
    return (F.col(ppl) - F.col(middle)) * F.sqrt("n_words")


def bands(scores: DataFrame, rules: QualityRules, hashed: str) -> DataFrame:
    """``lang, low, high`` of log perplexity by symbol, ``middle, word_low, word_high`` of log perplexity by word and
    ``lm_middle, lm_high`` of that of the model of words, from
    the quartiles of each language's different texts (by the hash in column ``hashed``) that pass the base rules. Copies
    count once: a large group of them would be a quartile itself.

    The band by word is for the distance from the language's median times the root of the words: a mean over few words
    spreads more. By symbol, marks after every word are cheap, as they repeat; by word they are dear. The model of words has
    no lower bound: a text that it finds likely without the text's own counts has near copies, which is no fault of it."""
    spread = lambda far, middle, least: F.greatest(F.abs(far - middle), F.lit(least))
    texts = scores.where("not base_failed and log_ppl is not null").select("lang", hashed, "log_ppl", "word_ppl", "lm_ppl", "n_words").dropDuplicates(["lang", hashed])
    q = texts.groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("q"), F.percentile_approx("word_ppl", 0.5, 10_000).alias("middle"), F.percentile_approx("lm_ppl", 0.5, 10_000).alias("lm_middle"))
    small = F.broadcast(q) if scores.select("lang").distinct().count() < 10_000 else q
    away = texts.join(small, "lang").select("lang", distance("word_ppl", "middle").alias("away"), distance("lm_ppl", "lm_middle").alias("lm_away"))
    w = away.groupBy("lang").agg(F.percentile_approx("away", [0.25, 0.5, 0.75], 10_000).alias("w"), F.percentile_approx("lm_away", [0.5, 0.75], 10_000).alias("m"))
    least, least_word = rules.least_spread, rules.least_word_spread
    return q.join(w, "lang").select(
        "lang", "middle", "lm_middle",
        (F.col("q")[1] - rules.lower * spread(F.col("q")[0], F.col("q")[1], least)).alias("low"),
        (F.col("q")[1] + rules.upper * spread(F.col("q")[2], F.col("q")[1], least)).alias("high"),
        (F.col("w")[1] - rules.lower * spread(F.col("w")[0], F.col("w")[1], least_word)).alias("word_low"),
        (F.col("w")[1] + rules.upper * spread(F.col("w")[2], F.col("w")[1], least_word)).alias("word_high"),
        (F.col("m")[0] + rules.upper * spread(F.col("m")[1], F.col("m")[0], least_word)).alias("lm_high"),
    )


def quality(docs: DataFrame, rules: QualityRules | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``log_ppl, low, high`` (by symbol), ``word_ppl`` and
    ``word_away, word_low, word_high``, ``lm_ppl`` (by word, of the model of words, by all other texts of the language) and
    ``lm_away, lm_high``; ``keys`` name further columns, each the 64-bit hash of the text. A text is kept if it passes the
    base rules, lies inside both bands of its language and isn't above the limit of the model of words.

    A null text counts as empty: no words, base_failed. A null language is a language of its own. Texts of any length
    are read whole; repeated rows are judged alike and count once in the models and bands; an empty table gives no rows;
    other columns are ignored, whatever their names."""
    rules, docs = rules or QualityRules(), modest_batches(docs)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    hashed = keys or ("t_",)
    scratch = Scratch(docs.sparkSession)
    try:
        scores = stash(scored(docs, rules, hashed, scratch).withColumn("base_failed", failed))
    finally:
        scratch.release()
    limits = stash(bands(scores, rules, hashed[0]))
    judged = scores.join(small_side(limits), "lang", "left").withColumn("word_away", distance("word_ppl", "middle")).withColumn("lm_away", distance("lm_ppl", "lm_middle"))
    inside = F.col("log_ppl").between(F.col("low"), F.col("high")) & F.col("word_away").between(F.col("word_low"), F.col("word_high")) & (F.col("lm_away") <= F.col("lm_high"))
    inside = F.coalesce(inside, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "low", "high", "word_ppl", "word_away", "word_low", "word_high", "lm_ppl", "lm_away", "lm_high", *keys)
