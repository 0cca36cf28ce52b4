"""A modified, interpolated Kneser-Ney model of whole words: count tables partitioned by hash, a text's own counts taken off.

Blocks hold documents as word numbers. From the highest order down, each block sends its distinct n-grams, once each, to the
parts of that order's count table, and gets their sums back; what a shorter n-gram is counted by (the different words to
its left, and what follows it as a context) comes from the longer ones, each told by the one block that owns it. So every
n-gram of every text is in the model, no table is broadcast, and a frequent n-gram is one entry of each block.

Keys are sorted and stored as differences. A word's code is a 64-bit hash of language and word (the highest bit set), or, of
words that are frequent in a sample of the texts, its number in a dictionary of at most 2^BITS words. An n-gram of numbered
words alone has a key that holds the numbers themselves, spread over the parts by a reversible mix; other n-grams have a
hash. So the dictionary only makes keys smaller: whatever is in it, the same n-grams are told apart and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_of, grouped, mix, per_batch, tidy, trim
from .lm_scores import open_keys, opened, part_of, press_keys, pressed

START = np.uint64(0x5354415254)
#: The dictionary has at most 2^BITS words. Codes and keys from HASHED on are hashes.
BITS, HASHED = 18, np.uint64(1 << 63)
#: What an n-gram is sent and answered with: as a context the sum of what follows it and the n-grams counted 1, 2 and more;
#: and its own count. The highest order has a count alone.
VALUES = 5
#: Each order is asked for in so many turns, so that their shuffles aren't on disk at once.
TURNS = 2
#: About so many words of a block are scored at once: a score needs some thirty numbers a word on the way.
PIECE = 1 << 16
ASKED = "block long, part int, keys binary, amounts array<array<binary>>, codes binary, names array<string>"
ANSWERED = "block long, level int, part int, amounts array<array<binary>>, owner binary, lang string, stats array<double>"


def press_numbers(numbers: np.ndarray) -> bytes:
    """Numbers with like bytes together: most of a small number's bytes are zero."""
    return pressed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T))


def open_numbers(blob: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(opened(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: the next step would find the disk full of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def press_places(numbers: np.ndarray) -> list[bytes]:
    """Numbers of which most are below 255: a byte for each, and what is above that of the others."""
    return [pressed(np.minimum(numbers, 255).astype(np.uint8)), press_numbers(numbers[numbers >= 255].astype(np.uint32) - np.uint32(255))]


def open_places(blobs: list[bytes]) -> np.ndarray:
    out = opened(blobs[0], np.uint8).astype(np.int64)
    out[out == 255] += open_numbers(blobs[1], np.uint32)
    return out


def press_amounts(numbers: np.ndarray) -> list[bytes]:
    """Amounts: their whole parts, and the rest of those that have one, as a text of several copies counts for its share."""
    whole = numbers.astype(np.uint32)
    rest = numbers - whole
    at = np.flatnonzero(rest)
    out = [press_numbers(whole)]
    return [*out, press_numbers(np.diff(at, prepend=0).astype(np.uint32)), press_numbers(rest[at])] if len(at) else out


def open_amounts(blobs: list[bytes]) -> np.ndarray:
    out = open_numbers(blobs[0], np.uint32).astype(np.float64)
    if len(blobs) > 1:
        out[np.cumsum(open_numbers(blobs[1], np.uint32), dtype=np.int64)] += open_numbers(blobs[2], np.float64)
    return out


def seed_of(lang: str) -> np.uint64:
    """The language's own hash, another than that of its name as a word: or the word de in English and the word en in
    German would be one."""
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))


def seeded(hashes: np.ndarray, sizes: list[int], langs: list[str]) -> np.ndarray:
    """Hashes of words of so many of each text, with the texts' languages."""
    return mix(hashes + np.repeat(np.array([seed_of(x) for x in langs], np.uint64), sizes))


def coded(hashes: np.ndarray, known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Codes of hashes of words; ``known``: the dictionary's, sorted, with their numbers."""
    out = hashes | HASHED
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[hit] = numbers[at[hit]]
    return out


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A reversible mix of numbers of so many bits."""
    few = np.uint64((1 << bits) - 1)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x * np.uint64(factor)) & few
        x ^= x >> np.uint64((bits + 1) // 2)
    return x


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n words that end at each place, from their codes."""
    out = np.full(len(x), n, np.uint64)
    for k in range(n - 1, -1, -1):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.zeros(min(k, len(x)), np.uint64), x[: len(x) - k]]
        out ^= out >> np.uint64(29)
    out = mix(out) | HASHED
    if n * BITS < 64:
        known = x < HASHED
        every = known.copy()
        for k in range(1, n):
            every[k:] &= known[:-k]
            every[:k] = False
        at = np.flatnonzero(every)
        packed = np.zeros(len(at), np.uint64)
        for k in range(n - 1, -1, -1):
            packed = packed << np.uint64(BITS) | x[at - k]
        out[at] = spread(packed, n * BITS) << np.uint64(63 - n * BITS)
    return out


class Block:
    """Codes of the words of some documents, each after ``order`` - 1 starts: ``numbers`` into ``each``, the different ones;
    ``doc`` the document of each word."""

    def __init__(self, row: dict, order: int) -> None:
        sizes = np.array(row["n_words"], np.int64)
        self.order, self.docs = order, len(sizes)
        self.names, codes = np.unique(np.array(row["lang"], object).astype(str), return_inverse=True) if len(sizes) else (np.empty(0, str), np.empty(0, np.int64))
        self.codes, self.copies = codes, np.array(row["copies"], np.float64)
        starts = seeded(np.full(len(self.names), START), [1] * len(self.names), self.names.tolist()) | HASHED
        words = open_keys(row["words"])
        self.each = np.r_[words, starts]
        self.numbers = np.repeat(len(words) + codes, sizes + order - 1)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.places = np.arange(len(self.doc)) + (order - 1) * (self.doc + 1)
        self.numbers[self.places] = open_places(row["numbers"])
        self.made: dict[int, tuple] = {}

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys of the n-grams and of the contexts that are as long, place of each word's n-gram among them, place
        of each word's context of n words, empty for the highest order)."""
        if n not in self.made:
            # single words are few, so they are sorted before they are looked up
            every = grams(self.each, 1) if n == 1 else grams(self.each[self.numbers], n)
            own = self.numbers[self.places] if n == 1 else self.places
            before = (self.numbers[self.places - 1] if n == 1 else self.places - 1) if n < self.order else np.empty(0, np.int64)
            met = np.zeros(len(every), bool)
            met[own] = True
            met[before] = True
            at, every = np.empty(len(every), np.uint32), every[met]
            first, at[met], _ = grouped(every)
            self.made[n] = every[first], at[own].astype(np.int64), at[before].astype(np.int64)
        return self.made[n]

    def some_word(self, n: int) -> np.ndarray:
        """For each key of a level a word with that n-gram, or that context if no word has it."""
        keys, own, before = self.level(n)
        out = np.empty(len(keys), np.int64)
        out[before] = np.arange(len(before))
        out[own] = np.arange(len(own))
        return out

    def sent(self, n: int, longer: tuple[list[np.ndarray], np.ndarray] | None) -> list[np.ndarray]:
        """The block's share of the level's amounts; ``longer``: amounts and owned keys of the level above."""
        keys, own, before = self.level(n)
        if longer is None:
            return [np.bincount(own, 1.0 / self.copies[self.doc], len(keys))]
        types = np.flatnonzero(longer[1] & (longer[0][-1] > 0))
        word, count = self.some_word(n + 1)[types], longer[0][-1][types]
        context = before[word]
        return [np.bincount(context, count, len(keys)), *(np.bincount(context, kind, len(keys)) for kind in (count == 1, count == 2, count > 2)), np.bincount(own[word], minlength=len(keys)).astype(np.float64)]

    def asked(self, n: int, longer: tuple[list[np.ndarray], np.ndarray] | None, parts: int, turn: int | None = None) -> Iterator[tuple]:
        """The block's requests: of all parts, or of those whose turn it is."""
        keys = self.level(n)[0]
        amounts, codes = self.sent(n, longer), self.codes[self.doc[self.some_word(n)]].astype(np.uint32)
        cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            if turn not in (None, part % TURNS):
                continue
            own = slice(cuts[part], cuts[part + 1])
            yield part, press_keys(keys[own]), [press_amounts(x[own]) for x in amounts], press_numbers(codes[own]), self.names.tolist()

    def nats(self, amounts: dict[int, list[np.ndarray]], stats: dict[tuple[int, str], list[float]]) -> np.ndarray:
        """Minus the log probability of each document under the model of all other texts of its language; by runs of whole
        documents, since each is scored by itself."""
        out = np.zeros(self.docs)
        cuts = {n: np.array([discounts(stats[n, str(x)]) for x in self.names]) for n in range(1, self.order + 1)}
        ends, at, start = np.cumsum(np.bincount(self.doc, minlength=self.docs)), 0, 0
        while start < len(self.doc):
            to = max(at + 1, int(np.searchsorted(ends, start + PIECE, "right")))
            end = int(ends[to - 1])
            if end > start:
                out[at:to] = self.nats_of(slice(start, end), at, to, amounts, stats, cuts)
            at, start = to, end
        return out

    def nats_of(self, run: slice, at: int, to: int, amounts: dict[int, list[np.ndarray]], stats: dict[tuple[int, str], list[float]], cuts: dict[int, np.ndarray]) -> np.ndarray:
        """Those of the documents from ``at`` up to ``to``, whose words are ``run``."""
        docs, langs = self.doc[run] - at, self.codes[at:to]
        levels, lost = {}, None
        for n in range(self.order, 0, -1):
            keys, own, _ = self.level(n)
            count = amounts[n][-1]
            first, back, times = grouped(docs * len(keys) + own[run])
            doc, gram = docs[first], own[run][first]
            all_ = count[gram]
            if lost is None:
                left = all_ - times
            else:  # the types that only this document has don't count here
                left = all_ - np.bincount(back[lost], minlength=len(first))
            lang = langs[doc]
            before, after = (cuts[n].ravel()[4 * lang + np.minimum(x, 3).astype(np.int64)] for x in (all_, left))
            if n > 1:
                context = self.level(n - 1)[2][run][first]
                followed = [x[context] for x in amounts[n - 1][:4]]
                group = grouped(doc * len(self.level(n - 1)[0]) + context)[1]
            else:
                whole = np.array([stats[1, str(x)][4:8] for x in self.names])
                followed, group = [x[lang] for x in whole.T], doc
            total = followed[0] - np.bincount(group, all_ - left)[group]
            spared = sum(x * cuts[n][:, k][lang] for k, x in enumerate(followed[1:], 1)) - np.bincount(group, before - after)[group]
            there = total > 0.5
            total = np.where(there, total, 1.0)
            levels[n] = np.where(there, (left - after) / total, 0.0)[back], np.where(there, spared / total, 1.0)[back]
            lost = first[left < 0.5]
        types = np.array([stats[1, str(x)][8] for x in self.names])
        p = 1.0 / (1.0 + types[langs[docs]])
        for n in range(1, self.order + 1):
            p = levels[n][0] + levels[n][1] * p
        return -np.bincount(docs, np.log(p), to - at)


def discounts(stats: list[float]) -> np.ndarray:
    """Chen and Goodman's discounts for counts of 0 (none), 1, 2 and more, from the numbers of n-grams counted 1 to 4."""
    c = stats[:4]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] + c[1] else 0.5
    made = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] and c[k] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1))])


def answers_of(asked: DataFrame, level: int) -> DataFrame:
    """For each request the sums over all blocks in the order of its keys, and which keys are its own (each key of one block);
    and, with a null block, for each language the numbers of n-grams counted 1 to 4, the sum of the counts, the numbers of
    n-grams counted 1, 2 and more, and all of them."""
    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("amounts", pa.list_(pa.list_(pa.binary()))), ("owner", pa.binary()), ("lang", pa.string()), ("stats", pa.list_(pa.float64()))])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [open_keys(r["keys"]) for r in rows]
        first, back, _ = grouped(np.concatenate(keys))
        owner = np.zeros(len(back), bool)
        owner[first] = True
        sums = [np.round(np.bincount(back, np.concatenate([open_amounts(r["amounts"][k]) for r in rows]), len(first))) for k in range(len(rows[0]["amounts"]))]
        names = {x: k for k, x in enumerate(sorted({x for r in rows for x in r["names"]}))}
        codes = np.concatenate([np.array([names[x] for x in r["names"]], np.int64)[open_numbers(r["codes"], np.uint32)] for r in rows])[first]
        count, out, at = sums[-1], [], 0
        kinds = [count == 1, count == 2, count == 3, count == 4, count, count == 1, count == 2, count > 2, count > 0]
        stats = np.stack([np.bincount(codes, x, len(names)) for x in kinds], 1)
        for r, own in zip(rows, keys, strict=True):
            here = slice(at, at + len(own))
            out.append((r["block"], level, r["part"], [press_amounts(x[back[here]]) for x in sums], pressed(np.packbits(owner[here])), None, None))
            at += len(own)
        out += [(None, level, rows[0]["part"], None, None, x, stats[k].tolist()) for x, k in names.items()]
        del rows, keys, first, back, sums
        trim(False)
        return pa.Table.from_batches([batch_of(schema, zip(*out, strict=True))])

    return asked.groupBy("part").applyInArrow(answer, ANSWERED)


def answered(table: pa.Table) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """level -> (amounts, owned) in the order of the block's keys."""
    out: dict[int, list] = {}
    for r in sorted(table.select(["level", "part", "amounts", "owner"]).to_pylist(), key=lambda r: (r["level"], r["part"])):
        amounts = [open_amounts(x) for x in r["amounts"]]
        out.setdefault(r["level"], []).append((amounts, np.unpackbits(opened(r["owner"], np.uint8), count=len(amounts[0])).astype(bool)))
    return {n: ([np.concatenate(x) for x in zip(*(a for a, _ in got), strict=True)], np.concatenate([o for _, o in got])) for n, got in out.items()}


def with_nats(blocks: DataFrame, order: int, parts: int, scratch: Scratch) -> DataFrame:
    """``block, nats``: minus the log probability of each of a block's documents, in their order. ``blocks``, written to a
    shared folder in buckets of ``block``, have ``block``, lists ``lang, copies, n_words`` with an entry for each document,
    ``words`` (their codes, sorted) and ``numbers`` (each word's place among them). What is written on the way is
    ``scratch``'s."""
    asked_schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("amounts", pa.list_(pa.list_(pa.binary()))), ("codes", pa.binary()), ("names", pa.list_(pa.string()))])
    own = blocks.select("block", "lang", "copies", "n_words", "numbers", "words")

    def top(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in per_batch(batches, 1):
                (row,) = batch.to_pylist()
                for sent in Block(row, order).asked(order, None, parts, turn):
                    yield batch_of(asked_schema, [[x] for x in (row["block"], *sent)])

        return run

    spark, table = blocks.sparkSession, None
    for turn in range(TURNS):
        with swept(spark):
            table = scratch.by(answers_of(own.mapInArrow(tidy(top(turn)), ASKED), order), "block", parts, table)

    def lower(n: int, turn: int):
        def ask(mine: pa.Table, got: pa.Table) -> pa.Table:
            if not mine.num_rows or not got.num_rows:
                return asked_schema.empty_table()
            (row,) = mine.to_pylist()
            block = Block(row, order)
            rows = [(row["block"], *x) for x in block.asked(n, answered(got)[n + 1], parts, turn)]
            del block
            trim(False)
            return pa.Table.from_batches([batch_of(asked_schema, zip(*rows, strict=True))]) if rows else asked_schema.empty_table()

        return ask

    for n in range(order - 1, 0, -1):
        got = spark.table(table).where(f"block is not null and level = {n + 1}")
        for turn in range(TURNS):
            with swept(spark):
                scratch.by(answers_of(own.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(lower(n, turn), ASKED), n), "block", parts, table)
    every = spark.table(table)
    sums = [F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(9)]
    stats = {(r.level, r.lang): [r[f"s{k}"] for k in range(9)] for r in every.where("block is null").groupBy("level", "lang").agg(*sums).collect()}  # a row for each language and level
    shared = spark.sparkContext.broadcast(stats)
    out_schema = pa.schema([("block", pa.int64()), ("nats", pa.list_(pa.float64()))])

    def score(mine: pa.Table, got: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return out_schema.empty_table()
        (row,) = mine.to_pylist()
        block = Block(row, order)
        amounts = {n: a for n, (a, _) in answered(got).items()}
        nats = block.nats(amounts, shared.value)
        del block, amounts
        trim(False)
        return pa.Table.from_batches([batch_of(out_schema, ([row["block"]], [nats]))])

    return own.groupBy("block").cogroup(every.where("block is not null").groupBy("block")).applyInArrow(score, "block long, nats array<double>")
