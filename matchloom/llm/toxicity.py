"""Toxicity: a linear classifier whose scores may not depend on which group a sentence names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, modest_batches, per_batch, stash, tidy, utf8

# Terms that name a group, by kind. A swap puts another term of the same kind and language in place.
IDENTITY_TERMS = (
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists sikhs",
    "muslim christian jewish hindu buddhist atheist sikh",
    "gay lesbian bisexual transgender queer straight heterosexual",
    "black white asian african latino arab european american",
    "immigrants refugees foreigners migrants natives locals",
    "disabled blind deaf elderly old young",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "schwule lesben transgender heterosexuelle",
    "migranten flüchtlinge ausländer einheimische",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "homosexuels lesbiennes transgenres hétérosexuels",
    "migrants réfugiés étrangers immigrés",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "gays lesbianas transexuales heterosexuales",
    "inmigrantes refugiados extranjeros nativos",
)
EDGES = b".,!?;:*#%$&|()[]<>\"'-"


@dataclass(frozen=True)
class ToxicityModel:
    """``sample`` bounds the labelled rows of each class that the fit uses (the smallest hashes of their ids);
    ``features`` the weights that it keeps; ``terms`` are the group names, a line for each kind; ``pairing`` weighs the
    penalty on score changes between a sentence and its counterfactual twin."""

    sample: int = 3_000
    features: int = 2_000
    hash_bits: int = 22
    min_docs: int = 3
    ridge: float = 1.0
    pairing: float = 4.0
    rounds: int = 300
    rate: float = 0.05
    threshold: float = 0.3
    terms: tuple[str, ...] = IDENTITY_TERMS


def swaps(lines: tuple[str, ...] = IDENTITY_TERMS) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    for line in lines:
        terms = [t.encode() for t in line.split()]
        for here, there in zip(terms, terms[1:] + terms[:1], strict=True):
            out.setdefault(here, there)
    return out


def word_features(word: bytes, bits: int) -> list[int]:
    """Hashed features of a word: itself without marks at its ends, and its beginnings of three to eight bytes."""
    core = word.strip(EDGES)
    return [zlib.crc32(x) >> (32 - bits) for x in (b"w" + core, *(b"p" + core[:k] for k in range(3, 9) if len(core) > k))] if core else []


def text_features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    from collections import Counter

    ids, n = [], []
    for word, k in Counter(words).items():
        own = word_features(word, bits)
        ids += own
        n += [k] * len(own)
    found, back = np.unique(np.array(ids, np.int32), return_inverse=True)
    return found, np.bincount(back, n, len(found)).astype(np.int32)


def twin_features(words: list[bytes], own: tuple[np.ndarray, np.ndarray], other: dict[bytes, bytes], at: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a labelled sentence's counterfactual twin, given its own: each group name is swapped for the next of its
    kind; a sentence that names no group gets a neutral mention of one (the ``at``-th, in turn), which adds that word's
    features. The sentence's label holds for the twin."""
    twin = [w.replace(core, other[core]) if (core := w.strip(EDGES)) in other else w for w in words]
    if twin != words:
        return text_features(twin, bits)
    if not other:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    more = np.array(word_features(sorted(other)[at % len(other)], bits), np.int32)
    found, back = np.unique(np.concatenate([own[0], more]), return_inverse=True)
    return found, np.bincount(back, np.concatenate([own[1], np.ones(len(more), np.int32)]), len(found)).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, spec: ToxicityModel) -> DataFrame:
    """``key, toxic, ids, n, ids2, n2``: features of the sampled rows and of their counterfactual twins (none where no
    terms are given); at most ``sample`` documents of each class, so its size is bounded."""
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.sample) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), *((c, numbers) for c in ("ids", "n", "ids2", "n2"))])
    other, bits = swaps(spec.terms), spec.hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 64):
            rows = []
            for text, key in zip(utf8(batch.column("text")), batch.column("key").to_pylist(), strict=True):
                words = (text or b"").lower().split()
                own = text_features(words, bits)
                rows.append((*own, *twin_features(words, own, other, key & 0xFFFFFFFF, bits)))
            yield batch_of(schema, (batch.column("key"), batch.column("toxic"), *zip(*rows, strict=True)))

    ours = docs.select("doc_id", "text").join(picked, "doc_id").select("text", F.xxhash64("doc_id", "text").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    return stash(ours.mapInArrow(tidy(run), "key long, toxic int, ids array<int>, n array<int>, ids2 array<int>, n2 array<int>"))


def chosen_features(rows: DataFrame, spec: ToxicityModel, n_toxic: int, n_clean: int) -> list[int]:
    """The ``features`` features that tell the classes apart best, by weighted log odds, from a Spark aggregate."""
    each = rows.select("toxic", F.explode(F.arrays_zip("ids", "n")).alias("x")).select("toxic", "x.ids", F.log1p(F.col("x.n")).alias("v"))
    sums = each.groupBy("ids").agg(F.count("*").alias("docs"), F.sum(F.col("v") * F.col("toxic")).alias("a"), F.sum(F.col("v") * (1 - F.col("toxic"))).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    gain = F.round(F.abs(odds) * F.sqrt(F.col("a") + F.col("b")), 9)
    best = sums.where(F.col("docs") >= min(spec.min_docs, n_toxic + n_clean)).select("ids", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "ids").limit(spec.features)
    return sorted(r.ids for r in best.collect())  # at most ``features`` numbers


def fit(rows: DataFrame, spec: ToxicityModel) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, bias) of the least mean loss: log loss, ridge, and ``pairing`` times the squared score
    change between a text and its twin. Without rows of both classes the score is the share of toxic rows. The driver
    gets the chosen features of the sampled rows alone."""
    split = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(split.values())
    if len(split) < 2:
        share = float(np.clip(split.get(1, 0) / total if total else 0.0, 1e-6, 1 - 1e-6))
        return np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share)))
    chosen = np.array(chosen_features(rows, spec, split[1], split[0]), np.int32)
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), *((c, numbers) for c in ("f", "n", "f2", "n2")), ("paired", pa.bool_())])

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, toxic, *parts in zip(*(batch.column(c).to_pylist() for c in ("key", "toxic", "ids", "n", "ids2", "n2")), strict=True):
                row = [key, toxic]
                for ids, n in (parts[:2], parts[2:]):
                    ids, n = np.array(ids, np.int32), np.array(n, np.int32)
                    at = np.minimum(np.searchsorted(chosen, ids), max(0, len(chosen) - 1))
                    hit = chosen[at] == ids if len(chosen) else np.zeros(len(ids), bool)
                    row += [at[hit].astype(np.int32), n[hit]]
                out.append((*row, len(parts[2]) > 0))
            yield batch_of(schema, zip(*out, strict=True))

    fields = "key long, toxic int, f array<int>, n array<int>, f2 array<int>, n2 array<int>, paired boolean"
    table = rows.mapInArrow(tidy(only_chosen), fields).toArrow().sort_by([("key", "ascending"), ("toxic", "ascending")])
    y, paired = table.column("toxic").to_numpy().astype(float), table.column("paired").to_numpy().astype(float)

    def matrix(f: str, n: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = table.column(f).combine_chunks()
        sizes = np.diff(own.offsets.to_numpy())
        return np.repeat(np.arange(len(y)), sizes), own.flatten().to_numpy().astype(np.int64), np.log1p(table.column(n).combine_chunks().flatten().to_numpy())

    (r, f, v), (r2, f2, v2) = matrix("f", "n"), matrix("f2", "n2")
    n, k = len(y), len(chosen)
    w, m, s = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, spec.rounds + 1):
        z = np.bincount(r, v * w[f], n)
        change = (z - np.bincount(r2, v2 * w[f2], n)) * paired
        off = 1 / (1 + np.exp(-z - w[k])) - y
        slope = np.bincount(f, v * (off + 2 * spec.pairing * change)[r], k) - np.bincount(f2, v2 * (2 * spec.pairing * change)[r2], k)
        grad = np.r_[(slope + spec.ridge * w[:k]) / n, off.mean()]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= spec.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return chosen.astype(np.int64), w[:k], float(w[k])


def score_text(text: bytes, place: dict[int, int], weights: np.ndarray, bias: float, bits: int) -> float:
    """The score of one text, feature by feature: the plain form of what ``toxicity`` computes for whole batches."""
    found, n = text_features(text.lower().split(), bits)
    own = [(place[f], k) for f, k in zip(found.tolist(), n.tolist(), strict=True) if f in place]
    z = bias + sum(weights[f] * np.log1p(k) for f, k in own)
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def toxicity(docs: DataFrame, labels: DataFrame, spec: ToxicityModel | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every text; ``keys`` name further columns, each the text's hash.

    Learns only from labels of rows that aren't held out; doc_id, lang, source and labels are no inputs of a score. A
    null or empty text has no features: its score is the bias alone. A row with a null doc_id is scored, not held out.
    Labels that are null or not 0 or 1 teach nothing; of several labels for one doc_id the toxic one counts. Texts are
    read whole; equal texts get equal scores, and repeated rows are returned as often; an empty table gives no rows; other
    columns are ignored, whatever their names."""
    spec, docs = spec or ToxicityModel(), modest_batches(docs)
    chosen, weights, bias = fit(training_rows(docs, labels, spec), spec)
    shared = docs.sparkSession.sparkContext.broadcast((chosen, weights, bias))
    schema, bits, limit = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), *((k, pa.int64()) for k in keys)]), spec.hash_bits, 300_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, bias = shared.value
        place = dict(zip(chosen.tolist(), range(len(chosen)), strict=True))
        hits: list[list[int]] = [[]]  # the kept features of words that have any; most words have none

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= limit:
                    self.clear()
                    del hits[1:]
                own = [place[x] for x in word_features(word, bits) if x in place]
                if own:
                    hits.append(own)
                self[word] = at = len(hits) - 1 if own else 0
                return at

        known = Known()
        for batch in per_batch(batches, 64):
            scores = []
            for text in utf8(batch.column("text")):
                words = (text or b"").lower().split()
                if len(known) + len(words) > limit:  # a clear within a text would mix up its numbers
                    known.clear()
                    del hits[1:]
                if len(words) < limit:
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    own = [f for k in at[at > 0].tolist() for f in hits[k]]
                else:
                    own = [place[x] for w in words for x in word_features(w, bits) if x in place]
                found, n = np.unique(np.array(own, np.int64), return_counts=True)
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[found] @ np.log1p(n) + bias, -60, 60)))))
            yield batch_of(schema, (batch.column("doc_id").to_pylist(), scores, *(batch.column(k) for k in keys)))

    hashed = docs.select("doc_id", "text", *[F.xxhash64("text").alias(k) for k in keys])
    made = hashed.mapInArrow(tidy(run), "doc_id long, score double" + "".join(f", {k} long" for k in keys))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= spec.threshold).cast("int").alias("predicted"), *keys)
