"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to each block's n-grams, summed per document.

Four tables follow from one another. ``blocks``: documents of about equally many words, as word numbers (written once, so
all that follows speaks of the same blocks). ``requests``: a block's exploded n-grams by level and hash part, each once,
with its count in the block: the block's own sums come before the shuffle. ``answers``: every part adds up its part of the
count table and joins it to the requests, so a request gets its n-grams' counts. The answers of a block meet its words
again, and scores are summed for each document. So a frequent n-gram is one entry of each block, not a row of each
occurrence, and no partition grows with an n-gram's frequency.

Keys are whole 64-bit hashes, sorted and stored as differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch_of, mix, modest_batches, per_batch, stash, tidy, utf8


@dataclass(frozen=True)
class Backoff:
    """Order of the model, the factor of each back-off step, and the least words of a block and of a part of the count
    tables. Both grow with the root of the corpus, so that a block asks a part for ``row`` n-grams or more at once."""

    order: int = 2
    factor: float = 0.4
    block_words: int = 1_500_000
    part_words: int = 1_000_000
    least_parts: int = 64
    row: int = 1_000

    def sizes(self, words: int) -> tuple[int, int]:
        """(words of a block, parts) for a corpus."""
        root = math.isqrt(self.row * words)
        return max(self.block_words, root), max(self.least_parts, -(-words // max(self.part_words, root)))


@dataclass
class Block:
    """Words of some documents as numbers into ``words`` (their hashes, sorted); ``sizes`` words in each document."""

    doc_ids: list
    sizes: np.ndarray
    numbers: np.ndarray
    words: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that end at each word, and whether one does (not before a text's n-th word)."""
        h = self.words[self.numbers]
        out = np.full(len(h), n, np.uint64)
        for k in range(n - 1, -1, -1):
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.zeros(min(k, len(h)), np.uint64), h[: len(h) - k]]
            out ^= out >> np.uint64(29)
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(h)) - np.repeat(starts, self.sizes)
        return mix(out), place >= n - 1


def cut_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[Block]:
    words, ids, sizes, hashes, total = WordHashes(), [], [], [], 0

    def made() -> Block:
        own, numbers = np.unique(np.concatenate(hashes).view(np.uint64) if hashes else np.empty(0, np.uint64), return_inverse=True)
        return Block(ids, np.array(sizes, np.int64), numbers.astype(np.uint32), own)

    for batch in per_batch(batches, 128):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            own = words.of((text or b"").lower().split())
            ids.append(doc_id)
            sizes.append(len(own))
            hashes.append(own)
            total += len(own)
        if total >= block_words:
            yield made()
            ids, sizes, hashes, total = [], [], [], 0
    if ids:
        yield made()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def requests(block: Block, spec: Backoff, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(level, part, keys, counts): the block's distinct n-grams in the order of their hashes, cut by part."""
    for level in range(1, spec.order + 1):
        grams, there = block.grams(level)
        keys, counts = np.unique(grams[there], return_counts=True)
        cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            yield level, part, keys[cuts[part] : cuts[part + 1]], counts[cuts[part] : cuts[part + 1]]


def pressed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def opened(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def press_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, like bytes together: the high ones are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pressed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def open_keys(blob: bytes) -> np.ndarray:
    planes = opened(blob, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def blocks_of(docs: DataFrame, block_words: int) -> DataFrame:
    """``block, doc_ids, sizes, numbers, words``: the documents as word numbers; a block's number is its place in the scan."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("numbers", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(cut_blocks(batches, block_words)):
            yield batch_of(schema, ([first | k], [b.doc_ids], [b.sizes], [pressed(b.numbers)], [press_keys(b.words)]))

    return docs.mapInArrow(tidy(run), "block long, doc_ids array<long>, sizes array<long>, numbers binary, words binary")


def block_of(row: dict) -> Block:
    return Block(row["doc_ids"], np.array(row["sizes"], np.int64), opened(row["numbers"], np.uint32), open_keys(row["words"]))


def requests_of(blocks: DataFrame, spec: Backoff, parts: int) -> DataFrame:
    """``block, level, part, keys, counts``: each block's exploded n-grams and how often they occur in it."""
    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 1):
            (row,) = batch.to_pylist()
            asked = [(row["block"], level, part, press_keys(keys), pressed(counts.astype(np.uint32))) for level, part, keys, counts in requests(block_of(row), spec, parts)]
            if asked:
                yield batch_of(schema, zip(*asked, strict=True))

    return blocks.mapInArrow(tidy(run), "block long, level int, part int, keys binary, counts binary")


def answers_of(asked: DataFrame) -> DataFrame:
    """``block, level, part, counts``: for each request the counts in the whole corpus, in the order of its n-grams. One
    part of one level is one group: the sums of equal keys are its count table, and the requests are joined to it."""

    def answer(table: pa.Table) -> pa.Table:
        keys = [open_keys(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([opened(x, np.uint32) for x in table.column("counts").to_pylist()])
        every = np.concatenate(keys)
        grams, back = np.unique(every, return_inverse=True)
        sums = np.bincount(back, counts, len(grams))  # the count table of this part
        found = np.minimum(sums[back], 0xFFFFFFFF).astype(np.uint32)
        out = [pressed(x) for x in np.split(found, np.cumsum([len(x) for x in keys])[:-1])]
        return pa.table({"block": table.column("block"), "level": table.column("level"), "part": table.column("part"), "counts": pa.array(out, pa.binary())})

    return asked.groupBy("level", "part").applyInArrow(answer, "block long, level int, part int, counts binary")


def scores_of(block: Block, counts: dict[int, np.ndarray], total: int, spec: Backoff) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, words scored below the highest order that their place allows) for each document.

    Counts are those of all other documents: a document's own occurrences are taken off. A word scores c(gram) /
    c(context) at the longest gram that occurs elsewhere, times ``factor`` for each step down; a word that occurs nowhere
    else scores as one occurrence, one step below."""
    n = len(block.numbers)
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    others: dict[int, np.ndarray] = {}
    for level in range(1, spec.order + 1):
        grams, there = block.grams(level)
        _, back = np.unique(grams[there], return_inverse=True)
        key = doc[there].astype(np.int64) * (len(counts[level]) + 1) + back
        _, again, own = np.unique(key, return_inverse=True, return_counts=True)
        others[level] = np.zeros(n)
        others[level][there] = counts[level].astype(np.float64)[back] - own[again]
    rest = (total - block.sizes)[doc].astype(np.float64)
    place = np.arange(n) - np.repeat(np.cumsum(block.sizes) - block.sizes, block.sizes)
    highest = np.minimum(place + 1, spec.order)
    out, open_ = np.zeros(n), np.ones(n, bool)
    for level in range(spec.order, 0, -1):
        hit = open_ & (highest >= level) & (others[level] > 0)
        context = rest if level == 1 else np.r_[0.0, others[level - 1][:-1]]
        out[hit] = np.log(others[level][hit]) - np.log(context[hit]) + np.log(spec.factor) * (highest[hit] - level)
        open_ &= ~hit
        if level == spec.order:
            backed = ~hit & (highest == level)
        else:
            backed |= open_ & (highest == level)
    out[open_] = np.log(spec.factor) * highest[open_] - np.log(np.maximum(rest[open_], 1.0))
    return np.bincount(doc, out, len(block.sizes)), np.bincount(doc, backed, len(block.sizes)).astype(np.int64)


def stupid_backoff(docs: DataFrame, spec: Backoff | None = None) -> DataFrame:
    """``doc_id, n_words, n_backoff, log_score, mean_log_score`` of every document against all the others.

    Words are lower-cased (A-Z) and end at ASCII white space. A null or empty text has no words, a score of 0 and no mean.
    Copies count for one another. Texts of any length are read whole. Rows with a null doc_id are scored; repeated rows are scored each; an empty table gives
    no rows; other columns are ignored."""
    spec, docs = spec or Backoff(), modest_batches(docs).select("doc_id", "text")
    white = "[ \\t\\n\\x0B\\f\\r]+"
    total = docs.agg(F.sum(F.size(F.filter(F.split("text", white), lambda w: w != "")).cast("long")).alias("n")).first().n or 0
    block_words, parts = spec.sizes(total)
    blocks = stash(blocks_of(docs, block_words))
    answers = answers_of(requests_of(blocks, spec, parts))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])

    def score(own: pa.Table, answered: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        block, counts = block_of(own.to_pylist()[0]), {}
        rows = sorted(zip(answered.column("level").to_pylist(), answered.column("part").to_pylist(), range(answered.num_rows), strict=True))
        for level in range(1, spec.order + 1):
            parts = [opened(answered.column("counts")[k].as_py(), np.uint32) for at, _, k in rows if at == level]
            counts[level] = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        logs, backed = scores_of(block, counts, total, spec)
        return pa.Table.from_batches([batch_of(schema, (block.doc_ids, block.sizes, backed, logs))])

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_backoff long, log_score double")
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 3).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))


BACKOFF_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), tokens AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), pairs AS (
  SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS context FROM tokens
), one AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
own_one AS (SELECT doc_id, word, count(*) AS c FROM tokens GROUP BY doc_id, word),
two AS (SELECT context, word, count(*) AS c FROM pairs WHERE context IS NOT NULL GROUP BY context, word),
own_two AS (SELECT doc_id, context, word, count(*) AS c FROM pairs WHERE context IS NOT NULL GROUP BY doc_id, context, word),
sizes AS (SELECT doc_id, len(w) AS n_words, (SELECT count(*) FROM tokens) - len(w) AS rest FROM words),
terms AS (
  SELECT p.doc_id, s.rest, p.context, a.c - oa.c AS c1, coalesce(b.c - ob.c, 0) AS c2, x.c - ox.c AS cx
  FROM pairs p JOIN sizes s USING (doc_id)
  JOIN one a ON a.word = p.word JOIN own_one oa ON oa.doc_id = p.doc_id AND oa.word = p.word
  LEFT JOIN two b ON b.context = p.context AND b.word = p.word LEFT JOIN own_two ob ON ob.doc_id = p.doc_id AND ob.context = p.context AND ob.word = p.word
  LEFT JOIN one x ON x.word = p.context LEFT JOIN own_one ox ON ox.doc_id = p.doc_id AND ox.word = p.context
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE (context IS NOT NULL AND c2 = 0) OR (context IS NULL AND c1 = 0)) AS n_backoff,
    sum(CASE WHEN c2 > 0 THEN ln(c2) - ln(cx)
      WHEN c1 > 0 THEN ln(c1) - ln(rest) + CASE WHEN context IS NULL THEN 0 ELSE ln(0.4) END
      ELSE ln(0.4) * CASE WHEN context IS NULL THEN 1 ELSE 2 END - ln(greatest(rest, 1)) END) AS s
  FROM terms GROUP BY doc_id
)
SELECT z.doc_id, CAST(z.n_words AS BIGINT) AS n_words, CAST(coalesce(s.n_backoff, 0) AS BIGINT) AS n_backoff,
  round(coalesce(s.s, 0.0), 3) AS log_score, CASE WHEN z.n_words > 0 THEN round(s.s / z.n_words, 6) END AS mean_log_score
FROM sizes z LEFT JOIN sums s USING (doc_id)
"""
