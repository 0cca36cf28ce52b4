"""Best-fit packing of token pieces into sequences under several capacities, planned on the counts of lengths."""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, modest_batches, per_batch, stash, tidy


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents' pieces, and attention cost (the sum of squared piece lengths).
    ``weights`` weigh these three, as shares of their capacity, in the choice of a bin; ``rule`` is ``norm`` (least
    weighted norm of what stays free) or ``dot`` (greatest weighted dot product of free room and piece).

    By default only tokens limit a sequence, so none is opened that its tokens would not need: a piece has a token at
    least, and a sum of squares is at most the square of the sum. The two other capacities choose: of two sequences with
    the same free tokens, the one whose pieces or attention are nearer to full is taken first."""

    tokens: int = 4096
    pieces: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.1, 0.3)
    rule: str = "norm"


#: The tokenizer file's own split pattern; the same for texts of plain characters (whose lower case and normal
#: form are plain, and whose letters and digits Python's own classes tell); and those characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLIT = r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+"
PLAIN = "[ \n!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017f]*"


class WordIds(dict):
    """Token ids by parts of texts, remembered. A plain text is cut into lower-cased parts by the tokenizer's pattern, and
    its parts, which many texts share, go to the merges alone. Any other text is cut at spaces and line feeds, which the
    tokenizer's matches never hold and its normaliser works within, and its words go through the whole tokenizer; such a
    word's key has a space before it."""

    def __init__(self, path: str, limit: int) -> None:
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the model's own memo of words outlives it: every task would leave one in a worker that lives on for the next
        self.tokenizer.model._resize_cache(0)
        self.plain, self.split = re.compile(PLAIN).fullmatch, re.compile(PLAIN_SPLIT).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.pool, self.ends = array("H"), array("q", [0])

    def parts(self, text: str) -> list[str]:
        if self.plain(text) and "<|" not in text:
            return self.split(text.lower())
        return [f" {w}" for w in text.replace("\n", " ").split(" ")]

    def __missing__(self, part: str) -> int:
        if part[0] == " ":
            ids = self.tokenizer.encode(part[1:], add_special_tokens=False).ids
        else:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        self.pool.extend(ids)
        at = self[part] = len(self.ends) - 1
        self.ends.append(len(self.pool))
        return at

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self) > self.limit:
            self.clear()
        numbers = []
        for text in texts:
            parts = self.parts(text)
            numbers.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        pool, ends = np.array(self.pool), np.array(self.ends)
        sizes = np.diff(ends)
        for at in numbers:
            n = sizes[at]
            last = np.cumsum(n)
            yield pool[np.repeat(ends[at] - last + n, n) + np.arange(last[-1])] if len(at) else pool[:0]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, memo: int = 600_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and ``end_id``, cut where longer than ``size``.
    A null text counts as empty, which leaves the end id alone. ``memo`` bounds the words that a task remembers: fewer
    need less memory and more time, and change no result."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer, memo)
        gc.disable()  # the memo's many small lists are no garbage
        for batch in per_batch(batches, 128):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = [[], [], [], [], []]
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), words.texts(texts), strict=True):
                own = np.append(own, end_id).astype("<u4")
                for piece, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size]
                    for held, value in zip(out, (doc_id, piece, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        held.append(value)
            yield batch_of(schema, out)
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """Vector best-fit, longest pieces first, over counts of equal pieces: (bins, [(length, pieces in each bin)...]).

    Bins with the same free room are one group, and equal pieces go to groups in bulk, as one-by-one best-fit would put
    them: a piece prefers the feasible group of the best score, and the next equal piece prefers the bin just used. Time
    and memory depend on the number of different lengths alone, not on the number of pieces."""
    limits = np.array([cap.tokens, cap.pieces, cap.attention], float)
    weights = np.array(cap.weights)
    free, bins, inside = np.empty((0, 3)), [], []
    for length in sorted(counts, reverse=True):
        left, item = counts[length], np.array([length, 1, length * length], float)
        while left:
            rows = np.flatnonzero((free >= item).all(1))
            if len(rows):
                room = free[rows] / limits
                score = ((room - item / limits) ** 2 * weights).sum(1) if cap.rule == "norm" else -(room * (item / limits) * weights).sum(1)
                g = rows[np.argmin(score)]
                each, there, room, held = int((free[g] // item).min()), bins[g], free[g], inside[g]
            else:
                each, there, room, held = int((limits // item).min()), 0, limits, ()
                if not each:
                    raise ValueError(f"a piece of {length} tokens fits in no sequence")
                g = None
            each = min(each, left)
            used = left // each if g is None else min(there, left // each)
            left -= used * each
            state = room - each * item
            if g is not None and used == there:
                free[g], inside[g] = state, (*held, (length, each))
            else:
                if g is not None:
                    bins[g] -= used
                free = np.vstack([free, state])
                bins.append(used)
                inside.append((*held, (length, each)))
    return list(zip(bins, inside, strict=True))


def pack(pieces: DataFrame, cap: Capacity | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``length`` from 1 to the capacity).

    Only the counts of lengths, at most as many as the capacity has tokens, reach the driver. Every piece gets its rank
    among equal lengths from salted windows (a frequent length is split by a hash of the piece), and finds its bin in
    the plan by a binary search. The rank comes from the piece's values, so a repeated task gives the same rows."""
    cap = cap or Capacity()
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    low, per, first, base, bin_no = [], [], [], [], 0
    seen = dict.fromkeys(counts, 0)
    for bins, held in plan(counts, cap):
        offset = 0
        for length, each in held:
            low.append((length << 40) + seen[length])
            per.append(each)
            first.append(bin_no)
            base.append(offset)
            seen[length] += bins * each
            offset += length * each
        bin_no += bins
    order = np.argsort(low, kind="stable")
    arrays = [np.array(x, np.int64)[order] for x in (low, per, first, base)]
    shared = pieces.sparkSession.sparkContext.broadcast(arrays)

    names = pieces.columns
    values = [c for c in ("doc_id", "piece", "ids_crc32") if c in names]
    salts = F.create_map(*[F.lit(x) for k, n in counts.items() if n > 256 for x in (k, min(65_536, -(-n // 256)))]) if any(n > 256 for n in counts.values()) else None
    salt = F.lit(0).cast("long") if salts is None else F.pmod(F.xxhash64(*values), F.coalesce(salts[F.col("length")], F.lit(1)))
    salted = pieces.withColumn("salt", salt)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "salt").orderBy(*values)
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("place") + F.col("skip")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, per, first, base = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            key = (length << 40) + rank
            at = np.searchsorted(low, key, "right") - 1
            into = key - low[at]
            columns = [batch.column(c) for c in names] + [pa.array(first[at] + into // per[at]), pa.array(base[at] + into % per[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(run), fields)


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity | None = None, memo: int = 600_000) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of one id. Texts of any length are cut, none is dropped. Equal rows are packed as
    often as they occur; a null doc_id is kept. An empty table gives no rows. Other columns are ignored."""
    cap, docs = cap or Capacity(), modest_batches(docs)
    return pack(stash(token_pieces(docs, tokenizer, cap.tokens, memo=memo)), cap)
