"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters; each pair verified once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Held, WordHashes, batch_of, grams, modest_batches, per_batch, small_side, stash, tidy, utf8
from .components import components

#: Bins of the suffix signature: how many shingles of a set fall into each range of hashes.
SIGNATURE_BINS = 64


@dataclass(frozen=True)
class JaccardJoin:
    """Parameters: words in a shingle, similarity as a fraction num/den, counters of the frequency table (a power of two;
    4 bytes each, so the broadcast is bounded whatever the input), per cent of a set by which prefixes are longer than
    one common shingle needs, and rounds in which each class tries one partner before what remains is tried in full."""

    words: int = 5
    num: int = 80
    den: int = 100
    counter_bits: int = 22
    longer: int = 3
    star_rounds: int = 1

    def common(self, n):
        """Shingles that the prefixes of two linked sets share at least, if both sets have n or more (a number or Column)."""
        return 1 + (n * self.longer // 100 if isinstance(n, int) else F.floor(n * self.longer / 100))

    def prefix(self, n: int) -> int:
        """Length of the rare-first prefix of a set of n. A link needs an intersection of t >= num/den * n shingles, and the
        first n - t + k shingles of two sets that share t have k in common."""
        return n - -(-self.num * n // self.den) + self.common(n)


def shingle_set(text: bytes | None, words: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lower-cased, words end at ASCII white space, other bytes count as they are."""
    return np.unique(grams(words.of(text.lower().split()), width)) if text else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """Shingles by range of their hashes, as 16-bit counts (held at the greatest; a bound stays a bound)."""
    n = np.bincount((shingles >> np.uint64(64 - SIGNATURE_BINS.bit_length() + 1)).astype(np.int64), minlength=SIGNATURE_BINS)
    return np.minimum(n, 0xFFFF).astype(np.uint16).tobytes()


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


CHUNK_BITS = 16
#: Sets that a task remembers to have met; forgetting them costs repeated rows, which later steps drop.
MEMO = 100_000
#: Words of which a task remembers the hashes. Frequent words are soon met again: 4,000 texts of check_l take .86 CPU seconds
#: with 30,000 and .87 with 150,000, of which they fill 123,247 in 22 MB.
WORDS = 30_000


def sketch_docs(docs: DataFrame, spec: JaccardJoin, keys: tuple[str, ...] = ()) -> DataFrame:
    """One scan: a row for each document (``doc_id``, ``cid`` of its shingle set, ``n``), and for each task chunks of
    shingle counters (``chunk``, ``counts``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary()), *((k, pa.int64()) for k in keys)])
    mask, chunks = np.uint64((1 << spec.counter_bits) - 1), 1 << max(0, spec.counter_bits - CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        words, counts, seen = WordHashes(WORDS), np.zeros(1 << spec.counter_bits, np.uint32), set()
        for batch in per_batch(batches):
            ids, cids, sizes, sigs, slots = batch.column("doc_id").to_pylist(), [], [], [], []
            for text in utf8(batch.column("text")):
                own = shingle_set(text, words, spec.words)
                cids.append(key := set_id(own))
                sizes.append(len(own))
                sigs.append(signature(own))
                if key not in seen:  # copies met in this task count once, as they do in the join
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(key)
                    slots.append(own & mask)
            if slots:
                np.add.at(counts, np.concatenate(slots).astype(np.int64), np.uint32(1))
            yield batch_of(schema, (ids, cids, sizes, sigs, [None] * len(ids), [None] * len(ids), *(batch.column(k) for k in keys)))
        if counts.any():
            parts = np.split(counts, chunks)
            yield batch_of(schema, (*[[None] * chunks] * 4, list(range(chunks)), [zlib.compress(p.tobytes(), 1) for p in parts], *[[None] * chunks for _ in keys]))

    hashed = docs.select("doc_id", "text", *[F.xxhash64("text").alias(k) for k in keys])
    return hashed.mapInArrow(tidy(run), "doc_id long, cid long, n long, sig binary, chunk int, counts binary" + "".join(f", {k} long" for k in keys))


def frequency_table(sketches: DataFrame, spec: JaccardJoin) -> np.ndarray:
    """The summed counters, as float32 ranks: at most 4 * 2^counter_bits bytes, whatever the corpus."""
    import zlib

    width = min(1 << CHUNK_BITS, 1 << spec.counter_bits)
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(width, np.uint64))
                own += np.frombuffer(zlib.decompress(blob), np.uint32)
        for chunk, own in sums.items():
            yield batch_of(schema, ([chunk], [zlib.compress(np.minimum(own, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)]))

    summed = sketches.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(tidy(run), "chunk int, counts binary")
    table = np.zeros(1 << spec.counter_bits, np.uint32)
    for row in summed.collect():  # the chunks of one table of fixed size
        table[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return table


def prefix_rows(docs: DataFrame, table: np.ndarray, spec: JaccardJoin) -> DataFrame:
    """``h``, ``cid``, ``n``, ``pos`` (from 0) of every prefix shingle, once for each distinct set that a task meets."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("h", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
    mask = np.uint64((1 << spec.counter_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, counts = WordHashes(WORDS), set(), shared.value
        for batch in per_batch(batches):
            out = [[], [], [], []]
            for text in utf8(batch.column("text")):
                own = shingle_set(text, words, spec.words)
                if not len(own) or (cid := set_id(own)) in seen:
                    continue
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(cid)
                k = spec.prefix(len(own))
                # rare first, then by hash: sets are sorted by hash, and the sort is stable
                order = np.argsort(counts[(own & mask).astype(np.int64)], kind="stable")[:k]
                for held, value in zip(out, (own[order].view(np.int64), np.full(k, cid, np.int64), np.full(k, len(own), np.int32), np.arange(k, dtype=np.int32)), strict=True):
                    held.append(value)
            if out[0]:
                yield batch_of(schema, map(np.concatenate, out))

    return docs.select("text").mapInArrow(tidy(run), "h long, cid long, n int, pos int")


def sets_of(docs: DataFrame, wanted: DataFrame, spec: JaccardJoin) -> DataFrame:
    """``cid``, ``body`` (sorted hashes) of the wanted classes (``cid``, ``rep``), from the text of one document of each."""
    schema = pa.schema([("cid", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(WORDS)
        for batch in per_batch(batches, 64):
            sets = [shingle_set(t, words, spec.words) for t in utf8(batch.column("text"))]
            yield batch_of(schema, ([set_id(s) for s in sets], [s.tobytes() for s in sets]))

    side = small_side(wanted)
    ours = docs.select("doc_id", "text").join(side.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    made = ours.select("text").mapInArrow(tidy(run), "cid long, body binary")
    # several rows may share the representative's id (or have none): one body of each class is kept
    return made.join(side.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, spec: JaccardJoin, held: Held) -> DataFrame:
    """The pairs (``a``, ``b``) that link. The suffix filter first: where two sets differ by more in their counts by hash
    range than a link allows, no intersection is made (the filter's bound, over fixed ranges instead of a median)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SIGNATURE_BINS).astype(np.int64) for c in ("sig_a", "sig_b"))
            n = x.sum(1) + y.sum(1)
            least = -(-spec.num * n // (spec.den + spec.num))
            full = (x.max(1, initial=0) == 0xFFFF) | (y.max(1, initial=0) == 0xFFFF)
            yield batch.select(["a", "b"]).filter(pa.array((np.abs(x - y).sum(1) <= n - 2 * least) | full, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 128):
            keep = []
            for x, y in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(spec.den * both >= spec.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_(df: DataFrame, source: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(source.select(F.col("cid").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return df

    close = held(with_(pairs, classes, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(near), "a long, b long"))
    named = close.select(F.col("a").alias("cid")).union(close.select("b")).distinct()
    sets = sets.join(named, "cid", "left_semi")
    return with_(close, sets, "body").select("a", "b", "body_a", "body_b").mapInArrow(tidy(run), "a long, b long")


def of_several(rows: DataFrame, column: str) -> DataFrame:
    """The rows of those prefix groups that hold more than one value of the column."""
    group = Window.partitionBy("h")
    return rows.withColumn("lo", F.min(column).over(group)).withColumn("hi", F.max(column).over(group)).where("lo <> hi").drop("lo", "hi")


def candidates(rows: DataFrame, spec: JaccardJoin) -> DataFrame:
    """Prefix rows of classes that can have a partner at all, with ``k``, the shared rows of their class: enough of a
    class's prefix must lie in groups with others (a partner has num/den of its shingles or more, and shares ``common``
    of that many)."""
    each = Window.partitionBy("h", "cid").orderBy("pos")
    # rows are dealt by h once: groups of one class, by far the most, and repeats of a class in a group end here
    once = of_several(rows.repartition("h"), "cid").withColumn("copy", F.row_number().over(each)).where("copy = 1").drop("copy")
    each = Window.partitionBy("cid")
    # ``m``: rows of the class before this one that others have too; what others' prefixes lack up to here, they lack
    counted = once.withColumns({"k": F.count("*").over(each), "m": F.row_number().over(each.orderBy("pos", "h")) - 1})
    able = counted.where(F.col("k") >= spec.common(F.floor(F.col("n") * spec.num / spec.den)))
    return stash(of_several(able, "cid").select("h", "cid", "n", "pos", "k", "m"))


def star_choices(rows: DataFrame, step: int, spec: JaccardJoin) -> DataFrame:
    """At most one partner ``y`` for each class ``cid``. Every prefix group names a member: the one that shares the most of
    its prefix (few edits set it apart from the others, so it links to most of them), in the next step the second, and so
    on; a class takes the one that most of its groups name among those of another root and of fitting size that come
    before itself in this order, so choices form a forest."""
    order = Window.partitionBy("h").orderBy(F.desc("k"), "cid")
    group = Window.partitionBy("h")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(group))
    head = F.when(F.col("place") == 1 + F.lit(step) % F.col("size"), F.struct(F.col("cid").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.col("m").alias("ym"), F.col("root").alias("yroot"), F.col("k").alias("yk")))
    named = placed.withColumn("head", F.max(head).over(group)).select("cid", "n", "pos", "m", "k", "root", "head.*")
    before = (F.col("yk") > F.col("k")) | ((F.col("yk") == F.col("k")) & (F.col("y") < F.col("cid")))
    votes = named.where((F.col("root") != F.col("yroot")) & before & fits(spec)).groupBy("cid", "y").agg(F.count("*").alias("votes"))
    return votes.groupBy("cid").agg(F.max_by("y", F.struct("votes", "y")).alias("y"))


def fits(spec: JaccardJoin):
    """The length filter and the positional filter at a common shingle: what both classes have before it that others have
    too, and what both have from it on, bounds the intersection."""
    length = F.lit(spec.den) * F.least("n", "yn") >= F.lit(spec.num) * F.greatest("n", "yn")
    most = F.least("m", "ym") + F.least(F.col("n") - F.col("pos"), F.col("yn") - F.col("ypos"))
    return length & (F.lit(spec.den + spec.num) * most >= F.lit(spec.num) * (F.col("n") + F.col("yn")))


def shared_least(spec: JaccardJoin):
    """Prefix rows that two linked classes share at least: an intersection of t leaves max(n - prefix) of it at most to
    what lies outside one of the prefixes."""
    outside = lambda n: F.floor(F.col(n) * spec.num / spec.den) - spec.common(F.col(n))  # noqa: E731  n - prefix
    t = F.ceil((F.col("n") + F.col("yn")) * spec.num / (spec.den + spec.num))
    return F.greatest(t - F.greatest(outside("n"), outside("yn")) - 1, F.lit(1))


def all_pairs(rows: DataFrame, spec: JaccardJoin, held: Held) -> DataFrame:
    """Every pair of classes of different roots that passes the filters. In a group, members of its most frequent root
    meet only the others. A pair shares ``shared_least`` rows, so one of them at least is among all but so many of the
    first rows of either class: only at the late rows of one of them, where the positional filter is sharpest, the pair is
    made."""
    group = Window.partitionBy("h")
    counted = rows.withColumn("c", F.count("*").over(Window.partitionBy("h", "root")))
    topped = counted.withColumn("top", F.max(F.struct("c", "root")).over(group)["root"]).drop("c")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("pos"), "h"))
    placed = held(topped.withColumn("late", rank))
    side = placed.where("root <> top")
    other = placed.select("h", *[F.col(c).alias(n) for c, n in (("cid", "y"), ("n", "yn"), ("pos", "ypos"), ("k", "yk"), ("m", "ym"), ("late", "ylate"), ("root", "yroot"))])
    # the class of the pair with fewer rows looks for the other
    mine = F.struct("k", "cid") < F.struct("yk", "y")
    spare = shared_least(spec) - 1
    look = F.when(mine, F.col("late") <= F.col("k") - spare).otherwise(F.col("ylate") <= F.col("yk") - spare)
    met = side.join(other, "h").where((F.col("root") != F.col("yroot")) & look & fits(spec))
    return met.select(F.least("cid", "y").alias("a"), F.greatest("cid", "y").alias("b")).distinct()


def linked_classes(docs: DataFrame, spec: JaccardJoin | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents: ``doc_id``, ``cid``, ``n``; classes in links: ``cid``, ``root``), where classes are equal shingle sets.

    Links between classes decide the components. First every class tries one partner in each of a few rounds, which joins
    nearly all near copies; two classes that are joined already need no verification, since it could not change a
    component. Then all other pairs that pass the filters are verified. So a group of m near copies costs about m pairs a
    round, and no pair that could join two components is left out. No pair is verified twice.
    """
    spec, held = spec or JaccardJoin(), Held()
    docs = modest_batches(docs)
    sketches = stash(sketch_docs(docs, spec, keys))
    members = sketches.where("chunk is null").select("doc_id", "cid", "n", "sig", *keys)
    rows = candidates(prefix_rows(docs, frequency_table(sketches, spec), spec), spec)
    classes = held(members.where("n > 0").join(rows.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    sets = stash(sets_of(docs, classes.select("cid", "rep"), spec))
    tried = links = None
    roots = classes.select("cid", F.col("cid").alias("root"))
    for step in range(spec.star_rounds + 1):
        last = step == spec.star_rounds
        open_ = of_several(rows.join(small_side(roots), "cid"), "root") if step else rows.withColumn("root", F.col("cid"))
        chosen = None if last else held(star_choices(open_, step, spec))
        pairs = all_pairs(open_, spec, held) if last else chosen.select(F.least("cid", "y").alias("a"), F.greatest("cid", "y").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        good = verified(pairs, classes, sets, spec, held)
        if last:
            links = good if links is None else links.union(good)
            break
        good = stash(good)
        tried = pairs if tried is None else tried.union(pairs)
        links = good if links is None else links.union(good)
        # what a class chose becomes its parent, if they link; two jumps make most trees one root
        up = chosen.join(good, (F.least("cid", "y") == F.col("a")) & (F.greatest("cid", "y") == F.col("b"))).select("cid", "y")
        for _ in range(2):
            above = up.select(F.col("cid").alias("y"), F.col("y").alias("z"))
            up = up.join(above, "y", "left").select("cid", F.coalesce("z", "y").alias("y"))
        top = roots.select(F.col("cid").alias("y"), F.col("root").alias("top"))
        moved = up.join(top, "y").select("cid", "top")
        roots = stash(roots.join(moved, "cid", "left").select("cid", F.coalesce("top", "root").alias("root")))
    found = components(stash(links)).select(F.col("node").alias("cid"), "root")
    found = stash(found)
    held.release()
    return members.drop("sig"), found


def near_duplicate_components(docs: DataFrame, spec: JaccardJoin | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest doc_id that links reach, itself included; and with
    ``keys`` (further columns, each the text's hash) also ``group_``, which names a group where ids are null.

    Null and empty texts, and texts of white space, have no shingles and stand alone, each for itself. Equal texts and
    texts with equal shingle sets are linked. Rows with a null doc_id take part; their component is the smallest id that
    is known in it, or null. Columns other than doc_id and text are ignored; repeated rows are returned as often. Texts of
    any length are read whole; an empty table gives no rows.
    """
    members, roots = linked_classes(docs, spec, keys)
    own = members.where("n > 0")
    # a class that no prefix group joins to another is its own root
    tops = own.groupBy("cid").agg(F.min("doc_id").alias("rep")).join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = tops.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = tops.join(low, "root").select("cid", "component_id", F.col("root").alias("group_"))
    also = ["group_", *keys] if keys else []
    full = own.join(of_class, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *also)
    alone = members.where("n = 0").withColumn("group_", F.lit(None).cast("long"))
    return full.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *also))
