"""Hilbert-curve sharding: several metadata dimensions become one order, which is cut into runs of equal rows or bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash


@dataclass(frozen=True)
class Layout:
    """Shards, bits of each dimension (cells: 2^(bits * dimensions)), and the law of the cuts: ``rows`` (counts at most
    one apart) or ``bytes`` (a row lies in the shard in which its first byte would lie)."""

    shards: int = 16
    bits: int = 5
    law: str = "rows"


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve of any dimension as a state machine, by Hamilton's construction: (digit, next state) for each
    state * 2^dims + cell bits. A state is the entry corner and the direction of a cell's own curve."""
    size = 1 << dims
    mask = size - 1
    rot = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & mask
    gray = lambda k: k ^ (k >> 1)
    back = {gray(k): k for k in range(size)}
    ones = lambda k: (~k & (k + 1)).bit_length() - 1  # noqa: E731  trailing ones of k
    digits, states = [], []
    for state in range(size * dims):
        entry, direction = state % size, state // size
        for bits in range(size):
            k = back[rot(bits ^ entry, dims - (direction + 1) % dims)]
            start = 0 if k == 0 else gray(2 * ((k - 1) // 2))
            turn = 0 if k == 0 else ones(k - 1) if k % 2 == 0 else ones(k)
            digits.append(k)
            states.append((entry ^ rot(start, direction + 1)) + size * ((direction + turn % dims + 1) % dims))
    return digits, states


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """The curve index of integer coordinates below 2^bits: one look-up for each bit, in SQL functions."""
    dims = len(coordinates)
    digits, states = curve_steps(dims)
    steps = F.array(*[F.lit(d + (s << dims)) for d, s in zip(digits, states, strict=True)])

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for c in coordinates:
            cell = cell * 2 + F.call_function("shiftright", c, level).bitwiseAND(1)
        found = F.element_at(steps, acc["state"] * (1 << dims) + cell + 1)
        return F.struct(F.call_function("shiftright", found, F.lit(dims)).alias("state"), (acc["index"] * (1 << dims) + found.bitwiseAND((1 << dims) - 1)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


#: Name of the dimension that is the size of the text in bytes; no column has such a name.
TEXT_BYTES = "<bytes of text>"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
#: Ranges into which the different values of a dimension are dealt while their places are summed up.
PIECES = 64


def cut_points(rows: DataFrame, name: str, kind: str, cells: int) -> list:
    """The values, ``cells`` - 1 at most, that cut a dimension into cells of about equally many rows; a value with many
    rows occurs as often as it fills cells, so few values are spread over all of the curve's range. Numbers by approximate
    quantiles. Other values by their exact places: the different values are dealt into ranges and numbered there, after
    the rows of the ranges before."""
    if kind.startswith(NUMBERS):
        shares = [i / cells for i in range(1, cells)]
        return sorted(rows.agg(F.percentile_approx(F.col(name).cast("double"), shares, 1_000).alias("q")).first().q or [])
    values = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).agg(F.count("*").alias("n"))
    dealt = stash(values.repartitionByRange(PIECES, "v").select("v", "n", F.spark_partition_id().alias("p")))
    sums = dealt.groupBy("p").agg(F.sum("n").alias("s"))  # a row for each range
    starts = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy()).alias("total"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("own", own).join(F.broadcast(starts), "p")
    cell = F.expr(f"((start + own) * {cells}) div total")  # by the rows of the values before
    ends = placed.groupBy(cell.alias("cell")).agg(F.max("v").alias("v")).orderBy("cell").collect()  # at most ``cells`` rows
    return [r.v for r, after in zip(ends, ends[1:], strict=False) for _ in range(after.cell - r.cell)]


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int) -> DataFrame:
    """``q0..`` for each dimension: 0 for null, else by the dimension's cut points, 2^bits - 1 at most."""
    kinds, out = dict(df.dtypes), df

    def below(value: Column):
        return lambda cut: cut < value

    for k, d in enumerate(dimensions):
        cuts = cut_points(df, d, kinds[d], (1 << bits) - 1)
        value = F.col(d).cast("double" if kinds[d].startswith(NUMBERS) else "string")
        place = F.lit(1) if not cuts else F.lit(1) + F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), below(value)))
        out = out.withColumn(f"q{k}", F.when(F.col(d).isNull(), F.lit(0)).otherwise(place))
    return out


SUBS = 4096


def sharded(docs: DataFrame, layout: Layout | None = None, dimensions: Sequence[str] = ("lang", "source", TEXT_BYTES), row: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, and ``curve``, the row's curve index; with ``row``, a
    column of ``docs`` that numbers its rows, that number as well (as ``row_``).

    The global order is (curve cell, a hash of the row, doc_id, text hash). It needs no global sort: a cell's rows are
    spread over sub-cells by their hash, windows number each sub-cell, and sums over sub-cells and cells (bounded: at most
    SUBS for a cell, at most 2^(bits * dimensions) cells) give each its start. So a cell that holds any share of the rows
    is no large task. Null metadata lies in the first cell of its dimension, a null text has no bytes (size 1, checksum
    0), equal texts have equal checksums and lie near each other, repeated rows take a slot each, and an empty table gives
    no rows. Other columns are ignored. All is DataFrame functions."""
    layout = layout or Layout()
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = (F.length(text) + 1).cast("long")
    dims = [f"d{k}" for k in range(len(dimensions))]
    base = docs.select("doc_id", *[(size if d == TEXT_BYTES else F.col(d)).alias(n) for n, d in zip(dims, dimensions, strict=True)], size.alias("size_"), F.crc32(text).alias("crc_"), F.xxhash64("text").alias("hash_"), *([F.col(row).alias("row_")] if row else []))
    base = stash(base)
    also = ["row_"] if row else []
    celled = quantised(base, dims, layout.bits)
    celled = stash(celled.select("doc_id", "size_", "crc_", "hash_", *also, hilbert_index([F.col(f"q{k}") for k in range(len(dims))], layout.bits).alias("cell")))
    by_bytes = layout.law == "bytes"
    weights = {"row": F.lit(1).cast("long")} | ({"byte": F.col("size_")} if by_bytes else {})
    sums = lambda df, *by: df.groupBy(*by).agg(*[F.sum(w).alias(k) for k, w in weights.items()])
    before = lambda over, k: F.coalesce(F.sum(k).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sums(celled, "cell")
    starts = cells.select("cell", *[before(Window.orderBy("cell"), k).alias(f"cell_{k}") for k in weights], *[F.sum(k).over(Window.partitionBy()).alias(f"all_{k}") for k in weights], F.least(F.ceil(F.col("row") / 64), F.lit(SUBS)).alias("subs"))
    starts = F.broadcast(stash(starts))  # at most 2^(bits * dimensions) rows
    placed = celled.join(starts, "cell").withColumn("sub", F.pmod(F.xxhash64("hash_", "doc_id"), F.col("subs")))
    subs = sums(placed, "cell", "sub")
    subs = subs.select("cell", "sub", *[before(Window.partitionBy("cell").orderBy("sub"), k).alias(f"sub_{k}") for k in weights])
    in_sub = Window.partitionBy("cell", "sub").orderBy("hash_", "doc_id")
    ranked = placed.select("*", *[before(in_sub, w).alias(f"own_{k}") for k, w in weights.items()]).join(subs, ["cell", "sub"])
    ranked = ranked.select("*", *[(F.col(f"cell_{k}") + F.col(f"sub_{k}") + F.col(f"own_{k}")).alias(f"at_{k}") for k in weights])
    cut = "byte" if by_bytes else "row"
    out = ranked.withColumn("shard", F.expr(f"(at_{cut} * {layout.shards}) div all_{cut}").cast("int"))
    if by_bytes:
        out = stash(out)
        firsts = F.broadcast(out.groupBy("shard").agg(F.min("at_row").alias("first_")))  # one row for each shard
        out = out.join(firsts, "shard")
    else:
        out = out.withColumn("first_", F.expr(f"(shard * all_row + {layout.shards - 1}) div {layout.shards}"))
    return out.select("doc_id", F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), F.lit(layout.law).alias("law"), "shard", (F.col("at_row") - F.col("first_")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve"), *also)


def write_shards(docs: DataFrame, path: str, layout: Layout | None = None, dimensions: Sequence[str] = ("lang", "source", TEXT_BYTES)) -> str:
    """Writes ``docs`` as one folder for each shard, rows in curve order, so that the column statistics of files and row
    groups let readers skip most of them for filters on any of the dimensions. Returns the name of the folders' column
    (``shard``, or one that is free).

    Every row is written once: rows are numbered in a written copy, and their places are joined by that number, so equal
    rows and rows without a doc_id are told apart."""
    row, of, slot = fresh(docs.columns, "row", "of_row", "slot")
    shard = "shard" if "shard" not in {c.lower() for c in docs.columns} else fresh(docs.columns, "shard")[0]
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    order = sharded(numbered, layout, dimensions, row).select(F.col("row_").alias(of), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = numbered.join(order, F.col(row) == F.col(of))
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).select(*docs.columns, shard).write.partitionBy(shard).parquet(path)
    return shard
