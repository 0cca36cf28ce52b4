"""Line de-duplication by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, small_side, stash


@dataclass(frozen=True)
class LineSpread:
    """A line on ``sites`` distinct sites or more is boilerplate. ``log2_registers`` sizes the sketches (a relative
    error of about 1.04 / 2^(log2_registers / 2)); lines whose estimate is within ``band`` such errors of the threshold
    are counted exactly. Lines of fewer than ``min_words`` words stay."""

    sites: int = 8
    log2_registers: int = 12
    band: float = 5.0
    min_words: int = 1


LINE_END = "\n"


def line_key(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds: 128 bits name a line, so different lines don't meet. (The seed of the second
    comes before the line: a hash that went on from the line's own would collide wherever that does.)"""
    return F.xxhash64(line), F.xxhash64(F.lit("second"), line)


#: A line is frequent if it has more than one in so many of all lines; so there are fewer frequent lines than that.
FREQUENT = 10_000


def line_counts(lines: DataFrame, spec: LineSpread) -> DataFrame:
    """``h, g, n, about, lo, hi``: occurrences of each line, the estimate of its distinct sites, and two of its sites, equal
    where it has one only. ``lines``: rows ``h, g, site`` (a null site counts as one site).

    Every task sketches the sites of each of its lines, and the sketches of a line are merged by the aggregation: what is
    shuffled is one sketch for a line and task, however often the line occurs there."""
    sketch = F.hll_sketch_agg("site", F.lit(spec.log2_registers))
    merged = lines.groupBy("h", "g").agg(F.count("*").alias("n"), sketch.alias("sketch"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    return merged.select("h", "g", "n", F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.hll_sketch_estimate("sketch")).alias("about"))


def spread_lines(lines: DataFrame, spec: LineSpread) -> tuple[DataFrame, DataFrame]:
    """(``h, g`` of the lines that are boilerplate, ``h, g`` of the frequent lines). Lines whose estimate is far from the
    threshold are decided by it; only those near are counted exactly."""
    margin = max(1.0, spec.sites * spec.band * 1.04 / 2 ** (spec.log2_registers / 2))
    wanted = F.col("about") > (spec.sites - margin if spec.sites > 1 else 0)
    counts, total = line_counts(lines, spec), lines.agg(F.count("*").alias("n")).first().n
    often = F.col("n") * FREQUENT > total
    kept = stash(counts.where(wanted | often).select("h", "g", "about", wanted.alias("wanted"), often.alias("often")))
    frequent = kept.where("often").select("h", "g")
    some = kept.where("wanted")
    far = some.where(F.col("about") >= (spec.sites + margin if spec.sites > 1 else 0)).select("h", "g")
    near = some.where(F.col("about") < (spec.sites + margin if spec.sites > 1 else 0)).select("h", "g")
    exact = of_lines(lines.select("h", "g", "site"), near, frequent).distinct().groupBy("h", "g").agg(F.count("site").alias("n")).where(F.col("n") >= spec.sites)
    return stash(far.unionByName(exact.select("h", "g"))), frequent


def of_lines(rows: DataFrame, side: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows joined to a side that has one row for a line. A small side is broadcast. With a large one the frequent
    lines, fewer than FREQUENT whatever the input, are joined by a broadcast all the same, and only the others, none of
    which has more than one in FREQUENT of the rows, are dealt by line: no line is a large task."""
    count = side.count()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), ["h", "g"])
    hot = F.broadcast(side.join(F.broadcast(frequent), ["h", "g"], "left_semi"))
    rest = rows.join(F.broadcast(frequent), ["h", "g"], "left_anti").join(side, ["h", "g"])
    return rows.join(hot, ["h", "g"]).unionByName(rest)


def dedup_lines(docs: DataFrame, spec: LineSpread | None = None, site: str = "source", removed: str = "lines_removed_") -> DataFrame:
    """All columns of ``docs`` with ``text`` less its boilerplate lines, and ``removed``, how many were taken out.

    A boilerplate line stays at its first place, the document of the smallest doc_id (then of the smallest hash of the
    text, then the first line in it), and goes everywhere else; so what copies on many sites share is kept once and no
    content is lost from the corpus. Empty lines and lines of white space stay. A null text stays null, an empty one
    empty; a null site counts as one site; repeated rows are treated alike (all of them are the first place, or none); a
    null doc_id is the smallest. An empty table gives no rows. Other columns are carried along under whatever names (but
    ``removed`` must be free)."""
    spec = spec or LineSpread()
    parts = F.split("text", LINE_END, -1)
    words = F.size(F.filter(F.split(F.col("line"), "[ \\t\\x0B\\f\\r]+", -1), lambda w: w != ""))
    ours = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.xxhash64(F.col(site)), F.lit(0).cast("long")).alias("site"), F.posexplode(parts).alias("pos", "line"))
    h, g = line_key(F.col("line"))
    kept = F.col("line").rlike("[^ \\t\\x0B\\f\\r]") if spec.min_words <= 1 else words >= spec.min_words
    lines = ours.where(kept).select("doc_id", "t", "site", "pos", h.alias("h"), g.alias("g"))
    spread, frequent = spread_lines(lines, spec)
    hits = stash(of_lines(lines, spread, frequent).select("doc_id", "t", "pos", "h", "g"))
    first = stash(hits.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first")))
    gone = of_lines(hits, first, frequent).where(~F.struct("doc_id", "t", "pos").eqNullSafe(F.col("first")))
    of_id, of_text, drop, own = fresh([*docs.columns, removed], "of_id", "of_text", "drop", "text_hash")
    side = small_side(stash(gone.groupBy(F.col("doc_id").alias(of_id), F.col("t").alias(of_text)).agg(F.collect_set("pos").alias(drop))))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    joined = keyed.join(side, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_text)), "left")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(drop), i)), LINE_END)
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(removed))


def line_report(docs: DataFrame, spec: LineSpread | None = None) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_chars, kept_md5`` of each document (a null text: no lines, nothing kept)."""
    before = docs.select("doc_id", "text", "source", F.coalesce(F.size(F.split("text", LINE_END, -1)), F.lit(0)).cast("long").alias("n_lines"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines"))
    out = dedup_lines(before.withColumn("n_lines", n_lines), spec)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.col("lines_removed_").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.md5(F.encode(kept, "UTF-8")).alias("kept_md5"))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM {docs}
), worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]')),
spread AS (SELECT line FROM worded GROUP BY line HAVING count(DISTINCT site) >= 8),
firsts AS (SELECT line, min(doc_id) AS doc_id FROM worded JOIN spread USING (line) GROUP BY line),
places AS (SELECT f.line, f.doc_id, min(w.pos) AS pos FROM firsts f JOIN worded w ON w.line = f.line AND w.doc_id = f.doc_id GROUP BY f.line, f.doc_id),
marked AS (
  SELECT l.doc_id, l.pos, l.line,
    (s.line IS NOT NULL AND NOT (p.line IS NOT NULL)) AS gone
  FROM lines l LEFT JOIN spread s ON s.line = l.line AND regexp_matches(l.line, '[^ \\t\\x0B\\f\\r]')
  LEFT JOIN places p ON p.line = l.line AND p.doc_id = l.doc_id AND p.pos = l.pos
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
"""
