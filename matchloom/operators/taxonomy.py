"""Occupation taxonomy: label index, title matching, code mapping and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import fuzzy, text


def label_index(occupations: DataFrame) -> DataFrame:
    """``key, id, label, ordinal``: one row for each label of each occupation (``id``, ``labels``)."""
    rows = occupations.select("id", F.posexplode("labels").alias("ordinal", "label"))
    return rows.select(text.taxonomy_key("label").alias("key"), "id", "label", "ordinal").where("key <> ''")


def match_exact(titles: DataFrame, index: DataFrame) -> DataFrame:
    """``title, key, match_type, candidates, id``: exact (one candidate), ambiguous (several), empty or unmatched.

    Candidates are counted for each key before the join, so the join adds no rows."""
    keys = index.groupBy("key").agg(F.count("*").alias("candidates"), F.min("id").alias("id"))
    rows = titles.select("title", text.taxonomy_key("title").alias("key")).join(keys, "key", "left")
    n = F.coalesce("candidates", F.lit(0))
    kind = F.when(F.col("key") == "", "empty").when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("unmatched")
    return rows.select("title", "key", kind.alias("match_type"), n.alias("candidates"), F.when(n == 1, F.col("id")).alias("id"))


def match_fuzzy(titles: DataFrame, index: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``title, key, id, label, ratio``: the most similar label of each title, if similar enough.

    Titles meet labels by equal character trigrams, not by a cross join. With u characters of both left over, the matched
    ones lie in u + 1 blocks at most, so 3 * u of a text's trigrams at most are lost; if the texts share one trigram, they
    then share one of the 3 * u + 1 rarest of each. They do from .92 on: M matched characters are 11.5 * u / 2 or more, so
    one block has three. Lengths and character counts, which bound M from above, cut pairs before the UDF. Ties go to the
    smaller label, then id. By the same count pairs are enough above .8, and below that single characters."""
    block = 3 if threshold >= 0.92 else 2 if threshold > 0.8 else 1
    keys = titles.select("title", text.taxonomy_key("title").alias("key")).where("key <> ''")
    labels = index.select(F.col("key").alias("lkey"), "id", "label")

    def grams(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - block + 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(block))))

    left, right = keys.select("key").distinct(), labels.select("lkey").distinct()
    seen = left.select(F.explode(grams("key")).alias("piece")).unionByName(right.select(F.explode(grams("lkey")).alias("piece")))
    seen = seen.groupBy("piece").agg(F.count("*").alias("n"))
    seen = F.broadcast(seen) if seen.count() <= 500_000 else seen

    def pieces(df: DataFrame, c: str, sign: str) -> DataFrame:
        # the other text is at most 2 / threshold - 1 times as long
        most = F.floor(F.length(c) * (1 - threshold) * (2 / threshold) + 1e-9)
        rare = df.select(c, F.explode(grams(c)).alias("piece")).join(seen, "piece").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"))
        rows = rare.select(c, fuzzy.char_bits(F.col(c)).alias(sign), F.slice("p", 1, (block * most + 1).cast("int")).alias("p"))
        return rows.select(c, sign, F.explode("p.piece").alias("piece"))

    close = fuzzy.may_reach(F.col("key"), F.col("lkey"), threshold) & fuzzy.bits_may_reach("key", "lkey", "a", "b", threshold)
    near = pieces(left, "key", "a").join(pieces(right, "lkey", "b"), "piece").where(close).select("key", "lkey").distinct()
    scored = near.withColumn("ratio", fuzzy.sequence_ratio("key", "lkey")).where(F.col("ratio") >= threshold)
    # ids of a label are one before the pairs meet them, so a label of many occupations adds no rows
    named = labels.groupBy("lkey").agg(F.min(F.struct("label", "id")).alias("n"))
    best = scored.join(named, "lkey").groupBy("key").agg(F.min(F.struct((-F.col("ratio")).alias("away"), "n")).alias("b")).select("key", "b.n.id", "b.n.label", (-F.col("b.away")).alias("ratio"))
    return keys.join(best.select("key", "id", "label", "ratio"), "key").select("title", "key", "id", "label", F.round("ratio", 4).alias("ratio"))


def apply_codes(occupations: DataFrame, index: DataFrame, mapping: DataFrame) -> DataFrame:
    """Occupations with the code and title that the last mapping row gives them, by id, else by a label that names one
    occupation. ``mapping`` has row, code, title, id, label."""
    single = index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lid")).where("n = 1").select("key", "lid")
    ids = occupations.select(F.col("id").alias("known"))
    rows = mapping.join(ids, mapping.id == ids.known, "left").withColumn("key", text.taxonomy_key("label")).join(single, "key", "left")
    by_label = F.when(text.truthy("label").isNotNull(), F.col("lid"))
    target = rows.withColumn("target", F.coalesce("known", by_label)).where("target is not null")
    last = target.groupBy("target").agg(F.max_by(F.struct("code", "title"), "row").alias("m"))
    return occupations.join(last, occupations.id == last.target, "left").select(occupations["*"], F.col("m.code").alias("code"), F.col("m.title").alias("code_title"))


def validate_mapping(mapping: DataFrame, occupations: DataFrame, index: DataFrame) -> DataFrame:
    """``row, issue``: missing code and title, code mapped to several ids (against the last id given for it before),
    missing id and label, unknown id, unknown label, id and label of different occupations."""
    first = index.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("ordinal", "id"))).where("rn = 1").select(F.col("key"), F.col("id").alias("lid"))
    before = Window.partitionBy("code").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = mapping.withColumns({"code": F.coalesce(text.truthy("code"), F.lit("")), "id": F.coalesce(text.truthy("id"), F.lit("")), "label": F.coalesce(text.truthy("label"), F.lit("")), "title": F.coalesce(text.truthy("title"), F.lit(""))})
    rows = rows.withColumn("prev", F.when(F.col("code") != "", F.last(F.nullif("id", F.lit("")), ignorenulls=True).over(before)))
    known = occupations.select(F.col("id").alias("known")).distinct()
    rows = rows.join(known, rows.id == known.known, "left").withColumn("key", text.taxonomy_key("label")).join(first, "key", "left")
    some, named = F.col("id") != "", F.col("label") != ""
    issues = F.array_compact(F.array(
        F.when((F.col("code") == "") & (F.col("title") == ""), "no_code"),
        F.when(F.col("prev").isNotNull() & (F.col("prev") != F.col("id")), "code_reused"),
        F.when(~some & ~named, "no_target"),
        F.when(some & F.col("known").isNull(), "unknown_id"),
        F.when(named & F.col("lid").isNull(), "unknown_label"),
        F.when(named & some & F.col("lid").isNotNull() & (F.col("lid") != F.col("id")), "id_label_mismatch"),
    ))
    return rows.select("row", F.explode(issues).alias("issue"))
