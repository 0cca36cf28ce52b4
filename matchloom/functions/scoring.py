"""Match features, weighted scores, label types and score bins as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the features; the weights of the scores below are fixed values too.
FEATURES = ("skill_overlap", "missing_skill_ratio", "experience_gap", "experience_surplus", "semantic_similarity", "performance_score", "engagement_score", "satisfaction_score", "tenure_years", "currently_active")
#: Inner edges of ten equal bins as 64-bit floats give them.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def overlap(owned: Column, required: Column) -> Column:
    """Share of the required skills that are owned; 0 without requirements."""
    n = F.size(F.array_distinct(required))
    return F.when(n > 0, F.size(F.array_intersect(required, owned)) / n).otherwise(F.lit(0.0))


def weighted_score(overlap_: Column, experience: Column, performance: Column, semantic: Column | None = None) -> Column:
    if semantic is not None:
        return 0.4 * semantic + 0.3 * overlap_ + 0.2 * experience + 0.1 * performance
    return 0.5 * overlap_ + 0.35 * experience + 0.15 * performance


def match_score(overlap_: Column, experience: Column, performance: Column, numeric: bool = True) -> Column:
    """The weighted score in per cent: a number where the requirements were given, else a struct with its parts."""
    total = F.round(100.0 * weighted_score(overlap_, experience, performance), 2)
    return total if numeric else F.struct(total.alias("total"), overlap_.alias("skill"), experience.alias("experience"), performance.alias("performance"))


def ranker_score() -> Column:
    c = F.col
    raw = 0.35 * c("skill_overlap") + 0.20 * c("semantic_similarity") + 0.15 * F.least(c("experience_surplus") / 5.0, F.lit(1.0)) + 0.10 * (1.0 - F.least(c("experience_gap") / 5.0, F.lit(1.0))) + 0.10 * c("performance_score") + 0.05 * c("engagement_score") + 0.05 * c("satisfaction_score")
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def label_type(score: Column, overlap_: Column, missing: Column, required: Column, title: Column, positive_score: float = 0.75, positive_overlap: float = 0.7, hard_low: float = 0.45, hard_high: float = 0.75, hard_overlap: float = 0.4, easy_score: float = 0.2, easy_overlap: float = 0.2) -> Column:
    """positive, hard_negative, easy_negative or null; pairs without a score go by their overlap."""
    hard = (missing >= 1) & ((overlap_ >= hard_overlap) | ((required <= 1) & (title >= 0.6)))
    whole = (overlap_ >= positive_overlap) & (missing == 0)
    scored = F.when((score >= positive_score) & whole, "positive").when((score >= hard_low) & (score < hard_high) & hard, "hard_negative").when((score <= easy_score) | (overlap_ <= easy_overlap), "easy_negative")
    bare = F.when(whole, "positive").when(hard, "hard_negative").when(overlap_ <= easy_overlap, "easy_negative")
    return F.when(score.isNotNull(), scored).otherwise(bare)


def score_bin(c: Column) -> Column:
    """0 to 9; a score on an edge lies in the bin above it, 1 in the last."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in EDGES), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Dot product of float arrays in double; 0 where one is missing or lengths differ."""
    wide = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def split_bucket(key: Column) -> Column:
    """MD5 of the key, as a 128-bit number, modulo 10,000; computed by quarters, whose numbers are longs."""
    digest = F.md5(key.cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") * (2 ** (128 - 4 * (at + 7)) % 10000)
    return ((part(1) + part(9) + part(17) + part(25)) % 10000).cast("int")
