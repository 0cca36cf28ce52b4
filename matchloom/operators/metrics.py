"""Ranking and classification metrics as windows and aggregates; ties are broken by a row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def per_query(rows: DataFrame, k: int = 10) -> DataFrame:
    """``query, p, r, ap, ndcg`` of each query with a positive; ``rows`` has query, key, score, label (0 or 1).

    Within a query rows are ordered by score, then key. A query's rows are needed in order, so one window over the query
    does all of it; the ideal gain needs no second sort, it follows from the number of positives."""
    order = Window.partitionBy("query").orderBy(F.desc(F.col("score").cast("float")), "key")
    ranked = rows.withColumns({"rank": F.row_number().over(order), "hits": F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    top = F.col("rank") <= k
    hit = top & (F.col("label") == 1)
    sums = ranked.groupBy("query").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_if(hit).alias("hit"), F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("prec"), F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")).where("pos > 0")
    size = F.least(F.lit(k), F.col("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(size, F.col("pos")).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    return sums.select("query", (F.col("hit") / size).alias("p"), (F.col("hit") / F.col("pos")).alias("r"), (F.col("prec") / F.least(F.col("pos"), size)).alias("ap"), F.when(F.col("n") < 2, 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"))


def ranking_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """Means over queries; zeros if no query has a positive."""
    return per_query(rows, k).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("p", "precision_at_k"), ("r", "recall_at_k"), ("ap", "map_at_k"), ("ndcg", "ndcg_at_k"))])


def classification(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 at a threshold, in one pass."""
    said = F.col("score") >= threshold
    true = F.col("label") == 1
    c = rows.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def curve_areas(rows: DataFrame) -> DataFrame:
    """``roc_auc`` (mid-ranks) and ``average_precision`` from counts by distinct score; equal scores are one step of the
    curves, and steps are added up by ranges of scores."""
    each = rows.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    before = running(each, "score", "p", "q", descending=True)
    steps = before.withColumns({"tp": F.col("before_p") + F.col("p"), "fp": F.col("before_q") + F.col("q")})
    sums = steps.agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)).alias("wins"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"))
    return sums.select("pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(F.col("pos") > 0, F.col("area") / F.col("pos")).alias("average_precision"))


def latency(rows: DataFrame, seconds: str, *by: str) -> DataFrame:
    """``n, avg_ms, p95_ms`` of each group: the mean, and the 95th percentile by the exclusive rule (between the two values
    around place 0.95 * (n + 1)) from 20 values on, else the greatest; two places."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(seconds)
    placed = rows.where(F.col(seconds).isNotNull()).select(*by, F.col(seconds).alias("s_")).withColumns({"n_": F.count("*").over(group), "at_": F.row_number().over(order.orderBy("s_"))})
    spot = F.col("n_") * 19 + 19
    low = F.least(F.greatest(F.floor(spot / 20), F.lit(1)), F.col("n_") - 1)
    share = (spot - low * 20) / 20.0
    part = F.when(F.col("at_") == low, F.col("s_") * (1.0 - share)).when(F.col("at_") == low + 1, F.col("s_") * share).otherwise(F.lit(0.0))
    sums = placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg("s_").alias("mean_"), F.sum(part).alias("p_"), F.max("s_").alias("most_"))
    return sums.select(*by, "n", F.round(F.col("mean_") * 1000, 2).alias("avg_ms"), F.round(F.when(F.col("n") >= 20, F.col("p_")).otherwise(F.col("most_")) * 1000, 2).alias("p95_ms"))


def stratified_split(rows: DataFrame, key: Column, label: str, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """``split`` train or valid, the same share of each label, by the order of a seeded hash of the key: the cut is an
    exact rank, found from counts of hash ranges, so no label is sorted in one task."""
    spot = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(4096))
    placed = rows.withColumn("spot_", spot)
    ranges = placed.groupBy(label, "spot_").agg(F.count("*").alias("c_"))
    order = Window.partitionBy(label).orderBy("spot_")
    starts = ranges.withColumns({"start_": F.coalesce(F.sum("c_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all_": F.sum("c_").over(Window.partitionBy(label))}).drop("c_")
    inner = Window.partitionBy(label, "spot_").orderBy(F.xxhash64(key, F.lit(seed)), key)
    at = F.row_number().over(inner)
    joined = placed.withColumn("at_", at).join(F.broadcast(starts), [label, "spot_"])  # at most 4,096 rows for a label
    return joined.withColumn("split", F.when(F.col("at_") + F.col("start_") <= F.round(F.col("all_") * valid), "valid").otherwise("train")).drop("spot_", "at_", "start_", "all_")
