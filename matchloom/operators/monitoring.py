"""Score monitoring: distributions, drift, calibration, baselines, profiles and daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import parsing, scoring


def monitoring_frame(rows: DataFrame, raw: str = "predicted_fit_score_raw", percent: str = "predicted_fit_score", label: str | None = "actual_label") -> DataFrame:
    """``predicted_score`` in [0, 1] (the raw score where there is one), ``actual_label`` and ``scoring_source``."""
    have = [F.col(c) for c in (raw, percent) if c in rows.columns]
    score = F.coalesce(parsing.score01(F.coalesce(*have)), F.lit(0.0)) if have else F.lit(0.0)
    own = parsing.binary_label(label) if label and label in rows.columns else F.lit(None).cast("double")
    source = F.coalesce("scoring_source", F.lit("unknown")) if "scoring_source" in rows.columns else F.lit("unknown")
    return rows.select(score.alias("predicted_score"), own.alias("actual_label"), source.alias("scoring_source"))


def histogram(rows: DataFrame, percent: Column) -> DataFrame:
    """Five bins of percentages with counts; empty bins are rows too."""
    bins = (("0-20", 20), ("20-40", 40), ("40-60", 60), ("60-80", 80))
    name = F.lit(None).cast("string")
    for text, top in reversed(bins):
        name = F.when(percent < top, text).otherwise(name if text != "60-80" else F.lit("80-100"))
    counts = rows.groupBy(name.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.sql("select explode(array('0-20', '20-40', '40-60', '60-80', '80-100')) as bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def psi(reference: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """Population stability index over ten bins, in one row; null where a side is empty. Each side shrinks to ten counts
    before they meet."""
    sides = reference.select(F.lit(0).alias("side"), F.col(score).alias("s")).unionByName(current.select(F.lit(1).alias("side"), F.col(score).alias("s"))).where("s is not null")
    counts = sides.groupBy(scoring.score_bin(F.col("s")).alias("bin")).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    row = counts.agg(F.collect_list(F.struct("r", "c")).alias("b"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    share = lambda n, total: F.greatest(n / F.greatest(total, F.lit(1)), F.lit(1e-9))
    term = lambda x: (share(x["c"], F.col("nc")) - share(x["r"], F.col("nr"))) * F.ln(share(x["c"], F.col("nc")) / share(x["r"], F.col("nr")))
    total = F.aggregate(F.transform("b", term), F.lit(0.0), lambda a, x: a + x)
    return row.select(F.when((F.col("nr") > 0) & (F.col("nc") > 0), total).alias("psi"))


def ece(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Expected calibration error over ten bins of the labelled rows; null without any."""
    own = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    bins = own.groupBy(scoring.score_bin(F.col(score)).alias("bin")).agg(F.count("*").alias("n"), F.sum(score).alias("p"), F.sum(label).alias("y"))
    return bins.agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def calibration_warning(mean: Column, deviation: Column, most: float = 0.95, least: float = 0.03) -> Column:
    return F.coalesce((mean > most) | (deviation < least), F.lit(False))


def drift(reference: DataFrame, current: DataFrame, job: str, min_rows: int = 30) -> DataFrame:
    """One drift event: rows, PSI, both calibration errors, their difference, the warning, and whether it counts (enough
    current rows and a baseline)."""
    sizes = current.agg(F.count("*").alias("current_rows"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    ref = reference.agg(F.count("*").alias("reference_rows"))
    joined = sizes.crossJoin(ref).crossJoin(psi(reference, current)).crossJoin(ece(reference).withColumnRenamed("ece", "ref_ece")).crossJoin(ece(current).withColumnRenamed("ece", "cur_ece"))  # five one-row frames
    ready = (F.col("current_rows") >= min_rows) & (F.col("reference_rows") > 0)
    return joined.select(F.lit(job).alias("job_title"), "reference_rows", "current_rows", F.when(ready, F.col("psi")).alias("score_psi"), "ref_ece", "cur_ece", F.when(ready, F.col("cur_ece") - F.col("ref_ece")).alias("calibration_drift"), calibration_warning(F.col("m"), F.col("s")).alias("calibration_warning"))


def baseline(events: DataFrame, as_of: Column, days: int = 30, cap: int = 200_000, job: str | None = None) -> DataFrame:
    """The latest valid scores of a job in a rolling window: ``ts, job, score``. The cap is a top-k by time."""
    rows = events.select("event_id", "ts", "job", parsing.score01("score").alias("score")).where("score is not null")
    rows = rows.where((F.col("ts") > as_of - F.make_interval(days=F.lit(days))) & (F.col("ts") <= as_of))
    if job is not None:
        rows = rows.where(F.lower(F.trim("job")) == job.strip().lower())
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(cap)


def baseline_stats(rows: DataFrame) -> DataFrame:
    """Counts, range, mean, deviation, distinct scores and the share of the most frequent; one aggregate over values."""
    each = rows.groupBy("score").agg(F.count("*").alias("n"))
    sums = each.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_scores"), F.max("n").alias("most"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.sum(F.col("score") * F.col("n")).alias("s1"), F.sum(F.col("score") * F.col("score") * F.col("n")).alias("s2"))
    mean = F.col("s1") / F.col("rows")
    return sums.select("rows", "unique_scores", "score_min", "score_max", mean.alias("score_mean"), F.sqrt(F.greatest(F.col("s2") / F.col("rows") - mean * mean, F.lit(0.0))).alias("score_stddev"), (F.col("most") / F.col("rows")).alias("dominant_score_ratio"))


def baseline_gate(stats: DataFrame, min_rows: int = 1_000, min_stddev: float = 0.01, min_unique: int = 50, max_dominant: float = 0.995) -> DataFrame:
    verdict = F.when(F.coalesce("rows", F.lit(0)) < min_rows, "too_few_rows").when(F.col("score_stddev") < min_stddev, "saturated").when(F.col("unique_scores") < min_unique, "few_unique").when(F.col("dominant_score_ratio") > max_dominant, "dominated").otherwise("accept")
    return stats.select("*", verdict.alias("verdict"))


def profile_rows(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Exact profile of the scores of each group."""
    q = F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev(score), F.lit(0.0)).alias("stddev"), F.min(score).alias("min"), F.max(score).alias("max"), q.alias("q"))
    return out.select(*by, "n", "mean", "stddev", "min", "max", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"))


def profile_sketch(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """The same from mergeable quantile sketches: bounded memory for groups of any size."""
    q = F.percentile_approx(score, [0.1, 0.5, 0.9], 10_000)
    out = rows.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev(score), F.lit(0.0)).alias("stddev"), F.min(score).alias("min"), F.max(score).alias("max"), q.alias("q"))
    return out.select(*by, "n", "mean", "stddev", "min", "max", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"))


def daily_drift(events: DataFrame) -> DataFrame:
    """Drift events by day: counts, mean and greatest PSI, mean and greatest absolute calibration drift, six places."""
    known = events.where(F.coalesce(F.trim("day_utc"), F.lit("")) != "")
    return known.groupBy("day_utc").agg(F.count("*").alias("events_count"), F.round(F.avg("score_psi"), 6).alias("score_psi_mean"), F.round(F.max("score_psi"), 6).alias("score_psi_max"), F.round(F.avg("calibration_drift"), 6).alias("calibration_drift_mean"), F.round(F.max(F.abs("calibration_drift")), 6).alias("calibration_drift_abs_max"))


def daily_summary(profiles: DataFrame, drift_by_day: DataFrame, mean_limit: float = 0.95, std_limit: float = 0.03, psi_limit: float = 0.2, calibration_limit: float = 0.05) -> DataFrame:
    """Profiles by day, joined with the day's drift: weighted mean and (as the source has it) weighted mean of deviations,
    range, the ten most frequent jobs, warning, and reasons to retrain."""
    jobs = profiles.groupBy("day_utc", "job_title").agg(F.count("*").alias("c"))
    place = Window.partitionBy("day_utc").orderBy(F.desc("c"), "job_title")
    top = jobs.withColumn("at", F.row_number().over(place)).where("at <= 10").groupBy("day_utc").agg(F.array_sort(F.collect_list(F.struct("at", "job_title", "c"))).alias("t"))
    top = top.select("day_utc", F.transform("t", lambda x: F.struct(x["job_title"].alias("job_title"), x["c"].alias("n"))).alias("top_jobs"))
    n = F.sum("n")
    days = profiles.groupBy("day_utc").agg(F.count("*").alias("profiles_count"), n.alias("rows_total"), F.when(n > 0, F.round(F.sum(F.col("mean") * F.col("n")) / n, 6)).otherwise(F.lit(0.0)).alias("mean_weighted"), F.when(n > 0, F.round(F.sum(F.col("stddev") * F.col("n")) / n, 6)).otherwise(F.lit(0.0)).alias("stddev_weighted"), F.round(F.min("min"), 6).alias("min_score"), F.round(F.max("max"), 6).alias("max_score"))
    joined = days.join(top, "day_utc", "left").join(drift_by_day, "day_utc", "left")
    reasons = F.array_compact(F.array(F.when(F.col("score_psi_max") >= psi_limit, "score_psi"), F.when(F.col("calibration_drift_abs_max") >= calibration_limit, "calibration_drift")))
    return joined.withColumns({"calibration_warning": calibration_warning(F.col("mean_weighted"), F.col("stddev_weighted"), mean_limit, std_limit), "drift_events_count": F.coalesce("events_count", F.lit(0)).cast("long"), "retrain_trigger_reasons": reasons, "retrain_trigger": F.size(reasons) > 0}).drop("events_count")
