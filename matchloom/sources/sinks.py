"""Writers of JSON lines, append-only logs, and a registry of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import read_files, suffix


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes JSON lines and returns how many, counted while they are written."""
    seen = Observation("written")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def ingest(spark: SparkSession, source: str, target: str) -> int:
    """Any pair source as JSON lines, unchanged."""
    from .readers import read_pairs

    return write_jsonl(read_pairs(spark, source), target)


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds files to an append-only log; every file has a header, and quotes are doubled, as the readers expect them."""
    rows.write.mode("append").option("header", True).option("escape", "\"").csv(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Adds JSON lines; NaN becomes null."""
    doubles = [c for c, kind in rows.dtypes if kind in ("double", "float")]
    rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}).write.mode("append").json(path)


def json_event(*columns: str):
    """One structured log line; fields that are null are left out."""
    return F.to_json(F.struct(*columns))


def registration(spark: SparkSession, dataset_id: str, path: str) -> DataFrame:
    """One registry row: digest over the files' digests in order of their names, bytes, and records (lines of JSON lines and
    text, rows of CSV and Parquet)."""
    files = read_files(spark, path)
    sums = files.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("f"), F.sum("length").alias("bytes"))
    digest = F.when(F.size("f") == 1, F.col("f")[0]["sha256"]).otherwise(F.sha2(F.array_join(F.transform("f", lambda x: x["sha256"]), "").cast("binary"), 256))
    kind = suffix(path)
    data = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.text(path).where(F.trim("value") != "")
    return sums.select(F.lit(dataset_id).alias("dataset_id"), F.lit(path).alias("path"), digest.alias("sha256"), "bytes").crossJoin(data.agg(F.count("*").alias("record_count")))  # one row each


def upsert_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the new rows in place of those of the same data set."""
    return registry.join(new.select("dataset_id"), "dataset_id", "left_anti").unionByName(new)
