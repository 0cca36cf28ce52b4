"""Imports that create or change rows: classification by two keys, and the state after an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(incoming: DataFrame, existing: DataFrame, number: str, email: str, compare: list[str]) -> DataFrame:
    """``outcome`` of each incoming row against a snapshot: invalid (no number), conflict (number and e-mail belong to
    different rows), created, updated or unchanged. Of several incoming rows with one number the first by ``ordinal``
    counts as created, the others as repeated; a sequential import would see them as updates of the first."""
    have = existing.select(F.col(number).alias("n_"), F.lower(F.trim(F.col(email))).alias("e_"), *[F.col(c).alias(f"old_{c}") for c in compare])
    by_number = have.select("n_", F.lit(True).alias("num_hit"), F.col("n_").alias("num_id"), *[f"old_{c}" for c in compare])
    by_email = have.where("e_ is not null and e_ <> ''").groupBy("e_").agg(F.min("n_").alias("mail_id"))
    rows = incoming.join(by_number, F.col(number) == F.col("n_"), "left").join(by_email, F.lower(F.trim(F.col(email))) == F.col("e_"), "left")
    changed = F.lit(False)
    for c in compare:
        new = F.col(c)
        given = new.isNotNull() & (F.trim(new.cast("string")) != "")
        changed = changed | (given & ~new.eqNullSafe(F.col(f"old_{c}")))
    first = F.row_number().over(Window.partitionBy(number).orderBy("ordinal")) == 1
    known = F.col("num_id").isNotNull() | F.col("mail_id").isNotNull()
    outcome = F.when(F.coalesce(F.trim(F.col(number).cast("string")), F.lit("")) == "", "invalid").when(F.col("num_id").isNotNull() & F.col("mail_id").isNotNull() & (F.col("num_id") != F.col("mail_id")), "conflict").when(~known & first, "created").when(~known, "repeated").when(changed, "updated").otherwise("unchanged")
    return rows.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an idempotent upsert: new values win where they are given, rows of either side stay."""
    values = [c for c in existing.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values])
    return existing.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in values])


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
