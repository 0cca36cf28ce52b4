"""List endpoints: search, filters, whitelisted sorting, pages, look-ups and uniqueness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows where any column holds the term, whatever the case; % and _ in the term are wildcards."""
    if not term or not term.strip():
        return rows
    pattern = f"%{term.strip().lower()}%"
    tests = [F.lower(F.trim(F.col(c))).like(pattern) for c in columns]
    any_ = tests[0]
    for t in tests[1:]:
        any_ = any_ | t
    return rows.where(any_)


def filtered(rows: DataFrame, **contains: str | None) -> DataFrame:
    for column, term in contains.items():
        rows = search(rows, term, column)
    return rows


def page(rows: DataFrame, sort: str, allowed: dict[str, str], key: str, descending: bool = False, skip: int = 0, limit: int = 50, strict: bool = True, default: str | None = None) -> DataFrame:
    """One page. An unknown sort field is an error, or the default field where ``strict`` is off. Ascending order puts
    nulls last, descending order first; the key breaks ties, so pages don't overlap. Spark keeps only skip + limit rows of
    each partition."""
    if sort not in allowed:
        if strict:
            raise ValueError(f"unknown sort field: {sort}")
        sort = default or key
    column = F.col(allowed.get(sort, sort))
    return rows.orderBy(column.desc_nulls_first() if descending else column.asc_nulls_last(), key).offset(skip).limit(limit)


def lookup(rows: DataFrame, **exact) -> DataFrame:
    """The rows whose columns equal these values; text is compared trimmed and without case. The tests reach the scan."""
    for column, value in exact.items():
        given = F.col(column)
        rows = rows.where(F.lower(F.trim(given)) == value.strip().lower() if isinstance(value, str) else given == value)
    return rows


def missing_columns(rows: DataFrame, *required: str) -> DataFrame:
    """``name``: the required columns that a table lacks; empty if it has them all."""
    lacking = [c for c in required if c not in rows.columns]
    return rows.sparkSession.createDataFrame([(c,) for c in lacking], "name string")


def if_match(rows: DataFrame, requests: DataFrame, key: str, tag: Column) -> DataFrame:
    """``requests`` (key, if_match) with ``outcome``: precondition_required without tokens, ok where one of them (commas
    between, ``*`` for any) is the row's tag, etag_mismatch where none is, not_found without a row. A merge of the rows with
    outcome ok is an update that no other can have overtaken."""
    now = rows.select(F.col(key), tag.alias("tag_"))
    joined = requests.join(now, key, "left")
    plain = lambda c: F.trim(F.regexp_replace(F.trim(c), '^W/|"', ""))
    tokens = F.transform(F.split(F.coalesce("if_match", F.lit("")), ","), plain)
    some = F.filter(tokens, lambda x: x != "")
    fits = F.array_contains(some, "*") | F.array_contains(some, plain(F.col("tag_")))
    outcome = F.when(F.size(some) == 0, "precondition_required").when(F.col("tag_").isNull(), "not_found").when(fits, "ok").otherwise("etag_mismatch")
    return joined.withColumn("outcome", outcome).drop("tag_")


def taken(rows: DataFrame, new: DataFrame, column: str, exclude: Column | None = None) -> DataFrame:
    """The new rows whose value exists already, whatever the case."""
    held = rows if exclude is None else rows.where(~exclude)
    keys = held.select(F.lower(F.trim(F.col(column))).alias("k_")).distinct()
    return new.join(keys, F.lower(F.trim(new[column])) == keys.k_, "left_semi")


def violations(rows: DataFrame, unique: list[str], ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Constraints that a table would enforce, as counts: repeated keys, and values out of range."""
    repeated = rows.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique:" + ",".join(unique)).alias("rule"), "n")
    out = repeated
    for column, (low, high) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(column) < low)
        if high is not None:
            bad = bad | (F.col(column) > high)
        out = out.unionByName(rows.agg(F.count_if(bad).alias("n")).select(F.lit(f"range:{column}").alias("rule"), "n"))
    return out
