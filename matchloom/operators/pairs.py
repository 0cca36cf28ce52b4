"""Training pairs: cleaning, overlap features, splits, gates, profiles, leakage, label types and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import fuzzy, parsing, scoring, text

from .order import with_ordinals

LABEL_OK = "try_cast(label as int) in (0, 1)"


def clean_pairs(raw: DataFrame) -> DataFrame:
    """Pairs in one shape (C01, N20): alias keys fall through empty values, numbers that can't be read are 0, rows without
    an employee, a job or a label of 0 or 1 go. ``raw`` has structs ``employee`` and ``job``, ``label`` and perhaps
    ``query_id`` and ``job_id``; missing fields count as null."""
    fields = {side: set(raw.schema[side].dataType.fieldNames()) for side in ("employee", "job")}

    def pick(side: str, *names: str) -> Column:
        found = [F.col(f"{side}.`{n}`").cast("string") for n in names if n in fields[side]]
        return text.first_text(*found) if found else F.lit(None).cast("string")

    def skills(side: str, *names: str) -> Column:
        out = []
        for n in names:
            if n in fields[side]:
                kind = raw.schema[side].dataType[n].dataType.typeName()
                made = F.array_distinct(parsing.some(F.transform(F.col(f"{side}.`{n}`"), text.normalize_skill))) if kind == "array" else parsing.parse_skills(F.col(f"{side}.`{n}`"))
                out.append(F.when(F.size(made) > 0, made))
        return F.coalesce(*out, F.array().cast("array<string>"))

    query = [F.col(c).cast("string") for c in ("query_id", "job_id") if c in raw.columns] + [pick("job", "id")]
    employee = F.struct(pick("employee", "id", "employee_id").alias("id"), F.coalesce(pick("employee", "full_name", "name"), F.lit("")).alias("full_name"), F.coalesce(pick("employee", "position", "title"), F.lit("")).alias("position"), F.coalesce(pick("employee", "department", "departement", "dept"), F.lit("")).alias("department"), F.coalesce(pick("employee", "summary", "resume_summary"), F.lit("")).alias("summary"), skills("employee", "skills", "skill", "competences", "competencies").alias("skills"), parsing.number_or(pick("employee", "experience_years", "years_experience")).alias("experience_years"))
    job = F.struct(pick("job", "id", "job_id").alias("id"), F.coalesce(pick("job", "title"), F.lit("")).alias("title"), F.coalesce(pick("job", "description"), F.lit("")).alias("description"), F.coalesce(pick("job", "department", "departement", "dept"), F.lit("")).alias("department"), skills("job", "required_skills", "skills", "must_have_skills", "nice_to_have_skills").alias("required_skills"), parsing.number_or(pick("job", "min_experience", "required_experience_years")).alias("min_experience"))
    good = raw.where(F.col("employee").isNotNull() & F.col("job").isNotNull()).where(LABEL_OK)
    return good.select(text.first_text(*query).alias("query_id"), F.expr("try_cast(label as int)").alias("label"), employee.alias("employee"), job.alias("job"))


def overlap_features(owned: Column, required: Column) -> dict[str, Column]:
    """Counts of distinct skills and the overlap ratio, six places."""
    own, need = F.size(F.array_distinct(owned)), F.size(F.array_distinct(required))
    common = F.size(F.array_intersect(owned, required))
    ratio = F.when(need > 0, F.round(common / need, 6)).otherwise(F.lit(0.0))
    return {"employee_skill_count": own.cast("long"), "required_skill_count": need.cast("long"), "skill_overlap_count": common.cast("long"), "skill_overlap_ratio": ratio}


def add_features(pairs: DataFrame) -> DataFrame:
    made = overlap_features(F.col("employee.skills"), F.col("job.required_skills"))
    return pairs.withColumn("features", F.struct(*[c.alias(k) for k, c in made.items()]))


def check_ratios(train: float, val: float, test: float) -> None:
    if round(train + val + test, 6) != 1.0:
        raise ValueError("Split ratios must sum to 1.")


def hash_split(key: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> Column:
    """A key's split by its MD5 bucket: equal keys always share one. A missing key needs another key (a row id)."""
    check_ratios(train, val, test)
    bucket = scoring.split_bucket(key)
    low, high = int(train * 10_000), int((train + val) * 10_000)
    return F.when(bucket < low, "train").when(bucket < high, "val").otherwise("test")


def split_or_roll(key: Column, row: Column, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> Column:
    """A key's split; a row without a key rolls: a seeded hash of its row id decides, so a repeated run rolls the same."""
    roll = F.concat_ws("|", F.lit(f"roll-{seed}"), row.cast("string"))
    return hash_split(F.coalesce(text.truthy(key.cast("string")), roll), train, val, test)


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys`` and the least ``order`` of each: the row that is seen first wins; a partial aggregate, no window."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"))


def profile_drift(new: DataFrame, old: DataFrame, **columns: str) -> DataFrame:
    """Differences of two one-row profiles, by column: new less old."""
    both = new.select(*[F.col(c).alias(f"new_{c}") for c in columns]).crossJoin(old.select(*[F.col(c).alias(f"old_{c}") for c in columns]))  # one row each
    return both.select(*[(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(name) for c, name in columns.items()])


def time_company_split(time: Column, company: Column, train_cut: str, val_cut: str, holdout: list[str]) -> Column:
    """Held-out companies and rows without a time are test; else by text order against two cut-offs."""
    held = F.lower(F.trim(F.coalesce(company, F.lit("")))).isin([c.strip().lower() for c in holdout]) if holdout else F.lit(False)
    t = text.truthy(time)
    return F.when(held, "test").when(t < train_cut, "train").when(t < val_cut, "val").otherwise("test")


def gate(rows: Column, ratio: Column, no_employee: Column, no_job: Column, min_rows: int, min_ratio: float, max_ratio: float, max_missing: float) -> Column:
    """The first failing check's name, or ``pass``."""
    return F.when(rows < min_rows, "too_few_rows").when((ratio < min_ratio) | (ratio > max_ratio), "positive_ratio").when(no_employee > max_missing, "missing_employee_skills").when(no_job > max_missing, "missing_job_skills").otherwise("pass")


def profile(pairs: DataFrame) -> DataFrame:
    """Totals of a pair set in one row; one aggregate, no shuffle beyond partial sums."""
    return pairs.agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.size("employee.skills") == 0).alias("no_employee_skills"), F.count_if(F.size("job.required_skills") == 0).alias("no_job_skills"))


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent elements, repeats counted; ties by name."""
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def leakage(rows: DataFrame, split: Column, keys: dict[str, Column]) -> DataFrame:
    """``split_pair, key_kind, overlap``: distinct keys that two splits share. One pass: a row's split is computed once for
    all kinds of key, and each key's set of splits is an aggregate of three flags; no split is joined to another."""
    named = [(kind, key.cast("string")) for kind, key in keys.items()]
    each = rows.select(split.alias("split"), *[key.alias(f"k{i}") for i, (_, key) in enumerate(named)])
    each = each.select(*[(F.col("split") == s).alias(s) for s in ("train", "val", "test")], F.inline(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("key")) for i in range(len(named))]))).where("key is not null")
    flags = each.groupBy("kind", "key").agg(*[F.bool_or(s).alias(s) for s in ("train", "val", "test")])
    sums = flags.groupBy("kind").agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))])
    kinds = rows.sparkSession.createDataFrame([(i, kind) for i, (kind, _) in enumerate(named)], "kind int, key_kind string")
    every = kinds.join(sums, "kind", "left").na.fill(0)
    return every.select("key_kind", F.expr("stack(3, 'train_val', train_val, 'train_test', train_test, 'val_test', val_test) as (split_pair, overlap)")).select("split_pair", "key_kind", "overlap")


def pick_per_label(labelled: DataFrame, positives: int = 1, hards: int = 2, easies: int = 2) -> DataFrame:
    """Each query's first rows of each label type (positives by score and overlap, hards by overlap and score, both
    falling; easies rising), for queries that have a positive; a candidate counts once, where it comes first. Ties go by
    candidate. ``labelled`` has query, cand, score, overlap, label_type."""
    kind = F.col("label_type")
    score = F.coalesce(F.col("score"), F.lit(-1.0))
    first = F.when(kind == "positive", -score).when(kind == "hard_negative", -F.col("overlap")).otherwise(F.col("overlap"))
    second = F.when(kind == "positive", -F.col("overlap")).when(kind == "hard_negative", -score).otherwise(score)
    quota = F.when(kind == "positive", positives).when(kind == "hard_negative", hards).otherwise(easies)
    place = Window.partitionBy("query", "label_type").orderBy("s1", "s2", "cand")
    typed = labelled.where(kind.isNotNull()).withColumns({"s1": first, "s2": second, "order": F.when(kind == "positive", 1).when(kind == "hard_negative", 2).otherwise(3)})
    placed = typed.withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= max(positives, hards, easies)).where(F.col("rn") <= quota)
    having = placed.where("label_type = 'positive'").select("query").distinct()
    once = Window.partitionBy("query", "cand").orderBy("order", "rn")
    return placed.join(having, "query", "left_semi").withColumn("again", F.row_number().over(once)).where("again = 1").drop("again", "s1", "s2")


def fill_deficit(pool: DataFrame, need: DataFrame, quota_column: str = "need") -> DataFrame:
    """Rows of a ranked pool (query, label_type, rn) up to what each query still needs of the type."""
    return pool.join(need, ["query", "label_type"]).where(F.col("rn") <= F.col(quota_column)).drop(quota_column)


def augmented(jobs: DataFrame, pool: DataFrame, seen: DataFrame, need: DataFrame) -> DataFrame:
    """``query, cand, overlap, missing, label_type, rn``: negatives from other queries' candidates for what queries still
    need. ``jobs`` has query and required, ``pool`` cand and skills, ``seen`` the pairs (query, cand) that are taken, ``need``
    query, hard and easy. Hard ones by falling overlap, easy ones by rising overlap, then by candidate.

    Not every job meets every candidate: pairs with a common skill come from a join on skills. Of the others, all without
    overlap and equal, a query takes the first of the pool; as many places of the pool are looked at as the query has
    candidates with overlap or taken ones, and what it needs, so enough of them are free."""
    want = need.where("hard > 0 or easy > 0")
    open_ = jobs.join(want, "query").withColumn("required", F.array_distinct("required")).withColumn("n", F.size("required"))
    each = open_.select("query", F.explode("required").alias("skill"))
    held = pool.select("cand", F.explode(F.array_distinct("skills")).alias("skill"))
    common = each.join(held, "skill").groupBy("query", "cand").agg(F.count("*").alias("common"))
    met = common.join(seen.select("query", "cand"), ["query", "cand"], "left_anti").join(open_, "query")
    reach = common.groupBy("query").agg(F.count("*").alias("met_"))
    taken = seen.groupBy("query").agg(F.count("*").alias("taken_"))
    looks = open_.join(reach, "query", "left").join(taken, "query", "left").withColumn("places", F.coalesce("met_", F.lit(0)) + F.coalesce("taken_", F.lit(0)) + F.col("easy"))
    spots = looks.where("easy > 0").select("query", "n", "hard", "easy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("spot"))
    numbered = with_ordinals(pool.select("cand"), "cand", "spot")
    others = spots.join(numbered, "spot").join(common.select("query", "cand"), ["query", "cand"], "left_anti").join(seen.select("query", "cand"), ["query", "cand"], "left_anti")
    rows = met.select("query", "cand", "common", "n", "hard", "easy").unionByName(others.select("query", "cand", F.lit(0).cast("long").alias("common"), "n", "hard", "easy"))
    over = F.when(F.col("n") > 0, F.round(F.col("common") / F.col("n"), 6)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"overlap": over, "missing": F.greatest(F.col("n") - F.col("common"), F.lit(0))})
    kind = scoring.label_type(F.lit(None).cast("double"), F.col("overlap"), F.col("missing"), F.col("n"), F.lit(0.0))
    typed = rows.withColumn("label_type", kind).where("label_type in ('hard_negative', 'easy_negative')")
    order = Window.partitionBy("query", "label_type").orderBy(F.when(F.col("label_type") == "hard_negative", -F.col("overlap")).otherwise(F.col("overlap")), "cand")
    placed = typed.withColumn("rn", F.row_number().over(order))
    return placed.where(F.col("rn") <= F.when(F.col("label_type") == "hard_negative", F.col("hard")).otherwise(F.col("easy"))).select("query", "cand", "overlap", "missing", "label_type", "rn")


def generated(records: DataFrame, jobs: DataFrame, pool: DataFrame, positives: int = 1, hards: int = 2, easies: int = 2) -> DataFrame:
    """``query, cand, label_type, overlap, origin``: the whole generation of pairs. ``records`` has query, cand, score,
    overlap, missing and label_type: each query with a positive picks its first rows of each type (``picked``), and what it
    has too few of comes from other queries' candidates (``augmented``)."""
    picked = pick_per_label(records, positives, hards, easies)
    have = records.groupBy("query").agg(F.count_if(F.col("label_type") == "hard_negative").alias("h"), F.count_if(F.col("label_type") == "easy_negative").alias("e"), F.count_if(F.col("label_type") == "positive").alias("p"))
    need = have.where("p > 0").select("query", F.greatest(hards - F.col("h"), F.lit(0)).alias("hard"), F.greatest(easies - F.col("e"), F.lit(0)).alias("easy"))
    more = augmented(jobs, pool, picked.select("query", "cand"), need)
    return picked.select("query", "cand", "label_type", "overlap", F.lit("picked").alias("origin")).unionByName(more.select("query", "cand", "label_type", "overlap", F.lit("augmented").alias("origin")))


def sampled_negatives(pool: DataFrame, positives: DataFrame, per_positive: int, seed: int) -> DataFrame:
    """For each query, candidates that are none of its positives, in the order of a seeded hash, ``per_positive`` for each
    positive (one at least). The pool is dealt to queries by hashing (query, candidate), so the sample is the same on any
    partitioning."""
    n = positives.groupBy("query").agg(F.greatest(F.count("*") * per_positive, F.lit(1)).alias("quota"))
    left = pool.join(positives.select("query", "cand"), ["query", "cand"], "left_anti")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string"), F.col("cand").cast("string")).cast("binary"))
    placed = left.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(order, "cand")))
    return placed.join(n, "query").where("rn <= quota").select("query", "cand", "rn")


def fuzzy_overlap(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``key, overlap, missing``: a required skill counts if some owned skill equals it or is similar enough.

    Exact hits by array functions first; only required skills without one meet the owned skills, in the pair's own rows,
    and only texts whose lengths allow the ratio reach the UDF, each different pair of texts once. What is similar to a
    required skill is then one list, which a row's owned skills are held against: rows of pairs of texts are not dealt.
    ``pairs`` has key, owned, required."""
    need = F.array_distinct("required")
    base = pairs.select("key", "owned", need.alias("need"), F.size(F.array_intersect(need, "owned")).alias("exact"))
    open_ = base.select("key", F.explode(F.array_except("need", "owned")).alias("want"), "owned")
    met = open_.select("want", F.explode("owned").alias("have")).where(fuzzy.may_reach(F.col("have"), F.col("want"), threshold)).distinct()
    near = met.withColumn("ratio", fuzzy.sequence_ratio("want", "have")).where(F.col("ratio") >= threshold).groupBy("want").agg(F.collect_set("have").alias("like")).localCheckpoint()
    size = F.size("need")
    if near.count() <= 1000:  # one small map goes to every row, which is then counted by itself
        like = F.broadcast(near.agg(F.map_from_entries(F.collect_list(F.struct("want", "like"))).alias("m")))
        close = lambda w: F.arrays_overlap(F.coalesce(F.element_at("m", w), F.array().cast("array<string>")), F.col("owned"))
        both = base.crossJoin(like).select("key", size.alias("n"), (F.col("exact") + F.size(F.filter(F.array_except("need", "owned"), lambda w: F.coalesce(close(w), F.lit(False))))).alias("hit"))
    else:
        hits = open_.join(near, "want").where(F.arrays_overlap("like", "owned")).groupBy("key").agg(F.count_distinct("want").alias("near"))
        both = base.select("key", "exact", size.alias("n")).join(hits, "key", "left").withColumn("hit", F.col("exact") + F.coalesce("near", F.lit(0)))
    return both.select("key", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(F.lit(0.0)).alias("overlap"), F.greatest(F.col("n") - F.col("hit"), F.lit(0)).alias("missing"))
