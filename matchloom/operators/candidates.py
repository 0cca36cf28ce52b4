"""Candidates, jobs and their ranking: skill joins, preprocessing, features, scores, gaps and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import parsing, scoring, text


def with_skills(people: DataFrame, owned: DataFrame, skills: DataFrame, key: str, owned_key: str, skill_key: str, name: str) -> DataFrame:
    """Adds ``skills``, each person's distinct skill names in order; people without any get an empty array.

    The pairs are made distinct by a partial aggregate before they are gathered, and one person's skills are few."""
    names = owned.join(skills, owned[skill_key] == skills[skill_key]).groupBy(owned[owned_key].alias(key)).agg(F.sort_array(F.collect_set(name)).alias("skills"))
    return people.join(names, key, "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def job_requirements(jobs: DataFrame, needs: DataFrame, skills: DataFrame) -> DataFrame:
    """Each job's required skills with their level and weight, in the order of their ids."""
    return jobs.join(needs, jobs.id == needs.job_id).join(skills, needs.skill_id == skills.id).select(jobs.id.alias("job_id"), needs.id.alias("need_id"), skills.name, needs.required_level, needs.weight).orderBy("job_id", "need_id")


def preprocess(people: DataFrame, as_of: Column) -> DataFrame:
    """Employee records in the form that features need; years count to a stated day. Where the hire date is missing, a
    given ``experience_years`` counts."""
    hired, left = parsing.parse_date("hire_date"), parsing.parse_date("termination_date")
    years = parsing.years_between(hired, F.coalesce(left, as_of))
    given = parsing.number_or("experience_years") if "experience_years" in people.columns else F.lit(0.0)
    full = text.first_text("full_name", F.trim(F.concat_ws(" ", "first_name", "last_name")))
    return people.select("id", F.coalesce(full, F.lit("Unknown")).alias("full_name"), text.normalize_text("position").alias("position"), text.normalize_text("department").alias("department"), parsing.parse_skill_list("skills").alias("skills"), F.when(hired.isNull(), given).otherwise(years).alias("experience_years"), years.alias("tenure_years"), parsing.performance("performance_score").alias("performance_score"), parsing.scaled("engagement_survey").alias("engagement_score"), parsing.scaled("emp_satisfaction").alias("satisfaction_score"), parsing.active(left, F.col("employment_status")).alias("currently_active"))


def job_skill_names(items: Column) -> Column:
    """Names of a list of requirement structs (``name``, or ``skill.name`` where that is empty); structs without are left out."""
    return F.filter(F.transform(items, lambda x: F.coalesce(text.truthy(x["name"]), text.truthy(x["skill"]["name"]))), lambda x: x.isNotNull())


def preprocess_jobs(jobs: DataFrame) -> DataFrame:
    """Job records in the form that features need. ``required_skills`` is a list of structs or of texts; ``min_experience``
    falls back to ``required_experience_years``, what can't be read counts as 0, and nothing is below 0."""
    kind = jobs.schema["required_skills"].dataType.elementType.typeName()
    names = job_skill_names(F.col("required_skills")) if kind == "struct" else F.col("required_skills")
    given = [F.col(c).cast("string") for c in ("min_experience", "required_experience_years") if c in jobs.columns]
    places = [text.truthy(F.col(c)) for c in ("departement", "department") if c in jobs.columns]
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    skills = F.array_distinct(parsing.some(F.transform(F.coalesce(names, F.array().cast("array<string>")), text.normalize_skill_app)))
    return jobs.select("id", lower(F.col("title")).alias("title"), lower(F.col("description")).alias("description"), lower(F.coalesce(*places)).alias("department"), skills.alias("required_skills"), F.greatest(parsing.number_or(F.coalesce(*given)), F.lit(0.0)).alias("required_experience_years"))


def scored(rows: DataFrame, model=None) -> DataFrame:
    """``score`` (six places), ``score_percent`` (two) and ``source`` for rows with features: the fitted model's
    probability, or the weighted heuristic where there is none. Rows are scored as columns inside the engine's own batches,
    so no batch size is to be chosen."""
    if model is None:
        out = rows.withColumn("score", scoring.ranker_score())
    else:
        from .ranker import predict

        out = predict(model, rows)
    return out.withColumns({"score": F.round("score", 6), "score_percent": F.round(F.col("score") * 100, 2), "source": F.lit("heuristic" if model is None else "model")})


def features(pairs: DataFrame, semantic: Column | None = None) -> DataFrame:
    """The ten features of each pair (``skills``, ``required``, ``experience_years``, ``required_years`` and the
    employee's own scores)."""
    overlap = scoring.overlap(F.col("skills"), F.col("required"))
    some = F.size("required") > 0
    made = {
        "skill_overlap": overlap,
        "missing_skill_ratio": F.when(some, 1.0 - overlap).otherwise(F.lit(0.0)),
        "experience_gap": F.greatest(F.col("required_years") - F.col("experience_years"), F.lit(0.0)),
        "experience_surplus": F.greatest(F.col("experience_years") - F.col("required_years"), F.lit(0.0)),
        "semantic_similarity": F.lit(0.0) if semantic is None else semantic,
    }
    return pairs.withColumns(made)


def contributions(rows: DataFrame, coefficients: dict[str, float], means: dict[str, float] | None = None, scales: dict[str, float] | None = None) -> DataFrame:
    """``breakdown``: an array of (feature, value, contribution, ordinal) of a linear model on standardised features."""
    parts = []
    for k, name in enumerate(scoring.FEATURES):
        x = F.col(name)
        if means:
            x = (x - means[name]) / (scales[name] or 1.0)
        parts.append(F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"), F.round(x * coefficients.get(name, 0.0), 6).alias("contribution"), F.lit(k).alias("ordinal")))
    return rows.withColumn("breakdown", F.array(*parts))


def top_reasons(breakdown: Column, n: int = 3) -> Column:
    """The n greatest positive contributions, or by size where none is positive; ties keep the order of features."""
    positive = F.filter(breakdown, lambda x: x["contribution"] > 0)
    by = lambda arr, f: F.array_sort(arr, lambda a, b: F.when(f(a) > f(b), -1).when(f(a) < f(b), 1).otherwise(a["ordinal"] - b["ordinal"]))
    ordered = F.when(F.size(positive) > 0, by(positive, lambda x: x["contribution"])).otherwise(by(breakdown, lambda x: F.abs(x["contribution"])))
    return F.transform(F.slice(ordered, 1, n), lambda x: text.reason_text(x["feature"], x["value"], x["contribution"]))


def skill_gap(required: Column, owned: Column) -> tuple[Column, Column]:
    """(matched, missing) in the order of the requirements."""
    return F.array_intersect(required, owned), F.array_except(required, owned)


def gap_ratio(required: Column, owned: Column) -> Column:
    n = F.size(F.array_distinct(required))
    return F.when(n > 0, F.round(F.size(F.array_except(required, owned)) / n, 4)).otherwise(F.lit(0.0))


def priority(position: Column, listed: Column) -> Column:
    """1.0 for the first of the listed gaps down to 0.6 for the last, two places."""
    return F.round(1.0 - position / F.greatest(listed - 1, F.lit(1)) * 0.4, 2)


def recommendations(missing: Column, job_title: Column, top: int = 3) -> Column:
    """For each of the first ``top`` gaps: topic, three course titles and a falling priority."""
    listed = F.slice(missing, 1, max(top, 0)) if top > 0 else F.array().cast("array<string>")
    suffix = F.when(text.truthy(F.trim(job_title)).isNotNull(), F.concat(F.lit(" for "), F.trim(job_title))).otherwise(F.lit(""))

    def one(skill: Column, at: Column) -> Column:
        label = text.display_name(skill)
        courses = F.array(F.concat(label, F.lit(" Fundamentals"), suffix), F.concat(F.lit("Applied "), label, F.lit(" Projects"), suffix), F.concat(label, F.lit(" Practice Lab"), suffix))
        return F.struct(skill.alias("missing_skill"), F.trim(F.concat(label, F.lit(" for "), job_title)).alias("learning_topic"), courses.alias("recommended_courses"), priority(at, F.size(listed)).alias("priority_score"))

    return F.transform(listed, one)


def ranked(scored: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The top rows by score, then key: a bounded top-k, not a full sort; ``rank`` from 1."""
    top = scored.orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # at most ``limit`` rows


def rank_candidates(people: DataFrame, job_title: str, required: list[str], min_experience: int, as_of: Column, limit: int = 20) -> DataFrame:
    """Scores every candidate for one job (literal, so nothing is joined) and keeps the best: ``score`` is the percentage
    before rounding; ``predicted_fit_score`` is rounded to two places."""
    need = F.array(*[text.normalize_skill_app(F.lit(x)) for x in required])
    own = parsing.parse_skill_list("skills")
    base = people.withColumns({"required": F.array_distinct(need), "owned": own})
    years = parsing.calendar_years(F.col("hire_date"), as_of)
    base = base.withColumns({"overlap": scoring.overlap(F.col("owned"), F.col("required")), "experience": parsing.experience_score(years.cast("double"), F.lit(float(min_experience))), "performance": parsing.performance_weight("performance_score")})
    raw = 100.0 * scoring.weighted_score(F.col("overlap"), F.col("experience"), F.col("performance"))
    matched, missing = skill_gap(F.col("required"), F.col("owned"))
    rows = base.withColumns({"score": raw, "exp_years": years, "matched_skills": matched, "missing_skills": missing, "skill_gap_ratio": gap_ratio(F.col("required"), F.col("owned")), "learning_recommendations": recommendations(missing, F.lit(job_title))})
    return ranked(rows.withColumn("predicted_fit_score", F.round("score", 2)), "score", "id", limit)
