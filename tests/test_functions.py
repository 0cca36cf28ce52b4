"""Literal cases of normalisers, parsers, scores, the limiter and fuzzy joins."""

import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from matchloom.functions import fuzzy, parsing, scoring, text
from matchloom.operators import candidates, listing, metrics, monitoring, pairs, skills, taxonomy, vectors
from matchloom.streaming import monitor


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f("x")).collect()]


def test_skill_names(spark):
    given = ["Python3", "python 3.8", "R&D", "C++11", "3.8", "2020", None, "  Node.js  "]
    assert values(spark, given, text.normalize_skill_app) == ["python", "python", "r and d", "c++", "3.", "2020", "", "node.js"]


def test_display(spark):
    assert values(spark, ["sql", "ci/cd", "node.js", "power bi"], text.display_name) == ["SQL", "CI/CD", "Node.Js", "Power Bi"]


def test_dates(spark):
    assert values(spark, ["01/05/2020", "2020-05-01", "13/05/2020", "05/13/2020", "05/01/69", "05/01/68", "x", None], parsing.parse_date) == [datetime.date(2020, 5, 1), datetime.date(2020, 5, 1), datetime.date(2020, 5, 13), datetime.date(2020, 5, 13), datetime.date(1969, 5, 1), datetime.date(2068, 5, 1), None, None]
    assert values(spark, ["01/05/2020"], lambda c: parsing.parse_date(c, parsing.IMPORT_FORMATS)) == [datetime.date(2020, 1, 5)]


def test_scores_and_labels(spark):
    assert values(spark, ["83.4567", "0.5", "250", "-1", "nan", "x", None], parsing.score01) == pytest.approx([0.834567, 0.5, 1.0, 0.0, None, None, None])
    assert values(spark, ["yes", "0", "2", "0.5", "NaN", "maybe", None], parsing.binary_label) == [1.0, 0.0, 1.0, 0.0, None, None, None]
    assert values(spark, ["0.3", "0.6", "0.7", "1.0", "0.0"], lambda c: scoring.score_bin(F.col(c).cast("double"))) == [2, 5, 6, 9, 0]


def test_lists(spark):
    assert values(spark, ["['a', 'b, c']", "a; b |c", "", None], parsing.parse_list) == [["a", "b, c"], ["a", "b", "c"], [], []]
    assert values(spark, ["SQL, sql | R&D"], parsing.parse_skills) == [["sql", "r and d"]]


def test_gap(spark):
    df = spark.sql("select array('python', 'sql', 'powerbi') r, array('python') o")
    matched, missing = candidates.skill_gap(F.col("r"), F.col("o"))
    row = df.select(matched.alias("m"), missing.alias("x"), candidates.gap_ratio(F.col("r"), F.col("o")).alias("g"), candidates.recommendations(missing, F.lit("Analyst"), 2).alias("l")).first()
    assert (row.m, row.x, row.g, len(row.l)) == (["python"], ["sql", "powerbi"], 0.6667, 2)
    assert [x.priority_score for x in row.l] == [1.0, 0.6]
    none = spark.sql("select cast(array() as array<string>) r, array('a') o")
    assert none.select(candidates.gap_ratio(F.col("r"), F.col("o"))).first()[0] == 0.0


def test_split_bucket(spark):
    import hashlib

    keys = ["a", "q-17", "", "ü", "x" * 50]
    assert values(spark, keys, lambda c: scoring.split_bucket(F.col(c))) == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 10000 for k in keys]
    with pytest.raises(ValueError):
        pairs.check_ratios(0.8, 0.1, 0.2)


def test_limiter(spark):
    times = [0, 1, 2, 3, 61.5, 62]
    rows = spark.createDataFrame([("a", float(t)) for t in times] + [("b", 5.0)], "user_id string, ts double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.k, r.t, r.accepted) for r in monitor.rate_limit(rows, most=3).collect())
    assert [x[2] for x in got if x[0] == "a"] == [True, True, True, False, True, True]


def test_fuzzy_overlap_is_brute_force(spark):
    owned, need = ["pyton", "sql", "excel"], ["python", "sql", "power bi"]
    row = pairs.fuzzy_overlap(spark.createDataFrame([(1, owned, need)], "key int, owned array<string>, required array<string>")).first()
    hit = sum(any(SequenceMatcher(None, n, o).ratio() >= 0.85 for o in owned) for n in need)
    assert (round(row.overlap, 6), row.missing) == (round(hit / 3, 6), 3 - hit)


def test_fuzzy_titles_are_brute_force(spark):
    titles, labels = ["software enginer", "data scientst", "nurse", "x"], ["software engineer", "data scientist", "nurses", "xy"]
    index = taxonomy.label_index(spark.createDataFrame([(str(i), [label]) for i, label in enumerate(labels)], "id string, labels array<string>"))
    got = {r.title: r.label for r in taxonomy.match_fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), index).collect()}
    want = {}
    for t in titles:
        best = max(labels, key=lambda x: SequenceMatcher(None, t, x).ratio())
        if SequenceMatcher(None, t, best).ratio() >= 0.92:
            want[t] = best
    assert got == want


def test_fuzzy_titles_of_the_whole_table_are_brute_force(spark, tmp_path):
    """j10 reads parts of any key: here all have keys beyond 1000."""
    from matchloom import queries as core

    parts = [(1000 + 7 * i, f"{a} {b}", f"Brand#{i % 25 + 1}", k) for i, (a, b, k) in enumerate((a, b, k) for a in ("large", "hot", "blue", "cold") for b in ("ring", "bolt", "plate") for k in ("LARGE", "ECONOMY", "SMALL", "PROMO"))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    labels = sorted({(label, f"O{k}") for k, n, b, p in parts for label in (f"{n} {b} {p}", f"{n} alt {b}" if k % 2 == 0 else f"{n} {b} {p}")})
    want = {}
    for _, n, b, p in parts:
        title = f"{n.translate(str.maketrans('aeiou', 'aeioo'))} {b} {p}"
        scores = [(-SequenceMatcher(None, title.lower(), label.lower()).ratio(), label, i) for label, i in labels]
        if -min(scores)[0] >= 0.92:
            want[title] = (*min(scores)[1:], round(-min(scores)[0], 4))
    got = {r.title: (r.label, r.id, r.ratio) for r in core.queries()["j10_fuzzy_title"](spark, str(tmp_path)).collect()}
    assert len(want) > 40 and got == want


def test_sections_and_detection(spark):
    cv = "Jane Doe\nSkills:\n- python, sql; project management\nEDUCATION\nwent to school for some time here and there\n"
    docs = spark.createDataFrame([(1, cv), (2, ""), (3, None)], "doc_id int, text string")
    found = {(r.line, r.section, r.weight) for r in skills.sections(docs).collect()}
    assert ("- python, sql; project management", "skills", 1.1) in found
    assert any(s == "education" and w == 1.1 for _, s, w in found)
    known = spark.createDataFrame([("Python3",), ("SQL",), ("Project Management",), ("Cobol",)], "skill string")
    hits = {r.skill: r.confidence for r in skills.detect(docs, known).collect()}
    assert {"python", "sql", "project management"} <= set(hits) and "cobol" not in hits
    assert all(0 <= c <= 1 for c in hits.values())


def test_daily_summary(spark):
    profile = spark.createDataFrame([("2024-01-01", "a", 100, 0.97, 0.02, 0.9, 1.0)], "day_utc string, job_title string, n long, mean double, stddev double, min double, max double")
    none = spark.createDataFrame([], "day_utc string, score_psi double, calibration_drift double")
    row = monitoring.daily_summary(profile, monitoring.daily_drift(none)).first()
    assert row.calibration_warning and not row.retrain_trigger and row.drift_events_count == 0
    events = spark.createDataFrame([("2024-01-01", 0.25, 0.01), ("2024-01-01", 0.11, -0.07)], none.schema)
    row = monitoring.daily_summary(profile, monitoring.daily_drift(events)).first()
    assert (row.score_psi_max, row.calibration_drift_abs_max, row.retrain_trigger_reasons) == (0.25, 0.07, ["score_psi", "calibration_drift"])


def test_baseline_gate(spark):
    flat = spark.range(1000).select(F.lit(1.0).alias("score"))
    even = spark.range(1000).select((F.col("id") / 1000).alias("score"))
    assert monitoring.baseline_gate(monitoring.baseline_stats(flat)).first().verdict == "saturated"
    assert monitoring.baseline_gate(monitoring.baseline_stats(even)).first().verdict == "accept"


def test_metrics(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 0), ("q", 3, 0.7, 1), ("r", 1, 0.5, 0)], "query string, key int, score double, label int")
    m = metrics.ranking_metrics(rows, 2).first()
    assert (m.precision_at_k, m.recall_at_k, m.map_at_k) == (0.5, 0.5, 0.5)
    a = metrics.curve_areas(rows).first()
    assert a.roc_auc == pytest.approx(0.75)


def test_pages(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, name string")
    assert [r.id for r in listing.page(df, "name", {"name": "name"}, "id").collect()] == [3, 1, 2]
    assert [r.id for r in listing.page(df, "name", {"name": "name"}, "id", True).collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        listing.page(df, "salary", {"name": "name"}, "id")


def test_stream_limiter(spark, tmp_path):
    rows = spark.createDataFrame([("a", float(t)) for t in (1000, 1001, 1002, 1003)], "user_id string, t double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    monitor.run_once(monitor.rate_limit_stream(stream, most=3), "limiter_test", mode="append")
    assert sorted(r.accepted for r in spark.table("limiter_test").collect()) == [False, True, True, True]


def test_ratio_udf_length_bound(spark):
    df = spark.createDataFrame([("abc", "abcdefghij")], "a string, b string")
    assert not df.select(fuzzy.may_reach(F.col("a"), F.col("b"), 0.85)).first()[0]


def test_vector_scores_are_those_of_single_pairs(spark):
    """What a task keeps back is what the threshold, the best k and the rounding would drop, for odd vectors too."""
    rows = [(k, [float(k * a % 7 - 3) / 4 for a in (1, 2, 3)]) for k in range(40)] + [(40, None), (41, []), (42, [1.0]), (43, [1.0, None, 2.0]), (44, [float("nan"), 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.where("id % 4 = 0 or id > 38")
    every = v.crossJoin(q.select(F.col("id").alias("query"), F.col("embedding").alias("q_"))).select("query", "id", scoring.dot(F.col("q_"), F.col("embedding")).alias("score")).cache()

    def same(got, want):
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.select(*got.columns).collect())

    same(vectors.query_scores(q, v, block=9), every)
    same(vectors.query_scores(q, v, places=1), every.withColumn("score", F.round("score", 1)))
    same(vectors.query_scores(q, v, least=0.51), vectors.above(every, 0.51))
    for k in (1, 5, 43):
        same(vectors.top_k(vectors.query_scores(q, v, best=k), k), vectors.top_k(every, k))


def test_gram_keys_are_those_of_single_grams(spark):
    """Keys from texts that are split again are those of each n-gram by itself: versions, marks and short texts."""
    texts = ["python 3.8 sql 37 c++ .net a1.2 3.7 / x", "7", "", "v2 2 2.0.1 +", "Node.js 18\nC# 7.3 - b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {tuple(r) for r in skills.gram_keys(docs).collect()}
    plain = F.regexp_replace("gram", text.VERSION_TAIL, "")
    grams = skills.ngram_rows(docs).select("doc_id", F.regexp_replace(plain, r"[+.#/\- ]", "").alias("key"), F.array_join(F.transform(F.split(plain, " "), lambda w: F.regexp_replace(F.left(w, F.lit(1)), r"[+.#/\-]", "")), "").alias("short")).where("key <> ''").collect()
    assert got == {(r.doc_id, "k", r.key) for r in grams} | {(r.doc_id, "s", r.short) for r in grams if r.short}


def test_detection_deals_only_hits_by_document(spark):
    """Of words and lines without a known skill nothing is shuffled: the plan joins before it deals."""
    docs = spark.createDataFrame([(1, "SKILLS\npython, sql\nother words")], "doc_id int, text string")
    found = skills.detect(docs, spark.createDataFrame([("python",)], "skill string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" not in plan and [tuple(r) for r in found.collect()] == [(1, "python", 0.99, "exact:skills")]


def test_semantic_evidence_from_whole_texts(spark):
    """A phrase after 200 others counts."""
    from matchloom.plans.flows import embedder

    docs = spark.createDataFrame([(1, "\n".join(f"entry{k} word{k} item{k}" for k in range(300)) + "\ndata work")], "doc_id int, text string")
    known = spark.createDataFrame([("data work",)], "skill string")
    got = [(r.canonical, r.source) for r in skills.semantic_hits(docs, known, embedder, 0.95).collect()]
    assert got == [("data work", "semantic:other")]


def test_said_skills_are_those_of_whole_keys(spark):
    texts = ["Tools:\n- Python 3.8, C++ & Perl5; R&D\n* SQL/ 7 |python3", "python\n•python 2,,-; node.js 18 / 3.7", "K8s, k8", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    keys = {r.k for r in skills.phrases(skills.sections(docs)).select(text.skill_key("phrase").alias("k")).collect()} - {""}
    table = spark.createDataFrame([(k,) for k in {*keys, "k8s", "k8", "k", "7"}], "alias string")
    rows = [sorted(str(tuple(r)) for r in f.select("doc_id", "pos", "at", "section", "weight", "alias").collect()) for f in (skills.said(docs, text.skill_key, table), skills.said_skills(docs, table))]
    assert rows[0] == rows[1] and len(rows[0]) > 8


def test_ratios_are_of_different_pairs(spark):
    """The filter on a ratio stays above the aggregate that makes pairs distinct."""
    rows = spark.createDataFrame([(k, ["pyton", "sql"], ["python"]) for k in range(50)], "key int, owned array<string>, required array<string>")
    assert {(r.overlap, r.missing) for r in pairs.fuzzy_overlap(rows).collect()} == {(1.0, 0)}
    two = spark.createDataFrame([("a", "b")], "x string, y string").distinct().withColumn("r", fuzzy.sequence_ratio("x", "y")).where("r >= 0.5")
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate") and "Filter" not in plan[plan.index("Aggregate") :]


def test_label_of_many_occupations(spark):
    """Ids of a label are one before pairs meet them: the least."""
    index = taxonomy.label_index(spark.range(300).select(F.format_string("%05d", "id").alias("id"), F.array(F.lit("data engineer"), F.lit("Data Engineer")).alias("labels")))
    found = taxonomy.match_fuzzy(spark.createDataFrame([("data enginer",)], "title string"), index)
    assert [(r.id, r.label) for r in found.collect()] == [("00000", "Data Engineer")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_leakage_of_several_keys(spark):
    rows = spark.createDataFrame([("train", 1, "a"), ("val", 1, "b"), ("test", 2, "b"), ("train", 2, None)], "s string, n int, t string")
    got = {(r.split_pair, r.key_kind): r.overlap for r in pairs.leakage(rows, F.col("s"), {"n": F.col("n"), "t": F.col("t"), "none": F.lit(None).cast("int")}).collect()}
    assert got == {("train_val", "n"): 1, ("train_test", "n"): 1, ("val_test", "n"): 0, ("train_val", "t"): 0, ("train_test", "t"): 0, ("val_test", "t"): 1, **{(p, "none"): 0 for p in ("train_val", "train_test", "val_test")}}
    plan = pairs.leakage(rows, pairs.hash_split(F.col("t")), {"n": F.col("n"), "t": F.col("t")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 8 and "Union" not in plan  # four quarters, under two limits


def test_ngram_counts_are_those_of_rows(spark):
    texts = ["a b a b a b c", "a", "", None, "b a b a", "x y z x y z x", "a b c d e a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want = {(r.doc_id, r["count"]) for r in skills.ngram_rows(docs).groupBy("doc_id").count().collect()}
    assert len(want) == 5
    for run in (1, 9, 1000):
        assert {(r.doc_id, r.n) for r in skills.ngram_counts(docs, run=run).collect()} == want
