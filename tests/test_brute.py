"""Queries that SQL can't state, against brute force; the model's life cycle; sinks."""

import json
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from matchloom import queries as core
from matchloom.operators import lifecycle, metrics, order, pairs
from matchloom.plans.analysis import feature_rows
from matchloom.plans.book import Tables

QUERIES = core.queries()


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def similar(a, b):
    return SequenceMatcher(None, a, b).ratio()


def order_sets(spark):
    t = Tables(spark, SMALL)
    out = defaultdict(set)
    for r in t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name").collect():
        out[r.l_orderkey].add(r.p_name)
    return out


def brand_names(spark):
    out = defaultdict(set)
    for r in Tables(spark, SMALL).part.select("p_brand", "p_name").collect():
        out[r.p_brand].add(r.p_name)
    return {b: sorted(names)[:5] for b, names in out.items()}


def test_ratios(spark):
    got = rows(spark, "m01_ratio")
    assert len(got) > 100
    for r in got:
        assert r.ratio == pytest.approx(similar(r.a, r.b), abs=1e-9)


def test_fuzzy_overlap(spark):
    got = {r.key: (r.overlap, r.missing) for r in rows(spark, "j05_fuzzy_overlap")}
    have, need = order_sets(spark), brand_names(spark)
    assert set(got) == {o for o in have if f"Brand#{o % 25 + 1}" in need}
    for o in got:
        own, want = [x.replace("l", "i") for x in have[o]], need[f"Brand#{o % 25 + 1}"]
        hits = sum(any(w == x or similar(w, x) >= 0.85 for x in own) for w in want)
        assert got[o] == (pytest.approx(hits / len(want)), len(want) - hits)


def test_resume_pairs(spark):
    have, need = order_sets(spark), brand_names(spark)
    typed = defaultdict(list)
    for o, own in have.items():
        brand = f"Brand#{o % 25 + 1}"
        if brand not in need:
            continue
        want = need[brand][:2]
        hits = sum(any(w == x or similar(w, x) >= 0.85 for x in own) for w in want)
        over, missing, score = hits / len(want), len(want) - hits, o % 100 / 100 if o % 3 > 0 else None
        hard = missing >= 1 and over >= 0.4
        if score is not None:
            kind = "positive" if score >= 0.75 and over >= 0.7 and not missing else "hard_negative" if 0.45 <= score < 0.75 and hard else "easy_negative" if score <= 0.2 or over <= 0.2 else None
        else:
            kind = "positive" if over >= 0.7 and not missing else "hard_negative" if hard else "easy_negative" if over <= 0.2 else None
        if kind:
            typed[brand, kind].append((over, -1 if score is None else score, o))
    want = set()
    for (brand, kind), found in typed.items():
        if (brand, "positive") in typed:
            key = {"positive": lambda x: (-x[1], -x[0], x[2]), "hard_negative": lambda x: (-x[0], -x[1], x[2]), "easy_negative": lambda x: (x[0], x[1], x[2])}[kind]
            want |= {(brand, x[2], kind, k + 1) for k, x in enumerate(sorted(found, key=key)[: 1 if kind == "positive" else 2])}
    assert {(r.query, r.cand, r.label_type, r.rn) for r in rows(spark, "m25_pairs_from_resumes")} == want and want


def test_sketches_are_near_exact_quantiles(spark):
    exact = {r.job: r for r in rows(spark, "a12_profile_row")}
    got = {r.job: r for r in rows(spark, "m24_profile_sketch")}
    assert set(got) == set(exact)
    for job, r in got.items():
        assert (r.n, r.min, r.max) == (exact[job].n, exact[job].min, exact[job].max)
        for q in ("q10", "median", "q90"):
            assert abs(r[q] - exact[job][q]) < 0.05 * (r.max - r.min) + 1e-9


def test_fuzzy_detection_adds_to_the_exact_one(spark):
    from matchloom.operators import skills

    known = spark.createDataFrame([("python",), ("kubernetes",)], "skill string")
    docs = spark.createDataFrame([(1, "pythn and kubernets"), (2, "python"), (3, "nothing")], "doc_id long, text string")
    got = {(r.doc_id, r.skill): (r.confidence, r.source) for r in skills.detect(docs, known, with_fuzzy=True).collect()}
    ratio = similar("python", "pythn")
    assert got[2, "python"] == (0.98, "exact") and got[1, "kubernetes"] == (0.82, "fuzzy") and not any(d == 3 for d, _ in got)
    assert got[1, "python"] == (round(min(0.82, ratio), 2), "fuzzy")
    plain = {(r.doc_id, r.skill): r.confidence for r in QUERIES["m17_skill_detect"](spark, SMALL).collect()}
    more = {(r.doc_id, r.skill): r.confidence for r in QUERIES["m17_detect_semantic"](spark, SMALL).collect()}
    assert plain and all(more[k] >= v for k, v in plain.items())
    parts = {(r.doc_id, r.canonical): round(r.conf, 2) for r in QUERIES["m17_semantic"](spark, SMALL).collect() if r.conf >= 0.6}
    assert {k: max(plain.get(k, 0), parts.get(k, 0)) for k in {*plain, *parts}} == more


def test_names_without_known_skills(spark):
    from matchloom.operators import skills

    docs = spark.createDataFrame([(1, "python"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.skills for r in skills.skill_names(docs).collect()} == {1: [], 2: []}
    known = spark.createDataFrame([("python",), ("sql",)], "skill string")
    assert {r.doc_id: r.skills for r in skills.skill_names(docs, known).collect()} == {1: ["python"], 2: []}


def test_ranker_metrics(spark):
    (r,) = rows(spark, "m07_ranker_metrics")
    n = Tables(spark, SMALL).orders.count()
    assert r.train_rows + r.valid_rows == n and abs(r.valid_rows - 0.2 * n) <= 2
    assert 0.9 < r.roc_auc <= 1.0 and 0.7 < r.f1 <= 1.0


def test_curve_areas_are_brute_force(spark):
    import random

    rnd = random.Random(2)
    data = [(round(rnd.random(), 2), int(rnd.random() < 0.4)) for _ in range(900)]
    got = metrics.curve_areas(spark.createDataFrame(data, "score double, label int")).first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    area = hits = seen = 0
    for s in sorted({s for s, _ in data}, reverse=True):
        step = [y for x, y in data if x == s]
        hits, seen = hits + sum(step), seen + len(step)
        area += sum(step) * hits / seen
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg)) and got.average_precision == pytest.approx(area / len(pos))


def test_running_sums(spark):
    data = [(k * 7 % 1000, k % 5) for k in range(1000)]
    got = {r.x: r.before_w for r in order.running(spark.createDataFrame(data, "x long, w long"), "x", "w").collect()}
    total = 0
    for x, w in sorted(data):
        assert got[x] == total
        total += w
    assert [r.ordinal for r in order.with_ordinals(spark.createDataFrame(data, "x long, w long"), "x").orderBy("x").collect()] == list(range(1000))


def test_augmentation_takes_what_is_free(spark):
    """A small pool: nearly all of it is seen or has overlap, and what is left is found."""
    jobs = spark.createDataFrame([("j", ["a", "b", "c", "d", "e"])], "query string, required array<string>")
    pool = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"]), (3, ["a"]), (4, []), (5, ["y"])], "cand long, skills array<string>")
    seen = spark.createDataFrame([("j", 2)], "query string, cand long")
    need = spark.createDataFrame([("j", 2, 5)], "query string, hard int, easy int")
    got = [(r.cand, r.label_type) for r in pairs.augmented(jobs, pool, seen, need).collect()]
    assert sorted(got) == [(1, "hard_negative"), (3, "easy_negative"), (4, "easy_negative"), (5, "easy_negative")]


def test_queries_in_blocks(spark):
    from matchloom.operators.vectors import query_scores

    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "id long, embedding array<double>")
    got = {(r["query"], r.id): r.score for r in query_scores(v, v, block=7).collect()}
    assert got == {(a, b): a * b + 1.0 for a in range(30) for b in range(30)}


def test_fuzzy_titles_at_lower_thresholds(spark):
    from matchloom.operators import taxonomy

    labels = ["data engineer", "nurse", "cook", "bus driver", "teacher"]
    index = taxonomy.label_index(spark.createDataFrame([(str(k), [x]) for k, x in enumerate(labels)], "id string, labels array<string>"))
    titles = ["date enginer", "nurze", "kok", "busdriver", "teach", "zzz"]
    for threshold in (0.85, 0.5):
        got = {r.title: r.label for r in taxonomy.match_fuzzy(spark.createDataFrame([(t,) for t in titles], "title string"), index, threshold).collect()}
        want = {}
        for t in titles:
            best = max(labels, key=lambda x: (similar(t, x), [-ord(c) for c in x]))
            if similar(t, best) >= threshold:
                want[t] = best
        assert got == want


def test_life_of_a_model(spark, tmp_path):
    folder = str(tmp_path / "models")
    info = lifecycle.model_info(spark, folder)
    assert (info["artifact_exists"], info["model_loaded"], info["dataset_version"], info["trained_at_utc"], info["metrics"]) == (False, False, None, None, {})
    data = feature_rows(Tables(spark, SMALL)).withColumn("label", ((F.col("skill_overlap") > 0.4) & (F.col("experience_gap") < 3)).cast("int"))
    first = lifecycle.retrain(data, "key", folder, "v1", "2026-03-27T00:00:00Z", "demo_dataset_v1")
    info = lifecycle.model_info(spark, folder)
    assert info["artifact_exists"] and info["model_loaded"] and info["metadata"]["model_name"] == "candidate_matcher"
    assert (info["dataset_version"], info["trained_at_utc"], info["metrics"]["roc_auc"]) == ("demo_dataset_v1", "2026-03-27T00:00:00Z", first["roc_auc"])
    noise = data.withColumn("label", (F.xxhash64("key") % 2 == 0).cast("int"))
    second = lifecycle.retrain(noise, "key", folder, "v2", "2026-04-01T00:00:00Z", promote="better")
    assert not second["promoted_to_latest"] and second["dataset_sha256"] != first["dataset_sha256"]
    assert lifecycle.model_info(spark, folder)["metadata"]["model_version"] == "v1"
    assert [(r["model_version"], r["promoted_to_latest"]) for r in lifecycle.registry(spark, folder)] == [("v1", True), ("v2", False)]
    assert lifecycle.dataset_digest(data) == lifecycle.dataset_digest(data.repartition(7)) == first["dataset_sha256"]


def test_csv_log_and_whole_json(spark, tmp_path):
    from matchloom.sources import readers, sinks

    log = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id long, said string")
    for _ in range(2):
        sinks.append_csv(log, str(tmp_path / "log"))
    assert Counter((r.id, r.said) for r in readers.read_csv(spark, str(tmp_path / "log")).collect()) == {("1", 'a "q", b'): 2, ("2", None): 2}
    one = {"query_id": "q", "label": "1", "employee": {"id": "e", "skills": ["a"]}, "job": {"id": "j"}}
    for name, body in (("list", [one, one | {"label": "0"}]), ("held", {"pairs": [one, one | {"label": "0"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        got = readers.read_pairs(spark, str(tmp_path / f"{name}.json")).collect()
        assert [(r.query_id, r.label, r.employee.skills, r.job.id) for r in got] == [("q", "1", ["a"], "j"), ("q", "0", ["a"], "j")]
