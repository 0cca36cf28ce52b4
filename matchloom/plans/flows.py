"""Queries on job records, augmentation, whole flows, detection wrappers, latency, ordinals and concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring, text
from matchloom.operators import candidates, listing, metrics, order, pairs, skills, vectors

from .analysis import BRAND_SQL, BUCKET, FEATURES_SQL, KNOWN, LINES_SQL, NORM_SQL, ORDER_SETS, OWNED_SQL, SPLIT, brands, customer_skills, feature_rows, known, order_sets
from .book import Tables, query
from .scalar import sql_skill_app

# records


@query("p23_job_preprocess", f"""
SELECT p_partkey AS id, lower(p_name) AS title, lower(p_type) AS department, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN {sql_skill_app('p_brand')} = {sql_skill_app('p_type')} THEN {sql_skill_app('p_brand')} ELSE {sql_skill_app('p_brand')} || '|' || {sql_skill_app('p_type')} END AS skills,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 7 AS DOUBLE) WHEN 1 THEN CAST(p_partkey % 5 AS DOUBLE) ELSE 0.0 END::DOUBLE AS years FROM part""")
def job_records(t: Tables) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    item = lambda name, inner: F.struct(name.alias("name"), F.struct(inner.alias("name")).alias("skill"))
    empty = item(F.lit(" ").cast("string"), none)
    some = F.array(item(F.col("p_brand"), none), item(none, F.col("p_type")), item(F.upper("p_brand"), none), item(none, none))
    given = F.when(k % 3 == 0, (k % 7).cast("string")).when(k % 3 == 2, F.lit("-2"))
    rows = t.part.select(k.alias("id"), F.upper("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("").alias("departement"), F.upper("p_type").alias("department"), F.when(k % 4 == 0, F.array(empty)).otherwise(some).alias("required_skills"), given.alias("min_experience"), F.when(k % 3 == 1, (k % 5).cast("string")).alias("required_experience_years"))
    made = candidates.preprocess_jobs(rows)
    return made.select("id", "title", "department", F.array_join("required_skills", "|").alias("skills"), F.col("required_experience_years").alias("years"))


@query("n18_profile_text", "SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'Fitter ' || c_mktsegment || ' b a' WHEN 1 THEN c_mktsegment ELSE 'b a' END AS text FROM customer")
def profile_text(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 3
    names = F.when(n == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"), F.lit("a")))
    return t.customer.select(F.col("c_custkey").alias("key"), text.profile_text(F.when(n == 0, "Fitter"), F.when(n < 2, F.col("c_mktsegment")), names).alias("text"))


@query("m04_match_score", "SELECT o_orderkey AS key, round(100.0 * (0.5::DOUBLE * ((o_orderkey % 5) / 4.0) + 0.35::DOUBLE * ((o_orderkey % 3) / 2.0) + 0.15::DOUBLE * 0.8::DOUBLE), 2) AS number, round(100.0 * (0.5::DOUBLE * ((o_orderkey % 5) / 4.0) + 0.35::DOUBLE * ((o_orderkey % 3) / 2.0) + 0.15::DOUBLE * 0.8::DOUBLE), 2) AS total, (o_orderkey % 5) / 4.0::DOUBLE AS skill FROM orders")
def match_score(t: Tables) -> DataFrame:
    parts = F.col("o_orderkey") % 5 / 4.0, F.col("o_orderkey") % 3 / 2.0, F.lit(0.8)
    rows = t.orders.select(F.col("o_orderkey").alias("key"), scoring.match_score(*parts).alias("number"), scoring.match_score(*parts, numeric=False).alias("s"))
    return rows.select("key", "number", "s.total", "s.skill")


@query("t03_batch_scores", f"WITH f AS ({FEATURES_SQL}), s AS (SELECT key, round(least(greatest(0.35::DOUBLE * skill_overlap + 0.15::DOUBLE * least(experience_surplus / 5.0, 1.0) + 0.10::DOUBLE * (1.0 - least(experience_gap / 5.0, 1.0)) + 0.05 + 0.0125 + 0.0375, 0.0), 1.0), 6) AS score FROM f) SELECT key, score, round(score * 100, 2) AS score_percent, 'heuristic' AS source FROM s")
def batch_scores(t: Tables) -> DataFrame:
    return candidates.scored(feature_rows(t)).select("key", "score", "score_percent", "source")


# splits, ordinals, checks

@query("h03_split_or_roll", f"""WITH k AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'roll-7|' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS g FROM orders)
SELECT key, {SPLIT.format(b=BUCKET.format(k='g'))} AS split FROM k""")
def split_or_roll(t: Tables) -> DataFrame:
    group = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("key"), pairs.split_or_roll(F.when(F.trim(group) != "", group), F.col("o_orderkey"), 7).alias("split"))


@query("w10_fallback_id", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'row_' || (row_number() OVER (ORDER BY o_orderkey) - 1) ELSE o_orderstatus END AS id FROM orders")
def fallback_id(t: Tables) -> DataFrame:
    rows = order.with_ordinals(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("given")), "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("key"), F.coalesce("given", F.concat(F.lit("row_"), F.col("ordinal"))).alias("id"))


@query("u06_required_columns", "SELECT c AS name FROM (SELECT unnest(['p_partkey', 'esco_id', 'p_name', 'onet_code']) AS c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE part))")
def required_columns(t: Tables) -> DataFrame:
    return listing.missing_columns(t.part, "p_partkey", "esco_id", "p_name", "onet_code")


@query("t10_if_match", """WITH r AS (SELECT c_custkey AS key, substr(sha1('c_name=' || c_name), 1, 16) AS tag FROM customer WHERE c_nationkey < 20)
SELECT c.c_custkey AS key, CASE WHEN c.c_custkey % 4 = 0 THEN 'precondition_required' WHEN r.tag IS NULL THEN 'not_found' WHEN c.c_custkey % 4 < 3 THEN 'ok' ELSE 'etag_mismatch' END AS outcome FROM customer c LEFT JOIN r ON r.key = c.c_custkey""")
def if_match(t: Tables) -> DataFrame:
    rows = t.customer.where("c_nationkey < 20").withColumnRenamed("c_custkey", "key")
    k, tag = F.col("c_custkey") % 4, text.fingerprint(["c_name"])
    asked = t.customer.select(F.col("c_custkey").alias("key"), F.when(k == 0, " ").when(k == 1, F.concat(F.lit('"old", W/"'), tag, F.lit('"'))).when(k == 2, "*").otherwise(F.lit('"old"')).alias("if_match"))
    return listing.if_match(rows, asked, "key", tag).select("key", "outcome")


@query("a22_latency", """WITH v AS (SELECT event_type, user_id % 50 AS g, ln(1 + value) / 1000 AS s FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type, g ORDER BY s) AS at_, count(*) OVER (PARTITION BY event_type, g) AS n FROM v),
p AS (SELECT *, least(greatest((n * 19 + 19) // 20, 1), n - 1) AS low FROM o)
SELECT event_type, g, count(*) AS n, round(avg(s) * 1000, 2) AS avg_ms, round(CASE WHEN any_value(n) >= 20 THEN sum(CASE WHEN at_ = low THEN s * (1.0::DOUBLE - (n * 19 + 19 - low * 20) / 20.0::DOUBLE) WHEN at_ = low + 1 THEN s * ((n * 19 + 19 - low * 20) / 20.0::DOUBLE) ELSE 0.0 END) ELSE max(s) END * 1000, 2) AS p95_ms FROM p GROUP BY 1, 2""")
def latency(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 50).alias("g"), (F.log1p("value") / 1000).alias("s"))
    return metrics.latency(rows, "s", "event_type", "g")


# augmentation and the whole flow

@query("j08_augment", f"""
WITH {OWNED_SQL}, {BRAND_SQL}, jobs AS (SELECT b AS query, names AS required, len(names) AS n FROM brand), pool AS (SELECT c AS cand, list(s) AS skills FROM owned GROUP BY 1),
seen AS (SELECT 'Brand#' || (c_nationkey + 1) AS query, c_custkey AS cand FROM customer),
x AS (SELECT query, cand, n, len(list_intersect(required, skills)) AS common FROM jobs, pool WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.query = jobs.query AND seen.cand = pool.cand)),
o AS (SELECT *, round(common / n, 6) AS overlap, n - common AS missing FROM x),
k AS (SELECT *, CASE WHEN overlap >= 0.7 AND missing = 0 THEN 'positive' WHEN missing >= 1 AND overlap >= 0.4 THEN 'hard_negative' WHEN overlap <= 0.2 THEN 'easy_negative' END AS label_type FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label_type ORDER BY CASE WHEN label_type = 'hard_negative' THEN -overlap ELSE overlap END, cand) AS rn FROM k WHERE label_type IN ('hard_negative', 'easy_negative'))
SELECT query, cand, overlap, CAST(missing AS BIGINT) AS missing, label_type, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= CASE label_type WHEN 'hard_negative' THEN 2 ELSE 3 END""")
def augment(t: Tables) -> DataFrame:
    jobs = brands(t).withColumnRenamed("b", "query")
    pool = customer_skills(t).select(F.col("c").alias("cand"), "skills")
    seen = t.customer.select(F.concat(F.lit("Brand#"), F.col("c_nationkey") + 1).alias("query"), F.col("c_custkey").alias("cand"))
    need = jobs.select("query", F.lit(2).alias("hard"), F.lit(3).alias("easy"))
    return pairs.augmented(jobs, pool, seen, need).withColumn("missing", F.col("missing").cast("long"))


RECORD_SQL = f"""{ORDER_SETS}, {BRAND_SQL}, jobs AS (SELECT b AS query, names[1:2] AS required FROM brand), pool AS (SELECT o AS cand, have AS skills FROM os),
x AS (SELECT query, cand, CASE WHEN cand % 3 > 0 THEN cand % 100 / 100.0::DOUBLE END AS score, len(required) AS n, len(list_intersect(required, skills)) AS common FROM pool JOIN jobs ON query = 'Brand#' || (cand % 25 + 1)),
typed AS (SELECT *, common / n AS overlap, CASE WHEN score IS NOT NULL THEN CASE WHEN score >= 0.75 AND common = n THEN 'positive' WHEN score >= 0.45 AND score < 0.75 AND n > common AND common / n >= 0.4 THEN 'hard_negative' WHEN score <= 0.2 OR common / n <= 0.2 THEN 'easy_negative' END
  ELSE CASE WHEN common = n THEN 'positive' WHEN n > common AND common / n >= 0.4 THEN 'hard_negative' WHEN common / n <= 0.2 THEN 'easy_negative' END END AS label_type FROM x),
placed AS (SELECT *, row_number() OVER (PARTITION BY query, label_type ORDER BY CASE label_type WHEN 'positive' THEN -coalesce(score, -1) WHEN 'hard_negative' THEN -overlap ELSE overlap END, CASE label_type WHEN 'positive' THEN -overlap WHEN 'hard_negative' THEN -coalesce(score, -1) ELSE coalesce(score, -1) END, cand) AS rn FROM typed WHERE label_type IS NOT NULL),
picked AS (SELECT * FROM placed WHERE rn <= CASE label_type WHEN 'positive' THEN 1 ELSE 2 END AND query IN (SELECT query FROM placed WHERE label_type = 'positive')),
need AS (SELECT query, greatest(2 - count(*) FILTER (label_type = 'hard_negative'), 0) AS hard, greatest(2 - count(*) FILTER (label_type = 'easy_negative'), 0) AS easy FROM typed GROUP BY 1 HAVING count(*) FILTER (label_type = 'positive') > 0),
more AS (SELECT query, cand, hard, easy, len(required) AS n, len(list_intersect(required, skills)) AS common FROM need JOIN jobs USING (query), pool WHERE hard + easy > 0 AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.query = need.query AND p.cand = pool.cand)),
kind AS (SELECT *, round(common / n, 6) AS overlap, CASE WHEN common < n AND round(common / n, 6) >= 0.4 THEN 'hard_negative' WHEN common / n <= 0.2 THEN 'easy_negative' END AS label_type FROM more),
extra AS (SELECT *, row_number() OVER (PARTITION BY query, label_type ORDER BY CASE WHEN label_type = 'hard_negative' THEN -overlap ELSE overlap END, cand) AS rn FROM kind WHERE label_type IS NOT NULL)"""


def flow_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, jobs, pool): orders stand for candidates, the first two part names of a brand for what a job needs."""
    jobs = brands(t).select(F.col("b").alias("query"), F.slice("required", 1, 2).alias("required"))
    pool = order_sets(t).select(F.col("o").alias("cand"), F.col("have").alias("skills"))
    rows = pool.join(F.broadcast(jobs), F.concat(F.lit("Brand#"), F.col("cand") % 25 + 1) == F.col("query"))  # 25 rows
    over = scoring.overlap(F.col("skills"), F.col("required"))
    made = rows.select("query", "cand", F.when(F.col("cand") % 3 > 0, F.col("cand") % 100 / 100.0).alias("score"), over.alias("overlap"), (F.size("required") - F.size(F.array_intersect("required", "skills"))).alias("missing"), F.size("required").alias("n"))
    kind = scoring.label_type(F.col("score"), F.col("overlap"), F.col("missing"), F.col("n"), F.lit(0.0))
    return made.withColumn("label_type", kind), jobs, pool


@query("m25_pair_generation", f"WITH {RECORD_SQL} SELECT query, cand, label_type, round(overlap, 6) AS overlap, 'picked' AS origin FROM picked UNION ALL SELECT query, cand, label_type, overlap, 'augmented' FROM extra WHERE rn <= CASE label_type WHEN 'hard_negative' THEN hard ELSE easy END")
def pair_generation(t: Tables) -> DataFrame:
    return pairs.generated(*flow_parts(t)).withColumn("overlap", F.round("overlap", 6))


# skills in texts

GRAMS_SQL = r"""tok AS (SELECT doc_id, regexp_extract_all(array_to_string(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\xA0]+', ' ', 'g'))), chr(10)), '[a-z0-9+.#/\-]+') AS w FROM documents),
gram AS (SELECT doc_id, unnest(w) AS g FROM tok UNION SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM tok UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) FROM tok)"""
#: The exact part of detection. Known skills are few, so their grams are looked for, not all grams' keys.
DETECT_SQL = LINES_SQL.rstrip() + f""", own AS (SELECT *, CASE WHEN head THEN CASE WHEN ends_with(rtrim(line), ':') OR up >= 0.75 * le THEN 1.1 ELSE 1.0 END END AS weight_ FROM c),
most AS (SELECT doc_id, coalesce(section, 'other') AS section, max(weight_) AS m FROM own GROUP BY ALL),
weights AS (SELECT doc_id, section, CASE WHEN section = 'other' THEN greatest(coalesce(m, 0.85), 0.85) ELSE m END AS weight FROM most),
said AS (SELECT doc_id, section, trim(unnest(regexp_split_to_array(body, '[,|;/]+'))) AS phrase FROM (SELECT doc_id, body, coalesce(section, 'other') AS section FROM c WHERE NOT head)),
skill AS (SELECT DISTINCT {sql_skill_app('s')} AS canonical FROM (SELECT unnest({list(KNOWN)}) AS s)),
keyed AS (SELECT canonical, regexp_replace(canonical, '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(canonical, '(^| )([^ ])[^ ]*', '\\2', 'g'), '[^a-z0-9]', '', 'g') AS short FROM skill),
idx AS (SELECT canonical, key AS alias, 'key' AS kind FROM keyed UNION ALL SELECT canonical, short, 'acronym' FROM keyed WHERE length(short) >= 2 AND short <> key),
{GRAMS_SQL},
plain AS (SELECT doc_id, regexp_replace(g, '([^0-9])[0-9]+(\\.[0-9]+)*$', '\\1') AS g FROM gram),
gk AS (SELECT DISTINCT doc_id, regexp_replace(g, '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(g, '(^| )([^ ])[^ ]*', '\\2', 'g'), '[^a-z0-9]', '', 'g') AS short FROM plain),
hit AS (SELECT doc_id, canonical, CASE WHEN kind = 'key' THEN 0.98 ELSE 0.90 END::DOUBLE AS conf, 1 AS plain_, CASE WHEN kind = 'key' THEN 'exact' ELSE 'synonym' END AS source FROM gk JOIN idx ON gk.key = alias WHERE gk.key <> ''
  UNION ALL SELECT doc_id, canonical, 0.88::DOUBLE, 1, 'synonym' FROM gk JOIN idx ON gk.short = alias WHERE gk.key <> '' AND gk.short <> ''
  UNION ALL SELECT s.doc_id, canonical, least(0.99::DOUBLE, 0.95::DOUBLE * weight), 0, 'exact:' || s.section FROM said s JOIN weights USING (doc_id, section) JOIN idx ON regexp_replace({sql_skill_app('phrase')}, '[^a-z0-9]', '', 'g') = alias WHERE phrase <> '' AND alias <> ''),
best AS (SELECT doc_id, canonical AS skill, round(conf, 2) AS confidence, source FROM hit WHERE conf >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY conf DESC, plain_ DESC, source DESC) = 1)
"""
query("m17_skill_detect", DETECT_SQL + "SELECT * FROM best")(lambda t: skills.detect(t.documents, known(t)))


@query("s05_sorted_hits", DETECT_SQL + "SELECT doc_id, skill, confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, skill) AS INTEGER) AS place FROM best")
def sorted_hits(t: Tables) -> DataFrame:
    rows = skills.sorted_hits(skills.detect(t.documents, known(t)))
    return rows.select("doc_id", F.posexplode("hits").alias("at", "h")).select("doc_id", "h.skill", "h.confidence", (F.col("at") + 1).alias("place"))


@query("m19_skill_names", DETECT_SQL + "SELECT d.doc_id, coalesce(string_agg(skill, '|' ORDER BY confidence DESC, skill), '') AS skills FROM documents d LEFT JOIN best USING (doc_id) GROUP BY 1")
def skill_names(t: Tables) -> DataFrame:
    return skills.skill_names(t.documents, known(t)).select("doc_id", F.array_join("skills", "|").alias("skills"))


EMBED_SQL = "list_transform(range(0, 64), lambda k: len(list_filter({w}, lambda x: (('0x' || substr(md5(x), 1, 6))::INT % 64) = k)))"


@query("m10_embed_texts", f"""WITH v AS (SELECT p_partkey AS key, {EMBED_SQL.format(w="string_split(lower(p_name || ' ' || p_type), ' ')")} AS v FROM part)
SELECT key, round(list_max(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS most, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS total FROM v""")
def embed_texts(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("key"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w"))
    made = rows.select("key", vectors.hashed_embedding(F.col("w")).alias("v"))
    return made.select("key", F.round(F.array_max("v"), 6).alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def embedder(c):
    return vectors.hashed_embedding(F.split(text.normalize_lines(c), " "))


WORDS_SQL = "string_split({x}, ' ')"
#: Phrases and their most similar skill, after the tables ``c``, ``weights`` and ``skill``.
SEMANTIC_SQL = f"""parts AS (SELECT doc_id, pos, section, unnest(regexp_split_to_array(body, '[,|;/]+')) AS raw, generate_subscripts(regexp_split_to_array(body, '[,|;/]+'), 1) AS at_ FROM (SELECT doc_id, pos, body, coalesce(section, 'other') AS section FROM c WHERE NOT head)),
spoken AS (SELECT doc_id, pos, at_, section, {NORM_SQL.format(x='trim(raw)')} AS key FROM parts WHERE trim(raw) <> ''),
firsts AS (SELECT * FROM spoken WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos, at_) = 1),
few AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, at_) <= 200),
sv AS (SELECT canonical, {EMBED_SQL.format(w=WORDS_SQL.format(x='canonical'))} AS v FROM skill), pv AS (SELECT key, {EMBED_SQL.format(w=WORDS_SQL.format(x='key'))} AS v FROM (SELECT DISTINCT key FROM few)),
sim AS (SELECT key, canonical, round(list_sum(list_transform(list_zip(pv.v, sv.v), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(pv.v, lambda x: x * x)) * list_sum(list_transform(sv.v, lambda x: x * x))), 9) AS s FROM pv, sv),
top AS (SELECT key, canonical, s FROM sim QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, canonical) = 1),
meant AS (SELECT doc_id, canonical, least(0.92::DOUBLE, s * weight) AS conf, 'semantic:' || section AS source FROM few JOIN top USING (key) JOIN weights USING (doc_id, section) WHERE s >= 0.65)
"""


@query("m17_semantic", DETECT_SQL.rstrip() + ", " + SEMANTIC_SQL + "SELECT doc_id, canonical, round(max(conf), 6) AS conf FROM meant GROUP BY 1, 2")
def semantic(t: Tables) -> DataFrame:
    hits = skills.semantic_hits(t.documents, known(t), embedder, limit=200)  # as its SQL has it
    return hits.groupBy("doc_id", "canonical").agg(F.round(F.max("conf"), 6).alias("conf"))


#: The same with all phrases of a text, not its first 200 different ones.
WHOLE_SQL = "\n".join(x for x in SEMANTIC_SQL.split("\n") if not x.startswith("few AS")).replace("FROM few", "FROM firsts")


@query("m17_detect_semantic", DETECT_SQL.rstrip() + ", " + WHOLE_SQL + """, every AS (SELECT doc_id, canonical, conf, plain_, source FROM hit UNION ALL SELECT doc_id, canonical, conf, 0, source FROM meant)
SELECT doc_id, canonical AS skill, round(conf, 2) AS confidence, source FROM every WHERE conf >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY conf DESC, plain_ DESC, source DESC) = 1""")
def detect_semantic(t: Tables) -> DataFrame:
    """All evidence together, vectors included."""
    return skills.detect(t.documents, known(t), semantic=(embedder, 0.65))
