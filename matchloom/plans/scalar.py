"""Queries on normalisers, parsers and other scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import parsing, scoring, text
from matchloom.operators import candidates
from matchloom.sources import readers, sinks

from .book import Tables, query

AS_OF = "DATE '2001-08-01'"


def day(c: str = "2001-08-01"):
    return F.lit(c).cast("date")


def sql_text(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(lower(coalesce({x}, '')), chr(32)||chr(9)||chr(10)||chr(13)||chr(160)), '[\\xA0\\t\\r\\n]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g')"


def sql_skill(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({sql_text(x)}, '&', ' and '), '[^a-z0-9+.#/\\-\\s]', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


def sql_skill_app(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(trim(coalesce({x}, ''))), '&', ' and '), '[^a-z0-9+.#/\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '([^0-9])[0-9]+(\\.[0-9]+)*$', '\\1'))"


RAW = "concat('  ', upper(p_name), chr(9), ' & ', p_brand, ' ')"


def raw_part(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), F.lit(" & "), F.col("p_brand"), F.lit(" ")).alias("raw"))


for _name, _f, _sql in (("n01_normalize_text", text.normalize_text, sql_text), ("n02_normalize_skill", text.normalize_skill, sql_skill), ("n03_normalize_skill_app", text.normalize_skill_app, sql_skill_app), ("n05_taxonomy_key", text.taxonomy_key, sql_skill)):
    query(_name, f"SELECT p_partkey AS key, {RAW} AS raw, {_sql(RAW)} AS norm FROM part")(lambda t, f=_f: raw_part(t).select("key", "raw", f("raw").alias("norm")))


@query("n04_n05_nation_key", f"SELECT n_nationkey AS key, {sql_skill('n_name')} AS norm FROM nation")
def nation_key(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("key"), text.taxonomy_key("n_name").alias("norm"))


@query("n06_normalize_lines", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS raw FROM documents)
SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(lower(regexp_replace(raw, '\\r\\n?', chr(10), 'g')), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\xA0]+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10)||chr(10), 'g'))) AS norm FROM d""")
def lines(t: Tables) -> DataFrame:
    n, end = F.col("doc_id") % 3, F.lit("\n")
    raw = F.when(n == 0, F.replace("text", end, F.lit("\r\n"))).when(n == 1, F.replace("text", end, F.lit("\r"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(text.normalize_lines(raw).cast("binary")).alias("norm"))


@query("n07_skill_key", f"SELECT p_partkey AS key, regexp_replace({sql_skill_app(RAW)}, '[^a-z0-9]', '', 'g') AS norm FROM part")
def key(t: Tables) -> DataFrame:
    return raw_part(t).select("key", text.skill_key("raw").alias("norm"))


@query("n08_acronym", f"SELECT p_partkey AS key, array_to_string(list_filter(list_transform(string_split({sql_skill_app(RAW)}, ' '), lambda w: left(w, 1)), lambda x: regexp_matches(x, '[a-z0-9]')), '') AS norm FROM part")
def acronym(t: Tables) -> DataFrame:
    return raw_part(t).select("key", text.acronym("raw").alias("norm"))


@query("n09_squash_name", "SELECT n_nationkey AS key, trim(regexp_replace('  ' || n_name || '   x ', '\\s+', ' ', 'g')) AS norm FROM nation")
def squash(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("key"), text.squash(F.concat(F.lit("  "), "n_name", F.lit("   x "))).alias("norm"))


@query("n10_display_name", "SELECT p_partkey AS key, CASE WHEN length(split_part(p_name, ' ', 2)) <= 3 THEN upper(split_part(p_name, ' ', 2)) ELSE upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) END AS shown FROM part")
def display(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key"), text.display_name(F.split("p_name", " ")[1]).alias("shown"))


@query("n11_hash_id", "SELECT o_orderkey AS key, 'JOB_' || substr(md5(lower(o_orderpriority) || '|' || lower(o_orderstatus) || '|' || CAST(o_custkey AS VARCHAR)), 1, 10) AS id FROM orders")
def hash_id(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key"), text.hash_id("JOB", text.business_key("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))).alias("id"))


@query("n13_row_fingerprint", "SELECT c_custkey AS key, substr(sha1('c_mktsegment=' || c_mktsegment || '|c_name=' || c_name || '|c_nationkey=' || c_nationkey), 1, 16) AS id FROM customer")
def print_(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("key"), text.fingerprint(["c_name", "c_mktsegment", "c_nationkey"]).alias("id"))


@query("n14_name_split", "SELECT p_partkey AS key, split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', -1) AS last_name FROM part")
def names(t: Tables) -> DataFrame:
    first, last = text.first_last("p_name")
    return t.part.select(F.col("p_partkey").alias("key"), first.alias("first_name"), last.alias("last_name"))


@query("n15_clean_text", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_name ELSE NULL END AS cleaned, lower(s_name || '@EXAMPLE.com') AS email FROM supplier")
def clean(t: Tables) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit(" nan ")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), "s_name", F.lit(" "))).otherwise(F.lit("  "))
    return t.supplier.select(F.col("s_suppkey").alias("key"), text.clean_text(raw).alias("cleaned"), text.norm_email(F.concat(F.lit(" "), "s_name", F.lit("@EXAMPLE.com "))).alias("email"))


@query("n16_candidate_text", "SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'empty profile' ELSE 'Role: ' || c_mktsegment || ' Skills: ' || c_name || ', x' END AS text FROM customer")
def candidate_text(t: Tables) -> DataFrame:
    none = F.col("c_custkey") % 5 == 0
    skills = F.when(none, F.array().cast("array<string>")).otherwise(F.array("c_name", F.lit("x")))
    return t.customer.select(F.col("c_custkey").alias("key"), text.labelled_text(F.when(~none, F.col("c_mktsegment")), skills, F.lit("")).alias("text"))


@query("n17_embed_text", "SELECT c_custkey AS key, c_mktsegment || ' ' || n_name || ' ' || c_name || ' z' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def embed_text(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("key"), text.embed_text(F.col("c_mktsegment"), F.lit(""), F.col("n_name"), skills=F.array(F.lit("z"), "c_name")).alias("text"))


@query("n19_reason_text", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'Strong skill overlap (' || printf('%.2f', (o_orderkey % 8) / 8.0) || ').' ELSE 'tenure years had ' || CASE WHEN o_orderkey % 3 = 0 THEN 'negative impact (-0.250).' ELSE 'positive impact (+0.250).' END END AS said FROM orders")
def reasons(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 2 == 0, "skill_overlap").otherwise("tenure_years")
    return t.orders.select(F.col("o_orderkey").alias("key"), text.reason_text(name, F.col("o_orderkey") % 8 / 8.0, F.when(F.col("o_orderkey") % 3 == 0, -0.25).otherwise(0.25)).alias("said"))


PIECES = "p_name || ', ' || p_brand || ' | ' || upper(p_name) || ';' || p_type"


@query("p01_parse_skills", f"""
WITH raw AS (SELECT p_partkey, list_transform(string_split_regex({PIECES}, '[,|;/]+'), lambda x: {sql_skill('x')}) AS a FROM part),
one AS (SELECT p_partkey, unnest(a) AS skill, generate_subscripts(a, 1) AS place FROM raw),
first AS (SELECT p_partkey, skill, min(place) AS place FROM one WHERE skill <> '' GROUP BY 1, 2)
SELECT p_partkey, skill, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS INTEGER) AS pos FROM first""")
def skills(t: Tables) -> DataFrame:
    raw = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" | "), F.upper("p_name"), F.lit(";"), "p_type")
    return t.part.select("p_partkey", F.posexplode(parsing.parse_skills(raw)).alias("pos", "skill"))


@query("p02_parse_skill_list", f"SELECT p_partkey, {sql_skill_app('p_brand')} AS a, CASE WHEN {sql_skill_app('p_type')} <> {sql_skill_app('p_brand')} THEN {sql_skill_app('p_type')} END AS b FROM part")
def skill_list(t: Tables) -> DataFrame:
    made = parsing.parse_skill_list(F.array("p_brand", "p_type", F.upper("p_brand"), F.lit(" ")))
    return t.part.select("p_partkey", F.get(made, F.lit(0)).alias("a"), F.get(made, F.lit(1)).alias("b"))


@query("p03_parse_list", "SELECT p_partkey, 3 AS n, p_name AS first, p_type AS last FROM part")
def lists(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    plain = F.concat("p_name", F.lit(" ; "), "p_brand", F.lit("|"), "p_type", F.lit(" ,"))
    json = F.to_json(F.array("p_name", "p_brand", "p_type"))
    one = F.when(F.col("p_partkey") % 3 == 0, parsing.parse_list(quoted)).when(F.col("p_partkey") % 3 == 1, parsing.parse_list(plain)).otherwise(parsing.parse_json_list(json))
    return t.part.select("p_partkey", F.size(one).alias("n"), one[0].alias("first"), one[2].alias("last"))


@query("p06_try_numbers", "SELECT event_id AS key, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS number, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS years, CAST(year(ts) AS VARCHAR) AS year FROM events")
def numbers(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select(F.col("event_id").alias("key"), parsing.number(F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(k)).alias("number"), parsing.years_in_text(F.concat(F.lit("about "), k, F.lit(" years, or 99"))).alias("years"), parsing.year_in_text(F.concat(F.lit("since "), F.date_format("ts", "dd.MM.yyyy"))).alias("year"))


@query("p09_pick_first", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS picked FROM orders")
def first(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key"), parsing.first_filled(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(""), "o_orderpriority").alias("picked"))


@query("p10_multi_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) AS imported, DATE '1969-05-01' AS pivot FROM orders")
def dates(t: Tables) -> DataFrame:
    def shown(*formats: str):
        k = F.col("o_orderkey") % len(formats)
        out = F.date_format("o_orderdate", formats[0])
        for i, f in enumerate(formats[1:], 1):
            out = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(out)
        return out

    return t.orders.select("o_orderkey", parsing.parse_date(shown("yyyy-MM-dd", "dd/MM/yyyy")).alias("parsed"), parsing.parse_date(shown("MM/dd/yyyy", "yyyy-MM-dd"), parsing.IMPORT_FORMATS).alias("imported"), parsing.parse_date(F.lit("05/01/69")).alias("pivot"))


@query("p11_years_between", f"SELECT o_orderkey AS key, round(date_diff('day', CAST(o_orderdate AS DATE), {AS_OF}) / 365.25::DOUBLE, 2) AS years, year({AS_OF}) - year(o_orderdate) AS cal_years FROM orders")
def years(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(F.col("o_orderkey").alias("key"), parsing.years_between(d, day()).alias("years"), parsing.calendar_years(d, day()).cast("long").alias("cal_years"))


@query("p13_experience_score", f"SELECT o_orderkey AS key, round(least((year({AS_OF}) - year(o_orderdate)) / CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) ELSE 10.0 END, 1.0), 6) AS exp_score FROM orders")
def experience(t: Tables) -> DataFrame:
    y = parsing.calendar_years(F.col("o_orderdate").cast("date"), day()).cast("double")
    return t.orders.select(F.col("o_orderkey").alias("key"), F.round(parsing.experience_score(y, (F.col("o_orderkey") % 4).cast("double")), 6).alias("exp_score"))


@query("p14_performance_label", "SELECT o_orderpriority AS priority, CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.8 WHEN '3' THEN 0.6 WHEN '4' THEN 0.35 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n FROM orders GROUP BY 1, 2")
def performance(t: Tables) -> DataFrame:
    given = F.element_at(F.create_map(*[F.lit(x) for p in (("1-URGENT", " Superior "), ("2-HIGH", "Accord parfait"), ("3-MEDIUM", "acceptable"), ("4-NOT SPECIFIED", "35"), ("5-LOW", "1")) for x in p]), F.col("o_orderpriority"))
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority"), parsing.performance(given).alias("weight")).agg(F.count("*").alias("n"))


@query("p16_scaled", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(CASE WHEN l_quantity > 1 THEN l_quantity / 5.0 ELSE l_quantity END, 1.0) AS scaled FROM lineitem")
def scaled(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", parsing.scaled("l_quantity").alias("scaled"))


SCORE = "least(greatest(CASE WHEN value > 1 THEN value / 100 ELSE value END, 0.0), 1.0)"
LABEL = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE"


@query("p17_score01", f"SELECT event_id, {SCORE} AS score01 FROM events")
def score01(t: Tables) -> DataFrame:
    return t.events.select("event_id", parsing.score01("value").alias("score01"))


@query("p19_label_map", f"SELECT event_id, {LABEL} AS label FROM events")
def labels(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 2
    word = F.when(F.col("event_id") % 7 == 0, "maybe").when(k == 1, F.when(F.col("event_id") % 2 == 0, " Yes ").otherwise("1")).otherwise(F.when(F.col("event_id") % 2 == 0, "no_match").otherwise("0.2"))
    return t.events.select("event_id", parsing.binary_label(word).alias("label"))


@query("p20_bucket_cascade", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'econ') THEN 0 WHEN contains(lower(p_type), 'small') THEN 1 WHEN contains(lower(p_type), 'med') THEN 3 ELSE 2 END AS years FROM part")
def cascade(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parsing.cascade("p_type", (("econ", 0), ("small", 1), ("med", 3))).alias("years"))


@query("p21_active_flag", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS active FROM orders")
def active(t: Tables) -> DataFrame:
    ended = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    return t.orders.select(F.col("o_orderkey").alias("key"), parsing.active(ended, F.when(F.col("o_orderstatus") == "F", " Terminated ").otherwise("ok")).alias("active"))


@query("p22_preprocess", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'order ' || o_orderkey AS full_name, lower(o_orderpriority) AS position, date_diff('day', CAST(o_orderdate AS DATE), {AS_OF}) AS days,
CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0 ELSE 0.0 END::DOUBLE AS performance_score FROM orders""")
def preprocess(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    raw = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("full_name"), F.lit("order").alias("first_name"), F.col("o_orderkey").cast("string").alias("last_name"), F.col("o_orderpriority").alias("position"), none.alias("department"), F.array(F.lit("Python3"), F.lit("python")).alias("skills"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("hire_date"), none.alias("termination_date"), F.when(F.col("o_orderpriority") == "1-URGENT", "superior").alias("performance_score"), F.lit("3").alias("engagement_survey"), F.lit("4").alias("emp_satisfaction"), none.alias("employment_status"))
    made = candidates.preprocess(raw, day())
    return made.join(raw.select("id", "hire_date"), "id").select("id", "full_name", "position", F.datediff(day(), F.to_date("hire_date")).cast("long").alias("days"), "performance_score")


@query("p24_filename_parse", "SELECT DISTINCT event_type AS job, strftime(ts, '%Y-%m-%d %H:00:00') AS at FROM events")
def filename(t: Tables) -> DataFrame:
    name = F.concat(F.lit("profile_"), "event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd'T'HH"), F.lit("0000Z.bin"))
    job, at = readers.filename_parts(F.col("f"))
    return t.events.select(name.alias("f")).distinct().select(job.alias("job"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("i07_taxonomy_source", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS preferred_label, CAST(CASE WHEN lower(p_brand) = p_name THEN 1 ELSE 3 END AS INTEGER) AS n_labels FROM part")
def source(t: Tables) -> DataFrame:
    raw = t.part.select(F.col("p_partkey").cast("string").alias("ID"), F.concat(F.lit(" "), "p_name").alias("PREFERREDLABEL"), F.concat("p_brand", F.lit("\n"), "p_type", F.lit("|"), "p_brand", F.lit("|")).alias("ALTLABELS"))
    return readers.taxonomy_rows(raw, "occupations").select("id", "preferred_label", F.size("labels").alias("n_labels"))


@query("i08_internal_titles", "SELECT p_name AS internal_title, p_brand AS alias FROM part WHERE p_partkey % 2 = 0")
def titles(t: Tables) -> DataFrame:
    raw = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(" ").alias("internal_title"), F.concat(F.lit("| "), "p_brand", F.lit(" |")).alias("aliases"))
    return readers.internal_titles(raw).select("internal_title", F.explode("aliases").alias("alias"))


@query("i11_reference_frame", f"SELECT count(*) AS rows, round(sum({SCORE}), 4) AS total FROM events")
def reference(t: Tables) -> DataFrame:
    frame = t.events.select(F.col("value").cast("string").alias("predicted_fit_score"), F.lit("x").alias("score"))
    return readers.reference_scores(frame).agg(F.count("*").alias("rows"), F.round(F.sum("score"), 4).alias("total"))


@query("i14_drift_event_days", "SELECT strftime(ts, '%Y-%m-%d') AS day_utc, count(*) AS n, round(sum((event_id % 64) / 256.0::DOUBLE), 6) AS psi, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS failures FROM events WHERE event_id % 7 > 0 GROUP BY 1")
def event_days(t: Tables) -> DataFrame:
    n = F.col("event_id")
    whole = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_utc"), F.lit("x").alias("job_title"), (n % 64 / 256.0).alias("score_psi")))
    log = t.events.select(F.explode(F.array(F.when(n % 7 == 0, F.substring(whole, 1, 30)).otherwise(whole), F.lit("  "))).alias("value"))
    good, bad = readers.parse_drift_lines(log)
    return good.groupBy("day_utc").agg(F.count("*").alias("n"), F.round(F.sum("score_psi"), 6).alias("psi")).crossJoin(bad)  # one row


@query("i16_extract_cleanup", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), chr(32)||chr(10)||chr(13)||chr(160))) AS cleaned FROM documents")
def cleanup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(readers.cleaned_extract("text").cast("binary")).alias("cleaned"))


@query("i17_mime_sniff", "SELECT o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'unknown' END AS kind FROM orders")
def sniff(t: Tables) -> DataFrame:
    body = F.when(F.col("o_orderkey") % 3 == 0, F.unhex(F.lit("255044462D312E37"))).when(F.col("o_orderkey") % 3 == 1, F.unhex(F.lit("504B0304000000776F72642F"))).otherwise(F.unhex(F.lit("504B030400")))
    return t.orders.select(F.col("o_orderkey").alias("key"), readers.file_kind(body).alias("kind"))


@query("i18_registry_upsert", "SELECT CASE WHEN n_regionkey < 2 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM nation GROUP BY 1")
def registry(t: Tables) -> DataFrame:
    old = t.nation.select(F.col("n_name").alias("dataset_id"), F.lit("old").alias("version"))
    new = t.nation.where("n_regionkey < 2").select(F.col("n_name").alias("dataset_id"), F.lit("new").alias("version"))
    return sinks.upsert_registry(old, new).groupBy("version").agg(F.count("*").alias("n"))


@query("i19_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan(t: Tables) -> DataFrame:
    return t.nation


@query("t12_json_event", "SELECT r_regionkey AS key, CASE WHEN r_regionkey % 2 = 0 THEN '{\"r_regionkey\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' ELSE '{\"r_regionkey\":' || r_regionkey || '}' END AS event FROM region")
def event(t: Tables) -> DataFrame:
    return t.region.withColumn("name", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name"))).select(F.col("r_regionkey").alias("key"), sinks.json_event("r_regionkey", "name").alias("event"))


@query("m02_overlap_literal", "SELECT n_nationkey AS key, 1.0 / 3 AS overlap FROM nation")
def overlap(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("key"), scoring.overlap(F.array(F.lit("a"), "n_name"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("a"))).alias("overlap"))
