"""Readers of pairs, tables, taxonomy files, monitoring logs and HR files; all distributed, with stated schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import parsing, text

PAIR = "query_id string, job_id string, label string, employee struct<id: string, full_name: string, name: string, position: string, title: string, department: string, departement: string, dept: string, summary: string, resume_summary: string, skills: array<string>, experience_years: double>, job struct<id: string, title: string, description: string, department: string, required_skills: array<string>, skills: array<string>, min_experience: double>"
DRIFT = "timestamp_utc string, job_title string, reference_rows long, current_rows long, score_psi double, ref_ece double, cur_ece double, calibration_drift double, calibration_warning boolean, broken string"
EVENTS = "scored_at_utc string, job_title string, predicted_score double, actual_label double, scoring_source string"


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def read_pairs(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """Pairs from .jsonl (blank lines are no rows), .json (a list, or an object with ``pairs``) or .csv."""
    kind = suffix(path)
    if kind in ("jsonl", "ndjson"):
        return spark.read.schema(schema).json(path)
    if kind == "json":
        # one read fits both forms: an element of a list is a row, an object with ``pairs`` a row that holds them all
        own = T._parse_datatype_string(schema)
        rows = spark.read.schema(T.StructType([*own.fields, T.StructField("pairs", T.ArrayType(own))])).option("multiLine", True).json(path)
        single = F.array(F.struct(*[F.col(f.name) for f in own.fields]))
        return rows.select(F.explode(F.coalesce("pairs", single)).alias("p")).select("p.*")
    if kind == "csv":
        return read_csv(spark, path)
    raise ValueError(f"unsupported input format: {path}")


def filename_parts(name: Column) -> tuple[Column, Column]:
    """(job, time) of a profile file's name, ``profile_<job>_<yyyymmdd>T<hhmmss>Z.bin``; nulls for other names."""
    pattern = r"^profile_(.+)_(\d{8}T\d{6}Z)\.bin$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return part(1), F.to_timestamp(part(2), "yyyyMMdd'T'HHmmss'Z'")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", empty: str | None = None) -> DataFrame:
    """All columns as text, quoted fields over several lines; with ``empty`` nulls become that text."""
    out = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding=encoding)
    return out if empty is None else out.na.fill(empty)


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, or Latin-1 where a line is no valid UTF-8."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return read_csv(spark, path, encoding="ISO-8859-1" if broken else "UTF-8")


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv, parquet, jsonl or ndjson."""
    kind = suffix(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("jsonl", "ndjson", "json"):
        return spark.read.json(path)
    raise ValueError(f"unsupported format: {path}")


def reference_scores(frame: DataFrame) -> DataFrame:
    """``score, label`` of a reference table: the first score column that it has; labels that are blank stay null."""
    name = next((c for c in ("predicted_score", "predicted_fit_score", "score") if c in frame.columns), None)
    if name is None:
        raise ValueError("no score column")
    label = parsing.binary_label("actual_label") if "actual_label" in frame.columns else F.lit(None).cast("double")
    return frame.select(parsing.score01(name).alias("score"), label.alias("label")).where("score is not null")


def parse_drift_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with ``day_utc``, a one-row count of lines that can't be read) of rows ``value``; blank lines are neither. A
    bad line is no failure."""
    some = lines.where(F.trim("value") != "")
    parsed = some.select(F.from_json("value", DRIFT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("e"))
    good = parsed.where("e is not null and e.broken is null").select("e.*").withColumn("day_utc", F.substring("timestamp_utc", 1, 10)).drop("broken")
    return good, parsed.agg(F.count_if(F.expr("e is null or e.broken is not null")).alias("failures"))


def read_drift_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_drift_lines(spark.read.text(path))


def split_labels(column: str):
    """Alternative labels: one a line or bar, trimmed, first occurrences."""
    return F.array_distinct(parsing.some(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"[\n|]+"), lambda x: F.trim(x))))


# Columns of the taxonomy files, by file, and the names that they get.
TAXONOMY = {
    "occupations": {"ID": "id", "ORIGINURI": "origin_uri", "ISCOGROUPCODE": "isco_group_code", "CODE": "code", "PREFERREDLABEL": "preferred_label", "ALTLABELS": "alt_labels", "DESCRIPTION": "description", "DEFINITION": "definition", "SCOPENOTE": "scope_note", "OCCUPATIONTYPE": "occupation_type", "ISLOCALIZED": "is_localized"},
    "skills": {"ID": "id", "ORIGINURI": "origin_uri", "SKILLTYPE": "skill_type", "REUSELEVEL": "reuse_level", "PREFERREDLABEL": "preferred_label", "ALTLABELS": "alt_labels", "DESCRIPTION": "description", "DEFINITION": "definition", "SCOPENOTE": "scope_note"},
    "occupation_skill_relations": {"OCCUPATIONID": "occupation_id", "RELATIONTYPE": "relation_type", "SKILLID": "skill_id", "OCCUPATIONTYPE": "occupation_type"},
    "occupations_hierarchy": {"PARENTOBJECTTYPE": "parent_type", "PARENTID": "parent_id", "CHILDID": "child_id", "CHILDOBJECTTYPE": "child_type"},
    "skills_hierarchy": {"PARENTOBJECTTYPE": "parent_type", "PARENTID": "parent_id", "CHILDID": "child_id", "CHILDOBJECTTYPE": "child_type"},
    "skill_skill_relations": {"REQUIRINGID": "requiring_id", "RELATIONTYPE": "relation_type", "REQUIREDID": "required_id"},
    "ISCOGroups": {"ID": "id", "ORIGINURI": "origin_uri", "CODE": "code", "PREFERREDLABEL": "preferred_label", "ALTLABELS": "alt_labels", "DESCRIPTION": "description"},
    "skillGroups": {"ID": "id", "ORIGINURI": "origin_uri", "CODE": "code", "PREFERREDLABEL": "preferred_label", "ALTLABELS": "alt_labels", "DESCRIPTION": "description", "SCOPENOTE": "scope_note"},
}


def taxonomy_rows(raw: DataFrame, kind: str) -> DataFrame:
    """A taxonomy file's columns renamed and trimmed (missing ones empty), alternative labels as an array, and ``labels``:
    the preferred label and the alternatives, distinct."""
    names = TAXONOMY[kind]
    cells = [F.trim(F.coalesce(F.col(c) if c in raw.columns else F.lit(None).cast("string"), F.lit(""))).alias(n) for c, n in names.items()]
    out = raw.select(*cells)
    if "alt_labels" not in names.values():
        return out
    out = out.withColumn("alt_labels", split_labels("alt_labels"))
    return out.withColumn("labels", F.array_distinct(parsing.some(F.concat(F.array("preferred_label"), F.col("alt_labels")))))


def read_taxonomy(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return taxonomy_rows(read_csv(spark, f"{folder}/{kind}.csv"), kind)


def internal_titles(raw: DataFrame) -> DataFrame:
    """``internal_title, aliases``: rows without a title go, aliases are split at bars."""
    aliases = parsing.some(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: F.trim(x)))
    return raw.select(F.trim("internal_title").alias("internal_title"), aliases.alias("aliases")).where("internal_title <> ''")


# Columns of the two HR files, by the names that they get.
HR_COMMA = {"employee_number": "Employee Number", "full_name": "Employee Name", "gender": "Sex", "dob": "DOB", "department": "Department", "position": "Position", "pay_rate": "Pay Rate", "performance_score": "Performance Score", "hire_date": "Date of Hire", "termination_date": "Date of Termination", "employment_status": "Employment Status"}
HR_SEMICOLON = {"employee_number": "Employee_ID", "first_name": "First Name", "last_name": "Last Name", "email": "Email", "gender": "Gender", "dob": "Birthdate", "department": "Department", "position": "Job Title", "salary": "Salary", "performance_score": "Performance Rating", "hire_date": "Hiredate", "termination_date": "Termdate"}


def hr_rows(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """An HR file in one shape: trimmed texts, dates by the import formats, e-mails in lower case, numbers, names split."""
    made = {}
    for name, source in names.items():
        c = text.clean_text(F.col(f"`{source}`")) if source in raw.columns else F.lit(None).cast("string")
        made[name] = parsing.parse_date(c, parsing.IMPORT_FORMATS) if name in ("dob", "hire_date", "termination_date") else parsing.number(c) if name in ("salary", "pay_rate") else F.lower(c) if name == "email" else c
    out = raw.select(*[c.alias(n) for n, c in made.items()])
    if "full_name" in names and "first_name" not in names:
        first, last = text.first_last("full_name")
        out = out.withColumns({"first_name": first, "last_name": last})
    elif "full_name" not in names:
        out = out.withColumn("full_name", F.concat_ws(" ", "first_name", "last_name"))
    return out


def file_kind(content):
    """MIME type by the first bytes: PDF, or a zip file that names a word document; else unknown."""
    head = F.hex(F.substring(content, 1, 5))
    word = F.instr(F.hex(content), "776F72642F") > 0  # word/
    return F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("504B0304") & word, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("unknown")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, kind, sha256`` of binary files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", file_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))


def cleaned_extract(c):
    """Text out of a document parser: no NUL characters, single blanks, at most one empty line in a row."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "\\x00", "")
    return text.strip(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def extracted_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of PDF and DOCX files, where a parser is installed; otherwise the read fails with a clear message. A file that
    isn't one of these gives an empty text."""

    def run(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name.lower().endswith(".pdf"):
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        out.append("\n".join(p.extract_text() or "" for p in pdf.pages))
                elif name.lower().endswith(".docx"):
                    import docx

                    out.append("\n".join(p.text for p in docx.Document(io.BytesIO(content)).paragraphs if p.text))
                else:
                    out.append("")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")
    return rows.select("path", cleaned_extract(F.col("text")).alias("text"))
