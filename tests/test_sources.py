"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from matchloom.operators import pairs
from matchloom.sources import readers, sinks

PAIR = {"query_id": "q", "label": "1", "employee": {"id": "e", "skills": ["SQL", "sql"]}, "job": {"id": "j", "required_skills": ["sql", "python"]}}


def test_pair_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(PAIR) + "\n\n" + json.dumps(PAIR) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"pairs": [PAIR, PAIR]}))
    (tmp_path / "c.json").write_text(json.dumps([PAIR]))
    counts = [readers.read_pairs(spark, str(tmp_path / n)).count() for n in ("a.jsonl", "b.json", "c.json")]
    assert counts == [2, 2, 1]
    with pytest.raises(ValueError):
        readers.read_pairs(spark, str(tmp_path / "d.txt"))
    made = pairs.add_features(pairs.clean_pairs(readers.read_pairs(spark, str(tmp_path / "a.jsonl")))).first()
    assert (made.query_id, made.label, made.features.skill_overlap_count, made.features.skill_overlap_ratio) == ("q", 1, 1, 0.5)


def test_jsonl_sink_counts(spark, tmp_path):
    assert sinks.write_jsonl(spark.range(7), str(tmp_path / "out")) == 7
    assert spark.read.json(str(tmp_path / "out")).count() == 7


def test_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name\nÉva\n".encode())
    (tmp_path / "l.csv").write_bytes("name\nÉva\n".encode("latin-1"))
    assert [readers.read_csv_any(spark, str(tmp_path / n)).first().name for n in ("u.csv", "l.csv")] == ["Éva", "Éva"]


def test_drift_log(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"timestamp_utc": "2024-01-02T03:04:05", "score_psi": 0.1}\n{broken\n\n')
    good, bad = readers.read_drift_events(spark, str(tmp_path / "d.jsonl"))
    assert [r.day_utc for r in good.collect()] == ["2024-01-02"]
    assert bad.first().failures == 1


def test_events_append(spark, tmp_path):
    rows = spark.sql("select 'a' job, double('nan') ece")
    for _ in range(2):
        sinks.append_events(rows, str(tmp_path / "log"))
    back = spark.read.schema("job string, ece double").json(str(tmp_path / "log"))
    assert back.count() == 2 and back.where("ece is not null").count() == 0


def test_registration(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    row = sinks.registration(spark, "d", str(tmp_path / "a.csv")).first()
    assert (row.record_count, row.sha256) == (2, hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest())


def test_hr_files(spark):
    comma = spark.createDataFrame([("7", "Ann Lee", "F", "01/02/1990", "IT", "Dev", "12.5", "Superior", "3/4/2015", None, "Active")], ", ".join(f"`{c}` string" for c in readers.HR_COMMA.values()))
    row = readers.hr_rows(comma, readers.HR_COMMA).first()
    assert (row.first_name, row.last_name, str(row.dob), str(row.hire_date), row.pay_rate) == ("Ann", "Lee", "1990-01-02", "2015-03-04", 12.5)


def test_file_kinds(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"PK\x03\x04 word/document.xml")
    (tmp_path / "c.bin").write_bytes(b"hello")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert kinds["a.pdf"] == "application/pdf" and kinds["b.bin"].endswith("wordprocessingml.document") and kinds["c.bin"] == "unknown"


def test_cleanup(spark):
    df = spark.createDataFrame([(" a\x00 \t b\n\n\n\nc ",)], "x string")
    assert df.select(readers.cleaned_extract(F.col("x"))).first()[0] == "a b\n\nc"
