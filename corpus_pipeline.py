"""The corpus pipeline: quality rules, toxicity, line de-duplication, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of documents. Rows that are
equal in every column are one row to the stages that remove rows: what holds for one holds for all of them, except in the
join, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import jaccard_join, line_dedup, packing, quality_rules, toxicity
from matchloom.llm.common import fresh, read, small_side, stash
from matchloom.llm.registry import tokenizer_path


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with the hash of the text in a column of a name that no column of theirs has, that name, and two free names
    for the columns of a side that is joined to it."""
    t, of_id, of_text = fresh(docs.columns, "text_hash", "of_id", "of_text")
    return docs.withColumn(t, F.xxhash64("text")), t, of_id, of_text


def _marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (``left_semi``) or without (``left_anti``) a row of ``marks`` (doc_id, t_), by doc_id and
    text hash, so rows that share a doc_id are told apart and rows without one are matched too."""
    keyed, t, of_id, of_text = _keyed(docs)
    side = small_side(marks.select(F.col("doc_id").alias(of_id), F.col("t_").alias(of_text)))
    return keyed.join(side, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(t) == F.col(of_text)), how).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and lie inside their language's perplexity band.

    A null, empty or short text fails the base rules and goes. A null doc_id or language is judged like any other. Texts
    of any length are read whole. Equal rows stay or go together. An empty table stays empty. Further columns are carried
    along under whatever names. Smaller blocks of words than alone: the same scores, less memory, more disk."""
    rules = quality_rules.QualityRules(block_words=250_000)
    return _marked(docs, stash(quality_rules.quality(docs, rules, keys=("t_",)).where("not kept").select("doc_id", "t_").distinct()), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is under the threshold; learns from the labels that aren't held out.

    A null or empty text scores as the bias alone, a null doc_id is scored like any other, and without labels of both
    classes every text scores as the share of toxic ones (none: it stays). Texts of any length are read whole. Equal rows
    stay or go together. An empty table stays empty. Further columns are carried along under whatever names."""
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), keys=("t_",))
    return _marked(docs, stash(scored.where("predicted = 1").select("doc_id", "t_").distinct()), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts; keeps every document. ``n_chars`` follows the changed texts.

    A null text stays null and an empty one empty, a null source is one site, texts of any length are read whole, equal
    rows are changed alike, an empty table stays empty, and further columns are carried along under whatever names."""
    (removed,) = fresh(docs.columns, "lines_removed")
    out = line_dedup.dedup_lines(docs, removed=removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest doc_id (a null counts as the greatest),
    then of the smallest text hash; of rows that share both, one.

    Texts without words (null, empty, white space) are in no group and stay, each row of them. Texts of any length are
    read whole, an empty table stays empty, and further columns are carried along under whatever names."""
    tagged = stash(jaccard_join.near_duplicate_components(docs, keys=("t_",))).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("o0"), F.col("doc_id").alias("o1"), F.col("t_").alias("o2"))
    first = tagged.groupBy("group_").agg(F.min(place).alias("o"))
    grouped = tagged.groupBy("group_", "doc_id", "t_").agg(F.count("*").alias("rows_")).join(first, "group_")
    marks = stash(grouped.select("doc_id", "t_", "rows_", place.eqNullSafe(F.col("o")).alias("stays")))
    out = _marked(docs, marks.where("not stays"), "left_anti")
    again = marks.where("stays and rows_ > 1")
    if again.isEmpty():
        return out
    keyed, t, _, _ = _keyed(_marked(out, again, "left_semi"))
    return _marked(out, again, "left_anti").unionByName(keyed.dropDuplicates(["doc_id", t]).select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents: one row for each piece, with its sequence and offset. A smaller memo of
    words than alone: the executors' heaps are full by now.

    A null or empty text is one piece of the end id alone, long texts are cut and no id is lost, a null doc_id is kept,
    equal rows are packed each, an empty table gives no rows, and further columns are ignored."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), memo=60_000)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't state the model scores, the link components and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
