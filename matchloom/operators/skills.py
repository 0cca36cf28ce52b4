"""Skills in free text: n-grams, alias index, sections, phrases and detection with confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import fuzzy, text

from . import vectors

TOKEN = r"[a-z0-9+.#/\-]+"
MARKS = "+.#/-"
BULLETS = ("-", "*", "•", "â€¢")


def tokens(c: Column | str) -> Column:
    """Words of the normalised text; single spaces and trimmed lines make no difference to them, so they aren't made."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.col(c), F.lit(""))), F.lit(TOKEN), 0)


def ngrams(words: Column, most: int = 4) -> Column:
    """Distinct n-grams of 1 to ``most`` words, joined by spaces."""
    def of(n: int) -> Column:
        last = F.greatest(F.size(words) - (n - 1), F.lit(0))
        return F.transform(F.slice(words, F.lit(1), last), lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.array_distinct(F.concat(words, *map(of, range(2, most + 1))))


def ngram_rows(docs: DataFrame, most: int = 4) -> DataFrame:
    """``doc_id, gram``: distinct n-grams of each row's text, made inside the row: no shuffle."""
    words = docs.select("doc_id", tokens("text").alias("w_"))  # a column of its own: a lambda would make it for each word
    return words.select("doc_id", F.explode(ngrams(F.col("w_"), most)).alias("gram"))


def ngram_counts(docs: DataFrame, most: int = 4, run: int = 1_000_000) -> DataFrame:
    """``doc_id, n``: how many different n-grams of 1 to ``most`` words each text has, for texts with a word.

    No n-gram is made as a text: words get numbers, and each n-gram the rank of (rank of its first n - 1 words, last word)
    among those of its text, which is exact. Runs of whole texts of about ``run`` words take bounded memory."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w_")
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + run, "right")))
                codes = words.slice(at, to - at).flatten().dictionary_encode()
                kinds, codes = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc, left = np.repeat(np.arange(to - at), sizes[at:to]), np.concatenate([np.arange(n, 0, -1) for n in sizes[at:to]])
                total, rank, places = np.zeros(to - at, np.int64), doc, np.arange(len(codes))
                for n in range(most):
                    whole = left[places] > n  # the text still has a word for them
                    places = places[whole]
                    _, first, rank = np.unique(rank[whole] * kinds + codes[places + n], return_index=True, return_inverse=True)
                    total += np.bincount(doc[places[first]], minlength=to - at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(total)], ["doc_id", "n"])
                at = to

    rows = docs.select("doc_id", tokens("text").alias("w_"))
    counted = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long").where("n > 0")
    return counted.groupBy("doc_id").agg(F.sum("n").alias("n"))


def alias_index(known: DataFrame) -> DataFrame:
    """``alias, canonical, kind``: each known skill's key, and its acronym where that has two letters or more."""
    rows = known.select(text.normalize_skill_app("skill").alias("canonical")).where("canonical <> ''").distinct()
    keyed = rows.select("canonical", text.skill_key("canonical").alias("key"), text.acronym("canonical").alias("short")).where("key <> ''")
    both = F.array(F.struct(F.col("key").alias("alias"), F.lit("key").alias("kind")), F.when((F.length("short") >= 2) & (F.col("short") != F.col("key")), F.struct(F.col("short").alias("alias"), F.lit("acronym").alias("kind"))))
    return keyed.select("canonical", F.explode(F.array_compact(both)).alias("a")).select("a.alias", "canonical", "a.kind")


def without_bullet(c: Column) -> Column:
    """One bullet at the start of a line goes."""
    return F.trim(F.regexp_replace(c, r"^(-|\*|•|â€¢)", ""))


def heading(line: Column) -> tuple[Column, Column]:
    """(key, weight) of a heading line; null for other lines. At most 80 characters and six words with a letter; a colon at
    the end, mostly capital letters, or mostly capitalised words."""
    trimmed = F.trim(F.regexp_replace(without_bullet(F.trim(line)), "^:+|:+$", ""))
    words = F.filter(F.split(trimmed, r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(trimmed, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(trimmed, r"[^\p{Lu}]", ""))
    started = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    fits = (F.length(trimmed) > 0) & (F.length(trimmed) <= 80) & (F.size(words) <= 6) & (letters > 0)
    colon = F.rtrim(line).endswith(":")
    is_heading = fits & (colon | (capitals >= 0.6 * letters) | (started >= 0.8 * F.size(words)))
    key = text.truthy(text.normalize_lines(trimmed))
    return F.when(is_heading, key), F.when(colon | (capitals >= 0.75 * letters), 1.1).otherwise(1.0)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line, head, own``: every line with text; a heading has its key and weight."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "raw")).select("doc_id", "pos", F.trim("raw").alias("line")).where("line <> ''")
    key, weight = heading(F.col("line"))
    return lines.withColumns({"head": key, "own": F.when(key.isNotNull(), weight)})


def placed(rows: DataFrame) -> DataFrame:
    """Marked rows with their ``section`` and ``weight``; a text's headings must be among them, its other lines need not."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(order), F.lit("other")))
    most = F.max("own").over(Window.partitionBy("doc_id", "section"))
    return carried.withColumn("weight", F.when(F.col("section") == "other", F.greatest(F.coalesce(most, F.lit(0.85)), F.lit(0.85))).otherwise(most)).where("head is null")


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line, section, weight``: every content line with the heading above it (``other``, 0.85, before any);
    a heading that comes again keeps its greatest weight."""
    return placed(marked(docs)).select("doc_id", "pos", "line", "section", "weight")


def parts_of(line: Column) -> Column:
    return F.split(without_bullet(line), r"[,|;/]+")


def said(docs: DataFrame, key: Callable[[Column], Column], table: DataFrame) -> DataFrame:
    """``doc_id, pos, at, section, weight`` and the columns of ``table`` (one is ``alias``) for the phrases whose key is an
    alias there. Only they and the headings are dealt by document; other lines do not leave their task."""
    parts = F.posexplode_outer(F.when(F.col("head").isNull(), parts_of(F.col("line")))).alias("at", "raw")
    rows = marked(docs).select("doc_id", "pos", "head", "own", parts).withColumn("key_", key(F.trim("raw")))
    met = rows.join(few(table), F.col("key_") == F.col("alias"), "left").where("head is not null or alias is not null")
    return placed(met).drop("head", "own", "raw", "key_")


def said_skills(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``said`` for skills' keys: a line's letters and digits are taken out at once and split at the same places; what is
    left without digits at its end can only be that of its key, so the key itself is made for those that meet an alias."""
    line = F.regexp_replace(F.replace(F.lower("line"), F.lit("&"), F.lit("and")), "[^a-z0-9,|;/]+", " ")
    stem = lambda c: F.rtrim(F.translate(c, " ", ""), F.lit("0123456789"))
    parts = F.posexplode_outer(F.when(F.col("head").isNull(), F.split(line, "[,|;/]+"))).alias("at", "letters")
    rows = marked(docs).select("doc_id", "pos", "head", "own", "line", parts).withColumn("stem_", stem(F.col("letters")))
    met = rows.join(few(table.withColumn("stem", stem(F.col("alias")))), F.col("stem_") == F.col("stem"), "left").where("head is not null or alias is not null")
    whole = text.skill_key(F.trim(F.get(parts_of(F.col("line")), F.col("at"))))
    return placed(met.where(F.col("head").isNotNull() | (whole == F.col("alias")))).drop("head", "own", "line", "letters", "stem_", "stem")


def few(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A side that is counted before it is broadcast."""
    return F.broadcast(table) if table.count() <= most else table


def phrases(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, at, phrase, section, weight``: lines without their bullet, split at commas, bars, semicolons, slashes."""
    return lines.select("doc_id", "pos", F.posexplode(parts_of(F.col("line"))).alias("at", "raw"), "section", "weight").select("doc_id", "pos", "at", F.trim("raw").alias("phrase"), "section", "weight").where("phrase <> ''")


def first_phrases(rows: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` different phrases of each text, as a semantic match takes them."""
    keyed = rows.withColumn("key", text.normalize_lines("phrase")).where("key <> ''")
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos", "at"))).where("rn = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "at"))).where(F.col("n") <= limit).drop("rn")


def gram_keys(docs: DataFrame, most: int = 4) -> DataFrame:
    """``doc_id, by, key``: the key (``by`` k) and the acronym (s) of the 1 to 4 words from each place of a text on, without
    a version at the end; repeats are not taken out. Made inside the row; a word has a call of its own only where a digit
    ends it, and the words without marks come from one text that is split again."""
    rows = docs.select("doc_id", tokens("text").alias("t")).select("doc_id", "t", F.split(F.translate(F.array_join("t", " "), MARKS, ""), " ").alias("w"))
    lists = [F.slice(c, n + 1, F.size(c)).alias(f"{c}{n}") for c in ("t", "w") for n in range(most)]
    cells = rows.select("doc_id", F.inline(F.arrays_zip(*lists)))

    def first(n: int) -> Column:  # marks come before digits and letters
        return F.when(F.left(f"t{n}", F.lit(1)) >= "0", F.left(f"t{n}", F.lit(1))).when(F.col(f"t{n}").isNotNull(), "")

    def of(n: int) -> tuple[Column, Column]:
        """A version that ends a single word needs a sign before it; that of a later word has the space."""
        last, digit = F.col(f"t{n - 1}"), F.right(f"t{n - 1}", F.lit(1)).between("0", "9")
        plain = F.regexp_replace(last, text.VERSION_TAIL, "") if n == 1 else F.ltrim(F.regexp_replace(F.concat(F.lit(" "), last), text.VERSION_TAIL, ""))
        short = first(0) if n == 1 else F.when(digit & F.left(last, F.lit(1)).between("0", "9") & last.rlike(r"^\d+(\.\d+)*$"), "").otherwise(first(n - 1))
        return F.concat(*[F.col(f"w{k}") for k in range(n - 1)], F.when(digit, F.translate(plain, MARKS, "")).otherwise(F.col(f"w{n - 1}"))), F.concat(*map(first, range(n - 1)), short)

    made = F.array(*[F.struct(key.alias("key"), short.alias("short")) for key, short in map(of, range(1, most + 1))])
    pairs = cells.select("doc_id", F.explode(made).alias("p")).select("doc_id", "p.*").where("key <> ''")
    both = F.array(F.struct(F.lit("k").alias("by"), F.col("key").alias("key")), F.struct(F.lit("s").alias("by"), F.col("short").alias("key")))
    return pairs.select("doc_id", F.inline(both)).where("key <> ''")


def detect(docs: DataFrame, known: DataFrame, least: float = 0.6, with_fuzzy: bool = False, semantic: tuple[Callable[[Column], Column], float] | None = None) -> DataFrame:
    """``doc_id, skill, confidence, source``: the best evidence for each known skill.

    N-grams and phrases meet the alias index by equi-join (the index has the size of the skill list) where they are made:
    only those that meet it are dealt by document. Exact n-gram .98, synonym .90, acronym .88; phrase .95 times its
    section's weight, .99 at most; with ``with_fuzzy`` similar keys too: n-grams from .90, capped at .82, phrases from .88.
    With ``semantic`` (a function from text to a unit vector, and a least cosine) phrases count by their vectors too, .92 at
    most. Of equal confidences an n-gram's source comes before a phrase's."""
    index = alias_index(known)
    key = F.col("kind") == "key"
    spoken = index.select("alias", "canonical", F.lit("k").alias("by"), F.when(key, 0.98).otherwise(0.90).alias("conf"), F.when(key, "exact").otherwise("synonym").alias("source"))
    spoken = spoken.unionByName(index.select("alias", "canonical", F.lit("s").alias("by"), F.lit(0.88).alias("conf"), F.lit("synonym").alias("source")))
    written = index.select("alias", "canonical", F.lit(0.99).alias("cap"), F.lit(0.95).alias("part"), F.lit("exact:").alias("kind"))
    if with_fuzzy:
        keys = index.where("kind = 'key'").select("canonical", F.col("alias").alias("skill_key"))
        near = _near(gram_keys(docs).where("by = 'k'").select("key"), keys, 0.90)
        spoken = spoken.unionByName(near.select(F.col("key").alias("alias"), "canonical", F.lit("k").alias("by"), F.least(F.lit(0.82), F.col("ratio")).alias("conf"), F.lit("fuzzy").alias("source")))
        parts = marked(docs).where("head is null").select(F.explode(parts_of(F.col("line"))).alias("raw")).select(text.skill_key(F.trim("raw")).alias("key")).where("key <> ''")
        near = _near(parts, keys, 0.88)
        written = written.unionByName(near.select(F.col("key").alias("alias"), "canonical", F.lit(0.90).alias("cap"), F.least(F.lit(0.80), F.col("ratio")).alias("part"), F.lit("fuzzy:").alias("kind")))
        spoken, written = spoken.localCheckpoint(), written.localCheckpoint()
    grams = gram_keys(docs).withColumnRenamed("key", "alias").join(few(spoken), ["alias", "by"]).select("doc_id", "canonical", "conf", "source")
    by_phrase = said_skills(docs, written).select("doc_id", "canonical", F.least("cap", F.col("part") * F.col("weight")).alias("conf"), F.concat("kind", "section").alias("source"))
    hits = grams.unionByName(by_phrase)
    if semantic is not None:
        hits = hits.unionByName(semantic_hits(docs, known, *semantic))
    best = hits.groupBy("doc_id", "canonical").agg(F.max(F.struct("conf", (~F.col("source").contains(":")).alias("plain"), "source")).alias("b"))
    return best.where(F.col("b.conf") >= least).select("doc_id", F.col("canonical").alias("skill"), F.round("b.conf", 2).alias("confidence"), F.col("b.source").alias("source"))


def semantic_hits(docs: DataFrame, known: DataFrame, embed: Callable[[Column], Column], least: float = 0.65, limit: int | None = None) -> DataFrame:
    """``doc_id, canonical, conf, source`` from the vectors of each text's different phrases (with ``limit`` its first ones
    alone): a phrase speaks, where it comes first, for its most similar skill (the smaller name of equals) if the cosine is
    ``least`` or more, weighted by its section.

    Every different phrase is compared once, whatever the texts that hold it, with all skills in one product; the skills'
    vectors go to every task (the list of known skills is small)."""
    names = known.select(text.normalize_skill_app("skill").alias("canonical")).where("canonical <> ''").distinct()
    key = text.normalize_lines
    if limit is None:
        keys = marked(docs).where("head is null").select(F.explode(parts_of(F.col("line"))).alias("raw")).select(key(F.trim("raw")).alias("key")).where("key <> ''")
    else:
        first = first_phrases(phrases(sections(docs)), limit)
        keys = first.select("key")
    vectors_ = keys.distinct().withColumn("pv", embed(F.col("key")))
    best = vectors.nearest(vectors_, names.withColumn("sv", embed(F.col("canonical")))).where(F.col("sim") >= least)
    if limit is None:
        rows = said(docs, key, best.withColumnRenamed("key", "alias").localCheckpoint())
        first = rows.groupBy("doc_id", "alias").agg(F.min(F.struct("pos", "at", "section", "weight", "canonical", "sim")).alias("f")).select("doc_id", "f.*")
    else:
        first = first.join(best, "key")
    return first.select("doc_id", "canonical", F.least(F.lit(0.92), F.col("sim") * F.col("weight")).alias("conf"), F.concat(F.lit("semantic:"), "section").alias("source"))


def sorted_hits(hits: DataFrame) -> DataFrame:
    """``doc_id, hits``: each text's hits (skill, confidence, source) by falling confidence, then by name."""
    placed = F.struct((-F.col("confidence")).alias("away"), "skill", "source")
    rows = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(placed)).alias("h"))
    return rows.select("doc_id", F.transform("h", lambda x: F.struct(x["skill"].alias("skill"), (-x["away"]).alias("confidence"), x["source"].alias("source"))).alias("hits"))


def skill_names(docs: DataFrame, known: DataFrame | None = None, **detection) -> DataFrame:
    """``doc_id, skills``: the names of the detected skills in that order, for every text; none without known skills."""
    none = F.array().cast("array<string>")
    if known is None:
        return docs.select("doc_id", none.alias("skills"))
    found = sorted_hits(detect(docs, known, **detection)).select("doc_id", F.col("hits.skill").alias("skills"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("skills", none).alias("skills"))


def _near(keys: DataFrame, skills: DataFrame, least: float, few_skills: int = 1000) -> DataFrame:
    """``key, canonical, ratio``: different texts that are similar enough; each pair of texts is compared once.

    Up to ``few_skills`` skills go to the keys, which meet those of like length where they are made; an edit distance, which
    what two texts do not have in common bounds from above, leaves few pairs to be dealt. More skills meet the different
    keys by equal pairs of letters."""
    wanted = skills.select("skill_key").distinct()
    size, own = F.length("key"), F.length("skill_key")
    if wanted.count() <= few_skills:
        shortest, longest = F.ceil(own * (least / (2 - least)) - 1e-9), F.floor(own * ((2 - least) / least) + 1e-9)
        sizes = F.broadcast(wanted.select("skill_key", F.explode(F.sequence(F.greatest(shortest, F.lit(1)).cast("int"), longest.cast("int"))).alias("size")))  # a row for each skill and length
        met = keys.join(sizes, size == F.col("size")).where((F.col("key") != F.col("skill_key")) & (F.levenshtein("key", "skill_key") <= (1 - least) * (size + own) + 1e-9)).select("key", "skill_key").distinct()
    else:
        pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(2))))
        left = keys.select("key").distinct().select("key", F.explode(pieces("key")).alias("p"))
        right = wanted.select("skill_key", F.explode(pieces("skill_key")).alias("p"))
        met = left.join(right, "p").where(fuzzy.may_reach(F.col("key"), F.col("skill_key"), least) & (F.col("key") != F.col("skill_key"))).select("key", "skill_key").distinct()
    return met.withColumn("ratio", fuzzy.sequence_ratio("skill_key", "key")).where(F.col("ratio") >= least).join(skills, "skill_key").select("key", "canonical", "ratio")


def calibrated(confidence: Column, temperature: float = 1.0) -> Column:
    """A confidence on the logit scale divided by a temperature."""
    p = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1.0 / (1.0 + F.exp(-F.ln(p / (1.0 - p)) / temperature))
