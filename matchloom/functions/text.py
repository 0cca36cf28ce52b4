"""Text, skill and key normalisation as Column expressions; each is one projection and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a skill keeps, and a version at its end.
SKILL_CHARS = r"[^a-z0-9+.#/\-\s]"
VERSION_TAIL = r"(?<=\D)\d+(\.\d+)*$"
#: Python's and Unicode's white space that a plain trim leaves.
EDGE = r"^[\s ]+|[\s ]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EDGE, "")


def truthy(c: Column | str) -> Column:
    """A text, or null where it is empty: alias chains fall through both."""
    return F.nullif(col(c), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    return F.coalesce(*[truthy(c) for c in cs])


def normalize_text(c: Column | str) -> Column:
    """Null becomes empty; trimmed, lower case; tabs, line ends and no-break spaces become single spaces."""
    s = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\r\n]+", " "), r"\s{2,}", " ")


def normalize_skill(c: Column | str) -> Column:
    s = F.regexp_replace(F.replace(normalize_text(c), F.lit("&"), F.lit(" and ")), SKILL_CHARS, " ")
    return F.trim(F.regexp_replace(s, r"\s{2,}", " "))


def normalize_skill_app(c: Column | str) -> Column:
    """As ``normalize_skill``, and without a version at the end: ``Python3`` and ``python 3.8`` are ``python``."""
    s = F.replace(F.lower(strip(F.coalesce(col(c), F.lit("")))), F.lit("&"), F.lit(" and "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, SKILL_CHARS, " "), r"\s+", " "))
    return F.trim(F.regexp_replace(s, VERSION_TAIL, ""))


def taxonomy_key(c: Column | str) -> Column:
    """Letters, digits and skill marks, lower case, single spaces, ``&`` as ``and``."""
    return normalize_skill(c)


def normalize_lines(c: Column | str) -> Column:
    """CV text: each line trimmed and single-spaced, at most one empty line in a row."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[ \t ]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def skill_key(c: Column | str) -> Column:
    return F.regexp_replace(normalize_skill_app(c), "[^a-z0-9]", "")


def acronym(c: Column | str) -> Column:
    firsts = F.transform(F.split(normalize_skill_app(c), " "), lambda w: F.substring(w, 1, 1))
    return F.array_join(F.filter(firsts, lambda x: x.rlike("[a-z0-9]")), "")


def squash(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def display_name(c: Column | str) -> Column:
    """Upper case for names with ``/`` or of three letters at most; else every letter after a non-letter is upper case."""
    s = col(c)
    words = F.regexp_extract_all(s, F.lit(r"([^\p{L}]*)(\p{L}*)"), 0)
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.regexp_extract(w, r"^([^\p{L}]*)", 1), F.initcap(F.regexp_extract(w, r"(\p{L}*)$", 1)))), "")
    return F.when(s.contains("/") | (F.length(s) <= 3), F.upper(s)).otherwise(titled)


def hash_id(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(col(c).cast("binary")), 1, 10))


def business_key(*cs: Column | str) -> Column:
    """Normalised parts joined by a bar; nulls count as empty, so every part keeps its place."""
    return F.concat_ws("|", *[normalize_text(c) for c in cs])


def fingerprint(fields: list[str]) -> Column:
    """Sixteen hex digits over ``name=value`` pairs in the order of names."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in sorted(fields)]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def etag(fields: list[str], key: str, updated: Column) -> Column:
    return F.concat(F.lit('W/"'), F.col(key).cast("string"), F.lit("-"), updated.cast("string"), F.lit("-"), fingerprint(fields), F.lit('"'))


def first_last(c: Column | str) -> tuple[Column, Column]:
    """First and last word of a name; a single word is both, and an empty name gives empty texts."""
    parts = F.split(strip(F.coalesce(col(c), F.lit(""))), r"\s+")
    return F.get(parts, F.lit(0)), F.element_at(parts, -1)


def clean_text(c: Column | str) -> Column:
    s = F.trim(col(c).cast("string"))
    return F.when(F.lower(s).isin("", "nan"), None).otherwise(s)


def norm_email(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def labelled_text(role: Column, skills: Column, summary: Column) -> Column:
    """``Role: … Skills: … Summary: …`` of what is there, or ``empty profile``."""
    parts = [F.when(truthy(role).isNotNull(), F.concat(F.lit("Role: "), role)), F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))), F.when(truthy(summary).isNotNull(), F.concat(F.lit("Summary: "), summary))]
    return F.coalesce(truthy(F.concat_ws(" ", *parts)), F.lit("empty profile"))


def embed_text(*parts: Column, skills: Column) -> Column:
    """Non-empty parts and the sorted skills, joined by spaces."""
    return F.trim(F.concat_ws(" ", *[truthy(p) for p in parts], truthy(F.array_join(F.array_sort(skills), " "))))


def profile_text(position: Column, department: Column, skills: Column) -> Column:
    """Position, department and skills, as far as they are there, joined by spaces (skills in their given order)."""
    return F.trim(F.concat_ws(" ", truthy(position), truthy(department), truthy(F.array_join(skills, " "))))


def reason_text(feature: Column, value: Column, contribution: Column) -> Column:
    # fixed values: the sentences
    two = F.format_string("%.2f", value)
    said = F.when(feature == "skill_overlap", F.concat(F.lit("Strong skill overlap ("), two, F.lit(").")))
    for name, start, end in (("experience_surplus", "Experience exceeds requirement (", " years)."), ("experience_gap", "Low experience gap (", " years)."), ("semantic_similarity", "High semantic similarity (", ")."), ("performance_score", "Good performance history (", ").")):
        said = said.when(feature == name, F.concat(F.lit(start), two, F.lit(end)))
    said = said.when(feature == "currently_active", F.lit("Currently active employee profile."))
    sign = F.when(contribution >= 0, "positive").otherwise("negative")
    return said.otherwise(F.concat(F.replace(feature, F.lit("_"), F.lit(" ")), F.lit(" had "), sign, F.lit(" impact ("), F.format_string("%+.3f", contribution), F.lit(").")))
