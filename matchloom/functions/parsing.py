"""Parsing of lists, numbers, dates, scores and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalize_skill, normalize_skill_app, normalize_text, strip

# Labels of performance ratings, and words that mean a positive or a negative label.
PERFORMANCE = {"superior": 1.0, "accord parfait": 0.8, "acceptable": 0.6, "inacceptable": 0.4, "non applicable": 0.2}
POSITIVE = ("1", "true", "yes", "y", "positive", "match")
NEGATIVE = ("0", "false", "no", "n", "negative", "no_match")
# Words of seniority with their years, and the orders in which date formats are tried.
SENIORITY = (("intern", 0), ("junior", 1), ("mid", 3), ("senior", 6), ("lead", 8), ("principal", 8))
#: Formats of employee records, and of imported HR files.
RECORD_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "MM/dd/yy")
IMPORT_FORMATS = ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yy")


def some(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def parse_skills(c: Column | str) -> Column:
    """Text split at commas, bars, semicolons and slashes; normalised, first occurrences kept in order."""
    return F.array_distinct(some(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[,|;/]+"), normalize_skill)))


def parse_skill_list(c: Column | str) -> Column:
    """Elements of an array, not split again; application normalisation, distinct."""
    return F.array_distinct(some(F.transform(col(c), normalize_skill_app)))


def parse_list(c: Column | str, separators: str = r"[,\n;/|]+") -> Column:
    """A bracketed list with quoted elements, else text split at the separators; elements are trimmed, empty ones go."""
    s = strip(F.coalesce(col(c), F.lit("")))
    inner = F.regexp_extract(s, r"(?s)^\[(.*)\]$", 1)
    quoted = F.regexp_extract_all(inner, F.lit(r"'([^']*)'|\"([^\"]*)\""), 0)
    listed = F.transform(quoted, lambda x: F.trim(x.substr(F.lit(2), F.length(x) - 2)))
    plain = F.transform(F.split(F.when(s.startswith("["), inner).otherwise(s), separators), lambda x: F.trim(x))
    return some(F.when(s.startswith("[") & (F.size(quoted) > 0), listed).otherwise(plain))


def parse_json_list(c: Column | str) -> Column:
    return some(F.coalesce(F.from_json(col(c), "array<string>"), parse_list(c)))


def parse_csv_skills(c: Column | str) -> Column:
    return F.array_distinct(some(F.transform(parse_list(c), normalize_skill)))


def number(c: Column | str) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def number_or(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.nullif(number(c), F.lit(float("nan"))), F.lit(default))


def years_in_text(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(\d+(\.\d+)?)", 1), F.lit("")).try_cast("double")


def year_in_text(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"((19|20)\d{2})", 1)


def first_filled(*cs: Column | str) -> Column:
    return F.coalesce(F.get(some(F.array(*[col(c) for c in cs])), F.lit(0)), F.lit(""))


def parse_date(c: Column | str, formats: tuple[str, ...] = RECORD_FORMATS) -> Column:
    """The first format that fits decides. A two-digit year from 69 on lies in the last century."""
    s = F.trim(col(c))
    made = []
    for f in formats:
        shape = "^" + "".join({"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{1,2}", "dd": r"\d{1,2}"}.get(p, p) for p in f.replace("/", " / ").replace("-", " - ").split()) + "$"
        day = F.try_to_timestamp(s, F.lit(f.replace("MM", "M").replace("dd", "d"))).cast("date")
        if f.endswith("/yy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        made.append(F.when(s.rlike(shape), day))
    return F.coalesce(*made)


def years_between(start: Column, end: Column) -> Column:
    return F.coalesce(F.round(F.greatest(F.datediff(end, start), F.lit(0)) / 365.25, 2), F.lit(0.0))


def calendar_years(start: Column, end: Column) -> Column:
    return F.coalesce(F.greatest(F.year(end) - F.year(start), F.lit(0)), F.lit(0))


def experience_score(years: Column, least: Column) -> Column:
    return F.least(years / F.when(least > 0, least).otherwise(F.lit(10.0)), F.lit(1.0))


def clamp(c: Column) -> Column:
    """[0, 1]; null and NaN are missing."""
    return F.when(F.isnan(c) | c.isNull(), None).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def performance_weight(c: Column | str) -> Column:
    """The label's weight, 0 for others."""
    s, out = normalize_text(c), None
    for label, weight in PERFORMANCE.items():
        out = F.when(s == label, F.lit(weight)) if out is None else out.when(s == label, F.lit(weight))
    return out.otherwise(F.lit(0.0))


def performance(c: Column | str) -> Column:
    """A label's weight, else a number (over 1: per cent), in [0, 1]; else 0."""
    n = number(c)
    known = normalize_text(c).isin(*PERFORMANCE)
    return F.when(known, performance_weight(c)).otherwise(F.coalesce(clamp(F.when(n > 1, n / 100).otherwise(n)), F.lit(0.0)))


def scaled(c: Column | str, most: float = 5.0) -> Column:
    n = number(c)
    return F.coalesce(clamp(F.when(n > 1, n / most).otherwise(n)), F.lit(0.0))


def score01(c: Column | str) -> Column:
    """A score in [0, 1]: over 1 it is a percentage; null where it is no number."""
    n = number(c)
    return clamp(F.when(n > 1, n / 100).otherwise(n))


def binary_label(c: Column | str) -> Column:
    """1 or 0 of a word, or of a number (1 and more: 1); null for anything else, NaN included."""
    s, n = F.lower(F.trim(col(c).cast("string"))), number(c)
    return F.when(s.isin(*POSITIVE), 1.0).when(s.isin(*NEGATIVE), 0.0).when(F.isnan(n) | n.isNull(), None).when(n >= 1, 1.0).otherwise(0.0)


def cascade(c: Column | str, rules: tuple[tuple[str, int], ...] = SENIORITY, default: int = 2) -> Column:
    """The value of the first rule whose text occurs."""
    s, out = F.lower(F.coalesce(col(c), F.lit(""))), None
    for text, value in rules:
        out = F.when(s.contains(text), F.lit(value)) if out is None else out.when(s.contains(text), F.lit(value))
    return out.otherwise(F.lit(default))


def active(terminated: Column, status: Column) -> Column:
    return (terminated.isNull() & (F.lower(F.trim(F.coalesce(status, F.lit("")))) != "terminated")).cast("double")
