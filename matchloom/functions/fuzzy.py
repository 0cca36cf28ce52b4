"""Ratcliff-Obershelp similarity. No built-in function computes it, so it is an Arrow-batched UDF over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length; argument order matters, as in the standard library; empty or null texts give 0."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


# else a filter on the ratio is taken through a distinct() below it, and every row pays for the call, not every different pair
sequence_ratio = sequence_ratio.asNondeterministic()


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two texts are long enough, relative to each other, to reach a ratio: evaluated before the UDF."""
    la, lb = F.length(a), F.length(b)
    return 2.0 * F.least(la, lb) >= least * (la + lb)


#: Characters that are counted together; others aren't counted, which loosens the bound and keeps it one.
COUNTED = (*"abcdefghijklmnopqrstuvwxyz", "01", "23", "45", "67", "89", " #+.-/")


def char_bits(c: Column) -> Column:
    """Character counts in unary, each up to 8, as four 64-bit words: the bits in which two texts differ are at most the
    characters that any matching of them leaves over."""
    words = []
    for at in range(0, len(COUNTED), 8):
        bits = F.lit(0).cast("long")
        for k, chars in enumerate(COUNTED[at : at + 8]):
            n = F.least(F.length(c) - F.length(F.translate(c, chars, "")), F.lit(8))
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1, F.lit(8 * k)))
        words.append(bits)
    return F.array(*words)


def bits_may_reach(a: str, b: str, a_bits: str, b_bits: str, least: float) -> Column:
    """Whether two texts have enough characters in common, in any order, to reach a ratio: evaluated before the UDF."""
    over = sum((F.bit_count(F.col(a_bits)[k].bitwiseXOR(F.col(b_bits)[k])) for k in range(1, len(COUNTED) // 8)), F.bit_count(F.col(a_bits)[0].bitwiseXOR(F.col(b_bits)[0])))
    return over <= (1 - least) * (F.length(a) + F.length(b)) + 1e-9
