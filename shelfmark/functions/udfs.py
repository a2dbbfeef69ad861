"""The few row functions Spark has no built-in for. All are Arrow batched."""

from __future__ import annotations

import json
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Characters whose compatibility form is one other character: folded natively by translate().
_SINGLE = {
    chr(code): unicodedata.normalize("NFKC", chr(code))
    for block in ((0xA0, 0x250), (0x2000, 0x2300), (0x2460, 0x2500), (0x3000, 0x3400), (0xF900, 0xFB00), (0xFF00, 0xFFF0))
    for code in range(*block)
    if not 0xD800 <= code < 0xE000
    and len(unicodedata.normalize("NFKC", chr(code))) == 1
    and unicodedata.normalize("NFKC", chr(code)) != chr(code)
}
_FROM, _TO = "".join(_SINGLE), "".join(_SINGLE.values())

#: Text made only of these needs no more than the translate fold: ASCII, precomposed Latin,
#: Greek and Cyrillic letters, common punctuation, kana and CJK, full-width ASCII.
_PLAIN = (
    r"^[\x00-\xA7\xA9-\xAE\xB0-\xB3\xB5-\xB7\xB9-\xBB\xBF-ıĴ-ľŁ-ňŊ-ž"
    r"Α-Ωα-ωЀ-џ‐‒-‖‘-‟†-•"
    r"　-゘ゝ-ゞ゠-ヾ㐀-鿿！-～]*$"
)


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def fold_width(text: Column) -> Column:
    """Native part of the compatibility fold: every one-to-one mapping, full-width forms first."""
    return F.translate(text, _FROM, _TO)


def nfkc(text: Column) -> Column:
    """Exact compatibility fold. Text that needs no Python is sent there as a null."""
    plain = text.rlike(_PLAIN)
    return F.when(plain, fold_width(text)).otherwise(_nfkc(F.when(~plain, text)))


@lru_cache(maxsize=65_536)
def _ratio(left: str, right: str) -> float:
    return 1.0 if left == right else SequenceMatcher(None, left, right, autojunk=True).ratio()


@pandas_udf(DoubleType())
def best_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The best matching-block ratio of any text of the first array and any of the second; null for a null or an empty one."""
    each = (None if a is None or b is None else max((_ratio(x, y) for x in a for y in b), default=None) for a, b in zip(left, right))
    return pd.Series(list(each), dtype="float64")


def edit_similarity(left: Column, right: Column) -> Column:
    """``1 - distance/longest``: the native counterpart of the ratio, checked against SQL."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest > 0, 1 - F.levenshtein(left, right) / longest).otherwise(F.lit(0.0))


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    return []


@pandas_udf(StringType())
def json_leaves(documents: pd.Series) -> pd.Series:
    """Every string leaf of a JSON document of any depth, blank separated."""

    def leaves(document):
        try:
            return " ".join(_strings(json.loads(document or "{}")))
        except (TypeError, ValueError):
            return ""

    return documents.map(leaves)
