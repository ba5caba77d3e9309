"""The most frequent terms of a text, counted within the row by plain Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import passes
from .text import STOPWORDS

SCHEMA = "struct<top:array<struct<term:string,n:bigint>>>"


def most_frequent(low: str | None, n: int, k: int, word: re.Pattern, skip: frozenset[str]) -> dict:
    """The k most frequent runs of n words of a lower-cased text, ties by first position."""
    words = [w for w in word.findall(low or "") if w not in skip]
    terms = words if n == 1 else zip(*[words[i:] for i in range(n)])
    top = Counter(terms).most_common(k)  # equals stay in the order in which they came
    return {"top": [{"term": t if n == 1 else " ".join(t), "n": c} for t, c in top]}


def top(text: Column, n: int = 1, k: int = 10, least: int = 3, without: tuple[str, ...] = ()) -> Column:
    """Term and count, as an array of structs; words are of a-z and 0-9 only, of some length, and neither stop words nor others named."""
    word, skip = re.compile(rf"(?<!\w)[a-z0-9]{{{least},}}+(?!\w)"), frozenset(STOPWORDS) | frozenset(without)
    low = F.lower(F.coalesce(text, F.lit("")))
    return passes.column(low, lambda t: most_frequent(t, n, k, word, skip), SCHEMA)["top"]
