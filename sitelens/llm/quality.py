"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote that a text is good (1) or bad (-1), or abstain (0).  Expectation-maximisation over the counts of
vote patterns estimates how often each rule is right and how many texts are good, and a text is kept if the
posterior probability that it is good is a half or more.  A base check comes first: too few words, or too many
words in repeated windows, and the text goes whatever the rules say.

There are at most 3 ** 8 vote patterns, so the driver's table is bounded; the votes' weights are put back
into a column expression.  The features are computed once, without a shuffle, and written to the shared folder.
Windows are compared by their 64-bit hashes within one text.

Defined cases: a null or empty text has no words and is not kept; a text without any vote has the prior as its
posterior, and a tie, a posterior of exactly a half, keeps it; repeated rows are judged alike, and each counts in the
estimate; a very long text is one row, its words and their windows held in one task; other columns, whatever their
names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pin

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: A rule's accuracy starts at, and is drawn towards, the first figure, and stays between the others.
ACCURACY, LEAST, MOST = 0.85, 0.55, 0.99
PRIOR, PSEUDO, ROUNDS = 0.9, 0.05, 100


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, first occurrences included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

    def twice(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(ordered, lambda s: F.zip_with(
            s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
        ))
        return let(F.sort_array(F.array_distinct(F.flatten(pairs))), covered)

    none = F.lit(0).cast("bigint")
    return F.when(
        F.size(words) > WINDOW,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), twice(h)).otherwise(none)),
    ).otherwise(none)


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the counts that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = F.lit(rf"[^{SPACE}]+")
    words = F.regexp_extract_all(text, blank, F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        counts.alias("w"),
        by_line.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
        F.regexp_count(text, F.lit("[.!?]")).cast("bigint").alias("n_stops"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_letters", "n_stops")


def votes() -> dict[str, Column]:
    """Rule -> 1 good, -1 bad, 0 abstains."""
    n = F.col("n_words")

    def rule(good: Column, bad: Column) -> Column:
        return F.when(n == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": rule(n >= 50, n < MIN_WORDS),
        "word_length": rule(F.col("word_chars").between(3 * n, 12 * n), (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        "symbols": rule(F.col("n_symbols") * 20 < n, F.col("n_symbols") * 4 > n),
        "lines": rule(F.col("n_dup_lines") * 20 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > 3 * F.col("n_lines")),
        "repeats": rule(F.col("n_repeat_words") * 20 <= n, F.col("n_repeat_words") * 10 > 2 * n),
        "variety": rule(F.col("n_distinct") * F.col("n_distinct") >= 16 * n, (n >= 50) & (F.col("n_distinct") * F.col("n_distinct") < n)),
        "letters": rule(F.col("n_letters") * 10 >= 8 * F.col("word_chars"), F.col("n_letters") * 10 < 6 * F.col("word_chars")),
        "stops": rule(F.col("n_stops") * 100 >= n, (n >= 100) & (F.col("n_stops") == 0)),
    }


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int) -> tuple[float, list[float]]:
    """(share of good texts, each rule's accuracy), by expectation-maximisation over counted vote patterns."""
    total = sum(patterns.values())
    prior, accuracy = PRIOR, [ACCURACY] * n_rules
    extra = PSEUDO * total
    for _ in range(ROUNDS if total else 0):
        good, right, cast = extra * PRIOR, [extra * ACCURACY] * n_rules, [extra] * n_rules
        for pattern, n in patterns.items():
            p = posterior(pattern, prior, accuracy)
            good += n * p
            for r, v in enumerate(pattern):
                if v:
                    right[r] += n * (p if v > 0 else 1 - p)
                    cast[r] += n
        new = [min(MOST, max(LEAST, a / b)) for a, b in zip(right, cast, strict=True)]
        share = min(MOST, max(1 - MOST, good / (total + extra)))
        done = abs(share - prior) + sum(abs(a - b) for a, b in zip(new, accuracy, strict=True)) < 1e-10
        prior, accuracy = share, new
        if done:
            break
    return prior, accuracy


def posterior(pattern: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    z = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy, strict=True))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: its features, votes, posterior, base_failed and kept."""
    rules = votes()
    seen = pin(features(docs, text_col, id_col), "quality").withColumns({f"vote_{r}": v for r, v in rules.items()})
    names = [f"vote_{r}" for r in rules]
    rows = seen.groupBy(*names).agg(F.count("*").alias("n")).collect()
    prior, accuracy = estimate({tuple(r[c] for c in names): r.n for r in sorted(rows)}, len(names))
    z = F.lit(math.log(prior / (1 - prior)))
    for c, a in zip(names, accuracy, strict=True):
        z = z + F.col(c) * F.lit(math.log(a / (1 - a)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        seen.withColumn("posterior", 1 / (1 + F.exp(-z)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
    )


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
