"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic.  Raking scales the cells' tokens until their sums over
each of the three dimensions agree with the target shares, and a document's probability of being sampled is the
factor of its cell, times a constant, 1 at most, such that the expected number of sampled tokens is the wanted
one.  Whether a document is in the sample depends on a hash of its id alone (Poisson sampling), so the sample
is the same on every run.

The topic is the column of that name; where there is none, it is the kind of text by its surface (table, symbols,
brief or prose), a stand-in for a classifier.  If targets can't all be met together, raking ends after ITERATIONS
rounds with a warning that names the largest remaining difference.

Categories that no target names share the cell ``*``, so the number of cells is at most the product of the
numbers of named categories plus one, however many sources the data has.  Only the cells' sums reach the
driver; documents are read twice and never shuffled.

Defined cases: nulls in a dimension count as ``*``; a null or empty text has no tokens and its cell's
probability; a target that no document can meet is left out and the others are scaled up; ``*`` without a
target keeps the share it has; ids that many rows share are sampled together; an empty table gives an empty
result; in weigh() input columns named like an added one are replaced, in sample() they stay; a very long text is
one row like any other, and only counted.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, renamed, restored, without

OTHER = "*"
DIMS = ("source", "lang", "topic")
ADDED = ["mix_source", "mix_lang", "mix_topic", "n_tokens", "weight", "probability", "u", "selected"]
TARGETS = {
    "source": {f"src{k}": 0.05 for k in range(20)},
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13},
    "topic": {"prose": 0.84, "table": 0.06, "symbols": 0.04, "brief": 0.06},
}
ITERATIONS, TOLERANCE = 200, 1e-9


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """What kind of text it is, by its surface: table, symbols, brief or prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.regexp_count(text, F.lit(r"[#*$%&<>]"))
    return (
        F.when(text.isNull() | (tokens < 40), "brief")
        .when(bars * 4 > tokens, "table")
        .when(marks * 2 > tokens, "symbols")
        .otherwise("prose")
    )


def unit(key: Column) -> Column:
    """A number from 0 to 1 that only depends on the key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: dict[tuple, float], targets: list[dict[str, float]]) -> dict[tuple, float]:
    """The cells' weights, summing to 1, whose sums over each dimension are the target shares."""
    total = sum(cells.values())
    if not total:
        return dict.fromkeys(cells, 0.0)
    weights = {c: t / total for c, t in cells.items()}
    wanted = []
    for d, target in enumerate(targets):
        have: dict[str, float] = {}
        for c, w in weights.items():
            have[c[d]] = have.get(c[d], 0.0) + w
        rest = have.get(OTHER, 0.0) if OTHER not in target else None
        named = {k: v for k, v in target.items() if have.get(k, 0.0) > 0 and v > 0}
        scale = (1 - (rest or 0.0)) / (sum(named.values()) or 1.0)
        share = {k: v * scale for k, v in named.items()} | ({OTHER: rest} if rest else {})
        wanted.append({k: share.get(k, 0.0) for k in have})
    for _ in range(ITERATIONS):
        off = 0.0
        for d, share in enumerate(wanted):
            have = dict.fromkeys(share, 0.0)
            for c, w in weights.items():
                have[c[d]] += w
            off = max([off, *(abs(have[k] - share[k]) for k in share)])
            weights = {c: w * share[c[d]] / have[c[d]] if have[c[d]] else 0.0 for c, w in weights.items()}
        if off < TOLERANCE:
            return weights
    warnings.warn(f"raking stopped after {ITERATIONS} rounds; a share is still off by {off:.2g}", stacklevel=2)
    return weights


def calibrate(cells: dict[tuple, float], weights: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Probabilities in proportion to weight / tokens, 1 at most, with budget expected tokens if there are as many."""
    factor = {c: weights[c] / t for c, t in cells.items() if t}
    left, tokens, out = sorted(factor, key=lambda c: (-factor[c], c)), budget, {}
    while left:
        mass = sum(weights[c] for c in left)
        scale = tokens / mass if mass else 0.0
        if factor[left[0]] * scale < 1:
            out |= {c: factor[c] * scale for c in left}
            break
        out[left[0]] = 1.0
        tokens -= cells[left[0]]
        left = left[1:]
    return {c: out.get(c, 1.0) for c in cells}


def weigh(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] = TARGETS,
    share: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    dim_cols: dict[str, str] | None = None,
) -> DataFrame:
    """docs with their cell, n_tokens, weight, probability, u and selected; share: of the tokens, to be sampled."""
    spark = docs.sparkSession
    base = without(docs, ADDED)
    names = {c.lower(): c for c in base.columns} if dim_cols is None else dim_cols
    text = F.col(f"`{text_col}`")
    tokens = n_tokens(text)
    kinds = {"topic": topic_of(text, tokens)} | {d: F.col(f"`{names[d]}`") for d in DIMS if d in names}
    out = base.withColumn("n_tokens", tokens)
    for d in DIMS:
        value = kinds.get(d, F.lit(None).cast("string")).cast("string")
        out = out.withColumn(f"mix_{d}", F.when(value.isin(*targets[d]), value).otherwise(OTHER))
    keys = [f"mix_{d}" for d in DIMS]
    rows = out.groupBy(*keys).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    cells = {tuple(r[k] for k in keys): float(r.t) for r in rows}
    weights = rake(cells, [targets[d] for d in DIMS])
    p = calibrate(cells, weights, share * sum(cells.values()))
    plan = spark.createDataFrame(
        [(*c, weights[c], p[c]) for c in cells] or [(None, None, None, 0.0, 0.0)],
        ", ".join(f"{k} string" for k in keys) + ", weight double, probability double",
    )
    return (
        out.join(F.broadcast(plan), keys, "left")
        .withColumn("u", unit(F.col(f"`{id_col}`")))
        .withColumn("selected", F.col("u") < F.col("probability"))
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, its cell, n_tokens, weight of the cell, probability, u, selected."""
    return weigh(docs, **options).select("doc_id", *[F.col(f"mix_{d}").alias(d) for d in DIMS], "n_tokens", "weight", "probability", "u", "selected")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, columns unchanged, those named like an added one too."""
    safe, new = renamed(docs)
    dims = {c.lower(): n for c, n in new.items() if c.lower() in DIMS}
    options = {"id_col": new[options.pop("id_col", "doc_id")], "text_col": new[options.pop("text_col", "text")], "dim_cols": dims} | options
    return restored(weigh(safe, **options).where("selected"), new)
