"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words, hashed into ``n_buckets``.  The machine adds to a linear score the
inner products of the latent factors of every two terms that occur together, so that a pair such as an insult
and a group's name can weigh more (or less) than its members.

Fitting uses a bounded sample: at most about ``max_rows`` labelled rows, chosen by a hash of their id.  Terms
that a chi-squared test over that sample finds to differ in toxic rows are learned, alone and in pairs, without a bound
on their number; the words of a pair that is toxic only together are among them, as each is then more frequent in toxic
rows than elsewhere.  Scoring reads every whole text once, without a shuffle.

Defined cases: a null or empty text has no terms and gets the score of the bias alone; rows without a label
are not learned from; a label table with repeated or conflicting rows counts by the mean (1 from 0.5 on); if
no labelled row can be learned from, every score is ``prior``; repeated rows score alike; a very long text is
one set of terms; in score() input columns named like an added one are replaced, in drop_toxic() they stay; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, bucket_of, pin, renamed, restored, unpin, without

ADDED = ["toxicity", "is_toxic"]


@dataclass
class Settings:
    n_buckets: int = 1 << 20
    max_rows: int = 16_384
    #: Terms of so many rows are learned whose share of toxic rows differs from the mean with p < 0.001, however many there are.
    min_rows: int = 5
    min_gain: float = 10.83
    rank: int = 4
    #: Passes over the rows; more where there are few, for so many steps at least.
    epochs: int = 20
    min_steps: int = 600
    batch: int = 128
    rate: float = 0.02
    #: Variance of the Gaussian prior of every weight; the more rows, the less it holds them back.
    variance: float = 10.0
    prior: float = 0.05
    seed: int = 7


def buckets(text: bytes | None, n_buckets: int) -> np.ndarray:
    """The sorted distinct hashed terms of a text."""
    return np.unique(np.fromiter((zlib.crc32(w) % n_buckets for w in set(alnum_words(text))), np.int64))


@dataclass
class Machine:
    """bias + sum of w + sum over pairs of v . v, over the chosen terms that a text has."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    n_buckets: int
    slot: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.slot = {int(t): k for k, t in enumerate(self.terms)}

    def score(self, text: bytes | None) -> float:
        at = {zlib.crc32(w) % self.n_buckets for w in set(alnum_words(text))} if len(self.terms) else ()
        at = sorted(self.slot[t] for t in at if t in self.slot)
        s = self.v[at].sum(axis=0)
        z = self.bias + self.w[at].sum() + 0.5 * float(s @ s - (self.v[at] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, s: Settings) -> Machine:
    """Adam on the logistic loss over the terms that a batch has; rows hold indices into terms."""
    n, k = len(terms), s.rank
    rng = np.random.default_rng(s.seed)
    bias, w, v = np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))]), np.zeros(n), rng.normal(0, 0.01, (n, k))
    state = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in (("b", bias), ("w", w), ("v", v))}
    full = [i for i in range(len(rows)) if len(rows[i])]
    batches = max(1, -(-len(full) // s.batch))
    # a rare term is in few batches and is held back more in each
    seen = np.bincount(np.concatenate([rows[i] for i in full]), minlength=n) if full else np.zeros(n)
    decay = batches / np.clip(seen, 1, batches) / (s.variance * max(1, len(rows)))
    step = 0

    def update(name: str, x: np.ndarray, at, grad: np.ndarray) -> None:
        m, u = state[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        u[at] = 0.999 * u[at] + 0.001 * grad**2
        x[at] -= s.rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(u[at] / (1 - 0.999**step)) + 1e-8)

    for _ in range(max(s.epochs, -(-s.min_steps // batches)) if full else 0):
        order = rng.permutation(len(full))
        for start in range(0, len(order), s.batch):
            ids = [full[i] for i in order[start : start + s.batch]]
            sizes = np.array([len(rows[i]) for i in ids])
            at = np.concatenate([rows[i] for i in ids])
            of, first = np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes
            each = v[at]
            both = np.add.reduceat(each, first)
            z = bias + np.add.reduceat(w[at], first) + 0.5 * ((both**2).sum(axis=1) - np.add.reduceat((each**2).sum(axis=1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) / len(ids)
            used, slot = np.unique(at, return_inverse=True)
            pull = g[of, None] * (both[of] - each)
            step += 1
            update("b", bias, slice(None), np.array([g.sum()]))
            update("w", w, used, np.bincount(slot, g[of]) + decay[used] * w[used])
            update("v", v, used, np.stack([np.bincount(slot, pull[:, c]) for c in range(k)], axis=1) + decay[used, None] * v[used])
    return Machine(terms, float(bias[0]), w, v, s.n_buckets)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Machine:
    """The machine, from the labelled rows of docs (doc_id, text) for which learn holds on doc_id."""
    s, spark = settings, docs.sparkSession
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(learn)
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    n = known.count()
    if n > s.max_rows:  # a sample by hash, of a size that the bound limits
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * s.max_rows / n))
    chosen = known.limit(2 * s.max_rows)
    sample = pin(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_featurize(s.n_buckets), "toxic int, terms array<bigint>"),
        "toxicity-sample",
    )
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not total.n or total.pos in (0, total.n):
        unpin(sample)
        prior = s.prior if not total.n else (total.pos + s.prior) / (total.n + 1)
        return Machine(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, s.rank)), s.n_buckets)
    rate = total.pos / total.n
    expected = F.col("n") * F.lit(rate)
    found = (
        sample.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
        .where(F.col("n") >= min(s.min_rows, max(1, total.n // 20)))
        .where(F.pow(F.col("pos") - expected, 2) >= s.min_gain * expected * (1 - rate))
        .select("term")
        .collect()
    )
    terms = np.array(sorted(r.term for r in found), np.int64)
    held = docs.sparkSession.sparkContext.broadcast(terms)
    kept = sample.mapInArrow(_places(held), "toxic int, terms array<bigint>").collect()
    kept.sort(key=lambda r: (r.toxic, r.terms))  # the order rows arrive in must not decide the model
    unpin(sample)
    held.destroy()
    return fit_rows([np.array(r.terms, np.int64) for r in kept], np.array([r.toxic for r in kept], float), terms, s)


def _places(held):
    """toxic, and the places of a row's terms among the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        for batch in batches:
            at = [np.flatnonzero(np.isin(terms, x)) for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int64()))], names=["toxic", "terms"])

    return run


def _featurize(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [buckets(t, n_buckets) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], names=["toxic", "terms"]
            )

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and is_toxic (from 0.5 on)."""
    out = without(docs, ADDED)
    names = out.columns
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            p = np.array([m.score(t) for t in as_bytes(batch.column(text_col))], float)
            added = [pa.array(p, pa.float64()), pa.array(p >= 0.5, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, *ADDED])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + ["toxicity double", "is_toxic boolean"])
    return out.mapInArrow(run, schema)


def held_out() -> Column:
    return bucket_of(F.col("doc_id"), 5) == 0


def report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read for learning."""
    machine = fit(docs, labels, ~held_out(), settings)
    return score(docs.select("doc_id", "text"), machine).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that the machine does not reject, columns unchanged, those named like an added one too."""
    machine = fit(docs, labels, ~held_out(), settings)
    safe, new = renamed(docs)
    return restored(score(safe, machine, new["text"]).where(~F.col("is_toxic")), new)
