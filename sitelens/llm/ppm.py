"""Language-model scoring by prediction with partial matching (PPM).

The model is a table of byte contexts of up to ORDER bytes with counts of the bytes that followed.  A byte is
predicted in the longest context that the table has; if it never followed there, an escape goes to the next
shorter one, where the bytes that the longer one could have predicted are excluded, and in the end to a uniform
choice among the bytes that no context has seen.  An escape weighs as many counts as the context has distinct
bytes (method C).  A text is its bytes, A-Z lower-cased, and an end, which is the byte 0xFF that UTF-8 never
uses; before its first byte stand ORDER such bytes.  ``adaptive`` scores a text by what it has itself seen so
far; ``report`` scores it by the whole table of the training texts.

Counting covers the windows of all texts and the words of the training texts; counts are added up in each task
before they are shuffled.  A window that training has seen is predicted in its full context; for the others, the
orders are joined and the escapes added up, once for each distinct window.  No window or context is left out:
the HEAD_WINDOWS most frequent windows and the MAX_HEAD most frequent words go to the executors with their
scores, and only the pairs of a document and a rarer one are shuffled to meet the tables, so no key is hot.
Texts are read twice and never shuffled.

Defined cases: a null or empty text is its end alone; without training texts every byte is equally likely;
repeated rows are scored alike, and each counts in training; a null id counts as an empty one in the choice of held-out
texts; a very long text is counted and scored as a whole, its words and windows held in one task; windows with equal
counts go to the executors together or not at all; other columns, whatever their names, are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bucket_of, pin, plain_words

ORDER = 5
END = b"\xff"
HEAD_WINDOWS, MAX_HEAD = 1 << 19, 1 << 18
#: Bytes and distinct words that a task works on at a time.
CHUNK, FLUSH = 4 << 20, 400_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte windows that end at each byte of each text and at its end, and where texts start."""
    pad = END * ORDER
    a = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8).astype(np.int64)
    key = np.zeros(len(a) - ORDER if len(a) else 0, np.int64)
    for k in range(ORDER + 1):
        key |= a[k : len(a) - ORDER + k] << (8 * (ORDER - k))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + ORDER) - ORDER
    keep = np.ones(len(key), bool)
    for k in range(ORDER):  # windows that end in the next text's padding
        at = ends[:-1] + k
        keep[at] = False
    return key[keep], np.cumsum(sizes) - sizes


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + ORDER + 1
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, gram, n, m): the counts of a task's words and windows in training texts and, as m, in held-out
    texts, and of its training texts where both are null."""
    words: Counter[bytes] = Counter()
    keys, counts, n_texts = np.zeros(0, np.int64), np.zeros((2, 0), np.int64), 0

    def rows(w: dict, k: np.ndarray, c: np.ndarray, n: int) -> pa.RecordBatch:
        word = pa.array([*w, *[None] * (len(k) + 1)], pa.binary())
        gram = pa.array(np.concatenate([np.zeros(len(w), np.int64), k, [0]]), mask=np.r_[np.ones(len(w), bool), np.zeros(len(k), bool), True])
        n = np.concatenate([np.fromiter(w.values(), np.int64, len(w)), c[0], [n]])
        m = np.concatenate([np.zeros(len(w), np.int64), c[1], [0]])
        return pa.RecordBatch.from_arrays([word, gram, pa.array(n), pa.array(m)], names=["word", "gram", "n", "m"])

    for batch in batches:
        sides: tuple[list[bytes], list[bytes]] = ([], [])
        for t, held in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            sides[bool(held)].append((t or b"").lower())
        n_texts += len(sides[0])
        for side, texts in enumerate(sides):
            for part in _chunks(texts):
                if not side:
                    for t in part:
                        words.update(t.split())
                k, c = np.unique(grams(part)[0], return_counts=True)
                both = np.concatenate([keys, k])
                keys, at = np.unique(both, return_inverse=True)
                old, counts = counts, np.zeros((2, len(keys)), np.int64)
                counts[:, at[: old.shape[1]]] = old
                counts[side, at[old.shape[1] :]] += c
                if len(words) > FLUSH or len(keys) > 4 * FLUSH:
                    yield rows(words, keys, counts, n_texts)
                    words, keys, counts, n_texts = Counter(), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), 0
    yield rows(words, keys, counts, n_texts)


def _low(column: Column | str, n_bytes: int) -> Column:
    """The last bytes of a window."""
    return (F.col(column) if isinstance(column, str) else column).bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1).cast("bigint"))


class Model:
    """The counts of all windows, and from them the exact scores of windows."""

    #: Orders with up to so many context bytes have a bounded number of nodes.
    SMALL = 1

    def __init__(self, windows: DataFrame):
        """windows: (gram, n, m), each window once; n and m are how often it stands in training and other texts."""
        self.windows = windows

    @cached_property
    def nodes(self) -> DataFrame:
        """k, node (k context bytes and the byte that followed), n."""
        k = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
        each = self.windows.where("n > 0").select(k, "gram", "n")
        nodes = each.groupBy("k", F.expr("gram & (shiftleft(256L, 8 * k) - 1)").alias("node")).agg(F.sum("n").alias("n"))
        return pin(nodes, "ppm-nodes")

    @cached_property
    def contexts(self) -> DataFrame:
        """k, context, the count and number of its bytes, and what the next shorter context counts for these bytes."""
        # every window has all orders, so a shorter context's count is the sum over the longer ones
        short = F.sum("n").over(Window.partitionBy("k", F.expr("node & (shiftleft(1L, 8 * k) - 1)")))
        each = self.nodes.select("k", F.shiftright("node", 8).alias("context"), "n", short.alias("short"))
        sums = each.groupBy("k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("q"), F.sum("short").alias("excluded"))
        return pin(sums, "ppm-contexts")

    def score(self, windows: DataFrame) -> DataFrame:
        """(gram) rows to (gram, log10 of the probability of its last byte after the others); each gram once."""
        parts = ("total", "q", "excluded", "n")
        k = F.explode(F.sequence(F.lit(self.SMALL + 1), F.lit(ORDER))).alias("k")
        each = windows.select("gram", k).withColumn("node", F.expr("gram & (shiftleft(256L, 8 * k) - 1)"))
        each = each.withColumn("context", F.shiftright("node", 8))
        large = f"k > {self.SMALL}"
        each = each.join(self.contexts.where(large), ["k", "context"], "left").join(self.nodes.where(large), ["k", "node"], "left")
        row = each.groupBy("gram").agg(
            *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(self.SMALL + 1, ORDER + 1) for c in parts]
        )
        for k in range(self.SMALL + 1):
            nodes = self.nodes.where(f"k = {k}").select(F.col("node").alias("_node"), F.col("n").alias(f"n{k}"))
            sums = self.contexts.where(f"k = {k}").select(F.col("context").alias("_context"), *[F.col(c).alias(f"{c}{k}") for c in parts[:3]])
            node = _low("gram", k + 1)
            row = row.join(F.broadcast(nodes), node == F.col("_node"), "left").drop("_node")
            row = row.join(F.broadcast(sums), F.shiftright(node, 8) == F.col("_context"), "left").drop("_context")
        out, zero = F.lit(0.0), F.lit(0)
        for k in range(ORDER, -1, -1):
            n, q = F.col(f"total{k}"), F.col(f"q{k}")
            done = F.lit(False)
            if k < ORDER:
                n, q = n - F.coalesce(f"excluded{k + 1}", zero), q - F.coalesce(f"q{k + 1}", zero)
                done = F.coalesce(*[f"n{j}" for j in range(k + 1, ORDER + 1)]).isNotNull()
            step = F.when(q > 0, F.log10(F.coalesce(f"n{k}", q) / (n + q)))
            out += F.when(~done, F.coalesce(step, F.lit(0.0))).otherwise(0.0)
        seen = F.coalesce(*[f"n{k}" for k in range(ORDER + 1)]).isNotNull()
        left = F.lit(256) - F.coalesce("q0", zero)
        out -= F.when(~seen & (left > 0), F.log10(left)).otherwise(0.0)
        return row.select("gram", out.alias("log10"))

    @cached_property
    def scores(self) -> DataFrame:
        """gram, the number of its places in all texts, log10; every window of the texts."""
        own = Window.partitionBy(F.shiftright("gram", 8))
        places = (F.col("n") + F.col("m")).alias("places")
        step = F.log10(F.col("n") / (F.sum("n").over(own) + F.count("*").over(own))).alias("log10")
        seen = self.windows.where("n > 0").select("gram", places, step)
        new = self.windows.where("n = 0")
        rest = self.score(new.select("gram")).join(new.select("gram", places), "gram").select("gram", "places", "log10")
        return pin(seen.union(rest), "ppm-scores")

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        codes, unique = pd.factorize(windows)
        rows = self.windows.sparkSession.createDataFrame(pd.DataFrame({"gram": unique}), "gram bigint")
        found = {r.gram: r["log10"] for r in self.score(rows).collect()}
        return np.array([found[int(w)] for w in unique])[codes]


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def train(texts: DataFrame, held: Column | None = None) -> tuple[Model, DataFrame, int, int, int]:
    """The model, the table (word, c), the numbers of tokens and of distinct tokens, ends included, and of texts.

    Texts where held is true are not learned, but the model has the scores of their windows too."""
    counted = texts.select("text", (F.lit(False) if held is None else held).alias("held"))
    counted = counted.mapInArrow(_counted, "word binary, gram bigint, n bigint, m bigint")
    counted = pin(counted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "ppm-counts")
    sums = counted.where(F.col("gram").isNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("word").alias("v"),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("texts"),
    ).first()
    words = counted.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    return Model(counted.where(F.col("gram").isNotNull()).select("gram", "n", "m")), words, sums.n, sums.v + (sums.texts > 0), sums.texts


def _level(column: str) -> Column:
    return F.floor(F.log2(column) * 8).cast("int")


def _least(rows: DataFrame, column: str, size: int) -> int | None:
    """The level of counts from which on the rows are size at most; none if even the highest level has more."""
    room, least = size, None
    for r in sorted(rows.groupBy(_level(column).alias("level")).count().collect(), key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    return least


def head_of(words: DataFrame, size: int = MAX_HEAD) -> tuple[dict[bytes, int], int | None]:
    """The most frequent words with their counts, size at most, and the level of counts from which on all are in it."""
    least = _least(words, "c", size)
    if least is None:
        return {}, least
    return {bytes(r.word): r.c for r in words.where(_level("c") >= least).collect()}, least


def head_windows(scores: DataFrame, size: int | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """The most frequent windows in order, their scores, and the level of places from which on all are in it."""
    least = _least(scores, "places", HEAD_WINDOWS if size is None else size)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), least
    rows = scores.where(_level("places") >= least).select("gram", "log10").toArrow()
    gram, score = rows["gram"].to_numpy(), rows["log10"].to_numpy()
    order = np.argsort(gram)
    return gram[order], score[order], least


def held_out() -> Column:
    return bucket_of(F.col("doc_id"), 7) == 2


def _lists(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """Sizes of the texts' lists, and two columns of what they hold, as two columns of lists."""
    sizes, first, second = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(first, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(second, pa.int64()))


def _windows(texts: list[bytes], head: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The sum of the scores of each text's windows in the head, and its other windows and how often it has them."""
    score, parts = [np.zeros(0)], []
    for part in _chunks(texts):
        keys, starts = grams(part)
        codes, unique = pd.factorize(keys)
        at, hit = _find(head, unique)
        value = np.zeros(len(unique))
        value[hit] = known[at[hit]]
        score.append(np.add.reduceat(value[codes], starts))
        rest = np.flatnonzero(~hit[codes])
        text = np.searchsorted(starts, rest, "right") - 1
        pair, times = np.unique(text * len(unique) + codes[rest], return_counts=True)
        parts.append((np.bincount(pair // len(unique), minlength=len(part)), unique[pair % len(unique)], times))
    return np.concatenate(score), *_lists(parts)


def _scorer(held):
    """Rows with the scores of the frequent windows, of the end and of the frequent words, and the rarer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_, known_, head, end = held.value
        for batch in batches:
            texts = [(t or b"").lower() for t in as_bytes(batch.column("text"))]
            n_tokens, n_known, base, rare, times = [], [], [], [], []
            for t in texts:
                words = plain_words(t)
                known, total, rest = int(end > 0), math.log10(end + 1), []
                for w, n in Counter(words).items():
                    c = head.get(w)
                    if c is None:
                        rest.append((w, n))
                    else:
                        known += n
                        total += n * math.log10(c + 1)
                n_tokens.append(len(words) + 1)
                n_known.append(known)
                base.append(total)
                rare.append([w for w, _ in rest])
                times.append([n for _, n in rest])
            score, windows, places = _windows(texts, grams_, known_)
            n_bytes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rid", "doc_id", "held_out")]
                + [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64())]
                + [pa.array(score, pa.float64()), pa.array(n_bytes, pa.int64())]
                + [pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                + [windows, places],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "head_score", "n_bytes", "rare", "times", "windows", "places"],
            )

    return run


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    model, words, n_train, n_distinct, n_texts = train(docs, held_out())
    head, least = head_of(words)
    grams_, known, least_window = head_windows(model.scores)
    held = docs.sparkSession.sparkContext.broadcast((grams_, known, head, n_texts))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = pin(
        rows.mapInArrow(
            _scorer(held),
            f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, head_score double, "
            "n_bytes bigint, rare array<binary>, times array<bigint>, windows array<bigint>, places array<bigint>",
        ),
        "ppm-scored",
    )
    tail = words if least is None else words.where(_level("c") < least)
    pairs = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "rid", F.col("p.rare").alias("word"), F.col("p.times").alias("times")
    )
    found = (
        pairs.join(tail, "word")
        .groupBy("rid")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    )
    rare = model.scores if least_window is None else model.scores.where(_level("places") < least_window)
    windows = scored.select("rid", F.explode(F.arrays_zip("windows", "places")).alias("p")).select(
        "rid", F.col("p.windows").alias("gram"), F.col("p.places").alias("times")
    )
    rest = windows.join(rare.select("gram", "log10"), "gram").groupBy("rid").agg(F.sum(F.col("times") * F.col("log10")).alias("rest"))
    scale = math.log10(n_train + n_distinct + 1)
    zero = F.lit(0).cast("bigint")
    score = F.col("head_score") + F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare", "times", "windows", "places").join(found, "rid", "left").join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def adaptive(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and the log10 probability of each text by a trie that starts empty and learns from each byte it codes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [adaptive_log10((t or b"").lower()) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def adaptive_log10(text: bytes) -> float:
    seen: dict[bytes, Counter[int]] = defaultdict(Counter)
    line, total = END * ORDER + text + END, 0.0
    for i in range(ORDER, len(line)):
        byte, out = line[i], set()
        for k in range(ORDER, -1, -1):
            counts = {b: n for b, n in seen.get(line[i - k : i], Counter()).items() if b not in out}
            if not counts:
                continue
            whole = sum(counts.values()) + len(counts)
            if byte in counts:
                total += math.log10(counts[byte] / whole)
                break
            total += math.log10(len(counts) / whole)
            out |= counts.keys()
        else:
            total -= math.log10(256 - len(out))
        for k in range(ORDER + 1):
            seen[line[i - k : i]][byte] += 1
    return total
