"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  Every run of ``window``
consecutive words of a benchmark item is one n-gram; an item with fewer words is one n-gram as a whole.
The n-grams' hashes go to the executors in blocks of a bounded size, documents are scanned once per block,
and a hash that hits is verified on the words themselves.  Documents are never shuffled.

Defined cases: a null or empty text has no words and no hits; a null or wordless item has no n-grams; items
without an id mark words but are not reported; repeated rows are reported once per row; an empty table gives
an empty result; a very long text is walked word by word in one task; items with the same n-grams are all reported;
in mark() and cut_spans() input columns named like an added one are replaced, in drop_documents() they stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, pin, renamed, restored, unpin, without

WINDOW = 10
#: Benchmark text that one broadcast may hold; more is scanned in several blocks.
BLOCK_BYTES = 8 << 20
ADDED = {"n_words": "bigint", "hit_runs": "array<struct<start:bigint,stop:bigint>>", "hit_items": "array<string>"}


class Grams:
    """The n-grams of a block of items, by length: sorted hashes, the items they are in and where; and the items' words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.words: set[bytes] = set()
        self.items: list[tuple[str | None, list[bytes]]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        same: dict[bytes, bytes] = {}  # one object a word
        for item, text in items:
            words = [same.setdefault(w, w) for w in alnum_words(text)]
            n = min(window, len(words))
            if n:
                keys = np.fromiter((self.key(words[i : i + n]) for i in range(len(words) - n + 1)), np.uint64)
                found.setdefault(n, []).append((keys, len(self.items)))
                self.items.append((item, words))
        self.words = set(same)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            item = np.repeat(np.array([i for _, i in parts], np.int32), [len(k) for k, _ in parts])
            start = np.concatenate([np.arange(len(k), dtype=np.int32) for k, _ in parts])
            self.by_length[n] = (keys[order], item[order], start[order])

    @staticmethod
    def key(gram: list[bytes]) -> int:
        return xxhash.xxh3_64_intdigest(b" ".join(gram))

    def _holders(self, gram: list[bytes], length: int, at: int) -> tuple[bool, set[str]]:
        """Whether any n-gram from ``at`` on with this one's hash is this one, word by word, and the items that have it."""
        keys, item, start = self.by_length[length]
        hit, holders, key = False, set(), keys[at]
        while at < len(keys) and keys[at] == key:
            name, words = self.items[item[at]]
            if (name is None or name not in holders) and words[start[at] : start[at] + length] == gram:
                hit = True
                holders |= {name} if name is not None else set()
            at += 1
        return hit, holders

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal runs [start, stop) of hit words, and the items that hit."""
        runs: list[list[int]] = []
        items: set[str] = set()
        known, at, n = self.words, 0, len(words)
        seen: dict[tuple[int, int], tuple[bool, set[str], list[bytes]]] = {}
        while at < n:
            if words[at] not in known:
                at += 1
                continue
            end = at + 1
            while end < n and words[end] in known:
                end += 1
            for length, (keys, _, _) in self.by_length.items():
                many = end - at - length + 1
                if many < 1:
                    continue
                mine = np.fromiter((self.key(words[i : i + length]) for i in range(at, at + many)), np.uint64, many)
                first = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                for i in np.flatnonzero(keys[first] == mine).tolist():
                    of = (length, int(mine[i]))
                    gram = words[at + i : at + i + length]
                    if of not in seen or seen[of][2] != gram:
                        seen[of] = (*self._holders(gram, length, int(first[i])), gram)
                    hit, holders, _ = seen[of]
                    if hit:
                        items |= holders
                        runs.append([at + i, at + i + length])
            at = end
        return _merged(runs, []), items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_bytes, by a hash of their id and text."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.encode(F.col(text_col), "utf-8").alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item, bytes(r.text) if r.text is not None else None) for r in rows.collect()]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, hit_runs (word positions) and hit_items (sorted)."""
    spark = docs.sparkSession
    out = without(docs, list(ADDED))
    names = out.columns
    held = None
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if k:  # the next block reads what the last one left, so that one broadcast is held at a time
            out, last = pin(out, "decontaminate"), held
            held = out
            if last is not None:
                unpin(last)
        schema = ", ".join(
            [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in ADDED]
            + [f"{n} {t}" for n, t in ADDED.items()]
        )
        grams = spark.sparkContext.broadcast(Grams(items, window))
        out = out.mapInArrow(_scanner(grams, names, text_col, k == 0), schema)
    return out


def _scanner(grams, names: list[str], text_col: str, first: bool):
    types = [
        pa.int64(),
        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
        pa.list_(pa.string()),
    ]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = grams.value
        for batch in batches:
            n_words, all_runs, all_items = [], [], []
            for row, text in enumerate(as_bytes(batch.column(text_col))):
                words = alnum_words(text)
                runs, items = index.scan(words)
                if not first:
                    runs = _merged(runs, [[x["start"], x["stop"]] for x in batch.column("hit_runs")[row].as_py()])
                    items |= set(batch.column("hit_items")[row].as_py())
                n_words.append(len(words))
                all_runs.append([{"start": a, "stop": b} for a, b in runs])
                all_items.append(sorted(items))
            added = [pa.array(x, t) for x, t in zip((n_words, all_runs, all_items), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, *ADDED])

    return scan


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def n_hit() -> F.Column:
    return F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"])


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without any benchmark passage, columns unchanged, those named like an added one too."""
    safe, new = renamed(docs)
    return restored(mark(safe, benchmark, text_col=new[text_col], **options).where(F.size("hit_runs") == 0), new)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with every hit run of words cut out of the text, and one blank left in its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(as_bytes(batch.column(text_col)), batch.column("hit_runs").to_pylist(), strict=True):
                texts.append(_without_runs(text, [(r["start"], r["stop"]) for r in runs]) if runs else text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(texts, pa.binary()).cast(pa.string()))

    marked = mark(docs, benchmark, text_col=text_col, **options)
    return marked.mapInArrow(cut, marked.schema)


def _without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    import re

    places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for start, stop in runs:
        out += [text[at : places[start][0]], b" "]
        at = places[stop - 1][1]
    return b"".join([*out, text[at:]])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark, **options)
    return marked.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


#: The same report in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT DISTINCT p.rid, p.i, ks.k, g.item_id
  FROM p JOIN ks ON p.i + ks.k - 1 <= len(p.w)
  JOIN g ON g.k = ks.k AND g.gram = array_to_string(p.w[p.i:p.i + ks.k - 1], ' ')),
hw AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM h) GROUP BY rid),
hi AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256,
  coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
