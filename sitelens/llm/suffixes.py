"""Suffix-array dedup: every byte covered by a LENGTH-byte string that also starts elsewhere is removed.

The suffix array is built by a difference-cover algorithm: suffixes at two of three places are sorted by
triples, named, and sorted again by the names of names until a name stands for LENGTH bytes; the remaining
third is sorted by a byte and the rank after it, and merged in.  Equal strings then stand side by side, and
adjacent prefixes are compared.

A suffix array over all places of a corpus would move tens of times its size, so the array is distributed by
content.  Every window of LENGTH bytes has an anchor, its K-gram with the least hash, leftmost among equals;
equal windows have equal anchors at the same distance.  The windows that share an anchor form a span.

1. Equal texts, known by a 128-bit hash, are one text with a number of copies; two copies repeat as a whole.
2. Anchors whose K-gram occurs once in the corpus can't lie in a repeated window and go.
3. Spans that are equal as a whole repeat as a whole; this takes the inside of every long repeat.
4. One copy of each span whose K-gram occurs in different spans is dealt by that K-gram's hash, so equal
   windows meet, and the groups' suffix arrays tell which windows repeat.
5. A K-gram that more than HOT different spans have, such as one beside the edge of a passage in very many texts,
   would fill a task.  Its windows are halved by their distance from the anchor; those of a half share more bytes
   than the K-gram and are dealt by all of these, again and again, until every group is small.  Each half again
   holds its equal pieces once, so all groups go through step 4 in the end.

Per text, the repeated windows become removed runs.  Texts are scanned once and shuffled, compressed, three times.

Defined cases: a null text is empty; texts of fewer than LENGTH bytes keep all bytes; the same text twice is
removed as a whole, whatever its id, and repeated rows stay rows of their own; a very long text is scanned in
pieces that overlap by a window, so none is lost, and is held whole in one task; ties between equal K-grams of a
window go to the leftmost; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pin, unpin

LENGTH, K, HOT = 200, 64, 256
#: Bytes that are hashed at a time, a text's bytes at most in one piece, and bytes of a suffix array.
CHUNK, PIECE, BLOCK = 2 << 20, 1 << 25, 1 << 20
_PLACE = np.uint64((1 << 26) - 1)


# --- the difference-cover suffix array -------------------------------------------------------------------------


def suffix_array(s: np.ndarray, reach: int) -> np.ndarray:
    """The places of s (positive integers) in the order of their suffixes, by at least ``reach`` symbols."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    first = np.arange(1, n + (n % 3 == 1), 3)  # an extra place ends the first third where their names would run on
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    names = _names(t, sample)
    if names.max() + 1 < len(sample) and reach > 3:
        order = suffix_array(names + 1, -(-reach // 3))
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    key = t[rest] * wide + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[one] * wide + rank[one + 1], key)
    both = np.concatenate([rest, two])
    _, pair = np.unique(t[both + 1] * wide + rank[both + 2], return_inverse=True)
    pairs = t[both] * (len(both) + 1) + pair
    before = before + np.searchsorted(np.maximum.accumulate(pairs[len(rest) :]) if len(two) else two, pairs[: len(rest)])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(rest)) + np.maximum.accumulate(before)] = rest
    out[out < 0] = sampled
    return out


def _names(t: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ranks of the triples at the places."""
    wide = int(t.max()) + 1
    key = t[places] * wide + t[places + 1]
    if wide**3 >= 1 << 62:
        _, key = np.unique(key, return_inverse=True)
    return np.unique(key * wide + t[places + 2], return_inverse=True)[1]


def repeated_windows(spans: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each span, whether the window at each of its places also starts elsewhere in the spans."""
    line = np.frombuffer(b"".join(s + b"\0" * 8 for s in spans), np.uint8)
    sizes = np.fromiter((len(s) + 8 for s in spans), np.int64, len(spans))
    starts = np.cumsum(sizes) - sizes
    symbols = line.astype(np.int64) + 2
    inside = np.zeros(len(line), bool)  # places where a whole window starts
    for start, size in zip(starts, sizes, strict=True):
        symbols[start + size - 8 : start + size] = 1
        inside[start : start + max(0, size - 8 - length + 1)] = True
    order = suffix_array(symbols, length)
    order = order[inside[order]]
    a, b = order[:-1], order[1:]
    alike = np.ones(len(a), bool)
    for k in range(0, length, 8):  # adjacent prefixes, eight bytes at a time
        at = np.flatnonzero(alike)
        if not len(at):
            break
        step = min(k, length - 8)
        words = np.zeros(len(at), bool) | True
        for j in range(min(8, length)):
            words &= line[a[at] + step + j] == line[b[at] + step + j]
        alike[at[~words]] = False
    twice = np.zeros(len(line), bool)
    twice[a[alike]] = True
    twice[b[alike]] = True
    return [twice[s : s + max(0, n - 8 - length + 1)] for s, n in zip(starts, sizes, strict=True)]


# --- anchors ---------------------------------------------------------------------------------------------------


def _hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place on."""
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < K:
        h = (h[:-size] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[size:] + (h[:-size] >> np.uint64(29)))
        size *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, the anchor's distance from the first, K-gram hash) of every anchor of the texts."""
    line = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    none = np.zeros(0, np.int64)
    if len(line) < LENGTH:
        return none, none, none, none, none
    h = _hashes(line)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = LENGTH - K + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(line) - LENGTH + 1], least[width - size : width - size + len(line) - LENGTH + 1])
    anchor = (least & _PLACE).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    if not len(place):
        return none, none, none, none, none
    anchor = anchor[place]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(place)] - 1
    text = text[new]
    return text, place[new] - starts[text], place[last] - starts[text], anchor[new] - place[new], h[anchor[new]].astype(np.int64)


def _pieces(text: bytes) -> list[tuple[int, bytes]]:
    """A text in pieces that hold every window once."""
    return [(at, text[at : at + PIECE + LENGTH - 1]) for at in range(0, max(1, len(text) - LENGTH + 1), PIECE)]


def _in_chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(numbers of the texts, offsets, pieces), about CHUNK bytes at a time."""
    number, offset, part, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at, piece in _pieces(t) if len(t) >= LENGTH else ():
            number.append(i)
            offset.append(at)
            part.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield number, offset, part
                number, offset, part, size = [], [], [], 0
    if part:
        yield number, offset, part


def _key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _unzipped(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z, max_output_size=1 << 31)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, and the compressed text where the task has not seen the key before."""
    z = zstandard.ZstdCompressor(level=1)
    seen: set[bytes] = set()
    for batch in batches:
        keys, data = [], []
        for text in as_bytes(batch.column("text")):
            keys.append(_key(text or b""))
            data.append(None if keys[-1] in seen else z.compress(text or b""))
            seen.add(keys[-1])
        if len(seen) > 1 << 20:
            seen.clear()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["doc_id", "text_key", "z"])


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
        tid = batch.column("tid").to_numpy()
        for number, offset, part in _in_chunks([_unzipped(z) for z in batch.column("z").to_pylist()]):
            text, first, last, back, gram = anchors(part)
            span = [xxhash.xxh3_64_intdigest(part[t][a : b + LENGTH]) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
            start = np.array(offset, np.int64)[text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram),
                    pa.array(np.array(span, np.uint64).astype(np.int64)),
                    pa.array(tid[np.array(number, np.int64)[text]]),
                    pa.array((first + start).astype(np.int32)),
                    pa.array((last - first).astype(np.int16)),
                    pa.array(back.astype(np.int16)),
                ],
                names=["gram", "span", "tid", "first", "more", "back"],
            )


# --- which windows repeat --------------------------------------------------------------------------------------


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted spans of each text."""
    names = ["gram", "span", "back", "kinds", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.binary()]
    for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
        rows = []
        for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True):
            text = _unzipped(z)
            rows += [(w["gram"], w["span"], w["back"], w["kinds"], text[w["first"] : w["first"] + w["more"] + LENGTH]) for w in want]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces cut in two at the middle of near..far, the distances of their windows from the anchor.

    All windows of a half cover the bytes from ``near`` before the anchor to LENGTH - ``far`` after it; the half is dealt by these bytes.
    """
    names = ["gram", "span", "home", "home_span", "low", "back", "near", "far", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.binary()]
    for batch in batches:
        rows = []
        for p in batch.to_pylist():
            middle = (p["near"] + p["far"]) // 2
            least = p["back"] - (len(p["data"]) - LENGTH)  # the distance of the last window
            for near, far in {(p["near"], middle), (min(middle + 1, p["far"]), p["far"])}:
                first, last = min(far, p["back"]), max(near, least)
                if first < last:
                    continue
                skip = p["back"] - first
                data = p["data"][skip : p["back"] - last + LENGTH]
                shared = p["data"][p["back"] - near : p["back"] - far + LENGTH]
                gram = xxhash.xxh3_64_intdigest(shared + near.to_bytes(2, "big") + far.to_bytes(2, "big"))
                span = xxhash.xxh3_64_intdigest(data, seed=first)
                rows.append((gram - (1 << 63), span - (1 << 63), p["home"], p["home_span"], p["low"] + skip, first, near, far, data))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _by_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, span, low, high): the runs of repeated windows, from spans sorted by K-gram; groups stay together."""
    grams, spans, data, size = [], [], [], 0

    def found() -> pa.RecordBatch:
        rows = [(g, s, a, b) for g, s, m in zip(grams, spans, repeated_windows(data), strict=True) for a, b in _runs(m)]
        g, s, a, b = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["gram", "span", "low", "high"]
        )

    for batch in batches:
        for g, s, d in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "data")), strict=True):
            if grams and (g, s) == (grams[-1], spans[-1]):
                continue
            if size >= BLOCK and g != grams[-1]:
                yield found()
                grams, spans, data, size = [], [], [], 0
            grams.append(g)
            spans.append(s)
            data.append(d)
            size += len(d)
    if grams:
        yield found()


def _by_arrays(spans: DataFrame) -> DataFrame:
    """(gram, span, low, high): the runs of repeated windows of distinct spans (gram, span, data)."""
    dealt = spans.select("gram", "span", "data").repartition("gram").sortWithinPartitions("gram", "span")
    return dealt.mapInArrow(_by_suffixes, "gram bigint, span bigint, low int, high int")


def _split(spans: DataFrame) -> list[DataFrame]:
    """(gram, span, low, high), pinned, of the spans of the K-grams that more than HOT spans have."""
    pieces = spans.where(F.col("kinds") > HOT).select(
        "gram", "span", F.col("gram").alias("home"), F.col("span").alias("home_span"), F.lit(0).alias("low"), "back",
        F.lit(0).cast("smallint").alias("near"), F.lit(LENGTH - K).cast("smallint").alias("far"), "data",
    )
    kinds, out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema), []
    hot = pieces
    while not hot.isEmpty():
        halves = pin(hot.mapInArrow(_halves, kinds), "suffix-halves")
        same = pin(halves.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min("data").alias("data")), "suffix-halves-once")
        sizes = pin(same.groupBy("gram").agg(F.count("*").alias("kinds")), "suffix-sizes")
        whole = same.where("n > 1").select("gram", "span", F.lit(0).alias("from"), (F.length("data") - LENGTH).alias("to"))
        few = same.join(sizes.where((F.col("kinds") > 1) & (F.col("kinds") <= HOT)), "gram")
        partly = _by_arrays(few).select("gram", "span", F.col("low").alias("from"), F.col("high").alias("to")).join(same.where("n > 1"), ["gram", "span"], "left_anti")
        runs = halves.join(whole.unionByName(partly), ["gram", "span"])
        out.append(pin(runs.select(F.col("home").alias("gram"), F.col("home_span").alias("span"), (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high")), "suffix-runs"))
        rest = pin(halves.join(sizes.where(F.col("kinds") > HOT), "gram").select(*pieces.columns), "suffix-hot")
        unpin(halves, same, sizes, *([hot] if hot is not pieces else []))
        hot = rest
    return out


def repeats(texts: DataFrame) -> DataFrame:
    """(tid, runs): the runs of windows [first, last] that repeat, of every text (tid, z) that has any; texts differ."""
    every = pin(texts.select("tid", "z").mapInArrow(_all_anchors, "gram bigint, span bigint, tid bigint, first int, more smallint, back smallint"), "suffix-anchors")
    # counts are written before they are joined: the parts of a skewed join are split only where both sides come from a shuffle
    twice = pin(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-twice")
    found = pin(every.join(twice, "gram"), "suffix-found")
    unpin(every, twice)
    kinds = pin(found.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("tid", "first", "more", "back")).alias("at")), "suffix-kinds")
    several = pin(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-several")
    at = F.struct("gram", "span", "kinds", F.col("at.first").alias("first"), F.col("at.more").alias("more"), F.col("at.back").alias("back"))
    want = kinds.join(several, "gram").groupBy("at.tid").agg(F.collect_list(at).alias("want"))
    spans = pin(
        texts.select("tid", "z").join(want, "tid").select("z", "want").mapInArrow(_cut_spans, "gram bigint, span bigint, back smallint, kinds bigint, data binary"), "suffix-cut"
    )
    runs = pin(_by_arrays(spans.where(F.col("kinds") <= HOT)), "suffix-runs")
    parts = [runs, *_split(spans)]
    partly = parts[0]
    for more in parts[1:]:
        partly = partly.unionByName(more)
    whole = kinds.where("n > 1").select("gram", "span", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    result = whole.unionByName(partly.join(kinds.where("n > 1"), ["gram", "span"], "left_anti"))
    out = pin(
        found.join(result, ["gram", "span"])
        .select("tid", F.struct((F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.coalesce("high", F.col("more").cast("int"))).alias("last")).alias("run"))
        .groupBy("tid")
        .agg(F.sort_array(F.collect_list("run")).alias("runs")),
        "suffix-repeats",
    )
    unpin(found, kinds, several, spans, *parts)
    return out


def _kept(text: bytes, runs: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs [start, stop)."""
    cut: list[list[int]] = []
    for r in runs or ():
        start, stop = r["first"], r["last"] + LENGTH
        if cut and start <= cut[-1][1]:
            cut[-1][1] = max(cut[-1][1], stop)
        else:
            cut.append([start, stop])
    edges = [0, *(x for c in cut for x in c), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [(a, b) for a, b in cut]


def _cut(with_text: bool):
    """text_key, n_bytes, the removed runs, the bytes that are left where they are wanted, and their sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            size, removed, left, sha = [], [], [], []
            for z, runs, copies in zip(batch.column("z").to_pylist(), batch.column("runs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                text = _unzipped(z)
                if copies > 1 and len(text) >= LENGTH:
                    runs = [{"first": 0, "last": len(text) - LENGTH}]
                kept, gone = _kept(text, runs)
                size.append(len(text))
                removed.append([{"start": a, "stop": b} for a, b in gone])
                left.append(kept if with_text else None)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"),
                    pa.array(size, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(left, pa.binary()),
                    pa.array(sha, pa.string()),
                ],
                names=["text_key", "n_bytes", "removed", "kept", "kept_sha256"],
            )

    return run


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, the removed runs of bytes, the bytes that are left and their sha256, one row a document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = pin(docs.mapInArrow(_packed, f"doc_id {kind}, text_key binary, z binary"), "suffix-packed")
    once = packed.groupBy("text_key").agg(F.min("z").alias("z"), F.count("*").alias("copies"))
    texts = pin(once.withColumn("tid", F.monotonically_increasing_id()), "suffix-texts")
    ids = pin(packed.select("doc_id", "text_key"), "suffix-ids")
    unpin(packed)
    runs = repeats(texts)
    of = texts.join(runs, "tid", "left").select("text_key", "z", "copies", "runs")
    kinds = "text_key binary, n_bytes bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary, kept_sha256 string"
    done = pin(of.mapInArrow(_cut(with_text), kinds), "suffix-done")
    unpin(texts, runs)
    return ids.join(done, "text_key").drop("text_key")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs, with_text=False).select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )
