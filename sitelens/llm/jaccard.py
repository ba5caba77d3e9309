"""N-gram Jaccard join by multiple-global-order filtering, and the components of its links.

A text's set is its distinct ``WORDS``-word shingles, as 64-bit hashes.  Two sets with 100 * intersection >=
PERCENT * union share a token among the first n - ceil(PERCENT * n / 100) + 1 of each, under any global order of
the tokens.  Candidates share a prefix token under a rarity order, pass its length and position filters, must share
a prefix token under each of the ORDERS hashed orders as well (by 32 bits of it, which only lets more through), and
are verified on the whole sets.

The rarity order.  All tokens are counted by their first PLACE_BITS bits, dealt by ranges of them.  The LISTED most
frequent are known to every task with their counts and come last, by count; the others come first, by their hash.
Any order is right, and this one is nearly that of exact counts: only tokens that are rarer than the least listed
one stand as equals.

Only components are wanted, so pairs inside a component are never made.  Texts with equal sets are one class.
A round of stars verifies, for every prefix token, the classes against one of them: a linear number of pairs.  The
first round takes the class with the fewest rarer tokens, which in a group of edited copies is the one that the
others were made from; later ones take a member of the token's largest component for those outside it.  The last
round makes the remaining candidates: of the classes that share a prefix token, those outside the token's largest
component meet the others, members of the own component excepted.  No candidate is capped or dropped.

Components are found by alternating large and small stars over pinned edge tables; neither links nor
components reach the driver.

Defined cases: a null, empty or wordless text has no shingles, links with nothing and is its own component;
fewer than WORDS words are one shingle; a very long text is split into words piece by piece and its set, eight
bytes a shingle, is held in one task; rows that repeat an id are rows of their own, and their component is
the least id reached from the row; null ids are never the least, and a component of null ids alone is null;
ties between rows go to the least row; other columns, whatever their names, are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pin, unpin

WORDS, PERCENT = 5, 80
#: Hashed orders beside the rarity order, at most two; rounds of stars before the last join.
ORDERS, STAR_ROUNDS = 2, 2
#: Tokens are counted by so many of their bits; so many of the most frequent are listed; so many are gathered before they are sorted.
PLACE_BITS, LISTED, GATHERED = 40, 1 << 20, 1 << 22
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


# --- sets ------------------------------------------------------------------------------------------------------

_SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A random number for every byte at 64 places of a word, the same for A-Z and a-z.
_AT = _mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _ODD[0]).reshape(64, 256)
_AT[:, 0x41:0x5B] = _AT[:, 0x61:0x7B]
_AT = _AT.reshape(-1)


def _words(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a line's words, and where they start."""
    at = np.flatnonzero(~_SEPARATOR[line])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    sizes = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, sizes)
    value = _AT[((place & 63) << 8) | line[at]]
    if sizes.max() > 64:
        far = np.flatnonzero(place > 63)
        value[far] = _mix(value[far] + (place[far] >> 6).astype(np.uint64) * _ODD[2])
    return _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * _ODD[1]), at[first]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text, cut at separators."""
    line, start = np.frombuffer(text, np.uint8), 0
    while start < len(text):
        stop = start + CHUNK
        while stop < len(text):
            cut = np.flatnonzero(_SEPARATOR[line[stop : stop + CHUNK]])
            if len(cut):
                stop += int(cut[0])
                break
            stop += CHUNK
        yield text[start:stop]
        start = stop


def _set(w: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's words; grams: those of WORDS words."""
    if not len(w):
        return w
    if len(w) < WORDS:
        h = np.array([len(w)], np.uint64) * _ODD[2]
        for k in range(len(w)):
            h = _mix(h + w[k : k + 1] * _ODD[k])
        return h
    s = np.sort(grams)
    return s[np.r_[True, s[1:] != s[:-1]]]


def _grams(w: np.ndarray) -> np.ndarray:
    n = max(0, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = _mix(h + w[k : n + k] * _ODD[k])
    return h


def sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of every text's shingles."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or b"") <= CHUNK):
            size += len(texts[stop] or b"")
            stop += 1
        if size > CHUNK:
            w = np.concatenate([_words(np.frombuffer(p, np.uint8))[0] for p in _pieces(texts[at])])
            yield _set(w, _grams(w))
        else:
            part = [t or b"" for t in texts[at:stop]]
            w, starts = _words(np.frombuffer(b" ".join(part), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in part])
            ends = np.searchsorted(starts, ends)
            grams, start = _grams(w), 0
            for end in ends.tolist():
                yield _set(w[start:end], grams[start : max(start, end - WORDS + 1)])
                start = end
        at = stop


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, n, key, and the compressed text z where the task has not seen the key before."""
    z = zstandard.ZstdCompressor(level=1)
    seen: set[bytes] = set()
    for batch in batches:
        n, keys, packed, texts = [], [], [], as_bytes(batch.column("text"))
        for rid, text, s in zip(batch.column("rid").to_pylist(), texts, sets(texts), strict=True):
            key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else rid.to_bytes(8, "big")
            n.append(len(s))
            keys.append(key)
            packed.append(z.compress(text) if len(s) and key not in seen else None)
            seen.add(key)
        if len(seen) > 1 << 20:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
            names=["rid", "doc_id", "n", "key", "z"],
        )


def _texts(column: pa.Array) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(data, max_output_size=1 << 31) for data in column.to_pylist()]


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column of compressed texts, few texts at a time."""
    for at in range(0, len(column), 256):
        yield from sets(_texts(column.slice(at, 256)))


# --- the rarity order ------------------------------------------------------------------------------------------


def _places(s: np.ndarray) -> np.ndarray:
    return s >> np.uint64(64 - PLACE_BITS)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places and their counts; the bytes of the steps between places stand by significance, which compresses."""
    z = zstandard.ZstdCompressor(level=1)
    steps = np.diff(places, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return z.compress(np.ascontiguousarray(steps).tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    """place << 24 | count."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    n = len(raw) // 12
    places = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel())
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return (places.astype(np.uint64) << np.uint64(24)) | counts.astype(np.uint64)


def _range_counts(bits: int):
    """(part, data): the places of a task's tokens and their counts, by 2^bits ranges of places."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        places, counts = np.unique(np.concatenate(held), return_counts=True)
        part = places >> np.uint64(PLACE_BITS - bits)
        edges = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=np.uint64))
        full = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
        data = [_packed(places[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]) for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in _sets(batch.column("z")):
                held.append(_places(s))
                size += len(s)
                if size >= GATHERED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n) of the places that occur more than twice."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault(part, []).append(_unpacked(data))
    for part in sorted(held):
        both = np.sort(np.concatenate(held.pop(part)))
        places = both >> np.uint64(24)
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        n = np.add.reduceat((both & np.uint64((1 << 24) - 1)).astype(np.int64), first)
        some = n > 2
        yield pa.RecordBatch.from_arrays([pa.array(places[first][some].astype(np.int64)), pa.array(n[some])], names=["place", "n"])


def _frequent(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted places of the most frequent tokens, LISTED at most, and their counts."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = parts.bit_length() + 1  # some ranges for every task, so that tasks are even
    dealt = reps.select("z").mapInArrow(_range_counts(bits), "part int, data binary").repartition(parts, "part")
    counts = pin(dealt.mapInArrow(_sums, "place bigint, n bigint"), "jaccard-counts")
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("bigint"))
    least, total = 1 << 62, 0
    for low, many in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += many
        if total > LISTED:
            break
        least = low
    listed = counts.where(F.col("n") >= least).toArrow()
    unpin(counts)
    places, n = listed["place"].to_numpy().astype(np.uint64), listed["n"].to_numpy()
    order = np.argsort(places)
    return places[order], n[order]


def _prefixes(held):
    """cid, n, rare (the prefix by rarity, in order), unlisted (how many of its tokens, the first, are not listed), and prefixes of two hashed orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts = held.value
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, len(b), 1024)):
            n, rare, unlisted, second, third = [], [], [], [], []
            for s in _sets(batch.column("z")):
                p = len(s) - -(-PERCENT * len(s) // 100) + 1
                known = np.zeros(len(s), bool)
                if len(places):
                    mine = _places(s)
                    at = np.minimum(np.searchsorted(places, mine), len(places) - 1)
                    known = places[at] == mine
                first = s[~known][:p]
                unlisted.append(len(first))
                if len(first) < p:
                    of = s[known]
                    first = np.concatenate([first, of[np.lexsort((of, counts[at[known]]))][: p - len(first)]])
                n.append(len(s))
                rare.append(first.view(np.int64))
                for k, out in ((1, second), (2, third)):
                    out.append(np.partition(_mix(s ^ _ODD[k]), p - 1)[:p].astype(np.uint32).view(np.int32) if k <= ORDERS else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array(n, pa.int64()), _lists(rare, pa.int64()), pa.array(unlisted, pa.int32()), _lists(second, pa.int32()), _lists(third, pa.int32())],
                names=["cid", "n", "rare", "unlisted", "second", "third"],
            )

    return run


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *arrays]), kind))


# --- verification and components -------------------------------------------------------------------------------


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        za, keep = batch.column("za"), []
        for i, right in enumerate(_sets(batch.column("zb"))):
            if a[i] != last:
                last, left = a[i], next(sets(_texts(za.slice(i, 1))))
            keep.append(linked(left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, prefixes: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the hashed orders too, and hold on the whole sets."""
    if ORDERS:
        orders = [c for c in ("second", "third")[:ORDERS]]
        for side in "ab":
            pairs = pairs.join(prefixes.select(F.col("cid").alias(side), *[F.col(c).alias(c + side) for c in orders]), side)
        for c in orders:
            pairs = pairs.where(F.arrays_overlap(c + "a", c + "b"))
        pairs = pairs.select("a", "b")
    both = (
        pairs.join(reps.select(F.col("cid").alias("b"), F.col("z").alias("zb")), "b")
        .join(reps.select(F.col("cid").alias("a"), F.col("z").alias("za")), "a")
        .select("a", "b", "za", "zb")
    )
    return pin(both.mapInArrow(_verified, "a bigint, b bigint"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp), pinned: the least node reached from every node of the edges (a, b)."""
    edges = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    before = None
    while True:
        # large stars: larger neighbours go to the least neighbour
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        up = edges.join(least.withColumnsRenamed({"u": "v"}), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        up = up.where("u > v").distinct()
        # small stars: a node and its smaller neighbours go to the least of these
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = pin(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        unpin(edges)
        edges = after
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
        before = state


def _fits() -> F.Column:
    """The length filter, and the position filter where the shared token is the first of both."""
    most = F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib"))
    return 100 * most >= PERCENT * (F.col("n") + F.col("nb") - most)


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with the component found so far."""
    if labels is None:
        return postings.withColumn("comp", F.col("cid"))
    return postings.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _in_many(postings: DataFrame, spare: list[DataFrame]) -> DataFrame:
    """The postings of tokens that several components share, with the token's largest component as top.

    What is counted is written before it is joined, and noted in spare: the parts of a skewed join are split only where both sides come from a shuffle.
    """
    sizes = postings.groupBy("token", "comp").agg(F.count("*").alias("k"))
    shared = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    spare.append(pin(shared.select("token", "top"), "jaccard-top"))
    return postings.join(spare[-1], "token")


def _postings(prefixes: DataFrame) -> DataFrame:
    """(token, cid, n, i), pinned: the rarity prefixes of all classes, without the tokens of one class alone.

    Listed tokens occur in several texts, so only the others, none of which has many rows, are dealt by token and counted.
    """
    every = prefixes.select("cid", "n", "unlisted", F.posexplode("rare").alias("i", "token"))
    few = every.where("i < unlisted").select("token", "cid", (F.shiftleft("n", 32) + F.col("i")).alias("at")).repartition("token")
    again = few.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    few = few.join(again.hint("shuffle_merge"), "token", "left_semi").select("token", "cid", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("i"))
    many = every.where("i >= unlisted").select("token", "cid", "n", F.col("i").cast("bigint").alias("i"))
    return pin(few.unionByName(many), "jaccard-postings")


def _star_pairs(postings: DataFrame, labels: DataFrame | None, k: int, spare: list[DataFrame]) -> DataFrame:
    """(a, b): for every token, one class and the others of its component or outside it."""
    of = _labelled(postings, labels)
    centre = F.struct("i", F.xxhash64("cid", F.lit(k)).alias("h"), F.col("cid").alias("a"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("ca"))
    if labels is not None:
        of = _in_many(of, spare)
    inside = of if labels is None else of.where("comp = top")
    spare.append(pin(inside.groupBy("token").agg(F.min(centre).alias("c")).select("token", "c.a", "c.nb", "c.ib", "c.ca"), "jaccard-centres"))
    return of.join(spare[-1], "token").where("comp <> ca").where(_fits()).select("a", F.col("cid").alias("b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (rid, doc_id, n, key), pinned, and (key, comp) of every class of equal sets, pinned."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = pin(rows.mapInArrow(_rows, f"rid bigint, doc_id {kind}, n bigint, key binary, z binary"), "jaccard-packed")
    reps = pin(packed.where("z IS NOT NULL").groupBy("key").agg(F.min(F.struct("rid", "z")).alias("r")).select("key", F.col("r.rid").alias("cid"), "r.z"), "jaccard-reps")
    rows = pin(packed.select("rid", "doc_id", "n", "key"), "jaccard-rows")
    unpin(packed)

    held = docs.sparkSession.sparkContext.broadcast(_frequent(reps))
    kinds = "cid bigint, n bigint, rare array<bigint>, unlisted int, second array<int>, third array<int>"
    prefixes = pin(reps.select("cid", "z").mapInArrow(_prefixes(held), kinds), "jaccard-prefixes")
    postings = _postings(prefixes)
    orders = prefixes.select("cid", "second", "third")

    links, labels, spare = [], None, []
    for k in range(STAR_ROUNDS):
        links.append(_verify(_star_pairs(postings, labels, k, spare), orders, reps))
        found = _components(links)
        if labels is not None:
            unpin(labels)
        labels = found

    of = _in_many(_labelled(postings, labels), spare)
    others = of.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    pairs = of.where("comp <> top").join(others, "token").where("comp <> cb AND (cb = top OR cid < b)").where(_fits())
    links.append(_verify(pairs.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct(), orders, reps))
    final = _components(links)
    classes = pin(reps.select("key", "cid").join(final, "cid", "left").select("key", F.coalesce("comp", "cid").alias("comp")), "jaccard-classes")
    unpin(reps, prefixes, postings, final, *spare, *links, *([labels] if labels is not None else []))
    held.destroy()
    return rows, classes


def _components(links: list[DataFrame]) -> DataFrame:
    """(cid, comp), pinned, of the classes that any of the links touch."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return components(edges)


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, n, comp and the least (is null, id, rid) of the component."""
    rows, classes = join(docs, id_col, text_col)
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))
    # a class without words is one row, known by its own key
    of = rows.groupBy("key").agg(F.min(least).alias("least"), F.min("rid").alias("row")).join(classes, "key", "left").withColumn("comp", F.coalesce("comp", "row"))
    roots = of.groupBy("comp").agg(F.min("least").alias("root"))
    by_key = of.select("key", "comp").join(roots, "comp").select("key", "root")
    return rows.select("rid", "doc_id", "n", "key").join(by_key, "key")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    members = _members(docs, "doc_id", "text")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("root.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, that of the least id; columns unchanged."""
    names = docs.columns
    taken = {c.lower() for c in names}
    rid = next(f"rid{k}" for k in range(len(taken) + 1) if f"rid{k}" not in taken)
    numbered = pin(docs.withColumn(rid, F.monotonically_increasing_id()), "jaccard-input")
    # the row number stands in the id, so that the rows chosen are known by it
    ids = numbered.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(rid).alias("row")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = _members(ids, "id", "text").where(F.col("doc_id.row") == F.col("root.id.row")).select(F.col("doc_id.row").alias(rid))
    return numbered.join(chosen, rid, "left_semi").select(*[F.col(f"`{c}`") for c in names])
