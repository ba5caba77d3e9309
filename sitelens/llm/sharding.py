"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on the ring.  A document's place is a hash of its id, and its home is the
shard of the next virtual node clockwise.  A shard takes no more than its bound: the number of documents
divided by the number of shards, rounded up for the first shards and down for the rest, so counts are at most
one apart.  Documents that a full shard can't take continue clockwise to the next virtual node of a shard with
room, and all others stay at home, which limits what moves when shards are added.

Only counts reach the driver: documents per arc between two virtual nodes, and per sorted partition.  From them
it plans which ranks of an arc go where.  The ranks come from one range-partitioned sort of ids and sizes; the
texts are not shuffled.  A hash of the row's own place splits ids that many rows share over partitions.

Defined cases: a null text has size 1 and the crc32 of an empty text; a null id hashes as an empty text; rows
with the same id are placed one by one, as the bound asks; fewer documents than shards leave shards empty; an
empty table gives an empty result; input columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, renamed, restored

N_SHARDS, VNODES = 8, 64
#: Places on the ring at which a virtual node may stand.
RING = 1 << 13


def place(key: Column) -> Column:
    """The place of a key: the first 52 bits of the md5 of its text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; a shard's places don't depend on the other shards."""
    nodes = [
        (int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:13], 16) >> 39, s)
        for s in range(n_shards)
        for v in range(vnodes)
    ]
    return sorted(nodes)


def plan(counts: list[int], nodes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): what of each arc goes to which shard."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    pieces = []
    left = []
    for arc, n in enumerate(counts):  # first every document that its home can take
        s = nodes[arc][1]
        took = min(n, room[s] - used[s])
        if took:
            pieces.append((arc, 0, took, s, used[s]))
            used[s] += took
        if took < n:
            left.append([arc, took, n, arc + 1])
    while left:  # then the rest, one virtual node further clockwise in each round
        still = []
        for arc, start, n, node in left:
            s = nodes[node % len(nodes)][1]
            took = min(n - start, room[s] - used[s])
            if took:
                pieces.append((arc, start, start + took, s, used[s]))
                used[s] += took
            if start + took < n:
                still.append([arc, start + took, n, node + 1])
        left = still
    return pieces


def assign(docs: DataFrame, n_shards: int = N_SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row a document: its id, size, text_crc32, shard, slot (gapless from 0 in each shard), and the row_col asked for."""
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes)
    places = [p for p, _ in nodes]
    arcs = ",".join(str(bisect_left(places, at) % len(nodes)) for at in range(RING))
    arc_at = F.split(F.lit(arcs), ",").cast("array<int>")
    raw = F.coalesce(F.encode(F.col(f"`{text_col}`"), "utf-8"), F.lit(b""))
    rows = (
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.length(raw).cast("bigint") + 1).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            place(F.col(f"`{id_col}`")).alias("h"),
            *([F.col(row_col)] if row_col else []),
        )
        # an arc that wraps round the ring takes the places after the last virtual node first, by rank of h
        .withColumn("arc", F.element_at(arc_at, F.shiftright("h", 39).cast("int") + 1))
        .withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    )
    ordered = rows.repartitionByRange("arc", "h", "spread").sortWithinPartitions("arc", "h", "text_crc32", "spread")
    ordered = pin(ordered.drop("h", "spread").withColumn("at", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("at", 33)
    n_of = {(r.part, r.arc): r.n for r in ordered.groupBy(part.alias("part"), "arc").agg(F.count("*").alias("n")).collect()}
    counts = [0] * len(nodes)
    first, before = [], 0  # of each partition's share of an arc: the rank of its first row, and its first row
    at = None
    for (p, arc), n in sorted(n_of.items()):
        if p != at:
            at, before = p, 0
        first.append((p, arc, counts[arc] - before))
        counts[arc] += n
        before += n
    pieces = plan(counts, nodes, n_shards)
    offsets = spark.createDataFrame(first, "part bigint, arc int, shift bigint")
    pieces_df = spark.createDataFrame(pieces, "arc int, lo bigint, hi bigint, shard int, slot0 bigint")
    rank = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("shift")
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(offsets), ["part", "arc"])
        .withColumn("rank", rank)
        .join(F.broadcast(pieces_df), "arc")  # a piece for each shard that an arc was dealt to, one as a rule
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), *([row_col] if row_col else []))
    )


def report(docs: DataFrame, n_shards: int = N_SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the law is `rows`."""
    return assign(docs, n_shards, vnodes).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def place_documents(docs: DataFrame, n_shards: int = N_SHARDS, vnodes: int = VNODES) -> DataFrame:
    """docs with shard and slot; rows are told apart by a number of their own, so repeated and null ids are no matter."""
    safe, new = renamed(docs)
    numbered = pin(safe.withColumn("row", F.monotonically_increasing_id()), "shards-input")
    shards = assign(numbered, n_shards, vnodes, new["doc_id"], new["text"], "row").select("row", "shard", "slot")
    kept = {c: n for c, n in new.items() if c.lower() not in ("shard", "slot")}
    return restored(numbered.join(shards, "row"), kept, ["shard", "slot"])


def write(docs: DataFrame, path: str, n_shards: int = N_SHARDS, vnodes: int = VNODES) -> None:
    """The documents as Parquet, a folder a shard."""
    placed = place_documents(docs, n_shards, vnodes)
    placed.repartition("shard", F.col("slot") % 64).write.partitionBy("shard").parquet(path)
