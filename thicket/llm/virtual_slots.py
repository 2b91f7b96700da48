"""Sharding by fixed virtual slots.

Records are hashed by id into thousands of slots; bytes are summed by slot. A map from slot to shard is stored in versions, each of
them written once. The first one deals slots out by number; rebalancing edits it: slots move, or change places, between the fullest and
the emptiest shard until that makes them no more equal; where shards are added, slots move into these alone. Rows lie where
the stored map's latest version puts them. The law is ``bytes``: shards have nearly equal sizes, as a slot is far smaller than
a shard. Texts are read once and never shuffled.

Defined results: a null text has size 1 (no bytes, plus one) and the CRC of an empty text; equal texts may lie
in different shards; rows with the same id share a slot and get distinct places; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.store import shared_folder, written

N_SLOTS = 8192


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, virtual slot, size and CRC of each row."""
    return docs.select(
        "doc_id",
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n_slots)).cast("int").alias("vslot"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows), at most one per virtual slot."""
    return [tuple(r) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()]


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """slot -> shard, by the slot's number."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced_map(old: list[int], sums: list[tuple[int, int, int]], n_shards: int) -> list[int]:
    """The map edited until moving a slot, or exchanging two, between the fullest and the emptiest shard makes these no more equal."""
    size = np.zeros(len(old), np.int64)
    for s, b, _ in sums:
        size[s] = b
    out = np.array(old)
    total = np.bincount(out, size, n_shards).astype(np.int64)
    while True:
        giver, taker = int(np.argmax(total)), int(np.argmin(total))
        gap = int(total[giver] - total[taker])
        if gap < 2:
            break
        mine, others = np.flatnonzero(out == giver), np.flatnonzero(out == taker)
        others = np.append(-1, others[np.argsort(size[others], kind="stable")])  # -1: nothing comes back
        theirs = np.append(0, size[others[1:]])
        at = np.searchsorted(theirs, size[mine] - gap / 2)
        best = None
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(theirs) - 1)):
            moved = size[mine] - theirs[k]
            off = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
            i = int(np.argmin(off))
            if off[i] < gap and (best is None or off[i] < best[0]):
                best = int(off[i]), mine[i], others[k[i]]
        if best is None:
            break
        _, a, b = best
        out[a] = taker
        if b >= 0:
            out[b] = giver
        total = np.bincount(out, size, n_shards).astype(np.int64)
    return out.tolist()


def grown_map(old: list[int], sums: list[tuple[int, int, int]], n_shards: int) -> list[int]:
    """The map edited for more shards: slots move only into new shards, from whichever shard is largest then."""
    size = dict.fromkeys(range(len(old)), 0) | {s: b for s, b, _ in sums}
    out, total = list(old), [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for s, k in enumerate(old):
        total[k] += size[s]
    for s in sorted(range(len(old)), key=lambda s: (size[s], s)):
        held[old[s]].append(s)
    aim, first_new = sum(total) / n_shards, max(old) + 1
    for k in range(first_new, n_shards):
        while True:
            giver = max(range(first_new), key=lambda j: total[j])
            at = bisect.bisect_right(held[giver], aim - total[k], key=lambda s: size[s]) - 1
            if at < 0 or not size[held[giver][at]]:
                break
            s = held[giver].pop(at)
            out[s] = k
            total[giver] -= size[s]
            total[k] += size[s]
    return out


def save_map(spark: SparkSession, name: str, version: int, slot_to_shard: list[int]) -> None:
    """Store a version of the map of that name in the shared folder; a version that is there already is an error."""
    df = spark.createDataFrame([(version, s, k) for s, k in enumerate(slot_to_shard)], "version int, vslot int, shard int")
    df.coalesce(1).write.mode("errorifexists").parquet(f"{shared_folder(spark)}/slot-maps-{name}/v{version}")


def load_map(spark: SparkSession, name: str, version: int | None = None) -> tuple[int, list[int]]:
    """The version asked for, or the latest: (version, slot -> shard). A map has one row per virtual slot."""
    df = spark.read.parquet(f"{shared_folder(spark)}/slot-maps-{name}/*")
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    return version, [r.shard for r in sorted(df.where(F.col("version") == version).collect(), key=lambda r: r.vslot)]


def placed(rows: DataFrame, sums: list[tuple[int, int, int]], slot_to_shard: list[int]) -> DataFrame:
    """Rows with their shard and their place in it: places of a virtual slot follow those of the shard's earlier slots."""
    n, start, at = {s: c for s, _, c in sums}, [0] * len(slot_to_shard), {}
    for s, k in enumerate(slot_to_shard):
        start[s] = at.get(k, 0)
        at[k] = start[s] + n.get(s, 0)
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, k, start[s]) for s, k in enumerate(slot_to_shard)], "vslot int, shard int, start long"))  # one row per virtual slot
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(table, "vslot").withColumn("slot", F.col("start") + place - 1)


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, name: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot of every row; the map's versions 1 and 2 are stored under ``name``, or a new one."""
    spark, name = docs.sparkSession, name or uuid.uuid4().hex
    rows = written(sized(docs, n_slots), "slot-rows")
    sums = slot_sums(rows)
    save_map(spark, name, 1, first_map(n_shards, n_slots))
    save_map(spark, name, 2, rebalanced_map(load_map(spark, name, 1)[1], sums, n_shards))
    return placed(rows, sums, load_map(spark, name)[1]).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot")
