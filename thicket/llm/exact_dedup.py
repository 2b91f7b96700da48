"""Exact deduplication against a minimal perfect hash over the distinct digests of earlier loads.

An index holds the distinct digests of all rows loaded so far in shards of about a thousand. In a shard a
minimal perfect hash (hash and displace: one seed for each bucket of about four digests) gives each digest a slot
of its own; the slot holds the full digest and the locator of the row that stays. A new load is first reduced
to its distinct digests; each is looked up by computing its slot and comparing all bytes of the digest there.
Members are repeats of earlier rows, nonmembers are grouped separately by digest. Texts are hashed where they
are read and never shuffled.

Texts are equal when identical after deleting white space (0x20, 0x09-0x0D). The row with the most code points
in its original text stays, then the smallest doc_id. Defined results: a null text counts as empty; empty
texts are equal to each other; of rows repeated with the same id all count in the group's size and all are
kept if their id is (:func:`kept_documents` leaves one row); a null id comes before others; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import join_back
from thicket.llm.store import dropped, written

SHARD = 1024  #: distinct digests in a shard of the index, about
BUCKET = 4  #: digests that share a seed, about


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), digest (SHA-256 of the text without white space), its 64-bit hash and the text's code points."""
    text = F.coalesce("text", F.lit(""))
    hexed = F.sha2(F.encode(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), "UTF-8"), 256)
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.unhex(hexed).alias("digest"), F.char_length(text).cast("long").alias("points"))
    return rows.withColumn("h", F.xxhash64("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """The distinct digests of rows, with the row that stays of each; combined before the shuffle."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th")))
    return rows.groupBy("digest", "h").agg(best.alias("best"), F.count("*").alias("n"))


def _hash_int(seeds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a 32-bit integer with h as the seed."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = h + p5 + np.uint64(4)
    x = x ^ (seeds.astype(np.uint64) * p1)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * p2 + p3
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return x ^ (x >> np.uint64(32))


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot of each h) for distinct signed 64-bit h; slots are 0 to len(h) - 1."""
    m = len(h)
    n_buckets = max(1, -(-m // BUCKET))
    bucket = (h >> 20) % n_buckets
    seeds, slot, free = np.zeros(n_buckets, np.int32), np.full(m, -1, np.int64), np.ones(m, bool)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    unsigned = h.astype(np.uint64)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        own = order[starts[b] : starts[b + 1]]
        if not len(own):
            break
        seed, step = 0, 256
        while True:
            tried = np.arange(seed, seed + step, dtype=np.uint64)
            x = _hash_int(tried[:, None], unsigned[own][None, :]).astype(np.int64) % m  # pmod of the signed value
            good = free[x].all(axis=1)
            if len(own) > 1:
                s = np.sort(x, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slot[own], free[x[k]] = seed + k, x[k], False
                break
            seed, step = seed + step, min(4096, step * 2)
    return seeds, slot


def _bucket(m: Column) -> Column:
    return F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.ceil(m / BUCKET))).cast("int")


def build_index(groups: DataFrame, n_groups: int | None = None) -> DataFrame:
    """The index of distinct digests: a row for each shard, with seeds by bucket and slots."""
    n_groups = groups.count() if n_groups is None else n_groups
    n_shards = max(1, -(-n_groups // SHARD))
    kind = groups.select("best.keep_id").dtypes[0][1]
    entry = f"array<struct<digest binary, less long, keep_id {kind}, keep_th long, n long>>"
    schema = f"shard int, n_shards int, m int, seeds array<int>, slots {entry}, beside {entry}"

    def entries(rows: pd.DataFrame) -> list[dict]:
        columns = (rows[c] for c in ("digest", "less", "keep_id", "keep_th", "n"))
        return [{"digest": bytes(d), "less": a, "keep_id": k, "keep_th": t, "n": n} for d, a, k, t, n in zip(*columns)]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        again = pdf.duplicated("h")  # of digests with one 64-bit hash the first has a slot, the others lie beside the slots
        seeds, slot = perfect_hash(pdf.loc[~again, "h"].to_numpy())
        rows = pdf[~again].assign(slot=slot).sort_values("slot")
        return pd.DataFrame({"shard": [key[0]], "n_shards": [n_shards], "m": [len(rows)], "seeds": [seeds], "slots": [entries(rows)], "beside": [entries(pdf[again])]})

    flat = groups.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "digest", "h", "best.less", "best.keep_id", "best.keep_th", "n")
    return flat.groupBy("shard").applyInPandas(build, schema)


def look_up(groups: DataFrame, index: DataFrame) -> DataFrame:
    """groups with ``found``, the slot's content if its digest has the same bytes, else null.

    groups has each digest once, so that no shard gets more rows than others.
    """
    first = index.select("n_shards").first()
    n_shards = first[0] if first else 1
    keyed = groups.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
    joined = keyed.join(index.drop("n_shards"), "shard", "left")
    seed = F.get("seeds", _bucket(F.col("m")))
    slot = F.pmod(F.xxhash64("digest", seed), F.col("m")).cast("int")
    entry = F.get("slots", slot)
    beside = F.when(F.size("beside") > 0, F.get(F.filter("beside", lambda x: x["digest"] == F.col("digest")), F.lit(0)))
    return joined.select(*groups.columns, F.when(entry["digest"] == F.col("digest"), entry).otherwise(beside).alias("found"))


def merged(new: DataFrame, index: DataFrame) -> DataFrame:
    """All groups of the index and of a new load's groups: digest, best, n."""
    hits = written(look_up(new, index), "lookups")
    old = index.select(F.explode(F.concat("slots", "beside")).alias("s")).select("s.digest", F.struct("s.less", "s.keep_id", "s.keep_th").alias("best"), "s.n")
    both = hits.where("found is not null").select("digest", F.least("best", F.struct(F.col("found.less"), F.col("found.keep_id"), F.col("found.keep_th"))).alias("new_best"), F.col("n").alias("more"))
    members = old.join(both, "digest", "left").select("digest", F.coalesce("new_best", "best").alias("best"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return members.unionByName(hits.where("found is null").select("digest", "best", "n"))


def _grouped(docs: DataFrame, first_load: Column | None) -> tuple[DataFrame, DataFrame]:
    """(digests of the rows, groups of equal texts), by way of an index over the first load."""
    rows = digests(docs)
    old = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)) == 0 if first_load is None else first_load
    rows = written(rows.withColumn("old", F.coalesce(old, F.lit(False))), "digests")
    index = written(build_index(groups_of(rows.where("old"))), "digest-index")
    groups = written(merged(groups_of(rows.where("not old")), index), "digest-groups")
    dropped(index)
    return rows, groups


def exact_dedup(docs: DataFrame, first_load: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Rows for which ``first_load`` holds make the historical index, the others are a new load on it; by default
    half of the rows by the hash of their ids. The result doesn't depend on it.
    """
    rows, groups = _grouped(docs, first_load)
    back = join_back(rows.select("doc_id", "digest"), groups.select("digest", F.col("best.keep_id").alias("keep_id"), "n"), "digest")
    return back.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, first_load: Column | None = None) -> DataFrame:
    """The rows and columns of docs whose text no better row has: one of each group, also of rows repeated as a whole."""
    rows, groups = _grouped(docs, first_load)
    stays = groups.select(F.col("best.keep_id").alias("keep_id"), F.col("best.keep_th").alias("keep_th"))
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_th"))
    kept = keyed.join(stays, (F.col("row_th") == F.col("keep_th")) & F.col("whole.doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    if rows.groupBy("doc_id", "th").count().where("count > 1").take(1):  # the row itself occurs again
        own = F.struct(F.col("whole.doc_id").alias("doc_id"), F.col("row_th").alias("th"))
        kept = kept.withColumn("own_key", own).dropDuplicates(["own_key"])
    return kept.select("whole.*")


def append_load(new_docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the new load that aren't repeats of the index or of each other, the index with this load)."""
    rows = written(digests(new_docs), "digests")
    new = groups_of(rows)
    fresh = written(look_up(new, index).where("found is null").drop("found"), "fresh")
    groups = written(merged(new, index), "digest-groups").withColumn("h", F.xxhash64("digest"))
    stays = fresh.select(F.col("digest").alias("d"), F.col("best.keep_id").alias("keep_id"), F.col("best.keep_th").alias("keep_th"))
    same = (F.col("digest") == F.col("d")) & (F.col("th") == F.col("keep_th")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(stays, same, "left_semi"), written(build_index(groups), "digest-index")


def sql(table: str = "documents") -> str:
    """exact_dedup as DuckDB SQL."""
    return f"""
    with d as (
      select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256 from {table}
    )
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
      doc_id = first_value(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256 order by points desc, doc_id)"""
