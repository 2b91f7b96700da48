"""Connected groups under links confirmed on whole contents, among the nodes that share buckets.

Members name for each node of a bucket a leader, another node of it, against which it is confirmed first. Buckets whose nodes then lie
in several groups go on in rounds: a round confirms a few nodes of each bucket (from its smallest groups, more in each
round) against the rest, unless that pair was tried or is tied already; then these leave the bucket. In the end every
pair that shares a bucket was confirmed, or refuted, or is connected: no link is lost, nothing is capped, and no bucket is
gathered in one place. Contents meet by key; of a node that many others are confirmed against, copies are spread.

Where contents have short sketches that can refute a link for certain, no leaders are needed: blocks of a bucket's sketches meet, all pairs
of them, and only the pairs not refuted there are confirmed on contents, a few of each node first, so that a linked group isn't written
as all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.components import components, join_back
from thicket.llm.store import dropped, tidied, written

#: For lists of contents whether each pair of them is linked.
Linked = Callable[[list[bytes], list[bytes]], np.ndarray]
#: For two lists of sketches whether they refute a link, a row for each of the first, a column for each of the second.
Refuted = Callable[[list[bytes], list[bytes]], np.ndarray]
#: From node, content to node, sketch.
Sketched = Callable[[DataFrame], DataFrame]
#: Told how many nodes, ties and links there are, for those who want to watch; counts are made only for them.
Say = Callable[[str], None]
LEADERS = 32  #: of a bucket, in the first round
BROADCAST_LEADERS = 512  #: of at most 1000 hot buckets, 40 bytes each
CHUNK = 2000  #: ties that meet one copy of a content, about
PAIR_BYTES = 16 << 20
BLOCK_BYTES = 1 << 19  #: of sketches that meet another block of their bucket, about
LOT_BYTES = 4 << 20  #: of small buckets that one call takes together, about
PAIRS = 1 << 21  #: of nodes of two blocks that are looked at together; small sketches make blocks of many nodes
MET_ROWS = 1 << 16  #: pairs given on in a batch


def _confirmed(ties: DataFrame, contents: DataFrame, linked: Linked) -> DataFrame:
    """The ties u, v whose contents are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("a").null_count or batch.column("b").null_count:
                raise ValueError("a node of a tie has no contents")
            step = max(1, int(batch.num_rows * PAIR_BYTES / max(PAIR_BYTES, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                hit = linked(part.column("a").to_pylist(), part.column("b").to_pylist())
                yield part.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    kind = contents.schema["node"].dataType.simpleString()
    one = ties.join(contents.select(F.col("node").alias("u"), F.col("content").alias("a")), "u", "left")
    other = contents.select(F.col("node").alias("v"), F.col("content").alias("b"))
    counts = ties.groupBy("v").agg(F.count("*").alias("n"))
    many = counts.where(F.col("n") > CHUNK)
    if many.take(1):  # their ties are spread over copies
        copies = many.select("v", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CHUNK))).alias("copy"), "n")
        split = join_back(ties, counts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.floor(F.col("n") / CHUNK) + 1).alias("copy"))
        one = split.join(contents.select(F.col("node").alias("u"), F.col("content").alias("a")), "u", "left")
        other = other.join(copies.drop("n"), "v", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))
        two = one.join(other, ["v", "copy"], "left")
    else:
        two = one.join(other, "v", "left")
    return two.select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def _labelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """df with the group of ``node``: its label, or itself."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return df.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels with more links u, v: only the groups that these tie are worked on again."""
    ends = _labelled(_labelled(found, labels, "u", "a"), labels, "v", "b")
    ties = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("label"), "component")
    nodes = found.select(F.col("u").alias("node")).unionAll(found.select(F.col("v").alias("node"))).distinct()
    new = nodes.join(labels.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    return written(labels.unionByName(new).join(ties, "label", "left").select("node", F.coalesce("component", "label").alias("label")), "labels")


def _open(left: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets that have nodes of several groups, and n, how many nodes the bucket has."""
    named = _labelled(left, labels, "node", "component").distinct()
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    several = sizes.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("size").alias("n")).where("groups > 1")
    return written(join_back(named, several.select("bucket", "n"), "bucket"), "bucket-members")


def _met(open_: DataFrame, sketches: DataFrame, refuted: Refuted, most: int, block_bytes: int) -> DataFrame:
    """bucket, u, v of the pairs of open buckets that lie in different groups and that sketches don't refute.

    Of a node with more than ``most`` of them in a block only the first ones are given, and these have ``more``.
    """

    def given(nodes: pa.Array, have: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        bucket, x, y, more = (np.concatenate(c) for c in zip(*have))
        for k in range(0, len(x), MET_ROWS):
            a, b = (nodes.take(pa.array(t[k : k + MET_ROWS])) for t in (x, y))
            columns = [pa.array(bucket[k : k + MET_ROWS]), pc.max_element_wise(a, b), pc.min_element_wise(a, b), pa.array(more[k : k + MET_ROWS])]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "u", "v", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bucket, i, j, block = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "block"))
        component = pc.dictionary_encode(table.column("component").combine_chunks()).indices.to_numpy()
        nodes, own = table.column("node").combine_chunks(), table.column("sketch").to_pylist()
        order = np.lexsort((block, j, i, bucket))
        key = np.stack([bucket, i, j])[:, order]
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        have: list[tuple[np.ndarray, ...]] = []
        held = 0
        for part in np.split(order, np.flatnonzero(new)[1:]):
            same = i[part[0]] == j[part[0]]
            one, two = (part, part) if same else (part[block[part] == i[part]], part[block[part] == j[part]])
            theirs, step = [own[x] for x in two], max(1, PAIRS // max(1, len(two)))
            for k in range(0, len(one) if len(two) else 0, step):
                rows = one[k : k + step]
                hit = component[rows][:, None] != component[two][None, :]
                if same:
                    hit &= np.arange(len(two)) > np.arange(k, k + len(rows))[:, None]
                if not hit.any():
                    continue
                hit &= ~refuted([own[x] for x in rows], theirs)
                so_far = np.cumsum(hit, axis=1, dtype=np.int32)
                more = so_far[:, -1] > most
                x, y = np.nonzero(hit & (so_far <= most))
                have.append((np.full(len(x), bucket[part[0]]), rows[x], two[y], more[x]))
                held += len(x)
                if held >= MET_ROWS:
                    yield from given(nodes, have)
                    have, held = [], 0
        if held:
            yield from given(nodes, have)

    kind = open_.schema["node"].dataType.simpleString()
    rows = written(open_.drop("n").join(sketches.select("node", "sketch"), "node"), "bucket-sketches")
    size = F.count("*") * F.max(F.length("sketch"))
    buckets = written(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(size / block_bytes).cast("int").alias("blocks"), size.alias("bytes")), "bucket-sizes")
    lots = max(1, (buckets.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0) // LOT_BYTES)
    dealt = join_back(rows, buckets.drop("bytes"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(lots))).otherwise(F.xxhash64("bucket", "i", "j"))
    met = sent.select("bucket", "i", "j", "block", "node", "component", "sketch", lot.alias("lot")).groupBy("lot").applyInArrow(run, f"bucket long, u {kind}, v {kind}, more boolean")
    out = written(met, "met")
    dropped(rows, buckets)
    return out


def _linked_by_sketches(
    left: DataFrame, contents: DataFrame, linked: Linked, refuted: Refuted, sketched: Sketched | None, labels: DataFrame, tried: DataFrame, say: Say | None, most: int, block_bytes: int
) -> DataFrame:
    sketches = None if sketched else contents
    while True:
        open_ = _open(left, labels)
        if not open_.take(1):
            dropped(open_, *([sketches] if sketched and sketches else []))
            return labels
        if sketches is None:  # later rounds have no other nodes
            sketches = written(sketched(contents.join(open_.select("node").distinct(), "node", "left_semi")), "sketches")
        met = _met(open_, sketches, refuted, most, block_bytes)
        ties = written(met.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"), "ties")
        found = written(_confirmed(ties, contents, linked), "links")
        if say:
            say(f"most {most}, open {open_.count()}, met {met.count()}, ties {ties.count()}, links {found.count()}")
        tidied(found)
        if found.take(1):
            labels = _joined(labels, found)
        # Of other buckets every pair was tried, refuted or is connected.
        left = written(open_.select("bucket", "node").join(met.where("more").select("bucket").distinct(), "bucket", "left_semi"), "bucket-left")
        dropped(open_, met)
        tried = tried.unionByName(ties)
        most *= 16


def linked_groups(members: DataFrame, contents: DataFrame, linked: Linked, say: Say | None = None, refuted: Refuted | None = None, most: int = LEADERS, block_bytes: int = BLOCK_BYTES, sketched: Sketched | None = None) -> DataFrame:
    """node, label (the smallest node of its group) of the nodes that have links.

    members: bucket, node, leader (the bucket's rows of one leader needn't be all of them), more (whether the bucket has, or may have, other
    pairs than those of its leader); contents: node, content and, if there is ``refuted`` but not ``sketched``, sketch. ``sketched`` makes the
    sketches of those nodes only that are in open buckets.
    """
    tried = written(members.where("node <> leader").select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")).distinct(), "ties")
    links = written(_confirmed(tried, contents, linked), "links")
    tidied(links)
    labels = components(links).withColumnRenamed("component", "label")
    if say:
        say(f"ties {tried.count()}, links {links.count()}")
    left, n_leaders = members.where("more").select("bucket", "node"), LEADERS
    if refuted:
        return _linked_by_sketches(left, contents, linked, refuted, sketched, labels, tried, say, most, block_bytes)
    while True:
        open_ = _open(left, labels)  # only buckets with two groups or more go on
        if not open_.take(1):
            dropped(open_, tried)
            return labels
        sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        ranked = open_.join(sizes, ["bucket", "component"]).withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("size", "component", "node")))
        leaders = written(ranked.where(F.col("k") <= n_leaders).select("bucket", F.struct("node", "component").alias("leader"), "n"), "bucket-leaders")
        listed = leaders.groupBy("bucket").agg(F.collect_list("leader").alias("leaders"), F.first("n").alias("n"))  # at most n_leaders each
        # Lists of hot buckets are broadcast while they are short.
        near = join_back(open_.drop("n"), listed, "bucket") if n_leaders <= BROADCAST_LEADERS else open_.drop("n").join(listed.drop("n"), "bucket")
        met = near.select("node", "component", F.explode("leaders").alias("l")).where("component <> l.component")
        pairs = met.select(F.greatest("node", "l.node").alias("u"), F.least("node", "l.node").alias("v")).distinct()
        ties = written(pairs.join(tried, ["u", "v"], "left_anti"), "ties")
        found = written(_confirmed(ties, contents, linked), "links")
        if say:
            say(f"leaders {n_leaders}, open {open_.count()}, ties {ties.count()}, links {found.count()}")
        tidied(found)
        if found.take(1):
            labels = _joined(labels, found)
        before = left
        left = written(open_.select("bucket", "node").join(leaders.select("bucket", F.col("leader.node").alias("node")), ["bucket", "node"], "left_anti"), "bucket-left")
        tried = tried.unionByName(ties)
        dropped(open_, leaders, *([before] if n_leaders > LEADERS else []))
        n_leaders *= 16
