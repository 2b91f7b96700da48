"""Connected components of an edge table by alternating stars, and joins that stay even with hot keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.store import dropped, written

AT_ONCE = 500_000  #: edges, at most 32 bytes each
HOT = 1000  #: a key is hot if it has more than one in HOT of all rows, so at most HOT keys are


def join_back(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the columns of their group; ``n`` of groups is the number of rows with that key.

    Hot groups, at most HOT of them, are broadcast, so that a hot key's rows stay where they are; the others are joined by key.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") * HOT > F.lit(total))
    cold = groups.where(F.col("n") * HOT <= F.lit(total))
    hot_keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key, how))


def join_by_text(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of ``found`` by doc_id, which may be null, and th, the hash of the text."""
    other = found.withColumnsRenamed({"doc_id": "found_id", "th": "found_th"})
    return rows.join(other, (F.col("th") == F.col("found_th")) & F.col("doc_id").eqNullSafe(F.col("found_id")), how).drop("found_id", "found_th")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges u, v: each node's neighbours (larger ones, or smaller ones and itself) are tied to the smallest."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    tied = join_back(near, least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """The same in one task, for a number of edges that was counted: labels fall to the smallest neighbour's, and follow themselves."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, nodes = pd.factorize(pd.concat([pdf["u"], pdf["v"]], ignore_index=True))
        order = np.argsort(nodes, kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        u, v = place[at].reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            for x in (label[u], label[v], u, v):
                np.minimum.at(new, x, low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"node": nodes[order], "component": nodes[order][label]})

    return edges.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, f"node {kind}, component {kind}")


def _peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges u, v whose u has no other edge, the rest); u is the larger end, so the smallest nodes stay in the rest."""
    nodes = edges.select("u").unionAll(edges.select(F.col("v").alias("u")))
    ends = nodes.groupBy("u").agg(F.count("*").alias("n")).where("n = 1").select("u")
    marked = written(edges.join(ends.withColumn("end", F.lit(True)), "u", "left").select("u", "v", F.coalesce("end", F.lit(False)).alias("end")), "edges")
    return marked.where("end").select("u", "v"), marked.where("not end").select("u", "v")


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (its smallest node) of every node of the edges u, v; nodes may be of any orderable type.

    At most ``at_once`` edges are worked on in one task. Of more, those to nodes that have no other edge are set aside, as such a node
    follows its neighbour; the rest goes on in rounds of stars, which leave more such nodes each time.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    aside: list[DataFrame] = []
    while now.count() > at_once:
        if aside:
            big = written(_stars(now, True), "edges")
            now = written(_stars(big, False), "edges")
            dropped(big)
        ends, rest = _peeled(now)
        dropped(now)
        aside.append(ends)
        now = rest
    out = written(_at_once(now), "components")
    dropped(now)
    for ends in reversed(aside):
        named = ends.join(out.withColumnRenamed("node", "v"), "v", "left").select("u", "v", F.coalesce("component", "v").alias("component"))
        roots = named.where("component = v").select(F.col("v").alias("node"), "component").distinct().join(out.select("node"), "node", "left_anti")
        out = written(out.unionByName(named.select(F.col("u").alias("node"), "component")).unionByName(roots), "components")
    return out
