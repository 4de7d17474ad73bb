"""Connected components of a link table, without any group in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bitloom.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node of links(a, b); component is the smallest reachable id.

    Labels are parent pointers, never above their node. Each round offers the smallest
    grandparent among a node's neighbours to the node and to its parent, so whole trees hook
    onto each other, and then points every node at its grandparent (FastSV). Rounds go on
    until no label changes: then all trees are stars and no link joins two of them. Rounds
    are written tables, the only thing that reaches the driver is whether a row changed. Ids
    may be of any type with an order, structs too. Null ends and loops are dropped, repeated
    links do no harm; an empty table gives an empty result.
    """
    e = links.where("a is not null and b is not null and a <> b").select("a", "b")
    e = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    cur = materialize(e.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        jump = cur.select(F.col("id").alias("component"), F.col("component").alias("grand"))
        full = cur.select("id", "component").join(jump, "component").select("id", "component", "grand")
        near = e.join(full.select(F.col("id").alias("b"), "grand"), "b").groupBy(F.col("a").alias("id")).agg(F.min("grand").alias("near"))
        near = full.join(near, "id")
        own = near.select("id", F.col("component").alias("old"), F.least("near", "grand").alias("to"))
        root = near.groupBy(F.col("component").alias("id")).agg(F.min("near").alias("to"))
        new = own.unionByName(root.withColumn("old", F.lit(None).cast(cur.schema["component"].dataType)))
        new = new.groupBy("id").agg(F.min("old").alias("old"), F.min("to").alias("to"))
        last, cur = cur, materialize(new.select("id", F.least("old", "to").alias("component"), (F.col("to") < F.col("old")).alias("changed")), "labels")
        discard(last)
        if cur.where("changed").limit(1).count() == 0:
            break
    discard(e)
    out = cur.select("id", "component")
    out.written_path = cur.written_path
    return out


def merge_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links(a, b): labels(id, component) of the earlier ones go on, and only components are joined.

    labels is discarded. Nodes of links that labels lacks are components of their own.
    """
    if labels is None:
        return components(links)
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    top = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = labels.join(top.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    known = moved.select("id", F.coalesce("to", "component").alias("component"))
    fresh = top.join(labels.select("id"), "id", "left_anti")
    out = materialize(known.unionByName(fresh), "labels")
    discard(labels, top)
    return out
