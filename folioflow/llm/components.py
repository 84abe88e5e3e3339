"""Connected components over a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import drop_materialized, materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable.

    Rounds of contraction: every node points at its smallest neighbour (or
    itself), pointers are doubled until they end at local minima, and the
    links between those minima are the next round's.  Each round at least
    halves the nodes that still have links; all steps are joins and
    aggregations that combine before the shuffle.  Null ends and links of a
    node with itself are ignored; an empty table gives an empty result.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "pointers")
        while True:
            hop = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            if to.join(hop, "root").where("next <> root").isEmpty():
                break
            # each root is itself a node, so the inner join keeps every row
            to = materialize(to.join(hop, "root").select("node", F.col("next").alias("root")), "pointers")
        if labels is None:
            new = to.select("node", F.col("root").alias("component"))
        else:
            hop = to.select(F.col("node").alias("component"), F.col("root").alias("next"))
            new = labels.join(hop, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        new = materialize(new, "labels")
        ends = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        ends_b = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = links.join(ends, "a").join(ends_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        rest = materialize(rest, "links")
        drop_materialized(links, to, *([labels] if labels is not None else []))
        links, labels = rest, new
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
