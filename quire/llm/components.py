"""Connected components of a table of links, by hooking, pointer jumping and contraction; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots by doubling, and keeps the
    links between different roots; a round at least halves the nodes that still have links. Empty links: no rows.
    """
    links, made = links.select("a", "b").filter("a <> b"), []
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "hooks")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(up.select("node", "root").join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "jumps")
            forget(up)
            up = jumped
            if up.filter("moved").isEmpty():
                break
        if found is None:
            found = stored(up.select("node", "root"), "roots")
        else:
            more = stored(found.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            forget(found)
            found = more
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        links = stored(links.join(ends[0], "a").join(ends[1], "b").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
        forget(up, *made)
        made = [links]
        if links.isEmpty():
            forget(*made)
            return found
