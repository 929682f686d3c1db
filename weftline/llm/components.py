"""Connected components by alternating large-star and small-star steps, each a shuffle of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def star_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root): every node of ``links`` (u, v) with the smallest node of its component.

    Nulls and links of a node to itself say nothing and are ignored. The smallest neighbours of nodes are written
    before rows meet them, so that adaptive execution can split the rows of a node with very many links.
    """
    name = "edges0"
    edges = scratch.put(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    seen, step = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, step = mark, step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), f"large{step}")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = scratch.put(large, f"edges{step}a")
        low = scratch.put(large.groupBy("u").agg(F.min("v").alias("low")), f"small{step}")
        small = large.join(low.hint("merge"), "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = scratch.put(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), f"edges{step}b")
        scratch.drop(name, f"large{step}", f"edges{step}a", f"small{step}")
        name = f"edges{step}b"
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
