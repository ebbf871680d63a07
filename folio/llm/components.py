"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one aggregate and one equi-join on edges, so no vertex's neighbours are ever gathered
in one place; hubs are split by adaptive skew-join handling. Rounds grow with the logarithm of the
longest path, and the loop ends only when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import forget, save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1000003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (node long, root long): the smallest node reachable, for nodes that are not their own.

    Loops, repeated and reversed edges and null ends count for nothing. No edges give no rows.
    Nodes that are missing from the result are their own root.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = save(start, "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = save(small.where("u <> v").distinct(), "edges")
        forget(now)
        now, before = then, state
        if (state := _state(now)) == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.folio_path = now.folio_path
    return out
