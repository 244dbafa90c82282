"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's larger (large) or smaller neighbours to the smallest one that it knows."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("at"), F.least("a", "least").alias("least"))
    joined = both.join(least, F.col("a") == F.col("at"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.*")
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (comparable ids, in either order; repeats and loops do no harm).
    Returns node, root for every linked node; root is the smallest id of its component.

    Each round is written to the shared folder, so a lost executor costs one round at most. A
    component that is a star around its smallest node no longer changes; the rounds end when
    nothing does.
    """
    state = common.cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        digest = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if digest == last or digest[0] == 0:
            break
        last = digest
        state = common.cut(_stars(_stars(state, True), False))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
