"""Connected components of a link table, without collecting links anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
each step is a grouped minimum (partially aggregated before the shuffle) joined back to the links, so a hub with
many links is never gathered into one task: the adaptive skew join splits its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): links of u. Adds m, the smallest of u and its neighbours."""
    low = pairs.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("m"))
    return pairs.join(low, "u")


def one_hub(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what ``links`` (a: a node, b: one of its hubs) connect: a node is linked with its smallest hub only, and so are its other hubs.

    Where the same group was found many times, each time around another hub, a row for each finding becomes one for each node and for each different pair of hubs. A node's
    hubs are gathered in a row, so there should be no more of them than the ways in which a group is looked for.
    """
    gathered = links.where("a <> b").groupBy("a").agg(F.collect_set("b").alias("hubs")).select(F.array_append("hubs", F.col("a")).alias("met"))
    to_smallest = F.transform("met", lambda x: F.struct(x.alias("a"), F.array_min("met").alias("b")))
    return gathered.select(F.inline(to_smallest)).where("a <> b").distinct()


def connected_components(spark: SparkSession, links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id reachable. Self links and repeats are allowed.

    An empty table gives an empty table. Whether the links are stars at the smallest id already is counted while a step is written, so no
    job of its own asks for it. ``limit`` guards against a fault only: the steps converge in O(log n) rounds, and an error is raised if they don't.
    """
    edges = materialize(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # an id between two others, or with two lower neighbours, is no star's
        astray = (F.col("v") > F.col("u")) & (F.col("m") < F.col("u")) | (F.col("v") < F.col("u")) & (F.col("v") != F.col("m"))
        seen = Observation()
        starred = _stars(both).observe(seen, F.count_if(astray).alias("astray"))
        # written once, since the next step reads it twice
        large = materialize(spark, starred.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        if not seen.get["astray"]:
            roots = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
        small = _stars(large).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = materialize(spark, small.where("u <> v").distinct())
    raise RuntimeError("components did not converge")
