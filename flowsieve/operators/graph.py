"""The busiest source-destination pairs as a directed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.traffic import pair_counts

EDGES = 30


def graph_edges(flows: DataFrame, n: int = EDGES) -> DataFrame:
    """The n busiest pairs; `width` is the line width, a tenth of the weight."""
    busiest = pair_counts(flows).orderBy(F.desc("count"), "src_ip", "dst_ip").limit(n)
    return busiest.select("src_ip", "dst_ip", F.col("count").alias("weight"), (F.col("count") / 10).alias("width"))


def graph_nodes(flows: DataFrame, n: int = EDGES) -> DataFrame:
    """Nodes of the edges. A node on both sides has the type under which it occurs last."""
    # at most n rows reach this window
    by_rank = Window.orderBy(F.desc("weight"), "src_ip", "dst_ip")
    ranked = graph_edges(flows, n).withColumn("rank", F.row_number().over(by_rank))
    written = ranked.select(F.inline(F.array(
        F.struct(F.col("src_ip").alias("id"), F.lit("source").alias("type"), (2 * F.col("rank")).alias("turn")),
        F.struct(F.col("dst_ip").alias("id"), F.lit("destination").alias("type"), (2 * F.col("rank") + 1).alias("turn")),
    )))
    nodes = written.groupBy("id").agg(F.max_by("type", "turn").alias("type"))
    colour = F.when(F.col("type") == "source", "skyblue").otherwise("lightgreen")
    return nodes.withColumn("colour", colour)
