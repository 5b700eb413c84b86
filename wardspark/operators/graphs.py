"""Graphs as two tables: nodes (graph_id, node_id, type_id) and edges (graph_id, src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.shared import staged


def feature_hash(name: Column, size: int) -> Column:
    """1 to size, from the last digits of a hash; the size is a power of two."""
    return (F.conv(F.substring(F.sha1(name), 33, 8), 16, 10).cast("long") % size + 1).cast("int")


def offsets(nodes: DataFrame) -> DataFrame:
    """graph_id and how many nodes the graphs before it have: sums over ranges of graphs, and then within each range, so no
    task sorts all graphs. The ranges are written once, as their borders must not change."""
    d = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).repartitionByRange("graph_id").withColumn("part", F.spark_partition_id())
    d = staged(d, "graphs")
    past = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("part").agg(F.sum("n").alias("n")).select("part", past(Window.orderBy("part")).alias("ahead"))  # a row for each range
    within = d.withColumn("own", past(Window.partitionBy("part").orderBy("graph_id")))
    return within.join(F.broadcast(parts), "part").select("graph_id", (F.col("ahead") + F.col("own")).alias("offset"))


def collate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All graphs as one: node numbers go on from graph to graph."""
    o = offsets(nodes)
    n = nodes.join(o, "graph_id").withColumn("node_id", F.col("node_id") + F.col("offset")).drop("offset")
    e = edges.join(o, "graph_id").withColumn("src", F.col("src") + F.col("offset")).withColumn("dst", F.col("dst") + F.col("offset")).drop("offset")
    return n, e


def neighbour_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, dim, value: the mean of the vectors of the sources of a node's edges; nodes: graph_id, node_id,
    v. The degree is 1 at least: a node that no edge leads to has the mean 0."""
    v = nodes.select("graph_id", F.col("node_id").alias("src"), F.posexplode("v").alias("dim", "x"))
    j = edges.select("graph_id", "src", "dst").join(v, ["graph_id", "src"])
    means = j.groupBy("graph_id", F.col("dst").alias("node_id"), "dim").agg(F.avg("x").alias("value"))
    each = nodes.select("graph_id", "node_id", F.posexplode("v").alias("dim", "x")).drop("x")
    return each.join(means, ["graph_id", "node_id", "dim"], "left").select("graph_id", "node_id", "dim", F.coalesce("value", F.lit(0.0)).alias("value"))


def mean_pool(nodes: DataFrame) -> DataFrame:
    """graph_id, dim, value: the mean vector of a graph's nodes."""
    return nodes.select("graph_id", F.posexplode("v").alias("dim", "x")).groupBy("graph_id", "dim").agg(F.avg("x").alias("value"))


def sibling_edges(statements: DataFrame) -> DataFrame:
    """statements: graph_id, body, place, node_id. Each to the next of its body."""
    w = Window.partitionBy("graph_id", "body").orderBy("place")
    return statements.select("graph_id", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst")).where("dst IS NOT NULL")


def use_edges(names: DataFrame) -> DataFrame:
    """names: graph_id, name, node_id. The first place of a name to each later one."""
    w = Window.partitionBy("graph_id", "name").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return names.select("graph_id", F.first("node_id").over(w).alias("src"), F.col("node_id").alias("dst")).where("src <> dst")


def bounded(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2048, most_edges: int = 8192) -> tuple[DataFrame, DataFrame]:
    """The first nodes of each graph, the edges among them, and of these the first."""
    n = nodes.where(F.col("node_id") < most_nodes)
    w = Window.partitionBy("graph_id").orderBy("src", "dst", "type")
    e = edges.where((F.col("src") < most_nodes) & (F.col("dst") < most_nodes)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most_edges).drop("_k")
    return n, e


def build_report(graphs: DataFrame) -> DataFrame:
    """graphs: graph_id, ok, nodes. One row: graphs, how many came out, and how many were cut."""
    return graphs.agg(F.count("*").alias("total"), F.count_if("ok").alias("built"), F.count_if(F.col("nodes") >= 2048).alias("truncated"), F.round(F.avg("nodes"), 4).alias("mean_nodes"))
