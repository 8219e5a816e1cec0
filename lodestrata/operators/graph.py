"""Graphs as two tables: degrees, pruning, induced subgraphs, shortest paths, adjacency, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import escape_html, node_id
from lodestrata.runtime import materialize


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours out and in. Both ends of an edge come from one pass over the distinct edges."""
    ends = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    return ends.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def prune(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visible nodes, edges among them, count of hidden ones): the nodes of most neighbours, 10 to 100; ties by id."""
    d = degrees(edges)
    visible = d.orderBy(F.col("degree").desc(), "node").limit(max(10, min(100, limit)))
    hidden = d.agg(F.greatest(F.count("*") - F.lit(max(10, min(100, limit))), F.lit(0)).alias("clustered"))
    return visible, induced(edges.select("src", "dst").distinct(), visible), hidden


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def distances(edges: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """(node, distance, parent) within ``most`` steps, one or more edges away; of equal ways the smallest parent.

    Level by level; the frontier is joined with the edges, what was seen before is taken out, and each
    level is written to the shared folder, so that the plan does not grow.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct())  # read once a level
    frontier = sources.select(F.col("node"))
    seen: DataFrame | None = None
    for step in range(1, most + 1):
        reached = edges.join(frontier.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        if seen is not None:
            reached = reached.join(seen.select("node"), "node", "left_anti")
        reached = materialize(reached.select("node", F.lit(step).alias("distance"), "parent"))
        if reached.isEmpty():
            break
        seen = reached if seen is None else seen.unionByName(reached)
        frontier = reached.select("node")
    if seen is None:
        return sources.select("node", F.lit(0).alias("distance"), F.col("node").alias("parent")).limit(0)
    return seen


def trace(edges: DataFrame, source: object, sink: object, most: int = 5) -> DataFrame:
    """(position, node) of a shortest path of at least one edge; empty if there is none within ``most`` (1 to 20)."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    way = distances(edges, spark.createDataFrame([(source,)], f"node {kind}"), max(1, min(20, most)))
    schema = f"position int, node {kind}"
    steps: list = []
    at = sink
    while True:
        row = way.where(F.col("node") == F.lit(at)).select("distance", "parent").first()
        if row is None:
            return spark.createDataFrame([], schema)
        steps.append(at)
        at = row["parent"]
        if row["distance"] == 1:
            steps.append(at)
            return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(steps))], schema)


def mermaid(nodes: DataFrame, edges: DataFrame, node: str = "node", label: str = "label", title: str = "flowchart LR") -> DataFrame:
    """One row: the diagram text, nodes and edges in order of their ids."""
    text = lambda c: escape_html(F.col(c).cast("string"))
    lines = nodes.select(F.lit(0).alias("part"), F.col(node).cast("string").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  "), node_id(F.col(node).cast("string")), F.lit('["'), text(label), F.lit('"]')).alias("line"))
    lines = lines.unionByName(edges.select(F.lit(1).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.concat(F.lit("  "), node_id(F.col("src").cast("string")), F.lit(" --> "), node_id(F.col("dst").cast("string"))).alias("line")))
    return lines.agg(F.sort_array(F.collect_list(F.struct("part", "a", "b", "line"))).alias("l")).select(F.concat(F.lit(title + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("diagram"))


def structurizr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a workspace in the architecture description language."""
    quoted = lambda c: F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("    "), node_id(F.col("node").cast("string")), F.lit(' = element "'), quoted("label"), F.lit('"')).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("    "), node_id(F.col("src").cast("string")), F.lit(" -> "), node_id(F.col("dst").cast("string"))).alias("line"))
    body = n.unionByName(e).agg(F.sort_array(F.collect_list(F.struct("part", "line"))).alias("l")).select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("b"))
    return body.select(F.concat(F.lit("workspace {\n  model {\n"), "b", F.lit("\n  }\n}")).alias("dsl"))


def trace_status(edges: DataFrame, source: object, sink: object, most: int = 5) -> DataFrame:
    """One row (status, length): SUCCESS within ``most`` steps (1 to 20), PARTIAL for a longer way, NOT_FOUND without one of 20."""
    spark = edges.sparkSession
    way = distances(edges, spark.createDataFrame([(source,)], f"node {dict(edges.dtypes)['src']}"), 20)
    far = way.where(F.col("node") == F.lit(sink)).agg(F.min("distance").alias("length"))
    return far.select(F.when(F.col("length").isNull(), "NOT_FOUND").when(F.col("length") > max(1, min(20, most)), "PARTIAL").otherwise("SUCCESS").alias("status"), "length")
