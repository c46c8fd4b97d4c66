"""The registry, graphs' measures, sinks and sources."""

import pytest
from pyspark.sql import functions as F
from weft import registry
from weft.graph import Graph, read_points_csv, write_points_csv
from weft.sources import tables


def test_registry(spark):
    assert len(registry.all_operators()) == 58 and len(registry.list_categories()) == 10
    assert {c: len(o) for c, o in registry.registry().items()} == {"proximity": 9, "triangulation": 2, "spanning": 6, "random_models": 13, "spanners": 5, "ann": 6, "kernel": 5, "visibility": 3, "data_driven": 5, "misc": 4}
    assert registry.get_operator("proximity", "epsilon").parameters() == [("epsilon", "float", "1.2")]
    assert "epsilon" in registry.get_operator("proximity", "epsilon").describe()
    for bad in (("x", "y"), ("proximity", "y")):
        with pytest.raises(KeyError, match="there are"):
            registry.get_operator(*bad)
    registry.operators_table(spark)
    assert spark.sql("SELECT count(*) FROM operators WHERE is_directed").first()[0] == 1


def test_graph(spark, tmp_path):
    points = tables.two_cluster_layout(spark)
    graph = registry.get_operator("proximity", "symmetric_knn").build_and_record(points, k=5)
    row = graph.summary().first()
    assert (row["n_nodes"], row["n_edges"]) == (30, 97) and abs(row["density"] - 97 / 435) < 1e-12 and graph.build_time_ms > 0
    assert graph.degrees().agg(F.sum("degree")).first()[0] == 194 and graph.degrees().count() == 30
    assert graph.contains(registry.get_operator("proximity", "mutual_knn").build(points).edges)
    assert not graph.contains(registry.get_operator("proximity", "complete").build(points).edges)
    assert {r["component"] for r in graph.components().collect()} <= {0, 10}
    low, high = graph.normalized_weights().agg(F.min("normalized"), F.max("normalized")).first()
    assert (low, high) == (0, 1)
    graph.write(str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 97
    write_points_csv(points, str(tmp_path / "p"))
    again = read_points_csv(spark, str(tmp_path / "p"))
    assert registry.get_operator("proximity", "symmetric_knn").build(again).edges.count() == 97
    empty = Graph(points.frame, graph.edges.limit(0))
    assert empty.summary().first()["density"] == 0 and empty.components().count() == 30


def test_layouts(spark):
    points = tables.two_cluster_layout(spark)
    head = [r["features"] for r in points.frame.orderBy("id").limit(1).collect()][0]
    assert abs(head[0] + 1.847641) < 1e-6
    assert tables.uniform_layout(spark).frame.count() == 30 == tables.single_cluster_layout(spark).frame.count()
    box = tables.bounding_box(points, 0.0).first()
    assert box["x_min"] < -2 < 2 < box["x_max"]
