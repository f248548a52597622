"""Empty tables give defined results."""

from pathloom.operators import charts as CH
from pathloom.operators import graph as G


def test_scores_of_an_empty_chart(spark):
    none = spark.createDataFrame([], "id long, hi array<double>, lo array<double>")
    assert CH.kruskal_stress(none).first()["stress"] is None
    row = CH.trustworthiness_continuity(none, 5).first()
    assert (row["n"], row["k"], row["tw"], row["ct"]) == (0, 0, 1.0, 1.0)


def test_graph_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert G.neighbour_graph(none).count() == 0 and G.geodesic_chart(none).count() == 0
