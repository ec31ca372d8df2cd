"""What grows with the tables is not broadcast, which would bring it to the driver whole: joins with it are merges, whatever its size is taken for."""

from pacegrid.plans import networks, progress
from pacegrid.sources import bindings as b

DATA = "/root/testdata/sf0.001"


def joins(df, kind):
    return df._jdf.queryExecution().sparkPlan().toString().count(kind)


def test_edges_do_not_broadcast_nodes(spark):
    e = b.edges(spark, DATA)
    assert joins(e, "SortMergeJoin") == 1 and joins(e, "Broadcast") == 0


def test_placed_edges_do_not_broadcast_nodes(spark):
    e = networks.placed(spark, DATA)
    assert joins(e, "SortMergeJoin") == 3 and joins(e, "Broadcast") == 0


def test_places_of_walks_do_not_broadcast_nodes(spark):
    assert joins(progress._places(spark, DATA), "SortMergeJoin [node") == 1
