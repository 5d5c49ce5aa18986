import pytest

from tessera.operators import ordering, rows


def test_greedy_pack_over_one_large_shard(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'a' as shard", "id", "cast(id * 7919 % 90 + 1 as int) as size", "'clash' as pack")
    got = ordering.greedy_pack(df, "shard", "id", "size", 100)
    pack = used = 0
    for k in range(n):
        size = k * 7919 % 90 + 1
        over = used + size > 100
        pack, used = pack + over, size if over else used + size
    last = got.where(f"id = {n - 1}").first()
    assert last.pack == pack and got.count() == n
    assert got.groupBy("pack").sum("size").where("sum(size) > 100").isEmpty()


def test_greedy_pack_edges(spark):
    df = spark.createDataFrame([("b", 1, 60), ("a", 2, 60), ("a", 1, 50), (None, 1, 5), ("a", 3, 500), ("a", 4, None)], "shard string, id int, size int")
    got = {(r.shard, r.id): r.pack for r in ordering.greedy_pack(df, "shard", "id", "size", 100).collect()}
    assert got == {("b", 1): 0, ("a", 1): 0, ("a", 2): 1, (None, 1): 0}
    assert ordering.greedy_pack(df.limit(0), "shard", "id", "size", 100).count() == 0


def test_tree_paths_of_depth_40(spark):
    nodes = [(k, k - 1 if k else None) for k in range(41)] + [(100, 20), (200, 999)]
    got = {}
    for r in rows.tree_paths(spark.createDataFrame(nodes, "node long, parent long"), "node", "parent").collect():
        got.setdefault(r.leaf, {})[r.position] = (r.node, r.owns)
    assert [got[40][k][0] for k in range(41)] == list(range(41))
    assert [got[100][k][0] for k in range(22)] == [*range(21), 100]
    assert got[200] == {0: (999, True), 1: (200, True)} and got[40][5][1] and not got[100][5][1]
    with pytest.raises(ValueError, match="ancestor"):
        rows.tree_paths(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"), "node", "parent")
