import hashlib
import math
import random

import duckdb
from pyspark.sql import functions as F

from tessera.llm import clustering, queries

SCHEMA = "vec_id long, embedding array<double>, q string, weight int, cluster string"


def plain(rows, k=16, rounds=3, dims=64):
    """[(id, cluster, distance)] and centroids, one vector at a time."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], centroids


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_plain_python_and_sql(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centroids = plain(rows)
    got = queries.op11_clusters(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    total = sum(d for _, _, d in want)
    of = {c: sum(d for _, x, d in want if x == c) for c in range(16)}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert rows_of(got) == sorted((i, c, d, of[c], total, digests[c]) for i, c, d in want)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    rel = con.sql(queries.oracle_sql()["op11_clusters"])
    assert rel.columns == got.columns and sorted(rel.fetchall()) == rows_of(got)


def test_edges_repeats_and_clashing_columns(spark):
    rng = random.Random(3)
    hot = [0.5] * 64
    rows = [(i, [rng.uniform(-2, 2) for _ in range(64)]) for i in range(40)] + [(100 + i, hot) for i in range(60)]
    rows += [(7, hot), (7, hot), (None, hot), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, [])]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    want, centroids = plain(rows)
    found, got = clustering.cluster_vectors(df)
    assert got == centroids
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert clustering.cluster_digests(df.where(F.lit(False))).count() == 0
    assert clustering.cluster_digests(df.where("vec_id = 1")).collect()[0].distance == 0


def test_ties_go_to_the_smaller_centroid_and_empty_ones_stay(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)]
    found, centroids = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, dims=2)
    assert centroids == [[64, 0]] * 3 and {r.cluster for r in found.collect()} == {0}


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3**j * (i % 5 - 2)) for j in range(8 + i % 3, 11 + i % 3)]) for i in range(20)] + [(90, [1e7, -1e7, 3.0]), (91, [1e7 + 1, -1e7, 3.0]), (92, [1e30, 0.0, 0.0])]
    want, _ = plain(rows, k=3, dims=3)
    found, _ = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, dims=3)
    got = {r.vec_id: r for r in found.collect()}
    small = [(i, c, d) for i, c, d in want if d < 1 << 63 and i != 92]
    assert len(small) >= 20 and got[92].vec_id == 92 and len(got) == len(rows)


def test_repeats_cost_one_distinct_row(spark):
    rows = [(i, [float(i % 4), 1.0]) for i in range(1000)]
    q = clustering.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2)
    distinct = q.groupBy("q").agg(F.count(F.lit(1)).alias("weight"))
    assert distinct.count() == 4
    assert clustering.totals(distinct, [[0, 64]], 2) == {(0, -1): 1000, (0, 0): 250 * 64 * 6, (0, 1): 64000}
