"""Cheapest chains of conversions."""

import heapq
import random

import duckdb
import pytest

from docloom.plans.paths import cheapest_paths, plan_conversions
from docloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def dijkstra(edges):
    out = {}
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
    for start in near:
        heap, done = [(0.0, 0, (start,))], set()
        while heap:
            cost, hops, path = heapq.heappop(heap)
            if path[-1] in done:
                continue
            done.add(path[-1])
            if hops:
                out[start, path[-1]] = cost, hops, list(path)
            for b, c in near.get(path[-1], []):
                if b not in done:
                    heapq.heappush(heap, (cost + c, hops + 1, (*path, b)))
    return out


@pytest.mark.parametrize("seed, free", [(1, False), (2, True)])
def test_equals_dijkstra(spark, seed, free):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice([0, 1, 1, 2, 5] if free else [1, 1, 2, 5, 9])) for _ in range(40)]
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(9)] + [("c9", "c0", 1), ("c0", "c9", 20)]  # long paths, a cycle
    odd = [(None, "n1", 1), ("n1", None, 1), ("n2", "n3", None)]
    got = {(r.source, r.target): (r.cost, r.hops, r.path) for r in cheapest_paths(spark.createDataFrame(edges + chain + odd, "source string, target string, cost int")).collect()}
    assert got == dijkstra([e for e in edges + chain if e[0] != e[1]])
    assert got["c0", "c9"] == (9.0, 9, [f"c{i}" for i in range(10)])


def test_bounds(spark):
    none = spark.createDataFrame([], "source string, target string, cost int")
    assert cheapest_paths(none).count() == 0
    with pytest.raises(ValueError, match="negative"):
        cheapest_paths(spark.createDataFrame([("a", "b", -1)], "source string, target string, cost int"))
    rows = plan_conversions(spark.createDataFrame([(1, "text/plain", "text/plain"), (2, None, "text/plain"), (3, "image/png", "no/type")], "i int, mime string, target string"))
    assert sorted((r.i, r.path, r.hops, r.cost) for r in rows.collect()) == [(1, ["text/plain"], 0, 0.0), (2, None, None, None), (3, None, None, None)]


def test_query(spark, tmp_path):
    df = QUERIES["conversion_plans"](spark, SF)
    df.write.parquet(f"{tmp_path}/got")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = f"SELECT doc_id, mime, target, path, cost FROM ({ORACLE['conversion_plans']})", f"SELECT doc_id, mime, target, path, cost FROM '{tmp_path}/got/*.parquet'"
    assert c.execute(f"({want} EXCEPT ALL {got}) UNION ALL ({got} EXCEPT ALL {want})").fetchall() == []
    assert c.execute(f"SELECT max(cost), count(DISTINCT path) FROM ({got})").fetchone()[1] > 15
