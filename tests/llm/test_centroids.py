"""Clustering against its SQL and a plain version of the contract."""

import hashlib

import pytest

from spanforge.llm import centroids, queries
from tests.helpers import SF, oracle, result

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in named[:8]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(at))
    for _ in range(10):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(at)):
            if mine := [v for (_, v), j in zip(kept, own) if j == k]:
                at[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    return [(i, k, d, sum(x for _, x, j in found if j == k), sum(x for _, x, _ in found), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found]


def test_matches_sql(spark):
    assert result(queries.queries()["op13_centroid_clustering"](spark, SF)) == oracle(queries.oracle_sql()["op13_centroid_clustering"])


def vec(*first):
    return [float(x) for x in first] + [0.0] * (64 - len(first))


ODD = [
    (1, vec(0.5, -0.25)), (2, vec(0.5, -0.25)), (3, None), (4, [1.0] * 63), (5, vec(float("nan"))), (6, vec(float("inf"))), (7, [None] * 64), (8, vec(-0.0003)),
    (None, vec(3, 1)), (9, vec(1, 2)), (9, vec(2, 1)), (9, vec(1, 2)), (10, []), (11, vec(-7, 4, 0.001)), (12, vec(1.5, 1.5)),
] + [(100 + i, vec(0.001 * (i % 37), -0.002 * (i % 11))) for i in range(300)] + [(1000 + i, vec(0.75, 0.75)) for i in range(400)]


@pytest.mark.parametrize("rows", [ODD, ODD[:3], ODD[2:7], []])
def test_matches_plain_version(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).selectExpr("*", "1 as v", "2 as cluster").repartition(3)
    got = centroids.cluster(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_components_that_are_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, vec(1e20), 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df).collect()
