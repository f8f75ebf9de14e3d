"""The robust estimate against a plain search from many random starts."""

import math

import numpy as np

from spanforge.llm import quality


def _steps(x, m, s, h):
    for _ in range(100):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        near = x[np.argsort(d, kind="stable")[:h]]
        m, s = near.mean(0), quality_scatter(near)
    return np.linalg.slogdet(s)[1], m, s


def quality_scatter(near):
    s = np.cov(near.T, bias=True)
    s[np.diag_indices(quality.D)] = np.maximum(np.diag(s), np.square(quality.FLOORS))
    return s


def test_least_determinant(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(3):
        a = rng.normal(size=(quality.D, quality.D)) * 0.5
        x = rng.normal(size=(300, quality.D)) @ a + 4
        x[: 20 * g] += 6  # a cluster of outliers
        x[:, 2] = 0.0 if g == 1 else x[:, 2]
        h = math.ceil(quality.HALF * len(x))
        tries = [rng.choice(len(x), 8, replace=False) for _ in range(200)]
        want[str(g)] = min((_steps(x, x[t].mean(0), quality_scatter(x[t]), h) for t in tries), key=lambda r: r[0])
        rows += [(str(g), *map(float, r)) for r in x]
    fit = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(quality.D)))
    got = {r["g"]: r for r in quality.estimates(fit).collect()}
    for g, (det, m, s) in want.items():
        assert got[g]["det"] < det + 0.15
        assert np.allclose([got[g][f"m{i}"] for i in range(quality.D)], m, atol=0.25)
        p = np.linalg.inv(s) / quality.consistency(quality.HALF, quality.D)
        assert np.allclose(np.sqrt([got[g][f"p{i}{i}"] for i in range(quality.D)]), np.sqrt(np.diag(p)), rtol=0.25)
    assert got["1"]["mid"] > 0 and got["1"]["spread"] > 0


def test_consistency():
    assert math.isclose(quality.chi_squared(2.0, 2), 1 - math.exp(-1), rel_tol=1e-12)
    x = np.random.default_rng(0).normal(size=(400_000, 3))
    near = x[np.argsort((x * x).sum(1))[: int(0.75 * len(x))]]
    assert math.isclose(quality.consistency(0.75, 3) * near.var(), 1, rel_tol=0.01)


def test_small_groups_are_judged_by_the_language_and_by_all(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, rng.integers(80, 200))).capitalize() + "."
    rows = [(i, text(), "en", f"s{i % 2}") for i in range(500)]
    rows += [(500 + i, text(), "en", "tiny") for i in range(20)] + [(600 + i, text(), "xx", "s0") for i in range(20)]
    junk = {700: ("en", "s0"), 701: ("en", "tiny"), 702: ("xx", "s0"), 703: ("en", None), 704: (None, None)}
    rows += [(i, " ".join(f"#$%{w}*|" for w in rng.choice(words, 150)), *k) for i, k in junk.items()]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, kept in got.items() if not kept} == set(junk)
