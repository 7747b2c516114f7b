"""Vector functions on generated vectors against numpy in double."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclake.functions import vectors as V


def of(spark, a, b, f, kind="float"):
    return spark.createDataFrame([(a, b)], f"a array<{kind}>, b array<{kind}>").select(f(F.col("a"), F.col("b")).alias("x")).first()["x"]


def vectors(seed, n, width, kind="float"):
    """Pairs of generated vectors, with opposite, scaled, orthogonal, tiny and zero ones among them."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    b[0], b[1], b[2] = -a[0], 3 * a[1], a[2]
    b[3], a[4], a[5], b[5] = 0, 0, 0, 0
    a[6, width // 2 :], b[6, : width // 2] = 0, 0
    a[7], b[7] = 1e-5 * a[7], 1e-5 * b[7]
    if kind == "tinyint":
        return [np.clip(np.rint(x * 40), -127, 127).astype(int) for x in (a, b)]
    return [x.astype(np.float32).astype(float) for x in (a, b)]


def columns(spark, seed, kind, *functions):
    a, b = vectors(seed, 12, 10, kind)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], f"i int, a array<{kind}>, b array<{kind}>")
    rows = df.orderBy("i").select(*[f(F.col("a"), F.col("b")).alias(str(k)) for k, f in enumerate(functions)]).collect()
    return a, b, np.array([tuple(r) for r in rows])


@pytest.mark.parametrize("kind", ["float", "tinyint"])
def test_similarities(spark, kind):
    """Against numpy in double; a zero vector is similar to nothing."""
    small = kind == "tinyint"
    a, b, got = columns(spark, 31, kind, V.cosine_similarity_int8 if small else V.cosine_similarity, V.euclidean_similarity_int8 if small else V.euclidean_similarity)
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    distance = np.linalg.norm(a - b, axis=1)
    assert got[:, 0] == pytest.approx(cosine, abs=1e-12) and got[:, 1] == pytest.approx(1 / (1 + distance), abs=1e-12)
    assert got[:3, 0] == pytest.approx([-1, 1, 1], abs=5e-2 if small else 1e-6) and not got[3:7, 0].any() and got[2, 1] == got[5, 1] == 1


def test_width_is_checked(spark):
    for a, b in (([1.0, 2.0], [1.0]), ([], [])):
        with pytest.raises(Exception, match="differ in width"):
            of(spark, a, b, V.cosine_similarity)


def test_quantize(spark):
    """Clamped, times 127 in float32, cut toward zero; back within one unit."""
    rng = np.random.default_rng(32)
    v = np.concatenate([rng.uniform(-1.3, 1.3, 300), np.arange(-130, 131) / 127, [0.0, 1.0, -1.0, 40.0, 1e-9]]).astype(np.float32)
    row = spark.createDataFrame([(v.tolist(),)], "a array<float>").select(V.quantize(F.col("a")).alias("q"), V.dequantize(V.quantize(F.col("a"))).alias("d")).first()
    assert row["q"] == np.trunc(np.clip(v, -1, 1) * np.float32(127)).astype(int).tolist()
    assert np.abs(np.array(row["d"]) - np.clip(v, -1, 1)).max() <= 1 / 127 + 1e-6


def test_normalize_and_range(spark):
    rng = np.random.default_rng(33)
    x = rng.normal(size=(20, 7)).astype(np.float32)
    x[3] = 0
    x[4], x[5, 2] = x[4] / 100, np.nan
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, a array<float>").orderBy("i").select(V.normalize(F.col("a")).alias("n"), V.out_of_range(F.col("a")).alias("o")).collect()
    for v, r in zip(x, rows):
        wide = np.flatnonzero(~(np.abs(v) <= 1))
        assert r["o"] == (int(wide[0]) if len(wide) else None)
        if np.isfinite(v).all():
            assert r["n"] == pytest.approx((v / np.linalg.norm(v)).tolist() if v.any() else v.tolist(), abs=1e-6)


def test_sparse_dot(spark):
    """Against dense products, in both orders; disjoint and empty ones give 0."""
    rng = np.random.default_rng(34)
    x = rng.normal(size=(30, 2, 12)).astype(np.float32) * (rng.random((30, 2, 12)) < 0.4)
    x[0], x[1, 0], x[2, 0, :6], x[2, 1, 6:] = 0, 0, 0, 0
    rows = [(i, *[part for v in pair for part in (np.flatnonzero(v).tolist(), v[v != 0].tolist())]) for i, pair in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, ai array<bigint>, av array<float>, bi array<bigint>, bv array<float>").orderBy("i")
    want = (x[:, 0].astype(float) * x[:, 1]).sum(1).tolist()
    for order in (("ai", "av", "bi", "bv"), ("bi", "bv", "ai", "av")):
        assert [r["x"] for r in df.select(V.sparse_dot(*map(F.col, order)).alias("x")).collect()] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n", [1, 3, 5, 8, 17, 64, 129, 1536])
def test_laws(spark, n):
    rng = np.random.default_rng(n)
    a, b = (rng.normal(0, 0.025, n).astype(np.float32) for _ in range(2))
    x, y = a.astype(float), b.astype(float)
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<float>, b array<float>").select(
        *[f.alias(str(k)) for k, f in enumerate(g(F.col("a"), F.col("b")) for g in (V.cosine_similarity, V.cosine_distance, V.euclidean_similarity, V.euclidean_distance))]
    ).first()
    assert got[0] == pytest.approx(x @ y / math.sqrt((x @ x) * (y @ y)), abs=1e-9) and got[0] == pytest.approx(1 - got[1], abs=1e-12)
    assert got[2] == pytest.approx(1 / (1 + math.dist(x, y)), abs=1e-9) and got[2] == pytest.approx(1 / (1 + got[3]), abs=1e-12)


def test_registry():
    assert V.metric_names() == ["cosine", "euclidean"] and V.is_known("cosine") and not V.is_known("dot")
    assert V.resolve("cosine").scale_invariant and not V.resolve("euclidean").scale_invariant
    with pytest.raises(ValueError):
        V.resolve("dot")
