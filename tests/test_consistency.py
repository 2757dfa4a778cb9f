"""Vector criteria against numpy, Sinkhorn properties."""

import numpy as np
import pytest

from sway.functions.vectors import cosine, kl, mse
from sway.operators.consistency import consistency, group_sinkhorn, pair_vectors, sinkhorn_divergence


def test_sinkhorn_properties():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 3))
    b = rng.normal(size=(30, 3)) + 0.5
    assert abs(sinkhorn_divergence(a, a)) < 1e-6
    assert sinkhorn_divergence(a, b) == pytest.approx(sinkhorn_divergence(b, a), rel=1e-4, abs=1e-6)
    t = np.array([1.0, -2.0, 0.5])
    assert sinkhorn_divergence(a, a + t) == pytest.approx(0.5 * float(t @ t), rel=2e-3)
    assert sinkhorn_divergence(a, b) > 0


def test_pairwise_criteria_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(i // 2 % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    pairs = pair_vectors(df).select("pair_id", "label", mse("left", "right").alias("m"),
                                    cosine("left", "right").alias("c"), kl("left", "right").alias("k")).collect()
    vec = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v, _ in rows}
    for r in pairs:
        x, y = vec[2 * r.pair_id], vec[2 * r.pair_id + 1]
        assert r.m == pytest.approx(np.mean((x - y) ** 2))
        assert r.c == pytest.approx(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
        lx = x - np.log(np.exp(x - x.max()).sum()) - x.max()
        ly = y - np.log(np.exp(y - y.max()).sum()) - y.max()
        assert r.k == pytest.approx(np.sum(np.exp(ly) * (ly - lx)), abs=1e-9)
    by = {r.label: r.consistency for r in consistency(pair_vectors(df), "mse").collect()}
    assert set(by) == {0, 1, 2}
    with pytest.raises(ValueError):
        consistency(pair_vectors(df), "nope")


def exact_transport(x, y):
    """Cost of the best matching of equally large clouds, by trying all of them."""
    from itertools import permutations

    c = ((x[:, None] - y[None]) ** 2).sum(2) / 2
    return min(np.mean([c[i, j] for i, j in enumerate(p)]) for p in permutations(range(len(y))))


def test_sinkhorn_is_near_the_exact_transport_cost():
    rng = np.random.default_rng(5)
    for _ in range(5):
        x, y = rng.normal(size=(6, 2)), rng.normal(size=(6, 2)) + 1
        assert sinkhorn_divergence(x, y, blur=0.01) == pytest.approx(exact_transport(x, y), rel=0.05)


def test_group_sinkhorn_takes_clouds_as_given(spark):
    rng = np.random.default_rng(2)
    rows = []
    for pid in range(60):
        for side in (0, 1):
            rows.append((f"g{pid % 2}", pid // 10, side, [float(x) for x in rng.normal(size=4) + side]))
    rows.append(("g0", 99, 0, [0.0] * 4))  # a cloud with one side
    df = spark.createDataFrame(rows, "label string, example int, side int, embedding array<double>")
    out = {r.label: r for r in group_sinkhorn(df, "label", "example").collect()}
    assert set(out) == {"g0", "g1"}
    for lab, r in out.items():
        values = []
        for e in range(6):
            x, y = (np.array([v for g, c, s, v in rows if (g, c, s) == (lab, e, k)]) for k in (0, 1))
            values.append(sinkhorn_divergence(x, y))
        assert r.sinkhorn == pytest.approx(np.mean(values), rel=1e-9)
    assert (out["g0"].n_clouds, out["g0"].n_one_sided, out["g1"].n_one_sided) == (7, 1, 0)
    # more examples don't change what the others give
    more = spark.createDataFrame([(g, c + 1000 * k, s, v) for k in range(3) for g, c, s, v in rows], df.schema)
    again = {r.label: r.sinkhorn for r in group_sinkhorn(more, "label", "example").collect()}
    assert again == pytest.approx({k: r.sinkhorn for k, r in out.items()})


@pytest.mark.parametrize("criterion", ["mse", "cossim", "kl", "ot"])
def test_criterion_dispatch(spark, criterion):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3)], "a") for i in range(8)]
    pairs = pair_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    got = consistency(pairs, criterion).first().consistency
    x, y = (np.array([v for i, v, _ in rows if i % 2 == k]) for k in (0, 1))
    soft = lambda v: np.exp(v) / np.exp(v).sum()
    want = {"mse": [np.mean((a - b) ** 2) for a, b in zip(x, y)],
            "cossim": [a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(x, y)],
            "kl": [np.sum(soft(b) * np.log(soft(b) / soft(a))) for a, b in zip(x, y)],
            "ot": [np.sum((a - b) ** 2) / 2 for a, b in zip(x, y)]}[criterion]
    assert got == pytest.approx(np.mean(want), rel=1e-6)


def points_of(clouds):
    """Rows (g, c, side, embedding) of named clouds, and each one's divergence."""
    rng = np.random.default_rng(1)
    rows, value = [], {}
    for name, (n, m) in clouds.items():
        x, y = rng.normal(size=(n, 5)), rng.normal(size=(m, 5)) + 0.3
        x[: n // 4] = x[:1]  # equal points are points of their own
        rows += [("g", name, side, v.tolist()) for side, z in ((0, x), (1, y)) for v in z]
        if n and m:
            value[name] = sinkhorn_divergence(x, y)
    return rows, value


POINTS = "g string, c string, side int, embedding array<double>"


def test_block_sinkhorn_equals_the_local_solver(spark):
    from pyspark.sql import functions as F

    from sway.operators.consistency import block_sinkhorn

    rows, value = points_of({"a": (30, 50), "b": (70, 20), None: (40, 40), "one": (1, 1), "few": (2, 33)})
    df = spark.createDataFrame(rows, POINTS).repartition(4)
    points = df.select(F.col("g").alias("grp"), F.col("c").alias("cloud"), "side", F.col("embedding").alias("v"))
    got = {r.cloud: (r.n_left, r.n_right, r.sinkhorn) for r in block_sinkhorn(points, block=16).collect()}
    assert set(got) == set(value) and got["b"][:2] == (70, 20)
    assert all(got[k][2] == pytest.approx(value[k], abs=1e-9) for k in value)


def test_tiles_are_solved_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from sway.operators.consistency import _merge_sums, _tile_sums

    rng = np.random.default_rng(4)
    n, size, dim = 600, 32, 64
    values = rng.normal(size=(2, n, size, dim))
    at = pa.array(np.arange(n + 1) * size, pa.int32())
    cloud = lambda v: pa.ListArray.from_arrays(at, pa.ListArray.from_arrays(
        pa.array(np.arange(n * size + 1) * dim, pa.int32()), pa.array(v.ravel())))
    flat = pa.ListArray.from_arrays(at, pa.array(np.zeros(n * size)))
    number = lambda kind: pa.array(np.arange(n), kind)
    batch = pa.RecordBatch.from_arrays(
        [number(pa.int64()), pa.array([0] * n, pa.int32()), number(pa.int32()), number(pa.int32()), cloud(values[0]),
         cloud(values[1]), flat, flat], names=["id", "problem", "i", "j", "x", "y", "f", "g"])
    # a slice: rows do not begin where the buffers do
    whole, batch = batch, batch.slice(100)
    for run, source in ((_tile_sums(0.5), batch), (_merge_sums, pa.Table.from_batches(_tile_sums(0.5)([whole])).combine_chunks().to_batches()[0])):
        tracemalloc.start()
        rows = largest = 0
        for out in run([source]):
            rows, largest = rows + out.num_rows, max(largest, out.num_rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == (1000 if source is batch else 1200)
        # the points of the batch alone are 16 MB, as Python objects four times that
        assert peak < 8e6
    first = next(iter(_tile_sums(0.5)([batch])))
    costs = 0.5 * ((values[0, 100][:, None] - values[1, 100][None]) ** 2).sum(axis=2)
    assert first.column("id")[0].as_py() == 100
    assert first.column("top")[0].as_py() == pytest.approx((-costs / 0.5).max(axis=1))


def test_group_sinkhorn_of_small_and_large_clouds(spark):
    rows, value = points_of({"a": (30, 20), "b": (5, 3), "c": (5, 3), None: (18, 33), "left only": (40, 0), "right only": (0, 2)})
    df = spark.createDataFrame(rows, POINTS).repartition(4)
    for largest in (2048, 16):
        r = group_sinkhorn(df, "g", "c", largest=largest).first()
        assert (r.n_clouds, r.n_one_sided, r.n_left, r.n_right) == (6, 2, 98, 61)
        assert r.sinkhorn == pytest.approx(np.mean(list(value.values())), rel=1e-9)
    assert group_sinkhorn(df.limit(0), "g", "c").count() == 0
    with pytest.raises(NotImplementedError):
        group_sinkhorn(df, "g", "c", p=1)
