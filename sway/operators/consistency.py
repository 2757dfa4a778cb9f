"""Consistency between vectors before and after the challenge.

Pairwise criteria (MSE, cosine, KL) are native per-row expressions followed by
an ordinary aggregate. The Sinkhorn divergence compares two *clouds* of vectors
and needs all point pairs of a cloud. A cloud is one example, named by an
explicit key; small ones are solved whole, many in an Arrow batch, larger ones over
tasks, block by block. A group's value is the mean over its clouds, as the reference
takes the mean over a batch. The number of solver steps is fixed, so a value depends on
its cloud alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.functions.constants import CONSISTENCY_SCALE, CRITERIA, SINKHORN_BLUR, SINKHORN_P
from sway.functions.vectors import cosine, kl, mse
from sway.operators.scratch import written


# ------------------------------------------------------------------ pairs
def pair_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 extra: tuple[str, ...] = ("label",)) -> DataFrame:
    """Pairs ``(2k, 2k+1)`` -> ``(pair_id, left, right, extra...)`` with one
    aggregation on the pair key (no self-join)."""
    side = F.pmod(F.col(id_col), F.lit(2))
    pair = F.floor(F.col(id_col) / 2).cast("bigint")
    return df.groupBy(pair.alias("pair_id")).agg(
        F.max(F.when(side == 0, F.col(vec_col))).alias("left"),
        F.max(F.when(side == 1, F.col(vec_col))).alias("right"),
        *[F.max(F.when(side == 0, F.col(c))).alias(c) for c in extra],
    ).filter(F.col("left").isNotNull() & F.col("right").isNotNull())


def pair_scores(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    return pairs.withColumn("mse", mse(left, right)).withColumn("cosine", cosine(left, right)).withColumn(
        "kl", kl(left, right))


# --------------------------------------------------------------- sinkhorn
def temperatures(blur: float = SINKHORN_BLUR, p: int = SINKHORN_P, reach: float = 8.0) -> list[float]:
    """The fixed cooling plan: from ``reach ** p`` (``reach``: a distance that no
    two points exceed by much) down by factors of ``2 ** p``, ending at ``blur ** p``."""
    out = [reach ** p]
    while out[-1] / 2 ** p > blur ** p:
        out.append(out[-1] / 2 ** p)
    return [*out, blur ** p]


def _half_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 0.5 * ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2) if x.size * len(y) < 1 << 22 else np.stack(
        [0.5 * ((row - y) ** 2).sum(axis=1) for row in x])


def _soft_minimum(costs: np.ndarray, potential: np.ndarray, t: float) -> np.ndarray:
    """For each row i: -t log mean_j exp((potential_j - costs_ij) / t)."""
    scores = (potential - costs) / t
    top = scores.max(axis=1)
    return -t * (top + np.log(np.exp(scores - top[:, None]).mean(axis=1)))


def _potentials(costs: np.ndarray, plan: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Dual potentials of entropic transport between uniform clouds: at each
    temperature both move half the way to the soft minimum of the other, and at the
    last one all the way."""
    rows, cols = np.zeros(costs.shape[0]), np.zeros(costs.shape[1])
    for t in plan:
        rows, cols = (0.5 * (rows + _soft_minimum(costs, cols, t)), 0.5 * (cols + _soft_minimum(costs.T, rows, t)))
    return _soft_minimum(costs, cols, plan[-1]), _soft_minimum(costs.T, rows, plan[-1])


def sinkhorn_divergence(x: np.ndarray, y: np.ndarray, blur: float = SINKHORN_BLUR, p: int = SINKHORN_P,
                        reach: float = 8.0) -> float:
    """Debiased Sinkhorn divergence of two uniform clouds (n, d) and (m, d) for the
    cost |x-y|^2/2 and temperature ``blur ** p``: the dual value of the pair less
    half of that of each cloud with itself."""
    if p != 2:
        raise NotImplementedError("only p=2 is supported")
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    plan = temperatures(blur, p, reach)
    from_x, from_y = _potentials(_half_squares(x, y), plan)
    own_x, own_y = (sum(_potentials(_half_squares(z, z), plan)) / 2 for z in (x, y))
    return float((from_x - own_x).mean() + (from_y - own_y).mean())


def _batch_divergences(x: np.ndarray, y: np.ndarray, blur: float, p: int, reach: float) -> np.ndarray:
    """``sinkhorn_divergence`` of many pairs of clouds (k, n, d) and (k, m, d) at once."""
    def solve(a, b):
        costs = 0.5 * ((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(axis=3)

        def soft(costs, potential, t):
            scores = (potential[:, None, :] - costs) / t
            top = scores.max(axis=2)
            return -t * (top + np.log(np.exp(scores - top[:, :, None]).mean(axis=2)))

        turned = costs.transpose(0, 2, 1)
        rows, cols = np.zeros(costs.shape[:2]), np.zeros(turned.shape[:2])
        for t in plan:
            rows, cols = 0.5 * (rows + soft(costs, cols, t)), 0.5 * (cols + soft(turned, rows, t))
        return soft(costs, cols, plan[-1]), soft(turned, rows, plan[-1])

    plan = temperatures(blur, p, reach)
    from_x, from_y = solve(x, y)
    own_x, own_y = (sum(solve(z, z)) / 2 for z in (x, y))
    return (from_x - own_x).mean(axis=1) + (from_y - own_y).mean(axis=1)


#: floats of cost matrices that a task holds at once
BATCH_COSTS = 1 << 20


def _solve_clouds(blur: float, p: int, reach: float):
    """Values of small clouds ``(grp, n_left, n_right, left, right)``: those of one shape in
    an Arrow batch are solved together."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = np.full(batch.num_rows, np.nan)
            shapes: dict = {}
            counts = [batch.column(k).to_numpy() for k in (1, 2)]
            # points of all rows one after the other; a row's begin at the sum of those before
            points, firsts = [], []
            for k in (3, 4):
                flat = batch.column(k).flatten()
                dim = len(flat.flatten()) // len(flat) if len(flat) else 0
                points.append(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim))
                firsts.append(np.cumsum(counts[k - 3]) - counts[k - 3])
            for i, shape in enumerate(zip(*counts)):
                if all(shape):
                    shapes.setdefault(shape, []).append(i)
            for (n, m), rows in shapes.items():
                size = max(1, BATCH_COSTS // (max(n, m) ** 2 * points[0].shape[1]))
                for at in range(0, len(rows), size):
                    part = np.array(rows[at:at + size])
                    x, y = (v[f[part][:, None] + np.arange(c)] for v, f, c in zip(points, firsts, (n, m)))
                    values[part] = _batch_divergences(x, y, blur, p, reach)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values)], names=["grp", "n_left", "n_right", "sinkhorn"])

    return run


def group_sinkhorn(points: DataFrame, group: str, cloud: str, side_col: str = "side", vec_col: str = "embedding",
                   blur: float = SINKHORN_BLUR, p: int = SINKHORN_P, reach: float = 8.0, largest: int = 2048) -> DataFrame:
    """V4: the mean over a group's clouds of the Sinkhorn divergence between their
    left (``side`` 0) and right (``side`` 1) points. ``cloud`` names the example
    that a point belongs to (within its group); group and cloud may be of any type.
    A cloud with one side only is counted in ``n_one_sided`` and has no value.
    Returns ``(group, n_clouds, n_one_sided, n_left, n_right, sinkhorn)``.

    Clouds of at most ``largest`` points a side are solved whole, many in one Arrow batch;
    larger ones by ``block_sinkhorn``, over tasks. ``points`` is read twice."""
    if p != 2:
        raise NotImplementedError("only p=2 is supported")
    kind = "array<double>"
    tagged = points.select(F.col(group).alias("grp"), F.col(cloud).alias("cloud"), F.col(side_col).alias("side"),
                           F.col(vec_col).cast(kind).alias("v"))
    of = lambda k: F.count_if(F.col("side") == k)
    sizes = written(tagged.groupBy("grp", "cloud").agg(of(0).alias("n_left"), of(1).alias("n_right")), "clouds")
    large = sizes.where((F.greatest("n_left", "n_right") > largest) & (F.least("n_left", "n_right") > 0))
    small = tagged
    if not large.isEmpty():
        same = F.col("grp").eqNullSafe(F.col("_grp")) & F.col("cloud").eqNullSafe(F.col("_cloud"))
        named = large.select(F.col("grp").alias("_grp"), F.col("cloud").alias("_cloud"))
        small = tagged.join(named, same, "left_anti")
        large = block_sinkhorn(tagged.join(named, same, "left_semi"), blur, reach, largest)
    sides = [F.collect_list(F.when(F.col("side") == k, F.col("v"))) for k in (0, 1)]
    gathered = small.groupBy("grp", "cloud").agg(sides[0].alias("left"), sides[1].alias("right")).select(
        "grp", F.size("left").cast("bigint").alias("n_left"), F.size("right").cast("bigint").alias("n_right"), "left", "right")
    per_cloud = gathered.mapInArrow(_solve_clouds(blur, p, reach), T.StructType([
        tagged.schema["grp"], T.StructField("n_left", T.LongType()), T.StructField("n_right", T.LongType()),
        T.StructField("sinkhorn", T.DoubleType())]))
    if "sinkhorn" in large.columns:
        per_cloud = per_cloud.unionByName(large.select("grp", "n_left", "n_right", "sinkhorn"))
    value = F.nanvl("sinkhorn", F.lit(None).cast("double"))
    return per_cloud.groupBy(F.col("grp").alias(group)).agg(
        F.count(F.lit(1)).alias("n_clouds"), F.count_if((F.col("n_left") == 0) | (F.col("n_right") == 0)).alias("n_one_sided"),
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), F.avg(value).alias("sinkhorn"))


# ------------------------------------------------- clouds beyond one task
#: the problems of a divergence: left-right, left-left, right-right
_PROBLEMS = ((0, 0, 1), (1, 0, 0), (2, 1, 1))
_SUMS = "id bigint, problem int, axis int, block int, top array<double>, total array<double>"


#: floats of sums that a task holds before it passes them on
_HELD_SUMS = 1 << 17


def _arrays(column):
    """The rows of an Arrow column of lists of doubles, as views of its buffer."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(at[:-1], at[1:]):
        yield values[a:b]


def _clouds(column):
    """The rows of an Arrow column of lists of equally long vectors, as views (points, dimensions)."""
    at, ends = column.offsets.to_numpy(), column.values.offsets.to_numpy()
    values = column.values.values.to_numpy(zero_copy_only=False)
    for a, b in zip(at[:-1], at[1:]):
        dims = np.diff(ends[a:b + 1])
        if (dims != dims[0]).any():
            raise ValueError("vectors of one cloud differ in length")
        yield values[ends[a]:ends[b]].reshape(b - a, dims[0])


def _sums_batch(rows):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["id", "problem", "axis", "block", "top", "total"])


def _sums_batches(rows):
    """``rows`` of sums as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 2 * len(row[4])
        if size >= _HELD_SUMS:
            yield _sums_batch(held)
            held, size = [], 0
    if held:
        yield _sums_batch(held)


def _tile_sums(t: float):
    """For each tile of costs, what it adds to the soft minima of its rows (axis 0) and of its
    columns (axis 1): the largest score and the sum of all, scaled by it. Tiles are read one
    at a time from the Arrow buffers; besides these a task holds one tile."""

    def rows(batches):
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in ("id", "problem", "i", "j")]
            points = (_clouds(batch.column(k)) for k in ("x", "y"))
            potentials = (_arrays(batch.column(k)) for k in ("f", "g"))
            for id_, problem, i, j, x, y, f, g in zip(*names, *points, *potentials):
                costs = _half_squares(x, y)
                for axis, block, other, c in ((0, i, g, costs), (1, j, f, costs.T)):
                    scores = (other - c) / t
                    top = scores.max(axis=1)
                    yield id_, problem, axis, block, top, np.exp(scores - top[:, None]).sum(axis=1)

    return lambda batches: _sums_batches(rows(batches))


def _merge_sums(batches):
    """Sums of one block that follow each other, as one: running maximum and scaled sum."""

    def rows():
        key, top, total = None, None, None
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in ("id", "problem", "axis", "block")]
            for *mine, a, s in zip(*names, _arrays(batch.column("top")), _arrays(batch.column("total"))):
                if mine == key:
                    high = np.maximum(top, a)
                    top, total = high, total * np.exp(top - high) + s * np.exp(a - high)
                else:
                    if key:
                        yield (*key, top, total)
                    # copies: a view would hold the batch
                    key, top, total = mine, a.copy(), s.copy()
        if key:
            yield (*key, top, total)

    return _sums_batches(rows())


def block_sinkhorn(points: DataFrame, blur: float = SINKHORN_BLUR, reach: float = 8.0, block: int = 2048) -> DataFrame:
    """``(grp, cloud, n_left, n_right, sinkhorn)`` for clouds of any size, from ``points (grp,
    cloud, side, v)``; both sides of a cloud must hold points.

    Points are dealt into blocks of about ``block``; a tile of costs is made from two blocks
    where it is needed. Potentials are a table with one row a block, written at every
    temperature. A step joins the tiles' blocks with their potentials, adds up each
    tile's largest score and scaled sum, and merges these by block in sorted streams: first
    within the task, then after the shuffle. No task holds more than a tile."""
    names = points.select("grp", "cloud").distinct().withColumn("id", F.monotonically_increasing_id())
    names = written(names, "cloud-names")
    same = points["grp"].eqNullSafe(names["grp"]) & points["cloud"].eqNullSafe(names["cloud"])
    # numbered where they are written: a task that runs again writes its rows anew
    rows = written(points.join(names, same).select("id", "side", "v").withColumn("row", F.monotonically_increasing_id()), "points")
    sizes = written(rows.groupBy("id", "side").agg(F.count(F.lit(1)).alias("n")), "sides")
    blocks = F.ceil(F.col("n") / F.lit(block))
    dealt = rows.join(sizes, ["id", "side"]).select(
        "id", "side", "n", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), "v")
    dealt = written(dealt.groupBy("id", "side", "block").agg(F.collect_list("v").alias("v"), F.first("n").alias("n")), "blocks")
    problems = points.sparkSession.createDataFrame(_PROBLEMS, "problem int, left_side int, right_side int")
    left = dealt.select("id", F.col("side").cast("int").alias("left_side"), F.col("block").alias("i"), F.col("v").alias("x"))
    right = dealt.select("id", F.col("side").cast("int").alias("right_side"), F.col("block").alias("j"), F.col("v").alias("y"))
    ids = left.select("id", "left_side", "i").join(F.broadcast(problems), "left_side").join(
        right.select("id", "right_side", "j"), ["id", "right_side"])
    ids = written(ids, "tiles")
    # potentials, zero at first: axis 0 for the rows' blocks of a problem, 1 for the columns'
    axes = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("left_side").alias("side")),
                             F.struct(F.lit(1).alias("axis"), F.col("right_side").alias("side")))).alias("s")
    sided = problems.select("problem", axes).select("problem", "s.axis", "s.side")
    # a soft minimum over rows is a mean over the points of the other axis
    other = sizes.join(F.broadcast(sided), "side").select("id", "problem", (1 - F.col("axis")).alias("axis"), F.col("n").alias("others"))
    state = dealt.select("id", F.col("side").cast("int").alias("side"), "block", F.size("v").alias("size")).join(
        F.broadcast(sided), "side").select("id", "problem", "axis", "block", F.array_repeat(F.lit(0.0), F.col("size")).alias("u"))
    state = written(state, "potentials")
    plan = temperatures(blur, 2, reach)
    key = ["id", "problem", "axis", "block"]

    def sums(state, t):
        f = state.where("axis = 0").select("id", "problem", F.col("block").alias("i"), F.col("u").alias("f"))
        g = state.where("axis = 1").select("id", "problem", F.col("block").alias("j"), F.col("u").alias("g"))
        tiles = (ids.join(left, ["id", "left_side", "i"]).join(right, ["id", "right_side", "j"])
                 .join(f, ["id", "problem", "i"]).join(g, ["id", "problem", "j"]).select("id", "problem", "i", "j", "x", "y", "f", "g"))
        parts = tiles.mapInArrow(_tile_sums(t), _SUMS).sortWithinPartitions(*key).mapInArrow(_merge_sums, _SUMS)
        return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge_sums, _SUMS)

    def soft(state, t):
        found = sums(state, t).join(other, ["id", "problem", "axis"])
        return found.select(*key, F.transform(F.arrays_zip("top", "total"), lambda z: F.lit(-t) * (
            z["top"] + F.log(z["total"] / F.col("others")))).alias("soft"))

    for t in plan:
        moved = state.join(soft(state, t), key)
        state = written(moved.select(*key, F.zip_with("u", "soft", lambda u, v: (u + v) / 2).alias("u")), "potentials")
    last = soft(state, plan[-1])
    mean = (F.aggregate("soft", F.lit(0.0), lambda a, x: a + x)).alias("sum")
    own = sizes.join(F.broadcast(sided), "side").select("id", "problem", "axis", "n")
    weight = F.when(F.col("problem") == 0, F.lit(1.0)).otherwise(F.lit(-0.5))
    value = last.select("id", "problem", "axis", mean).join(own, ["id", "problem", "axis"]).groupBy("id").agg(
        F.sum(weight * F.col("sum") / F.col("n")).alias("sinkhorn"))
    n = lambda k: F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0))
    counts = sizes.groupBy("id").agg(n(0).alias("n_left"), n(1).alias("n_right"))
    return names.join(value, "id").join(counts, "id").select("grp", "cloud", "n_left", "n_right", "sinkhorn")


# ---------------------------------------------------------------- dispatch
def consistency(pairs: DataFrame, criterion: str = "ot", left: str = "left", right: str = "right",
                group: str = "label", cloud: str = "pair_id", reach: float = 8.0) -> DataFrame:
    """V5: criterion ``ot | mse | cossim | kl`` -> one row per group with the
    batch-mean consistency value (the selection is honoured, Q15). For ``ot``,
    ``cloud`` names the example of each pair."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown consistency criterion {criterion}")
    if criterion == "ot":
        pts = pairs.select(F.col(cloud).alias("_cloud"), group, F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.col(left).alias("embedding")),
            F.struct(F.lit(1).alias("side"), F.col(right).alias("embedding")))))
        return group_sinkhorn(pts, group, "_cloud", reach=reach).select(group, F.col("sinkhorn").alias("consistency"))
    fn = {"mse": mse, "cossim": cosine, "kl": kl}[criterion]
    return pairs.groupBy(group).agg(F.avg(fn(left, right)).alias("consistency"))


def combined_score(df: DataFrame, batch: str, alpha: float = 1.0, loss: str = "loss",
                   loss_followup: str = "loss_followup", consistency_col: str = "consistency") -> DataFrame:
    """Per batch, ``mean(loss) + alpha * (mean(loss_followup) + 1e-5 *
    mean(consistency))`` — the training objective as a scored table."""
    return df.groupBy(batch).agg(
        F.avg(loss).alias("loss"), F.avg(loss_followup).alias("loss_followup"),
        F.avg(consistency_col).alias("consistency"),
    ).withColumn("objective", F.col("loss") + F.lit(alpha) * (F.col("loss_followup")
                                                              + F.lit(CONSISTENCY_SCALE) * F.col("consistency")))
