"""Per-row vector comparisons (V1-V3) as native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sway.functions.constants import COSINE_EPS
from sway.functions.text import ColumnOrName, col


def as_double(v: ColumnOrName) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def sq_error_sum(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def mse(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V1: mean squared error of two equally long vectors."""
    return sq_error_sum(a, b) / F.size(col(a))


def cosine(a: ColumnOrName, b: ColumnOrName, eps: float = COSINE_EPS) -> Column:
    """V2: ``a.b / (max(|a|, eps) * max(|b|, eps))``."""
    e = F.lit(eps)
    return dot(a, b) / (F.greatest(norm(a), e) * F.greatest(norm(b), e))


_NEG_INF = float("-inf")


def logsumexp(a: ColumnOrName) -> Column:
    """``log(sum(exp(v)))`` in one stable pass (online max rescaling), so no
    per-element lambda re-evaluates a whole-array expression."""
    init = F.struct(F.lit(_NEG_INF).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    return F.aggregate(as_double(a), init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def nll_of_max(a: ColumnOrName) -> Column:
    """``-max(log_softmax(v)) = logsumexp(v) - max(v)``."""
    return logsumexp(a) - F.array_max(as_double(a))


def kl(a: ColumnOrName, b: ColumnOrName) -> Column:
    """V3: KL(softmax(b) || softmax(a)) = sum p_b (b - a) - lse(b) + lse(a),
    folded in one pass with online max rescaling for both sides."""
    init = F.struct(*[F.lit(v).alias(n) for n, v in
                      (("mx", _NEG_INF), ("sx", 0.0), ("my", _NEG_INF), ("sy", 0.0), ("w", 0.0))])

    def step(acc, p):
        x, y = p["x"], p["y"]
        mx = F.greatest(acc["mx"], x)
        my = F.greatest(acc["my"], y)
        ry = F.exp(acc["my"] - my)
        ey = F.exp(y - my)
        return F.struct(mx.alias("mx"), (acc["sx"] * F.exp(acc["mx"] - mx) + F.exp(x - mx)).alias("sx"),
                        my.alias("my"), (acc["sy"] * ry + ey).alias("sy"), (acc["w"] * ry + ey * (y - x)).alias("w"))

    def finish(acc):
        return acc["w"] / acc["sy"] - (acc["my"] + F.log(acc["sy"])) + (acc["mx"] + F.log(acc["sx"]))

    pairs = F.zip_with(as_double(a), as_double(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, init, step, finish)
