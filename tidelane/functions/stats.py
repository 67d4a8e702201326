"""Statistics blocks as aggregate columns.

Two conventions are kept apart: ``array_stats`` takes absolute values and divides by n, the sample statistics take signed values and divide by n - 1. Sums
and sums of squares of whole numbers are exact, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("mean", "std", "var", "min", "max", "range", "median", "sum", "count", "up_mean", "up_std", "up_min", "up_max", "up_sum", "up_count", "down_mean", "down_std", "down_min", "down_max", "down_sum", "down_count")
DISTRIBUTION = ("p10", "p20", "p30", "p40", "p50", "p60", "p70", "p80", "p90", "mean", "std", "min", "max", "median", "skew", "kurt")
_WIDE = "decimal(38,0)"


def _population(x: Column) -> tuple[Column, Column, Column, Column]:
    """mean, variance (not below 0), sum, count of whole numbers."""
    n, s, q = F.count(x), F.sum(x.cast(_WIDE)).cast("double"), F.sum((x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast(_WIDE)).cast("double")
    mean = s / n
    return mean, F.greatest(q / n - mean * mean, F.lit(0.0)), s, n


def array_stats(x: Column) -> list[Column]:
    """The 21 statistics of a signed sequence of whole numbers: over absolute values, then over those above 0 (up) and below 0 (down). Zeros belong to neither."""
    size = F.abs(x)
    mean, var, total, n = _population(size)
    low, high = F.min(size).cast("double"), F.max(size).cast("double")
    out = {"mean": mean, "std": F.sqrt(var), "var": var, "min": low, "max": high, "range": high - low, "median": F.percentile(size, F.lit(0.5)), "sum": total, "count": n}
    for side, part in (("up", F.when(x > 0, size)), ("down", F.when(x < 0, size))):
        m, v, s, k = _population(part)
        one = {"mean": m, "std": F.when(k > 1, F.sqrt(v)), "min": F.min(part).cast("double"), "max": F.max(part).cast("double"), "sum": s}
        out |= {f"{side}_{name}": F.coalesce(c, F.lit(0.0)) for name, c in one.items()} | {f"{side}_count": k}
    return [out[name].alias(name) for name in STATS]


def sample_std(x: Column) -> Column:
    return F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), F.lit(0.0))


def sample_var(x: Column) -> Column:
    return F.coalesce(F.when(F.count(x) > 1, F.var_samp(x)), F.lit(0.0))


def or0(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def distribution(x: Column, prefix: str) -> list[Column]:
    """Sixteen numbers of a sequence: nine linear percentiles, mean, std, min, max, median, skew, kurtosis; 0 for an empty one.

    The standard deviation is sqrt(sum of squares * n / (n - 1)), without the division by n, and skew and kurtosis are scaled by it.
    """
    n = F.count(x)
    share = [k / 10 for k in range(1, 10)]
    parts = F.percentile(x, F.array(*[F.lit(s) for s in share]))
    nd = n.cast("double")
    m2 = F.var_pop(x) * nd
    std = F.when(n > 1, F.sqrt(m2 * nd / (nd - 1))).otherwise(0.0)
    # sums of cubes and fourth powers about the mean, from Spark's standardised moments
    moment2 = F.var_pop(x)
    z3 = F.skewness(x) * F.pow(moment2, F.lit(1.5)) * nd / F.pow(std, F.lit(3.0))
    z4 = (F.kurtosis(x) + 3) * moment2 * moment2 * nd / F.pow(std, F.lit(4.0))
    wide = std > 1e-12
    skew = F.when((n >= 3) & wide, nd / ((nd - 1) * (nd - 2)) * z3)
    kurt = F.when((n >= 4) & wide, nd * (nd + 1) / ((nd - 1) * (nd - 2) * (nd - 3)) * z4 - 3 * (nd - 1) * (nd - 1) / ((nd - 2) * (nd - 3)))
    values = [*(parts[k] for k in range(9)), F.avg(x), std, F.min(x), F.max(x), parts[4], skew, kurt]
    return [or0(v).alias(f"{prefix}_{name}") for v, name in zip(values, DISTRIBUTION, strict=True)]


def running(x: Column, window) -> dict[str, Column]:
    """Cumulative mean, std (dividing by n), min and max."""
    return {"mean": F.avg(x).over(window), "std": F.stddev_pop(x).over(window), "min": F.min(x).over(window), "max": F.max(x).over(window)}
