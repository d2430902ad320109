"""Statistical functions as column expressions, and a t quantile for single values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*key: Column | str) -> Column:
    """An integer from 0 to 2^32 - 1 that depends on the key alone: the source of all randomness here."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def shuffled(*key: Column | str) -> Column:
    """A sort key that puts rows in an order which depends on the key alone."""
    return F.md5(F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key]))


def binomial_tail(n: Column, k: Column) -> Column:
    """The chance of k or more heads in n fair throws; summed in logarithms, so that n may be large."""
    n, k = n.cast("int"), k.cast("int")
    step = lambda s, i: F.struct(
        (s["log"] + F.when(i < n, F.log((n - i) / (i + 1.0))).otherwise(0.0)).alias("log"),
        (s["tail"] + F.when(i >= k, F.exp(s["log"])).otherwise(0.0)).alias("tail"),
    )
    start = F.struct((n * F.lit(-math.log(2))).alias("log"), F.lit(0.0).alias("tail"))
    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda s: s["tail"])


def erf(x: Column) -> Column:
    """The error function by a series of positive terms; past 6 it is 1 to all digits."""
    size = F.least(F.abs(x), F.lit(6.0))
    step = lambda s, n: F.struct(
        (s["term"] * s["xx"] * 2 / (2 * n + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"), s["xx"].alias("xx")
    )
    start = F.struct(size.alias("term"), F.lit(0.0).alias("sum"), (size * size).alias("xx"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda s: s["sum"] * F.exp(-s["xx"]))
    return F.signum(x) * total * (2 / math.sqrt(math.pi))


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal is over z."""
    return (1 - erf(z / math.sqrt(2))) / 2


def signed_rank_tail(n: Column, w: Column) -> Column:
    """The exact chance of a signed-rank sum of w or more for n untied values, by counting sign patterns."""
    n = n.cast("int")
    top = (n * (n + 1) / 2).cast("int")
    one = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    shares = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        one,
        lambda old, r: F.transform(old, lambda x, i: (x + F.when(i >= r, F.element_at(old, F.greatest(i - r + 1, F.lit(1)))).otherwise(0.0)) / 2),
    )
    return F.aggregate(F.slice(shares, F.ceil(w).cast("int") + 1, top + 1), F.lit(0.0), lambda s, x: s + x)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_quantile(p: float, df: float) -> float:
    """The value below which a share p of Student's t lies, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    below = lambda t: 1 - _beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """The critical value of Grubbs' two-sided test for one outlier among n values."""
    if n < 3:
        return math.nan
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
