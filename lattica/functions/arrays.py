"""Scalar and array functions as column expressions: clips, activations, permutations, mixed radix, softmax, sampling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def zscore(x: Column, mean: Column, std: Column, clip: float = 100.0) -> Column:
    """(x - mean) / std within +-clip; null stays null (greatest and least alone would skip it)."""
    z = (x - mean) / std
    return F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def unzscore(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def soft_clip(x: Column, low: Column, high: Column) -> Column:
    """Values beyond a bound grow with its logarithm: max(low - log1p|x|, x), then min(high + log1p|x|, x) of the result."""
    a = F.when(x.isNotNull(), F.greatest(low - F.log1p(F.abs(x)), x))
    return F.when(a.isNotNull(), F.least(high + F.log1p(F.abs(a)), a))


def hard_clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def softmax(logits: Column, temperature: float = 0.9) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(logits, lambda v: F.exp((v - F.array_max(logits)) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def logsumexp(values: Column) -> Column:
    m = F.array_max(values)
    return m + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - m)))


def reduce_array(values: Column, how: str) -> Column:
    """sum, product, max or logsumexp of an array."""
    if how == "sum":
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    if how == "product":
        return F.aggregate(values, F.lit(1.0), lambda a, v: a * v)
    if how == "max":
        return F.array_max(values)
    if how == "logsumexp":
        return logsumexp(values)
    raise ValueError(f"unknown reduction {how!r}")


def argmax(p: Column) -> Column:
    """Zero-based place of the largest value, the first of equals."""
    return F.array_position(p, F.array_max(p)) - 1


def gather(values: Column, perm: list[int]) -> Column:
    """values[perm]."""
    return F.transform(F.lit(perm).cast("array<int>"), lambda i: F.element_at(values, i + 1))


def inverse_permutation(perm: list[int]) -> list[int]:
    out = [0] * len(perm)
    for i, p in enumerate(perm):
        out[p] = i
    return out


def circular_groups(values: Column, width: int, size: int = 3) -> Column:
    """For each place i the values at i + 2^k (modulo width), k below size."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array(*(F.element_at(values, ((i + (1 << k)) % width + 1).cast("int")) for k in range(size))))


def mixed_radix_bases(classes: int, most: int = 10) -> list[int]:
    """Near-equal bases, none above `most`, whose product is at least `classes`."""
    digits = max(1, math.ceil(math.log(classes) / math.log(most) - 1e-12))
    base = min(math.ceil(classes ** (1 / digits) - 1e-12), most)
    bases = [base] * digits
    i = 0
    while math.prod(bases) < classes:
        bases[i % digits] += 1
        i += 1
    return bases


def mixed_radix_digit(y: Column, bases: list[int], k: int) -> Column:
    later = math.prod(bases[k + 1 :])
    return F.floor(y / later).cast("int") % bases[k]


def balanced_groups(classes: int, most: int = 10) -> list[int]:
    """Group of each class: ceil(classes/most) groups, at most `most`, of near-equal sizes."""
    groups = min(math.ceil(classes / most), most)
    size, extra = divmod(classes, groups)
    return [g for g in range(groups) for _ in range(size + (g < extra))]


def sharpen(p: Column, temperature: float) -> Column:
    """p^(1/temperature), normalised; all mass on the largest for temperatures near 0."""
    if temperature <= 1e-8:
        best = argmax(p)
        return F.transform(p, lambda v, i: F.when(i == best, 1.0).otherwise(0.0))
    q = F.transform(p, lambda v: F.pow(v, F.lit(1 / temperature)))
    return F.transform(q, lambda v: v / F.aggregate(q, F.lit(0.0), lambda a, b: a + b))


def sample_category(p: Column, u: Column) -> Column:
    """Place of the class that a uniform u falls into, by cumulative probability."""
    scan = F.aggregate(p, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k")), lambda a, v: F.struct((a["c"] + v).alias("c"), (a["k"] + F.when(a["c"] + v <= u, 1).otherwise(0)).alias("k")))
    return F.least(scan["k"], F.size(p) - 1)


def tempered_level(u: Column, temperature: float) -> Column:
    """Quantile level of a tempered draw: 0.5 + (u - 0.5) * temperature, away from 0 and 1."""
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 0.5 + (u - 0.5) * temperature))


def _sign(x: Column) -> Column:
    return F.signum(x)


#: Elementwise activations.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "tanh": F.tanh,
    "leaky_relu": lambda x: F.when(x >= 0, x).otherwise(0.01 * x),
    "elu": lambda x: F.when(x >= 0, x).otherwise(F.expm1(x)),
    "identity": lambda x: x,
    "selu": lambda x: 1.0507009873554805 * F.when(x >= 0, x).otherwise(1.6732632423543772 * F.expm1(x)),
    "silu": lambda x: x / (1 + F.exp(-x)),
    "relu": lambda x: F.greatest(F.lit(0.0), x),
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))),
    "relu6": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(6.0), x)),
    "hardtanh": lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
    "sgn": _sign,
    "heaviside": lambda x: F.when(x >= 0, 1.0).otherwise(0.0),
    "rbf": lambda x: F.exp(-x * x),
    "exp": F.exp,
    "unit_interval": lambda x: F.when((x >= 0) & (x <= 1), 1.0).otherwise(0.0),
    "sin": F.sin,
    "square": lambda x: x * x,
    "abs": F.abs,
    "sqrt_abs": lambda x: F.sqrt(F.abs(x)),
    "log_clip_abs": lambda x: F.log(F.greatest(F.abs(x), F.lit(1e-3))),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "round": F.rint,
    "modulo": lambda x: x - F.floor(x),
    "logsigmoid": lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x))),
    "power_relu": lambda x: F.pow(F.greatest(F.lit(0.0), x), F.lit(2.0)),
    "signed_power": lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(0.5)),
    "negative_power": lambda x: 1 / (1 + F.abs(x)),
}


def rank_in_row(values: Column) -> Column:
    """Place of each value in its sorted row, from 0; equals by position."""
    order = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.transform(values, lambda v, i: F.array_position(F.transform(order, lambda s: s["i"]), i) - 1)


def argsort_row(values: Column) -> Column:
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"])


def is_max(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(v == F.array_max(values), 1.0).otherwise(0.0))


def standardize(values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.transform(values, lambda v: (v - mean) / (F.sqrt(var) + 1e-8))


def l2_normalize(values: Column) -> Column:
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(values, lambda v: v / (norm + 1e-8))


def kumaraswamy(x: Column, a: float, b: float) -> Column:
    """1 - (1 - x^a)^b of x in [0, 1]."""
    return 1 - F.pow(1 - F.pow(x, F.lit(a)), F.lit(b))


def count_below(values: Column, n: int, below) -> Column:
    """How many of an array's n values, sorted so that those for which below(value) holds come first, these are; by halving."""
    steps = F.lit([1 << i for i in reversed(range(max(n, 1).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & below(F.element_at(values, F.least(at + step, F.lit(n)))), at + step).otherwise(at))


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function by Acklam's rational approximation (relative error below 1.2e-9)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(coefs, x):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + k
        return out

    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    mid, r = p - 0.5, (p - 0.5) * (p - 0.5)
    return F.when(p < 0.02425, poly(c, low) / poly((*d, 1.0), low)).when(p > 1 - 0.02425, -poly(c, high) / poly((*d, 1.0), high)).otherwise(poly(a, r) * mid / poly((*b, 1.0), r))
