"""Synthetic tables from random causal graphs and layered models. A dataset is a function of (seed, number) alone, so a
lost task makes the same rows again; datasets are spread over tasks, one NumPy call chain each."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

Rng = np.random.Generator

#: Most features by number of rows (fixed values): up to the rows, that many features.
FEATURE_CAPS = ((10_240, 100), (20_000, 80), (30_000, 60), (40_000, 40), (50_000, 30), (60_000, 20), (65_000, 15))


def feature_cap(rows: int, most: int = 100) -> int:
    return next((min(most, cap) for top, cap in FEATURE_CAPS if rows <= top), 10)


# -- draws


def log_uniform(rng: Rng, low: float, high: float) -> float:
    return float(np.exp(rng.uniform(np.log(low), np.log(high))))


def truncated_normal(rng: Rng, mean: float, std: float, low: float, high: float) -> float:
    for _ in range(100):
        v = rng.normal(mean, std)
        if low <= v <= high:
            return float(v)
    return float(np.clip(mean, low, high))


def log_scale_weights(rng: Rng, n: int) -> np.ndarray:
    """softmax(-decay * ln(1..n) + s * noise), shuffled, of norm sqrt(n)."""
    z = -rng.uniform(0, 2) * np.log(np.arange(1, n + 1)) + rng.uniform(0, 1) * rng.normal(size=n)
    w = np.exp(z - z.max())
    w = rng.permutation(w / w.sum())
    return w * np.sqrt(n) / np.linalg.norm(w)


# -- points and matrices


def points(rng: Rng, n: int, d: int, kind: str | None = None) -> np.ndarray:
    """uniform in a cube, in a ball, Gaussian, correlated Gaussian, or a mixture of Gaussians."""
    kind = kind or rng.choice(["uniform", "ball", "gaussian", "covariance", "mixture"])
    if kind == "uniform":
        return rng.uniform(-1, 1, (n, d))
    if kind == "ball":
        x = rng.normal(size=(n, d))
        return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.random((n, 1)) ** (1 / d)
    if kind == "gaussian":
        return rng.normal(size=(n, d))
    if kind == "covariance":
        return rng.normal(size=(n, d)) @ matrix(rng, d, d)
    if kind == "mixture":
        k = int(rng.integers(2, 8))
        centres, scale = rng.normal(size=(k, d)) * 2, rng.uniform(0.2, 1, k)
        at = rng.choice(k, n, p=rng.dirichlet(np.ones(k)))
        return centres[at] + scale[at][:, None] * rng.normal(size=(n, d))
    raise ValueError(f"unknown points {kind!r}")


def matrix(rng: Rng, d_in: int, d_out: int, kind: str | None = None) -> np.ndarray:
    """Random matrices: Gaussian, weighted columns, given singular values, kernel of points, activated."""
    kind = kind or rng.choice(["gaussian", "weights", "singular", "kernel", "activation"])
    g = rng.normal(size=(d_in, d_out)) / np.sqrt(d_in)
    if kind == "gaussian":
        return g
    if kind == "weights":
        return g * log_scale_weights(rng, d_in)[:, None]
    if kind == "singular":
        u, s, v = np.linalg.svd(g, full_matrices=False)
        return u * (np.arange(1, len(s) + 1) ** -rng.uniform(0, 2.0)) @ v
    if kind == "kernel":
        a, b = rng.normal(size=(d_in, 3)), rng.normal(size=(d_out, 3))
        k = np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2) * np.sign(g)
        return k / np.maximum(np.linalg.norm(k, axis=0, keepdims=True), 1e-6)
    if kind == "activation":
        k = ACTIVATIONS[rng.choice(list(ACTIVATIONS))](g * np.sqrt(d_in))
        return k / np.maximum(np.linalg.norm(k, axis=0, keepdims=True), 1e-6)
    raise ValueError(f"unknown matrix {kind!r}")


def standardize(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x, "tanh": np.tanh, "relu": lambda x: np.maximum(x, 0), "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x), "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50))), "sin": np.sin, "square": lambda x: np.clip(x, -1e3, 1e3) ** 2, "abs": np.abs, "sign": np.sign, "heaviside": lambda x: (x > 0).astype(float), "rbf": lambda x: np.exp(-np.clip(x, -30, 30) ** 2),
    "exp": lambda x: np.exp(np.clip(x, -20, 5)), "sqrt_abs": lambda x: np.sqrt(np.abs(x)), "unit_interval": lambda x: (np.abs(x) <= 1).astype(float), "softplus": lambda x: np.logaddexp(0, x), "round": np.rint, "modulo": lambda x: x % 1.0,
    "log_abs": lambda x: np.log(np.maximum(np.abs(x), 1e-3)), "rank": lambda x: x.argsort(0).argsort(0) / max(1, len(x) - 1), "silu": lambda x: x / (1 + np.exp(-np.clip(x, -50, 50))),
}


# -- functions of a node: (rows, d_in) -> (rows, d_out)


def f_linear(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    return x @ matrix(rng, x.shape[1], d)


def f_quadratic(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    some = x[:, rng.permutation(x.shape[1])[: min(8, x.shape[1])]]
    return np.stack([np.einsum("ni,ij,nj->n", some, matrix(rng, some.shape[1], some.shape[1], "gaussian"), some) for _ in range(d)], axis=1)


def f_mlp(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    for _ in range(int(rng.integers(1, 4))):
        x = ACTIVATIONS[rng.choice(list(ACTIVATIONS))](standardize(x @ matrix(rng, x.shape[1], int(rng.integers(4, 33)))))
    return x @ matrix(rng, x.shape[1], d)


def f_trees(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    """A sum of oblivious trees: each level asks one question of all rows."""
    out = np.zeros((len(x), d))
    for _ in range(int(rng.integers(2, 12))):
        depth = int(rng.integers(1, 6))
        leaf = np.zeros(len(x), int)
        for _ in range(depth):
            c = rng.integers(0, x.shape[1])
            leaf = leaf * 2 + (x[:, c] > x[rng.integers(0, len(x)), c])
        out += rng.normal(size=(2**depth, d))[leaf]
    return out


def f_discretize(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    """The value of the nearest of some centres."""
    centres = x[rng.integers(0, len(x), int(rng.integers(2, 20)))]
    p = rng.choice([1.0, 2.0, 4.0])
    dist = (np.abs(x[:, None] - centres[None]) ** p).sum(-1)
    return rng.normal(size=(len(centres), d))[dist.argmin(axis=1)]


def f_gaussian_process(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    """Random Fourier features of a smooth kernel."""
    w = rng.standard_t(3, size=(x.shape[1], 128)) / log_uniform(rng, 0.5, 5) / np.sqrt(x.shape[1])
    return np.cos(x @ w + rng.uniform(0, 2 * np.pi, 128)) @ rng.normal(size=(128, d)) * np.sqrt(2 / 128)


def f_em(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    """Soft assignment to random components, each with a value."""
    centres = x[rng.integers(0, len(x), int(rng.integers(2, 10)))]
    z = -((x[:, None] - centres[None]) ** 2).sum(-1) / log_uniform(rng, 0.1, 3)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True)) @ rng.normal(size=(len(centres), d))


def f_product(rng: Rng, x: np.ndarray, d: int) -> np.ndarray:
    return standardize(f_linear(rng, x, d)) * standardize(SIMPLE[int(rng.integers(0, len(SIMPLE)))](rng, x, d))


SIMPLE = [f_linear, f_mlp, f_trees, f_gaussian_process]
FUNCTIONS = [f_linear, f_quadratic, f_mlp, f_trees, f_discretize, f_gaussian_process, f_em, f_product]


def combine(rng: Rng, parents: list[np.ndarray], d: int) -> np.ndarray:
    """A node from its parents: a function of all of them together, or functions of each, reduced."""
    if len(parents) == 1 or rng.random() < 0.5:
        return FUNCTIONS[int(rng.integers(0, len(FUNCTIONS)))](rng, standardize(np.concatenate(parents, axis=1)), d)
    each = np.stack([FUNCTIONS[int(rng.integers(0, len(FUNCTIONS)))](rng, standardize(p), d) for p in parents])
    how = rng.choice(["sum", "product", "max", "logsumexp"])
    if how == "sum":
        return each.sum(axis=0)
    if how == "product":
        return np.stack([standardize(e) for e in each]).prod(axis=0)
    return each.max(axis=0) if how == "max" else np.logaddexp.reduce(np.clip(each, -50, 50), axis=0)


# -- graphs


def random_dag(rng: Rng, n: int, offset: float = 0.0) -> list[list[int]]:
    """Parents of each node; edge i -> j (i < j) with probability sigmoid(offset + out_i + in_j), Cauchy terms."""
    a, b, c = rng.standard_cauchy() + offset, rng.standard_cauchy(n), rng.standard_cauchy(n)
    p = 1 / (1 + np.exp(-np.clip(a + b[:, None] + c[None], -50, 50)))
    return [[i for i in range(j) if rng.random() < p[i, j]] for j in range(n)]


def ancestors(parents: list[list[int]], nodes: set[int]) -> set[int]:
    out, todo = set(nodes), list(nodes)
    while todo:
        for p in parents[todo.pop()]:
            if p not in out:
                out.add(p)
                todo.append(p)
    return out


# -- converters from latent vectors to columns


def to_category(rng: Rng, v: np.ndarray, k: int) -> np.ndarray:
    """Whole numbers below k: by nearest centre, by largest of k scores, or by ranks of one direction."""
    how = rng.choice(["nearest", "softmax", "rank"])
    if how == "nearest":
        c = v[rng.integers(0, len(v), k)]
        return ((v[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1).astype(float)
    if how == "softmax":
        return (standardize(v) @ rng.normal(size=(v.shape[1], k)) + rng.gumbel(size=(len(v), k)) * rng.uniform(0, 0.5)).argmax(axis=1).astype(float)
    x = v @ rng.normal(size=v.shape[1])
    cuts = np.sort(x[rng.integers(0, len(x), k - 1)])
    return rng.permutation(k)[np.searchsorted(cuts, x)].astype(float)


def to_number(rng: Rng, v: np.ndarray) -> np.ndarray:
    x = standardize(v @ rng.normal(size=(v.shape[1], 1)))[:, 0]
    if rng.random() < 0.3:  # skewed, as by a Kumaraswamy curve of the ranks
        u = (x.argsort().argsort() + 0.5) / len(x)
        x = 1 - (1 - u ** log_uniform(rng, 0.3, 3)) ** log_uniform(rng, 0.3, 3)
    return x


def category_size(rng: Rng, most: int = 10) -> int:
    return int(min(most, 2 + rng.geometric(0.35)))


# -- models


@dataclass(frozen=True)
class Dataset:
    x: np.ndarray
    y: np.ndarray
    n_train: int
    categories: tuple[int, ...]  # of each column, 0 for numbers


def graph_table(rng: Rng, rows: int, features: int, max_nodes: int = 24) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """Columns and a target read off the nodes of a random graph whose ancestors overlap."""
    while True:
        n = int(log_uniform(rng, 3, max_nodes))
        parents = random_dag(rng, n, 1.0)
        at, target = rng.integers(0, n, features), int(rng.integers(0, n))
        if ancestors(parents, set(at.tolist())) & ancestors(parents, {target}):
            break
    live, value = ancestors(parents, {*at.tolist(), target}), {}
    for j in sorted(live):  # nodes that nothing reads are never made
        d = int(rng.integers(2, 9))
        v = points(rng, rows, d) if not parents[j] else combine(rng, [value[p] for p in parents[j]], d)
        value[j] = standardize(np.nan_to_num(v, nan=0.0, posinf=1e6, neginf=-1e6)) + rng.normal(size=v.shape) * log_uniform(rng, 1e-4, 0.3)
    cats = tuple(category_size(rng) if rng.random() < 0.25 else 0 for _ in range(features))
    x = np.stack([to_category(rng, value[int(a)], k) if k else to_number(rng, value[int(a)]) for a, k in zip(at, cats, strict=True)], axis=1)
    return x, to_number(rng, value[target]), cats


def layered_table(rng: Rng, rows: int, features: int, trees: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """Columns and a target sampled from the units of a random network, or of random trees."""
    h = points(rng, rows, int(rng.integers(2, max(3, features) + 1)))
    units = [h]
    for _ in range(int(rng.integers(2, 6))):
        d = max(features + 1, 8)
        h = f_trees(rng, h, d) if trees else ACTIVATIONS[rng.choice(list(ACTIVATIONS))](standardize(h @ matrix(rng, h.shape[1], d, "gaussian")))
        h = standardize(np.nan_to_num(h)) + rng.normal(size=h.shape) * log_uniform(rng, 1e-3, 0.3)
        units.append(h)
    every = np.concatenate(units[1:], axis=1)
    pick = rng.permutation(every.shape[1])[: features + 1]
    return every[:, pick[1:]], every[:, pick[0]], (0,) * features


def dummy_table(rng: Rng, rows: int, features: int) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    return rng.normal(size=(rows, features)), rng.normal(size=rows), (0,) * features


PRIORS = {"graph": graph_table, "mlp": layered_table, "tree": lambda rng, n, d: layered_table(rng, n, d, True), "dummy": dummy_table}


def classes_of(rng: Rng, y: np.ndarray, k: int) -> np.ndarray:
    """Classes from a real target: by the median for two, else by random boundaries in rank or value; labels shuffled."""
    if k == 2:
        c = (y > np.median(y)).astype(int)
    else:
        cuts = np.sort(y[rng.integers(0, len(y), k - 1)] if rng.random() < 0.5 else rng.normal(y.mean(), y.std() + 1e-9, k - 1))
        c = np.searchsorted(cuts, y)
    return rng.permutation(k)[c].astype(float)


def covered(y: np.ndarray, n_train: int) -> bool:
    """Train and test hold the same classes, at least two."""
    a, b = set(y[:n_train]), set(y[n_train:])
    return a == b and len(a) >= 2


def learnable(rng: Rng, x: np.ndarray, y: np.ndarray, draws: int = 200, trees: int = 24) -> bool:
    """Whether random trees, out of bag, beat the mean: share of bootstrap means of the gain at or below 0 under 5 %."""
    total, seen = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(trees):
        bag = rng.integers(0, len(y), len(y))
        out = np.setdiff1d(np.arange(len(y)), bag)
        if not len(out):
            continue
        leaf_in, leaf_out = np.zeros(len(bag), int), np.zeros(len(out), int)
        for _ in range(4):
            c = rng.integers(0, x.shape[1])
            cut = x[rng.integers(0, len(y)), c]
            leaf_in, leaf_out = leaf_in * 2 + (x[bag, c] > cut), leaf_out * 2 + (x[out, c] > cut)
        n = np.bincount(leaf_in, minlength=16)
        mean = np.where(n > 0, np.bincount(leaf_in, y[bag], 16) / np.maximum(n, 1), y[bag].mean())
        total[out] += mean[leaf_out]
        seen[out] += 1
    ok = seen > 0
    if ok.sum() < 10:
        return False
    gain = (y[ok].mean() - y[ok]) ** 2 - (total[ok] / seen[ok] - y[ok]) ** 2
    means = gain[rng.integers(0, len(gain), (draws, len(gain)))].mean(axis=1)
    return bool((means <= 0).mean() < 0.05)


def make_dataset(number: int, rows: int = 128, features: int = 8, classes: int = 0, seed: int = 0, prior: str = "mix", tries: int = 20, filter_tries: int = 6) -> tuple[np.ndarray, np.ndarray, int]:
    """(x, y, number of training rows) of dataset `number`. classes 0: regression. Unlearnable tables are replaced for the first tries."""
    d = min(features, feature_cap(rows))
    for attempt in range(tries):
        rng = np.random.default_rng([seed, number, attempt])
        kind = rng.choice(["graph", "mlp", "tree"]) if prior == "mix" else prior
        x, y, _ = PRIORS[kind](rng, rows, d)
        n_train = int(rows * rng.uniform(0.3, 0.9))
        keep = [j for j in range(d) if len(np.unique(x[:n_train, j])) > 1]
        x = x[:, keep + [j for j in range(d) if j not in keep]]
        x[:, len(keep) :] = 0.0  # constant columns become padding at the end
        y = standardize(y[:, None])[:, 0]
        if not np.isfinite(x).all() or not np.isfinite(y).all() or not keep:
            continue
        if kind != "dummy" and attempt < filter_tries and not learnable(rng, x[:, : len(keep)], y):
            continue
        if classes:
            for _ in range(10):
                c = classes_of(rng, y, classes)
                p = rng.permutation(rows)
                if covered(c[p], n_train):
                    return np.clip(x[p], -1e4, 1e4), c[p], n_train
            continue
        return np.clip(x, -1e4, 1e4), y, n_train
    rng = np.random.default_rng([seed, number, tries])
    x, y, _ = dummy_table(rng, rows, features)
    return x, (np.arange(rows) % classes).astype(float) if classes else y, rows // 2


def datasets(spark: SparkSession, n: int, rows: int = 128, features: int = 8, classes: int = 0, seed: int = 0, prior: str = "mix") -> DataFrame:
    """dataset_id, row_id, features, y, is_train of n datasets."""
    if prior not in (*PRIORS, "mix"):
        raise ValueError(f"unknown prior {prior!r}")

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                x, y, n_train = make_dataset(int(i), rows, features, classes, seed, prior)
                yield pd.DataFrame({"dataset_id": int(i), "row_id": np.arange(len(y), dtype=np.int32), "features": list(x), "y": y, "is_train": np.arange(len(y)) < n_train})

    parts = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, n, 1, parts).mapInPandas(run, "dataset_id long, row_id int, features array<double>, y double, is_train boolean")


def gaussian_tables(spark: SparkSession, n: int, rows: int, features: int, seed: int = 0) -> DataFrame:
    """The dummy prior in column expressions alone."""
    df = spark.range(n * rows).select(F.floor(F.col("id") / rows).cast("long").alias("dataset_id"), (F.col("id") % rows).cast("int").alias("row_id"))
    return df.withColumn("features", F.array(*(F.randn(seed + j) for j in range(features)))).withColumn("y", F.randn(seed + features))


def small_size(rng: Rng, drawn: int) -> int:
    """Replays small sizes: 5 % uniform below 1,000, 25 % log-uniform to 10,000, else as drawn."""
    u = rng.random()
    return int(rng.integers(200, 1000)) if u < 0.05 else int(log_uniform(rng, 1000, 10_000)) if u < 0.3 else drawn


def lr_schedule(step: int, total: int, warmup: int, peak: float = 1.0, kind: str = "cosine", floor: float = 0.0) -> float:
    """Learning rates by step: cosine, linear, polynomial or constant, after a linear warm-up."""
    if step < warmup:
        return peak * step / max(1, warmup)
    t = min(1.0, (step - warmup) / max(1, total - warmup))
    shape = {"cosine": 0.5 * (1 + math.cos(math.pi * t)), "linear": 1 - t, "polynomial": (1 - t) ** 2, "constant": 1.0}
    if kind not in shape:
        raise ValueError(f"unknown schedule {kind!r}")
    return floor + (peak - floor) * shape[kind]
