"""Ensemble views: permutations of features and classes, their configurations, and the averaging of what members say."""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import gather, inverse_permutation, softmax

#: Beyond this many elements a Latin square is replaced by random permutations.
LATIN_LIMIT = 4000


def latin_square(n: int, rng: random.Random) -> list[list[int]]:
    """n permutations in which every element takes every place once: shuffled rows, columns and symbols of a cyclic square."""
    rows, columns, symbols = list(range(n)), list(range(n)), list(range(n))
    for x in (rows, columns, symbols):
        rng.shuffle(x)
    return [[symbols[(r + c) % n] for c in columns] for r in rows]


def permutations(n_elements: int, n: int, method: str = "latin", seed: int | None = 0) -> list[list[int]]:
    """Permutations of range(n_elements): none, shift, random or latin. One alone is the identity."""
    identity = list(range(n_elements))
    if method not in ("none", "shift", "random", "latin"):
        raise ValueError(f"unknown shuffle method {method!r}")
    if n == 1 or method == "none":
        return [identity]
    rng = random.Random(seed)
    if method == "latin" and n_elements > LATIN_LIMIT:
        method = "random"
    if method == "shift":
        return [identity[i:] + identity[:i] for i in range(n_elements)]
    if method == "random":
        if n_elements <= 5:
            every = [list(p) for p in itertools.permutations(identity)]
            return rng.sample(every, min(n, len(every)))
        return [rng.sample(identity, n_elements) for _ in range(n)]
    return latin_square(n_elements, rng)


@dataclass(frozen=True)
class Member:
    """One view: number, normaliser, feature permutation, class permutation."""

    number: int
    norm: str
    features: tuple[int, ...]
    classes: tuple[int, ...] | None = None


def members(n: int, n_features: int, n_classes: int | None = None, norms: tuple[str, ...] = ("none", "power"), feature_method: str = "latin", class_method: str = "shift", seed: int = 42) -> list[Member]:
    """The first n of all (feature permutation, class permutation) pairs in a seeded order, each with every normaliser."""
    rng = random.Random(seed)
    feats = permutations(n_features, n, feature_method, seed)
    classes = permutations(n_classes, n, class_method, seed) if n_classes else [None]
    pairs = list(itertools.product(feats, classes))
    rng.shuffle(pairs)
    every = [(f, c, m) for f, c in pairs for m in norms]
    return [Member(i, m, tuple(f), tuple(c) if c else None) for i, (f, c, m) in enumerate(every[:n])]


def remap(member: Member, dropped: set[int]) -> Member:
    """A member's view when some features are masked: they go, and the others are renumbered."""
    left = [i for i in range(len(member.features)) if i not in dropped]
    at = {v: k for k, v in enumerate(left)}
    return Member(member.number, member.norm, tuple(at[i] for i in member.features if i not in dropped), member.classes)


def views(df: DataFrame, features: str, config: list[Member]) -> DataFrame:
    """Every row for every member, the feature array permuted. Rows are multiplied in place; nothing is shuffled."""
    each = F.array(*(F.struct(F.lit(m.number).alias("member"), gather(F.col(features), list(m.features)).alias(features)) for m in config))
    return df.withColumn("__view", F.explode(each)).select(*(c for c in df.columns if c != features), "__view.member", f"__view.{features}")


def shuffle_label(y: Column, perm: tuple[int, ...]) -> Column:
    return F.element_at(F.lit(list(perm)).cast("array<int>"), y + 1)


def unshuffle(outputs: Column, perm: tuple[int, ...]) -> Column:
    """Class outputs in the original order: out[k] = outputs[perm[k]]."""
    return gather(outputs, list(perm))


def average_logits(df: DataFrame, key: str, logits: str, n_classes: int, temperature: float = 0.9) -> DataFrame:
    """Mean of the members' logits for each key, and its softmax."""
    mean = df.groupBy(key).agg(*(F.avg(F.element_at(logits, k + 1)).alias(f"l{k}") for k in range(n_classes)))
    mean = mean.select(key, F.array(*(F.col(f"l{k}") for k in range(n_classes))).alias("logits"))
    return mean.withColumn("proba", softmax(F.col("logits"), temperature))


__all__ = ["Member", "average_logits", "inverse_permutation", "latin_square", "members", "permutations", "remap", "shuffle_label", "unshuffle", "views"]
