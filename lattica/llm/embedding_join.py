"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of t or more is a distance of at most eps = sqrt(2 - 2t). They are turned to
their principal axes (one pass sums the second moments, a matrix of the dimension's square), sorted by the grid cells of
side eps on the leading axes, and the sorted sequence is cut into intervals, each saved as arrays in the shared folder
with its box on the leading axes. Every interval finds its later partners by recursion over the sequence's halves,
skipping halves whose boxes lie more than eps apart; projections never lengthen a distance, so nothing that links is
skipped. An interval and a few partners are one piece of work: rows of numbers alone are dealt, and the worker maps the
arrays it needs, so no vector crosses a shuffle for a pair of intervals and the driver holds no list of them. Leaves are
skipped by their boxes in the same way, the rest are screened by matrix products in single precision with its error's
bound as slack, and what passes is decided in double precision.

How much is skipped depends on the vectors: where few axes hold most of the spread, most intervals lie apart; where all
directions are alike and eps is wider than the spread on each axis, as for vectors drawn at random, no partition by
boxes can skip anything, and the work grows with the square of the number of vectors.

Equal vectors are one weighted point, so groups of copies cost one row. Pieces of work return counts of links and, for
the components, a spanning forest of what they found, never the pairs.

Defined cases: null, zero and non-finite vectors, null components and empty vectors link with nothing; vectors of
another dimension than the most frequent one are compared among their own dimension. Rows that repeat a vec_id are
vectors of their own for n_links and share a component id. A null vec_id takes part and names a component only where all
members' ids are null; ids must be whole numbers. A threshold of 1 links vectors whose cosine rounds to 1. Extra columns
are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected, lean, map_array, save_array, shared_dir, stage

#: Leading axes of the grid and of the boxes.
AXES = 16
#: Vectors of an interval: the sequence is cut into about PARTS intervals of a size between the two bounds, and of at most BYTES.
PARTS, SMALLEST, LARGEST, BYTES = 24, 512, 16_384, 1 << 25
#: Partners of an interval in one piece of work, at most.
PARTNERS = 16
#: Vectors of a leaf.
LEAF = 256
#: Slack of comparisons of distances, and the least side of a cell.
_EDGE, _SIDE = 1e-9, 0.02
#: Points that stand for more rows than this, and a thousandth of all, get their labels by broadcast.
HEAVY = 1_000


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(points: DataFrame, dim: int) -> np.ndarray:
    """The leading principal axes, from sums of products over all points."""

    def sums(batches):
        total, s, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            x = _unit(_matrix(b.column("v"), dim))
            total, s, n = total + x.T @ x, s + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + dim + 1, dtype=np.int32)), pa.array(np.concatenate((total.ravel(), s, [float(n)])))], names=["i", "x"])

    found = points.select("v").mapInArrow(lean(sums), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    x = np.zeros(dim * dim + dim + 1)
    x[found["i"].to_numpy()] = found["x"].to_numpy()
    n, s = max(x[-1], 1.0), x[dim * dim : dim * dim + dim]
    spread = x[: dim * dim].reshape(dim, dim) / n - np.outer(s, s) / n / n
    _, vectors = np.linalg.eigh(spread)
    return vectors[:, ::-1][:, : min(AXES, dim)]


def _apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    """Whether two boxes lie more than eps apart."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > (eps + _EDGE) ** 2


def interval_pairs(boxes: list[tuple[np.ndarray, np.ndarray]], eps: float, only: int | None = None) -> list[tuple[int, int]]:
    """Pairs (i <= j) of intervals (with only: of that i) whose boxes are not provably apart: recursion over halves of the sequence."""
    n = len(boxes)
    memo: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a, b):
        if (a, b) not in memo:
            if b - a == 1:
                memo[a, b] = boxes[a]
            else:
                m = (a + b) // 2
                x, y = box(a, m), box(m, b)
                memo[a, b] = np.minimum(x[0], y[0]), np.maximum(x[1], y[1])
        return memo[a, b]

    out, todo = [], [(0, n, 0, n)] if n else []
    if only is not None:
        todo = [(only, only + 1, only, only + 1)] + ([(only, only + 1, only + 1, n)] if only + 1 < n else [])
    while todo:
        a, b, c, d = todo.pop()
        if (a, b) != (c, d) and _apart(box(a, b), box(c, d), eps):
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return out


def join_blocks(x: np.ndarray, px: np.ndarray, y: np.ndarray | None, py: np.ndarray | None, t: float):
    """Index pairs of linked rows of x and y (y None: of x with itself, i < j), in chunks. px, py: leading coordinates, in sequence order."""
    eps = math.sqrt(max(0.0, 2 - 2 * t))
    same = y is None
    y, py = (x, px) if same else (y, py)
    slack = np.float32(t - (x.shape[1] + 16) * 2.0**-22)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    starts = [np.arange(0, len(z), LEAF) for z in (x, y)]
    low, high = [np.minimum.reduceat(p, at) for p, at in zip((px, py), starts, strict=True)], [np.maximum.reduceat(p, at) for p, at in zip((px, py), starts, strict=True)]
    for i, a in enumerate(starts[0].tolist()):
        b = min(a + LEAF, len(x))
        gap = np.maximum(0, np.maximum(low[0][i] - high[1], low[1] - high[0][i]))
        live = (gap * gap).sum(axis=1) <= (eps + _EDGE) ** 2
        if same:
            live[:i] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], live.astype(np.int8), [0]))))
        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # runs of leaves that aren't apart
            for c in range(first * LEAF, min(last * LEAF, len(y)), 16 * LEAF):
                d = min(c + 16 * LEAF, last * LEAF, len(y))
                r, s = np.nonzero(x32[a:b] @ y32[c:d].T >= slack)
                r, s = r + a, s + c
                if same:
                    r, s = r[r < s], s[r < s]
                for g in range(0, len(r), 1 << 16):
                    u, v = r[g : g + (1 << 16)], s[g : g + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[u], y[v])
                    for k in np.flatnonzero(np.abs(near - t) <= _EDGE):  # at the threshold the exact sum decides
                        p, q = x[u[k]], y[v[k]]
                        near[k] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q))
                    if (keep := near >= t).any():
                        yield u[keep], v[keep]


def _spanning(r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges r-s of one leaf pair: (node, smallest node it reaches)."""
    nodes, at = np.unique(np.concatenate((r, s)), return_inverse=True)
    a, b = at[: len(r)], at[len(r) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(u: np.ndarray, v: np.ndarray, parent: dict[int, int]) -> None:
    """Adds edges to a union-find over row numbers."""
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent.setdefault(b, b) != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)


def _order(lead: np.ndarray, eps: float) -> np.ndarray:
    """Place of each row in the epsilon grid order: its cells on the leading axes, as one number (of as many axes as fit)."""
    side = max(eps, _SIDE)
    cell, each = np.floor((lead + 1) / side).astype(np.int64), int(2 / side) + 3
    key = np.zeros(len(cell), np.int64)
    for k in range(min(cell.shape[1], int(62 / math.log2(each)))):
        key = key * each + np.clip(cell[:, k], 0, each - 1)
    return key


def _links(points: DataFrame, dim: int, t: float) -> DataFrame:
    """points: pid, weight, v. Returns (pid, links, root): counts of linked weight, and edges pid-root of a spanning forest (root null: none)."""
    eps = math.sqrt(max(0.0, 2 - 2 * t))
    n, spark = points.count(), points.sparkSession
    size = min(LARGEST, max(SMALLEST, -(-n // PARTS)), max(LEAF, BYTES // (8 * dim)))
    axes = _axes(points, dim)
    kind = dict(points.dtypes)["v"]
    real = np.float32 if kind == "array<float>" else np.float64
    folder = f"{shared_dir(spark)}/sequence-{uuid.uuid4().hex[:12]}"

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("weight"), b.column("v"), pa.array(_order(_unit(_matrix(b.column("v"), dim)) @ axes, eps))], names=["pid", "weight", "v", "cell"])

    placed = points.mapInArrow(lean(place), f"pid long, weight long, v {kind}, cell long")
    ordered = placed.repartitionByRange(max(1, -(-n // size)), "cell", "pid").sortWithinPartitions("cell", "pid")

    def cut(batches):
        """Saves the intervals of a partition, at most `size` rows each, and gives their names and boxes."""
        from pyspark import TaskContext

        base, held, rows, k = TaskContext.get().partitionId() << 24, [], 0, 0

        def save(table):
            v = np.asarray(table.column("v").combine_chunks().flatten(), dtype=real).reshape(-1, dim)
            lead = _unit(v.astype(np.float64)) @ axes
            for part, array in (("v", v), ("pid", np.asarray(table.column("pid"), np.int64)), ("weight", np.asarray(table.column("weight"), np.int64))):
                save_array(folder, f"{part}-{base + k}", array)
            return pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([lead.min(axis=0).tolist()]), pa.array([lead.max(axis=0).tolist()])], names=["name", "low", "high"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= size:
                t_ = pa.Table.from_batches(held)
                yield save(t_.slice(0, size))
                k, rest = k + 1, t_.slice(size)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield save(pa.Table.from_batches(held))

    boxes = stage(ordered.mapInArrow(lean(cut), "name long, low array<double>, high array<double>"), "boxes")
    m = boxes.count()

    def index(batches):
        """Saves the boxes in the sequence's order: 2 * AXES + 1 numbers an interval."""
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        save_array(folder, "names", np.asarray(table.column("name"), np.int64))
        for side in ("low", "high"):
            save_array(folder, side, np.asarray(table.column(side).combine_chunks().flatten(), np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows])], names=["n"])

    boxes.coalesce(1).sortWithinPartitions("name").mapInArrow(lean(index), "n long").count()
    each = min(PARTNERS, max(1, m // 8))

    def deal(batches):
        low, high = (map_array(folder, side, np.float64).reshape(m, -1) for side in ("low", "high"))
        all_boxes = [(low[i], high[i]) for i in range(m)]
        for b in batches:
            for i in b.column("id").to_pylist():
                mates = sorted(j for _, j in interval_pairs(all_boxes, eps, i))
                some = [mates[g : g + each] for g in range(0, len(mates), each)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array(some, pa.list_(pa.int64()))], names=["one", "others"])

    work = stage(spark.range(0, m, 1, max(1, min(m, 256))).mapInArrow(lean(deal), "one long, others array<long>"), "work")

    def load(name):
        v = _unit(map_array(folder, f"v-{name}", real).reshape(-1, dim).astype(np.float64))
        return v, v @ axes, map_array(folder, f"pid-{name}", np.int64), map_array(folder, f"weight-{name}", np.int64)

    def compare(one, others, names):
        x, lead, pid, weight = load(names[one])
        for j in others:
            y, lead_y, pid_y, weight_y = (None, None, pid[:0], weight[:0]) if j == one else load(names[j])
            ids, count, parent = np.concatenate((pid, pid_y)), np.zeros(len(pid) + len(pid_y), np.int64), {}
            for r, s in join_blocks(x, lead, y, lead_y, t):
                mass, s = (weight if y is None else weight_y)[s], s if y is None else s + len(pid)
                count += (np.bincount(r, mass, len(ids)) + np.bincount(s, weight[r], len(ids))).astype(np.int64)
                _forest(*_spanning(r, s), parent)
            hit = np.flatnonzero(count)
            root = []
            for i in hit.tolist():
                while parent[i] != i:
                    i = parent[i]
                root.append(int(ids[i]))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(root, pa.int64())], names=["pid", "links", "root"])

    def run(batches):
        names = map_array(folder, "names", np.int64).tolist()
        for b in batches:
            for one, others in zip(b.column("one").to_pylist(), b.column("others").to_pylist(), strict=True):
                yield from compare(one, others, names)

    pieces = work.count()
    tasks = min(pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces // 8))
    return work.repartition(max(1, tasks)).mapInArrow(lean(run), "pid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row a row of vectors."""
    v = F.col(vector_col)
    inner = dict(vectors.dtypes)[vector_col]
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(good, F.lit(False))
    kind = inner if inner in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, v).cast(kind).alias("v"))
    # equal vectors are one point; adding 0 makes -0 and 0 equal
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1])))
    points = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("wide"), "v").alias("k2")]  # 128 bits name a vector where its label is joined
    points = stage(points.withColumn("pid", F.monotonically_increasing_id()).select("*", F.size("v").alias("dim"), *key), "points")
    found = None
    for (dim,) in sorted(points.select("dim").distinct().collect()):
        part = _links(points.where(F.col("dim") == dim).select("pid", "weight", "v"), dim, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stage(found, "links")
    total = links.groupBy("pid").agg(F.sum("links").alias("links"))
    comp = stage(connected(links.where("pid <> root").select(F.col("pid").alias("u"), F.col("root").alias("v")).distinct()), "linked")
    small = points.drop("v", "dim")
    named = small.join(comp.select(F.col("node").alias("pid"), F.col("component").alias("comp")), "pid")
    least = named.groupBy("comp").agg(F.min("low").alias("least"))
    least = F.broadcast(least) if comp.select("component").distinct().count() <= 1_000_000 else least
    label = small.join(named.join(least, "comp").select("pid", "least"), "pid", "left").join(total, "pid", "left")
    label = stage(label.select("k1", "k2", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "label")
    good = rows.where("v is not null").select("vec_id", *key)
    # vectors that many rows share, at most a thousand of them, would each be one hot key of the join
    heavy = max(HEAVY, rows.count() // 1000)
    some = F.broadcast(label.where(F.col("weight") > heavy))
    out = good.join(some, ["k1", "k2"]).unionByName(good.join(some.select("k1", "k2"), ["k1", "k2"], "left_anti").join(label.where(F.col("weight") <= heavy), ["k1", "k2"]))
    out = out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(alone)
