"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character classes, its length, mean word length and
share of distinct and of doubled words, together with the same features of the line before and the line after. The
field is fit by gradient steps on a bounded sample of labelled documents: SAMPLE of each label, chosen by a hash, and of
each at most LINES lines in a row, from a place chosen by a hash. Lines begin with their document's label, from which no
transitions can be learnt; after that first fit, on the lines' own features alone, lines that are surely of the other label change it
(in bad documents at most a quarter of them), and the whole field is fit, so that it learns where labels change inside a
document; this is done ROUNDS times. A document's score is the mean of its lines' forward-backward marginals of `good`,
weighted by line length in bytes.

Defined cases: a null or empty text is one empty line. A doc_id with several labels counts with their rounded mean;
labels other than 0 and 1, and null ones, are left out. Without any label of one kind, the field learns the other.
Without labels all scores are 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_fraction, hash_words, joined, lean, pieces

#: Labelled documents of each label that are learnt from.
SAMPLE = 1_500
#: Lines of each that are learnt from.
LINES = 400
#: Times that labels change, and how sure a fit must be to change a line's label.
ROUNDS, SURE = 2, 0.7
#: Gradient steps, their size, and the L2 weight.
STEPS, STEP, RIDGE = 250, 0.1, 1e-3
#: Score from which a document counts as good.
CUT = 0.3
#: Character classes of a line, as shares of its bytes (fixed values); bytes from 128 on are a class of their own.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "|", "#$%&*", "@^~+=<>{}[]\\/_", "!?", ".,;:", "'\"()-`")
WIDTH = len(CLASSES) + 5
#: Bytes whose classes are counted in one step.
STEP_BYTES = 1 << 20
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _table:
        t = np.full(256, len(CLASSES) + 1, np.int64)
        t[128:] = len(CLASSES)
        for i, c in enumerate(CLASSES):
            t[list(c.encode())] = i
        _table.append(t)
    return _table[0]


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, offsets of n+1 of the documents' lines)."""
    n = len(off) - 1
    text = joined(data, off, 10)
    ends = np.flatnonzero(text == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    docs = np.searchsorted(ends, (off + np.arange(n + 1))[1:] - 1, side="right")
    docs = np.concatenate(([0], docs))
    k = len(CLASSES) + 2
    count, table = np.zeros((len(ends), k), np.int64), _classes()
    for at in range(0, len(text), STEP_BYTES):  # a byte's line number takes eight bytes
        part = text[at : at + STEP_BYTES]
        line = np.cumsum(part == 10) - (part == 10)
        base = int(np.searchsorted(ends, at))
        many = int(line[-1]) + 1
        count[base : base + many] += np.bincount(line * k + table[part], minlength=many * k).reshape(-1, k)
    count = count[:, : k - 1]
    h, first = hash_words(text)
    line = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(line, minlength=len(ends))
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(ends))
    again = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(ends)) if len(h) > 1 else np.zeros(len(ends))
    letters = size - count[:, 3]
    one, w1 = np.maximum(size, 1), np.maximum(words, 1)
    x = np.column_stack((count / one[:, None], np.log1p(size) / 5, np.minimum(letters / w1, 40) / 10, distinct / w1, again / w1))
    return x.astype(np.float32), size, docs


def with_neighbours(x: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, whether there are such lines, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[docs[:-1]], last[docs[1:] - 1] = True, True
    before[first], after[last] = 0, 0
    return np.column_stack((x, before, after, first, last, np.ones(len(x)))).astype(np.float32)


def _groups(lengths: np.ndarray):
    """Documents in groups of like length, so that padding stays within a factor of 2."""
    level = np.frexp(np.maximum(lengths, 1).astype(float))[1]
    for v in np.unique(level):
        yield np.flatnonzero(level == v)


def marginals(unary: np.ndarray, docs: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of `good` of each line, expected counts of the four transitions, and the sum of log Z. unary: log-potential of good against bad."""
    lengths = np.diff(docs)
    out, pairs, log_z = np.zeros(len(unary)), np.zeros((2, 2)), 0.0
    e = np.exp(t)
    for g in _groups(lengths):
        m, longest = len(g), int(lengths[g].max())
        u = np.zeros((longest, m, 2))
        at = docs[g][None, :] + np.arange(longest)[:, None]
        valid = np.arange(longest)[:, None] < lengths[g][None, :]
        u[:, :, 1][valid] = unary[at[valid]]
        top = u.max(axis=2, keepdims=True)
        p = np.exp(u - top)
        f, scale = np.zeros((longest, m, 2)), np.ones((longest, m))
        for i in range(longest):
            v = p[i] if i == 0 else (f[i - 1] @ e) * p[i]
            v = np.where(valid[i][:, None], v, f[i - 1] if i else v)
            s = np.where(valid[i], v.sum(axis=1), 1.0)
            f[i], scale[i] = v / s[:, None], s
        log_z += float(np.log(scale).sum() + top[:, :, 0][valid].sum())
        b = np.ones((m, 2))
        for i in range(longest - 1, -1, -1):
            q = f[i] * b
            q /= q.sum(axis=1, keepdims=True)
            out[at[i][valid[i]]] = q[valid[i], 1]
            if i:
                live = valid[i]
                nxt = p[i] * b
                if live.any():
                    joint = f[i - 1][live][:, :, None] * e[None] * nxt[live][:, None, :]
                    pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = nxt @ e.T
                b = np.where(live[:, None], back / back.sum(axis=1, keepdims=True), b)
    return out, pairs, log_z


class Field:
    """The fitted field: weights over standardised features, and transition potentials."""

    def __init__(self, x: np.ndarray, docs: np.ndarray, label: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(3 * WIDTH + 3), np.ones(3 * WIDTH + 3))
        self.mean[-1], self.scale[-1] = 0, 1
        self.w, self.t = np.zeros(3 * WIDTH + 3), np.zeros((2, 2))
        if not len(x):
            return
        z, of = (x - self.mean) * self.scale, np.repeat(np.arange(len(docs) - 1), np.diff(docs))
        first = label[of].astype(float)
        self._fit(z, docs, first, STEPS, alone=True)
        last = first
        for _ in range(ROUNDS):
            p, _, _ = marginals(z @ self.w, docs, self.t)
            y = np.where((first == 1) & (p < 1 - SURE), 0.0, np.where((first == 0) & (p > SURE), 1.0, first))
            # of a bad document's lines, the worst three quarters stay bad
            order = np.lexsort((p, of))
            rank = np.empty(len(p), np.int64)
            rank[order] = np.arange(len(p)) - docs[:-1][of[order]]
            y[(first == 0) & (4 * rank < 3 * np.diff(docs)[of])] = 0.0
            if (y == last).all() and self.t.any():
                break
            self._fit(z, docs, y, STEPS)
            last = y

    def _fit(self, z: np.ndarray, docs: np.ndarray, y: np.ndarray, steps: int, alone: bool = False) -> None:
        """alone: neither neighbours' features nor transitions."""
        inner = np.ones(len(y), bool)
        inner[docs[:-1]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
        n = len(docs) - 1
        # every document weighs the same, whatever its number of lines
        share = np.repeat(1 / np.diff(docs), np.diff(docs))
        m1, m2 = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        both = np.concatenate((self.w, self.t.ravel()))
        for i in range(1, steps + 1):
            p, pairs, _ = marginals(z @ self.w, docs, self.t)
            grad = np.concatenate((z.T @ ((y - p) * share) / n - RIDGE * self.w, ((seen - pairs) / max(1, inner.sum()) - 10 * RIDGE * self.t).ravel()))
            if alone:
                grad[WIDTH : len(self.w) - 1] = grad[len(self.w) :] = 0
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            both = both + STEP * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
            self.w, self.t = both[:-4], both[-4:].reshape(2, 2)

    def lines(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal of `good` of each line, bytes of each line, offsets of n+1 of the documents' lines)."""
        x, size, docs = line_features(data, off)
        p, _, _ = marginals(((with_neighbours(x, docs) - self.mean) * self.scale) @ self.w, docs, self.t)
        return p, size, docs

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        p, size, docs = self.lines(data, off)
        weight = np.maximum(size, 1).astype(float)
        return np.add.reduceat(p * weight, docs[:-1]) / np.add.reduceat(weight, docs[:-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Field:
    """Fits on SAMPLE documents of each label among the rows that learn (over doc_id) allows."""
    known = labels.where(F.col("quality").isin(0, 1)).where(learn).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    keep = F.lit(0.0)
    for v, n in counts.items():
        keep = F.when(F.col("quality") == v, min(1.0, SAMPLE / n)).otherwise(keep)
    chosen = known.where(hash_fraction(F.col("doc_id").cast("string"), F.lit("quality")) < keep).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most about 2 * SAMPLE rows

    def run(batches):
        for b in batches:
            for row, data, off in pieces(b.column("raw"), 1 << 19):
                x, _, lines = line_features(data, off)
                x, blobs = with_neighbours(x, lines), []
                for a, c, doc in zip(lines[:-1].tolist(), lines[1:].tolist(), b.column("doc_id").slice(row, len(lines) - 1).to_pylist(), strict=True):
                    a += zlib.crc32(f"line {doc}".encode()) % max(1, c - a - LINES + 1)
                    blobs.append(x[a : min(c, a + LINES)].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(blobs)), b.column("label").slice(row, len(blobs)), pa.array(blobs)], names=["doc_id", "label", "x"])

    got = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("__label").alias("label"), F.col("text").cast("binary").alias("raw")).mapInArrow(lean(run), "doc_id string, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"])
    parts = [np.frombuffer(v, np.float32).reshape(-1, 3 * WIDTH + 3) for v in got["x"]]
    at = np.concatenate(([0], np.cumsum([len(v) for v in parts]))).astype(np.int64)
    return Field(np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, 3 * WIDTH + 3)), at, got["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Field, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id by default), then score and predicted."""
    keep = keep or ["doc_id"]
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").cast("binary").alias("raw"))
    names, kinds = [f"c{i}" for i in range(len(keep))], dict(rows.dtypes)

    def run(batches):
        for b in batches:
            for row, data, off in pieces(b.column("raw"), 1 << 19):
                s = np.clip(model.score(data, off), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(row, len(s)) for c in names), pa.array(s)], names=[*names, "score"])

    out = rows.mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def label_lines(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, line (from 0), n_bytes, good (the line's marginal) and label (1 good, 0 bad) of every line of every row."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))

    def run(batches):
        for b in batches:
            for row, data, off in pieces(b.column("raw"), 1 << 19):
                p, size, lines = model.lines(data, off)
                n = np.diff(lines)
                own = b.column("doc_id").slice(row, len(n)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(len(p)) - np.repeat(lines[:-1], n)), pa.array(size.astype(np.int64)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "line", "n_bytes", "good", "label"])

    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, line long, n_bytes long, good double, label int")
