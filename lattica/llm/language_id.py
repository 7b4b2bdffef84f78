"""Language identification in two steps: the language family, then languages within it by one-versus-one linear SVMs.

Features are frequencies of byte bigrams and trigrams of the lower-cased (A-Z) whole text, hashed to DIM places. Both
steps vote over pairwise linear SVMs (squared hinge, L2); a pair's margin becomes a probability, and a class's score is
its mean probability against the others. The text's score is the family's score times the language's within it.

The classifier is fit on a bounded sample of labelled rows: SAMPLE whole texts a language, chosen by a hash, fewer where
languages are so many that these would be more than TOTAL texts; a pair of families takes FAMILY texts of each, spread
over its languages. Each pair's rows and products are made when it is its turn. Languages outside the table of families
are families of their own.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with a null lang are never learnt
from; with one learnt language every text with a letter gets it, with none all texts are `und`. Repeated rows are
scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_fraction, lean, pieces

#: Places of the hashed n-grams.
DIM = 1 << 13
#: Texts of each language that are learnt from, of all languages, and of each family in a pair of families.
SAMPLE, TOTAL, FAMILY = 400, 20_000, 1_200
#: L2 weight of the SVMs.
RIDGE = 1.0
#: Families of languages by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt ug",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv su mg",
    "sinitic": "zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def _places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the bigram and the trigram at each byte."""
    b = data.astype(np.uint32)
    b = b + ((b >= 65) & (b <= 90)) * np.uint32(32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65599) + b[2:]
    shift = np.uint32(32 - DIM.bit_length() + 1)
    return ((two * np.uint32(2654435761)) >> shift).astype(np.int64), ((three * np.uint32(2246822519) + np.uint32(374761393)) >> shift).astype(np.int64)


def profiles(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Frequencies of hashed bigrams and trigrams of each text, one row a text."""
    out = np.zeros((len(off) - 1, DIM), np.float32)
    if len(data) < 2:
        return out
    two, three = _places(data)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if b - a > 1:
            found = np.bincount(two[a : b - 1], minlength=DIM)
            if b - a > 2:
                found += np.bincount(three[a : b - 2], minlength=DIM)
            out[i] = found / np.float32(2 * (b - a) - 3 if b - a > 2 else 1)
    return out


def _svm(gram: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM in the primal by Newton steps over the active set: coefficients of the rows, and the offset."""
    n = len(y)
    active, beta, offset = np.arange(n), np.zeros(n), 0.0
    for _ in range(30):
        m = len(active)
        a = np.zeros((m + 1, m + 1))
        a[:m, :m] = gram[np.ix_(active, active)]
        a[np.arange(m), np.arange(m)] += RIDGE
        a[m, :m] = a[:m, m] = 1
        a[m, m] = -1e-9
        x = np.linalg.solve(a, np.append(y[active], 0))
        beta = np.zeros(n)
        beta[active], offset = x[:m], x[m]
        new = np.flatnonzero(y * (gram @ beta + offset) < 1)
        if len(new) == m and (new == active).all() or not len(new):
            break
        active = new
    return beta, float(offset)


class Hierarchy:
    """The fitted classifier: pairwise weights between families, and between the languages of each."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], lang: list[str]):
        """x: places and values of each text's profile."""
        self.langs = sorted(set(lang))
        family = [_FAMILY.get(v, f"own:{v}") for v in self.langs]
        self.families = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == g] for g in self.families]
        of = np.array([self.langs.index(v) for v in lang], np.int64)
        kin = np.array([self.families.index(family[i]) for i in of], np.int64)
        total, squares = np.zeros(DIM), np.zeros(DIM)
        for at, value in x:
            total[at] += value
            squares[at] += value.astype(np.float64) ** 2
        n = max(1, len(x))
        scale = 1 / np.maximum(np.sqrt(np.maximum(0, squares / n - (total / n) ** 2)), 1e-5)
        centre = total / n * scale
        self.pairs: list[tuple[int, int, int]] = []  # (group, or -1 between families; a; b)
        weights, offsets = [], []
        turn = np.empty(len(of), np.int64)  # place of each text among those of its language: the first of all of them make a family's share
        for v in range(len(self.langs)):
            own = np.flatnonzero(of == v)
            turn[own] = np.arange(len(own))
        jobs = [(-1, a, b, kin) for a in range(len(self.families)) for b in range(a)] + [(g, a, b, of) for g, m in enumerate(self.members) for a in m for b in m if b < a]
        for g, a, b, label in jobs:
            sides = [np.flatnonzero(label == v) for v in (a, b)]
            if g < 0:
                sides = [np.sort(v[np.argsort(turn[v], kind="stable")[:FAMILY]]) for v in sides]
            rows = np.sort(np.concatenate(sides))
            z = np.zeros((len(rows), DIM))
            for k, i in enumerate(rows.tolist()):
                at, value = x[i]
                z[k, at] = value * scale[at]
            z -= centre
            beta, offset = _svm(z @ z.T / DIM, np.where(label[rows] == a, 1.0, -1.0))
            w = z.T @ beta / DIM
            weights.append(w * scale)
            offsets.append(offset - float(w @ centre))
            self.pairs.append((g, a, b))
        self.weights = np.array(weights, np.float32).T.reshape(DIM, len(jobs))
        self.offsets = np.array(offsets)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each profile."""
        p = 1 / (1 + np.exp(-2 * np.clip(x @ self.weights + self.offsets, -50, 50)))
        fam, lang = np.zeros((len(x), len(self.families))), np.zeros((len(x), len(self.langs)))
        for k, (g, a, b) in enumerate(self.pairs):
            to = fam if g < 0 else lang
            to[:, a] += p[:, k]
            to[:, b] += 1 - p[:, k]
        fam /= max(1, len(self.families) - 1)
        if len(self.families) == 1:
            fam[:] = 1
        best = fam.argmax(axis=1)
        out, score = np.zeros(len(x), np.int64), fam[np.arange(len(x)), best]
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(best == g)
            if len(m) > 1:
                part = lang[np.ix_(rows, m)] / (len(m) - 1)
                top = part.argmax(axis=1)
                out[rows], score[rows] = np.array(m)[top], score[rows] * part[np.arange(len(rows)), top]
            else:
                out[rows] = m[0]
        return out, score


def fit(docs: DataFrame, learn: Column) -> Hierarchy:
    """Fits on SAMPLE texts a language (all if there are fewer) of the rows of docs that learn allows."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = min(SAMPLE, max(1, TOTAL // max(1, len(counts))))
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sorted(counts.items())], "lang string, __share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(hash_fraction(F.col("doc_id").cast("string"), F.lit("language")) < F.col("__share"))

    def run(batches):
        for b in batches:
            for row, data, off in pieces(b.column("raw"), 1 << 20):
                for at in range(0, len(off) - 1, 512):
                    x = profiles(data[off[at] : off[min(at + 512, len(off) - 1)]], off[at : at + 513] - off[at])
                    full = [np.flatnonzero(v) for v in x]
                    yield pa.RecordBatch.from_arrays([b.column("lang").slice(row + at, len(x)), b.column("doc_id").slice(row + at, len(x)), pa.array([i.astype(np.uint16).tobytes() for i in full]), pa.array([v[i].tobytes() for v, i in zip(x, full, strict=True)])], names=["lang", "doc_id", "at", "value"])

    got = chosen.select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(lean(run), "lang string, doc_id string, at binary, value binary").toPandas()
    got = got.sort_values(["lang", "doc_id", "at", "value"])
    x = [(np.frombuffer(at, np.uint16), np.frombuffer(value, np.float32)) for at, value in zip(got["at"], got["value"], strict=True)]
    return Hierarchy(x, got["lang"].tolist())


def identify(docs: DataFrame, model: Hierarchy, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id by default), then lang_pred and score."""
    keep = keep or ["doc_id"]
    cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*cols, F.col("text").cast("binary").alias("raw"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    names = [f"c{i}" for i in range(len(keep))]
    kinds = dict(rows.dtypes)
    langs = model.langs

    def run(batches):
        for b in batches:
            for row, data, off in pieces(b.column("raw"), 1 << 20):
                for at in range(0, len(off) - 1, 512):
                    x = profiles(data[off[at] : off[min(at + 512, len(off) - 1)]], off[at : at + 513] - off[at])
                    some = [b.column(c).slice(row + at, len(x)) for c in [*names, "letters"]]
                    letters = np.asarray(some.pop())
                    if langs:
                        best, score = model.predict(x)
                        pred = [langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    else:
                        score, pred = np.zeros(len(x)), ["und"] * len(x)
                    yield pa.RecordBatch.from_arrays([*some, pa.array(pred), pa.array(np.where(letters, score, 0.0))], names=[*names, "lang_pred", "score"])

    out = rows.mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in names) + ", lang_pred string, score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
