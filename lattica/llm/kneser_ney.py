"""Interpolated modified Kneser-Ney bigram model over words, counted in Spark and read by memory-mapping.

Counting is three shuffles of packed, sorted runs, each merged by shards that write sorted arrays into the shared folder:
word hashes with counts (a word's id is its place), bigrams (id before, id) with counts, and for every word the numbers
of different words before it and of bigrams seen once, twice and more often after it. Runs are aggregated before the
shuffle; the numbers of shards follow the size of the texts, every shard is a task of its own, and the bigrams of a word
that holds more than 1/(4*shards) of all tokens are spread over all shards. The driver sees a row a shard only. Workers map the arrays of the shared folder (of a local copy, where that folder is not a file
system they can map) and look up sorted queries.

P(v|u) = (c(uv) - D(c(uv))) / c(u) + g(u) P1(v), P1(v) = (b(v) - D'(b(v))) / B + g1 / (V + 1) with b(v) the number of
words before v, B the number of bigrams, and the three discounts of each level from its counts of counts. Tokens not in
the training texts share the last 1/(V + 1). All documents' probabilities include the end token; every text starts in a
begin context. The order is 2: texts of random words gain little from trigrams, which would quadruple the arrays.

Defined cases: a null text is empty, one end token. Without training rows every token has probability 1 (V = 0).
Repeated rows count and are scored as often as they come. At most 2^32 - 2 different words. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_words, lean, map_array, mix, pieces, save_array, shared_dir

#: Tokens gathered by a map task before it sends a run on.
FLUSH = 4_000_000
#: Tokens for which there is one shard of bigrams and, at some bytes a token, at least one of words.
SHARD_TOKENS, TOKEN_BYTES = 6_000_000, 6

_maps: dict = {}


def _runs(batches):
    """(shard, [blobs]) of rows sorted by shard."""
    now, held = None, []
    for b in batches:
        for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(blob.as_buffer().to_pybytes())
    if held:
        yield now, held


def _blob_rows(shards: list[int], blobs: list[bytes], size: int = 16):
    for i in range(0, len(shards), size):
        yield pa.RecordBatch.from_arrays([pa.array(shards[i : i + size], pa.int32()), pa.array(blobs[i : i + size], pa.binary())], names=["shard", "blob"])


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts in 9 bytes an entry; a count over 255 is several entries."""
    while counts.max(initial=0) > 255:
        over = counts > 255
        keys, counts = np.concatenate((keys, keys[over])), np.concatenate((np.where(over, 255, counts), counts[over] - 255))
        if len(keys) > 4_000_000:
            break
    return np.int64(len(keys)).tobytes() + keys.tobytes() + (counts.astype(np.uint8).tobytes() if counts.max(initial=0) <= 255 else counts.astype(np.int64).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    rest = len(blob) - 8 - 8 * n
    return np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint8 if rest == n else np.int64, n, 8 + 8 * n).astype(np.int64)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(b) for b in blobs]
    return _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _raw(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("text").cast("binary").alias("raw"))


class Reader:
    """Word ids, counts and bigram counts from the mapped arrays. meta: folder, bits (of word shards), offsets, least (tokens of a hot word), shards."""

    def __init__(self, meta: dict):
        self.meta, self.folder = meta, meta["folder"]
        self.offsets = np.array(meta["offsets"], np.int64)  # first id of each word shard, and the number of words
        self.words = int(self.offsets[-1])
        self.begin, self.end = self.words, self.words + 1
        self.hash = [map_array(self.folder, f"word-hash-{i}", np.uint64) if meta["offsets"][i] < meta["offsets"][i + 1] else np.empty(0, np.uint64) for i in range(len(self.offsets) - 1)]
        self.files: dict = {}

    def file(self, name: str, dtype) -> np.ndarray:
        if name not in self.files:
            self.files[name] = map_array(self.folder, name, dtype)
        return self.files[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes; -1 if unknown."""
        uniq, inverse = np.unique(hashes, return_inverse=True)
        out = np.full(len(uniq), -1, np.int64)
        cut = np.searchsorted((uniq >> np.uint64(64 - self.meta["bits"])).astype(np.int64) if self.meta["bits"] else np.zeros(len(uniq), np.int64), np.arange(len(self.hash) + 1))
        for i, known in enumerate(self.hash):
            q = uniq[cut[i] : cut[i + 1]]
            if len(q) and len(known):
                at = np.minimum(np.searchsorted(known, q), len(known) - 1)
                hit = known[at] == q
                out[cut[i] : cut[i + 1]][hit] = at[hit] + self.offsets[i]
        return out[inverse]

    def shard_of(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Shard of each bigram, sorted by the word before: by that word, or by both where it is a hot one."""
        h = mix(before.astype(np.uint64) + np.uint64(1))
        new = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))) if len(before) else np.zeros(0, np.int64)
        words = before[new]
        own = words < self.words
        count = np.full(len(words), self.meta["docs"], np.int64)  # that of the begin context
        count[own] = self.word_values(words[own], "word-n", np.int64)[:, 0]
        hot = np.repeat(count > self.meta["least"], np.diff(np.append(new, len(before))))
        h[hot] = mix(h[hot] ^ (after[hot].astype(np.uint64) + np.uint64(1)))
        return ((h >> np.uint64(32)) % np.uint64(self.meta["shards"])).astype(np.int64)

    def word_values(self, ids: np.ndarray, name: str, dtype, width: int = 1) -> np.ndarray:
        """Values stored by word id, of sorted ids (begin and end included, in the last shard)."""
        out = np.zeros((len(ids), width), np.int64)
        last = len(self.offsets) - 2
        cut = np.searchsorted(ids, self.offsets)
        cut[0], cut[-1] = 0, len(ids)
        for i in range(last + 1):
            q = ids[cut[i] : cut[i + 1]]
            if len(q):
                out[cut[i] : cut[i + 1]] = self.file(f"{name}-{i}", dtype).reshape(-1, width)[q - self.offsets[i]]
        return out

    def pairs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Counts of bigrams of known ids."""
        key = (before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        uniq, inverse = np.unique(key, return_inverse=True)
        shard = self.shard_of((uniq >> np.uint64(32)).astype(np.int64), (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out = np.zeros(len(uniq), np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.meta["shards"] + 1))
        for i in range(self.meta["shards"]):
            rows = order[cut[i] : cut[i + 1]]
            if len(rows):
                keys = self.file(f"pair-key-{i}", np.uint64)
                if len(keys):
                    q = uniq[rows]
                    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                    hit = keys[at] == q
                    n = self.file(f"pair-n-{i}", np.uint8)[at].astype(np.int64)
                    big = np.flatnonzero(hit & (n == 255))
                    if len(big):
                        where, real = self.file(f"pair-bigat-{i}", np.int64), self.file(f"pair-bign-{i}", np.int64)
                        n[big] = real[np.searchsorted(where, at[big])]
                    out[rows] = np.where(hit, n, 0)
        return out[inverse]


def reader(meta: dict) -> Reader:
    """The worker's reader of a folder, kept between tasks."""
    key = (meta["folder"], meta["shards"])
    if key not in _maps:
        _maps.clear()
        _maps[key] = Reader(meta)
    _maps[key].meta = meta  # the description grows as the fit goes on
    return _maps[key]


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = (max(0, v) for v in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) if a and b else 0.75 * min(k, 1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _words(rows: DataFrame, folder: str, bits: int) -> list:
    """Counts words into 2^bits sorted shards on disk. Returns (shard, words, tokens)."""

    def count(batches):
        held, size = [], 0

        def send():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted((key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64), np.arange((1 << bits) + 1))
            full = [i for i in range(1 << bits) if cut[i] < cut[i + 1]]
            yield from _blob_rows(full, [_pack(key[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]) for i in full])

        for b in batches:
            for _, data, off in pieces(b.column("raw")):
                h, _ = doc_words(data, off)
                held.append(h)
                size += len(h)
            if size >= FLUSH:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    def merge(batches):
        for shard, blobs in _runs(batches):
            key, n = _joined(blobs)
            save_array(folder, f"word-hash-{shard}", key)
            save_array(folder, f"word-n-{shard}", n)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(key)]), pa.array([int(n.sum())])], names=["shard", "words", "tokens"])

    runs = rows.mapInArrow(lean(count), "shard int, blob binary").repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard")
    return runs.mapInArrow(lean(merge), "shard int, words long, tokens long").collect()


def _bigrams(rows: DataFrame, meta: dict) -> tuple[list, list]:
    """Counts bigrams into sorted shards, and the words' numbers of neighbours. Returns counts of counts of both."""
    shards, n_words = meta["shards"], len(meta["offsets"]) - 1

    def count(batches):
        r, held, size = reader(meta), [], 0

        def send():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            part = r.shard_of((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(shards + 1))
            for i in range(shards):
                if cut[i] < cut[i + 1]:
                    yield from _blob_rows([i], [_pack(key[order[cut[i] : cut[i + 1]]], n[order[cut[i] : cut[i + 1]]])])

        for b in batches:
            for _, data, off in pieces(b.column("raw")):
                before, after, _ = sequence(r, data, off)
                held.append((before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))
                size += len(after)
            if size >= FLUSH:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    def merge(batches):
        r = reader(meta)
        for shard, blobs in _runs(batches):
            key, n = _joined(blobs)
            save_array(r.folder, f"pair-key-{shard}", key)
            save_array(r.folder, f"pair-n-{shard}", np.minimum(n, 255).astype(np.uint8))
            big = np.flatnonzero(n >= 255)
            save_array(r.folder, f"pair-bigat-{shard}", big.astype(np.int64))
            save_array(r.folder, f"pair-bign-{shard}", n[big])
            totals = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
            before, after = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
            stats = np.column_stack([np.add.reduceat((n == 1) if k == 1 else (n == 2) if k == 2 else (n >= 3), first).astype(np.uint32) for k in (1, 2, 3)])
            words, seen = np.unique(after, return_counts=True)
            rows_, blobs_ = [], []
            for kind, ids, values in ((b"a", before[first], stats), (b"b", words, seen.astype(np.uint32).reshape(-1, 1))):
                cut = np.searchsorted(ids, r.offsets)
                cut[0], cut[-1] = 0, len(ids)
                for i in range(n_words):
                    if cut[i] < cut[i + 1]:
                        rows_.append(i)
                        blobs_.append(kind + ids[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() + values[cut[i] : cut[i + 1]].tobytes())
            for b in _blob_rows([*rows_, -1], [*blobs_, np.array(totals, np.int64).tobytes()]):
                yield b

    def finish(batches):
        r = reader(meta)
        for shard, blobs in _runs(batches):
            if shard < 0:
                total = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([int(v)]) for v in total)], names=["shard", "n1", "n2", "n3", "n4", "total"])
                continue
            low = int(r.offsets[shard])
            high = int(r.offsets[shard + 1]) + (2 if shard == n_words - 1 else 0)
            after, before = np.zeros((high - low, 3), np.uint32), np.zeros(high - low, np.uint32)
            for b in blobs:
                width = 4 if b[:1] == b"a" else 2
                v = np.frombuffer(b[1:], np.uint32)
                n = len(v) // width
                at = v[:n].astype(np.int64) - low
                if width == 4:
                    after[at] += v[n:].reshape(n, 3)
                else:
                    before[at] += v[n:]
            save_array(r.folder, f"word-after-{shard}", after)
            save_array(r.folder, f"word-before-{shard}", before)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([int((before == k).sum())]) for k in (1, 2, 3, 4)), pa.array([int(before.sum(dtype=np.int64))])], names=["shard", "n1", "n2", "n3", "n4", "total"])

    runs = rows.mapInArrow(lean(count), "shard int, blob binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(lean(merge), "shard int, blob binary")
    done = runs.repartitionById(n_words + 1, F.pmod("shard", F.lit(n_words + 1))).sortWithinPartitions("shard").mapInArrow(lean(finish), "shard int, n1 long, n2 long, n3 long, n4 long, total long").collect()
    add = lambda rows: [sum(r[c] for r in rows) for c in ("n1", "n2", "n3", "n4", "total")]
    return add([r for r in done if r["shard"] < 0]), add([r for r in done if r["shard"] >= 0])


def sequence(r: Reader, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id before, id, offsets of n+1) of all tokens of the texts, each with its end token; -1 for unknown words."""
    h, at = doc_words(data, off)
    n = len(off) - 1
    ids = np.insert(r.ids(h), at[1:], r.end)
    ends = at + np.arange(n + 1)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[ends[:-1]] = r.begin
    return before, ids, ends


def fit(docs: DataFrame, learn: Column) -> dict:
    """Counts the rows that learn allows. Returns the model's description (its arrays lie in the shared folder)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex[:12]}"
    rows = _raw(docs.where(learn))
    n_docs, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
    bits = max(0, (max(partitions, size // (TOKEN_BYTES * SHARD_TOKENS)) - 1).bit_length())
    found = {r["shard"]: r for r in _words(rows, folder, bits)}
    offsets, tokens = [0], n_docs
    for i in range(1 << bits):
        offsets.append(offsets[-1] + (found[i]["words"] if i in found else 0))
        tokens += found[i]["tokens"] if i in found else 0
    if offsets[-1] + 2 >= 1 << 32:
        raise ValueError("more different words than 32-bit ids")
    meta = {"folder": folder, "bits": bits, "offsets": offsets, "docs": n_docs, "tokens": tokens, "shards": max(8, tokens // SHARD_TOKENS + 1)}
    meta["least"] = tokens / (4 * meta["shards"])
    if n_docs:
        pairs, before = _bigrams(rows, meta)
        meta |= {"pair_d": _discounts(pairs[:4]), "word_d": _discounts(before[:4]), "types": before[4], "before_n": before}
        d, (b1, b2, b3, _, _) = meta["word_d"], before
        known = offsets[-1] + 1
        meta["spread"] = (d[0] * b1 + d[1] * b2 + d[2] * (known - b1 - b2)) / before[4]
    return meta


def token_scores(r: Reader, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count in training, log10 probability) of each token after the one before it."""
    meta = r.meta
    if not meta["docs"]:
        return np.zeros(len(ids), np.int64), np.zeros(len(ids))
    uniq, inverse = np.unique(np.concatenate((ids, before)), return_inverse=True)
    some = uniq[uniq >= 0]
    pad = len(uniq) - len(some)
    full = lambda x: np.concatenate((np.zeros((pad, x.shape[1]), x.dtype), x))
    words = some[some < r.words]
    count = np.concatenate((r.word_values(words, "word-n", np.int64), np.full((len(some) - len(words), 1), meta["docs"])))  # begin and end come once a document
    lead = full(r.word_values(some, "word-before", np.uint32))[:, 0]
    after, count = full(r.word_values(some, "word-after", np.uint32, 3)), full(count)[:, 0]
    v = r.words + 1
    d = np.array([0.0, *meta["word_d"]])
    p1 = (lead - d[np.minimum(lead, 3)]) / meta["types"] + meta["spread"] / (v + 1)
    i, u = inverse[: len(ids)], inverse[len(ids) :]
    both = (ids >= 0) & (before >= 0)
    n = np.zeros(len(ids), np.int64)
    n[both] = r.pairs(before[both], ids[both])
    d = np.array([0.0, *meta["pair_d"]])
    total = count[u]
    seen = total > 0
    t = np.maximum(total, 1)
    p = np.where(seen, (n - d[np.minimum(n, 3)]) / t + (after[u] @ d[1:]) / t * p1[i], p1[i])
    return count[i], np.log10(p)


def score(docs: DataFrame, meta: dict, *keep: Column) -> DataFrame:
    """The kept columns (named c0, c1, ...), then n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows = _raw(docs, *(c.alias(f"c{i}") for i, c in enumerate(keep)))
    names, kinds = [f"c{i}" for i in range(len(keep))], dict(rows.dtypes)

    def run(batches):
        r = reader(meta)
        total, v = meta["tokens"], (r.words + 1) if meta["docs"] else 0
        for b in batches:
            for row, data, off in pieces(b.column("raw")):
                before, ids, ends = sequence(r, data, off)
                n, p = token_scores(r, before, ids)
                add = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731, B023
                base = np.log10((n + 0.1) / (total + 0.1 * (v + 1)))
                cols = [np.diff(ends), add((n > 0).astype(np.int64)), np.full(len(ends) - 1, total, np.int64), add(base), add(p)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(row, len(ends) - 1) for c in names), *map(pa.array, cols)], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(lean(run), "".join(f"{c} {kinds[c]}, " for c in names) + "n_tokens long, n_known long, train_tokens long, base_score double, score double")
