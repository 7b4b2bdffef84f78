"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into pieces; all pieces are packed by their length alone, so the plan is made
from a histogram of at most `capacity` counts: pieces above a third of the capacity are matched greedily, the longest
with the longest that still fits, at most two in a sequence; smaller ones, longest first, go to the fullest sequences
that can take them (best fit), and open new ones only when none can. Sequences with equal contents are one run of the
plan. Every piece then finds its place from its length and its rank among pieces of that length, so no group of pieces
is gathered anywhere: ranks come from counts by (length, salt).

Tokenising works on white-space separated chunks, where the tokenizer never joins them: each worker keeps the ids of the
chunks it has met (by 64-bit hash, at most CACHE of them) and asks the tokenizer for new ones only. Texts with the
marks of special tokens, and all texts where the tokenizer's ids depend on white space, are given to the tokenizer whole.

Defined cases: a null or empty text is the end token alone. Repeated rows are packed as often as they come. A null
doc_id is kept. Extra columns are ignored. With no rows the result is empty.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import hash_words, joined, lean, pieces as runs, stage

#: The tokenizer's file: a name in the folder of public tokenizers, or a path.
TOKENIZER = "word_bpe_49k.json"
#: Id that ends every document.
END = 0
#: Chunks whose ids a worker remembers.
CACHE = 2_000_000
#: Least salts of a length.
SALTS = 512

_state: dict = {}


class _Ids:
    """Ids of white-space separated chunks, by their hash."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hash, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        own = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: whether white space never matters, and whether A-Z count as a-z
        self.splits = all(own(gap.join(("the", "Of", "7", "!?", "é"))) == [i for v in ("the", "Of", "7", "!?", "é") for i in own(v)] for gap in (" ", "\n", "\t  ", "\r\n"))
        self.folds = own("the and ing q7x abcdefghijklmnopqrstuvwxyz") == own("THE AND ING Q7X ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            size.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)) if len(e.ids) else np.zeros(len(some), np.int64))
        return np.concatenate(ids), np.concatenate(size)

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end tokens, offsets of n+1 into them)."""
        n = len(off) - 1
        if not self.splits:
            raw = data.tobytes()
            own = [self.whole(raw[a:c]) for a, c in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.concatenate(own), np.concatenate(([0], np.cumsum([len(v) for v in own])))
        text = joined(data, off, 32)
        h, first = hash_words(text, self.folds)
        at = np.searchsorted(first, off + np.arange(n + 1))
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, uniq), max(0, len(self.hash) - 1))
        known = self.hash[place] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        start, size, ids = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64), self.ids
        start[known], size[known] = self.start[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = text.tobytes()
            words = [raw[a : a + 1 + _length(raw, a)].decode("utf-8", "replace") for a in first[where[new]].tolist()]
            got, count = self._new(words)
            start[new], size[new] = len(ids) + np.cumsum(count) - count, count
            ids = np.concatenate((ids, got))
            if len(self.hash) + len(new) > CACHE:
                self.hash, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
            else:
                both = np.concatenate((self.hash, uniq[new]))
                order = np.argsort(both, kind="stable")
                self.hash, self.start, self.size, self.ids = both[order], np.concatenate((self.start, start[new]))[order], np.concatenate((self.size, size[new]))[order], ids
        each, begin = size[inverse], start[inverse]
        total = np.concatenate(([0], np.cumsum(each)))
        flat = ids[np.repeat(begin - total[:-1], each) + np.arange(total[-1])]
        ends = total[at]  # ids before each document, without end tokens
        return np.insert(flat, ends[1:], np.uint32(END)), ends + np.arange(n + 1)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids + [END], np.uint32)


_SPACES = b" \t\n\x0b\x0c\r"


def _length(raw: bytes, at: int) -> int:
    """Bytes of the word at `at`, less one. The text always ends with a blank."""
    i = at + 1
    while raw[i] not in _SPACES:
        i += 1
    return i - at - 1


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each row's ids."""

    def run(batches):
        if tokenizer not in _state:
            _state[tokenizer] = _Ids(tokenizer)
        ids_of = _state[tokenizer]
        for b in batches:
            for row, data, off in runs(b.column("raw"), 1 << 21):
                ids, at = ids_of.of(data, off)
                raw = data.tobytes()
                marked = any(m in raw for m in ids_of.marks)
                number, piece, start, length, crc = [], [], [], [], []
                for i in range(len(off) - 1):
                    own = ids[at[i] : at[i + 1]]
                    if marked and any(m in raw[off[i] : off[i + 1]] for m in ids_of.marks):
                        own = ids_of.whole(raw[off[i] : off[i + 1]])
                    for k, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        number.append(row + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(np.ascontiguousarray(part, "<u4").data))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(number, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset in the sequence), sorted by length and first rank.

    Piece number r of a length belongs to the last row whose first rank is at most r.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank, out, sequences = np.zeros(capacity + 1, np.int64), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: runs (first sequence, count)

    def put(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        out.append((length, int(rank[length]), each, sequence, offset))
        rank[length] += n
        left[length] -= n

    third = capacity // 3
    for big in range(capacity, third, -1):
        while left[big]:
            fits = np.flatnonzero(left[third + 1 : min(big, capacity - big) + 1]) + third + 1
            if len(fits) and fits[-1] == big and left[big] == 1:
                fits = fits[:-1]
            if not len(fits):
                n = int(left[big])
                put(big, n, 1, sequences, 0)
                gaps[capacity - big].append((sequences, n))
            elif fits[-1] == big:
                n = int(left[big]) // 2
                put(big, 2 * n, 2, sequences, 0)
                gaps[capacity - 2 * big].append((sequences, n))
            else:
                mate = int(fits[-1])
                n = int(min(left[big], left[mate]))
                put(big, n, 1, sequences, 0)
                put(mate, n, 1, sequences, big)
                gaps[capacity - big - mate].append((sequences, n))
            sequences += n
    for small in range(third, 0, -1):
        room = small
        while left[small]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                each = capacity // small
                n = -(-int(left[small]) // each)
                first, free = sequences, capacity
                sequences += n
            else:
                (first, n), free = gaps[room].pop(), room
                each = free // small
            full = min(n, int(left[small]) // each)
            if full:
                put(small, full * each, each, first, capacity - free)
                gaps[free - each * small].append((first, full))
            if full < n and left[small]:
                some = int(left[small])
                put(small, some, some, first + full, capacity - free)
                gaps[free - some * small].append((first + full, 1))
                full += 1
            if full < n:
                gaps[free].append((first + full, n - full))
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    found = stage(token_pieces(docs, capacity, tokenizer), "pieces")
    salts = max(SALTS, found.count() // 20_000)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    rows = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    keys = (rows[:, 0].astype(np.uint64) << np.uint64(48)) | rows[:, 1].astype(np.uint64)

    def run(batches):
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64), side="right") - 1
            r = rows[at] if len(at) else rows[:0]
            k = rank - r[:, 1]
            sequence, offset = r[:, 3] + k // r[:, 2] if len(at) else k, r[:, 4] + (k % r[:, 2]) * length if len(at) else k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "rank"), pa.array(sequence), pa.array(offset)], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    kind = dict(found.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
