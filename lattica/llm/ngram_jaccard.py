"""N-gram Jaccard join by parity sketches.

A text's set is its distinct w-word shingles (hashed to 64 bits). Each set is drawn as a parity sketch: a very wide bit
vector in which every shingle flips one bit, so the Hamming distance of two sketches never exceeds the size of the
symmetric difference. For sizes up to `hi` and a similarity of t, that difference is at most d = 2*hi*(1-t)/(1+t); with
the sketch cut into d + 1 + s blocks, two sets that link agree on at least 1 + s whole blocks (pigeonhole), so that each
may leave out its s lightest ones.
Blocks are joined per size band; agreeing sets are candidates, and every candidate is verified on its real shingles.

Shape of the work, for sets A, B, ... of one block value ("bucket"):
 1. within a map task and then within a shard, a bucket sends star edges (smallest set, other set) instead of all pairs;
 2. edges are verified on whole texts, and components are found;
 3. buckets that still hold two or more components are joined whole, in blocks of at most BLOCK sets, where a narrow
    parity sketch's Hamming distance drops what can't link; the rest is verified too, the nearest that would join two
    components first, then all others that still lie between components. These others are sent as pairs; only where a
    piece of work has more than LEFT of them a set, its bucket is sent instead and, if still open, joined again. So no
    link between different texts is lost, and groups of copies are never expanded.
Narrow sketches have bits in proportion to the set, so that they tell large sets apart as well as small ones; of two
widths the wider one is folded. Pairs are verified by hubs: a hub's text meets those of up to BLOCK partners in one
piece of work, and each text crosses one shuffle for each of its hubs.

Defined cases: null and empty texts (or white space only) have no shingles, link with nothing and are their own
component. Texts of fewer than w words are one shingle, the whole sequence. Rows that repeat a doc_id count as one
document when components are labelled; each row's own text decides its links. A null doc_id takes part and never names
a component unless all its members' ids are null. doc_id must be an integer or a text of one. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import P_BYTE, P_SEQ, connected, doc_words, lean, mix, pieces, stage, unused

#: Blocks beyond the pigeonhole's d + 1: 2 and this share of d. A set leaves out as many of its lightest blocks.
SPARE = 0.25
#: Growth of the size bands, at least; den / num if that is more.
RATIO = 1.25
#: Entries a map task gathers before it sends them on.
FLUSH = 600_000
#: Entries of a shard that are grouped in one step.
RANGE = 400_000
#: Least bits of the narrow sketches that pairs are tried on before their texts are, and bits per shingle of the largest
#: symmetric difference of two sets that link (rounded up to a power of two).
LEAST_BITS, BITS = 256, 16
#: Sets of one bucket, or partners of one hub, that are compared in one piece of work.
BLOCK = 512
#: Pairs a set that a piece of work leaves for later; where there are more, their bucket is joined again.
LEFT = 4
#: Pairs that a task remembers having sent.
SENT = 50_000
#: A list of candidates of at most this many is broadcast (some 30 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 500_000
#: Bits of a block key that are sent, and the bit that says that its flush held other sets too.
KEY_BITS = 47
_KEY, _FLAG = np.uint64((1 << KEY_BITS) - 1), np.uint64(1 << KEY_BITS)


def shingle_sets(data: np.ndarray, off: np.ndarray, w: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = doc_words(data, off)
    weights = [np.uint64(pow(P_SEQ, i + 1, 1 << 64)) for i in range(w)]
    out = []
    run = np.zeros(max(0, len(h) - w + 1), np.uint64)
    for i in range(w):
        run += h[i : i + len(run)] * weights[i]
    run = mix(run)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= w:
            s = run[a : b - w + 1]
            s = s.copy()
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            short = np.array([b - a], np.uint64) * np.uint64(P_BYTE)
            for i in range(b - a):
                short += h[a + i : a + i + 1] * weights[i]
            out.append(mix(short ^ np.uint64(0xA5A5A5A5)))
        else:
            out.append(run[:0])
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    a, b = np.bitwise_xor.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(P_SEQ)))
    both = mix(np.array([a ^ np.uint64(len(s)), b + np.uint64(len(s))], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def spare(d: int) -> int:
    return 2 + int(SPARE * d)


def bands(num: int, den: int, most: int) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, blocks) of each band; 0 blocks where only equal sets can link."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo + 1, int(lo * RATIO), lo * den // num)  # so the largest partner is in the next band at most
        d = 2 * hi * (den - num) // (den + num)
        out.append((lo, hi, d + 1 + spare(d) if d else 0))
        lo = hi + 1
    return out


def block_keys(s: np.ndarray, num: int, den: int, table: list[tuple[int, int, int]]) -> np.ndarray:
    """Keys of the sketch blocks under which a set is joined: in its own band, and in the next if a larger partner can be there."""
    n, found = len(s), []
    own = next(i for i, x in enumerate(table) if x[1] >= n)
    for i in (own, own + 1):
        lo, _, k = table[i]
        if not k or (i > own and n * den // num < lo):
            continue
        block = (s % np.uint64(k)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        count = np.bincount(block, minlength=k)
        full = np.flatnonzero(count)
        value = np.zeros(k, np.uint64)
        value[full] = np.bitwise_xor.reduceat(mix(s[order]), (np.cumsum(count) - count)[full])
        keys = mix(value + np.uint64((i + 1) * P_BYTE % (1 << 64)) + np.arange(k, dtype=np.uint64) * np.uint64(P_SEQ))
        # the lightest blocks go: all of at most c shingles, c the largest for which these are no more than the spare ones.
        # Of the blocks on which two sets agree, those that either leaves out are then at most the spare ones too.
        lost = np.cumsum(np.bincount(count)) <= spare(2 * table[i][1] * (den - num) // (den + num))
        keys = keys[count >= int(lost.sum())]
        found.append(keys)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, node) entries: the distinct keys with their smallest node, and (key, smallest node, other node) of shared keys."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    if not len(key):
        return key, node, key, node, node
    keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    key, node = key[keep], node[keep]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    pivot = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    return key[new], node[new], key[~new], pivot[~new], node[~new]


def packed_keys(key: np.ndarray, node: np.ndarray) -> bytes:
    """(key, node) entries by node: number of nodes, nodes, entries of each, 6 bytes a key."""
    order = np.argsort(node, kind="stable")
    key, node = key[order], node[order]
    new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    count = np.diff(np.append(new, len(node)))
    return np.int64(len(new)).tobytes() + node[new].tobytes() + count.astype(np.uint32).tobytes() + key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    node = np.frombuffer(raw, np.int64, n, 8)
    count = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    six = np.frombuffer(raw, np.uint8, -1, 8 + 12 * n).reshape(-1, 6)
    key = np.zeros((len(six), 8), np.uint8)
    key[:, :6] = six
    return key.view("<u8").ravel().astype(np.uint64), np.repeat(node, count)


_SETS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])
_ENTRIES = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("key", pa.int64()), ("pivot", pa.int64()), ("member", pa.int64())])


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _each_set(batches, w: int):
    for b in batches:
        for row, data, off in pieces(b.column("raw")):
            yield b, row, shingle_sets(data, off, w)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text: with doc_id it tells rows apart that aren't repeats of each other) and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("th"), F.col("text").cast("binary").alias("raw"))


def sketch_bits(n: int, num: int, den: int) -> int:
    return max(LEAST_BITS, 1 << (BITS * 2 * n * (den - num) // (den + num)).bit_length())


def narrow_sketch(s: np.ndarray, bits: int) -> bytes:
    """Parity sketch: its Hamming distance to another set's is at most the size of the symmetric difference."""
    return np.packbits((np.bincount((mix(s ^ np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of `size` bytes or more, as rows of that width: halves are XORed, which is the narrower sketch."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for width in {len(x) for x in sketches}:
        at = [i for i, x in enumerate(sketches) if len(x) == width]
        rows = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1, size // 8)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def set_table(docs: DataFrame, w: int, num: int, den: int) -> DataFrame:
    """doc_id, th, n (set size), d1 and d2 (digest) and a narrow parity sketch of each row; the last three are null for empty sets."""

    def run(batches):
        for b, row, sets in _each_set(batches, w):
            d = [digest(s) if len(s) else (None, None) for s in sets]
            own = b.slice(row, len(sets))
            yield _batch(_SETS, own.column("doc_id"), own.column("th"), [len(s) for s in sets], [x[0] for x in d], [x[1] for x in d], [narrow_sketch(s, sketch_bits(len(s), num, den)) if len(s) else None for s in sets])

    return _texts(docs).mapInArrow(lean(run), "doc_id long, th long, n long, d1 long, d2 long, sketch binary")


def _other_name(d1: int, d2: int) -> int:
    """Name of a set whose d1 another set has too."""
    return int(mix(mix(np.array([d1], np.int64).view(np.uint64)) ^ np.array([d2], np.int64).view(np.uint64)).view(np.int64)[0])


def _entries(docs: DataFrame, w: int, num: int, den: int, shards: int, clashing: frozenset) -> DataFrame:
    """Block entries packed by shard, one smallest node a key, and the stars within each flush (dealt round the shards)."""

    def send(keys, nodes, turn):
        key, low, k2, pivot, member = stars(np.concatenate(keys), np.concatenate(nodes))
        part = ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        more = np.zeros(len(key), np.uint64)
        more[np.searchsorted(key, k2)] = _FLAG
        key, order = (key & _KEY) | more, np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(shards + 1))
        key, low = key[order], low[order]
        full = np.flatnonzero(np.diff(cut)).tolist()
        for g in range(0, len(full), 64):
            some = full[g : g + 64]
            none = pa.nulls(len(some), pa.int64())
            yield _batch(_ENTRIES, some, [packed_keys(key[cut[i] : cut[i + 1]], low[cut[i] : cut[i + 1]]) for i in some], none, none, none)
        for g in range(0, len(k2), 20_000):
            e = slice(g, g + 20_000)
            n = len(k2[e])
            turn += 1
            yield _batch(_ENTRIES, np.full(n, turn % shards), pa.nulls(n, pa.binary()), (k2[e] & _KEY).view(np.int64), pivot[e], member[e])

    def run(batches):
        keys, nodes, held, table, seen, turn = [], [], 0, bands(num, den, 1 << 20), set(), 0
        for _, _, sets in _each_set(batches, w):
            for s in sets:
                if len(s):
                    d = digest(s)
                    if d in seen:
                        continue
                    while max(len(s) * 2, len(s) * den // num + 1) > table[-1][1]:
                        table = bands(num, den, table[-1][1] * 4)
                    k = block_keys(s, num, den, table)
                    if len(k):
                        seen.add(d)
                        turn = d[0] & 0xFFFF
                        keys.append(k)
                        nodes.append(np.full(len(k), _other_name(*d) if d[0] in clashing else d[0], np.int64))
                        held += len(k)
            if held >= FLUSH:
                yield from send(keys, nodes, turn)
                keys, nodes, held, seen = [], [], 0, set()
        if held:
            yield from send(keys, nodes, turn)

    return _texts(docs).select("raw").mapInArrow(lean(run), "shard int, blob binary, key long, pivot long, member long")


def _buckets(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard's blobs: (key, pivot, member) of keys that nodes share.

    A key of two nodes in all is no more than its pair, and is sent once under key -1. Of keys with the same nodes and no
    others one is enough. The shard is worked off in ranges of keys of about RANGE entries.
    """
    got = [unpacked_keys(x) for x in raws]
    key, node = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    del got
    parts = max(1, len(key) // RANGE)
    part = ((key & _KEY) % np.uint64(parts)).astype(np.int32)
    out, known = [], set()
    for i in range(parts):
        own = part == i
        if own.any():
            out.append(_range(key[own], node[own], known))
    found = [np.concatenate([x[c] for x in out]) for c in range(3)]
    alone = found[0] == -1
    pairs = np.unique(np.column_stack((found[1][alone], found[2][alone])), axis=0)
    return np.concatenate((np.full(len(pairs), -1, np.int64), found[0][~alone])), np.concatenate((pairs[:, 0], found[1][~alone])), np.concatenate((pairs[:, 1], found[2][~alone]))


def _range(key: np.ndarray, node: np.ndarray, known: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _buckets gives, of some keys. known: the sets of three nodes and more that came before."""
    order = np.lexsort((node, key & _KEY))
    key, node = key[order], node[order]
    flag, key = key >> np.uint64(KEY_BITS), key & _KEY
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new) - 1
    some = np.bincount(group, flag) > 0  # a flush held nodes that aren't here
    keep = np.concatenate(([True], ~((key[1:] == key[:-1]) & (node[1:] == node[:-1]))))
    key, node, group = key[keep], node[keep], group[keep]
    size = np.bincount(group, minlength=len(some))
    live = ((size > 1) | some)[group]  # most keys are one node's alone
    key, node, group = key[live], node[live], group[live]
    if not len(key):
        return key.view(np.int64), node, node
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size, some, group = size[group[begin]], some[group[begin]], np.repeat(np.arange(len(begin)), size[group[begin]])
    name = mix(node.view(np.uint64))
    one, two = np.bitwise_xor.reduceat(name, begin), np.add.reduceat(mix(name + np.uint64(1)), begin)
    again = np.zeros(len(size), bool)
    for i in np.flatnonzero((size > 2) & ~some).tolist():
        which = (int(size[i]), int(one[i]), int(two[i]))
        again[i] = which in known
        known.add(which)
    use = ((size > 1) & ~again)[group]
    use[begin] = False
    pivot = node[begin][group]
    pair = ((size == 2) & ~some)[group]
    return np.where(pair, np.int64(-1), key.view(np.int64))[use], pivot[use], node[use]


def _shared(docs: DataFrame, w: int, num: int, den: int, shards: int, clashing: frozenset) -> DataFrame:
    """(key, pivot, member) of keys that two or more nodes share: a star or a tree of two levels for each key; key -1 for pairs alone."""

    def ready(held):
        key, pivot, member = _buckets(held)
        for g in range(0, len(key), 100_000):
            e = slice(g, g + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[e]), pa.array(pivot[e]), pa.array(member[e])], names=["key", "pivot", "member"])

    def run(batches):
        held, now = [], None
        for b in batches:
            local = b.filter(pc.is_null(b.column("blob")))
            if local.num_rows:
                yield local.select(["key", "pivot", "member"])
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
                if blob.is_valid:
                    if shard != now and held:
                        yield from ready(held)
                        held = []
                    now = shard
                    held.append(blob.as_buffer().to_pybytes())
        if held:
            yield from ready(held)

    packed = _entries(docs, w, num, den, shards, clashing)
    return packed.repartition(shards // 2, "shard").sortWithinPartitions("shard").mapInArrow(lean(run), "key long, pivot long, member long")


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and narrow sketches allow a link."""

    def run(batches):
        for x in batches:
            n, m = np.asarray(x.column("na")), np.asarray(x.column("nb"))
            sa, sb = x.column("sa").to_pylist(), x.column("sb").to_pylist()
            width = np.array([min(len(p), len(q)) for p, q in zip(sa, sb, strict=True)], np.int64)
            far = np.zeros(len(width), np.int64)
            for size in np.unique(width).tolist():
                at = np.flatnonzero(width == size)
                far[at] = np.bitwise_count(folded([sa[i] for i in at], size) ^ folded([sb[i] for i in at], size)).sum(axis=1, dtype=np.int64)
            yield x.filter(pa.array(far * (den + num) <= (den - num) * (n + m), pa.bool_())).select(["a", "b"])

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    small, big = (s, t) if len(s) <= len(t) else (t, s)
    if not len(small) or den * len(small) < num * len(big):
        return False
    both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
    return den * both >= num * (len(s) + len(t) - both)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, w: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose shingle sets link, found on the texts of one row of each node.

    The node with more partners is the hub: it goes before them in pieces of work of about BLOCK partners each.
    """
    ends = pairs.select("a", "b", F.col("a").alias("x")).union(pairs.select("a", "b", F.col("b").alias("x")))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("m"))
    best = ends.join(degree, "x").groupBy("a", "b").agg(F.max(F.struct("m", "x")).alias("hub")).select("a", "b", F.col("hub.x").alias("hub"), F.col("hub.m").alias("m"))
    best = best.select("hub", F.expr("if(hub = a, b, a)").alias("node"), F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("m") / F.lit(BLOCK))).alias("salt"))
    work = best.select("hub", "salt", "node", F.lit(1).alias("role")).union(best.select("hub", "salt", F.col("hub").alias("node"), F.lit(0).alias("role")).distinct())
    work = stage(work.join(classes.select("node", "rep"), "node").select("hub", "salt", "node", "role", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "wanted")
    few = F.broadcast(work) if work.count() <= BROADCAST_IDS else work
    found = _texts(docs).join(few, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th")))

    def run(batches):
        now = hub = last = None
        for b in batches:
            hubs, salts, nodes, roles = (b.column(c).to_pylist() for c in ("hub", "salt", "node", "role"))
            a, c = [], []
            for row, data, off in pieces(b.column("raw")):
                for i, s in enumerate(shingle_sets(data, off, w), row):
                    if (hubs[i], salts[i]) != now:
                        now, hub, last = (hubs[i], salts[i]), s, None
                    elif roles[i] and nodes[i] != last:  # rows that repeat the hub or a partner say nothing new
                        last = nodes[i]
                        if _linked(hub, s, num, den):
                            a.append(min(now[0], last))
                            c.append(max(now[0], last))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    dealt = found.select("hub", "salt", "role", "node", "raw").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "node")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _forest(comp: list, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (distance, i, j), nearest first, those that join components not yet joined."""
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    kept = []
    for h, i, j in sorted(found):
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            parent[a] = b
            kept.append((h, i, j))
    return kept


def _residual(members: DataFrame, classes: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs (a, b) across components of one key whose narrow sketches allow a link; with forest, those that would join them first.

    members: key, node, comp. Keys of many nodes are cut into blocks of about BLOCK nodes; each pair of blocks is a piece
    of work of its own, and only pairs that pass leave it. Those that the forest leaves out are marked later; where they
    are more than LEFT a node, a row (null, null, key) stands for them.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    some = members.join(sizes, "key").join(classes.select("node", "n", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int"))
    some = some.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "comp", "n", "sketch")

    def work(rows):
        key, x, y, own, node, names, n, sk = map(list, zip(*rows, strict=True))
        comp = np.unique(np.array(names), return_inverse=True)[1]
        n, own, node, width = np.array(n), np.array(own), np.array(node), np.array([len(v) for v in sk])
        level = {size: folded([v if len(v) >= size else bytes(size) for v in sk], size) for size in np.unique(width).tolist()}
        found = []
        for i in range(len(n)):
            ok = (comp != comp[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & (node > node[i]) & ((own != own[i]) | (x[0] == y[0]))
            for size, rows_of in level.items():
                if size > width[i]:
                    continue
                j = np.flatnonzero(ok & ((width >= size) if size == width[i] else (width == size)))
                if not len(j):
                    continue
                far = np.bitwise_count(rows_of[j] ^ rows_of[i]).sum(axis=1, dtype=np.int64)
                near = far * (den + num) <= (den - num) * (n[j] + n[i])
                found += [(h, i, k) for h, k in zip(far[near].tolist(), j[near].tolist(), strict=True)]
        kept = _forest(names, found) if forest else found
        rows = [(int(node[i]), int(node[j]), None, False) for _, i, j in kept]
        if len(found) - len(kept) > LEFT * len(n):
            rows.append((None, None, key[0], True))
        elif len(kept) < len(found):
            first = {(i, j) for _, i, j in kept}
            rows += [(int(node[i]), int(node[j]), None, True) for _, i, j in found if (i, j) not in first]
        return rows

    def run(batches):
        held, now, sent = [], None, set()

        def fresh(found):
            """What the task hasn't sent yet: keys of like members find the same pairs."""
            if len(sent) > SENT:
                sent.clear()
            new = [row for row in found if row not in sent and not sent.add(row)]
            types = pa.int64(), pa.int64(), pa.int64(), pa.bool_()
            return pa.RecordBatch.from_arrays([pa.array([row[c] for row in new], t) for c, t in enumerate(types)], names=["a", "b", "key", "later"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "x", "y", "own", "node", "comp", "n", "sketch")), strict=True):
                if row[:3] != now and held:
                    if len(held) > 1:
                        yield fresh(work(held))
                    held = []
                now = row[:3]
                held.append(row)
        if len(held) > 1:
            yield fresh(work(held))

    dealt = some.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(lean(run), "a long, b long, key long, later boolean").distinct()


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, comp) of keys whose nodes are of two or more components; of keys with the same nodes one is enough."""
    named = members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    own = named.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    keys = stage(own.where("c1 <> c2").groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key"), "open")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return stage(named.join(few, "key"), "members")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose nodes are of two components."""
    side = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _labelled(docs: DataFrame, w: int, num: int, den: int) -> DataFrame:
    """doc_id, th, n, comp (null: linked with no other text), head (struct of the smallest row of the component), one row a row of docs."""
    spark = docs.sparkSession
    sets = stage(set_table(docs, w, num, den), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")  # null ids last
    classes = sets.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = stage(classes.withColumn("node", F.col("d1")), "classes")
    # as many as sets ** 2 / 2 ** 65 are expected
    clashing = frozenset(r["d1"] for r in classes.groupBy("d1").count().where("count > 1").select("d1").toLocalIterator())
    if clashing:
        rename = F.udf(_other_name, "long")
        other = F.when(F.col("d1").isin(list(clashing)), rename("d1", "d2")).otherwise(F.col("d1"))
        classes = stage(classes.withColumn("node", other), "classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    shards = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000 + 1)

    shared = stage(_shared(docs, w, num, den, shards, clashing), "shared")
    tried = stage(shared.select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct(), "tried")
    near = stage(_near(tried, classes, num, den), "near")
    sure = stage(_verified(near, docs, classes, w, num, den), "sure")

    buckets = shared.where("key <> -1")
    members = buckets.select("key", F.col("pivot").alias("node")).union(buckets.select("key", "member")).distinct()
    parts = lambda: connected(sure.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = _open(members, parts())
    found = stage(_residual(members, classes, num, den, True), "rest")
    rest = stage(found.where("not later").select("a", "b").join(tried, ["a", "b"], "left_anti"), "late")  # the likeliest links between components
    sure = stage(sure.union(_verified(rest, docs, classes, w, num, den)), "sure")
    if not found.where("later").isEmpty():  # whatever pairs are left
        tried, joined, keys = tried.union(rest), parts(), found.where("key is not null").select("key").distinct()
        rest = _apart(found.where("later and key is null").select("a", "b"), joined)
        if not keys.isEmpty():
            again = _open(members.select("key", "node").join(keys, "key", "left_semi"), joined)
            rest = rest.union(_residual(again, classes, num, den, False).select("a", "b")).distinct()
        rest = stage(rest.join(tried, ["a", "b"], "left_anti"), "late")
        sure = stage(sure.union(_verified(rest, docs, classes, w, num, den)), "sure")
    every = stage(parts(), "every")

    met = every.join(classes.select("node", "d1", "d2", "rep"), "node")
    heads = met.groupBy("component").agg(F.min("rep").alias("head"))
    heads = F.broadcast(heads) if every.select("component").distinct().count() <= BROADCAST_IDS else heads
    linked = stage(met.join(heads, "component").select("d1", "d2", F.col("component").alias("comp"), "head"), "linked")
    label = classes.select("d1", "d2", "rep").join(linked, ["d1", "d2"], "left").select("d1", "d2", "comp", F.coalesce("head", "rep").alias("head"))
    full = sets.where("n > 0").select("doc_id", "th", "n", "d1", "d2").join(label, ["d1", "d2"]).select("doc_id", "th", "n", "comp", "head")
    return full.union(sets.where("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long"), row))


def jaccard_components(docs: DataFrame, w: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity num/den or more), one row a row of docs."""
    return _labelled(docs, w, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, w: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs that come first in their component (smallest doc_id, nulls last): one row of each group of near copies stays.

    Rows with the same doc_id and the same text are one row. Rows without shingles link with nothing; of those that repeat
    each other one stays too.
    """
    labels = stage(_labelled(docs, w, num, den).select("doc_id", "th", F.expr("head.doc_id <=> doc_id and head.th = th").alias("first")), "labels")
    id_, th = unused("id", docs), unused("th", docs)
    key = F.col(id_).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(th) == F.xxhash64(F.col("text").cast("binary")))
    names = [F.col("doc_id").alias(id_), F.col("th").alias(th)]
    gone = stage(labels.where("not first").select(*names).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(few, key, "left_anti")
    twice = stage(labels.where("first").groupBy("doc_id", "th").count().where("count > 1").select(*names), "twice")
    if twice.isEmpty():
        return kept
    few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    many = kept.join(few, key).dropDuplicates([id_, th]).drop(id_, th)
    return kept.join(few, key, "left_anti").unionByName(many)
