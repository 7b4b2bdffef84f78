"""The operators of lattica.llm against brute force, on small tables that hold what is odd: nulls, empty and very long
texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import html
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import embedding_join, fingerprints, html_text, kneser_ney, language_id, mixing, ngram_jaccard, packing, quality, url_filter
from lattica.llm.common import connected, hash_words, held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, n int, h string, label string"
WORDS = {"en": "the of and thing ation ering with that".split(), "de": "der und ung keit schen über ein lich".split(), "fr": "le que ment eaux où dans une".split(), "es": "el ción para mente los qué año".split()}


def corpus(seed=3):
    """(doc_id, text, lang, source) rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        lang = ["en", "de", "fr", "es"][i % 4]
        words = [rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 120))]
        text = " ".join(words)
        if i % 7 == 0:
            text = text.replace(" ", " | ")
        rows.append((i, text.replace(" ", "\n", 2), lang, f"src{rng.choice([0, 0, 0, 1, 2, 3])}"))
    for k in range(20):  # near copies of one text
        words = rows[11][1].split() * 3
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((100 + k, " ".join(words), "fr", "src0"))
    rows += [(200 + k, rows[5][1].upper() if k % 2 else rows[5][1], "de", None) for k in range(6)]
    rows += [(300, None, "en", "src1"), (301, "", None, "src1"), (302, " \t\n ", "en", "src1"), (303, "7 7 !!", "en", "src2"), (304, "one", "en", "src2"), (305, "one", "en", "src2"), (306, "Two  words", "en", None)]
    rows += [(307, " ".join(rng.choice(WORDS["en"]) for _ in range(40_000)), "en", "src3"), (308, "x" * 300_000, "en", "src3")]
    rows += [(309, "é ﬁne  Straße X", "de", "src4"), (310, "é FINE STRASSE x ", "de", "src4"), (311, "<|endoftext|> it's <|ENDOFTEXT|> a b", "en", "src4")]
    return rows + [rows[3], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 2, 3, "h", "l") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words_of(text):
    return (text or "").encode().lower().split()


def _chain(n, w, share, seed):
    """Rows of which each shares about `share` of its shingles with the one before: links near the threshold."""
    rng = random.Random(seed)
    words, out = [f"w{rng.randrange(10**6)}" for _ in range(n)], []
    for i in range(24):
        out.append((1000 + i, " ".join(words)))
        cut = max(1, round(n * (1 - share) / (1 + share)))
        words = words[cut:] + [f"w{rng.randrange(10**6)}" for _ in range(cut + rng.choice([-1, 0, 0, 1]))]
    return out


@pytest.mark.parametrize(("w", "num", "den"), [(1, 1, 2), (2, 7, 10), (1, 19, 20)])
def test_jaccard_components_at_other_thresholds(spark, w, num, den):
    rows = [(i, t) for k, n in enumerate((6, 25, 90, 400)) for i, t in [(i + 100 * k, t) for i, t in _chain(n, w, num / den, n)]]
    base = _chain(100, 1, 0.5, 9)[0][1].split()
    rows += [(5000 + k, " ".join(base[k : k + 50])) for k in range(0, 50, 2)] + [(6000, " ".join(base))]
    rows = list(dict(rows).items())
    test_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, w, num, den)


def test_null_and_repeated_ids(spark):
    """Rows without an id take part; rows that repeat an id are told apart by their text."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(None, text), (None, near), (None, text), (None, "something else here now yes"), (4, "first text of four is this"), (4, "other text of four is that one"), (9, "other text of four is that one"), (9, "only nine has these words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard.jaccard_components(docs, 5, 4, 5).collect()), key=str)
    assert [c for _, _, c in got].count(4) == 3 and [c for _, _, c in got].count(9) == 1 and [c for _, _, c in got].count(None) == 4
    kept = sorted(map(tuple, ngram_jaccard.keep_first(docs, 5, 4, 5).collect()), key=str)
    assert len(kept) == 5 and (4, rows[4][1]) in kept and (4, rows[5][1]) in kept and (9, rows[7][1]) in kept and (None, rows[3][1]) in kept
    assert sum(r in kept for r in {(None, text), (None, near)}) == 1


def test_packed_keys_and_buckets():
    rng = np.random.default_rng(3)
    key, node = rng.integers(0, 1 << 48, 500, dtype=np.uint64), rng.integers(-9, 9, 500)
    k, n = ngram_jaccard.unpacked_keys(ngram_jaccard.packed_keys(key, node))
    assert sorted(zip(k.tolist(), n.tolist(), strict=True)) == sorted(zip(key.tolist(), node.tolist(), strict=True))
    flag = int(ngram_jaccard._FLAG)
    blobs = [ngram_jaccard.packed_keys(np.array([1, 2, 3, 4, 5 | flag], np.uint64), np.array([10, 10, 10, 10, 10])), ngram_jaccard.packed_keys(np.array([1, 2, 3, 5], np.uint64), np.array([20, 20, 20, 20])), ngram_jaccard.packed_keys(np.array([2, 3, 4], np.uint64), np.array([30, 30, 10]))]
    got = sorted(zip(*(x.tolist() for x in ngram_jaccard._buckets(blobs)), strict=True))
    assert got in ([(-1, 10, 20), (2, 10, 20), (2, 10, 30), (5, 10, 20)], [(-1, 10, 20), (3, 10, 20), (3, 10, 30), (5, 10, 20)])
    assert ngram_jaccard._other_name(5, 1) != ngram_jaccard._other_name(5, 2)
    for bits in (128, 512):
        s = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        assert ngram_jaccard.folded([ngram_jaccard.narrow_sketch(s, 2048)], bits // 8).tobytes() == ngram_jaccard.narrow_sketch(s, bits)


@pytest.mark.parametrize("n", [6, 30])
def test_residual_sends_left_out_pairs(spark, n):
    """What the forest leaves out of a key goes on as pairs, if these are few to a node; else the key is joined again."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 63, 2, dtype=np.uint64))) for _ in range(n)]
    classes = spark.createDataFrame([(i, len(s), bytearray(ngram_jaccard.narrow_sketch(s, 2048))) for i, s in enumerate(sets)], "node long, n long, sketch binary")
    members = spark.createDataFrame([(key, i, i) for key in (7, 8) for i in range(n)], "key long, node long, comp long")
    got = ngram_jaccard._residual(members, classes, 4, 5, True).collect()
    first, later = ({(r.a, r.b) for r in got if r.key is None and r.later == flag} for flag in (False, True))
    keys = {r.key for r in got} - {None}
    assert len(first) == n - 1
    if n == 6:
        assert not keys and first | later == {(i, j) for i in range(n) for j in range(i + 1, n)}
    else:
        assert keys == {7, 8} and not later


@pytest.mark.parametrize("left", [0, 4])
def test_jaccard_of_near_copies(spark, monkeypatch, left):
    """Copies of one text on both sides of the threshold: the same links whether what is left out goes on as pairs or as keys."""
    monkeypatch.setattr(ngram_jaccard, "LEFT", left)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([6, 12, 13, 14, 15, 18])):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    test_jaccard_components(docs, rows, 1, 4, 5)


@pytest.mark.parametrize(("w", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_jaccard_components(docs, rows, w, num, den):
    sets, parent = {}, {}
    for i, text, *_ in rows:
        v = words_of(text)
        sets[i] = frozenset(b" ".join(v[k : k + w]) for k in range(len(v) - w + 1)) if len(v) >= w else frozenset([b" ".join(v)] if v else [])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_jaccard.jaccard_components(docs, w, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), find(i)) for i, *_ in rows)
    kept = ngram_jaccard.keep_first(docs, w, num, den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in sets})


def test_jaccard_empty_and_null(spark, none):
    assert ngram_jaccard.jaccard_components(none).collect() == []
    got = ngram_jaccard.jaccard_components(frame(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_blocks_hold_every_link():
    """Pigeonhole: sets at the threshold share a block key, whatever their sizes."""
    rng = np.random.default_rng(1)
    table = ngram_jaccard.bands(4, 5, 1 << 14)
    for n in [9, 10, 12, 17, 18, 40, 100, 700, 3000]:
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, len(base) // 9 + 1)
            add = rng.integers(0, max(1, len(base) // 10 - drop) + 1)
            other = np.unique(np.concatenate((base[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            both = len(np.intersect1d(base, other))
            if 5 * both >= 4 * (len(base) + len(other) - both) and len(np.setxor1d(base, other)):
                assert len(np.intersect1d(ngram_jaccard.block_keys(base, 4, 5, table), ngram_jaccard.block_keys(other, 4, 5, table)))


def test_blocks_hold_links_of_loose_thresholds():
    rng = np.random.default_rng(2)
    for num, den, sizes in ((7, 10, [(15, 21), (20, 27), (799, 1140)]), (1, 2, [(4, 7), (4, 8), (30, 60), (700, 1400)])):
        table = ngram_jaccard.bands(num, den, 1 << 14)
        assert all(n * den // num <= table[i + 1][1] for i, (_, n, _) in enumerate(table[:-1]))
        for few, many in sizes:
            big = np.unique(rng.integers(0, 1 << 63, many, dtype=np.uint64))
            keys = [ngram_jaccard.block_keys(s, num, den, table) for s in (np.sort(rng.permutation(big)[:few]), big)]
            assert len(np.intersect1d(*keys))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(51)} | {(i, 1000) for i in range(1000, 1100)}


def reference_mix(rows, weights=(5, 2, 1), share=1.5, repeats=2.0):
    size = [len(words_of(t)) for _, t, *_ in rows]
    total = Counter()
    for (_, _, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= repeats * total[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = repeats * total[s]
            left -= target[s]
        open_ -= over
    return size, total, target


def test_mix(spark, docs, rows, none):
    size, total, target = reference_mix(rows)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], n) for r, n in zip(rows, size, strict=True))
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for r, n in zip(rows, size, strict=True) if r[3] == s)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns
    assert Counter(r.doc_id for r in copies.collect()) == {r.doc_id: r.copies * sum(x[0] == r.doc_id for x in rows) for r in got if r.copies}
    assert mixing.mix(none).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()] == [0, 0]


def test_pack(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    got = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.pack(none).collect() == []


def _ids(spark, texts, tokenizer):
    got = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1 << 20, tokenizer).collect()
    return {r.doc_id: (r.length, r.ids_crc32) for r in got}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_tokenizer(spark, name):
    """Ids are the tokenizer's own, also where white space, case or long words of a pattern matter."""
    import public_tokenizers
    from tokenizers import Tokenizer

    morse = ["a"]
    while len(morse[-1]) < 2048:
        morse.append(morse[-1] + morse[-1].translate({97: 98, 98: 97}))
    texts = ["the The THE", "a\n\n  b\tc ", " lead", "it's IT'S 'S", "don't\r\nDon’t", "", "<|endoftext|> x", morse[-1], morse[-1].translate({97: 98, 98: 97}), "é É e\u0301 straße STRASSE 7 77 ٣"]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert _ids(spark, texts, name) == want


def test_word_hashes_of_patterns_stay_apart():
    """Words that a hash linear in its bytes confuses; and case folds, whatever the length."""
    one, two = b"a", b"b"
    while len(one) < 1 << 13:
        one, two = one + two, two + one
        h, first = hash_words(np.frombuffer(one + b" " + two + b"\t" + one.upper(), np.uint8))
        assert h[0] != h[1] and h[0] == h[2] and first.tolist() == [0, len(one) + 1, 2 * len(one) + 2]
        h, _ = hash_words(np.frombuffer(one + b" " + one.upper(), np.uint8), fold=False)
        assert h[0] != h[1]
    texts = [b"x" * k for k in range(1, 140)]
    h, _ = hash_words(np.frombuffer(b" ".join(texts), np.uint8))
    assert len(set(h.tolist())) == len(texts)
    assert all(hash_words(np.frombuffer(b"\n" * (k % 5) + v, np.uint8))[0][0] == h[k] for k, v in enumerate(texts))


def test_packing_plan_places_every_rank_once():
    rng = random.Random(5)
    for capacity in (7, 64, 2048):
        counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5)), capacity, capacity // 3 + 1]) for _ in range(3000))
        rows, used, big = packing.plan(counts, capacity), defaultdict(list), Counter()
        for length, n in counts.items():
            own = rows[rows[:, 0] == length]
            for rank in range(n):
                _, first, each, sequence, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                k = rank - first
                used[sequence + k // each].append((offset + k % each * length, length))
                big[sequence + k // each] += length > capacity // 3
        for items in used.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        assert max(big.values(), default=0) <= 2
        assert sorted(used) == list(range(len(used)))


def test_fingerprints(docs, rows, none):
    def canon(text):
        x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
        return re.sub(r"[\s\x1c-\x1f\x85]+", " ", x).strip(" ")

    def digest(text):
        c = canon(text).encode()
        one = xxhash.xxh64_intdigest(c, 42)
        two = xxhash.xxh64_intdigest(c, xxhash.xxh64_intdigest(b"wide", 42))
        return f"{one:016x}{two:016x}"

    ordered = sorted(rows, key=lambda r: (-r[0], (r[1] or "").encode()))
    want, least = Counter(), {}
    for i, text, *_ in rows:
        least[canon(text)] = min(i, least.get(canon(text), i))
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text), digest(edited), float(digest(text) == digest(edited)), float(digest(text) == digest(after)), least[canon(text)]] += 1
    assert Counter(map(tuple, fingerprints.fingerprints(docs).collect())) == want
    assert digest(rows[-7][1]) != "" and fingerprints.fingerprints(none).collect() == []


@pytest.mark.parametrize(("broadcast", "heavy"), [(500_000, 1000), (0, 2)])
def test_fingerprints_that_clash(spark, monkeypatch, broadcast, heavy):
    """With a digest of the length alone, copies are still those of equal canonical bytes; also where lists are too long to broadcast."""
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.length(canon).cast("string"))
    monkeypatch.setattr(fingerprints, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(fingerprints, "HEAVY", heavy)
    rows = [(5, "abc"), (3, "ABC "), (9, "xyz"), (8, "xyz"), (7, "none"), (None, "abc"), (2, "xyz9"), (1, None), (0, ""), (11, "long one"), (12, "LONG one"), (13, "long  one")]
    got = {(r.doc_id, r.n_chars): r.copy_of for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3): 3, (3, 4): 3, (9, 3): 8, (8, 3): 8, (7, 4): 7, (None, 3): 3, (2, 4): 2, (1, 0): 0, (0, 0): 0, (11, 8): 11, (12, 8): 11, (13, 9): 11}


def test_fingerprint_folds(spark):
    pairs = [("é ﬁne  Straße X", "é FINE STRASSE x "), ("", None), ("\t", "")]
    for a, b in pairs:
        r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).first()
        assert r[0] == r[1]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    near = [base[i % 7] + rng.normal(size=16).astype(np.float32) * s for i, s in zip(range(90), np.linspace(0.01, 0.6, 90), strict=True)]
    vectors = [*base, *near, *[base[3]] * 30, base[3] * 2, -base[3]]
    rows = [(i, [float(x) for x in v], 1, 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1, 0), (n + 1, [0.0] * 16, 1, 0), (n + 2, [float("nan")] * 16, 1, 0), (n + 3, [None] * 16, 1, 0), (n + 4, [], 1, 0), (n + 5, [float("inf")] + [1.0] * 15, 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, weight int")
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    label = np.arange(n)
    for _ in range(n):
        label = np.array([label[link[i]].min() for i in range(n)])
    got = {r.vec_id: r for r in embedding_join.near_duplicates(df, 0.95).collect()}
    assert len(got) == len(rows)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum() - 1, label[i], label[i] == i)
    for i in range(n, len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_join.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.9, 1.0])
def test_embeddings_over_many_intervals(spark, monkeypatch, threshold):
    """More intervals than one, a large group of copies, repeated and null ids, two dimensions, ties at the threshold."""
    monkeypatch.setattr(embedding_join, "SMALLEST", 64)
    monkeypatch.setattr(embedding_join, "PARTS", 9)
    monkeypatch.setattr(embedding_join, "HEAVY", 50)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)) * (np.arange(8) + 1.0) ** -1.0
    x[300:400] = x[5]
    x[400:500] = x[:100] + rng.normal(size=(100, 8)) * 0.05
    x[500], x[501], x[502] = np.eye(8)[0], np.eye(8)[0] * 0.9 + np.eye(8)[1] * math.sqrt(1 - 0.81), np.eye(8)[0] * 3
    other = rng.normal(size=(40, 3))
    ids = [None if i == 5 else 3 if i == 4 else i for i in range(700)]
    rows = [(ids[i], [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in v]) for i, v in enumerate(other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = Counter()
    for part, names in ((x, ids), (other, list(range(1000, 1040)))):
        z = part / np.linalg.norm(part, axis=1, keepdims=True)
        link = z @ z.T >= threshold - (1e-12 if threshold < 1 else 1e-15)
        np.fill_diagonal(link, True)
        for i in range(len(z)):
            seen, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(link[todo.pop()]).tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((names[j] for j in seen if names[j] is not None), default=None)
            want[names[i], int(link[i].sum()) - 1, least, names[i] == least] += 1
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df, threshold).collect())
    assert sum(n for _, n, _, _ in got.elements()) > 9900 and got.total() == 740
    if threshold < 1:
        assert got == want
    else:  # copies link; a scaled copy may round to either side of 1
        assert {k: n for k, n in got.items() if k[0] not in (500, 502)} == {k: n for k, n in want.items() if k[0] not in (500, 502)}


def test_interval_pairs_skip_only_what_is_apart():
    rng = np.random.default_rng(4)
    p = np.sort(rng.normal(size=(40, 3)), axis=0)
    boxes = [(v - 0.01, v + 0.01) for v in p]
    want = {(i, j) for i in range(40) for j in range(i, 40) if not embedding_join._apart(boxes[i], boxes[j], 0.5)}
    assert set(embedding_join.interval_pairs(boxes, 0.5)) == want


def test_kneser_ney(docs, rows, none):
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10 != 0]
    tokens = lambda r: [*words_of(r[1]), 1]
    count, pairs = Counter(), Counter()
    for r in learn:
        t = tokens(r)
        count.update(t)
        pairs.update(zip([0, *t[:-1]], t, strict=True))
    total, v, context = sum(count.values()), len(count), Counter(count)
    context[0] = len(learn)
    lead = Counter(b for _, b in pairs)
    of = lambda c: [0.0, *kneser_ney._discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])]
    d, e = of(pairs), of(lead)
    spread = sum(e[min(3, k)] for k in lead.values()) / len(pairs)
    freed = defaultdict(float)
    for (a, _), k in pairs.items():
        freed[a] += d[min(3, k)]

    def p(a, b):
        p1 = (lead[b] - e[min(3, lead[b])]) / len(pairs) + spread / (v + 1)
        return p1 if not context[a] else (pairs[a, b] - d[min(3, pairs[a, b])]) / context[a] + freed[a] / context[a] * p1

    some = words_of(rows[0][1])[0]
    assert sum(p(some, b) for b in count) + p(some, None) == pytest.approx(1)
    out = held_out(F.col("doc_id"), 10, 0)
    got = sorted(kneser_ney.score(docs, kneser_ney.fit(docs, ~out), F.col("doc_id")).collect())
    for r, g in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        t = tokens(r)
        assert g[:4] == (r[0], len(t), sum(x in count for x in t), total)
        assert g[4] == pytest.approx(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (v + 1))) for x in t))
        assert g[5] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *t[:-1]], t, strict=True)))
    assert kneser_ney.score(none, kneser_ney.fit(none, ~out), F.col("doc_id")).collect() == []
    assert {r.score for r in kneser_ney.score(docs, kneser_ney.fit(none, ~out), F.col("doc_id")).collect()} == {0.0}


def test_language(docs, rows, none):
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, ~out)
    got = language_id.identify(docs, model, docs.columns)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    lang = {r[0]: r for r in rows}
    sure = [r for r in got.collect() if r.doc_id < 80]
    assert sum(r.lang_pred == lang[r.doc_id][2] for r in sure) >= 0.95 * len(sure)
    for r in got.collect():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", lang[r.doc_id][1] or ""))
        assert 0 <= r.score <= 1
    assert language_id.identify(none, model).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(none, ~out)).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"und", "de"}


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], int(" | " not in (r[1] or "")), None) for r in rows if r[0] < 80] + [(500, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, ~out)
    got = quality.score(docs, model, docs.columns)
    assert got.columns == [*docs.columns, "score", "predicted"]
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id < 80:
            assert r.predicted == int(" | " not in r.text)
    assert quality.score(none, model).collect() == []
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), ~out)).collect()} == {0.5}


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    t, docs = rng.normal(size=(2, 2)), np.array([0, 1, 4, 9])
    u = rng.normal(size=9)
    got, pairs, log_z = quality.marginals(u, docs, t)
    want, total, seen = np.zeros(9), 0.0, np.zeros((2, 2))
    for a, b in zip(docs[:-1], docs[1:], strict=True):
        n, z, m, s = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            w = math.exp(sum(u[a + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            z, m = z + w, m + w * np.array(y)
            for i in range(n - 1):
                s[y[i], y[i + 1]] += w
        want[a:b], total, seen = m / z, total + math.log(z), seen + s / z
    assert np.allclose(got, want) and np.allclose(pairs, seen) and log_z == pytest.approx(total)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav><div class="cookie-banner"><p>We use cookies, really, a lot of them, on every page you read here.</p></div>
<div class="page"><div class="content"><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold<br>and</b> a <a href=3>link</a>, long enough to count for something.
<p>Second one &lt;b&gt; caf&eacute;, also, quite, long, and with commas, so that it scores.</p><ul><li>item one<li>item two</ul><div class="ad-slot">Buy, buy, buy this very long advert, it is great, said nobody ever.</div>
<p>Short.</p><form><p>Your name, please, in this form, with many commas, indeed.</p><input></form></div>
<aside><p>Sidebar text, with commas, and more, and long enough to be taken for an article.</p></aside></div>
<section id="comments"><p>I agree, wholly, with all of this, and more, says a reader, at great length, indeed.</p></section><footer>&copy; nobody</footer></body></html>"""


def test_html():
    want = ["Title & more", "First paragraph, with bold and a link, long enough to count for something.", "Second one <b> café, also, quite, long, and with commas, so that it scores.", "item one", "item two", "Short."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)
    article = PAGE.replace('<div class="content">', "<article>").replace("</form></div>", "</form></article>")
    assert html_text.main_text(article) == "\n\n".join(want)
    for odd in (None, "", "   ", "<p", "<!--", "<script>x", "</p></p>", "<!DOCTYPE html>"):
        assert html_text.main_text(odd) == ""
    assert html_text.main_text("<p>a<p>b") == "a\n\nb"
    assert html_text.main_text("just text &amp; &#x41;") == "just text & A"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html_text.main_text("<article>" + "<p>word, word" * 20_000)) == 20_000 * 10 + 19_999 * 2
    assert html.unescape("&amp;") == "&"


def test_html_odd_markup():
    text = html_text.main_text
    assert text('<p class="x>Hello world') == "Hello world"
    assert text("<p title=it's>one</p><p>don't</p>") == "one\n\ndon't"
    assert text("<article><p>a <math><mi>x</mi></math> b <svg class=i/>c</p><object><p>d</p></object></article>") == "a x b c\n\nd"
    assert text("<article><svg/><p>all of it</p><button>no<p>more</article>").startswith("all of it")
    assert text("<body><div><p>one, long enough to be, well, the container</p></div><div><p>two short</p></div></body>") == "one, long enough to be, well, the container\n\ntwo short"
    assert text("<article><a href=x><p>linked</p><p>plain text after a link without an end, and on, and on</p></article>") == "linked\n\nplain text after a link without an end, and on, and on"
    assert text("<form><article><h1>T</h1><p>a page within a form</p></article></form>") == "T\n\na page within a form"
    assert text("<p>" + "&#" + "9" * 9000 + ";&#x" + "F" * 50 + ";&#0000065;") == "\ufffd\ufffdA"


def test_html_hostile_pages_take_linear_time():
    n = 40_000
    pages = {
        "open and other end tags": "<b>" * n + "</i>" * n + "x", "nested blocks": "<div>x" * n, "inline around rules": "<b>" * n + "x<hr>" * n, "one quote": "<a " * 3 * n + '"', "quotes": '<a b="' * n, "both quotes": "<a b='\"" * n,
        "script": "<script>" + "</script " * n, "lists": "<ul><li>" * n, "links": "<a><div>" * n + "</a>" * n, "ampersands": "&" * 10 * n, "digits": "&#" + "9" * 10 * n, "less than": "<" * 10 * n, "comments": "<!--" * n, "tables": "<table><tr><td>" * n, "buttons": "<button>x" * n + "</button>", "names": "<a " + "=" * 10 * n,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 8, name  # a quadratic step would take minutes


def generated_page(rng):
    """(page, its main blocks) in one of several layouts, with parts around the article that are not of it."""
    say = lambda k: " ".join(rng.choice(WORDS["en"]) + rng.choice(WORDS["en"]) for _ in range(k))
    blocks = [say(rng.randint(4, 9)), *(say(rng.randint(12, 60)).replace(" ", ", ", rng.randint(1, 4)).capitalize() + "." for _ in range(rng.randint(3, 9)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}" + rng.choice(["</p>", ""]) for b in blocks[1:])
    if rng.random() < 0.5:
        items = [say(5) for _ in range(3)]
        body += "</p><ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        blocks += items
    wrap = rng.choice(["<article>{}</article>", "<main><div class=post>{}</div></main>", '<div id="content"><div>{}</div></div>', "<div class='story-body'>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"])
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{say(2)}</a></li>" for k in range(6)) + "</ul>"
    before = [f"<nav>{menu}</nav>", f"<header><h2>{say(3)}</h2>{menu}</header>", f"<div class='cookie-notice'><p>{say(30)}, {say(9)}</p></div>", f"<div class=ad>{say(25)}</div>", f"<script>var a='<p>{say(40)}</p>'</script>", f"<form><p>{say(20)}</p><input></form>", f"<div role=navigation>{menu}</div>"]
    after = [f"<aside><p>{say(40)}, {say(40)}</p></aside>", f"<footer><p>{say(30)}</p></footer>", f"<div id=comments><p>{say(40)}, {say(9)}</p><p>{say(30)}</p></div>", f"<div class='sidebar right'><p>{say(50)}</p>{menu}</div>", f"<div class='related'>{menu}</div>", f"<style>p{{{say(3)}}}</style>"]
    pick = lambda parts: "".join(rng.sample(parts, rng.randint(1, len(parts))))
    return f"<!DOCTYPE html><html><head><title>{say(4)}</title></head><body>{pick(before)}{wrap.format(body)}{pick(after)}</body></html>", blocks


def test_html_of_generated_pages():
    """Word recall and precision on pages of known main text."""
    rng, found, wanted, both, exact = random.Random(6), 0, 0, 0, 0
    for _ in range(300):
        page, blocks = generated_page(rng)
        got, want = html_text.main_text(page), "\n\n".join(blocks)
        exact += got == want
        g, w = Counter(got.split()), Counter(want.split())
        found, wanted, both = found + g.total(), wanted + w.total(), both + (g & w).total()
    assert both / wanted > 0.99 and both / found > 0.99 and exact >= 290


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (None, "u", "<p>x", 7), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in got) == sorted([(1, len(html_text.main_text(PAGE)))] * 2 + [(2, 0), (-1, 1)])
    assert html_text.extract(df.limit(0)).collect() == []


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules(spark):
    urls = {
        "http://a.example.com/en/7817?x": ("a.example.com", "/en/7817", "example.com/en/7", "allow"), "https://EXAMPLE.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"), "ftp://b.net/de/8#t": ("b.net", "/de/8", "net/de/", "allow"), "http://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"),
        "http://net": ("net", "", None, "allow"), "http://a.org?/es/": ("a.org", "", None, "allow"), "http://a.org/es/": ("a.org", "/es/", "org/es/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.judge(df, RULES, []).collect()}
    for i, want in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert url_filter.judge(df.limit(0), RULES, []).collect() == []


def test_url_mining(spark):
    rng = random.Random(8)
    pages, labels = [], []
    for i in range(600):
        spam = i % 5 == 0
        host = "win-casino.bets.io" if spam else rng.choice(["news.site.io", "blog.site.io", "shop.bets.io"])
        pages.append((i, f"http://{host}/{rng.choice(['en', 'de'])}/{i}?ref=x"))
        labels.append((i, 0 if spam else 1, 0))
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = url_filter.mine(df, known)
    assert any("h:win-casino" in r[0] for r in rules)
    got = url_filter.judge(df, [], rules).collect()
    assert all((r.verdict == "block") == (r.page_id % 5 == 0) for r in got)
    # brute force over the rules
    for r in got:
        assert (r.mined_rule is not None) == any(x[0] <= set(spark_tokens(r.host, pages[r.page_id][1])) for x in rules)
    assert url_filter.mine(df, known.limit(0)) == [] and url_filter.mine(df.limit(0), known) == []


def test_url_rules_of_brute_force(spark):
    """All rules at a support and confidence, from counts of every token set; a template of many constant segments is one item."""
    rng = random.Random(4)
    deep = "/".join(f"seg{chr(97 + i)}" for i in range(20))
    urls = [f"http://{rng.choice(['x', 'y', 'z'])}.{rng.choice(['aa', 'bb'])}.io/{rng.choice([deep, 'en', 'de'])}/{i}" for i in range(400)]
    urls += urls[:20]
    labels = [(i, int(not ("//x" in u and rng.random() < 0.9 or rng.random() < 0.2)), None) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad = {str(i): q == 0 for i, q, _ in labels}
    seen = [(frozenset(r.tokens), r.bad) for r in url_filter.labelled(pages, known).collect()]
    assert len(seen) == 420 and all(b == bad[u.rsplit("/", 1)[1]] for u, b in [(r.url, r.bad) for r in url_filter.labelled(pages, known).collect()])
    n, support = len(seen), 0.05
    rows = {t: frozenset(i for i, (v, _) in enumerate(seen) if t in v) for v, _ in seen for t in v}
    groups = defaultdict(set)
    for t, r in rows.items():
        if len(r) >= support * n:
            groups[r].add(t)
    want, lists = {}, [(frozenset(), frozenset(range(n)))]
    for r, g in sorted(groups.items(), key=lambda x: sorted(x[1])):
        lists += [(k | g, v & r) for k, v in lists if len(v & r) >= support * n]
    for k, v in lists:
        for verdict in ("block", "allow"):
            hit = sum(seen[i][1] == (verdict == "block") for i in v)
            if k and hit >= support * n and hit / len(v) >= 0.6 and url_filter.lower_bound(hit / len(v), len(v)) >= 0.5:
                want[k, verdict] = (round(hit / len(v), 9), round(hit / n, 9))
    want = {(k, v): c for (k, v), c in want.items() if not any(w == v and j < k and d[0] >= c[0] for (j, w), d in want.items())}
    got = {(r.tokens, r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.mine(pages, known, support)}
    assert got == want and {v for _, v in got} == {"block", "allow"}
    assert any(len([t for t in k if t.startswith("p:seg")]) == 20 for g in groups.values() for k in [g])


def spark_tokens(host, url):
    labels = host.split(".")
    return ["d:" + ".".join(labels[-2:]), *("h:" + v for v in labels), "q:ref", "p:" + url.split("/")[3], "p:#"]


def test_url_mining_drops_no_item(spark):
    """A rule on tokens that tell little on their own, in URLs of more than ten items, and a chain of twenty nested segments."""
    rng = random.Random(6)
    urls, labels = [], []
    for i in range(800):
        x, y = rng.random() < 0.5, rng.random() < 0.5  # both together are bad
        keys = [f"k{j}" for j in range(14) if rng.random() < (0.75 if i % 3 else 0.2)]
        keys += (["xx"] if x else []) + (["yy"] if y else [])
        chain = [f"c{chr(97 + j)}" for j in range(20) if j <= i % 20]
        urls.append(f"http://h.io/{'/'.join(chain)}/{i}?" + "&".join(f"{k}=1" for k in keys))
        p = 0.5 + 0.1 * (("k0" in keys) - 0.5) + 0.1 * (("k1" in keys) - 0.5)
        labels.append((i, int(not (x and y or rng.random() < p - 0.4)), 0))
    pages, known = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = [(frozenset(r.tokens), r.bad) for r in url_filter.labelled(pages, known).collect()]
    support, n = 0.2, len(seen)
    rules = url_filter.mine(pages, known, support)
    got = {(r.tokens, r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in rules}
    masks = defaultdict(int)
    for i, (own, _) in enumerate(seen):
        for t in own:
            masks[t] |= 1 << i
    groups = defaultdict(set)
    for t, m in masks.items():
        if m.bit_count() >= support * n:
            groups[m].add(t)
    bad, want = sum(1 << i for i, (_, b) in enumerate(seen) if b), {}
    def search(own, mask, rest):  # noqa: E306
        for k, (m, g) in enumerate(rest):
            both = mask & m
            if both.bit_count() < support * n or both == mask and own:
                continue
            tokens = own | g
            for verdict, hit in (("block", (both & bad).bit_count()), ("allow", (both & ~bad).bit_count())):
                of = both.bit_count()
                if hit >= support * n and hit / of >= 0.6 and url_filter.lower_bound(hit / of, of) >= 0.5:
                    want[tokens, verdict] = url_filter.Rule(tokens, hit / of, hit / n, verdict, 0.0)
            search(tokens, both, rest[k + 1 :])
    search(frozenset(), (1 << n) - 1, sorted(((m, frozenset(g)) for m, g in groups.items()), key=lambda x: (x[0].bit_count(), sorted(x[1]))))
    want = {(r.tokens, r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.prune(list(want.values()))}
    assert got == want and any(t >= {"q:xx", "q:yy"} and v == "block" for t, v in got)
    assert max(len({masks[t] for t in own if masks[t] in groups}) for own, _ in seen) > 10
