"""The registered queries and the pipeline on a small set of tables, against brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import html_text, mixing, packing, queries
from tests.llm.test_operators import RULES, corpus, generated_page, reference_mix, words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def components(texts, w, num, den):
    """Smallest key reachable by links, of {key: text}."""
    sets, label = {}, {}
    for i, text in texts.items():
        v = words_of(text)
        sets[i] = frozenset(b" ".join(v[k : k + w]) for k in range(len(v) - w + 1)) if len(v) >= w else frozenset([b" ".join(v)] if v else [])
        label[i] = i
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in range(len(links) + 1):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return sets, label


@pytest.fixture(scope="module")
def rows():
    return [r for r in corpus(5) if r[0] != 3] + [(3, "one row of three, not repeated, at all", "en", "src1")]


@pytest.fixture(scope="module")
def pages(rows):
    rng = random.Random(1)
    hosts = ["a.example.com", "example.net", "b.example.org", "X.example.NET", "other.io"]
    out = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(rows)[0]}?q=1", generated_page(rng)[0]) for i in range(60)]
    return [*out, (60, None, None), (61, "no scheme", ""), (62, "http://", "<p>x")]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 16))
    x[50:70] = x[:20] + rng.normal(size=(20, 16)) * 0.08
    x[70:80] = x[3]
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows, pages, vectors):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(" | " not in (r[1] or "")), 0) for r in rows if r[0] < 80]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{path}/pages.parquet")
    data = [(i, [float(v) for v in x], 0) for i, x in enumerate(vectors)] + [(90, None, 0), (91, [0.0] * 16, 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, sf, name):
    return queries.QUERIES[next(q for q in queries.QUERIES if q.startswith(name + "_"))](spark, sf).collect()


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_scores_and_languages(spark, sf, rows):
    text = {r[0]: r[1] or "" for r in rows}
    one = {r.doc_id: r for r in run(spark, sf, "op1")}
    seven = {r.doc_id: r for r in run(spark, sf, "op7")}
    assert set(one) == set(seven) == set(text)
    for i, r in one.items():
        assert r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert sum(one[i].predicted == (" | " not in text[i]) for i in range(80) if one[i].held_out) == sum(one[i].held_out for i in range(80))
    for i, r in seven.items():
        assert r.held_out == (crc(i) % 4 == 2) and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[i])) and 0 <= r.score <= 1
    lang = {r[0]: r[2] for r in rows}
    assert sum(seven[i].lang_pred == lang[i] for i in range(80) if i != 3) >= 70  # of 79, some of four words


def tokenised(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    return want


def test_packing(spark, sf, rows):
    got = run(spark, sf, "op2")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == tokenised([(r[0], r[1]) for r in rows])


def test_jaccard(spark, sf, rows):
    sets, label = components({r[0]: r[1] for r in rows}, 3, 90, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, sf, "op3")) == sorted((i, len(sets[i]), label[i]) for i in sets)


def test_pages(spark, sf, pages):
    got = {r.page_id: r for r in run(spark, sf, "op4")}
    assert {i: (r.url, r.text, r.n_chars) for i, r in got.items()} == {i: (u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in pages}
    judged = {r.page_id: r for r in run(spark, sf, "op9")}
    for i, url, _ in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = judged[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert len(judged) == len(pages)


def test_mixing(spark, sf, rows):
    size, total, target = reference_mix(rows)
    source, own = {r[0]: r[3] for r in rows}, {r[0]: n for r, n in zip(rows, size, strict=True)}
    taken = Counter()
    for r in run(spark, sf, "op5"):
        assert (r["size"], r.source_size) == (own[r.doc_id], total[source[r.doc_id]]) and r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(own[i] for i in own if source[i] == s)


def test_vectors(spark, sf, vectors):
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[link[i]].min() for i in range(len(x))])
    want = {i: (int(link[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {90: (0, 90, True), 91: (0, 91, True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, sf, "op6")} == want


def test_language_model(spark, sf, rows):
    count = Counter()
    for r in rows:
        if crc(r[0]) % 10:
            count.update([*words_of(r[1]), None])
    total, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in run(spark, sf, "op8")}
    for i, text, *_ in rows:
        t = [*words_of(text), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 10 == 0, len(t), sum(x in count for x in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (v + 1))) for x in t)) and r.score < 0
    assert len(got) == len(rows)


def test_digests(spark, sf, rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in run(spark, sf, "op10")}
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) and (r.near_next == 1.0) == (r.fingerprint == got[after[0]].fingerprint)
    prints = {}
    for i, text, *_ in rows:
        assert prints.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint
    assert html.unescape("&lt;") == "<"


def test_pipeline_stage_by_stage(spark, sf, rows):
    """Every stage against brute force on its own input; run() is the stages in order."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    language, good, distinct, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"size": F.lit(1), "key": F.lit("k"), "n": F.lit(None).cast("int"), "__id": F.lit(4)})
    one = language(spark, docs, sf).cache()
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or ""))
    two = good(spark, one, sf).cache()
    kept = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and not [i for i in kept if i < 80 and " | " in kept[i].text]
    assert len([i for i in range(80) if i in kept]) == len([r for r in rows if r[0] < 80 and " | " not in r[1]])
    three = distinct(spark, two, sf).cache()
    _, label = components({i: r.text for i, r in kept.items()}, 5, 4, 5)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(set(label.values()))
    four = mixed(spark, three, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(three, weights=(5, 2, 1), share=1.5, repeats=2.0).collect()}
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == {i: n for i, n in copies.items() if n}
    five = packed(spark, four, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five) == tokenised([(r.doc_id, r.text) for r in four.collect()])
    full = Counter()
    for r in five:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048 and len(full) <= math.ceil(sum(full.values()) / 2048) + 1
    plain = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in plain.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in five)


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    """Empty tables, null and repeated ids, repeated rows, no labels."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.createDataFrame([], spark.read.parquet(f"{sf}/labels.parquet").schema).write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.collect() == [] and {"doc_id", "piece", "sequence_id"} <= set(none.columns)
    words = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    odd = [(None, words, "en", None, 1), (7, words + " end", "en", "a", 1), (7, words + " end", "en", "a", 1), (7, "another text of the same id here", "en", "a", 1), (8, None, None, None, None), (9, "", "en", "b", 0)]
    three = corpus_pipeline.distinct(spark, spark.createDataFrame(odd, schema), sf).collect()
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in three) == [(7, "another"), (7, words[:7]), (8, ""), (9, "")]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], spark.read.parquet(f"{sf}/labels.parquet").schema).write.parquet(f"{tmp_path}/odd/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert got == {7}


def test_line_labels(spark):
    """Labels change inside a document: junk lines in good texts are found, which needs line labels of their own."""
    from lattica.llm import quality

    rng, rows, labels, truth = random.Random(2), [], [], {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    for i in range(160):
        bad = i % 2
        kinds = [int(rng.random() < (0.85 if bad else 0.1)) for _ in range(rng.randint(6, 14))]
        lines = [" | ".join(word().upper() + str(rng.randrange(99)) for _ in range(6)) if k else " ".join(word() for _ in range(9)) + "." for k in kinds]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1 - bad, 0))
        truth |= {(i, n): 1 - k for n, k in enumerate(kinds)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    got = quality.label_lines(docs, model).collect()
    assert len(got) == len(truth) and sum(r.label == truth[r.doc_id, r.line] for r in got) > 0.95 * len(got)
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in quality.score(docs, model).collect()) >= 150
    assert all(r.n_bytes == len(rows[r.doc_id][1].split("\n")[r.line].encode()) for r in got)
    assert quality.label_lines(docs.limit(0), model).collect() == []
