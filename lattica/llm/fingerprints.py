"""Canonical exact digests of documents, in DataFrame functions only.

A text's canonical form is its NFKC form, full case folding, NFKC again, every run of white space one space, trimmed.
The digest is 128 bits: two xxhash64 lanes over the canonical bytes, the second salted. Documents of equal digest are
grouped, and inside a bucket of two or more the canonical bytes themselves are compared.

Defined cases: a null text counts as empty, and all empty texts are copies of each other. Rows that repeat a doc_id are
ordered by text. A null doc_id sorts below every other and never names a group unless all ids in it are null. Extra
columns are ignored. With one row, the next document is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

#: Documents in one range of the ordered walk, and the most ranges (the driver holds one id for each).
RANGE_ROWS, RANGES = 2_000, 8_192
#: A list of digests of at most this many is broadcast; a longer one is joined by shuffle.
BROADCAST_DIGESTS = 500_000
#: Digests of more documents than this, and than a thousandth of all, are joined by broadcast in any case.
HEAVY = 1_000


def _icu(cls: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case and white space folded."""
    plain = _icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")))
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", plain))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits of two xxhash64 lanes."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))))


def fingerprint(text: Column) -> Column:
    return digest(canonical(text))


def copies(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """fingerprint, part, copy_of, n: for each digest of two or more documents, the smallest doc_id of each set of byte-equal canonical texts.

    part is null unless texts of one digest differ; it is then the canonical text that the row stands for. prints: the
    digests of docs, one row a document.
    """
    twice = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    few = F.broadcast(twice) if twice.count() <= BROADCAST_DIGESTS else twice
    own = docs.select(F.col("doc_id"), canonical("text").alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    met = own.join(few, "fingerprint", "left_semi")
    by = met.groupBy("fingerprint").agg(F.min("canon").alias("c1"), F.max("canon").alias("c2"), F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    by = stage(by.select("fingerprint", (F.col("c1") == F.col("c2")).alias("same"), "copy_of", "n"), "buckets")
    same = by.where("same").select("fingerprint", F.lit(None).cast("string").alias("part"), "copy_of", "n")
    clash = by.where("not same").select("fingerprint")
    if clash.isEmpty():
        return same
    apart = met.join(clash, "fingerprint", "left_semi").groupBy("fingerprint", F.col("canon").alias("part")).agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    return same.union(apart)


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most key: binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    n = 1 << (len(bounds).bit_length() - 1)
    steps = [n >> i for i in range(n.bit_length())]
    all_ = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.element_at(all_, F.least(at + s, F.lit(len(bounds)))) <= key), at + s).otherwise(at))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the next document in descending doc_id; after the last comes the first.

    Documents are dealt to ranges of doc_id; the first document of each range is also dealt to the range before it, as its
    guest, so one shuffle and one sort a range are enough.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.count()
    want = min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1))
    cuts = docs.agg(F.percentile_approx(key, [i / want for i in range(1, want)], 100 * want if want <= 100 else 10_000)).first()[0] if want > 1 and rows else []
    bounds = sorted(set(cuts or []))
    ranged = docs.withColumn("__key", key).withColumn("__range", _below(bounds, F.col("__key")))
    heads = {r["__range"]: r["head"] for r in ranged.select("__range", "__key").groupBy("__range").agg(F.max("__key").alias("head")).collect()}
    order = sorted(heads)
    before = {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}  # whose guest each range's head is
    ids, to = [heads[r] for r in order], [before[r] for r in order]
    if not order:
        ids, to = [0], [0]
    # head i belongs to range order[i]; ranges are few, and are looked up by position
    at = F.array_position(F.lit(order or [0]).cast("array<int>"), F.col("__range")).cast("int")
    guest = F.when(F.element_at(F.lit(ids).cast("array<bigint>"), at) == F.col("__key"), F.element_at(F.lit(to).cast("array<int>"), at))
    dealt = ranged.withColumn("__to", guest).withColumn("__deal", F.explode(F.when(F.col("__to").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("g")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("__to").alias("r"), F.lit(True).alias("g"))))))
    dealt = dealt.select(*docs.columns, "__key", F.col("__deal.r").alias("__r"), F.col("__deal.g").alias("__g"))
    w = Window.partitionBy("__r").orderBy("__g", F.desc("__key"), "text")
    out = dealt
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where("not __g").drop("__key", "__r", "__g")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, copy_of."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    own = own.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", F.xxhash64("text").alias("text_hash")
    )
    near = lambda c: F.when(F.col("fingerprint") == F.col(c), 1.0).otherwise(0.0)
    own = stage(own.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), "text_hash"), "digests")
    groups = copies(docs, own.select("fingerprint"))
    alike, clash = groups.where("part is null").select("fingerprint", "copy_of", "n"), groups.where("part is not null")
    columns = [c for c in own.columns if c != "text_hash"]
    named = lambda df: df.select(*columns, F.coalesce("copy_of", "doc_id").alias("copy_of"))
    if not clash.isEmpty():  # texts of one digest that differ: their rows are known by the text's own hash and doc_id
        met = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), canonical("text").alias("part")).withColumn("fingerprint", digest(F.col("part")))
        met = met.join(clash, ["fingerprint", "part"]).select("fingerprint", "__id", "__hash", F.col("copy_of").alias("__copy")).distinct()
        own = own.join(met, (own["fingerprint"] == met["fingerprint"]) & own["doc_id"].eqNullSafe(met["__id"]) & (own["text_hash"] == met["__hash"]), "left").select(*(own[c] for c in columns), "__copy")
        named = lambda df: df.select(*columns, F.coalesce("copy_of", "__copy", "doc_id").alias("copy_of"))
    if alike.count() <= BROADCAST_DIGESTS:
        return named(own.join(F.broadcast(alike), "fingerprint", "left"))
    # digests that very many documents share, at most a thousand of them, would each be one hot key of the join
    heavy = max(HEAVY, own.count() // 1000)
    some = F.broadcast(alike.where(F.col("n") > heavy))
    rest = own.join(some.select("fingerprint"), "fingerprint", "left_anti")
    return named(own.join(some, "fingerprint")).union(named(rest.join(alike.where(F.col("n") <= heavy), "fingerprint", "left")))
