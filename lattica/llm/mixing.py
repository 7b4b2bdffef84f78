"""Mixing sources to target weights by thresholds on a hash.

Every document has a uniform 60-bit hash. Sizes are summed by source and the leading bits of the hash; the bucket in
which a source's budget ends is the boundary, and only boundary buckets are summed again, by their next bits, until
single hash values remain. Documents whose hash is at most their source's threshold are taken, so the corpus is never
sorted, and a smaller budget always takes a subset of a larger one's documents.

A source whose target exceeds its size is taken whole once and its rest by threshold. The document at the threshold is
taken if that brings the source nearer to its target.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; rows with equal source and
doc_id share one hash and are taken or left together; with no words at all, all targets are 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

#: Bits of the hash, by level of the search.
LEVELS = (12, 16, 16, 16)
#: Sources of at most this many are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, salt: str = "") -> Column:
    """60 bits of MD5, so that other engines can compute it too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """source, source_size, target of each source. sizes: source, size.

    The targets share `share` times the whole by weight, none above `repeats` times its source. Capping is repeated
    aggregation over the sources: each round fixes the level that the sources not yet capped share.
    """
    rank = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    rank = stage(rank.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), "sources")
    before, shift = 0, []
    for r in rank.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition of the sort
        shift.append((r["__part"], before))
        before += r["count"]
    spark = sizes.sparkSession
    starts = spark.createDataFrame(shift or [(0, 0)], "__part long, __start long")
    place = (F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.lit([float(w) for w in weights]).cast("array<double>"), place.cast("int") + 1)
    ranked = rank.join(F.broadcast(starts), "__part").select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    total, level = float(share) * (rank.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while total:
        # the sum is over whole numbers, so it doesn't depend on the order of the rows
        r = ranked.agg(F.sum(F.when(F.col("cap") <= level * F.col("weight"), F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(F.col("cap") > level * F.col("weight"), F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not r["open"]:
            break
        new = (total - repeats * r["full"]) / r["open"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows joined to a table of one row a source."""
    s = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(s) if n <= BROADCAST_SOURCES else s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix_plan(rows: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> tuple[DataFrame, int]:
    """source, source_size, target, whole, last of each source, and the number of sources. rows: source, size, h.

    A document is taken `whole` times, and once more if its hash is at most `last`.
    """
    targets = stage(source_targets(rows, weights, share, repeats), "targets")
    n = targets.count()
    plain = targets.select("source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"), "source_size", "target")
    goal = plain.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    # threshold of each source: lo is the start of its boundary bucket, before the words below it
    bound = goal.select("source", "need", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("before"))
    bits = sum(LEVELS)
    for level in LEVELS:
        wide, bits = bits, bits - level
        inside = _with_sources(rows.where("size > 0").select("source", "size", "h"), bound, n)
        inside = inside.where((F.col("h") >= F.col("lo")) & (F.shiftright(F.col("h") - F.col("lo"), wide) == 0))
        sums = inside.groupBy("source", "need", "before", F.shiftright("h", bits).alias("b")).agg(F.sum("size").alias("s"))
        run = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.col("before") + F.sum("s").over(run)).withColumn("start", F.col("upto") - F.col("s"))
        # the last bucket that begins below the need holds the boundary
        last = sums.where(F.col("start") < F.col("need")).groupBy("source").agg(F.max_by(F.struct("b", "start", "need"), "b").alias("x"))
        bound = stage(last.select("source", "x.need", F.shiftleft("x.b", bits).alias("lo"), F.col("x.start").alias("before")), "bound")
    # at single hash values: take the one at the boundary if its middle is not beyond the need
    edge = _with_sources(rows.where("size > 0").select("source", "size", "h"), bound, n).where("h = lo").groupBy("source", "need", "lo", "before").agg(F.sum("size").alias("s"))
    edge = edge.select("source", F.when(F.col("before") + F.col("s") / 2 <= F.col("need"), F.col("lo")).otherwise(F.col("lo") - 1).alias("last"))
    plan = goal.join(edge.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    return stage(plan, "plan"), n


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0, salt: str = "") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row of docs."""
    rows = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), salt).alias("h")), "sized")
    plan, n = mix_plan(rows, weights, share, repeats)
    out = _with_sources(rows, plan, n).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take_copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0, salt: str = "") -> DataFrame:
    """The mix itself: the rows of docs that are taken, as often as they are taken."""
    rows = stage(docs.select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), salt).alias("h")), "sized")
    plan, n = mix_plan(rows, weights, share, repeats)
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    out = _with_sources(docs.select(*named, "source", hash_of(F.col("doc_id"), salt).alias("h")), plan, n).withColumn("copies", _copies())
    out = out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
