"""Mixing sources to target weights, without sorting and without Python on the executors.

Every document gets a fixed hash. Words are summed by source and hash bucket; the running
sum over a source's buckets shows in which bucket its budget runs out, and only that bucket is
cut into finer ones, until a single hash is left. A document is then taken by comparing its
hash with its source's threshold. Thresholds are nested: a smaller budget takes a subset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import n_words, staged

#: Hash bits by which each level tells documents apart; the last is the whole hash.
LEVELS = (12, 24, 60)
HASH_BITS = 60
#: Sources that are sorted together, about.
RANGE_ROWS = 1 << 18


def document_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's digits: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows, with the sums over all rows before each in an order that tells every row apart.

    Ranges of some ``RANGE_ROWS`` rows are sorted by themselves; one task adds up a row for each range."""
    ranges = 1 + rows.count() // RANGE_ROWS
    placed = staged(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    upto = (Window.unboundedPreceding, -1)
    each = placed.groupBy("_range").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    over = Window.orderBy("_range").rowsBetween(*upto)
    each = each.select(F.col("_range"), *[F.coalesce(F.sum(name).over(over), F.lit(0)).alias(f"_{name}") for name in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(*upto)
    inside = {name: F.coalesce(F.sum(x).over(own), F.lit(0)) + F.col(f"_{name}") for name, x in sums.items()}
    return placed.join(F.broadcast(each), "_range").withColumns(inside).drop("_range", *[f"_{name}" for name in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Per source: its words, its target and the whole copies and rest that reach it.

    ``share`` is the fraction of all words to take (3, 2 is 150 %). Targets follow the weights
    and stop at ``most`` times the source's words; the rest is shared again by weight among
    those below, which ends where one level fits all of them. In the order of cap by weight
    that level is found with running sums, in whole numbers. There is one row per source here, and sources are
    sorted in ranges, so that no task gets all of very many, as where each host is one.
    """
    num, den = share
    exact = "decimal(38,0)"
    cycle = F.array(*[F.lit(w) for w in weights])
    by_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    out = running_sums(by_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    out = out.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    words, weight = (x or 0 for x in out.agg(F.sum("source_size"), F.sum("weight")).first())
    by_level = [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()]
    out = running_sums(out, by_level, {"capped": F.col("cap"), "passed": F.col("weight")})
    # What is left for this source and all after it, times den.
    out = out.withColumn("left", F.lit(words * num) - F.col("capped") * den).withColumn("left_weight", F.lit(weight) - F.col("passed"))
    fits = F.col("left").cast(exact) * F.col("weight") <= F.col("cap").cast(exact) * den * F.col("left_weight")
    level = out.filter(fits).agg(F.min_by(F.struct("left", "left_weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).first()[0]
    cap = F.col("cap").cast("double")
    # Ties of the order lie on one level, so that the smaller of both holds for every source.
    out = out.withColumn("target", F.least(cap, F.lit(level[0]) * F.col("weight") / F.lit(level[1] * den)) if level else cap)
    words = F.floor("target").cast("long")
    base = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    base = F.when(base * F.col("source_size") > words, base - 1).otherwise(base)
    return out.select("source", "source_size", "target", base.alias("base"), (words - base * F.col("source_size")).alias("rest"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds per source the hash at which its rest runs out, the words that remain for the
    documents of that hash, and the words they have."""
    at = targets.filter("rest > 0").select("source", F.col("rest").alias("remains"), F.lit(0).cast("long").alias("prefix"))
    rows, before = sizes.filter("size > 0"), 0
    for bits in LEVELS:
        # Only the boundary bucket of the level before is read on.
        inside = rows.withColumn("prefix", F.shiftright("hash", HASH_BITS - before))
        inside = inside.join(at, (inside.source.eqNullSafe(at.source)) & (inside.prefix == at.prefix), "left_semi")
        sums = inside.groupBy("source", F.shiftright("hash", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(running)).alias("s")
        edge = sums.join(at.select("source", "remains").alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")))
        edge = edge.filter("upto - words <= remains and remains < upto")
        at = staged(edge.select("s.source", (F.col("remains") - (F.col("upto") - F.col("words"))).alias("remains"), F.col("bucket").alias("prefix"), "words"), "mix-edge")
        before = bits
    at = at.select(F.col("source").alias("at_source"), F.col("prefix").alias("at_hash"), "remains", F.col("words").alias("at_words"))
    return targets.join(at, targets.source.eqNullSafe(at.at_source), "left").drop("at_source")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, cut_boundary: bool = True) -> DataFrame:
    """How many words the mix takes from each document: doc_id, source, size, source_size, target, taken.

    A source's target of t words over its s words takes every document ``t // s`` times and
    those below the hash threshold once more. The document at the threshold gives just the words
    that are left (``cut_boundary``), so that a source misses its target by less than a word;
    or else it is taken whole where that comes nearer. Rows that share a doc_id share
    its hash and divide what is left by their sizes. Null texts and texts without words have
    size 0 and are taken with 0 words. No row is lost; an empty table gives an empty table.
    """
    sizes = staged(_sized(docs).select("doc_id", "source", "size", "hash"), "mix-sizes")
    return _taken(sizes, _source_plan(sizes, weights, share, most), cut_boundary).select("doc_id", "source", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": n_words(docs.text), "hash": document_hash(docs.doc_id)})


def _source_plan(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    return staged(thresholds(sizes, staged(source_targets(sizes, weights, share, most), "mix-targets")), "mix-plan").withColumnRenamed("source", "of")


def _taken(rows: DataFrame, plan: DataFrame, cut_boundary: bool) -> DataFrame:
    """The rows (source, size, hash and more) with source_size, target and taken.

    The plan has one row per source. Its measured size decides whether Spark broadcasts it, or else
    joins by source, where it splits a hot one."""
    rows = rows.join(plan, rows.source.eqNullSafe(plan["of"]))
    exact = "decimal(38,0)"
    part = F.floor(F.col("remains").cast(exact) * F.col("size").cast(exact) / F.col("at_words").cast(exact)).cast("long")
    edge = part if cut_boundary else F.when(F.col("remains") * 2 >= F.col("at_words"), F.col("size")).otherwise(0)
    extra = F.when(F.col("hash") < F.col("at_hash"), F.col("size")).when((F.col("hash") == F.col("at_hash")) & (F.col("at_words") > 0), edge).otherwise(0)
    return rows.withColumn("taken", (F.col("base") * F.col("size") + extra).cast("long"))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The documents of the mix, each as often as it is taken, whole and with all its columns.

    The document at a threshold is taken once more where that comes nearer to the target.
    Documents without words are kept once, as they cost nothing. Texts aren't shuffled unless the table
    of sources is too large to broadcast.
    """
    sizes = staged(_sized(docs).select("doc_id", "source", "size", "hash"), "mix-sizes")
    plan = _source_plan(sizes, weights, share, most)
    # The documents' own columns travel in one, so that none clashes.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), docs.source.alias("source"), n_words(docs.text).alias("size"), document_hash(docs.doc_id).alias("hash"))
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    out = _taken(rows, plan, cut_boundary=False).withColumn("copies", copies.cast("int")).filter("copies > 0")
    return out.select("_doc", F.explode(F.expr("sequence(1, copies)"))).select("_doc.*")
