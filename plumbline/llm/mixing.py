"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every source gets a target of words. Of a source that needs more than it has, whole epochs
come first; the rest is a weighted sample without replacement: each document draws an
exponential key ``-ln(u) / w`` (w: its quality weight), and in order of the keys documents
are taken until the prefix sum of their sizes reaches the rest of the budget. The document
at which it does is taken if that brings the sum nearer.

Prefix sums don't sort a source in one task: sizes are first summed by slice of the key's
range, the slices are prefix-summed, and only the documents of the slice that holds the
boundary are sorted. The outcome is one boundary key for each source, and documents are
then decided row by row, without a shuffle of texts.

Defined results: null text has size 0; a null source is a source of its own and comes last;
a null id is a value like others; rows alike in id and text share a key and are taken
together; an empty table gives no rows; documents of size 0 are taken like others and add 0.
Added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

SLICES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Quality weight of a text, 0.25 to 2: it falls with the symbols for each word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return F.greatest(F.lit(0.25), 2.0 - 4.0 * symbols / F.greatest(n_words(text), F.lit(1)))


def uniform(seed: int, *cols: Column) -> Column:
    """A number between 0 and 1, never 0 or 1, from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their rank (from 0) by key: ranges are numbered one by one, then shifted."""
    placed = saved(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    inner = placed.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).withColumnRenamed("part", "before")
    shifts = (
        placed.select("part").distinct().join(sizes, F.col("before") < F.col("part"), "left")
        .groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shift"))
    )
    return inner.join(shifts, "part").withColumn("rank", F.col("shift") + F.col("in_part")).drop("part", "in_part", "shift")


def source_targets(sources: DataFrame, weights: list[float], total_share: float, most: float) -> DataFrame:
    """``target`` for each source (columns key, source_size): shares of ``total_share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared
    again by weight among the others, until none is above."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = saved(_numbered(sources).withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))), "weighted")
    cap = most * F.col("source_size")
    level, rest, total = 0.0, None, None
    while True:  # each round caps one source more at least; a round reads one row for each source
        over = cap <= level * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(over, cap)).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("left"),
        ).first()
        total = total_share * (row.total or 0)
        if not row.left or row.left == rest:
            break
        level, rest = (total - (row.capped or 0.0)) / row.left, row.left
    return ranked.withColumn("target", F.least(cap, level * F.col("weight")).cast("double"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2.0,
    quality: Column | None = None, seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the document) and taken
    (copies times size). ``weights`` go to the sources in order of code points and repeat."""
    text = F.col(text_col)
    quality = text_quality(text) if quality is None else quality
    key_of = F.when(F.col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source_col).cast("string")))
    draw = -F.ln(uniform(seed, F.col(id_col), text)) / quality
    slice_of = F.least(F.floor((1 - F.exp(-F.col("draw"))) * SLICES), F.lit(SLICES - 1)).cast("int")
    narrow = saved(docs.select(key_of.alias("key"), n_words(text).alias("size"), draw.alias("draw")).withColumn("slice", slice_of), "keys")
    slices = narrow.groupBy("key", "slice").agg(F.sum("size").alias("sum"))
    slices = saved(slices, "slices")
    sources = slices.groupBy("key").agg(F.sum("sum").alias("source_size"))
    targets = source_targets(sources, list(weights), total_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = saved(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    by_slice = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        slices.withColumn("upto", F.sum("sum").over(by_slice)).join(targets.select("key", "rest"), "key")
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("sum") < F.col("rest")))
        .select("key", "slice", "rest", (F.col("upto") - F.col("sum")).alias("start"))
    )
    edge = saved(edge, "edges")
    inside = narrow.join(edge, ["key", "slice"]).groupBy("key", "draw").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    upto = F.col("start") + F.sum("sum").over(Window.partitionBy("key").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    nearer = F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("upto") - F.col("sum") - F.col("rest"))
    taken_up = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("sum") < F.col("rest")) & nearer)
    cuts = inside.withColumn("upto", upto).filter(taken_up).groupBy("key").agg(F.max("draw").alias("last_draw"))
    bounds = saved(
        targets.join(edge.select("key", F.col("slice").alias("edge")), "key", "left").join(cuts, "key", "left")
        .select("key", "source_size", "target", "epochs", "edge", "last_draw"), "bounds",
    )
    # documents of earlier slices are all taken; in the boundary's slice those up to its last key
    chosen = F.col("edge").isNotNull() & ((F.col("slice") < F.col("edge")) | ((F.col("slice") == F.col("edge")) & F.coalesce(F.col("draw") <= F.col("last_draw"), F.lit(False))))
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c.lower() not in added]
    decided = docs.select(
        F.struct(*keep).alias("row"), key_of.alias("key"), n_words(text).alias("size"), draw.alias("draw"),
    ).withColumn("slice", slice_of).join(bounds, "key")
    decided = decided.withColumn("copies", F.col("epochs") + chosen.cast("long"))
    return decided.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` says."""
    return mixed.filter(F.col("copies") > 0).withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
