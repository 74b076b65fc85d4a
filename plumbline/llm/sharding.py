"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the first bits of a key's hash. A bucket splits on another bit only
while its bytes are over the limit; all others stay as they are. Sizes by prefix are summed
from one aggregation at a depth at which buckets are small for even keys; only prefixes that
are over the limit there are looked at again, ``STEP`` bits deeper, until the hash ends.
Rows find their bucket by one join on the bits that all buckets have, and then among the few
buckets below these. Where rows of one key are over the limit, no bit can part them: their bucket is cut
into parts by the rows' running bytes, rows of more than half the limit being parts of their own.
So no shard is over the limit unless it is a single row that is.

``write_shards`` deals the rows by shard and writes one file for each.

Defined results: a null key is hashed like the empty text, null text has 0 bytes; a row over
the limit is a shard of its own if its key is over-full, as it then is; repeated rows share a bucket;
an empty table gives no rows; added columns replace columns of the same names, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small

BITS = 60
STEP = 6


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 digest of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _leaves(sums: DataFrame, at: int, top: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """From bytes by prefix of ``at`` bits: buckets that end the directory between ``top`` and ``at`` bits,
    as rows (prefix, depth, bytes), and the prefixes that are still over the limit."""
    deep = sums.select(F.explode(F.sequence(F.lit(top), F.lit(at))).alias("depth"), "prefix", "bytes")
    level = deep.withColumn("prefix", F.expr(f"shiftright(prefix, {at} - depth)")).groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    level = saved(level, "levels")
    parent = level.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("bytes").alias("above_bytes"))
    split = level.withColumn("above", F.shiftright("prefix", 1)).join(parent, ["depth", "above"], "left")
    ends = split.filter((F.col("bytes") <= limit) & ((F.col("depth") == top) | (F.col("above_bytes") > limit)))
    over = level.filter((F.col("depth") == at) & (F.col("bytes") > limit))
    return ends.select("prefix", "depth", "bytes"), over.select("prefix", "bytes")


def extendible_shards(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """The directory (prefix, depth, bytes) and ``docs`` with their place in it: bytes, prefix, depth, part."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = saved(docs.select(key_hash(F.col(key_col)).alias("hash"), size.alias("bytes")), "keys")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at = min(BITS, max(1, (max(1, total // limit_bytes)).bit_length() + STEP))
    sums = rows.groupBy(F.shiftright("hash", BITS - at).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    directory, over = _leaves(sums, at, 0, limit_bytes)
    over = saved(over, "over")
    while at < BITS and not over.isEmpty():
        deeper = min(BITS, at + STEP)
        inside = rows.withColumn("above", F.shiftright("hash", BITS - at)).join(small(over.select(F.col("prefix").alias("above"))), "above", "left_semi")
        sums = inside.groupBy(F.shiftright("hash", BITS - deeper).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        ends, over = _leaves(sums, deeper, at + 1, limit_bytes)
        directory, over, at = directory.unionByName(ends), saved(over, "over"), deeper
    directory = saved(directory.unionByName(over.select("prefix", F.lit(BITS).alias("depth"), "bytes")), "directory")

    # buckets by the bits that all have: few each, as the hash is even and a key's path has one for each bit
    shared = directory.agg(F.min("depth")).first()[0] or 0
    leaf = F.struct("prefix", F.col("depth").cast("int").alias("depth"), (F.col("bytes") > limit_bytes).alias("full"))
    below = directory.select(F.expr(f"shiftright(prefix, depth - {shared})").alias("top"), leaf.alias("leaf")).groupBy("top").agg(F.collect_list("leaf").alias("leaves"))
    kept = [c for c in docs.columns if c.lower() not in ("bytes", "prefix", "depth", "part")]
    keyed = docs.select(F.struct(*kept).alias("row"), key_hash(F.col(key_col)).alias("hash"), size.alias("bytes")).withColumn("top", F.shiftright("hash", BITS - shared))
    own = F.filter("leaves", lambda x: F.call_function("shiftright", F.col("hash"), F.lit(BITS) - x["depth"]) == x["prefix"])
    placed = keyed.join(small(saved(below, "buckets")), "top").withColumn("leaf", F.get(own, F.lit(0))).select("row", "bytes", "leaf.prefix", "leaf.depth", "leaf.full")
    if directory.filter(F.col("bytes") > limit_bytes).isEmpty():
        return directory, placed.select("row.*", "bytes", "prefix", "depth", F.lit(0).alias("part"))

    # parts of an over-full key: running bytes by file of the written table, then within the file
    half = limit_bytes // 2
    cut = saved(placed.filter("full"), "overfull")
    cut = cut.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    cut = cut.withColumn("light", F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)).withColumn("heavy", (F.col("bytes") > half).cast("int"))
    key = ["prefix", "depth"]
    by_file = saved(cut.groupBy(*key, "file").agg(F.sum("light").alias("light_sum"), F.sum("heavy").alias("heavy_sum")), "by-file")
    upto = Window.partitionBy(*key).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = by_file.select(
        *key, "file", F.coalesce(F.sum("light_sum").over(upto), F.lit(0)).alias("light_before"), F.coalesce(F.sum("heavy_sum").over(upto), F.lit(0)).alias("heavy_before"),
        F.sum("light_sum").over(Window.partitionBy(*key)).alias("light_all"),
    )
    run = Window.partitionBy(*key, "file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.join(small(saved(before, "before")), [*key, "file"])
    light = F.floor((F.col("light_before") + F.sum("light").over(run) - F.col("light")) / F.lit(max(1, half)))
    heavy = F.floor(F.col("light_all") / F.lit(max(1, half))) + F.col("heavy_before") + F.sum("heavy").over(run)
    cut = cut.withColumn("part", F.when(F.col("heavy") == 1, heavy).otherwise(light).cast("int"))
    done = placed.filter("NOT full").withColumn("part", F.lit(0)).select("row", "bytes", *key, "part").unionByName(cut.select("row", "bytes", *key, "part"))
    return directory, done.select("row.*", "bytes", *key, "part")


def write_shards(placed: DataFrame, folder: str) -> DataFrame:
    """Writes the rows with one Parquet file for each shard, in folders depth=/prefix=/part=, and gives the table as read from these."""
    shard = ["depth", "prefix", "part"]
    placed.repartition(*shard).write.partitionBy(*shard).option("compression", "zstd").parquet(folder)
    inner = [f for f in placed.schema.fields if f.name not in shard]
    kinds = [placed.schema[c] for c in shard]
    return placed.sparkSession.read.schema(T.StructType([*inner, *kinds])).parquet(folder)
