"""Records of delimited files whose cells hold line breaks, read in splits.

A split can't tell by itself whether it begins inside a quoted cell. One pass counts the quotes of each split; their
running sum along the file tells of every split whether it begins inside (an odd number before it). Then each
split puts its own lines together to records. What it begins inside of, and what it leaves open, are pieces that are
joined along the file: at most two for each split, whatever the number of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import stored

QUOTE = '"'
#: What a row of ``_split_records`` is: a record, the end of one begun in a split before, one left open, or a stretch inside of one.
WHOLE, END, OPEN, INSIDE = range(4)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file and block (where the split begins) of each line; the order within a split is the file's."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def quotes_in(line: str) -> F.Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(QUOTE)))


def split_starts(lines: DataFrame) -> DataFrame:
    """file, block, inside (whether the split begins inside a quoted cell): one row for each split."""
    counted = lines.groupBy("file", "block").agg((F.sum(quotes_in("value")) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    return counted.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, piece, text of rows (value, file, block, inside) in the order of the splits' lines."""
    now, held, begun, first = None, [], False, False  # the split, its open lines, whether it was open before the split, the file's first record

    def rows(made: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "block", "piece", "text"])

    def left() -> list[tuple[str, int, int, str]]:
        if not held or now is None:
            return []
        return [(*now, INSIDE if begun else OPEN, "\n".join(held))]

    for batch in batches:
        odd = pc.bit_wise_and(pc.count_substring(batch["value"], QUOTE), 1).to_numpy(zero_copy_only=False)
        files, blocks = batch["file"].to_pylist(), batch["block"].to_numpy()
        inside = batch["inside"]
        if inside.null_count:
            raise ValueError("the file's splits changed between two passes; read it again")
        inside = inside.to_pylist()
        values, made = batch["value"], []
        cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.array(files[1:], object) != np.array(files[:-1], object))) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if (files[lo], int(blocks[lo])) != now:
                made += left()
                now, held, begun = (files[lo], int(blocks[lo])), [], inside[lo]
                first, is_open = now[1] == 0, inside[lo]
            else:
                is_open = bool(held)
            state = (np.cumsum(odd[lo:hi]) + is_open) % 2  # after each line
            before = np.concatenate([[int(is_open)], state[:-1]])
            single = (state == 0) & (before == 0)
            texts = values.slice(lo, hi - lo).to_pylist()
            for alone, after, text in zip(single.tolist(), state.tolist(), texts, strict=True):
                if not alone:
                    held.append(text)
                    if after:
                        continue
                    text, piece = "\n".join(held), END if begun else WHOLE
                    held, begun = [], False
                else:
                    piece = WHOLE
                if first:  # the header
                    first = False
                    continue
                made.append((*now, piece, text.removesuffix("\r")))
        yield rows(made)
    yield rows(left())


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of headed files, line breaks within quotes and all, without the headers and blank lines. A quote that is never
    closed takes all that follows it in its file into one record."""
    lines = lines_of(spark, path)
    starts = stored(split_starts(lines))
    placed = lines.join(F.broadcast(starts), ["file", "block"], "left").select("value", "file", "block", "inside")  # a row for each split
    made = placed.mapInArrow(_split_records, "file string, block bigint, piece int, text string")
    pieces = made.filter(F.col("piece") != WHOLE)
    number = F.sum((F.col("piece") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy("block", F.col("piece") == OPEN))  # two rows for each split at most
    joined = pieces.withColumn("number", number).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max((F.col("piece") == OPEN).cast("int")).alias("opened"))
    joined = joined.filter("opened = 1").select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record"))
    return made.filter(F.col("piece") == WHOLE).select(F.col("text").alias("record")).unionByName(joined).filter(F.trim("record") != "")
