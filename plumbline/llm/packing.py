"""Best-fit packing by the sum-of-squares rule.

A piece goes to the open bin, or to a new one, for which the sum over all levels of the
squared number of open bins at that level becomes smallest (of equal ones, the fullest bin).
Pieces are dealt at random into groups of ``group_pieces``, so that a group fits in a task
whatever the table's size; each group is packed on its own. Bins that a group leaves under
``reopen_below`` of the capacity are taken apart and their pieces, now the longest first, are
packed once more in fewer groups, until one group is left or ``rounds`` are over; what then
stays open is the last groups' remainder, a bounded number of bins for each.

Defined results: a piece of the whole capacity is a sequence of its own; pieces of length 0
take no place and stand in a sequence at the offset where it is cut off; repeated rows are
pieces of their own; lengths that are null, negative or over the capacity are an error; an
empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given; lengths are 1 to capacity."""
    at_level = np.zeros(capacity + 1, np.int64)  # open bins by level; new bins have level 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for k, size in enumerate(lengths.tolist()):
        if size == capacity:
            bins[k], offsets[k], made = made, 0, made + 1
            continue
        # change of the sum: levels 1 to capacity - size; at the last one the bin is closed and counts no more
        here = at_level[1 : capacity - size + 1]
        change = 2 * (at_level[size + 1 :] - here + 1)
        change[-1] -= 1
        change[here == 0] = never
        back = int(change[::-1].argmin())
        level = capacity - size - back
        if change[level - 1] > 2 * at_level[size] + 1:
            level = 0
        if level:
            which = stacks[level].pop()
            at_level[level] -= 1
        else:
            which, made = made, made + 1
        bins[k], offsets[k] = which, level
        if level + size < capacity:
            stacks[level + size].append(which)
            at_level[level + size] += 1
    return bins, offsets


def pack(
    pieces: DataFrame, *, length_col: str = "length", capacity: int = 2048, group_pieces: int = 60_000, rounds: int = 3,
    reopen_below: float = 0.98,
) -> DataFrame:
    """``pieces`` with sequence_id and offset; both replace columns of these names.

    Rows travel whole to their group, so give it narrow rows: the ids of the pieces can be
    joined to the result by document and piece."""
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    checked = F.when(F.col(length_col).between(0, capacity), F.col(length_col)).otherwise(F.raise_error(F.concat(F.lit("a piece's length is not from 0 to the capacity: "), F.coalesce(F.col(length_col).cast("string"), F.lit("null")))))
    rows = saved(pieces.select(F.struct(*keep).alias("row"), checked.cast("long").alias("n")), "pieces")
    # a number for each row that doesn't change when a task runs again: its place in the table just written
    left = rows.select("row", "n", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("deal"))
    done: list[DataFrame] = []
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n bigint, deal bigint, bin bigint, offset bigint, open boolean, group bigint"

    def packed(pdf: pd.DataFrame, again: bool) -> pd.DataFrame:
        group = pdf["group"].iloc[0]
        pdf = pdf.sort_values(["n", "deal"], ascending=[False, True]) if again else pdf.sort_values("deal")
        pdf = pdf.reset_index(drop=True)
        n = pdf["n"].to_numpy()
        bins, offsets = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        some = n > 0
        bins[some], offsets[some] = sum_of_squares(n[some], capacity)
        filled = np.bincount(bins, n, minlength=1)
        offsets[~some] = filled[0]
        return pdf.assign(bin=bins, offset=offsets, open=filled[bins] < reopen_below * capacity, group=group)[["row", "n", "deal", "bin", "offset", "open", "group"]]

    for k in range(rounds):
        count = left.count()
        groups = max(1, -(-count // group_pieces))
        dealt = left.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(k)), F.lit(groups)))
        pack_group = (lambda pdf: packed(pdf, True)) if k else (lambda pdf: packed(pdf, False))
        out = dealt.groupBy("group").applyInPandas(pack_group, schema)
        out = saved(out, f"packed{k}")
        last = k == rounds - 1 or (k > 0 and groups == 1)
        closed = out if last else out.filter(~F.col("open"))
        number = F.lit(k).cast("long") * (1 << 60) + F.col("group") * (1 << 32) + F.col("bin")
        done.append(closed.select("row.*", number.alias("sequence_id"), F.col("offset")))
        if last:
            break
        left = out.filter("open").select("row", "n", "deal")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
