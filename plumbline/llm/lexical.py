"""Ranked lexical search over sharded inverted indexes.

Index: a task makes shards of the texts it reads, of about ``shard_bytes`` of text each; nothing is
shuffled. A shard has its documents in the order of their ids, one row for each term with the places
of its documents (gaps, as variable-length bytes) and its occurrences in each, and one row without term
with the documents' ids and lengths. Whole texts, all rows and all terms are indexed.

Search: the items' terms are dealt to blocks of ``BLOCK`` items; the posting rows of a block's terms go to
the block and shard they belong to, and with them the items that use them and the terms' weights. There the
postings of an item are merged document at a time: a heap holds a cursor for each term, keyed by its next
document; the least opens a window of documents, in which all cursors that reach it are added
up; a heap of k holds the best by score, then id. Last, the shards' best are merged.

Scores are whole numbers: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and the sum over the item's different
terms of w * ((10^9 tf) div (1000 tf + 8 m)).

Defined results: null text has no terms; a document without terms is found by nothing; repeated rows are
documents each; of equal scores the smaller id comes first, null ids last; an item without terms, or whose terms no document
holds, has no rows; repeated items are items each; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, saved, small
from .terms import FIGURES, LETTERS, gathered, term_lists, term_table

#: Bytes of text of a shard; a longer document is a shard with what comes before it.
SHARD_BYTES = 16 << 20
#: Items that are searched for together.
BLOCK = 256
#: Documents that a merge adds up at once.
WINDOW = 4096
#: Rows that a Python worker gets at once.
ROWS = 1000
_TABLE = term_table(LETTERS + FIGURES)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Whole numbers from 0 as bytes of 7 bits, the last of each below 128; ``ends``: where each row's numbers end."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1 << 7 * k)
    stop = np.cumsum(width)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(10):
        some = np.flatnonzero(width > k)
        if not len(some):
            break
        more = (width[some] > k + 1).astype(np.uint8) << 7
        out[stop[some] - width[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    offsets = np.concatenate([[0], stop])[np.concatenate([[0], ends]).astype(np.int64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first).astype(np.int64) if len(last) else np.zeros(0, np.int64)


_INDEX = "shard bigint, term string, n bigint, base bigint, ids binary, counts binary, total bigint"


def _indexed(size: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in gathered(batches, "text", size):
            part = part.combine_chunks()
            row, terms = term_lists(part["text"].chunk(0), _TABLE)
            lengths = np.bincount(row, minlength=len(part))
            id_array = part["id"].chunk(0)
            null, ids = id_array.is_null().to_numpy(zero_copy_only=False), id_array.fill_null(0).to_numpy()
            order = np.lexsort((ids, null))
            order = order[lengths[order] > 0]
            if not len(order):
                continue
            place = np.full(len(part), -1)
            place[order] = np.arange(len(order))
            coded = terms.dictionary_encode()
            words = coded.dictionary.take(pc.sort_indices(coded.dictionary))
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(words))
            keys, tf = np.unique(rank[coded.indices.to_numpy()] * len(order) + place[row], return_counts=True)
            term, doc = keys // len(order), keys % len(order)
            starts = np.searchsorted(term, np.arange(len(words)))
            gaps = np.diff(doc, prepend=0)
            gaps[starts] = doc[starts]
            ends = np.append(starts[1:], len(keys))
            known = ids[order][~null[order]]
            steps = np.diff(known.view(np.uint64), prepend=known[:1].view(np.uint64))
            base = int(known[0]) if len(known) else None
            head = [[number], [None], [len(order)], [base], packed(steps, np.array([len(steps)])), packed(lengths[order], np.array([len(order)])), [int(lengths.sum())]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            names = [c.split()[0] for c in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(head, kinds, strict=True)], names)
            n = len(words)
            rows = [np.full(n, number), words.cast(pa.binary()).view(pa.string()), ends - starts, pa.nulls(n, pa.int64()), packed(gaps, ends), packed(tf, ends), pa.nulls(n, pa.int64())]
            made = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)
            for lo in range(0, n, 1 << 16):
                yield made.slice(lo, 1 << 16)
            number += 1

    return shards


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A written index of all rows: shard, term (null: the shard's documents), n (documents), base, ids, counts (packed), total."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, ROWS):
        return saved(texts.mapInArrow(_indexed(shard_bytes), _INDEX), "index")


def item_terms(items: DataFrame, number: str, text_col: str) -> DataFrame:
    """number, term: the different terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", SHARD_BYTES):
            part = part.combine_chunks()
            row, terms = term_lists(part["text"].chunk(0), _TABLE)
            yield pa.RecordBatch.from_arrays([part["number"].chunk(0).take(pa.array(row)), terms.cast(pa.binary()).view(pa.string())], ["number", "term"])

    return items.select(F.col(number).alias("number"), F.col(text_col).cast("string").alias("text")).mapInArrow(split, "number bigint, term string").distinct()


def best_of(cursors: list[tuple[np.ndarray, np.ndarray]], k: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The k best (score, place) by document-at-a-time merge of lists of (places ascending, gains)."""
    heap = [(int(at[0]), j, 0) for j, (at, _) in enumerate(cursors) if len(at)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -place): the least is the one to give way
    while heap:
        lo = heap[0][0]
        scores = np.zeros(window, np.int64)
        while heap and heap[0][0] < lo + window:
            _, j, start = heapq.heappop(heap)
            places, gains = cursors[j]
            stop = start + int(np.searchsorted(places[start:], lo + window))
            scores[places[start:stop] - lo] += gains[start:stop]  # a list holds a document once
            if stop < len(places):
                heapq.heappush(heap, (int(places[stop]), j, stop))
        floor = best[0][0] if len(best) == k else 0
        found = np.flatnonzero(scores > floor)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        for place in found.tolist():
            entry = (int(scores[place]), -(lo + place))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry[0] > best[0][0]:  # of equal scores the earlier place stays
                heapq.heapreplace(best, entry)
    return [(score, -place) for score, place in sorted(best, key=lambda x: (-x[0], -x[1]))]


def _searched(n_docs: int, n_terms: int, k: int):
    def search(rows: pa.Table) -> pa.Table:
        numbers, ids, scores = [], [], []
        terms = rows["term"].is_null().to_numpy()
        head = rows.take(pa.array(np.flatnonzero(terms))).to_pylist()[0]
        length = unpacked(head["counts"])
        steps = unpacked(head["ids"]).view(np.uint64)
        known = (np.cumsum(steps) + np.array([head["base"] or 0]).view(np.uint64)).view(np.int64)
        uniq, inverse = np.unique(length, return_inverse=True)
        eight_m = np.array([8 * (10 + 90 * n * n_docs // n_terms) for n in uniq.tolist()], np.int64)[inverse]
        cursors: dict[int, list] = {}
        for row in rows.select(["term", "ids", "counts", "uses"]).take(pa.array(np.flatnonzero(~terms))).to_pylist():
            places, tf = np.cumsum(unpacked(row["ids"])), unpacked(row["counts"])
            gain = 1_000_000_000 * tf // (1000 * tf + eight_m[places])
            for use in row["uses"]:
                cursors.setdefault(use["number"], []).append((places, use["w"] * gain))
        for number, lists in cursors.items():
            for score, place in best_of(lists, k):
                numbers.append(number)
                ids.append(int(known[place]) if place < len(known) else None)
                scores.append(score)
        return pa.table({"number": pa.array(numbers, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return search


def search(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_col, rank (from 1), doc_id, score: each item's ``k`` best documents."""
    spark = index.sparkSession
    sums = index.filter("term IS NULL").agg(F.sum("n").alias("docs"), F.sum("total").alias("terms")).first()
    numbered = saved(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).withColumn("number", F.monotonically_increasing_id()), "items")
    blocks = -(-numbered.count() // BLOCK) or 1
    used = saved(item_terms(numbered, "number", "text"), "used")
    postings = index.filter("term IS NOT NULL")
    held = postings.join(small(used.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * (sums.docs or 0) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = used.join(held.select("term", weight.alias("w")), "term").filter("w > 0").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    uses = saved(weighted.groupBy("block", "term").agg(F.collect_list(F.struct("number", "w")).alias("uses")), "uses")  # at most a block's items
    opened = postings.join(small(uses), "term").select("block", "shard", "term", "n", "base", "ids", "counts", "uses")
    heads = index.filter("term IS NULL").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "term", "n", "base", "ids", "counts", F.lit(None).cast(uses.schema["uses"].dataType).alias("uses"))
    both = opened.unionByName(heads)
    with batches_of(spark, ROWS):
        found = saved(both.groupBy("block", "shard").applyInArrow(_searched(sums.docs or 0, sums.terms or 1, k), "number bigint, doc_id bigint, score bigint"), "found")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(small(numbered.select("number", "item")), "number").select(F.col("item").alias(item_col), "rank", "doc_id", "score")
