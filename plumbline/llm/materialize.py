"""Training-order materialisation: token sequences in fixed-stride binary shards.

The ids of a task's documents follow one another, each document closed by its end id, and are
cut into sequences of ``sequence_tokens``; only a task's last sequence is shorter. Sequences
are numbered densely, and a keyed Feistel permutation with cycle-walking gives each number
its global slot: a bijection on 0..n-1 that needs no shuffle, no table and no state. As
slots are dense, ranges of them are known beforehand: sequences go straight to the partition
that holds their range, and each shard is one file of records of equal length, so slot s
stands in shard s // shard_records at byte (s % shard_records) * stride. A reader can begin
at any slot and go on sequentially.

Sequences travel compressed, and shards are written in ``waves`` (runs of shards, one after the
other), so that the disk holds the shuffle of one wave at a time. Files are written under a
name of the task's attempt and renamed, so a task that runs again replaces whole files by the
same bytes.

Defined results: null text is empty and is the end id alone; the places that a sequence leaves
in its record are filled with ``pad_id``; repeated rows are documents of their own; an empty table
writes no shard; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, scratch_dir
from .tokens import BATCH_ROWS, WordEncoder, _portions


def feistel_slots(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where the permutation of 0..n-1 under ``key`` puts each number."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1) for r in range(rounds)]
    out = numbers.astype(np.uint64)
    live = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(live):  # walk the cycle until the slot is below n; less than four steps on average
            x = out[live]
            left, right = x >> np.uint64(half), x & mask
            for k in keys:
                f = (right + np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
                f = (f ^ (f >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
            out[live] = (left << np.uint64(half)) | right
            live = live[out[live] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(stored: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored`` (a table just read, not changed) with a dense ``number`` from 0, and its count of rows. A row's
    number is its place in its file after all rows of the files before; the driver sees no rows, and one
    task sees one row for each file."""
    placed = stored.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = placed.groupBy("file").count()
    before = saved(files.withColumn("before", F.sum("count").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))), f"{name}-files")
    total = before.agg(F.sum("count")).first()[0] or 0
    return placed.join(before.select("file", F.coalesce("before", F.lit(0)).alias("before")), "file").withColumn("number", F.col("before") + F.col("at")).drop("file", "at", "before"), total


def token_sequences(docs: DataFrame, *, tokenizer_path: str, sequence_tokens: int, end_id: int, id_bytes: int) -> DataFrame:
    """Sequences of the columns doc_id and text: n_tokens, data (compressed ids, little endian) and spans, the runs
    of one document's ids (doc_id, start: its ids before the run, n_tokens)."""
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    id_type = docs.schema["doc_id"].dataType
    run = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("spans", T.ArrayType(run))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, encoder = zstandard.ZstdCompressor(level=3), WordEncoder.of(tokenizer_path)
        ids, spans = np.zeros(0, np.uint32), []  # what is left of the documents so far, less than a sequence

        def sequences(ids: np.ndarray, spans: list[pa.Table], width: int) -> pa.RecordBatch:
            """``ids`` as sequences of ``width``; spans are tables (doc_id, start, n_tokens) that cover them in order."""
            n = -(-len(ids) // width)
            if id_bytes == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id doesn't fit in 2 bytes")
            raw = ids.astype(f"<u{id_bytes}")
            data = [pack.compress(raw[k * width : (k + 1) * width].tobytes()) for k in range(n)]
            runs = pa.concat_tables(spans).combine_chunks()
            length = runs["n_tokens"].to_numpy()
            first = np.cumsum(length) - length
            # a span goes on in as many sequences as it touches
            touched = (first + length - 1) // width - first // width + 1
            row = np.repeat(np.arange(len(length)), touched)
            sequence = first[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(touched) - touched, touched)
            begin = np.maximum(first[row], sequence * width)
            stop = np.minimum(first[row] + length[row], (sequence + 1) * width)
            values = pa.StructArray.from_arrays(
                [runs["doc_id"].combine_chunks().take(pa.array(row)), pa.array(runs["start"].to_numpy()[row] + begin - first[row]), pa.array(stop - begin)], ["doc_id", "start", "n_tokens"],
            )
            offsets = np.searchsorted(sequence, np.arange(n + 1)).astype(np.int32)
            tokens = np.minimum(width, len(ids) - np.arange(n) * width)
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(data, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["n_tokens", "data", "spans"])

        for batch in batches:
            for part in _portions(batch, "text"):
                new, stops = encoder.encode(part["text"], end_id, False)
                sizes = np.diff(stops, prepend=0)
                spans.append(pa.table({"doc_id": part["doc_id"], "start": np.zeros(len(sizes), np.int64), "n_tokens": sizes.astype(np.int64)}))
                ids = np.concatenate([ids, new])
                full = len(ids) // sequence_tokens * sequence_tokens
                if full:
                    runs = pa.concat_tables(spans).combine_chunks()
                    length = runs["n_tokens"].to_numpy()
                    last = np.cumsum(length)
                    k = int(np.searchsorted(last, full))  # the run that reaches the cut
                    over = int(last[k] - full)
                    head = runs.slice(0, k + 1).set_column(2, "n_tokens", pa.array(np.append(length[:k], length[k] - over)))
                    yield sequences(ids[:full], [head], sequence_tokens)
                    tail = runs.slice(k if over else k + 1)
                    if over:
                        start, rest = tail["start"].to_numpy().copy(), tail["n_tokens"].to_numpy().copy()
                        start[0], rest[0] = start[0] + rest[0] - over, over
                        tail = pa.table({"doc_id": tail["doc_id"], "start": start, "n_tokens": rest})
                    ids, spans = ids[full:], [tail]
        if len(ids):
            yield sequences(ids, spans, sequence_tokens)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def materialize(
    docs: DataFrame, *, tokenizer_path: str, key: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    sequence_tokens: int = 2048, shard_records: int = 4096, end_id: int = 0, pad_id: int = 0, id_bytes: int = 2, waves: int = 2,
) -> DataFrame:
    """Writes the shards to ``folder`` (a URI that all executors reach) and returns the index, one row for each run of
    a document's ids in a sequence: slot, doc_id, start (its ids before), n_tokens, shard, offset (the
    run's first byte in the shard), ids_crc32 (of the run's bytes as written)."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/shards-{key}"
    id_type = docs.schema[id_col].dataType
    cut = token_sequences(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path=tokenizer_path, sequence_tokens=sequence_tokens, end_id=end_id, id_bytes=id_bytes)
    rows, total = numbered(saved(cut, "sequences"), "sequences")
    stride, shards = sequence_tokens * id_bytes, -(-total // shard_records)

    @F.pandas_udf("bigint")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(feistel_slots(number.to_numpy(), total, key))

    slotted = rows.withColumn("slot", slot_of("number")).withColumn("shard", F.floor(F.col("slot") / F.lit(shard_records)).cast("int"))
    fill = np.full(sequence_tokens, pad_id, f"<u{id_bytes}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt, unpack = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor()
        stream, now = None, None

        def close():
            stream.close()
            fs.move(f"{root}/.{now}-{attempt}", f"{root}/shard-{now:08d}.bin")

        for batch in batches:
            spans = batch["spans"]
            runs, ends = spans.flatten(), (spans.offsets.to_numpy() - spans.offsets[0].as_py())[1:]
            n, at, crc = runs.field("n_tokens").to_numpy(), np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
            k = 0
            for shard, data, end in zip(batch["shard"].to_pylist(), batch["data"], ends.tolist(), strict=True):
                if shard != now:
                    if stream:
                        close()
                    now, stream = shard, fs.open_output_stream(f"{root}/.{shard}-{attempt}")
                record = unpack.decompress(data.as_py())
                record += fill[len(record) :]
                stream.write(record)
                begin = 0
                while k < end:
                    stop = begin + int(n[k]) * id_bytes
                    at[k], crc[k] = begin, zlib.crc32(record[begin:stop])
                    begin, k = stop, k + 1
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            slot = batch["slot"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), runs.field("doc_id"), runs.field("start"), runs.field("n_tokens"), batch["shard"].take(pa.array(row)), pa.array(slot % shard_records * stride + at), pa.array(crc)],
                ["slot", "doc_id", "start", "n_tokens", "shard", "offset", "ids_crc32"],
            )
        if stream:
            close()

    fields = {"slot": T.LongType(), "doc_id": id_type, "start": T.LongType(), "n_tokens": T.LongType(), "shard": T.IntegerType(), "offset": T.LongType(), "ids_crc32": T.LongType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    index: DataFrame | None = None
    runs = np.linspace(0, shards, max(1, min(waves, shards)) + 1).astype(int).tolist()
    for lo, hi in zip(runs, runs[1:], strict=False):
        parts = max(1, min(hi - lo, max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-(hi - lo) // 64))))
        wave = slotted.filter(F.col("shard").between(lo, hi - 1))
        ranged = wave.repartitionById(parts, F.floor((F.col("shard") - lo) * F.lit(parts) / F.lit(max(1, hi - lo))).cast("int")).sortWithinPartitions("slot")
        written = saved(ranged.select("slot", "shard", "data", "spans").mapInArrow(write, schema), "index")
        index = written if index is None else index.unionByName(written)
    return index


def read_slots(folder: str, first: int, count: int, *, sequence_tokens: int = 2048, shard_records: int = 4096, id_bytes: int = 2) -> Iterator[np.ndarray]:
    """Records of ``count`` slots from ``first``, in order: what a training job resumes from."""
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    stride, slot = sequence_tokens * id_bytes, first
    while slot < first + count:
        shard, at = divmod(slot, shard_records)
        take = min(first + count - slot, shard_records - at)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            data = np.frombuffer(f.read(take * stride), f"<u{id_bytes}")
        if not len(data):
            return
        yield from data.reshape(-1, sequence_tokens)
        slot += take
