"""Token ids of whole texts, in pieces.

A tokenizer that drops white space, lowers case, and parts letters and figures from marks gives a
text the ids of its words, one after the other, whatever the case of ASCII letters and with
closing marks as words of their own. So each task encodes every different word once, keeps
the ids of a bounded number of words, and puts texts together by index arithmetic. Whether this
holds of a tokenizer is tried on made-up texts when it is loaded; if it doesn't, or with
``whole_texts=True``, texts are encoded as they are.
"""

from __future__ import annotations

import os
import random
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Words of which a Python worker keeps the ids; others are encoded again in each batch.
KEPT_WORDS = 300_000
#: Words that one call encodes.
JOINED_WORDS = 200
#: Bytes of text that a task encodes at once (a longer text is encoded alone).
BATCH_BYTES = 2 << 20
#: Rows that Spark hands over at once, so that long texts don't add up in a worker.
BATCH_ROWS = 1000

#: Marks after a letter or figure, up to white space. Only letters that are one letter in lower case too: a capital
#: I with a dot becomes two characters, and the dot then belongs to the marks.
CLOSING = r"([0-9A-Za-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?#$%&*|]+)(\s|$)"
#: What texts that try a tokenizer are made of.
PROBES = [*"aAzZ09 sStT'.,;:!?#$%&*|<>=()-_\n\t\x0b\x1f", "İ", "ı", "é", "É", "ß", "ẞ", "e\u0301", "\u0307", "\u0338", "Σ", "ς", "ǅ", "K", "Ⅷ", "٣", "中", "か\u3099", "\u00a0", "\u2009", "🙂", "'ll", "'S", "Ab", "the", "<|", "|>", "<|endoftext|>"]

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts by their words; one for each Python worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), {}
        marks = [(str(x), k) for k, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word)]
        self.mark, self.mark_id = marks[0] if marks else (None, None)
        self.by_words = True
        self.by_words = self._tried()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _tried(self, texts: int = 400) -> bool:
        """Whether texts have the ids of their words."""
        rng = random.Random(11)
        made = ["".join(rng.choices(PROBES, k=rng.randint(1, 16))) for _ in range(texts)]
        ids, ends = self.encode(pa.array(made), None, False)
        whole = self.tokenizer.encode_batch(made, add_special_tokens=False)
        return all(ids[lo:hi].tolist() == w.ids for lo, hi, w in zip([0, *ends], ends, whole, strict=False))

    def _new_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in a call: with a special token between them, at which their ids are parted."""
        one = [k for k, w in enumerate(words) if self.mark is None or self.mark in w]
        many = [k for k, w in enumerate(words) if self.mark is not None and self.mark not in w]
        out: list[bytes] = [b""] * len(words)
        for k in one:
            out[k] = array("I", self.tokenizer.encode(words[k], add_special_tokens=False).ids).tobytes()
        for lo in range(0, len(many), JOINED_WORDS):
            part = many[lo : lo + JOINED_WORDS]
            ids = np.array([*self.tokenizer.encode(self.mark.join([words[k] for k in part]), add_special_tokens=False).ids, self.mark_id], np.uint32)
            data, at = ids.tobytes(), 0
            for k, end in zip(part, np.flatnonzero(ids == self.mark_id).tolist(), strict=True):
                out[k] = data[4 * at : 4 * end]
                at = end + 1
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        got = [self.kept.get(w) for w in words]
        new = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(new, self._new_ids([words[k] for k in new]), strict=True):
            got[k] = x
            if len(self.kept) < KEPT_WORDS:
                self.kept[words[k]] = x
        return got

    def encode(self, texts: pa.Array, end_id: int | None, whole_texts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it."""
        texts = pc.fill_null(texts, "")
        if whole_texts or not self.by_words:
            lists = pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            spaced = pc.replace_substring_regex(texts, CLOSING, r"\1 \2\3")
            special = pc.any(pc.match_substring(texts, "<|")).as_py()  # special tokens are found before case is lowered
            lists = pc.ascii_split_whitespace(spaced if special else pc.ascii_lower(spaced))
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), np.uint32)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4  # 32 bits do: a portion has BATCH_BYTES or one text
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[index]
        ends = np.cumsum(n, dtype=np.int32)
        out = flat[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        offsets = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        stops = np.concatenate([[0], ends])[offsets].astype(np.int64)
        if end_id is None:
            return out, stops
        return np.insert(out, stops, np.uint32(end_id)), stops + np.arange(1, len(stops) + 1)


def _portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about BATCH_BYTES together."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def token_pieces(
    docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
    end_id: int | None = 0, whole_texts: bool = False, id_bytes: int = 4,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: id_col, piece (from 0), start (ids of the document before
    it), length and ids (binary: unsigned, little endian, of ``id_bytes`` bytes, 2 or 4). Null text is empty; a document
    without any id (empty, and no ``end_id``) has no piece; repeated rows have pieces each."""
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    id_type = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        for batch in batches:
            for part in _portions(batch, "text"):
                ids, stops = encoder.encode(part["text"], end_id, whole_texts)
                sizes = np.diff(stops, prepend=0)
                pieces = -(-sizes // max_tokens)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * max_tokens
                length = np.minimum(sizes[row] - start, max_tokens)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * id_bytes  # pieces follow one another in ids
                if id_bytes == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id doesn't fit in 2 bytes")
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype(f"<u{id_bytes}").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data],
                    ["id", "piece", "start", "length", "ids"],
                )

    schema = f"id {id_type}, piece int, start bigint, length bigint, ids binary"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col if id_col.lower() not in ("piece", "start", "length", "ids") else free_name(out, "doc_id"))
