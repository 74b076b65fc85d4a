"""Terms of whole texts, as Arrow arrays: bytes that no term holds become spaces, at which texts are split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FIGURES = bytes(range(0x30, 0x3A))


def term_table(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: bytes of ``kept`` stay, A-Z in lower case; all others become spaces."""
    return bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


def term_lists(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """The row of each term, and the terms (binary) of all rows in order. Null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    spaced = memoryview(data)[lo:hi].tobytes().translate(table) if hi > lo else b""
    made = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - lo).tobytes()), pa.py_buffer(spaced)])
    lists = pc.ascii_split_whitespace(made)
    flat = lists.flatten().cast(pa.large_binary())
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    filled = pc.not_equal(flat, b"")
    return row[filled.to_numpy(zero_copy_only=False)], flat.filter(filled)


def gathered(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    """Runs of rows whose texts have about ``size`` bytes together; a longer text stands alone with what comes before it."""
    held, total = [], 0
    for batch in batches:
        ends = total + np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = min(int(np.searchsorted(ends, size)) + 1, batch.num_rows)
            held.append(batch.slice(lo, hi - lo))
            if ends[hi - 1] >= size:
                yield pa.Table.from_batches(held)
                held, ends = [], ends - ends[hi - 1]
            lo = hi
        total = int(ends[-1]) if batch.num_rows else total
    if held:
        yield pa.Table.from_batches(held)
