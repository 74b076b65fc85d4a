"""Secret scans by learned formats.

Patterns find assignments, access keys and runs of hex figures. What they find in a bounded sample of documents
are labelled credentials, from which a probabilistic automaton is learned for each kind: a prefix tree of the
values, whose states are merged where their counts are compatible (Hoeffding bounds on the ends and
on each next character, and so on below them). Another is learned from the sample's other candidates, that
is, from runs of 12 or more characters of credentials (figures, letters, + / _ . = -) that no pattern finds. Then every candidate of
every whole text is scored: log-likelihood under a kind's automaton less that under the others', for each character.
A candidate outside the patterns' spans is added, with kind ``format``, if its score reaches that kind's
threshold: the 1 % quantile of labelled credentials kept from learning, no less than that of all but one in a thousand
of the other candidates kept from it, and never below 0.

Patterns and candidates are searched for in bytes; all their characters are ASCII. Spans count code points.

Defined results: null text is empty and has no spans; repeated rows are scanned each; without labelled
credentials of a kind in the sample (or without other candidates) that kind adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved
from .tokens import _portions

#: Documents of the sample, and values of each kind that automata are learned from (as many again set the thresholds).
SAMPLE_DOCS, SAMPLE_VALUES = 20_000, 1_000
#: Characters of the values of a kind that are learned from, together; none has more than a hundredth of them.
SAMPLE_CHARS = 60_000
LEAST_CANDIDATE = 12
#: Logarithm of the chance of each symbol where a value has left its kind's format: it isn't of it.
BEYOND = -1000.0
#: The kinds as listed: their order is that of spans with the same start.
KINDS = ("assign", "access", "hex", "format")
ROWS = 1000

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = rf"({_ANY_CASE}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ASSIGN, _ACCESS, _HEX = (re.compile(p.encode()) for p in (ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+"))
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[list(_SYMBOLS)] = np.arange(len(_SYMBOLS))
_MARKED = bytes(0x78 if b in _SYMBOLS else 0x20 for b in range(256))
_CONTINUING = bytes(range(0x80, 0xC0))


def patterns(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of access keys and hex runs of a candidate run."""
    out = []
    if b"AKIA" in data[start:stop]:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data, start, stop) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(data, start, stop) if m.end() - m.start() >= 16]


def found_in(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """What the patterns find, (start, kind, stop, start of the value), and the candidates outside of it, (start, stop), in bytes."""
    base = []
    lowered = data.lower()
    if any(h in lowered for h in _HINTS):
        base = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    taken, others = [(s, e) for s, _, e, _ in base], []
    marks, run, at = data.translate(_MARKED), b"x" * LEAST_CANDIDATE, 0
    while (start := marks.find(run, at)) >= 0:
        at = marks.find(b" ", start)
        at = len(data) if at < 0 else at
        hits = patterns(data, start, at)
        base += [(s, kind, e, s) for s, kind, e in hits]
        while taken and taken[0][1] <= start:
            taken.pop(0)
        if not hits and not (taken and taken[0][0] < at):
            others.append((start, at))
    return sorted(base), others


class Automaton:
    """A probabilistic automaton over the symbols of credentials: next state (-1: none), and logarithms of the chances of
    each symbol and of the end, smoothed by ``smooth`` occurrences of each. Beyond the known states each symbol has the chance
    whose logarithm is ``beyond``."""

    def __init__(self, moves: list[dict[int, int]], counts: list[dict[int, int]], ends: list[int], beyond: float, smooth: float = 0.05):
        n, width = len(moves), len(_SYMBOLS)
        self.next = np.full((n + 1, width), n, np.int64)
        self.log, self.end = np.full((n + 1, width), beyond), np.full(n + 1, beyond)
        for k in range(n):
            total = ends[k] + sum(counts[k].values()) + smooth * (width + 1)
            self.log[k], self.end[k] = math.log(smooth / total), math.log((ends[k] + smooth) / total)
            for symbol, to in moves[k].items():
                self.next[k, symbol], self.log[k, symbol] = to, math.log((counts[k][symbol] + smooth) / total)

    def scores(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood of each value (of its symbols from ``starts`` on in ``flat``), all values a step at a time."""
        order = np.argsort(-lengths, kind="stable")
        state, total = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        at, falling = starts[order], -lengths[order]
        live, step = len(order), 0
        while live > 3:
            live = int(np.searchsorted(falling, -step))  # values of more than ``step`` symbols
            symbol = flat[at[:live] + step]
            total[:live] += self.log[state[:live], symbol]
            state[:live] = self.next[state[:live], symbol]
            step += 1
        for k in range(live):  # a few long values
            now, more = int(state[k]), 0.0
            for symbol in flat[at[k] + step : at[k] - falling[k]].tolist():
                more += self.log[now, symbol]
                now = int(self.next[now, symbol])
            state[k], total[k] = now, total[k] + more
        out = np.empty(len(order))
        out[order] = total + self.end[state]
        return out


def learned(values: list[bytes], beyond: float = BEYOND, alpha: float = 0.05, least: int = 10) -> Automaton:
    """The automaton of the values by merging states of their prefix tree. States are visited from the root;
    one is merged with the first compatible one of those that stay, which are tried from the state before it and then from
    the newest on; without one it stays too. A state that fewer than ``least`` values pass is held to its own counts only."""
    moves: list[dict[int, int]] = [{}]
    counts: list[dict[int, int]] = [{}]
    ends, passed = [0], [0]
    for value in values:
        now = 0
        passed[0] += 1
        for symbol in _SYMBOL[np.frombuffer(value, np.uint8)].tolist():
            if symbol not in moves[now]:
                moves[now][symbol] = len(moves)
                counts[now][symbol] = 0
                moves.append({})
                counts.append({})
                ends.append(0)
                passed.append(0)
            counts[now][symbol] += 1
            now = moves[now][symbol]
            passed[now] += 1
        ends[now] += 1
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = passed[a], passed[b]
            if differ(ends[a], n, ends[b], m):
                return False
            if m < least or n < least:
                continue
            for symbol in counts[a].keys() | counts[b].keys():
                if differ(counts[a].get(symbol, 0), n, counts[b].get(symbol, 0), m):
                    return False
                if symbol in moves[a] and symbol in moves[b] and moves[a][symbol] != moves[b][symbol]:
                    if passed[moves[b][symbol]] >= least:
                        stack.append((moves[a][symbol], moves[b][symbol]))
        return True

    def fold(a: int, b: int) -> list[tuple[int, int]]:
        """Adds b, the root of a tree that no other state leads into, to a; the moves that states that stay gain by it."""
        stack, gained = [(a, b)], []
        while stack:
            a, b = stack.pop()
            passed[a] += passed[b]
            ends[a] += ends[b]
            for symbol, to in moves[b].items():
                if symbol in moves[a]:
                    counts[a][symbol] += counts[b][symbol]
                    stack.append((moves[a][symbol], to))
                else:
                    moves[a][symbol], counts[a][symbol] = to, counts[b][symbol]
                    if a in kept:
                        gained.append((a, symbol))
        return gained

    red, kept, fringe = [0], {0}, deque((0, symbol) for symbol in sorted(moves[0]))
    while fringe:
        of, symbol = fringe.popleft()
        blue = moves[of][symbol]
        if blue in kept:
            continue
        twin = next((r for r in [of, *reversed(red)] if compatible(r, blue)), None)
        if twin is None:
            red.append(blue)
            kept.add(blue)
            fringe += [(blue, s) for s in sorted(moves[blue])]
        else:
            moves[of][symbol] = twin
            fringe += fold(twin, blue)
    place = {r: k for k, r in enumerate(red)}
    return Automaton([{s: place[to] for s, to in moves[r].items()} for r in red], [counts[r] for r in red], [ends[r] for r in red], beyond)


@dataclass
class Formats:
    """The automata of the kinds and of other candidates, and each kind's threshold."""

    kinds: list[Automaton] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    others: Automaton | None = None

    def margins(self, values: list[bytes], kinds: list[Automaton] | None = None) -> np.ndarray:
        """For each value (rows) and kind, how much likelier a character is under the kind than under the others."""
        flat = _SYMBOL[np.frombuffer(b"".join(values), np.uint8)]
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        starts = np.cumsum(lengths) - lengths
        plain = self.others.scores(flat, starts, lengths)
        return np.stack([(a.scores(flat, starts, lengths) - plain) / (lengths + 1) for a in kinds or self.kinds], 1)

    def best(self, values: list[bytes]) -> np.ndarray:
        """How far each value's score stands above the nearest kind's threshold (negative: below all)."""
        if not self.kinds or not values:
            return np.full(len(values), -np.inf)
        return (self.margins(values) - np.array(self.thresholds)).max(1)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values = [], []
        for data in batch["text"].cast(pa.binary()).to_pylist():
            base, others = found_in(data or b"")
            kinds += [k for _, k, _, _ in base] + [3] * len(others)
            values += [data[v:e] for _, _, e, v in base] + [data[s:e] for s, e in others]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.binary())], ["kind", "value"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES, sample_chars: int = SAMPLE_CHARS) -> Formats:
    """Formats learned from about ``sample_docs`` documents, drawn by a hash of id and text, and at most twice ``sample_values`` different values
    of each kind (eight times as many of other candidates), drawn by hash too: half of them, of ``sample_chars`` characters together, are learned
    from (again four times as many of the others), the other half sets the thresholds."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = docs.count()
    if n > sample_docs:
        texts = texts.filter(F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 40)) < F.lit(int(sample_docs / n * (1 << 40))))
    with batches_of(docs.sparkSession, ROWS):
        values = saved(texts.mapInArrow(_labelled, "kind int, value binary").distinct(), "values")
    short = values.filter(F.length("value") <= sample_chars // 100)

    def halves(kind: int, times: int) -> tuple[list[bytes], list[bytes]]:
        drawn = short.filter(F.col("kind") == kind).orderBy(F.xxhash64("value", F.lit(7)), "value").limit(2 * times * sample_values).collect()
        chars = np.cumsum([len(r.value) for r in drawn[::2]])
        return [bytes(r.value) for r in drawn[::2][: int(np.count_nonzero(chars <= times * sample_chars))]], [bytes(r.value) for r in drawn[1::2]]

    model = Formats()
    used, other = halves(3, 4)
    if not used or not other:
        return model
    model.others = learned(used, -math.log(len(_SYMBOLS) + 1))  # what it doesn't know may be anything
    for k in range(3):
        used, kept = halves(k, 1)
        if not used or not kept:
            continue
        automaton = learned(used)
        threshold = max(0.0, float(np.quantile(model.margins(kept, [automaton])[:, 0], 0.01)), float(np.quantile(model.margins(other, [automaton])[:, 0], 0.999)))
        model.kinds.append(automaton)
        model.thresholds.append(threshold)
    return model


SPANS = "array<struct<start:int,kind:int,stop:int,score:double>>"


def scan(docs: DataFrame, model: Formats, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans (by start, then kind, a place in KINDS): all that patterns find and candidates that formats
    add, in code points; score: how far a value stands above the nearest threshold (null without formats)."""
    id_type = dict(docs.dtypes)[id_col]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                ids, rows, values = [], [], []
                for data in part["text"].cast(pa.binary()).to_pylist():
                    data = data or b""
                    base, others = found_in(data)
                    hits = sorted([(s, k, e, v) for s, k, e, v in base] + [(s, 3, e, s) for s, e in others])
                    values += [data[v:e] for _, _, e, v in hits]
                    cuts, at, chars = {}, 0, 0
                    for cut in sorted({c for s, _, e, _ in hits for c in (s, e)}):
                        chars += len(data[at:cut].translate(None, _CONTINUING))
                        at, cuts[cut] = cut, chars
                    rows.append([(cuts[s], k, cuts[e]) for s, k, e, _ in hits])
                unique = sorted(set(values))
                above = dict(zip(unique, model.best(unique).tolist(), strict=True))
                scored = iter(values)
                out = []
                for row in rows:
                    kept = []
                    for start, kind, stop in row:
                        score = above[next(scored)]
                        if kind < 3 or score >= 0:
                            kept.append({"start": start, "kind": kind, "stop": stop, "score": score if math.isfinite(score) else None})
                    out.append(kept)
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(out, kinds)], ["id", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(spans, f"id {id_type}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256 and spans (text: kind:start:end, comma-joined) of scanned rows."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
