"""How far sources of a language diverge in their terms, by integer-encoded counts.

1. Texts become counts for each (language, source, term), added up in each task before the shuffle, and
   then one row for each (language, term) that stands in enough documents.
2. These rows are range-partitioned by language and term, so each task holds a stretch of the sorted
   dictionary. It cuts the stretch into chunks of at most ``CHUNK_TERMS`` terms; an occurrence's id is
   its term's place in the chunk's sorted array (``searchsorted``), so ids keep the terms' UTF-8 order; a
   chunk keeps ids and counts for each source.
3. With the sources' totals, each chunk is scored by itself: a dense vector of counts for each source
   (``bincount`` over ids), from it the scaled probabilities, sums for each pair of sources, and the first
   terms of each source, whose ties the ids settle. Chunks of a task are added up before the
   last shuffle.

A probability is p = 1 + floor(SCALE * (count + 1) / (N + V)); the divergence of p from q is
floor((p - q) ** 2 / q). All of it is exact in 64 bits up to 9e15 occurrences.

Defined results: null text, language and source are ''; a group without terms takes part with counts of 0;
a language without kept terms has pairs of value 0 and no term rows; repeated rows are documents each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, saved, small
from .terms import LETTERS, gathered, term_lists, term_table

SCALE = 1_000_000_000
#: Terms of a chunk.
CHUNK_TERMS = 4096
#: Cells of the dense table (sources by terms) that are worked on at once.
CELLS = 1 << 21
#: Bytes of text whose terms a task counts at once.
TEXT_BYTES = 16 << 20
#: Rows that a Python worker gets at once.
ROWS = 1000
_TABLE = term_table(LETTERS)


def _counted(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, cnt, docs of stretches of the texts."""
    for part in gathered(batches, "text", text_bytes):
        part = part.combine_chunks()
        lang, source = (part[c].chunk(0).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        row, terms = term_lists(part["text"].chunk(0), _TABLE)
        coded = terms.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        term = coded.indices.to_numpy().astype(np.int64)
        cells, times = np.unique(row * width + term, return_counts=True)  # a document's terms
        keys, inverse = np.unique(group[cells // width] * width + cells % width, return_inverse=True)
        cnt = np.bincount(inverse, weights=times, minlength=len(keys)).astype(np.int64)
        docs = np.bincount(inverse, minlength=len(keys))
        at = keys // width
        columns = [lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary)))]
        columns += [coded.dictionary.take(pa.array(keys % width)).cast(pa.binary()).view(pa.string()), pa.array(cnt), pa.array(docs.astype(np.int64))]
        made = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "cnt", "docs"])
        for lo in range(0, len(made), 1 << 16):
            yield made.slice(lo, 1 << 16)


def kept_terms(docs: DataFrame, *, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", text_bytes: int = TEXT_BYTES) -> DataFrame:
    """lang, term, counts (array of source and cnt) of the terms that at least ``least_docs`` documents of their language hold."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    counted = texts.mapInArrow(lambda batches: _counted(batches, text_bytes), "lang string, source string, term string, cnt bigint, docs bigint")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "cnt")).alias("counts"))
    with batches_of(docs.sparkSession, ROWS):
        return saved(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "counts"), "terms")


_CHUNK = "lang string, part int, chunk int, terms array<string>, sources array<string>, starts array<int>, ids array<int>, counts array<bigint>, sums array<bigint>"


def _encoded(batches: Iterator[pa.RecordBatch], chunk_terms: int) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted rows (lang, term, counts)."""
    part, number = TaskContext.get().partitionId(), 0
    lang, held, n = None, [], 0

    def chunk() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        entries = rows["counts"].chunk(0)
        terms = np.array(rows["term"].chunk(0).cast(pa.binary()).to_pylist(), object)
        flat = entries.flatten()
        occurring = np.repeat(terms, np.diff(entries.offsets.to_numpy()))
        ids = np.searchsorted(terms, occurring).astype(np.int32)
        names = np.array(flat.field("source").cast(pa.binary()).to_pylist(), object)
        sources, of = np.unique(names, return_inverse=True)
        order = np.lexsort((ids, of))
        cnt = flat.field("cnt").to_numpy()
        starts = np.searchsorted(of[order], np.arange(len(sources) + 1)).astype(np.int32)
        sums = np.add.reduceat(cnt[order], starts[:-1])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        text = lambda x: one(pa.array(list(x), pa.binary()).view(pa.string()))
        columns = [pa.array([lang]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), text(terms), text(sources)]
        columns += [one(pa.array(starts)), one(pa.array(ids[order])), one(pa.array(cnt[order])), one(pa.array(sums))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "part", "chunk", "terms", "sources", "starts", "ids", "counts", "sums"])

    for batch in batches:
        runs = batch["lang"].dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            while start < stop:
                if n == chunk_terms or (n and batch["lang"][start].as_py() != lang):
                    yield chunk()
                    held, n, number = [], 0, number + 1
                lang, take = batch["lang"][start].as_py(), min(chunk_terms - n, stop - start)
                held.append(batch.slice(start, take))
                n, start = n + take, start + take
    if n:
        yield chunk()


def scaled(count: np.ndarray, total) -> np.ndarray:
    """floor(SCALE * count / total) by long division, three figures at a time, for 0 <= count <= total < 9e15."""
    q, r = count // total, count % total
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return q


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def chunk_scores(counts: np.ndarray, n: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """For a table of counts (sources by terms), the sources' totals and the number of the language's terms: the sum of the
    divergences of each source from each, and each source's divergence from the language at each term (0 where it holds
    none, or no more than the language). Terms are taken in stretches of CELLS."""
    sources, width = counts.shape
    sums, own = np.zeros((sources, sources), np.int64), np.zeros((sources, width), np.int64)
    step = max(1, CELLS // max(sources, 1))
    for lo in range(0, width, step):
        c = counts[:, lo : lo + step]
        p = 1 + scaled(c + 1, (n + v)[:, None])
        for k in range(sources):
            sums[k] += divergence(p[k], p).sum(1)
        q = 1 + scaled(c.sum(0) + 1, int(n.sum()) + v)
        own[:, lo : lo + step] = np.where((c > 0) & (p > q), divergence(p, q), -1)
    return sums, own


def _scored(listed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, names, sums, best = None, [], None, {}

        def out() -> pa.RecordBatch:
            rows = [(lang, names[a], "pair", names[b], int(sums[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b]
            rows += [(lang, names[a], "term", term, value) for a, found in best.items() for value, term in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string()] * 4 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                if sums is None or row["lang"] != lang:
                    if sums is not None:
                        yield out()
                    lang, names, best = row["lang"], row["names"], {}
                    sums, place = np.zeros((len(names), len(names)), np.int64), {s: k for k, s in enumerate(names)}
                width, starts, ids = len(row["terms"]), row["starts"], np.array(row["ids"])
                counts, cnt = np.zeros((len(names), width), np.int64), np.array(row["counts"], float)
                for k, s in enumerate(row["sources"]):
                    at = slice(starts[k], starts[k + 1])
                    counts[place[s]] = np.bincount(ids[at], weights=cnt[at], minlength=width)
                more, own = chunk_scores(counts, np.array(row["totals"], np.int64), row["v"])
                sums += more
                for a in range(len(names)):
                    found = np.flatnonzero(own[a] >= 0)
                    found = found[np.argsort(-own[a, found], kind="stable")[:listed]]  # of equal values the smaller id
                    if len(found):  # chunks of a task come in the order of their terms
                        both = best.get(a, []) + [(int(own[a, k]), row["terms"][k]) for k in found]
                        best[a] = sorted(both, key=lambda x: -x[0])[:listed]
        if sums is not None:
            yield out()

    return score


class Encoded:
    """The dictionary and the counts of a table: ``chunks`` (with each chunk's sorted terms and its sources' ids and
    counts) and ``languages`` (lang, v, names and totals of its sources)."""

    def __init__(
        self, docs: DataFrame, *, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        chunk_terms: int = CHUNK_TERMS, text_bytes: int = TEXT_BYTES,
    ):
        spark = docs.sparkSession
        kept = kept_terms(docs, least_docs=least_docs, text_col=text_col, lang_col=lang_col, source_col=source_col, text_bytes=text_bytes)
        with batches_of(spark, ROWS):
            ranged = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
            self.chunks = saved(ranged.mapInArrow(lambda batches: _encoded(batches, chunk_terms), _CHUNK), "chunks")
        filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
        groups = docs.select(filled(lang_col, "lang"), filled(source_col, "source")).distinct()
        totals = self.chunks.select("lang", F.inline(F.arrays_zip("sources", "sums"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("sums").alias("n"))
        wide = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
        wide = wide.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s"))
        terms = self.chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
        self.languages = saved(wide.join(terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.col("s.source").alias("names"), F.col("s.n").alias("totals")), "languages")

    def dictionary(self) -> DataFrame:
        """lang, id (from 0 in each language, in UTF-8 order), term."""
        sizes = self.chunks.select("lang", "part", "chunk", F.size("terms").alias("n"))
        before = F.sum("n").over(Window.partitionBy("lang").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row for each chunk
        first = sizes.select("lang", "part", "chunk", F.coalesce(before, F.lit(0)).alias("first"))
        placed = self.chunks.select("lang", "part", "chunk", F.posexplode("terms").alias("k", "term")).join(first, ["lang", "part", "chunk"])
        return placed.select("lang", (F.col("first") + F.col("k")).alias("id"), "term")

    def audit(self, *, listed: int = 200) -> DataFrame:
        """lang, source, part, item, value, rank: ``pair`` rows for each other source of the language (all of them), ``term`` rows
        for the ``listed`` terms in which the source stands furthest above its language."""
        keyed = self.chunks.join(small(self.languages), "lang").select(*[c.split()[0] for c in _CHUNK.split(", ")], "v", "names", "totals")
        with batches_of(self.chunks.sparkSession, 8):
            rows = saved(keyed.sortWithinPartitions("lang", "part", "chunk").mapInArrow(_scored(listed), "lang string, source string, part string, item string, value bigint"), "scores")
        pairs = rows.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        bare = self.languages.filter("v = 0")
        none = bare.select("lang", F.explode("names").alias("source"), F.lit("pair").alias("part"), "names")
        none = none.select("lang", "source", "part", F.explode("names").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
        every = pairs.unionByName(none).unionByName(rows.filter("part = 'term'"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return every.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= listed))


def source_divergence(docs: DataFrame, *, listed: int = 200, **how) -> DataFrame:
    """The audit of ``docs``; see ``Encoded`` and its ``audit``."""
    return Encoded(docs, **how).audit(listed=listed)
