"""Duplicate rows: exact, normalised and near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.schema import batches_of, quoted, stored, with_row_index
from plumbline.functions.text import normalised, percent

from .inference import id_columns

#: Parts of a name that keep a column out of duplicate search.
ID_NAME_PARTS = ["id", "key", "uuid", "guid", "index", "code", "num", "no", "number"]
#: Texts of a block, and pairs of texts whose comparison in blocks costs as much as a row of blocking.
BLOCK_TEXTS, PAIRS_TO_ROW = 256, 20
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 4096


def duplicate_search_columns(df: DataFrame, order: str | None = None) -> list[str]:
    """All columns but those that identify rows: by name, by content, or because over 95 % of their
    values differ (asked of tables of more than 10 rows). A sketch counts the different values; only columns
    near the bound are counted exactly."""
    found = {r.column for r in id_columns(df, order=order).collect()}
    named = {c for c in df.columns if any(p in c.lower() for p in ID_NAME_PARTS)}
    asked = [c for c in df.columns if c not in found | named]
    if not asked:
        return []
    row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(quoted(c).cast("string"), 0.016).alias(f"u{k}") for k, c in enumerate(asked)]).first()
    if row.n <= 10:
        return asked
    near = [c for k, c in enumerate(asked) if row[f"u{k}"] > 0.8 * row.n]  # ten standard errors below the bound
    unique = set()
    for c in near:
        if df.select(quoted(c).cast("string").alias("v")).filter("v IS NOT NULL").distinct().count() > 0.95 * row.n:
            unique.add(c)
    return [c for c in asked if c not in unique]


def normalised_row(df: DataFrame, columns: list[str] | None = None, *, case_sensitive: bool = False, ignore_whitespace: bool = True) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [
        (normalised(quoted(c), case_sensitive=case_sensitive, ignore_whitespace=ignore_whitespace) if isinstance(kinds[c], T.StringType) else quoted(c)).alias(c)
        for c in (df.columns if columns is None else columns)
    ]


def exact_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """total_rows, duplicate_count (rows beyond the first of their kind; nulls are equal), duplicate_pct."""
    groups = df.groupBy(*[quoted(c) for c in (columns or df.columns)]).agg(F.count("*").alias("__n"))
    sums = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_count"))
    return sums.withColumn("duplicate_pct", percent(F.col("duplicate_count"), F.col("total_rows")))


def normalised_duplicates(df: DataFrame, columns: list[str] | None = None, **how: bool) -> DataFrame:
    return exact_duplicates(df.select(*normalised_row(df, columns, **how)))


def duplicate_flags(indexed: DataFrame, columns: list[str], row_index: str = "row_index", **how: bool) -> DataFrame:
    """row_index, original_index (the first row that is equal) and is_duplicate. The first row is found
    by an aggregation and joined, so a group of very many copies isn't sorted in one task."""
    cells = normalised_row(indexed, columns, **how) if how else [quoted(c) for c in columns]
    keyed = indexed.select(F.col(row_index).alias("row_index"), F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256).alias("__row"))
    firsts = keyed.groupBy("__row").agg(F.min("row_index").alias("original_index"))
    return keyed.join(firsts, "__row").select("row_index", "original_index", (F.col("row_index") != F.col("original_index")).alias("is_duplicate"))


def duplicate_groups(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Groups of equal rows: the columns, how many rows, and the first by ``order``."""
    return df.groupBy(*[quoted(c) for c in columns]).agg(F.count("*").alias("copies"), F.min(order).alias("first_row")).filter("copies > 1")


def duplicate_examples(indexed: DataFrame, flags: DataFrame, row_index: str = "row_index", n: int = 5) -> DataFrame:
    """The first ``n`` duplicates with both rows as JSON."""
    first = flags.filter("is_duplicate").orderBy("row_index").limit(n).select(F.col("original_index"), F.col("row_index").alias("duplicate_index"))
    return _with_rows(indexed, first, row_index).withColumns({"type": F.lit("exact"), "similarity": F.lit(1.0)})


def _with_rows(indexed: DataFrame, pairs: DataFrame, row_index: str) -> DataFrame:
    """A few pairs (original_index, duplicate_index) with original_row and duplicate_row as JSON."""
    rows = indexed.select(F.col(row_index).alias("at"), F.to_json(F.struct(*[quoted(c) for c in indexed.columns if c != row_index])).alias("row"))
    one = pairs.join(rows, pairs["original_index"] == rows["at"]).drop("at").withColumnRenamed("row", "original_row")
    return one.join(rows, one["duplicate_index"] == rows["at"]).drop("at").withColumnRenamed("row", "duplicate_row")


def indel_similarity(a: str, b: str) -> float:
    """1 - indel distance / (both lengths), by the longest common subsequence (bit-parallel)."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        u = rows & masks.get(ch, 0)
        rows = ((rows + u) | (rows - u)) & full
    return 2 * (full ^ rows).bit_count() / (len(a) + len(b))


def lcs_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs left[i], right[j]: the bit-parallel steps of ``indel_similarity`` for
    many pairs at once, a column of each right text after the other, in words of 64 places of the left texts."""
    out = np.zeros(len(i), np.int64)
    codes = {ch: k for k, ch in enumerate(sorted(set("".join(left))))}
    none, longest = len(codes), max(map(len, right), default=0)
    words = max(1, -(-max(map(len, left), default=0) // 64))
    at = np.full((longest, len(right)), none, np.int32)
    for k, text in enumerate(right):
        at[: len(text), k] = [codes.get(ch, none) for ch in text]
    rows_at_once = max(1, cells // ((none + 1) * words))
    for lo in range(0, len(left), rows_at_once):
        part = left[lo : lo + rows_at_once]
        masks = np.zeros((words, len(part) * (none + 1)), np.uint64)
        for k, text in enumerate(part):
            for p, ch in enumerate(text):
                masks[p // 64, k * (none + 1) + codes[ch]] |= np.uint64(1 << p % 64)
        mine = np.flatnonzero((i >= lo) & (i < lo + rows_at_once))
        for begin in range(0, len(mine), max(1, cells // (8 * words))):
            some = mine[begin : begin + max(1, cells // (8 * words))]
            base, of = (i[some] - lo) * (none + 1), j[some]
            live = np.full((words, len(some)), np.uint64(2**64 - 1))
            for column in at:
                place = base + column[of]
                carry = np.zeros(len(some), np.uint64)
                for w in range(words):
                    x = live[w]
                    u = x & masks[w][place]
                    total = x + u
                    more = total < x
                    total += carry
                    carry = (more | (total < carry)).astype(np.uint64)
                    live[w] = total | (x & ~u)
            lengths = np.array([len(t) for t in part])[i[some] - lo]
            for w in range(words):
                valid = np.clip(lengths - 64 * w, 0, 64)
                mask = np.where(valid == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(valid, 63).astype(np.uint64)) - np.uint64(1))
                out[some] += np.bitwise_count(~live[w] & mask)
    return out


def record_text(df: DataFrame, columns: list[str], style: str = "values") -> Column:
    """A row as one text: its values, or as ``dict`` with the column names and texts in quotes as well."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if style == "values":
        return F.concat_ws(" ", *[F.coalesce(quoted(c).cast("string"), F.lit("NULL")) for c in columns])
    cells = [F.concat(F.lit("'"), quoted(c), F.lit("'")) if isinstance(kinds[c], T.StringType) else quoted(c).cast("string") for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{c}': "), F.coalesce(x, F.lit("nan"))) for c, x in zip(columns, cells, strict=True)]), F.lit("}"))


def near_rows(indexed: DataFrame, columns: list[str], threshold: float = 0.9, *, row_index: str = "row_index", up_to: int | None = None) -> DataFrame | None:
    """Pairs (a, b, similarity) of rows that aren't equal but nearly so once normalised; of equal rows the first stands
    for all. Rows are compared as texts with the column names. None if more than ``up_to`` rows differ: they aren't compared then."""
    kinds = {f.name: f.dataType for f in indexed.schema.fields}
    cells = normalised_row(indexed, columns)
    rows = indexed.select(F.col(row_index).alias("row_index"), *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    rows = rows.groupBy(*[f"c{k}" for k in range(len(columns))]).agg(F.min("row_index").alias("row_index"))
    rows = stored(rows.select("row_index", *[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]))
    assert all(rows.schema[c].dataType == kinds[c] for c in columns)
    records = rows.select("row_index", record_text(rows, columns, "dict").alias("record"))
    if up_to is not None and rows.count() > up_to:
        return None
    return near_duplicates(records, threshold)


def near_examples(indexed: DataFrame, pairs: DataFrame, row_index: str = "row_index", n: int = 5) -> DataFrame:
    """The first ``n`` near pairs with both rows as JSON, as in ``duplicate_examples``."""
    first = pairs.orderBy("a", "b").limit(n).select(F.col("a").alias("original_index"), F.col("b").alias("duplicate_index"), "similarity")
    return _with_rows(indexed, first, row_index).withColumn("type", F.lit("near"))


def near_duplicates(records: DataFrame, threshold: float = 0.9, *, id_col: str = "row_index", text_col: str = "record", metric: str = "indel") -> DataFrame:
    """Pairs (a, b, similarity), a < b, of different texts with similarity of at least ``threshold``.

    Two ways, neither of which loses a pair; counts by length tell which makes fewer rows. Short texts, or few edits: blocking.
    For each pair of lengths that can be similar, the longer text is cut into more
    segments than edits are allowed, so one of them stands unchanged in the shorter text, shifted
    by no more than the edits; pairs are candidates when they share (lengths, segment, its text). Long texts that may
    be many edits apart, which share segments with nearly all others: blocks of texts of similar length are compared with each
    other (``_by_blocks``). Equal texts are compared once: rows of the same text are joined to the pair at the end. ``metric`` is
    ``indel`` (1 - indel / both lengths) or ``levenshtein`` (1 - edits / longer length)."""
    texts = stored(records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL"))
    distinct = stored(texts.select("text").distinct().withColumn("n", F.length("text")).withColumn("uid", F.unhex(F.md5("text"))))
    share = 1 - threshold
    ratio = (1 + share) / (1 - share) if metric == "indel" else 1 / threshold  # longest partner to shortest

    def edits(long_n: Column, n: Column) -> Column:
        """Edits that two similar texts of these lengths may be apart."""
        return F.floor(share * (long_n + n if metric == "indel" else long_n) + 1e-9).cast("int")

    left, right = texts.select(F.col("id").alias("x"), F.col("text").alias("t")), texts.select(F.col("id").alias("y"), F.col("text").alias("s"))
    if metric == "indel":
        most = edits(F.col("n") * ratio, F.col("n"))
        made = F.col("c") * (F.floor(F.col("n") * ratio) - F.col("n") + 1) * (most + 1) * (most / 2 + 1)
        sums = distinct.groupBy("n").agg(F.count("*").cast("double").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(made), F.lit(0.0)).alias("made")).first()
        if sums.n * sums.n / 2 < PAIRS_TO_ROW * sums.made:
            out = _by_blocks(distinct, threshold, ratio).join(left, "t").join(right, "s")
            return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")

    def segments(rows: DataFrame) -> DataFrame:
        """Rows (n, long_n) for each segment of the longer text: one more than there are edits."""
        rows = rows.withColumn("edits", edits(F.col("long_n"), F.col("n"))).filter("long_n > edits")
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        at = lambda i: F.floor(i * F.col("long_n") / (F.col("edits") + 1)).cast("int")
        return rows.withColumn("from", at(F.col("i"))).withColumn("size", at(F.col("i") + 1) - F.col("from"))

    lengths = lambda lo, hi: F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi))
    longer = segments(distinct.select("uid", "text", F.col("n").alias("long_n"), lengths(F.ceil(F.col("n") / ratio - 1e-9).cast("int"), F.col("n")).alias("n")))
    own = longer.select("uid", "n", "long_n", "i", F.substring("text", F.col("from") + 1, F.col("size")).alias("piece"))
    shorter = segments(distinct.select("uid", "text", "n", lengths(F.col("n"), F.floor(F.col("n") * ratio + 1e-9).cast("int")).alias("long_n")))
    apart = F.col("long_n") - F.col("n")
    lo = F.greatest(F.lit(0), F.col("from") - F.floor((F.col("edits") + apart) / 2).cast("int"))
    hi = F.least(F.col("n") - F.col("size"), F.col("from") + F.floor((F.col("edits") - apart) / 2).cast("int"))
    pieces = F.transform(F.sequence(lo, hi), lambda p: F.substring(F.col("text"), p + 1, F.col("size")))
    shorter = shorter.filter((lo <= hi) & (apart <= F.col("edits"))).select(F.col("uid").alias("other"), "n", "long_n", "i", F.explode(F.array_distinct(pieces)).alias("piece"))
    pairs = own.join(shorter, ["n", "long_n", "i", "piece"]).filter("uid <> other")
    pairs = pairs.select(F.least("uid", "other").alias("u"), F.greatest("uid", "other").alias("w")).distinct()
    one, two = distinct.select(F.col("uid").alias("u"), F.col("text").alias("t")), distinct.select(F.col("uid").alias("w"), F.col("text").alias("s"))
    both = pairs.join(one, "u").join(two, "w")
    total = F.length("t") + F.length("s")
    if metric == "indel":
        bound = F.floor(share * total + 1e-9).cast("int")
        close = both.filter(F.levenshtein("t", "s") <= bound)  # never over the indel distance

        @F.pandas_udf("double")
        def similarity(t: pd.Series, s: pd.Series) -> pd.Series:
            return pd.Series([indel_similarity(x, y) for x, y in zip(t, s, strict=True)])

        scored = close.withColumn("similarity", similarity("t", "s"))
    else:
        scored = both.withColumn("similarity", 1 - F.levenshtein("t", "s") / F.greatest(F.length("t"), F.length("s")))
    found = scored.filter(F.col("similarity") >= threshold - 1e-12).select("t", "s", "similarity")
    out = found.join(left, "t").join(right, "s")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _by_blocks(distinct: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """t, s, similarity (indel) of the pairs of different texts that reach the threshold. Texts are numbered by length and cut
    into blocks; a task compares two blocks whose lengths allow it: by the difference of their character counts, which the
    indel distance is never below, for all pairs at once, and by common subsequences where that is small enough."""
    rows = with_row_index(distinct.select("text", "n"), "n", "text").withColumn("block", (F.col("row_index") / BLOCK_TEXTS).cast("int"))
    blocks = stored(rows.groupBy("block").agg(F.collect_list("text").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most")))
    last = blocks.count() - 1
    wanted = blocks.select("block", "texts", "most", F.explode(F.sequence("block", F.lit(max(last, 0)))).alias("other"))
    pairs = wanted.join(blocks.select(F.col("block").alias("other"), F.col("texts").alias("others"), F.col("least").alias("from")), "other").filter(F.col("from") <= F.col("most") * ratio + 1e-9)

    def counts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64), np.int16)
        for k, text in enumerate(texts):
            out[k] = np.minimum(np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, minlength=64), 2**14)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["texts"], row["others"]
                n, m = np.fromiter(map(len, left), np.int32, len(left)), np.fromiter(map(len, right), np.int32, len(right))
                a, b = counts(left), counts(right)
                far = np.floor((1 - threshold) * (n[:, None] + m[None, :]) + 1e-9)
                apart = np.zeros(far.shape, np.int32)
                for k in range(64):
                    apart += np.abs(a[:, k, None] - b[None, :, k])
                near = apart <= far
                if row["block"] == row["other"]:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                similarity = 2 * lcs_lengths(left, right, i, j) / np.maximum(n[i] + m[j], 1)
                i, j, similarity = (x[similarity >= threshold - 1e-12] for x in (i, j, similarity))
                made = [pa.array([left[k] for k in i], pa.string()), pa.array([right[k] for k in j], pa.string()), pa.array(similarity)]
                yield pa.RecordBatch.from_arrays(made, ["t", "s", "similarity"])

    with batches_of(distinct.sparkSession, 1):
        tasks = min((last + 1) * (last + 2) // 2, MOST_TASKS) or 1  # given, since the rows are few and small and the work isn't
        dealt = pairs.select("block", "other", "texts", "others").repartition(tasks, "block", "other")
        return stored(dealt.mapInArrow(compare, "t string, s string, similarity double"))


def duplicate_totals(exact: DataFrame, near_count: int | Column) -> DataFrame:
    """A profile's row with its near pairs added to the count: total_rows, duplicate_count, duplicate_pct, near_duplicate_count."""
    near = near_count if isinstance(near_count, Column) else F.lit(near_count)
    count = F.col("duplicate_count") + F.coalesce(near, F.lit(0))
    return exact.select("total_rows", count.alias("duplicate_count"), percent(count, F.col("total_rows")).alias("duplicate_pct"), near.cast("long").alias("near_duplicate_count"))


def duplicate_profiles(df: DataFrame, *, near_threshold: float = 0.9, near_up_to: int | None = None, order: str | None = None, smart: list[str] | None = None, near: Column | int | None = None) -> DataFrame:
    """Three profiles of the table as rows: raw rows, normalised rows, and normalised rows without the
    columns that identify them, to which each pair of nearly equal rows adds one; near_duplicate_count is NULL where
    they weren't looked for, because more than ``near_up_to`` rows differ. ``smart`` and ``near``: those columns and the number of
    pairs, where they are known already (0: none)."""
    if smart is None:
        smart = duplicate_search_columns(df, order) or df.columns
        near = _near_count(df, smart, near_threshold, near_up_to)
    parts = [("standard", exact_duplicates(df), 0), ("normalized", normalised_duplicates(df), 0), ("smart", normalised_duplicates(df, smart), near)]
    out = None
    for name, part, pairs in parts:
        part = duplicate_totals(part, pairs).select(F.lit(name).alias("profile"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _near_count(df: DataFrame, smart: list[str], near_threshold: float, near_up_to: int | None) -> int | None:
    numbered = df.select(*[quoted(c) for c in smart]).withColumn("__row", F.monotonically_increasing_id())
    pairs = near_rows(numbered, smart, near_threshold, row_index="__row", up_to=near_up_to) if near_threshold < 1 else numbered.limit(0)
    return None if pairs is None else pairs.count()


def additional_duplicates(profiles: DataFrame) -> DataFrame:
    of = lambda name: F.max(F.when(F.col("profile") == name, F.col("duplicate_count")))
    return profiles.agg((of("smart") - of("standard")).alias("additional_duplicates_found"))


def duplicate_split(profile: DataFrame) -> DataFrame:
    """Shares of duplicates and of other rows, one decimal: what a pie chart shows."""
    share = F.round(percent(F.col("duplicate_count"), F.col("total_rows"), None), 1)
    return profile.select(F.inline(F.array(F.struct(F.lit("Duplicates").alias("label"), share.alias("pct")), F.struct(F.lit("Unique").alias("label"), (100 - share).alias("pct")))))
