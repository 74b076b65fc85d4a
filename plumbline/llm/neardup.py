"""N-gram Jaccard join through a token-group matrix, and its classes.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``similarity``. Exact: no link between different texts is lost.

1. One pass makes each text's set of 64-bit shingle hashes, of which it keeps the size, a
   128-bit digest, a few MinHash keys, and the prefix: the tokens that come first in a fixed
   global order, so many that two linked sets share one of them. Texts with the same digest
   are one node from then on.
2. Nodes with a MinHash key in common are compared with a few of them; what links becomes a
   group (cut into groups of at most about ``group_size``); every other node is a group of one.
3. The matrix holds each group's token union over its members' prefixes, as rows (token,
   group). A query's overlap with a group is counted by a join on the tokens that several
   components hold. No member can share more tokens with the query than that overlap plus
   what lies beyond the longer prefix; only groups for which this reaches the overlap that
   the similarity demands are opened, and their members are verified on whole sets: a task
   holds one group's sets at a time and reads its queries after them; a group with many queries is
   dealt to several tasks.
4. Tokens in the prefixes of more than ``frequent`` groups go to the end of the global order. A
   sketch keeps some tokens beyond the prefix to take their place; of texts with more of them
   than that (a passage common to many), the whole sets are counted too and ordered anew. So
   common passages make no candidates unless a text consists of little else.

Defined results: null or blank text has an empty set and links with nothing; a text with
fewer words than a shingle is one token; copies and repeated rows fall into one class; a
null id is ignored in a class's smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, free_name, saved, small
from .components import connected_components
from .tokens import _portions

KEYS = 4
#: Queries of a group that one task verifies; a group with more is dealt to several.
QUERIES = 256
#: Rows that a Python worker gets at once.
ROWS = 400
#: Nodes that stand for a key: each is compared with all that have the key.
HEADS = 4
_SALTS = np.array([xxhash.xxh3_64_intdigest(f"key{k}") | 1 for k in range(2 * KEYS)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _stir(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * _MIX


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    rolled = word
    with np.errstate(over="ignore"):
        for k in range(1, size):
            rolled = _stir(rolled[: len(word) - k]) + word[k:] if len(word) > k else rolled[:0]
        rolled = _stir(rolled)
    rolled = rolled.view(np.int64)
    for lo, hi in zip(ends, ends[1:], strict=False):
        if hi - lo >= size:
            yield np.unique(rolled[lo : hi - size + 1])
        elif hi > lo:
            yield np.array([xxhash.xxh3_64_intdigest(word[lo:hi].tobytes())], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def prefix_length(n, percent: int):
    """Two sets that link, one of n tokens, share one of its first so many tokens in any order."""
    return n - -(-n * percent // 100) + 1


def kept_length(n, percent: int):
    """Tokens that a sketch keeps: the prefix and a quarter more, to take the place of frequent ones."""
    p = prefix_length(n, percent)
    return p + p // 4 + 4


def _sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                n, nodes, keys, prefixes = [], [], [], []
                for tokens in shingle_sets(part["text"], size):
                    n.append(len(tokens))
                    nodes.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    with np.errstate(over="ignore"):
                        least = [_stir(tokens.view(np.uint64) * s).min() for s in _SALTS] if len(tokens) else [np.uint64(0)] * 2 * KEYS
                        keys.append([int((least[2 * k] * _MIX + least[2 * k + 1] + np.uint64(k)).view(np.int64)) for k in range(KEYS)])
                    prefixes.append(tokens[: kept_length(len(tokens), percent)])
                columns = [part["id"], part["hash"], pa.array(n, pa.int64()), pa.array(nodes, pa.binary())]
                columns += [pa.array([x[k] for x in keys], pa.int64()) for k in range(KEYS)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "n", "node", *[f"key{k}" for k in range(KEYS)], "prefix"])

    schema = "id bigint, hash bigint, n bigint, node binary, " + ", ".join(f"key{k} bigint" for k in range(KEYS)) + ", prefix array<bigint>"
    return docs.mapInArrow(sketch, schema).withColumn("row", F.monotonically_increasing_id())


class _Join:
    """The steps over one table; ``texts`` has id and text."""

    def __init__(self, texts: DataFrame, size: int, percent: int, group_size: int, frequent: int):
        self.texts, self.size, self.percent, self.group_size, self.frequent = texts, size, percent, group_size, frequent
        self.rows = saved(_sketched(texts.withColumn("hash", F.xxhash64("text")), size, percent), "sketches")
        # the row that stands for a node: its id and text tell it in the table of texts
        head = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("pick"), "hash", "row").alias("head")
        classes = self.rows.filter("n > 0").select("*", head).groupBy("node").agg(F.min("head").alias("head"), F.min("id").alias("least_id"), F.first("n").alias("n"), *[F.first(f"key{k}").alias(f"key{k}") for k in range(KEYS)])
        self.nodes = saved(classes.select("node", "head.pick", "head.hash", F.col("head.row").alias("uid"), "least_id", "n", *[f"key{k}" for k in range(KEYS)]), "nodes")

    def texts_of(self, uids: DataFrame) -> DataFrame:
        """uid and text of the given nodes, each once."""
        wanted = saved(self.nodes.join(uids.distinct(), "uid", "left_semi").select("uid", "pick", "hash"), "wanted")
        keyed = self.texts.select(F.coalesce("id", F.lit(-(2**63))).alias("pick"), F.xxhash64("text").alias("hash"), "text")
        return keyed.join(small(wanted), ["pick", "hash"]).select("uid", "text").dropDuplicates(["uid"])

    def sets(self, uids: DataFrame) -> DataFrame:
        """uid and whole set (array) of the given nodes, made again from their texts."""
        size = self.size

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _portions(batch, "text"):
                    made = list(shingle_sets(part["text"], size))
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
                    yield pa.RecordBatch.from_arrays([part["uid"], values], ["uid", "tokens"])

        return self.texts_of(uids).mapInArrow(whole, "uid bigint, tokens array<bigint>")

    def verified(self, inside: DataFrame, queries: DataFrame) -> DataFrame:
        """Links (a, b) between the queries (g, c, uid, n) and the members (same columns) of the groups (g, c) that
        they open. A query's text travels once for each group it opens, a group's once for ``QUERIES`` queries."""
        queries = saved(queries, "queries")
        load = saved(queries.groupBy("g", "c").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts")), "load")
        hot = small(load.filter("parts > 1"))
        parts = F.coalesce("parts", F.lit(1))
        dealt = queries.join(hot, ["g", "c"], "left").select("g", "c", F.pmod(F.xxhash64("uid"), parts).alias("s"), F.lit(1).alias("kind"), "uid", "n")
        held = inside.join(small(load.select("g", "c")), ["g", "c"], "left_semi").join(hot, ["g", "c"], "left")
        held = held.select("g", "c", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("s"), F.lit(0).alias("kind"), "uid", "n")
        both = saved(held.unionByName(dealt), "both")
        size, percent = self.size, self.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, members = None, []
            for batch in batches:
                for part in _portions(batch, "text"):
                    a, b = [], []
                    rows = zip(*(part[c].to_pylist() for c in ("g", "c", "s", "kind", "uid", "n")), shingle_sets(part["text"], size), strict=True)
                    for g, c, s, kind, uid, n, x in rows:
                        if (g, c, s) != now:
                            now, members = (g, c, s), []
                        if kind == 0:
                            members.append((uid, x))
                            continue
                        for other, y in members:
                            if 100 * min(n, len(y)) >= percent * max(n, len(y)):
                                shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                                if 100 * shared >= percent * (n + len(y) - shared):
                                    a.append(uid)
                                    b.append(other)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        texts = self.texts_of(both.select("uid"))
        sorted_in = both.join(texts, "uid").repartition("g", "c", "s").sortWithinPartitions("g", "c", "s", "kind")
        return saved(sorted_in.select("g", "c", "s", "kind", "uid", "n", "text").mapInArrow(check, "a bigint, b bigint"), "links")

    def first_links(self) -> DataFrame:
        """Links between a node and the few that stand for each of its MinHash keys."""
        keyed = self.nodes.select("uid", "n", F.explode(F.array(*[f"key{k}" for k in range(KEYS)])).alias("key"))
        first = [F.min_by(F.struct("uid", "n"), F.xxhash64("uid", F.lit(k))).alias(f"h{k}") for k in range(HEADS)]
        heads = keyed.groupBy("key").agg(F.count("*").alias("held"), *first).filter("held > 1")
        heads = heads.select("key", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("head"))
        heads = saved(heads, "heads")
        pairs = keyed.join(small(heads), "key").filter(F.col("uid") != F.col("head.uid"))
        close = 100 * F.least("n", "head.n") >= self.percent * F.greatest("n", "head.n")
        queries = pairs.filter(close).select(F.col("head.uid").alias("g"), F.lit(0).cast("long").alias("c"), "uid", "n").distinct()
        inside = heads.select(F.col("head.uid").alias("g"), F.lit(0).cast("long").alias("c"), F.col("head.uid").alias("uid"), F.col("head.n").alias("n")).distinct()
        return self.verified(inside, queries)

    def prefix_rows(self, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes with their group (uid, n, component, chunk), and those of their prefixes' rows that may
        meet another component's, under the order that puts frequent tokens last."""
        sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / F.lit(self.group_size)).alias("chunks")).filter("chunks > 1")
        grouped = labels.join(small(saved(sizes, "sizes")), "component", "left")
        grouped = saved(grouped.select(F.col("node").alias("uid"), "component", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).alias("chunk")), "grouped")
        members = saved(
            self.nodes.select("uid", "n").join(small(grouped), "uid", "left")
            .select("uid", "n", F.coalesce("component", "uid").alias("component"), F.coalesce("chunk", F.lit(0)).alias("chunk")), "members",
        )
        held = saved(self.rows.select(F.col("row").alias("uid"), F.col("prefix").alias("kept")).join(small(members), "uid"), "held")
        length = (F.col("n") - F.ceil(F.col("n") * self.percent / F.lit(100)) + 1).cast("int")
        exploded = lambda df, tokens: df.select("uid", "n", "component", "chunk", F.explode(tokens).alias("token"))
        rows = exploded(held, F.slice("kept", 1, length))
        met = saved(self._met(rows, members), "met")
        often = saved(self._frequent(met), "often")
        if often.isEmpty():
            return members, met
        late = self._late(exploded(held, F.col("kept")), often)
        # where a sketch can't replace its frequent tokens, the whole set is counted and ordered anew
        short = (F.size("kept") < F.col("n")) & (F.size("kept") - F.size("late") < length)
        far = saved(held.join(small(late), "uid").filter(short).select("uid"), "far")
        if not far.isEmpty():
            whole = self.sets(far).join(small(members), "uid")
            often = saved(often.union(self._frequent(exploded(whole, F.col("tokens")))).distinct(), "often")
            late = self._late(exploded(held, F.col("kept")), often)
        ordered = held.join(small(late), "uid", "left")
        moved = F.concat(F.array_except("kept", "late"), F.sort_array("late"))
        near = ordered.filter(~F.coalesce(short, F.lit(False)))
        out = exploded(near, F.slice(F.when(F.col("late").isNull(), F.col("kept")).otherwise(moved), 1, length))
        far = saved(ordered.filter(short).select("uid"), "far")
        if not far.isEmpty():
            sets = saved(self.sets(far), "sets").join(small(members), "uid")
            late = self._late(exploded(sets, F.col("tokens")), often)
            anew = sets.join(small(late), "uid").withColumn("tokens", F.concat(F.sort_array(F.array_except("tokens", "late")), F.sort_array("late")))
            out = out.unionByName(exploded(anew, F.slice("tokens", 1, length)))
        return members, self._met(out, members)

    def _frequent(self, rows: DataFrame) -> DataFrame:
        """Tokens that more than ``frequent`` groups hold."""
        held = rows.groupBy("token", "component", "chunk").agg(F.lit(1).alias("one"))
        return held.groupBy("token").agg(F.count("*").alias("groups")).filter(F.col("groups") > self.frequent).select("token")

    def _late(self, rows: DataFrame, often: DataFrame) -> DataFrame:
        """The frequent tokens of each node that has some."""
        return saved(rows.join(small(often), "token", "left_semi").groupBy("uid").agg(F.collect_list("token").alias("late")), "late")

    def _met(self, rows: DataFrame, members: DataFrame) -> DataFrame:
        """The rows whose token more than one component holds; most stand in one only and make no candidate. Narrow rows go
        to the join on tokens, and what is left gets its columns back."""
        shared = saved(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token"), "shared")
        left = saved(rows.select("uid", "token").join(small(shared), "token", "left_semi"), "shared-rows")
        return left.join(small(members), "uid").select("uid", "n", "component", "chunk", "token")

    def matrix_links(self, labels: DataFrame) -> DataFrame:
        """Links between different components of ``labels``, by the token-group matrix."""
        members, rows = self.prefix_rows(labels)
        matrix = rows.groupBy("token", "component", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        matrix = matrix.select("token", F.col("component").alias("g"), F.col("chunk").alias("c"), "least", "most")
        t = self.percent / 100
        near = (F.col("n") * t <= F.col("most") + 1e-6) & (F.col("least") * t <= F.col("n") + 1e-6)
        met = rows.join(matrix, "token").filter((F.col("g") < F.col("component")) & near)
        counted = met.groupBy("uid", "n", "g", "c").agg(F.count("*").alias("overlap"), F.min("least").alias("least"), F.max("most").alias("most"))

        def demanded(m):
            """Tokens of the prefixes that linked sets of n and m share at least: all that they must share, less what
            may lie beyond the longer prefix."""
            return F.ceil(t / (1 + t) * (F.col("n") + m) - 1e-6) - F.ceil(F.greatest(F.col("n"), m) * t - 1e-6) + 1

        least = F.greatest(F.col("least"), F.ceil(F.col("n") * t - 1e-6))
        most = F.least(F.col("most"), F.floor(F.col("n") / t + 1e-6))
        # over a group's sizes it is least at one end, but for rounding
        opened = counted.filter(F.col("overlap") >= F.least(demanded(least), demanded(most)) - F.when(least < most, 1).otherwise(0)).select("g", "c", "uid", "n")
        inside = members.select(F.col("component").alias("g"), F.col("chunk").alias("c"), "uid", "n")
        return self.verified(inside, opened)


def ngram_jaccard_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity_percent: int = 80,
    group_size: int = 16, frequent: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: id_col (bigint), n_shingles, component_id (the smallest id that links
    reach, its own included), and node (the digest that copies share)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, ROWS):
        join = _Join(texts, shingle_words, similarity_percent, group_size, frequent)
        links = join.first_links()
        more = join.matrix_links(connected_components(links))
    labels = connected_components(links.unionByName(more))
    placed = join.nodes.join(small(labels), join.nodes["uid"] == labels["node"], "left").select(join.nodes["node"], "least_id", F.coalesce("component", "uid").alias("component"))
    placed = saved(placed, "placed")
    smallest = saved(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "smallest")
    ids = small(saved(placed.join(small(smallest), "component").select("node", "component_id"), "classes"))
    out = join.rows.select("id", "n", "node").join(ids, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "node")


def one_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (null last), of equal ones the first
    in the table. Rows whose texts have no word are classes of their own and all stay."""
    number = free_name(docs, "row_number")
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    classes = ngram_jaccard_classes(rows, id_col=number, text_col=text_col, **how).select(F.col(number).alias("at"), "component_id")
    placed = rows.select(F.col(number).alias("at"), F.col(id_col).alias("id")).join(classes, "at")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")).select(F.col("first.at").alias(number))
    return rows.join(small(saved(first, "kept")), number, "left_semi").drop(number)
