"""Language of words and documents by a linear-chain conditional random field.

Words of a text form chains; each word has features, hashed into one weight table: its
character n-grams (those at a word's edges carry an edge mark, so they are its affixes) and,
if the training sample holds it often enough, the word itself (the lexicon). Transitions
between the labels of neighbours are learned with them, on windows of labelled documents
and on windows spliced from documents of several languages, so that the chain knows switches.
Forward-backward gives each word a distribution over languages; a document's is the mean
over its words that have a letter.

Training takes a bounded sample (``docs_per_language`` documents of each label, ``words_per_doc``
consecutive words of each, at a place drawn by hash) to the driver; labelling is one pass over the
whole texts of all rows, without a shuffle. A text of more than ``CHAIN`` words is worked through in
chains that reach ``MARGIN`` words over into their neighbours; posteriors of the margins are thrown
away, so every word sees its neighbours and the rest of the text has no weight left there.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text when nothing was learned; equal scores go to the first label in order; repeated rows
are labelled alike; an empty table gives no rows; ``lang_pred``, ``score`` and ``spans``
replace columns of these names, other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words_of
from .tokens import BATCH_ROWS, _portions

CHAIN = 512
MARGIN = 64
#: Size of the weight table; the last row stays zero.
BUCKETS = 1 << 17
NGRAMS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS + 1 by labels
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of its words


def word_features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each (lower-case) word, one array, and where each word's begin."""
    code = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    grown, out = np.zeros(len(code), np.uint64), []
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            grown = grown[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
            if n not in NGRAMS:
                continue
            mixed = grown * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            ids = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)
            ids[owner[: len(ids)] != owner[n - 1 :]] = BUCKETS
            out.append(np.pad(ids, (0, len(code) - len(ids)), constant_values=BUCKETS))
    whole = word_hashes(words)
    known = np.isin(whole, lexicon)
    out.append(np.full(len(code), BUCKETS))
    out[-1][first[known]] = (whole[known] % np.uint64(BUCKETS)).astype(np.int64)
    return np.stack(out, 1).ravel(), first * len(out)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def potentials(emissions: np.ndarray) -> np.ndarray:
    return np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)


def forward_backward(unary: np.ndarray, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of the words of chains. Word k has potentials ``unary[code[k]]``; chain j holds
    ``lengths[j]`` (at least 1) words from ``starts[j]``. With ``pairs`` also the expected transitions."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    most, k = (int(lengths[0]) if len(lengths) else 0), unary.shape[1]
    active = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # chains that have a t-th word
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    forward, scale = np.empty((len(code), k), np.float32), np.empty((len(code), 1), np.float32)
    state = np.exp(start - start.max()).astype(np.float32)[None, :].repeat(len(starts), 0)
    for t in range(most):
        at = starts[: active[t]] + t
        state = (state if t == 0 else state[: active[t]] @ a) * unary[code[at]]
        total = np.maximum(state.sum(1, keepdims=True), 1e-30)
        state /= total
        forward[at], scale[at] = state, total
    expected, back = np.zeros((k, k)), np.ones((len(starts), k), np.float32)
    post = np.empty((len(code), k), np.float32)
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        got = forward[at] * back[:n]
        post[at] = got / np.maximum(got.sum(1, keepdims=True), 1e-30)
        if t:
            right = unary[code[at]] * back[:n] / scale[at]
            if pairs:
                expected += a * (forward[at - 1].T @ right)
            back[:n] = right @ a.T
    return (post, expected) if pairs else post


def chains(n_words: np.ndarray, longest: int = CHAIN, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts whose words follow one another as chains: the place of each chain's words in the texts,
    the chains' starts and lengths in that, and which of its words aren't margin."""
    parts = -(-n_words // longest)
    first = np.cumsum(n_words) - n_words
    index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = np.repeat(first, parts), np.repeat(first + n_words, parts)
    core = begin + index * longest
    stop = np.minimum(core + longest, end)
    lo, hi = np.maximum(core - margin, begin), np.minimum(stop + margin, end)
    lengths = hi - lo
    starts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) + np.repeat(lo - starts, lengths)
    inner = (place >= np.repeat(core, lengths)) & (place < np.repeat(stop, lengths))
    return place, starts, lengths, inner


def train_sample(
    docs: DataFrame, *, text_col: str, lang_col: str, learn_from: Column, draw_col: str,
    docs_per_language: int = 300, words_per_doc: int = 120,
) -> list[tuple[str, list[str]]]:
    """Labelled runs of words, at most docs_per_language of each label: those with the least hash of draw_col and text."""
    some = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(draw_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    drawn = some.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    # different draws are ranked, so that a document that is repeated takes one place; at most docs_per_language rows a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    picks = drawn.select("lang", "draw").distinct().withColumn("rank", rank).filter(F.col("rank") <= docs_per_language).drop("rank")
    words = words_of(F.lower("text"))
    place = F.floor(F.pmod(F.col("draw") * 1e6, F.lit(1.0)) * F.greatest(F.size("words") - words_per_doc, F.lit(0))).cast("int") + 1
    runs = drawn.join(F.broadcast(picks), ["lang", "draw"]).select("lang", "draw", words.alias("words")).select("lang", "draw", F.slice("words", place, words_per_doc).alias("words"))
    rows = runs.groupBy("lang", "draw").agg(F.first("words").alias("words")).collect()
    return [(r.lang, r.words) for r in sorted(rows, key=lambda r: (r.lang, r.draw)) if r.words]


def train(sample: list[tuple[str, list[str]]], *, rounds: int = 50, rate: float = 0.15, decay: float = 1e-5, lexicon_docs: int = 3, spliced: float = 0.4, seed: int = 5) -> Model:
    """Maximum likelihood by Adam over all windows; deterministic for a sample."""
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros((0, 0)), np.zeros(0))
    rng, number, k = np.random.default_rng(seed), {x: i for i, x in enumerate(labels)}, len(labels)
    windows = [[(number[lang], w)] for lang, w in sample]
    for _ in range(int(spliced * len(sample))):
        picks = rng.integers(0, len(sample), int(rng.integers(2, 5)))
        spans = [(sample[p], int(rng.integers(3, 25))) for p in picks]
        windows.append([(number[lang], w[(s := int(rng.integers(0, max(1, len(w) - n)))) : s + n]) for (lang, w), n in spans])
    seen: dict[str, int] = {}
    for _, w in sample:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    vocabulary = {x: i for i, x in enumerate(sorted(seen))}
    listed = [x for x in vocabulary if seen[x] >= lexicon_docs]
    lexicon = np.sort(word_hashes(listed)) if listed else np.zeros(0, np.uint64)
    ids, first = word_features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(first, len(ids))))
    real = ids < BUCKETS
    ids, owner = ids[real], owner[real]  # every word has its edge-marked n-grams, so none is left without
    first = np.searchsorted(owner, np.arange(len(vocabulary)))
    code = np.array([vocabulary[x] for win in windows for _, w in win for x in w])
    gold = np.array([y for win in windows for y, w in win for _ in w])
    lengths = np.array([sum(len(w) for _, w in win) for win in windows])
    starts = np.cumsum(lengths) - lengths
    heads = np.zeros(len(code), bool)
    heads[starts] = True
    inner = np.flatnonzero(~heads)
    gold_pairs = np.bincount(gold[inner - 1] * k + gold[inner], minlength=k * k).reshape(k, k)
    gold_starts = np.bincount(gold[starts], minlength=k)
    params = [np.zeros((BUCKETS + 1, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        w, trans, start = params
        unary = potentials(np.add.reduceat(w[ids], first))
        post, expected = forward_backward(unary, code, starts, lengths, trans, start, pairs=True)
        by_word = np.stack([np.bincount(code, (gold == y) - post[:, y], len(vocabulary)) for y in range(k)], 1)
        by_feature = np.stack([np.bincount(ids, by_word[owner, y], BUCKETS + 1) for y in range(k)], 1)
        grads = [by_feature, gold_pairs - expected, gold_starts - post[starts].sum(0)]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / len(code) - decay * p
            m, v = moments[i] = (0.9 * moments[i][0] + 0.1 * g, 0.999 * moments[i][1] + 0.001 * g * g)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    params[0][BUCKETS] = 0
    return Model(labels, params[0].astype(np.float32), params[1], params[2], lexicon)


def label_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Posteriors of all words of some texts, whether each word has a letter, the words of each text, and the words."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    n_words = np.diff(ends)
    if not len(words):
        return np.zeros((0, len(model.labels)), np.float32), np.zeros(0, bool), n_words, flat
    lettered = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    ids, first = word_features(words.to_pylist(), model.lexicon)
    emissions = np.add.reduceat(model.weights[ids], first)
    emissions[~lettered] = 0  # figures and marks take the label of their neighbours
    place, starts, lengths, inner = chains(n_words)
    post = forward_backward(potentials(emissions), code[place], starts, lengths, model.transitions, model.start)
    return post[inner], lettered[code], n_words, flat


def label_documents(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (the mean posterior of that language over the words with a
    letter); with ``spans`` also the runs of words of one language: lang, first_word, n_words."""
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    keep = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "spans")])
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UNKNOWN], object)
        for batch in batches:
            for part in _portions(batch, text_col):
                if not m.labels:
                    added = [pa.array([UNKNOWN] * part.num_rows), pa.array([0.0] * part.num_rows)]
                    added += [pa.array([[]] * part.num_rows, SPANS)] if spans else []
                else:
                    post, lettered, n_words, _ = label_batch(part[text_col], m)
                    sums = np.zeros((len(post) + 1, len(m.labels)))
                    np.cumsum(post * lettered[:, None], 0, out=sums[1:], dtype=np.float64)
                    counts = np.concatenate([[0], np.cumsum(lettered)])
                    ends = np.cumsum(n_words)
                    total, count = sums[ends] - sums[ends - n_words], counts[ends] - counts[ends - n_words]
                    best = total.argmax(1)
                    score = np.clip(total[np.arange(len(best)), best] / np.maximum(count, 1), 0, 1)
                    added = [pa.array(np.where(count > 0, names[best], UNKNOWN), pa.string()), pa.array(np.where(count > 0, score, 0.0))]
                    if spans:
                        word = post.argmax(1)
                        added.append(pa.array([_runs(word[e - n : e], m.labels) if c else [] for e, n, c in zip(ends, n_words, count, strict=True)], SPANS))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *["lang_pred", "score", "spans"][: len(added)]])

    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if spans:
        run = [T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]
        schema.add("spans", T.ArrayType(T.StructType(run)))
    return keep.mapInArrow(label, schema)


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def _runs(word: np.ndarray, labels: list[str]) -> list[dict]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]])
    return [{"lang": labels[word[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cuts, cuts[1:], strict=False)]


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled rows outside the held-out fold; rows without id aren't learned from."""
    learn_from = ~held_out(id_col) & F.col(id_col).isNotNull()
    return train(train_sample(docs, text_col=text_col, lang_col=lang_col, learn_from=learn_from, draw_col=id_col))
