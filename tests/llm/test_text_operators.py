from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, langid, mixing, quality
from plumbline.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string"


def test_language_of_held_out_documents(spark):
    got = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_edge_cases(spark):
    rows = [(1, None, "en", "a", 5), (2, "", "en", "a", 5), (3, "12 -- 7 !", "fr", None, 5), (4, "the cat and the dog " * 50, None, None, 5), (4, "the cat and the dog " * 50, None, None, 5), (None, "le chat et le chien", "fr", None, 5)]
    rows += [(k, "the house and the cat of the town", "en", "a", 5) for k in range(10, 30)] + [(k, "le chat et la maison de la ville", "fr", "a", 5) for k in range(30, 50)]
    docs = spark.createDataFrame(rows, DOCS + ", score int")
    out = langid.label_documents(docs, langid.fit(docs), spans=True).collect()
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    for k in (1, 2, 3):
        assert (by_id[k][0].lang_pred, by_id[k][0].score, by_id[k][0].spans) == ("und", 0.0, [])
    assert [r.lang_pred for r in by_id[4]] == ["en", "en"] and by_id[None][0].lang_pred == "fr"
    assert sum(s.n_words for s in by_id[4][0].spans) == 250
    empty = docs.limit(0)
    assert langid.label_documents(empty, langid.fit(empty)).count() == 0
    assert langid.label_documents(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0


def test_switches_inside_a_text_are_seen():
    sample = [("en", "the house and the cat of the town in the night".split())] * 40 + [("fr", "le chat et la maison de la ville dans les nuits".split())] * 40
    model = langid.train(sample, rounds=30)
    words = "the cat and the house le chat et la maison".split()
    post, lettered, n, _ = langid.label_batch(pa.array([" ".join(words)]), model)
    assert [model.labels[k] for k in post.argmax(1)] == ["en"] * 5 + ["fr"] * 5


def test_long_texts_are_labelled_as_one_chain():
    sample = [("en", "the house and the cat of the town in the night".split())] * 40 + [("fr", "le chat et la maison de la ville dans les nuits".split())] * 40
    model = langid.train(sample, rounds=30)
    rng = np.random.default_rng(2)
    words = []
    while len(words) < 5000:  # switches, and stretches without any letter
        words += list(rng.choice([*sample[int(rng.integers(2)) * 40][1], "--", "12"], int(rng.integers(5, 40)))) + ["7"] * int(rng.integers(0, 20))
    post, lettered, n, _ = langid.label_batch(pa.array(["the cat", " ".join(words), None]), model)
    ids, first = langid.word_features(words, model.lexicon)
    emissions = np.add.reduceat(model.weights[ids], first)
    emissions[~np.array([any(c.isalpha() for c in w) for w in words])] = 0
    whole = langid.forward_backward(langid.potentials(emissions), np.arange(len(words)), np.array([0]), np.array([len(words)]), model.transitions, model.start)
    assert n.tolist() == [2, len(words), 0] and len(post) == 2 + len(words)
    assert np.allclose(post[2:], whole, atol=1e-4)


def test_all_labels_are_learned_and_repeats_are_bounded(spark):
    rows = [(k, f"w{k % 80}x " * 30, f"l{k % 80}", "a") for k in range(800)] + [(7, "one text again and again", "l7", "a")] * 3000
    docs = spark.createDataFrame(rows, DOCS)
    sample = langid.train_sample(docs, text_col="text", lang_col="lang", learn_from=F.lit(True), draw_col="doc_id", docs_per_language=20)
    n = Counter(lang for lang, _ in sample)
    assert set(n) == {f"l{k}" for k in range(80)} and max(n.values()) <= 20


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    unary, trans, start = np.exp(rng.normal(size=(6, 3))).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    code, lengths = np.array([0, 1, 2, 3, 4, 5, 0]), np.array([4, 3])
    post = langid.forward_backward(unary, code, np.array([0, 4]), lengths, trans, start)
    for lo, n in ((0, 4), (4, 3)):
        weights = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = math.exp(start[path[0]]) * math.prod(float(unary[code[lo + t], y]) for t, y in enumerate(path)) * math.exp(sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                weights[t, y] += w
        assert np.allclose(post[lo : lo + n], weights / weights.sum(1, keepdims=True), atol=1e-4)


def test_mix_meets_its_targets(spark):
    got = QUERIES["op4_mixing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sizes = {k: len(r.text.encode().split()) for k, r in docs.items()}
    assert {r.doc_id: r["size"] for r in got} == sizes
    totals = Counter()
    for k, r in docs.items():
        totals[r.source] += sizes[k]
    target, left, free = {}, 1.5 * sum(totals.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(totals))}
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > 2 * totals[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * totals[s]
            left -= target[s]
            del free[s]
    taken, largest = Counter(), Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == totals[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in totals)
    again = {r.doc_id: r.taken for r in QUERIES["op4_mixing"](spark, "/root/testdata/sf0.001").collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_edge_cases(spark):
    rows = [(1, None, "en", "b"), (2, "", "en", None), (3, "x " * 50_000, "en", "a"), (None, "one two", None, None), (5, "a b c", "en", "b"), (5, "a b c", "en", "b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", taken int")
    out = mixing.mix(docs)
    assert out.count() == 6 and out.columns.count("taken") == 1
    assert all(r.taken <= 2 * r["size"] for r in out.collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    heavy = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("one").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    half = mixing.mix(heavy, total_share=0.5, quality=F.col("w")).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r.odd: r.n for r in half}
    assert n[0] + n[1] == 2000 and n[0] > 1.8 * n[1]  # heavier documents come first


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "back\\slash <|end|> <|turn|>x", "", "a\nb", "<\\|text|>\\\\"]
    rows = [(7, k, role, t) for k, (role, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant"], texts, strict=True))]
    rows += [(8, 1, None, None), (8, 0, "user", "hi"), (9, 0, "assistant", "x"), (9, 0, "assistant", "x"), (None, 3, "us<|er", "q")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, example string")
    examples = chat.prefix_examples(turns)
    got = examples.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("loss", chat.loss_text(examples)).collect()
    by_conv = defaultdict(list)
    for r in sorted(got, key=lambda r: r.example):
        by_conv[r.conv_id].append(r)
    assert [[t.text for t in r.turns] for r in by_conv[7]] == [texts[:3], texts]
    assert [r.loss for r in by_conv[7]] == ["", texts[4]]
    assert [(t.role, t.text) for t in by_conv[8][-1].turns] == [("user", "hi"), ("", "")] and by_conv[8][-1].loss_length == 0
    assert [r.loss for r in by_conv[9]] == ["x", "x"]
    assert by_conv[None][0].turns[0].role == "us<|er"
    for r in got:
        for control in ("</s>", "[INST]", "[/INST]"):
            assert control not in r.text
    assert chat.prefix_examples(turns.limit(0)).count() == 0


def _repeated(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)})


def test_very_long_texts_are_counted_and_formatted_whole(spark):
    words = [f"w{i % 9973}" for i in range(60_000)]
    long = " ".join(words) + "\n</s>[INST] \\ <|end|>"
    docs = spark.createDataFrame([(1, long, "en", "s"), (1, long, "en", "s")], DOCS)
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == 2 and all((r.n_words, r.n_repeat_words, r.n_symbols) == (60_003, _repeated(long.split()), 6) for r in got)
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    examples = chat.prefix_examples(turns)
    r = examples.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("loss", chat.loss_text(examples)).first()
    assert [t.text for t in r.turns] == [long, long] and r.loss == long


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_quality_counts(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = [w.decode() for w in d.text.encode().split()]
        lines = [x for x in d.text.split("\n") if x.encode().split()]
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in d.text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), _repeated(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.base_failed and r.kept)
        if labels.get(d.doc_id) == 1 and not r.base_failed:
            clean.append(r.kept)
    assert np.mean(clean) > 0.98


def test_quality_edge_cases(spark):
    rows = [(1, None, None, "s"), (2, "", "en", "s"), (3, "$$$ " * 400, "en", "s"), (None, "a b c d e f g a b c", "en", None), (5, "x\n" * 60, "xx", None)]
    rows += [(k, " ".join(f"w{i * k % 97} the" for i in range(100)), "en", "s") for k in range(10, 40)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_words int")
    out = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and not out[1].kept
    assert out[None].n_repeat_words == 6 and out[5].n_dup_lines == 59
    assert quality.quality_verdicts(docs.limit(0)).count() == 0
    even = docs.select(F.array(F.lit(1.0), F.lit(0.0)).alias("p"), F.array(F.lit(0.0), F.lit(3.0)).alias("q")).limit(1)
    assert even.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(1.0)
    assert even.select(quality.js_distance(F.col("p"), F.col("p"))).first()[0] == 0.0


def test_documents_without_language_are_judged_by_the_nearest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))
    own = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    got = {r.doc_id: r for r in quality.quality_verdicts(hidden).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    unnamed = [r.doc_id for r in hidden.filter("lang IS NULL").collect()]
    passed = [d for d in unnamed if own[d].kept and own[d].n_words >= 100]
    assert {lang[d] for d in passed} == {"de", "en", "es", "fr"}
    assert [d for d in passed if not got[d].kept] == []
    # noise is as far from the nearest reference as from its own
    failed = [d for d in unnamed if not own[d].kept and own[d].n_words >= 100]
    assert failed and all(not got[d].kept for d in failed if not own[d].base_failed) and all(got[d].word_distance is not None for d in failed)
    # brute force over the named documents' words
    words = {r.doc_id: [w.decode() for w in r.text.encode().split()] for r in docs.collect()}
    counts = {x: Counter(w for d in words if lang[d] == x and d not in set(unnamed) for w in words[d]) for x in ("de", "en", "es", "fr")}
    common = {x: sorted(c, key=lambda w, c=c: (-c[w], w))[:40] for x, c in counts.items()}

    def distance(d, x):
        c, n = Counter(words[d]), [counts[x][w] for w in common[x]]
        p, q = np.array([c[w] for w in common[x]], float), np.array(n, float)
        p, q = np.append(p, len(words[d]) - p.sum()) / len(words[d]), np.append(q, counts[x].total() - q.sum()) / counts[x].total()
        m = (p + q) / 2
        return np.sqrt(max(0, sum(np.sum(v[v > 0] * np.log2(v[v > 0] / m[v > 0])) for v in (p, q)) / 2))

    for d in [d for d in words if len(words[d]) >= 100]:
        assert got[d].word_distance == pytest.approx(min(distance(d, x) for x in counts) if d in unnamed else distance(d, lang[d]), abs=1e-9)
    nameless = quality.quality_verdicts(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.char_distance is None and r.word_distance is None and r.kept == (not r.base_failed) for r in nameless)
