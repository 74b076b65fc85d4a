from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, lexical, secrets
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"


# secrets


def base_spans(text):
    """(start, kind, stop) by patterns over code points."""
    text, out = text or "", []
    keyword = r"(?:password|passwd|secret|token|api_?key)"
    for m in re.finditer(rf"(?ai:{keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def hostile_texts(n=400, seed=3):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "ſecret", "secret", "toKen", "api_key", "apikey", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x.y/z+", "é", "漢字", "🙂", "\n", "\x00", "-", "_", "abcdefghijkl", "K"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(n)]


def test_base_spans_against_patterns(spark):
    texts = [None, "", *hostile_texts(), "é" * 50_000 + ' token = "' + "0123456789abcdef" * 2000 + '" AKIA' + "Z9" * 9]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:5])], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in secrets.scan(docs, secrets.Formats()).collect():
        got[r.doc_id].append([(s.start, s.kind, s.stop) for s in r.spans])
    for k, text in enumerate(texts):
        assert all(x == base_spans(text) for x in got[k]) and len(got[k]) == (2 if k < 5 else 1), text


def test_secrets_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_secrets"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        base = base_spans(docs[r.doc_id])
        said = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == said


def test_learned_formats_add_what_patterns_miss(spark):
    rng = random.Random(5)
    figures = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    words = ["".join(rng.choices(["tion", "ment", "er", "the", "lich", "keit", "ou", "re"], k=rng.randint(4, 7))) for _ in range(600)]
    rows = [(k, " ".join(rng.choices(words, k=30)) + (f' token = "{figures(40)}"' if k % 3 == 0 else "")) for k in range(1500)]
    rows += [(-1, "see " + figures(15) + "g and " + (lone := "f" + figures(13)) + " here"), (-2, "internationalization of the government-wide questionnaires")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = secrets.fit(docs)
    assert len(model.kinds) == 2 and len(model.kinds[0].end) < 20
    spans = {r.doc_id: r.spans for r in secrets.scan(docs, model).collect()}
    text = dict(rows)
    assert [text[-1][s.start : s.stop] for s in spans[-1] if s.kind == 3] == [lone] and spans[-2] == []
    assert sum(s.kind == 3 for k, x in spans.items() if k >= 0 for s in x) <= 0.002 * sum(len(t.split()) for t in text.values())
    again = secrets.fit(docs.repartition(7))
    assert np.allclose(again.thresholds, model.thresholds)


def test_merging_finds_the_states_of_a_known_language():
    rng = random.Random(1)
    values = [("key-" + "".join(rng.choices("01", k=2 * rng.randint(2, 20)))).encode() for _ in range(500)]
    automaton = secrets.learned(values)
    assert len(automaton.end) <= 12  # a tree of the values has thousands
    flat = lambda v: (secrets._SYMBOL[np.frombuffer(v, np.uint8)], np.array([0]), np.array([len(v)]))
    per = lambda v: float(automaton.scores(*flat(v))[0]) / len(v)
    assert per(b"key-011010110100") > per(b"key-01101x110100") + 1 and per(b"key-0110") > per(b"yek-0110") + 1
    long = b"key-" + b"01" * 5000
    one, many = automaton.scores(*flat(long)), automaton.scores(np.tile(flat(long)[0], 5), np.arange(5) * len(long), np.full(5, len(long)))
    assert np.allclose(one, many)


def test_secrets_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.digests(secrets.scan(empty, secrets.fit(empty))).count() == 0
    clash = spark.createDataFrame([(1, "token=0123456789ab", 2, None)], "doc_id bigint, text string, spans int, kind string")
    assert secrets.digests(secrets.scan(clash, secrets.fit(clash))).first().n_assign == 1


# divergence


def audited(rows, least=3, listed=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in terms}:
        df = Counter(t for x, _, ts in terms if x == lang for t in set(ts))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        count = {s: Counter(t for x, y, ts in terms if (x, y) == (lang, s) for t in ts if t in set(kept)) for x, s, _ in terms if x == lang}
        v, n = len(kept), {s: sum(c.values()) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (n[s] + v) for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in count.values()) + 1) // (sum(n.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s), key=lambda x: (-x[0], x[1].encode()))
            found = sorted(((f(p[s][t], q[t]), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:listed]
            out += [(lang, s, "pair", o, x, k) for k, (x, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, x, k) for k, (x, t) in enumerate(found, 1)]
    return sorted(out)


def source_rows(n=300, seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "漢字", "a1b", "x", "zz", "q-r", "🙂", "naïve", "AB\x00cd", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = [(" ".join(rng.choices(words, [30, *[1] * (len(words) - 1)], k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None, ""])) for _ in range(n)]
    return rows + [("once only", "de", "a"), (None, "de", "b"), (None, "de", "b"), ("12 34", "es", "a"), (None, None, "z"), ("the " * 20_000, "en", "a")]


@pytest.mark.parametrize(("chunk", "text_bytes", "listed"), [(4096, 1 << 24, 200), (5, 300, 3)])
def test_divergence_against_brute_force(spark, chunk, text_bytes, listed):
    rows = source_rows()
    df = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], DOCS + ", term string, cnt int")
    got = divergence.source_divergence(df, listed=listed, chunk_terms=chunk, text_bytes=text_bytes).collect()
    assert sorted(map(tuple, got)) == audited(rows, listed=listed)


def test_dictionary_ids_keep_utf8_order(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(source_rows())], DOCS)
    encoded = divergence.Encoded(df, chunk_terms=4)
    by_lang = defaultdict(list)
    for r in encoded.dictionary().collect():
        by_lang[r.lang].append((r.id, r.term))
    assert set(by_lang) == {"en", "fr", ""}
    for found in by_lang.values():
        found.sort()
        assert [k for k, _ in found] == list(range(len(found))) and [t for _, t in found] == sorted((t for _, t in found), key=str.encode)


def test_scaled_is_exact():
    rng = random.Random(6)
    totals = [rng.randint(1, 9 * 10**15) for _ in range(500)] + [1, 7, 9 * 10**15]
    counts = [rng.randint(0, t) for t in totals[:-1]] + [totals[-1]]
    assert divergence.scaled(np.array(counts), np.array(totals)).tolist() == [10**9 * c // t for c, t in zip(counts, totals, strict=True)]


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


# search


def ranked(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) & c.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "The", "été", "w1", "42", "漢字", "x", *[f"t{k}" for k in range(40)]]
    docs = [(rng.choice([-(2**62), -5, 2**62, *range(200)]), " ".join(rng.choices(words, [60, *[2] * 6, *[1] * 40], k=rng.randint(0, 40)))) for _ in range(400)]
    docs += [(7, "t1 t2 the"), (7, "t1 t2 the"), (3, "t1 t2 the"), (None, "t1 t2 the"), (None, "t1 t2 the"), (9, None), (10, ""), (11, "-- !"), (12, "t3 " * 30_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(12)] + [(3, "t1 t2"), (50, None), (51, "--"), (52, "unseen"), (None, "the t1"), (60, "t1 " * 5000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, shard int, number int").repartition(3)
    wanted = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, term string")
    for size in (1 << 24, 700):
        index = lexical.build_index(df, shard_bytes=size)
        assert index.filter("term IS NULL").agg(F.sum("n")).first()[0] == sum(bool(re.search(r"\w", t or "")) for _, t in docs)
        for k in (10, 3):
            got = lexical.search(index, wanted, k=k).collect()
            assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == ranked(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    assert lexical.search(lexical.build_index(docs), some.withColumnRenamed("id", "item_id")).count() == 0
    assert lexical.search(lexical.build_index(some, id_col="id"), items).count() == 0


def test_postings_round_trip_and_merge():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 300, 500), [0, 127, 128, 2**14, 2**35, 2**63 - 1]]).astype(np.int64)
    ends = np.array([0, 3, 3, 400, len(values)])
    rows = [lexical.unpacked(x.as_py()) for x in lexical.packed(values, ends)]
    assert [len(r) for r in rows] == [0, 3, 0, 397, 106] and np.array_equal(np.concatenate(rows), values)
    for _ in range(30):
        cursors = [(np.flatnonzero(rng.random(500) < rng.random()), None) for _ in range(6)]
        cursors = [(p, rng.integers(0, 5, len(p))) for p, _ in cursors]
        total = Counter()
        for p, g in cursors:
            total.update(dict(zip(p.tolist(), g.tolist(), strict=True)))
        want = sorted(((s, p) for p, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:7]
        assert lexical.best_of(cursors, 7, window=16) == want
