from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.operators import duplicates
from plumbline.operators.duplicates import indel_similarity


def _texts(n, size, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcde fgh é漢", k=rng.randint(size // 2, size))) for _ in range(n)]
    for k in range(n // 3):  # neighbours at a few edits
        text = list(base[k])
        for _ in range(rng.randint(1, max(2, size // 10))):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "y"]])
        base.append("".join(text))
    return [*base, *base[:5], "", "", None]


@pytest.mark.parametrize("size", [12, 220])
@pytest.mark.parametrize("by_blocks", [True, False])
def test_near_pairs_against_brute_force(spark, monkeypatch, size, by_blocks):
    if size == 220 and not by_blocks:
        pytest.skip("what the blocks are for")
    monkeypatch.setattr(duplicates, "PAIRS_TO_ROW", 10**9 if by_blocks else 0)
    monkeypatch.setattr(duplicates, "BLOCK_TEXTS", 16)
    texts = _texts(60, size)
    rows = list(enumerate(texts))
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in duplicates.near_duplicates(spark.createDataFrame(rows, "row_index bigint, record string"), 0.9).collect())
    want = []
    for i, s in rows:
        for j, t in rows[i + 1 :]:
            if s is not None and t is not None and s != t and (x := indel_similarity(s, t)) >= 0.9 - 1e-12:
                want.append((i, j, round(x, 9)))
    assert len(want) > 10 and got == sorted(want)


def test_common_subsequences_of_many_pairs():
    rng = random.Random(4)
    left = ["".join(rng.choices("abcdé漢", k=k)) for k in (0, 1, 63, 64, 65, 128, 200)]
    right = ["".join(rng.choices("abcdz漢", k=k)) for k in (0, 2, 64, 130, 199)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    for cells in (1 << 22, 64):
        got = duplicates.lcs_lengths(left, right, i, j, cells)
        assert [round(indel_similarity(left[a], right[b]) * (len(left[a]) + len(right[b])) / 2) if left[a] or right[b] else 0 for a, b in zip(i, j, strict=True)] == got.tolist()


def test_profiles_say_when_near_rows_werent_looked_for(spark):
    df = spark.createDataFrame([(f"some name {k // 2}", "town") for k in range(24)], "name string, town string")
    near = lambda up_to: {r.profile: r.near_duplicate_count for r in duplicates.duplicate_profiles(df, near_up_to=up_to).collect()}
    assert near(5) == {"standard": 0, "normalized": 0, "smart": None} and near(12)["smart"] > 0
