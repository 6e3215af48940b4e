from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from karyospark.llm import hard_negatives as H
from karyospark.llm import tiles as T
from karyospark.llm import topk_search as K

SCHEMA = "vec_id bigint, label int, embedding array<float>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 70), st.integers(1, 70), st.sampled_from([3, 10**6, 2**40, 2**63 - 1]), st.integers(0, 99))
def test_strassen_is_exact(m, k, n, size, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
    before, T.LEAF = T.LEAF, 4
    try:
        got = T.strassen(a, b)
    finally:
        T.LEAF = before
    assert (got == a @ b).all()  # numpy's integers count modulo 2^64 as well


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(1, 4))
def test_heaps(seed, k, tiles, values):
    rng = np.random.default_rng(seed)
    heaps, seen, at = T.Heaps(6, k), defaultdict(list), 0
    for n in tiles:
        rows = rng.permutation(6)[:4]
        scores, ids, valid = rng.integers(0, values, (4, n)), np.arange(at, at + n), rng.random((4, n)) < 0.7
        at += n
        heaps.offer(rows, scores, ids, valid, scores + 1)
        for i, j in zip(*np.nonzero(valid), strict=True):
            seen[rows[i]].append((-scores[i, j], ids[j], scores[i, j] + 1))
    for r in range(6):
        want = sorted(seen[r])[:k]
        held = heaps.full[r]
        assert list(zip((-heaps.score[r, held]).tolist(), heaps.id[r, held].tolist(), heaps.extra[r, held].tolist(), strict=True)) == want


def codes(v, scale):
    return [min(max(int(np.floor(np.float64(np.float32(x)) * scale)), -(2**63)), 2**63 - 1) for x in v]


def score(a, b):
    s = sum(x * y for x, y in zip(a, b, strict=False)) & (2**64 - 1)
    return s - 2**64 if s >= 2**63 else s


def sound(v):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)


def plain_top(rows, k, scale, every):
    rows = [(i, codes(v, scale)) for i, _, v in rows if i is not None and sound(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        best = sorted((-score(v, w), i) for i, w in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def plain_negatives(rows, scale, every, positives=5, negatives=5, window=(80, 100)):
    rows = [(i, lab, codes(v, scale)) for i, lab, v in rows if i is not None and lab is not None and sound(v)]
    out = []
    for a, lab, v in {(i, x, tuple(v)) for i, x, v in rows if i % every == 0}:
        met = [(-score(v, w), i, x == lab) for i, x, w in rows if i != a]
        for s, p, _ in sorted(m for m in met if m[2])[:positives]:
            fits = sorted((t, n) for t, n, same in met if not same and window[0] * -s <= 100 * -t <= window[1] * -s)
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def clouds(n, dims, seed, labels=4):
    """Vectors around a few centres, many of them equal, so that scores tie."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    rows = []
    for i in range(n):
        v = centres[i % 5] + (rng.standard_normal(dims) * 0.3 if i % 3 else 0)
        rows.append((i, int(rng.integers(labels)), [float(x) for x in v]))
    return rows


@pytest.mark.parametrize(("dims", "block", "tile"), [(64, 32_768, 2048), (7, 3, 10), (33, 5, 16)])
def test_brute_force(spark, monkeypatch, dims, block, tile):
    monkeypatch.setattr(T, "QUERY_ROWS", block)
    monkeypatch.setattr(T, "TILE_QUERIES", max(2, block // 2))
    monkeypatch.setattr(T, "TILE_ROWS", tile)
    monkeypatch.setattr(T, "CHUNK_ROWS", 40)
    rows = clouds(400, dims, dims)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 20 == 0, k=4, scale=16.0).collect())) == plain_top(rows, 4, 16.0, 20)
    got = sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 20 == 0, scale=16.0).collect()))
    assert got == plain_negatives(rows, 16.0, 20) and len(got) > 100


def odd(n=30):
    nan, inf, big = float("nan"), float("inf"), 3e38
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [1.0, 2.0, 3.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 1, []), (3, 1, None), (4, None, [1.0, 2.0]), (None, 1, [1.0, 1.0]), (5, 1, [1.0, None]), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0])]
    rows += [(8, 2, [big, 1.0]), (9, 2, [-big, 1.0]), (10, 1, [big, big]), (11, 3, [0.0, -0.0]), (12, 1, [-1.0, -2.0]), (20, 2, []), (30, 1, [1e-40, 2.0])]
    return rows + [(100 + i, i % 3, [float(i % 4), 1.0]) for i in range(n)]


def test_odd_rows(spark):
    for rows in (odd(), odd(0)):
        df = spark.createDataFrame([(*r, 7, "x", 9, 1) for r in rows], SCHEMA + ", no bigint, block string, score int, rank int")
        tens = F.col("vec_id") % 10 == 0
        assert sorted(map(tuple, K.top_k(df, tens, k=5, scale=16.0).collect())) == plain_top(rows, 5, 16.0, 10)
        assert sorted(map(tuple, H.hard_negatives(df, tens, scale=16.0).collect())) == plain_negatives(rows, 16.0, 10)
    empty = df.limit(0)
    assert K.top_k(empty, tens).count() == 0 and H.hard_negatives(empty, tens).count() == 0
    assert K.top_k(df, F.lit(None).cast("boolean")).count() == 0 and H.hard_negatives(df, F.lit(False)).count() == 0
    some = [r for r in rows if not r[2] or max(x or 0 for x in r[2]) < 1e9][:14]  # fewer answers than k, and no sum too long
    assert sorted(map(tuple, K.top_k(spark.createDataFrame(some, SCHEMA), tens, k=9, scale=16.0).collect())) == plain_top(some, 9, 16.0, 10) != []
    few = spark.createDataFrame(rows[:1], SCHEMA)
    assert K.top_k(few, tens).count() == 0 and H.hard_negatives(few, tens).count() == 0


def test_window_of_huge_scores(spark):
    low, high = H._bounds((80, 100))
    values = [-(2**63), -7, -5, 0, 1, 4, 99, 2**63 - 1]
    for r in spark.createDataFrame([(v,) for v in values], "score bigint").select("score", low.alias("low"), high.alias("high")).collect():
        assert r.high == r.score and r.low == -(-80 * r.score // 100)


def test_cutoff_spares_most_scores():
    """No vector that reaches the cutoff is dropped, most others are, and without a cutoff none is."""
    vectors = np.random.default_rng(5).integers(-500, 500, (3000, 64))
    parts = [vectors[:20, a] @ vectors[:, a].T for a in np.array_split(np.arange(64), K.LISTS)]
    whole = np.sum(parts, axis=0)
    cutoff = np.sort(whole, axis=1)[:, -11, None]
    seen, known, enough = K.sufficient(parts, cutoff)
    assert enough[whole >= cutoff].all() and (whole >= cutoff).sum() < enough.sum() < 0.4 * enough.size
    assert (known == sum(np.where(s, p, 0) for s, p in zip(seen, parts))).all()
    assert K.sufficient(parts, np.full((20, 1), T.LOWEST))[2].all()
