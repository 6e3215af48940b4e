import hashlib

import numpy as np
import pytest

from karyospark.llm import line_dedup as L


def plain(rows, min_chars=40, min_docs=5):
    fold = str.maketrans(L.UPPER, L.LOWER)
    key = lambda x: x.strip(L.BLANKS).translate(fold)
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    holders = {}
    for d, ls in lines:
        if d is not None:
            for k in {key(x) for x in ls}:
                holders.setdefault(k, []).append(d)
    out = []
    for d, ls in lines:
        gone = lambda x: len(key(x)) >= min_chars and len(holders.get(key(x), ())) >= min_docs and d is not None and max(holders[key(x)]) != d
        kept = [x for x in ls if not gone(x)]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id bigint, text string, n_lines int, h1 string")
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(docs, **how).collect()), key=str)


LINE = "This line is certainly longer than forty characters, é."


@pytest.mark.parametrize("keys_a_shard", [1 << 16, 2])
def test_against_plain_python(spark, keys_a_shard):
    rows = [(i, f"own {i}\n  {LINE}\t\nshort\n{LINE.upper() if i % 2 else LINE}") for i in range(8)]
    rows += [(20 + i, f"{'x' * 40}\n{i}\n" + "\n".join(f"{k % 9} {'y' * 50}" for k in range(i + 2))) for i in range(9)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, LINE * 3000), (None, f"{LINE}\nx"), (None, LINE), (3, LINE)]
    assert run(spark, rows, keys_a_shard=keys_a_shard) == plain(rows)


def test_every_line_dropped_and_empty_table(spark):
    rows = [(i, LINE) for i in range(6)]
    assert run(spark, rows) == [(i, 1, 1 if i < 5 else 0, LINE if i == 5 else "") for i in range(6)]
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.dedup_lines(docs).count() == 0


def test_a_line_of_most_documents(spark):
    rows = [(i, f"{LINE}\nown {i} {'z' * 60 if i % 3 else ''}") for i in range(600)]
    assert run(spark, rows) == plain(rows)


def test_query_digest(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in plain(rows)]
    assert sorted((tuple(r) for r in L.op2_mph_line_dedup(spark, d).collect()), key=str) == sorted(want, key=str)


def test_hashes_that_share_their_first_half(spark):
    rows = [(d, 7, g) for d in range(1, 7) for g in (1, 2)] + [(d, 7, 3) for d in (1, 2)] + [(d, 9, 1) for d in range(3, 9)] + [(None, 7, 1)]
    probes = spark.createDataFrame(rows, "doc_id bigint, h1 bigint, h2 bigint").cache()
    index = L.build_line_index(probes, 1).cache()
    assert index.count() == 1 and len(index.first().spare) == 2 * 32
    got = sorted(map(tuple, L.probe_line_index(probes, index, 5, 1).collect()))
    assert got == sorted([(d, 7, g) for d in range(1, 6) for g in (1, 2)] + [(d, 9, 1) for d in range(3, 8)])


def test_a_line_goes_by_both_halves_of_its_hash():
    line, other = "x" * 50, "y" * 50
    halves = lambda t: [L._signed(t.encode(), s) for s in (42, L.SECOND_SEED)]
    text = f"{line}\n{other}"
    assert L._cut_one(text, np.array(halves(line)), 40) == (other, 2, 1)
    assert L._cut_one(text, np.array([halves(line)[0], 5]), 40) == (text, 2, 0)
    assert L._cut_one(text, np.array([*halves(line), halves(line)[0], 5, *halves(other)]), 40) == ("", 2, 2)
