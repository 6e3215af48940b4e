import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from karyospark.llm import middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def numbers(doc_id, seed=42):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plainly(doc_id, text, share=50, spm_share=80, h=None):
    text = text or ""
    h1, h2, h3, h4 = h or numbers(doc_id)
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm_share:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def run_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab \n\t<>PSMé中\U0001f600\x85\xa0", max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), max_size=6), st.sampled_from([1, 3, 1 << 20]))
def test_scatter_and_gather(rows, block):
    before, M.BLOCK_BYTES = M.BLOCK_BYTES, block
    try:
        texts = [t for t, _ in rows]
        data, offsets = run_of(texts)
        h = [np.array([x[k] for _, x in rows], np.int64) for k in range(4)]
        n, form, prefix, middle, out, edges = M.scatter(data, offsets, h, 90, 50)
        back, back_edges, valid = M.gather(out, edges, form)
    finally:
        M.BLOCK_BYTES = before
    assert valid.all()
    for k, (text, x) in enumerate(rows):
        want = plainly(None, text, 90, 50, x)
        assert (n[k], ("plain", "psm", "spm")[form[k]], out[edges[k] : edges[k + 1]].tobytes().decode()) == (want[0], want[1], want[4])
        assert form[k] == 0 or (prefix[k], middle[k]) == want[2:4]
        assert back[back_edges[k] : back_edges[k + 1]].tobytes().decode() == text


@pytest.mark.parametrize("size", [1, 64, 4 << 20])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(M, "RUN_BYTES", size)
    texts = ["", None, " ", "one", " lead and trail  ", "<P>", "has <M> inside", "<", "<S", "P>", "é中 \U0001f600\n\nx", "a" * 10_000 + " \t" * 5_000, "word " * 50_000, "\x1c\x85\xa0 b"]
    rows = [(i, t, "clash", "clash") for i in range(40) for t in texts] + [(None, t, "", "") for t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string, _0 string")
    made = M.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "_0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = M.restore(made).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.restore(M.fill_in_middle(df.limit(0))).count() == 0


def test_outputs_without_their_marks(spark):
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<S>b<P>a<M>c", "acb"), ("psm", "<P><S><M>", ""), ("psm", "<S>b<P>a<M>c", None), ("spm", "<S>b<M>c<P>", None), ("psm", "", None), ("psm", "<P>a<S>", None), ("psm", "x<P>a<S>b<M>c", None), ("plain", "as it is", "as it is"), (None, "x", None), ("plain", None, None), ("odd", "x", None), ("psm", "<P>", None), ("psm", "<S><M>", None)]
    df = spark.createDataFrame(rows, "form string, output string, want string").coalesce(1)
    assert all(r.restored == r.want for r in M.restore(df).collect())


def test_shares(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c' AS text")
    forms = {r.form: r["count"] for r in M.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 10_000) < 300 and abs(forms["spm"] - 8_000) < 300
