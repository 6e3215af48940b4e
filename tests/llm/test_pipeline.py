"""The pipeline on the small tables, each stage against a plain version on its own input."""

import collections
import hashlib
import math

import pytest
import tiktoken

import corpus_pipeline as P
from karyospark.llm import line_dedup, mixing

from .test_bpe import library  # noqa: F401
from .test_line_dedup import plain as plain_lines

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    place, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{D}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, D).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert [s.columns for s in steps[:5]] == [steps[0].columns] * 5
    assert steps[5].columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"]


def test_quality_keeps_clean_documents(spark, steps):
    kept = rows(steps[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    clean = [k in kept for k, q in labels.items() if q == 1]
    junk = [k in kept for k, q in labels.items() if q == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.1
    assert all(kept[k].text == r.text for k, r in rows(steps[0]).items() if k in kept)


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    for doc, _, dropped, text in plain_lines([(k, r.text) for k, r in before.items()]):
        if dropped and not text.strip(line_dedup.BLANKS):
            assert doc not in after
        else:
            assert after[doc].text == text and after[doc].n_chars == len(text)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates(steps):
    before, after = rows(steps[2]), rows(steps[3])
    sets = {k: shingles(r.text) for k, r in before.items()}
    shared = collections.Counter()
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[:i])
    close = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    linked = {k for p, j in close.items() if j >= 0.8 for k in p}
    assert set(before) - linked <= set(after)  # unlike documents are left alone
    both = [p for p, j in close.items() if j >= 0.8 and p[0] in after and p[1] in after]
    found = [p for p, j in close.items() if j >= 0.8 and not (p[0] in after and p[1] in after)]
    assert len(found) > 20 and len(both) <= 0.03 * (len(found) + len(both))
    texts = collections.Counter(r.text for r in after.values())
    assert max(texts.values()) == 1
    assert {r.text for r in after.values()} <= {r.text for r in before.values()}


def test_mixing(steps):
    before, copies = rows(steps[3]), collections.Counter(r.doc_id for r in steps[4].collect())
    n = collections.Counter(r.source for r in before.values())
    whole = sum(math.sqrt(x) for x in n.values())
    for k, r in before.items():
        rate = len(before) * math.sqrt(n[r.source]) / whole / n[r.source]
        u = int(hashlib.md5(f"{k}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        want, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            want += 1
            p *= rate / want
            total += p
        assert copies[k] == want


def test_encoding(steps, library):  # noqa: F811
    texts = rows(steps[4])
    assert steps[5].count() == steps[4].count()
    assert isinstance(library, tiktoken.Encoding)
    encoded = {k: library.encode_ordinary(r.text) for k, r in texts.items()}
    for r in steps[5].collect():
        assert r.token_ids == encoded[r.doc_id] and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest()


def test_run_is_the_stages_in_order(spark, steps):
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.select("doc_id", "n_tokens").collect())
    assert key(P.run(spark, D)) == key(steps[5])


PROSE = "The river was wide and the boats were slow, but nobody on the shore had ever seen it from the other side of the hills. "
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, posterior string, rate string, copy string, n_lines string, original_text string, row string, mix_key string, token_ids string"


def odd_documents(spark):
    texts = [None, "", " \n\t ", PROSE, PROSE, PROSE * 3000, "x", "漢字 ☃ 🙂", PROSE + "\n" + "=" * 60 + "\nEnd of it."]
    rows = [(None if k == 4 else k // 2, t, "en", None if k % 3 else "web", len(t or ""), *(f"own {n}" for n in range(10))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:4], CLASH)


@pytest.mark.parametrize("n", range(5))
def test_odd_rows_and_clashing_names(spark, n):
    docs = odd_documents(spark)
    out = P.STAGES[n][1](spark, docs, D)
    got = out.collect()
    own = {tuple(r) for r in docs.collect()}
    if n < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {tuple(r) for r in got} <= own  # no line is common enough to go
    if n == 0:
        assert all(r.text and r.text.strip() for r in got)
    if n == 1:
        assert len(got) == docs.count()
    if n == 2:
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 0, 0, 1, 1, 1, 3, 3]  # 2 repeats the prose of 1, 4 goes on after it
    if n == 4:
        assert len(got) == docs.count() and all(r.n_tokens == len(r.token_ids) for r in got)
    nothing = P.STAGES[n][1](spark, docs.limit(0), D)
    assert nothing.count() == 0


def test_the_session_keeps_its_setting(spark, steps):
    assert spark.conf.get(P.BATCH_SETTING) == "10000"
