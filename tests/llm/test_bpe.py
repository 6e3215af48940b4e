import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from karyospark.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    kinds = [0x250, 0x3000, 0x20000]
    texts = ["\x1c a\x1d\x1e", "\x85\x85x \xa0\xa0y", "a᠎b ​ c", "²³½ Ⅷ １２ x²", "don't 'S 's's", "   ", "\n", "a" * 3000, "<|endoftext|>", "x   \n  y"]
    for _ in range(1500):
        points = [rng.choice([rng.randrange(rng.choice(kinds)), 32, 10, 9]) for _ in range(40)]
        texts.append("".join(chr(c) for c in points if not 0xD800 <= c < 0xE000))
    return texts


@pytest.mark.parametrize(("at_once", "chars"), [(1 << 18, 1 << 20), (7, 30), (1 << 18, 500)])
def test_encode_as_the_library_and_back(library, monkeypatch, at_once, chars):
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", at_once)
    monkeypatch.setattr(bpe, "BATCH_CHARS", chars)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 500)
    codec = bpe.codec(P.path(bpe.VOCABULARY))
    texts = [None, "", *odd_texts(), "ab" * 400 + " the end", None]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == library.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()
    assert codec.encode(None) == []


def test_query_on_the_small_table(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.op6_two_tier_bpe(spark, d).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())


def test_columns_and_odd_rows(spark, library):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "Wörter, words", "c"), (2, "Wörter, words", "c")], "doc_id int, text string, token_ids string")
    rows = bpe.encode_documents(docs).withColumn("back", bpe.decode(bpe.F.col("token_ids"))).collect()
    assert [r.token_ids for r in rows] == [[], [], *[library.encode_ordinary("Wörter, words")] * 2]
    assert [bytes(r.back).decode() for r in rows] == ["", "", *["Wörter, words"] * 2]
    assert [(r.n_tokens, r.decoded_sha256) for r in rows] == [(len(r.token_ids), hashlib.sha256(bytes(r.back)).hexdigest()) for r in rows]
    assert bpe.encode_documents(docs.limit(0)).count() == 0
