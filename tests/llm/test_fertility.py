import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from karyospark.llm import fertility as T


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


ODD = [None, "", " \n\t", "a", "\xa0x y z\x1cw v", "a b c d e f g h " * 3, "x\n\n x\nx\n x\nx ", "<#> *$ %& |", "w " * 5000, "né à ☃ 漢字 🙂 " * 40, "q" * 100_000]


@pytest.fixture(scope="module")
def rated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r.doc_id: r for r in T.op1_tokeniser_fertility(spark, "/root/testdata/sf0.01").collect()}, {r.doc_id: r.text for r in docs.collect()}


def test_base_counts(rated):
    rows, texts = rated
    for k, text in texts.items():
        r = rows[k]
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_measures_against_the_libraries(rated):
    rows, texts = rated
    v = T.Vocabularies(P.path(T.BPE_FILE), P.path(T.PIECE_FILE))
    for k in list(texts)[:200]:
        text = texts[k] or ""
        ids, parts = v.bpe.encode_ordinary(text), v.piece.encode(text)
        if not ids:
            continue
        n = len(ids)
        assert rows[k].bpe_chars_per_token == pytest.approx(len(text) / n)
        assert rows[k].piece_chars_per_token == pytest.approx(len(text) / len(parts))
        assert rows[k].entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(ids).values()))
        assert rows[k].fallback_share == pytest.approx(sum(map(v.piece.is_byte, parts)) / len(parts))


def upto(values, share):
    """The middle of the first histogram bin with this share of the values up to it."""
    values = sorted(values)
    return values[math.ceil(share * len(values)) - 1] + 0.5


def test_verdicts_against_plain_bands(rated):
    rows, texts = rated
    groups, seen = {}, set()
    length = lambda r: int(math.log2(r.n_words))
    for k, r in rows.items():
        if r.base_failed or (r.band, texts[k]) in seen:
            continue
        seen.add((r.band, texts[k]))
        script = T.script_of(texts[k])
        for g in [(r.band, length(r)), r.band, ("script", script), None]:
            groups.setdefault(g, []).append(r)
    checked = 0
    for k, r in rows.items():
        if r.base_failed:
            assert not r.kept
            continue
        keys = [(r.band, length(r)), r.band, ("script", T.script_of(texts[k]))]
        group = groups[next((g for g in keys if len(groups[g]) >= T.TRUSTED), None)]
        inside = True
        for name, step, least, both in T.BANDED:
            bins = [math.floor(x[name] / step) for x in group]
            low, middle, high = (upto(bins, q) * step for q in (0.125, 0.5, 0.875))
            value = r[name]
            above = value > middle + T.BAND_DEVIATIONS * max(least, (high - middle) / T.EIGHTH)
            below = value < middle - T.BAND_DEVIATIONS * max(least, (middle - low) / T.EIGHTH)
            inside &= not (above or below) if both else not (above and r.fallback_tokens > T.SPARED_TOKENS)
        checked += not inside
        assert r.kept == inside
    assert checked > 20


def test_clean_documents_stay_and_junk_goes(spark, rated):
    rows, _ = rated
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [rows[k].kept for k, q in labels.items() if q == 1 and not rows[k].base_failed]
    junk = [rows[k].kept for k, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.985 and np.mean(junk) < 0.35


@pytest.mark.parametrize("n_plain", [40, 400])
def test_bands_catch_what_the_base_rules_miss(spark, n_plain):
    rng = np.random.default_rng(1)
    plain_words = ["house", "river", "green", "walking", "seven", "table", "morning", "light", "paper", "under"]
    rows = [(i, " ".join(rng.choice(plain_words, 120)), "en") for i in range(1000, 1000 + n_plain)]
    emoji = " ".join("".join(chr(c) for c in rng.integers(0x1F600, 0x1F640, 4)) for _ in range(120))
    numbers = " ".join(f"{x:x}" for x in rng.integers(1 << 40, 1 << 60, 120))
    rows += [(100, emoji, "en"), (101, numbers, "en"), (102, emoji, "xx"), (103, numbers[:1500], None)]
    kept = {r.doc_id: r.kept for r in T.rate_fertility(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [k for k, v in sorted(kept.items()) if not v] == [100, 101, 102, 103]


def test_script_of_the_whole_text():
    assert T.script_of("A " + "слово " * 9) == "cyrillic" and T.script_of("12 %") == "other" and T.script_of("漢字 ab 漢") == "han" and T.script_of("ünder Ω") == "latin"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 1000)
    docs = spark.createDataFrame([(i // 2, t, 7, "m") for i, t in enumerate(ODD)] + [(None, "x y", 1, "m")], "doc_id bigint, text string, n_words int, m string")
    rows = T.rate_fertility(docs).collect()
    assert sorted((tuple(r)[1:6] for r in rows)) == sorted(map(plain, [*ODD, "x y"]))
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in rows)
    assert T.rate_fertility(docs.limit(0)).count() == 0
