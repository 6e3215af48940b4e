"""Quality rules from tokeniser fertility.

Whole texts are encoded with two public vocabularies: a byte-level BPE
(characters per token, entropy of the tokens) and a piece vocabulary with byte
fallback (characters per token, share of fallback bytes).  A document is
rejected where a measure leaves the band of its language, or of its script
where no language is given, among texts of about its length.  Bands come from
all documents: histograms of the distinct texts give each group's median and
the values that an eighth of them lies beyond, and these the band.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.operators.lineage import cut

from .bits import mix
from .texts import BLANK, words_of

# The characters that count as symbols, and the length of a repeated run of words.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

SLICE_CHARS = 1 << 21
#: Standard deviations (as an eighth of the texts beyond shows them, on each side) that a band reaches from the median.
BAND_DEVIATIONS = 4.0
#: Texts from which a group's eighths are trusted; smaller groups take the band of the next wider one.
TRUSTED = 100
BROADCAST_ROWS = 100_000
BPE_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

#: Measures that have a band: name, histogram step, least standard deviation, and whether low values are judged.
BANDED = [("bpe_chars_per_token", 0.01, 0.03, True), ("piece_chars_per_token", 0.01, 0.03, True), ("entropy_gap", 0.01, 0.03, True), ("fallback_share", 0.001, 0.004, False)]
#: Fallback tokens (two characters of four bytes) that no text is rejected for.
SPARED_TOKENS = 8
EIGHTH = 1.1503  # standard deviations from the median to the value that an eighth lies beyond

# First and last code points of the letters of scripts.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6), ("latin", 0xF8, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x5D0, 0x5EA), ("arabic", 0x620, 0x64A), ("arabic", 0x66E, 0x6D3), ("devanagari", 0x904, 0x961),
    ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FFFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
SCRIPT_OF = np.zeros(0x30001, np.uint8)
for _name, _first, _last in SCRIPTS:
    SCRIPT_OF[_first : _last + 1] = SCRIPT_NAMES.index(_name)

FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, bpe_tokens bigint, piece_tokens bigint, fallback_tokens bigint, entropy double"


class Vocabularies:
    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        lines = open(bpe_path, "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = len(ranks)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        return [self.bpe.encode_to_numpy(t, disallowed_special=()) for t in texts], self.piece.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def vocabularies(bpe_path: str, piece_path: str) -> Vocabularies:
    return Vocabularies(bpe_path, piece_path)


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE_CHARS, cut at white space."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = re.compile(r"[\x20\x09-\x0D]").search(text, at + SLICE_CHARS)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    counts: dict[str, int] = {}
    for x in lines:
        counts[x] = counts.get(x, 0) + 1
    return sum(n - 1 for x, n in counts.items() if n > 1 and BLANK.sub("", x))


def repeat_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the words that stand in a window of WINDOW words found twice or more in it."""
    n = len(codes) - WINDOW + 1
    out = np.zeros(n_docs, np.int64)
    if n < 2:
        return out
    start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    with np.errstate(over="ignore"):
        one, h = mix(codes.view(np.uint64)), mix(doc[:n].view(np.uint64), 5)
        for j in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + one[j : n + j]
    start = start[np.argsort(h[start], kind="stable")]
    a, b = start[:-1], start[1:]
    near = np.flatnonzero((h[a] == h[b]) & (doc[a] == doc[b]))
    a, b = a[near], b[near]
    same = np.ones(len(a), bool)
    for j in range(WINDOW):
        same &= codes[a + j] == codes[b + j]
    edge = np.zeros(len(codes) + 1, np.int64)
    twice = np.unique(np.concatenate([a[same], b[same]]))
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    return out + np.bincount(doc[covered], minlength=n_docs)


def measure(texts: list[str | None], vocab: Vocabularies) -> pd.DataFrame:
    """The FIELDS of each text."""
    frames, part, chars = [], [], 0
    for text in texts:
        part.append(text or "")
        chars += len(part[-1])
        if chars > SLICE_CHARS:
            frames.append(_measure_part(part, vocab))
            part, chars = [], 0
    frames.append(_measure_part(part, vocab))
    return pd.concat(frames, ignore_index=True)


def _measure_part(texts: list[str], vocab: Vocabularies) -> pd.DataFrame:
    n = len(texts)
    slices = [(k, part) for k, text in enumerate(texts) for part in _slices(text)]
    code_of: dict[str, int] = defaultdict(count().__next__)
    codes, words_in, word_chars = [np.zeros(0, np.int64)], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, part in slices:
        words = words_of(part)
        codes.append(np.fromiter(map(code_of.__getitem__, words), np.int64, len(words)))
        words_in[k] += len(words)
        word_chars[k] += sum(map(len, words))
    tokens, pieces = vocab.encode([part for _, part in slices])
    home = np.array([k for k, _ in slices], np.int64)
    of_token = np.repeat(home, [len(x) for x in tokens])
    of_piece = np.repeat(home, [len(x) for x in pieces])
    key, times = np.unique(of_token * np.int64(vocab.n_vocab) + np.concatenate([np.zeros(0, np.int64), *tokens]).astype(np.int64), return_counts=True)
    owner, bpe_tokens = key // vocab.n_vocab, np.bincount(of_token, minlength=n)
    share = times / bpe_tokens[owner]
    return pd.DataFrame({
        "n_words": words_in,
        "word_chars": word_chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [dup_lines(t) for t in texts],
        "n_repeat_words": repeat_words(np.concatenate(codes), np.repeat(np.arange(n), words_in), n),
        "bpe_tokens": bpe_tokens,
        "piece_tokens": np.bincount(of_piece, minlength=n),
        "fallback_tokens": np.bincount(of_piece, vocab.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, len(of_piece))], n).astype(np.int64),
        "entropy": np.bincount(owner, -share * np.log2(share), n),
        "n_chars": [len(t) for t in texts],
        "script": [script_of(t) for t in texts],
    })


def script_of(text: str) -> str:
    """The script that most letters of the whole text belong to; ``other`` where no known one has any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(SCRIPT_OF[np.minimum(points, 0x30000)], minlength=len(SCRIPT_NAMES))
    counts[0] = 0
    return SCRIPT_NAMES[int(counts.argmax())]


def measures(text: Column, bpe_path: str, piece_path: str) -> Column:
    @F.pandas_udf(f"{FIELDS}, n_chars bigint, script string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabularies(bpe_path, piece_path)
        for texts in batches:
            yield measure(texts.to_list(), vocab).set_index(texts.index)

    return udf(text)


def bands(distinct: DataFrame, deviations: float) -> DataFrame:
    """``(band, script, length, low_*, high_*)`` for each such combination of ``distinct``: the edges of every measure.

    One histogram per band, script, length class and measure is summed up to
    four groupings: band and length; band; script; everything.  The first of
    them that holds ``TRUSTED`` texts gives the edges, else everything does.
    """
    measure = [F.struct(F.lit(m).alias("m"), F.floor(F.col(m) / step).alias("bin")) for m, step, _, _ in BANDED]
    cells = distinct.select("band", "script", "length", F.explode(F.array(*measure)).alias("x")).where("x.bin IS NOT NULL")
    cells = cut(cells.groupBy("band", "script", "length", "x.m", "x.bin").agg(F.count(F.lit(1)).alias("n")))
    edges = cells.select("band", "script", "length").distinct()
    steps = F.create_map(*[F.lit(v) for m, step, _, _ in BANDED for v in (m, step)])
    least = F.create_map(*[F.lit(v) for m, _, least, _ in BANDED for v in (m, least)])
    levels = [["band", "length"], ["band"], ["script"], []]
    for k, keys in enumerate(levels):
        whole = W.partitionBy(*keys, "m")
        sums = cells.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
        upto = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) + 0.5) * F.element_at(steps, F.col("m"))
        found = sums.groupBy(*keys, "m").agg(upto(0.125).alias("q1"), upto(0.5).alias("q2"), upto(0.875).alias("q3"), F.max("total").alias("total"))
        side = lambda d: deviations * F.greatest(d / EIGHTH, F.element_at(least, F.col("m")))
        band = F.struct((F.col("q2") - side(F.col("q2") - F.col("q1"))).alias("low"), (F.col("q2") + side(F.col("q3") - F.col("q2"))).alias("high"))
        if k < len(levels) - 1:
            found = found.where(F.col("total") >= TRUSTED)
        found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("m") == m, band)).alias(f"{m}_{k}") for m, _, _, _ in BANDED])
        edges = edges.join(found, keys, "left") if keys else edges.crossJoin(F.broadcast(found))  # one row
    chosen = lambda m: F.coalesce(*[F.col(f"{m}_{k}") for k in range(len(levels))])
    return edges.select("band", "script", "length", *[chosen(m).alias(f"edges_{m}") for m, _, _, _ in BANDED])


def rate_fertility(
    docs: DataFrame, bpe_path: str | None = None, piece_path: str | None = None, min_words: int = 20, max_repeat_percent: int = 30, deviations: float = BAND_DEVIATIONS
) -> DataFrame:
    """``(doc_id, FIELDS, base_failed, band, bpe_chars_per_token, piece_chars_per_token, fallback_share, entropy_gap, kept)``, a row per row of ``docs``.

    Words are runs without ``[\\x20\\x09-\\x0D]``; a null text counts as empty
    and has none.  ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of the words in repeated windows of eight.  ``band``
    is ``lang``, or the script of most letters where ``lang`` is null or
    missing.  Distinct texts that pass the base rules make the bands, by powers
    of two of the number of words: the median, and on each side ``deviations``
    standard deviations as the value that an eighth lies beyond shows them.  Groups of fewer than
    ``TRUSTED`` texts are judged by the band of the next wider group: the
    language at any length, the script, everything.  Up to ``SPARED_TOKENS``
    fallback tokens reject nobody.  A value on a band's edge is inside.

    Whole texts are encoded; texts beyond ``SLICE_CHARS`` in parts cut at white
    space.  Repeated rows and ids are judged row by row; an empty table gives no
    rows; further columns of ``docs``, whatever their names, are ignored.
    """
    bpe_path = bpe_path or public_tokenizers.path(BPE_FILE)
    piece_path = piece_path or public_tokenizers.path(PIECE_FILE)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), F.xxhash64("text").alias("_text"), measures(F.col("text"), bpe_path, piece_path).alias("m"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    rows = cut(
        rows.select("doc_id", "lang", "_text", "m.*")
        .withColumn("band", F.coalesce("lang", F.concat(F.lit("script:"), "script")))
        .withColumn("length", F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))).cast("int"))
        .withColumn("base_failed", failed)
        .withColumn("bpe_chars_per_token", ratio("n_chars", "bpe_tokens"))
        .withColumn("piece_chars_per_token", ratio("n_chars", "piece_tokens"))
        .withColumn("fallback_share", F.coalesce(ratio("fallback_tokens", "piece_tokens"), F.lit(0.0)))
        .withColumn("entropy_gap", F.col("entropy") - F.least(F.log2(F.greatest("bpe_tokens", F.lit(1)).cast("double")), F.lit(9.0)))
    )
    names = [m for m, _, _, _ in BANDED]
    distinct = rows.where(~F.col("base_failed")).groupBy("band", "script", "length", "_text").agg(*[F.min(m).alias(m) for m in names])
    edges = cut(bands(distinct, deviations))
    edges = F.broadcast(edges) if edges.count() <= BROADCAST_ROWS else edges  # one row a language, script and length class
    outside = F.lit(False)
    for name, _, _, both in BANDED:
        edge, value = F.col(f"edges_{name}"), F.col(name)
        high = value > edge["high"] if both else (value > edge["high"]) & (F.col("fallback_tokens") > SPARED_TOKENS)
        outside = outside | F.coalesce(high | (value < edge["low"]) if both else high, F.lit(False))
    judged = rows.join(edges, ["band", "script", "length"], "left").withColumn("kept", ~F.col("base_failed") & ~outside)
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    return judged.select("doc_id", *fields, "base_failed", "band", *names, "kept")


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate_fertility(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rated.select(*base, "band", "bpe_chars_per_token", "piece_chars_per_token", "fallback_share", "entropy", "entropy_gap", "fallback_tokens")


QUERIES = {"op1_tokeniser_fertility": op1_tokeniser_fertility}
ORACLES: dict[str, str] = {}
