"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document.  Only the
counts of vote patterns leave the executors (at most 3 ** labellers of them);
expectation-maximisation over those counts estimates how each labeller votes on
good and on bad documents, and so a posterior for every pattern.  Posteriors
are the soft labels of a bounded sample of documents, on which a linear scorer
over hashed words and word shapes is trained; the scorer judges all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice, repeat
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import words_of

# Frequent short words of the languages that the stop-word labeller knows.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we "
    "de la le les et des un une du que qui dans pour par sur est pas au en aux ce se "
    "el los las y del con no su para es al lo como más una "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an"
).split()
SYMBOLS = "#*$%&|<>"

#: Bound of the rows that train the scorer, and the size of its weight table.
SAMPLE_ROWS = 4000
DIMS = 1 << 16
SCALE = 10.0
STEPS = 120
MEMO_WORDS = 300_000
THRESHOLD = 0.5


def _band(x: float, good: float, bad: float) -> int:
    """1 up to ``good``, -1 from ``bad`` on, 0 between."""
    return 1 if x <= good else -1 if x >= bad else 0


class Tally:
    """What the labellers look at, counted once per text that has words."""

    __slots__ = ("bangs", "counts", "echoes", "longest", "n", "odd_ends", "text", "top", "upper")

    def __init__(self, text: str, words: list[str]):
        self.text, self.n = text, len(words)
        self.counts = Counter(words)
        self.top = max(self.counts.values())
        self.upper = self.bangs = self.odd_ends = 0
        for w, k in self.counts.items():
            end = w[-1]
            if end == "!" and w.endswith("!!"):
                self.bangs += k
            if end not in ENDS and not end.isalnum():
                self.odd_ends += k
            if w.isupper() and len(w) > 1:
                self.upper += k
        self.echoes = sum(map(eq, words, islice(words, 1, None)))
        self.longest = max(sum(1 for _ in g) for _, g in groupby(words)) if self.echoes > 2 else self.echoes + 1


#: Fixed value: marks that may end a word.
ENDS = ".,;:!?\"')]»”’…-"


def _upper_share(t):
    return _band(t.upper / t.n, 0.1, 0.4)


def _symbol_share(t):
    return _band(sum(map(t.text.count, SYMBOLS)) / len(t.text), 0.01, 0.06)


def _bang_share(t):
    return _band(t.bangs / t.n, 0.02, 0.1)


def _bar_share(t):
    return _band(t.counts.get("|", 0) / t.n, 0.03, 0.2)


def _top_word_share(t):
    return 1 if t.n < 20 else _band(t.top / t.n, 0.15, 0.3)


def _echo_share(t):
    return 1 if t.n < 8 else _band(t.echoes / t.n, 0.1, 0.3)


def _longest_run(t):
    return _band(t.longest, 3, 6)


def _stop_words(t):
    if t.n < 20:
        return 1
    share = sum(map(t.counts.get, STOP_FORMS, repeat(0))) / t.n
    return 1 if share >= 0.1 and share <= 0.7 else -1 if share < 0.02 else 0


def _distinct_words(t):
    return 1 if t.n < 20 else _band(-len(t.counts) / t.n**0.5, -3.0, -1.5)


def _odd_ends(t):
    return _band(t.odd_ends / t.n, 0.05, 0.25)


STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
LABELLERS = [_upper_share, _symbol_share, _bang_share, _bar_share, _top_word_share, _echo_share, _longest_run, _stop_words, _distinct_words, _odd_ends]


def pattern_of(tally: Tally | None) -> int:
    """All votes as one number in base 3; without words everybody abstains."""
    if tally is None:
        return sum(3**k for k in range(len(LABELLERS)))
    return sum((f(tally) + 1) * 3**k for k, f in enumerate(LABELLERS))


def tally_of(text: str | None) -> Tally | None:
    words = words_of(text)
    return Tally(text, words) if words else None


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """``(posterior of good by pattern, P(vote | class) by labeller, prior of good)`` by EM over pattern counts."""
    votes = votes_of(patterns)
    good = np.where((votes < 0).any(1), 0.1, 0.9)  # at first, any vote against counts
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.02, 0.98)
        tables = np.stack([[[w[votes[:, k] == v].sum() + 1 for v in (-1, 0, 1)] for k in range(votes.shape[1])] for w in weight])
        tables = tables / tables.sum(2, keepdims=True)
        logs = np.log(tables)[:, np.arange(votes.shape[1])[None, :], votes + 1].sum(2)
        gap = np.clip(np.log(1 - prior) + logs[0] - np.log(prior) - logs[1], -500, 500)
        new = 1 / (1 + np.exp(gap))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, tables, float(prior)


MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def word_shape(word: str) -> str:
    """The case of a word without the ASCII marks at its end, and those marks."""
    core = word.rstrip(MARKS)
    case = "x" if core.islower() else "X" if core.isupper() else "Xx" if core.istitle() else "mixed"
    return f"{case}{'' if core.isalpha() else '0'}{word[len(core):][:8]}"


class Features:
    """Hashed places of a word and of its shape; shapes are few and remembered."""

    def __init__(self, dims: int):
        self.dims, self.shapes = dims, {}

    def place(self, name: str) -> int:
        return xxhash.xxh64_intdigest(name.encode()) % self.dims

    def places(self, word: str) -> tuple[int, int]:
        shape = word_shape(word)
        if (found := self.shapes.get(shape)) is None:
            if len(self.shapes) > MEMO_WORDS:
                self.shapes.clear()
            found = self.shapes[shape] = self.place(f"shape {shape}")
        return self.place(word.lower()), found


@dataclass
class Model:
    posterior: dict[int, float]
    accuracies: np.ndarray
    prior: float
    weights: np.ndarray
    bias: float


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps on ``(places, shares, posterior)``; both classes weigh alike."""
    if not rows:
        return np.zeros(dims, np.float32), 0.0
    place = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]) * SCALE
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, place = np.unique(place, return_inverse=True)
    y = np.array([r[2] for r in rows])
    share = np.clip(y.mean(), 0.02, 0.98)
    balance = y / share + (1 - y) / (1 - share)
    w, b, seen, seen_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, value * w[place], len(rows)) + b
        off = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        g = np.bincount(place, value * off[owner], len(used)) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
        seen_b += off.sum() ** 2
        b -= 0.5 * off.sum() / np.sqrt(seen_b)
    out = np.zeros(dims, np.float32)
    out[used] = w
    return out, float(b)


def _document_features(t: Tally, features: Features) -> list[tuple[int, float]]:
    """Hashed places and values of what single words don't show: echoes, the top word and the lack of distinct words."""
    values = [("echo", t.echoes / t.n), ("top", t.top / t.n if t.n >= 20 else 0.0), ("same", max(0.0, 1 - len(t.counts) / (3 * t.n**0.5)))]
    return [(features.place(f"document {name}"), v) for name, v in values]


def _pattern_column(text):
    @F.pandas_udf("int")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pattern_of(tally_of(t)) for t in texts], index=texts.index, dtype="int32")

    return udf(text)


def _sample_features(text, dims: int):
    @F.pandas_udf("pattern int, places array<int>, shares array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(dims)
        for texts in batches:
            rows = []
            for text in texts:
                t, share = tally_of(text), Counter()
                for w, k in t.counts.items() if t else ():
                    for p in features.places(w):
                        share[p] += k / t.n
                for p, v in _document_features(t, features) if t else ():
                    share[p] += v
                rows.append((pattern_of(t), list(share), list(share.values())))
            yield pd.DataFrame(rows, columns=["pattern", "places", "shares"], index=texts.index)

    return udf(text)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dims: int = DIMS) -> Model:
    """The label model over all documents, and the scorer over ``sample_rows`` of them at most.

    The sample is the documents with the least hashes of ``doc_id`` and text.
    """
    found = docs.select(_pattern_column(F.col("text")).alias("pattern")).groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    found.sort()
    patterns, counts = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
    good, tables, prior = label_model(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 1)
    share = min(1.0, 2 * sample_rows / max(1, int(counts.sum())))
    near = docs.select("text", place.alias("place"), F.col("doc_id").alias("id")).where(F.col("place") <= min((1 << 63) - 1, int(share * 2.0**63)))
    picked = near.orderBy("place", "id").limit(sample_rows)  # about 2 * sample_rows rows come together, and repeated ones
    rows = [(np.array(r[1], np.int64), np.array(r[2]), posterior.get(r[0], prior)) for r in picked.select(_sample_features(F.col("text"), dims).alias("f")).select("f.*").collect()]
    weights, bias = train_scorer([r for r in rows if len(r[0])], dims)
    return Model(posterior, tables, prior, weights, bias)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``vote_pattern``, ``posterior``, ``score`` (0 to 1) and ``kept``.

    Whole texts are scored.  Null, empty and blank texts score 0 and are not
    kept.  Repeated rows get equal scores.  Input columns of the four names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dims floats and the patterns' posteriors

    @F.pandas_udf("vote_pattern int, posterior double, score double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        features, weight, w = Features(len(m.weights)), {}, m.weights
        for texts in batches:
            rows = []
            for text in texts:
                t = tally_of(text)
                pattern = pattern_of(t)
                if t is None:
                    rows.append((pattern, m.posterior.get(pattern, m.prior), 0.0, False))
                    continue
                z = 0.0
                for word, k in t.counts.items():
                    v = weight.get(word)
                    if v is None:
                        if len(weight) > MEMO_WORDS:
                            weight.clear()
                        i, j = features.places(word)
                        v = weight[word] = float(w[i]) + float(w[j])
                    z += k * v
                z = z / t.n + sum(v * float(w[p]) for p, v in _document_features(t, features))
                score = 1 / (1 + math.exp(-min(max(m.bias + SCALE * z, -500.0), 500.0)))
                rows.append((pattern, m.posterior.get(pattern, m.prior), score, score >= threshold))
            yield pd.DataFrame(rows, columns=["vote_pattern", "posterior", "score", "kept"], index=texts.index)

    names = [c for c in docs.columns if c not in ("vote_pattern", "posterior", "score", "kept")]
    return docs.select(F.struct(*names).alias("row"), judge("text").alias("judged")).select("row.*", "judged.*")


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, fit(docs)).select("doc_id", "vote_pattern", "posterior", "score", "kept")


QUERIES = {"op9_weak_label_quality": op9_weak_label_quality}
ORACLES: dict[str, str] = {}
