"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary's tokens.  A pre-token's
64-bit hash gives a place, the token at that place is compared byte by byte,
and a match is the whole answer.  Tier two, for pre-tokens that are no token:
the bytes form a doubly linked list, a heap holds the mergeable neighbours by
rank, and the best is merged until none is left; stale heap entries are skipped.
The pre-tokens of many texts are looked up together; each worker remembers two
generations of a bounded number of them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bits import MinimalPerfectHash

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a generation of the memo holds, and bounds of what is looked up together.
MEMO_PIECES = 150_000
PIECES_AT_ONCE = 1 << 18
BATCH_CHARS = 1 << 19
ROWS_AT_ONCE = 500


class Memo:
    """Ids by string: those in use, and of earlier ones the last one or two ``MEMO_PIECES``."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """What is not known yet; all else that is wanted is in ``young`` from here to the next call."""
        if len(self.young) > MEMO_PIECES:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old.get, []
        for x in wanted - young.keys():
            if (ids := old(x)) is None:
                new.append(x)
            else:
                young[x] = ids
        return new


class Codec:
    def __init__(self, path: str, pattern: str):
        lines = open(path, "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = dict(sorted((i, t) for t, i in ranks.items()))
        ordered = list(ranks)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ordered), np.uint64, len(ordered))
        self.mph = MinimalPerfectHash.build(hashes)
        self.slots: list[bytes] = [b""] * len(ordered)
        self.slot_ids = np.zeros(len(ordered), np.int64)
        for place, token in zip(self.mph.lookup(hashes).tolist(), ordered, strict=True):
            self.slots[place] = token
            self.slot_ids[place] = ranks[token]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.merges: list[dict[int, int]] = [{} for _ in range(max(self.tokens) + 1)]  # by left id: rank by right id
        for token, i in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    self.merges[left][right] = i
        self.byte_ranks = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.decimal = {i: str(i) for i in self.tokens}
        self.ids = {i: i for i in self.tokens}  # remembered pre-tokens share these
        self.single = {i: (i,) for i in self.tokens}
        self.pattern = regex.compile(pattern)
        self.memo = Memo()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token itself."""
        n, merges, push, pop = len(piece), self.merges, heapq.heappush, heapq.heappop
        ids = list(map(self.byte_ids.__getitem__, piece))
        of_bytes = self.byte_ranks
        ranks = [of_bytes[a << 8 | b] for a, b in pairwise(piece)]  # of each place with its right neighbour
        ranks.append(-1)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << shift | k for k, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            best = pop(heap)
            k, rank = best & mask, best >> shift
            if ranks[k] != rank:  # merged meanwhile
                continue
            right = after[k]
            end = after[k] = after[right]
            ids[k], ids[right], ranks[right] = rank, -1, -1
            if end < n:
                before[end] = k
                new = ranks[k] = merges[rank].get(ids[end], -1)
                if new >= 0:
                    push(heap, new << shift | k)
            else:
                ranks[k] = -1
            start = before[k]
            if start >= 0:
                new = ranks[start] = merges[ids[start]].get(rank, -1)
                if new >= 0:
                    push(heap, new << shift | start)
        whole = self.ids
        return tuple([whole[i] for i in ids if i >= 0])

    def forget(self) -> None:
        """Leaves the vocabulary only."""
        self.memo = Memo()

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids of these pre-tokens."""
        new = self.memo.missing(pieces)
        raw = list(map(str.encode, new))
        places = self.mph.lookup(np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)))
        memo, slots, ids = self.memo.young, self.slots, self.slot_ids[places].tolist() if new else []
        for piece, data, place, i in zip(new, raw, places.tolist(), ids, strict=True):
            memo[piece] = self.single[i] if place >= 0 and slots[place] == data else self.merge(data)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null and empty texts."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text; pre-tokens of about ``BATCH_CHARS`` characters are looked up together, of longer texts in parts."""
        held, chars = [], 0
        for text in texts:
            text = text or ""
            if chars + len(text) > BATCH_CHARS and held:
                yield from self._batch(held)
                held, chars = [], 0
            if len(text) > BATCH_CHARS:
                yield self._long(text)
            else:
                held.append(self.pattern.findall(text))
                chars += len(text)
        yield from self._batch(held)

    def _batch(self, found: list[list[str]]) -> Iterator[list[int]]:
        self.learn(set().union(*found))
        ids_of = self.memo.young.__getitem__
        return (list(chain.from_iterable(map(ids_of, pieces))) for pieces in found)

    def _long(self, text: str) -> list[int]:
        found = (m.group() for m in self.pattern.finditer(text))
        ids: list[int] = []
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            self.learn(set(pieces))
            ids += chain.from_iterable(map(self.memo.young.__getitem__, pieces))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    made = Codec(path, pattern)
    gc.freeze()  # the vocabulary stays, so the collector need not walk it again and again
    return made


def encode(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of each text as ``array<int>``; empty for null and empty texts."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("array<int>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for texts in batches:
            yield pd.Series([np.array(ids, np.int32) for ids in own.encode_all(texts)], index=texts.index, dtype=object)

    return udf(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes of each array of ids, as ``binary``; empty for null and empty arrays."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for arrays in batches:
            yield pd.Series([b"" if x is None else own.decode(x.tolist()) for x in arrays], index=arrays.index, dtype=object)

    return udf(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """``struct(n_tokens, ids_sha256, decoded_sha256)``: each text encoded and its ids decoded, in one worker."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = []
            for ids in own.encode_all(texts):
                rows.append((len(ids), sha(own.decimals(ids).encode()), sha(own.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=texts.index)

    return udf(text)


def encode_documents(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) of ``docs`` and ``token_ids array<int>``, ``n_tokens`` and ``decoded_sha256``, of the bytes that the ids give back.

    The whole text is cut by the public pattern and encoded without special
    tokens; very long texts go through in parts of bounded size, with the ids
    of the whole.  Null and empty texts have no ids, repeated rows come back as
    often, an empty table gives no rows, and input columns of the three new
    names are replaced.  ``ROWS_AT_ONCE`` rows are worked on at a time, however
    large the batches that Spark sends.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    new = "token_ids array<int>, n_tokens bigint, decoded_sha256 string"
    names = [c for c in keep or docs.columns if c not in ("token_ids", "n_tokens", "decoded_sha256")]
    sent = docs.select(F.col("text").cast("string").alias("_encoded"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                ids, digests = [], []
                for found in own.encode_all(part.column(0).to_pylist()):
                    ids.append(np.array(found, np.int32))
                    digests.append(hashlib.sha256(own.decode(found)).hexdigest())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                columns = [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(sizes), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", "n_tokens", "decoded_sha256"])
        own.forget()  # the next stage's work needs the room

    fields = [*sent.schema.fields[1:], *StructType.fromDDL(new).fields]
    return sent.mapInArrow(run, StructType(fields))


def op6_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")


QUERIES = {"op6_two_tier_bpe": op6_two_tier_bpe}
ORACLES: dict[str, str] = {}
