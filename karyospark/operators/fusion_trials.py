"""The fusion null in batches: scaffold codes are permuted in arrays, and only a trial's metrics leave the task.

``fusion.fusion_null`` is the same null as one set of joins over all trials; it
needs every ortholog once a trial.  Here each batch of trials gets the table
once, as codes and positions, and counts tuples, their ranges and the mixed
pairs of each trial in numpy.

Of larger tables no trial sees all orthologs.  Orthologs that share the three
scaffolds that stay are cut into chunks; a trial draws how many of each dealt
scaffold a chunk gets, and each chunk deals them to the orthologs at the ends of
its position ranges, to the others only where an end is still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import LEAST_COUNT, METRICS, placed, placed_null
from .hits import number_rows
from .lineage import cut
from .permute import DRAWN_ROWS, DRAWN_TUPLES, draw_counts

#: Orthologs that a task may hold (some hundred bytes each); larger tables go through ``fusion_null``.
BATCH_ROWS = 2_000_000
#: Orthologs from which on trials that need not follow hash ranks draw counts by chunk, and those of one chunk.
CHUNKED_ROWS, CHUNK = 500_000, 1 << 17
#: Trials whose counts lie in one row, and numbers that a task holds for them.
BLOCK_TRIALS, BLOCK_NUMBERS = 32, 1 << 22
#: Tuples that are counted in an array, however few orthologs there are, or as many times the orthologs.
DENSE, DENSE_SHARE = 1 << 22, 4
SCHEMA = "permuted string, trial bigint, hyp string, max_single bigint, max_grouping bigint, total bigint, n_groupings bigint, mean double"


def _within(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of equal sorted keys."""
    at, step, left, right = np.arange(len(key)), 1, [], []
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        left.append(at)
        right.append(at + step)
        step += 1
    return np.concatenate(left or [at]), np.concatenate(right or [at])


def mixed_rows(sister: np.ndarray, pair: np.ndarray, og: np.ndarray, count: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, pair)``: tuples that take part in mixed pairs of one (B, C), found as by ``fusion.hypothesis``.

    ``pair`` codes the scaffolds of B and C; ``spans`` are lowest and highest positions there.
    """
    _, pair, size = np.unique(pair, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(size[pair] >= 2)
    both = pair[rows] * (int(og.max(initial=0)) + 1) + og[rows]
    times = lambda key: np.unique(key, return_inverse=True, return_counts=True)
    _, at, n = times(both)
    dup = n[at] > 1
    p, a = pair[rows], sister[rows]
    dups, singles = (np.bincount(p[x], minlength=len(size)) for x in (dup, ~dup))
    single_a = np.full(len(size), -1)
    single_a[p[~dup]] = a[~dup]
    doubtful = dup & (dups[p] > 1) & ((singles[p] > 1) | ((singles[p] == 1) & (a == single_a[p])))
    rows, both = rows[~doubtful], both[~doubtful]
    _, at, n = times(both)
    rows = rows[n[at] == 1]
    rows = rows[np.argsort(pair[rows], kind="stable")]
    i, j = (rows[x] for x in _within(pair[rows]))
    most, least = np.maximum(count[i], count[j]), np.minimum(count[i], count[j])
    overlap = reduce(np.logical_or, [np.maximum(lo[i], lo[j]) <= np.minimum(hi[i], hi[j]) for lo, hi in spans])
    fits = (sister[i] != sister[j]) & ~((most > 7 * least) & (least <= 10)) & overlap
    rows = np.unique(np.concatenate([i[fits], j[fits]]))
    return rows, pair[rows]


class Trials:
    """Orthologs of an outgroup and three species as ``codes`` and ``pos`` (a row a species), by rising id."""

    def __init__(self, codes: np.ndarray, pos: np.ndarray, least: int):
        self.kinds = codes.max(axis=1, initial=0) + 1
        self.codes = codes.astype(np.min_scalar_type(int(self.kinds.max(initial=1))))
        self.least = least
        self.along = [np.argsort(p, kind="stable").astype(np.int32) for p in pos]
        self.pos = [p[order] for p, order in zip(pos, self.along, strict=True)]
        self.cells: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

    def _cells(self, column: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tuples of the other species' codes, and each row's first key of its tuple: by id, then along each species."""
        if column not in self.cells:
            kept, cell = np.unique(np.delete(self.codes, column, axis=0), axis=1, return_inverse=True)
            base = cell.ravel() * self.kinds[column]
            base = base.astype(np.int32 if kept.shape[1] * self.kinds[column] < 1 << 31 else np.int64)
            self.cells[column] = kept, [base, *(base[order] for order in self.along)]
        return self.cells[column]

    def groups(self, column: int, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Codes, counts and position ranges (not of the outgroup) of the tuples with at least ``least`` orthologs, with ``dealt`` as the codes of ``column``."""
        kept, bases = self._cells(column)
        kinds = self.kinds[column]
        key, size = bases[0] + dealt, kept.shape[1] * kinds
        dense = size <= max(DENSE, DENSE_SHARE * len(key))
        if dense:
            names, counts = None, np.bincount(key, minlength=size)
        else:
            names, counts = np.unique(key, return_counts=True)
        large = np.flatnonzero(counts >= self.least)
        place = np.full(len(counts), len(large), np.int32)
        place[large] = np.arange(len(large))
        count, large = counts[large], large if dense else names[large]
        codes = np.insert(kept[:, large // kinds].astype(np.int64), column, large % kinds, axis=0)
        spans = [(count, count)]
        for base, order, pos in zip(bases[2:], self.along[1:], self.pos[1:], strict=True):
            key = base + dealt[order]
            where = place[key] if dense else place[np.searchsorted(names, key)]
            lo, hi = np.zeros((2, len(large) + 1), np.int64)
            hi[where] = pos  # the last of equal places stays
            lo[where[::-1]] = pos[::-1]
            spans.append((lo[:-1], hi[:-1]))
        return codes, count, spans

    def metrics(self, column: int, dealt: np.ndarray) -> list[tuple]:
        """``METRICS`` of each hypothesis, zeros where nothing supports it."""
        return tuple_metrics(self.kinds, *self.groups(column, dealt))


def tuple_metrics(kinds: np.ndarray, codes: np.ndarray, count: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """``METRICS`` of each hypothesis from codes, counts and position ranges of tuples, zeros where nothing supports it."""
    out = []
    for a in (1, 2, 3):
        b, c = (s for s in (1, 2, 3) if s != a)
        rows, pair = mixed_rows(codes[a], codes[b] * kinds[c] + codes[c], codes[0], count, [spans[b], spans[c]])
        if not len(rows):
            out.append((0, 0, 0, 0, 0.0))
            continue
        sums = np.bincount(pair, weights=count[rows])
        total = int(count[rows].sum())
        out.append((int(count[rows].max()), int(sums.max()), total, len(np.unique(pair)), total / len(rows)))
    return out


class Chunk:
    """Orthologs whose codes are dealt among them, given by their positions ``pos`` (a row a species)."""

    def __init__(self, pos: np.ndarray, reach: int):
        self.pos, self.n = pos, pos.shape[1]
        self.along = [np.argsort(p, kind="stable") for p in pos]
        ends = [x for o in self.along for x in (o[:reach], o[-reach:])]
        border = np.unique(np.concatenate(ends))
        self.border = border if 2 * len(border) < self.n else np.arange(self.n)
        self.rest = np.setdiff1d(np.arange(self.n), self.border, assume_unique=True)
        self.ends = [(np.searchsorted(self.border, x), p[x]) for p, lo, hi in zip(pos, ends[::2], ends[1::2], strict=True) for x in (lo, hi)]

    def spans(self, rng: np.random.Generator, counts: np.ndarray) -> np.ndarray:
        """Lowest and highest positions of each code (a row for each end of each species), of codes that occur ``counts`` times."""
        kinds, share = np.arange(len(counts)), counts
        if len(self.rest):
            share = rng.multivariate_hypergeometric(counts, len(self.border), method="marginals")
        dealt = rng.permutation(np.repeat(kinds, share))
        out, found = np.zeros((len(self.ends), len(counts)), np.int64), np.zeros((len(self.ends), len(counts)), bool)
        for k, (at, pos) in enumerate(self.ends):
            code = dealt[at]
            found[k, code] = True
            if k % 2:
                out[k, code] = pos  # the last of equal places stays
            else:
                out[k, code[::-1]] = pos[::-1]
        if (found | (counts == 0)).all():
            return out
        whole = np.empty(self.n, np.int64)
        whole[self.border] = dealt
        whole[self.rest] = rng.permutation(np.repeat(kinds, counts - share))
        for k, (p, order) in enumerate(zip(self.pos, self.along, strict=True)):
            code, place = whole[order], p[order]
            out[2 * k, code[::-1]] = place[::-1]
            out[2 * k + 1, code] = place
        return out


def merged(rows: np.ndarray) -> np.ndarray:
    """``rows`` (columns of key, count, lowest and highest places in turn), one a key: counts added up, ranges joined."""
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    at = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]][: rows.shape[1]])
    join = [np.minimum if k % 2 == 0 else np.maximum for k in range(len(rows) - 2)]
    return np.stack([rows[0, at], np.add.reduceat(rows[1], at), *(f.reduceat(r, at) for f, r in zip(join, rows[2:], strict=True))]) if len(at) else rows


def dealt_by_hash(values: np.ndarray, ids: list[str], trial: int) -> np.ndarray:
    """One trial of ``groups.shuffle_column``: the k-th row by hash gets the value of the k-th by id."""
    keys = np.array([hashlib.md5(f"{trial}:{i}".encode()).hexdigest() for i in ids], "S32")
    out = np.empty_like(values)
    out[np.argsort(keys, kind="stable")] = values
    return out


def _coded(rbh: DataFrame, species: list[str]) -> DataFrame:
    """``(number, rbh, c0.., p0..)``: rows by rising id, scaffolds as numbers."""
    rows = rbh
    for k, s in enumerate(species):
        names = number_rows(rbh.select(f"{s}_scaf").distinct(), [f"{s}_scaf"], f"c{k}")
        rows = rows.join(names, f"{s}_scaf")
    columns = [*[(F.col(f"c{k}") - 1).alias(f"c{k}") for k in range(4)], *[F.col(f"{s}_pos").cast("bigint").alias(f"p{k}") for k, s in enumerate(species)]]
    return number_rows(rows.select("rbh", *columns), ["rbh"])


def _packed(ids: bool):
    """Rows of each Arrow batch as one row of bytes, and their ids where wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([batch.column(0).to_pylist() if ids else []], pa.list_(pa.string()))], ["packed", "ids"])

    return run


def _trials(species: list[str], permuted: list[str], first: int, trials: int, jobs: int, seed: int, ranked: bool, least: int):
    def work(job: int, parts: list[np.ndarray], ids: list[str]) -> pa.RecordBatch:
        table = np.concatenate(parts, axis=1)
        order = np.argsort(table[0])
        table, ids = table[:, order], [ids[k] for k in order] if ids else ids
        held = Trials(table[1:5], table[5:9], least)
        rows = []
        for n in range(job, trials * len(permuted), jobs):
            s, trial = permuted[n % len(permuted)], first + n // len(permuted)
            k = species.index(s)
            values = held.codes[k]
            dealt = dealt_by_hash(values, ids, trial) if ranked else np.random.default_rng([seed, k, trial]).permutation(values)
            rows += [(s, trial, hyp, *m) for hyp, m in zip(species[1:], held.metrics(k, dealt), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["permuted", "trial", "hyp", *METRICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, ids = None, [], []
        for batch in batches:
            for job, packed, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if job != current and parts:
                    yield work(current, parts, ids)
                    parts, ids = [], []
                current = job
                parts.append(np.frombuffer(packed, np.int64).reshape(9, -1))
                ids += names
        if parts:
            yield work(current, parts, ids)

    return run


CELL = ["c0", "c1", "c2", "c3"]


def _drawn(rbh: DataFrame, species: list[str], permuted: list[str], trials: int, first: int, seed: int, least: int) -> DataFrame | None:
    """``fusion_null_batches`` of drawn trials from counts by chunk; None where there are too many tuples to draw for."""
    spark, ks = rbh.sparkSession, [species.index(s) for s in permuted]
    margins, rows = [], rbh
    for k, s in enumerate(species):
        names = cut(number_rows(rbh.groupBy(f"{s}_scaf").agg(F.count(F.lit(1)).alias("n")), [f"{s}_scaf"], f"c{k}"))
        margins.append(names.select("n", (F.col(f"c{k}") - 1).alias("c")))
        rows = rows.join(names.select(f"{s}_scaf", (F.col(f"c{k}") - 1).alias(f"c{k}")), f"{s}_scaf")
    kinds = [m.count() for m in margins]
    rows = cut(rows.select(F.xxhash64("rbh").alias("_hash"), *CELL, *[F.col(f"{s}_pos").cast("bigint").alias(f"p{k}") for k, s in enumerate(species) if k]))
    # the dealt species' own code leaves the row: what stays is a cell
    stay = [F.struct(F.lit(k).alias("k"), *[(F.lit(-1).cast("bigint") if c == f"c{k}" else F.col(c)).alias(c) for c in CELL]) for k in ks]
    rows = rows.select("_hash", "p1", "p2", "p3", F.inline(F.array(*stay)))
    cells = cut(rows.groupBy("k", *CELL).agg(F.count(F.lit(1)).alias("n")))
    if max(kinds) * cells.count() > DRAWN_TUPLES:
        return None
    parts = F.ceil(F.col("n") / CHUNK)
    rows = rows.join(cells.withColumn("_parts", parts).drop("n"), ["k", *CELL]).withColumn("part", F.pmod("_hash", "_parts")).drop("_hash", "_parts")
    keys = ["k", *CELL, "part"]
    chunks = number_rows(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "chunk")
    chunks = cut(chunks)
    sizes = {k: ([], []) for k in ks}
    for r in chunks.select("k", "chunk", "n").orderBy("chunk").collect():  # numbers only, DRAWN_TUPLES and one a CHUNK at most
        sizes[r.k][0].append(r.chunk)
        sizes[r.k][1].append(r.n)
    margin = {k: np.array([r.n for r in margins[k].orderBy("c").select("n").collect()], np.int64) for k in ks}
    long = max(1, min(BLOCK_TRIALS, trials, BLOCK_NUMBERS // max(len(sizes[k][0]) * kinds[k] for k in ks)))
    block_of = lambda b: (first + b * long, min(first + trials, first + (b + 1) * long))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column(0).to_pylist():
                k, block = ks[job % len(ks)], job // len(ks)
                names, size = sizes[k][0], np.array(sizes[k][1], np.int64)
                start, stop = block_of(block)
                table = np.zeros((len(size), stop - start, kinds[k]), np.int64)
                for t in range(start, stop):
                    (row, col), n = draw_counts(np.random.default_rng([seed, k, t]), [size, margin[k]])
                    table[row, t - start, col] = n
                for at in range(0, len(names), 1000):
                    some = table[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 1000], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([x.tobytes() for x in some], pa.binary())], ["chunk", "block", "counts"])

    reach = {k: int(np.ceil(14 * margin[k].sum() / margin[k].min())) for k in ks}  # an end stays open once in a million for the rarest

    def deal(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(drawn):
            return pd.DataFrame({"k": [], "block": [], "tuples": []})
        k, chunk = int(rows.k.iloc[0]), int(drawn.chunk.iloc[0])
        places = rows[["p1", "p2", "p3"]].to_numpy(np.int64)
        places = places[np.lexsort(places.T)]  # however the rows arrive
        held, cell = Chunk(np.ascontiguousarray(places.T), reach[k]), rows[CELL].iloc[0].to_numpy(np.int64)
        out = []
        for block, counts in zip(drawn.block.tolist(), drawn.counts, strict=True):
            start, _ = block_of(block)
            found = []
            for t, n in enumerate(np.frombuffer(counts, np.int64).reshape(-1, kinds[k]), start):
                at = np.flatnonzero(n)
                spans = held.spans(np.random.default_rng([seed, k, t, chunk]), n)[:, at]
                codes = np.repeat(cell[:, None], len(at), axis=1)
                codes[k] = at
                found.append(np.vstack([np.full(len(at), t), codes, n[at], spans]))
            out.append((k, block, np.concatenate(found, axis=1).tobytes()))
        return pd.DataFrame(out, columns=["k", "block", "tuples"])

    def judge(parts: pd.DataFrame) -> pd.DataFrame:
        k = int(parts.k.iloc[0])
        tuples = np.concatenate([np.frombuffer(x, np.int64).reshape(12, -1) for x in parts.tuples], axis=1)
        radix, out = np.array(kinds), []
        tuples = tuples[:, np.argsort(tuples[0], kind="stable")]
        for own in np.split(tuples, np.flatnonzero(np.diff(tuples[0])) + 1, axis=1):
            key = np.ravel_multi_index(tuple(own[1:5]), radix)
            one = merged(np.vstack([key, own[5:]]))
            one = one[:, one[1] >= least]
            codes = np.array(np.unravel_index(one[0], radix))
            spans = [(one[1], one[1]), *((one[j], one[j + 1]) for j in (2, 4, 6))]
            out += [(species[k], int(own[0, 0]), hyp, *m) for hyp, m in zip(species[1:], tuple_metrics(radix, codes, one[1], spans), strict=True)]
        return pd.DataFrame(out, columns=["permuted", "trial", "hyp", *METRICS])

    jobs = len(ks) * -(-trials // long)
    drawn = spark.range(0, jobs, 1, jobs).mapInArrow(draw, "chunk bigint, block bigint, counts binary").join(chunks.select("chunk", *keys), "chunk")
    dealt = rows.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInPandas(deal, "k int, block bigint, tuples binary")
    return dealt.groupBy("k", "block").applyInPandas(judge, SCHEMA)


def fusion_null_batches(rbh: DataFrame, species: list[str], permuted: list[str], trials: int, first: int = 0, seed: int = 0, ranked: bool = False, least: int = LEAST_COUNT) -> DataFrame:
    """``(permuted, trial, hyp, METRICS)``: the fusion metrics with one species' scaffolds permuted, for each of ``permuted``.

    Trial t has its own seed, so runs over ``first`` to ``first + trials - 1``
    are put together by a union.  ``ranked`` permutes as ``fusion_null`` does.
    Rows without a scaffold or position take no part.  From ``CHUNKED_ROWS``
    orthologs on, trials that are not ``ranked`` are drawn by chunk, equally
    likely but other ones.  Tables of more than ``BATCH_ROWS`` orthologs that
    are ``ranked``, or have too many tuples for that, go through
    ``fusion_null``, one species after the other, with its permutations of
    trials 0 and up.
    """
    spark = rbh.sparkSession
    rbh = rbh.select("rbh", *[f"{s}_{c}" for s in species for c in ("scaf", "pos")]).dropna()
    n = rbh.count()
    if not ranked and CHUNKED_ROWS <= n < DRAWN_ROWS and (drawn := _drawn(rbh, species, permuted, trials, first, seed, least)) is not None:
        return drawn
    if n > BATCH_ROWS:
        by_id = placed(rbh, species)
        nulls = [placed_null(by_id, species, s, first + trials).where(F.col("trial") >= first).withColumn("permuted", F.lit(s)) for s in permuted]
        columns = ["permuted", F.col("trial").cast("bigint").alias("trial"), "hyp", *METRICS]
        return reduce(DataFrame.unionByName, [n.select(*columns) for n in nulls])
    jobs = max(1, min(trials * len(permuted), 3 * spark.sparkContext.defaultParallelism))
    rows = _coded(rbh, species).select("rbh", "number", *[f"{x}{k}" for x in "cp" for k in range(4)])
    packed = cut(rows.mapInArrow(_packed(ranked), "packed binary, ids array<string>"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(jobs - 1))).alias("job"), "packed", "ids")
    dealt = sent.repartitionByRange(jobs, "job").sortWithinPartitions("job")
    return dealt.mapInArrow(_trials(species, permuted, first, trials, jobs, seed, ranked, least), SCHEMA)
