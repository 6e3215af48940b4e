"""Fill-in-the-middle documents by displacement scatter.

A text is cut at two token ends; the parts are put in another order behind
marks.  A batch of texts is one run of bytes.  A scan gives every token's end
and so the cuts; at each cut a difference array holds by how much more the
bytes behind it move, its cumulative sum is each byte's shift, and one numpy
scatter puts all bytes of the batch in place.  Going back, the marks are found
in the outputs, and the inverse gather takes every byte from where it stands.

Shifts are made for ``BLOCK_BYTES`` at a time, the sum carried from block to
block, so that a long text costs little more than itself and its output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text in one run (a longer text is a run of its own), and of one array of shifts.
RUN_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NEW = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data), mask)


def _shifts(edges: np.ndarray, steps: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(lo, hi, places)`` of blocks of 0 to n: each position plus all ``steps`` at rising ``edges`` up to it."""
    carry = 0
    for lo in range(0, n, BLOCK_BYTES):
        hi = min(n, lo + BLOCK_BYTES)
        a, b = np.searchsorted(edges, (lo, hi))
        shift = np.zeros(hi - lo, np.int64)
        np.add.at(shift, edges[a:b] - lo, steps[a:b])
        shift[0] += carry
        np.cumsum(shift, out=shift)
        carry = int(shift[-1])
        yield lo, hi, shift + np.arange(lo, hi)


def _steps(starts: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Difference array of segments (in order, for each text) that move from ``starts`` to ``targets``; empty ones add up with the next."""
    edges, shift = np.stack(starts, 1).ravel(), np.stack([t - s for s, t in zip(starts, targets, strict=True)], 1).ravel()
    return edges, np.diff(shift, prepend=0)


def _put(out: np.ndarray, at: np.ndarray, mark: bytes) -> None:
    out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)


def _marks(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where a mark begins in the bytes."""
    at = np.flatnonzero(data[: max(0, len(data) - 2)] == mark[0])
    return at[(data[at + 1] == mark[1]) & (data[at + 2] == mark[2])]


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a mark; bytes of neighbouring texts make none."""
    held = np.zeros(len(offsets) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = _marks(data, mark)
        text = np.searchsorted(offsets, at, side="right") - 1
        held[text[at + len(mark) <= offsets[text + 1]]] = True
    return held


def scatter(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], share: int, spm_share: int) -> tuple[np.ndarray, ...]:
    """``(n, form, prefix_chars, middle_chars, output bytes, output offsets)`` of a run of texts; forms are 0 plain, 1 psm, 2 spm."""
    start, stop = offsets[:-1], offsets[1:]
    solid = ~BLANK[data]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[stop[stop > start] - 1] = True  # also the end of a text that ends in blanks
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(ends, start, side="right")
    n = np.searchsorted(ends, stop, side="right") - first
    form = np.where((n == 0) | _marked(data, offsets) | (h[2] % 100 >= share), 0, np.where(h[3] % 100 < spm_share, 2, 1))
    one, two = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    ends = np.append(ends, 0)
    lo, hi = (np.where((k > 0) & (form > 0), ends[first + k - 1], start) for k in (one, two))
    size = stop - start + np.where(form > 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE), 0)
    edges = np.append(0, np.cumsum(size))
    psm, spm, base = form == 1, form == 2, edges[:-1]
    # a plain text is one segment at its start: its prefix and middle are empty
    to_prefix = base + np.where(psm, 3, np.where(spm, 6 + stop - hi, 0))
    to_suffix = base + np.where(psm, 6 + lo - start, np.where(spm, 3, 0))
    to_middle = base + np.where(form > 0, 9 + lo - start + stop - hi, 0)
    out = np.empty(edges[-1], np.uint8)
    for a, b, places in _shifts(*_steps([start, lo, hi], [to_prefix, to_middle, to_suffix]), len(data)):
        out[places] = data[a:b]
    moved = form > 0
    for mark, at in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        _put(out, at[moved] - len(mark), mark)
    lead = (data & 0xC0) != 0x80
    chars = lambda a, b: np.array([np.count_nonzero(lead[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    return n, form, chars(start, lo), chars(lo, hi), out, edges


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text bytes, offsets, valid)`` of a run of outputs; not valid are those without their form's marks."""
    start, stop = offsets[:-1], offsets[1:]
    none = len(data) + 3
    whole = {m: np.append(_marks(data, m), none) for m in (PREFIX, SUFFIX, MIDDLE)}
    find = lambda mark, at: whole[mark][np.searchsorted(whole[mark], np.minimum(at, none))]
    psm, spm = form == 1, form == 2
    zero = np.where(psm, find(PREFIX, start), find(SUFFIX, start))
    second = np.where(psm, find(SUFFIX, zero + 3), find(PREFIX, zero + 3))
    third = find(MIDDLE, second + 3)
    found = (zero == start) & (third + 3 <= stop)
    valid, moved = (form == 0) | ((psm | spm) & found), (psm | spm) & found
    from_prefix = np.where(moved, np.where(psm, zero, second) + 3, start)
    from_suffix = np.where(moved, np.where(psm, second, zero) + 3, start)
    from_middle = np.where(moved, third + 3, start)
    prefix = np.where(moved, np.where(psm, second, third) - from_prefix, 0)
    middle = np.where(moved, stop - from_middle, 0)
    size = np.where(valid, stop - start - np.where(moved, 9, 0), 0)
    edges = np.append(0, np.cumsum(size))
    base = edges[:-1]
    out = np.empty(edges[-1], np.uint8)
    for a, b, places in _shifts(*_steps([base, base + prefix, base + prefix + middle], [from_prefix, from_middle, from_suffix]), len(out)):
        out[a:b] = data[places]
    return out, edges, valid


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of each batch whose first column, a string without nulls, has about ``RUN_BYTES``, with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _bytes_of(batch.column(0))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _mapped(df: DataFrame, inner: list[Column], names: list[str], new: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """``df`` with columns ``names`` and those that ``work`` makes of each run of ``inner``."""
    fields = StructType.fromDDL(new).fields
    out_names, skip = [*names, *(f.name for f in fields)], len(inner)
    free = "_" * (1 + max(map(len, names), default=0))  # longer than any name, so no other column's
    sent = df.select(*[c.alias(f"{free}{k}") for k, c in enumerate(inner)], *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _runs(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], *work(part, data, offsets)], out_names)

    return sent.mapInArrow(run, StructType([*sent.schema.fields[skip:], *fields]))


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) of ``docs(doc_id, text, ...)`` and ``n, form, prefix_chars, middle_chars, output``.

    Tokens are words with the blanks before them; blanks at the end are one
    more.  Cuts and forms follow from the sha256 of ``seed`` and ``doc_id``:
    ``share`` percent are cut, of these ``spm_share`` percent with the suffix
    first (``spm``), the others with the prefix first (``psm``).  ``plain``
    texts, among them empty ones and such that hold a mark, come out as they
    are, without ``prefix_chars`` and ``middle_chars``.  Null texts count as
    empty, a null id as an empty one; rows that share an id are cut by the same
    numbers, repeated rows come out alike, long texts are worked on whole, an
    empty table gives no rows.  Input columns of the new names are replaced.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    names = [c for c in keep or docs.columns if c not in {f.name for f in StructType.fromDDL(NEW)}]
    forms = pa.array(["plain", "psm", "spm"])

    def work(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        numbers = [c.to_numpy(zero_copy_only=False) for c in part.columns[1:5]]
        n, form, prefix, middle, out, edges = scatter(data, offsets, numbers, share, spm_share)
        plain = form == 0
        return [pa.array(n), forms.take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), _strings(out, edges)]

    return _mapped(docs, [F.coalesce(F.col("text").cast("string"), F.lit("")), *h], names, NEW, work)


def restore(outputs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) of ``outputs(form, output, ...)`` and ``restored``, the text that the output was made of.

    Null where output or form is null, the form is unknown, or the marks of the
    form are missing.  An input column ``restored`` is replaced.
    """
    form = F.when(F.col("output").isNotNull(), F.when(F.col("form") == "plain", 0).when(F.col("form") == "psm", 1).when(F.col("form") == "spm", 2))
    names = [c for c in keep or outputs.columns if c != "restored"]

    def work(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [_strings(*gather(data, offsets, part.column(1).to_numpy(zero_copy_only=False)))]

    return _mapped(outputs, [F.coalesce("output", F.lit("")), F.coalesce(form, F.lit(-1))], names, "restored string", work)


def op11_displacement_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = fill_in_middle(docs, seed=42, share=50, spm_share=80, keep=["doc_id"])
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    back = restore(made.select(*kept, "output", F.sha2("output", 256).alias("output_sha256")), keep=[*kept, "output_sha256"])
    return back.select(*kept, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


_TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce("text", '') t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) s FROM documents),
h AS (SELECT *, regexp_extract_all(t, '{_TOKENS}') w, {', '.join(f"CAST('0x' || substr(s, {8 * k + 1}, 8) AS BIGINT) h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(w) n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') pre, array_to_string(w[a + 1:b], '') mid, array_to_string(w[b + 1:n], '') suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) output_sha256, sha256(t) restored_sha256 FROM p"""

QUERIES = {"op11_displacement_scatter": op11_displacement_scatter}
ORACLES = {"op11_displacement_scatter": ORACLE}
