"""Streaming over key-sorted Arrow batches, group by group, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """``(crowded, columns)`` of whole groups; the first column is the sorted key.

    Groups of at most ``limit`` rows come whole and several at once; the rows of
    larger ones come as they pass, flagged, so nothing larger is ever held.
    """
    held: list[np.ndarray] | None = None
    hot = None
    for batch in batches:
        cols = [_plain(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if hot is not None:
            n = int(np.searchsorted(cols[0], hot, side="right"))
            if n:
                yield True, [c[:n] for c in cols]
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        yield from _parted([c[:last] for c in cols], limit)
        held = [c[last:] for c in cols]
        if len(held[0]) > limit:
            hot = held[0][0]
            yield True, held
            held = None
    if held is not None:
        yield from _parted(held, limit)


def _plain(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_fixed_size_list(column.type):
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _parted(cols: list[np.ndarray], limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    if not len(cols[0]):
        return
    edges = np.flatnonzero(np.diff(cols[0])) + 1
    sizes = np.diff(np.concatenate([[0], edges, [len(cols[0])]]))
    crowded = np.repeat(sizes > limit, sizes)
    if crowded.any():
        yield True, [c[crowded] for c in cols]
        cols = [c[~crowded] for c in cols]
    if len(cols[0]):
        yield False, cols


def pairs_by_offset(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal sorted keys, one vector for each distance between the two rows."""
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        if len(at):
            yield at, at + step
        step += 1


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes, the least node that pairs (i, j) reach from each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
