"""Comparing blocks of items pair by pair: what a tile of two blocks reports, and in which form.

A tile never lists its links: it gives each linked item the weight of the items it links
to, and a root of the tile's links that joins the same items together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        of = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(of) + 1):
            if i < len(of) and of[i] == of[start]:
                continue
            if held and held_key != of[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, i - start))
            held_key, start = of[start], i
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index joined to each of ``n`` items by the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def report(names: list, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list, list, list]:
    """(names, linked weight, root's name) of the items that the links a[i] - b[i] touch."""
    got = np.zeros(len(names), dtype=np.int64)
    np.add.at(got, a, weights[b])
    np.add.at(got, b, weights[a])
    touched = np.union1d(a, b)
    root = roots(len(names), a, b)
    return [names[i] for i in touched], got[touched].tolist(), [names[root[i]] for i in touched]


def compare(keys: list[str], links: Callable[[pa.Table], tuple[list, np.ndarray, np.ndarray, np.ndarray]]):
    """A function for mapInArrow: runs ``links`` on each tile and reports (node, n_links, root).

    ``links`` gives names, weights and the two ends of each link, as places in names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: list = []
        count: list = []
        root: list = []
        for table in groups(batches, keys):
            names, weights, a, b = links(table)
            if len(a):
                for out, more in zip((node, count, root), report(names, weights, a, b), strict=True):
                    out += more
            if len(node) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(count, pa.int64()), pa.array(root, pa.string())], names=["node", "n_links", "root"])
                node, count, root = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(count, pa.int64()), pa.array(root, pa.string())], names=["node", "n_links", "root"])

    return run


REPORT = "node string, n_links long, root string"
