"""Maximal sets by a frontier of nodes over packed bitmaps: one step counts all children of many nodes at once."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.operators.conditional import GROUP_CELLS, MaximalTree, _found, clear_subsets, named, trimmed
from patternlake.session import cut

#: Most bytes of the bitmaps that one step lays side by side.
WAVE_BYTES = 32 << 20


def packed(columns: list[np.ndarray], n_items: int) -> np.ndarray:
    """(items, words) of 64-bit words: bit r of an item's words is set if row r has the item."""
    words = -(-len(columns) // 64)
    out = np.zeros((n_items, words), np.uint64)
    sizes = [len(c) for c in columns]
    if sum(sizes):
        row = np.repeat(np.arange(len(columns)), sizes)
        np.bitwise_or.at(out, (np.concatenate(columns), row >> 6), np.left_shift(np.uint64(1), (row & 63).astype(np.uint64)))
    return out


def planes(weight: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Weights as bitmaps: (words, factor), so that a set of rows weighs the sum of factor times the ones it shares with each. Equal weights are one plane."""
    rows = np.arange(len(weight))
    if len(weight) and (weight == weight[0]).all():
        return [(packed([np.zeros(1, np.int64)] * len(weight), 1)[0], int(weight[0]))]
    top = int(weight.max()).bit_length() if len(weight) else 0
    out = [(packed([np.zeros(int(on), np.int64) for on in (weight >> p) & 1], 1)[0], 1 << p) for p in range(top)]
    return [(w, f) for w, f in out if w.any()] if len(rows) else []


class Frontier:
    """Search for maximal sets among the items of one group, the most frequent first.

    A node is a set, the bitmap of the rows that hold it, and the items that may still join. A step takes as many nodes as ``wave_bytes`` allow and gets the
    supports of all their children from one AND and one population count per plane of weights. Rows that share all that could join end a branch, items that all rows of a node have join
    at once, and a node whose largest possible set lies in one that was found is dropped.
    """

    def __init__(self, bitmaps: np.ndarray, weight: np.ndarray, least: int, wave_bytes: int = WAVE_BYTES, max_nodes: int | None = None, budget_s: float | None = None):
        self.bitmaps, self.planes, self.least = bitmaps, planes(weight), least
        self.whole = np.bitwise_or.reduce([w for w, _ in self.planes], axis=0) if self.planes else np.zeros(bitmaps.shape[1], np.uint64)
        self.wave = max(1, wave_bytes // max(1, 16 * bitmaps.size))
        self.max_nodes, self.budget_s = max_nodes, budget_s
        self.nodes = self.steps = 0
        self.complete = True

    def _weigh(self, rows: np.ndarray, along: np.ndarray | None = None) -> np.ndarray:
        """Weight of each bitmap of ``rows``, or of its part in each of ``along``."""
        out = 0
        for words, factor in self.planes:
            part = rows & words
            out = out + factor * np.bitwise_count(part if along is None else part[:, None, :] & along).sum(axis=-1, dtype=np.int64)
        return out

    def mine(self) -> list[tuple[int, int]]:
        """(mask, support) of the maximal sets; the empty set if no item is frequent."""
        began, found = time.monotonic(), MaximalTree()
        stack = [(0, self.whole, np.arange(len(self.bitmaps)))]
        while stack:
            if (self.max_nodes and self.nodes >= self.max_nodes) or (self.budget_s and time.monotonic() - began > self.budget_s):
                self.complete = False
                break
            taken = [stack.pop() for _ in range(min(self.wave, len(stack)))]
            taken = [t for t in taken if not t[0] or not found.covers(t[0] | _mask(t[2]))]
            if not taken:
                continue
            self.nodes += len(taken)
            self.steps += 1
            rows = np.stack([t[1] for t in taken])
            support, total = self._weigh(rows, self.bitmaps), self._weigh(rows)
            for (head, own, tail), n, each in zip(taken, total.tolist(), support):
                stack += self._visit(head, own, tail, n, each, found)
        return _largest(found.sets)

    def _visit(self, head: int, rows: np.ndarray, tail: np.ndarray, n: int, support: np.ndarray, found: MaximalTree) -> list:
        tail = tail[support[tail] >= self.least]
        head |= _mask(tail[support[tail] == n])
        tail = tail[support[tail] < n]
        whole = head | _mask(tail)
        if whole and found.covers(whole):
            return []
        if not len(tail):
            found.add(head, n)
            return []
        shared = rows & np.bitwise_and.reduce(self.bitmaps[tail], axis=0)
        if (m := int(self._weigh(shared[None])[0])) >= self.least:
            found.add(whole, m)
            return []
        return [(head | 1 << int(x), rows & self.bitmaps[x], tail[:k]) for k, x in enumerate(tail)]  # the rarest is taken off first


def _mask(items: np.ndarray) -> int:
    out = 0
    for x in items.tolist():
        out |= 1 << x
    return out


def _largest(sets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sets that lie in no other: nodes of one step do not know of each other's."""
    kept = MaximalTree()
    for mask, n in sorted(sets, key=lambda s: -s[0].bit_count()):
        if not kept.sets or not kept.covers(mask):
            kept.add(mask, n)
    return kept.sets


def maximal_frontier(txns: DataFrame, least: int, cells: int = GROUP_CELLS, wave_bytes: int = WAVE_BYTES, max_nodes: int | None = None, budget_s: float | None = None) -> DataFrame:
    """(items, support, complete) of the maximal sets over (items, weight), by a frontier over the packed bitmaps of each conditional group.

    Nothing is collected and nothing broadcast but the names of up to a few hundred items. With a budget of nodes or seconds for each group, ``complete`` is false on every row if
    a search was cut short: then sets may be missing, and some listed may not be maximal.
    """

    def miner(frame: pd.DataFrame, least: int):
        names, prefixes, weight = trimmed(frame, least)
        f = Frontier(packed(prefixes, len(names)), weight, least, wave_bytes, max_nodes, budget_s)
        return names, f.mine(), f.complete

    found, names = _found(txns, least, miner, cells)
    if max_nodes is None and budget_s is None:
        return named(clear_subsets(found), names).select("items", "support", F.lit(True).alias("complete"))
    found = cut(found, "searched")
    ended = found.agg(F.coalesce(F.min("complete"), F.lit(True)).alias("complete"))
    return named(clear_subsets(found.where("ids is not null")), names).crossJoin(F.broadcast(ended))
