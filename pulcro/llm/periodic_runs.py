"""Maximal runs of repeated words in texts, found in an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of short texts whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 200_000

FOUND = (
    "n_kept long, n_runs long, start long, length long, period long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
NAMES = ["n_kept", "n_runs", "start", "length", "period", "runs", "collapsed"]


def suffix_ranks(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array and its inverse of texts laid end to end, and the ranks by 1, 2, 4, ... words.

    ``words`` are numbers that no two texts share, so the suffixes of a text lie together; a suffix
    ends with its text. By doubling: only suffixes that are still tied are sorted again.
    """
    n = len(words)
    end = np.searchsorted(owner, owner, side="right")
    order = np.argsort(words)
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, width = [rank.astype(np.int32)], 1
    size = np.diff(np.append(first, n))
    tied = order[np.repeat(size, size) > 1]
    while len(tied):
        after = tied + width
        inside = after < end[tied]
        key = np.where(inside, rank[np.where(inside, after, 0)], -1)
        # Tied suffixes are listed by rank; inside a rank they are put in order of what follows.
        by = np.lexsort((key, rank[tied]))
        tied, key = tied[by], key[by]
        old = rank[tied]
        head = np.ones(len(tied), bool)
        head[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        begin = np.ones(len(tied), bool)
        begin[1:] = old[1:] != old[:-1]
        place = np.arange(len(tied))
        base = place[begin][np.cumsum(begin) - 1]
        at = place[head][np.cumsum(head) - 1]
        rank[tied] = old + at - base
        levels.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(head), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        width *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank, levels


def common_prefixes(suffixes: np.ndarray, owner: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array; 0 for the first."""
    n = len(suffixes)
    shared = np.zeros(n, np.int64)
    end = np.searchsorted(owner, owner, side="right")
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b = suffixes[at - 1], suffixes[at]
    stop_a, stop_b = end[a], end[b]
    length = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x + (1 << k) <= stop_a) & (y + (1 << k) <= stop_b)
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        length += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
    shared[at] = length
    return shared


def smaller_children(shared: np.ndarray) -> np.ndarray:
    """Rows (begin, end, depth, left, right): every child but the largest of every interval of ``shared``.

    Intervals come from one pass with a stack of (depth, left end, boundaries between children); ends
    are exclusive, ``left`` and ``right`` are those of the whole interval.
    """
    places = np.flatnonzero(shared)
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = []
    depths, last = shared[places].tolist(), -2

    def close(depth: int, left: int, bounds: list[int], right: int) -> None:
        edges = [left, *bounds, right]
        sizes = [y - x for x, y in zip(edges, edges[1:])]
        largest = sizes.index(max(sizes))
        for k in range(len(sizes)):
            if k != largest:
                found.append((edges[k], edges[k + 1], depth, left, right))

    for place, depth in zip(places.tolist(), depths):
        left = place - 1
        if place != last + 1:
            while stack:
                close(*stack.pop(), last + 1)
        else:
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                close(*top, place)
                left = top[1]
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(place)
        else:
            stack.append((depth, left, [place]))
        last = place
    while stack:
        close(*stack.pop(), last + 1)
    return np.array(found, np.int64).reshape(-1, 5)


def branching_squares(suffixes: np.ndarray, rank: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares that the word after them does not continue.

    Such a square of period d begins at i just if suffixes i and i + d lie in different children of
    an interval of depth d. For every suffix i of a child that is not the largest, the interval is
    asked whether it holds i + d or i - d: no more than n log n questions.
    """
    child = smaller_children(shared)
    n = len(suffixes)
    size = child[:, 1] - child[:, 0]
    row = np.repeat(np.arange(len(child)), size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    begin, end, depth, left, right = child[row].T
    i = suffixes[begin + inside]
    starts, periods = [], []
    for j, first in ((i + depth, i), (i - depth, i - depth)):
        real = (j >= 0) & (j < n)
        at = rank[np.where(real, j, 0)]
        good = real & (at >= left) & (at < right) & ~((at >= begin) & (at < end))
        starts.append(first[good])
        periods.append(depth[good])
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(words: np.ndarray, squares: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from branching squares (period, place) of one text, rotated and merged.

    The last square of a run ends where the run ends; it is moved left for as long as words a period
    apart agree. Squares of a multiple of the period end there too and add nothing.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    found = set()
    for period, place in sorted(squares):
        end = place + 2 * period
        known = ending.setdefault(end, [])
        if any(period % p == 0 and s <= place for s, p in known):
            continue
        start, step = place, 64
        while start > 0:  # longer and longer stretches are compared at once
            low = max(0, start - step)
            differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
            if len(differ):
                start = low + int(differ[-1]) + 1
                break
            start, step = low, step * 2
        known.append((start, period))
        found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _search(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of at least ``least`` words of each text, by one suffix array of them all."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat: list[int] = []
    for k, text in enumerate(texts):
        numbers: dict[bytes, int] = {}
        base = len(flat)
        flat.extend(base + numbers.setdefault(w, len(numbers)) for w in text)
    words = np.array(flat, np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(words):
        return found
    suffixes, rank, levels = suffix_ranks(words, owner)
    places, periods = branching_squares(suffixes, rank, common_prefixes(suffixes, owner, levels))
    squares: dict[int, list[tuple[int, int]]] = {}
    begin = np.cumsum(sizes) - sizes
    for k, place, period in zip(owner[places].tolist(), (places - begin[owner[places]]).tolist(), periods.tolist()):
        squares.setdefault(k, []).append((period, place))
    for k, given in squares.items():
        own = words[begin[k] : begin[k] + sizes[k]]
        found[k] = [r for r in maximal_runs(own, given) if r[1] >= max(least, 2 * r[2])]
    return found


def _answer(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    if runs:
        words = [words[k] for k in np.flatnonzero(_kept(len(words), runs)).tolist()]
    told = [dict(zip(("start", "length", "period"), r)) for r in runs]
    return len(words), len(runs), start, length, period, told, b" ".join(words).decode()


def _answers(texts: Iterator[str | None], least: int) -> Iterator[tuple]:
    """One answer a text; texts are searched together while they have under ``BATCH_WORDS`` words."""
    waiting: list[list[bytes]] = []
    total = 0
    for text in texts:
        words = (text or "").encode().split()
        if waiting and total + len(words) > BATCH_WORDS:
            yield from map(_answer, waiting, _search(waiting, least))
            waiting, total = [], 0
        waiting.append(words)
        total += len(words)
    if waiting:
        yield from map(_answer, waiting, _search(waiting, least))


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Adds a struct column ``found`` to every row: the runs of repeated words in the whole text.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch whose words
    equal those ``period`` places on, with its smallest period, at least two periods and ``least``
    words long, that cannot be extended. ``found`` holds n_kept (words of ``collapsed``), n_runs, of the longest
    run (ties: smallest start, then period) start, length and period (null without a run), all
    ``runs`` by start and period, and ``collapsed``: the words that no run holds behind its first
    period, joined by one space. A null or empty text has no words and no runs. All columns of
    ``docs`` stay, but one named ``found`` is replaced; repeated rows are answered alike. Rows are
    independent: nothing is shuffled. Time is n log n in the words of a text, whatever repeats.
    """

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame(list(_answers(iter(batch), least)), columns=NAMES, dtype=object)
            yield frame.astype({name: "Int64" for name in NAMES[:5]})

    return docs.withColumn("found", search(F.col(text)))
