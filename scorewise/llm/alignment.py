"""Banded alignment of many pairs of sequences at once: whether the edit distance stays within a bound."""

from __future__ import annotations

import numpy as np

CELLS = 200_000
PLACES = 2_000_000  # of the sequences of one batch
ROWS = 32  # between looks at which pairs cannot be settled any more
FAR = np.int32(1 << 29)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what both begin and end with; that never changes the distance."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _shared(a: np.ndarray, b: np.ndarray, k: int = 1) -> int:
    """Number of runs of k elements that two sequences have in common, counting repeats."""
    both = np.concatenate([a, b]).astype(np.int64)
    runs, edge = both, len(a)
    for j in range(1, k):
        _, runs = np.unique(runs[: len(both) - j] * (int(both.max()) + 1) + both[j:], return_inverse=True)
    if k > 1:  # not those that reach from one sequence into the other
        runs, edge = np.concatenate([runs[: max(0, len(a) - k + 1)], runs[len(a) :]]), max(0, len(a) - k + 1)
    _, number = np.unique(runs, return_inverse=True)
    size = int(number.max()) + 1 if len(runs) else 0
    return int(np.minimum(np.bincount(number[:edge], minlength=size), np.bincount(number[edge:], minlength=size)).sum())


def _apart(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether too few runs are shared: an edit spoils k runs of k elements at most."""
    longer = max(len(a), len(b))
    return any(longer - k + 1 - _shared(a, b, k) > k * most for k in (1, 2, 3) if longer - k + 1 > k * most)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int, most: np.ndarray) -> np.ndarray:
    """Least costs of paths that stray at most ``band`` from the diagonal, as far as they are at most ``most``, else ``FAR``. No
    path costs less than the distance, and where the distance is at most ``band`` one costs as much.

    A column holds a pair, a row a diagonal, and a cell its cost less the number of its diagonal."""
    order = np.argsort([-len(a) for a, _ in pairs], kind="stable")
    rows, columns = np.array([len(pairs[i][0]) for i in order]), np.array([len(pairs[i][1]) for i in order])
    most, width, deep = most[order], 2 * band + 1, int(rows.max())
    x = np.full((deep + 1, len(pairs)), -1, np.int32)
    y = np.full((deep + width + 1, len(pairs)), -2, np.int32)
    for at, i in enumerate(order):
        a, b = pairs[i]
        x[: len(a), at] = a
        b = b[: deep + band + 1]
        y[band : band + len(b), at] = b
    slant = np.arange(width, dtype=np.int32)[:, None]
    line = np.broadcast_to(np.where(slant >= band, -band, FAR), (width, len(pairs))).astype(np.int32)
    end = columns - rows + band
    rows = np.where((end >= 0) & (end < width), rows, -1)  # of the others no path ends in the band
    out = np.full(len(pairs), FAR, np.int32)

    def settle(i: int) -> None:
        done = np.flatnonzero(rows == i)
        out[order[done]] = line[end[done], done] + end[done]

    ends = set(rows.tolist())
    settle(0)
    for i in range(1, deep + 1):
        if i % ROWS == 1:
            alive = rows >= i
            if i > 1:
                alive &= (line + slant).min(axis=0) <= most
            if not alive.any():
                break
            if alive.sum() <= 0.9 * len(alive):
                x, y, line, end, rows, most, order = x[:, alive], y[:, alive], line[:, alive], end[alive], rows[alive], most[alive], order[alive]
        changed = line + (x[i - 1] != y[i - 1 : i - 1 + width])
        np.minimum(changed[:-1], line[1:] + 2, out=changed[:-1])
        if i <= band:
            changed[: band - i] = FAR
        line = np.minimum.accumulate(changed, axis=0)
        if i in ends:
            settle(i)
    return np.where(out > FAR // 2, FAR, out)


def within(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float, share: int = 64) -> np.ndarray:
    """Whether 1 - distance / longer length reaches ``similarity``, for pairs of integer sequences.

    Pairs are settled by what the lengths allow, then aligned in a band of a ``share``-th of their length: a path that costs little
    enough settles a pair, whether or not it is the least. The others are settled by the runs that they share, or aligned in
    bands four times as wide each, up to one that holds every path that would do."""
    out = np.zeros(len(pairs), bool)
    waiting: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int(np.floor((1 - similarity) * longer + 1e-9))
        if abs(len(a) - len(b)) > most:
            continue
        a, b = _trimmed(a, b)
        longer = max(len(a), len(b))
        if longer <= most:
            out[i] = True
        else:
            waiting.append((i, a, b, most, min(most, max(8, abs(len(a) - len(b)) + 4, longer // share))))
    first = True
    while waiting:
        waiting.sort(key=lambda w: (w[4], len(w[1])))
        later, at = [], 0
        while at < len(waiting):
            # pairs of one batch are about as long and need about the same band
            widest = waiting[at][4] + waiting[at][4] // 4
            most_pairs = max(1, CELLS // (2 * widest + 1))
            end, longest = at + 1, len(waiting[at][1])
            while end < min(len(waiting), at + most_pairs) and waiting[end][4] <= widest:
                longest = max(longest, len(waiting[end][1]))
                if (end + 1 - at) * longest > PLACES:
                    break
                end += 1
            part, at = waiting[at:end], end
            band = part[-1][4]
            for (i, a, b, most, _), cost in zip(part, _banded([w[1:3] for w in part], band, np.array([w[3] for w in part]))):
                if cost <= most:
                    out[i] = True
                elif band < most and not (first and _apart(a, b, most)):
                    later.append((i, a, b, most, min(most, band * 4)))
        waiting, first = later, False
    return out
