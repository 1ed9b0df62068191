"""Plain loops over one series, written from the operator descriptions, to compare the block-wise forms with."""

from __future__ import annotations

import math

import numpy as np


def smooth(x, range_, sigma):
    half = (range_ - 1) // 2
    taps = [math.exp(-0.5 * ((d + 1) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)) for d in range(-half, half + 1)]
    return [sum(w * x[i + d] for d, w in zip(range(-half, half + 1), taps) if 0 <= i + d < len(x)) for i in range(len(x))]


def runs(x, enter, leave):
    out, open_at = [], None
    for i, s in enumerate(x):
        if open_at is None and enter(s):
            open_at = i
        elif open_at is not None and leave(s):
            out.append((open_at, i - 1))
            open_at = None
    return out + ([(open_at, len(x) - 1)] if open_at is not None else [])


def picks(x, segments, budget, gap):
    total = sum(e - s + 1 for s, e in segments)
    out = []
    for no, (s, e) in enumerate(segments):
        allowed = max(2, round(budget * (e - s + 1) / total))
        chosen = {s, e}
        for i in sorted(range(s + 1, e), key=lambda i: (-x[i], i)):
            if len(chosen) < allowed and all(abs(i - c) >= gap for c in chosen):
                chosen.add(i)
        out += [(no, i) for i in sorted(chosen)]
    return out


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def pr_area(scores, labels):
    points = [(0.0, 1.0)]
    for t in sorted(set(scores), reverse=True):
        hit = sum(y for s, y in zip(scores, labels) if s >= t)
        said = sum(s >= t for s in scores)
        points.append((hit / sum(labels), hit / said))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


def meter(x, n):
    rows = []
    for i in range(len(x)):
        last = x[max(0, i - n + 1):i + 1]
        rows.append((sorted(last)[(len(last) - 1) // 2], float(np.mean(last)), max(last), x[i], float(np.mean(x[:i + 1]))))
    return rows
