"""Which lines of a text a longest common line sequence with another text keeps.

Few changes are found by the greedy search along diagonals, which keeps what it
reached for each number of edits; where the changes are many, the first text is
halved where the two longest common sequences of its halves, found by bit vectors with a bit for each line of
the second text, are longest together. Memory is bounded by a constant and the texts, and the time of the worst case is the
product of their lines over the bits of a word.
"""

from __future__ import annotations

import numpy as np

MOST_EDITS = 400  # of one greedy search, whose memory grows with their square
OFTEN = 64  # a line with more places than this keeps its bit vector


def kept_lines(a: list[str], b: list[str]) -> bytearray:
    """A 1 for each line of ``b`` in a longest common sequence of lines with ``a``."""
    number: dict[str, int] = {}
    kept = bytearray(len(b))
    todo = [([number.setdefault(s, len(number)) for s in a], [number.setdefault(s, len(number)) for s in b], range(len(b)))]
    while todo:
        x, y, at = todo.pop()
        x, y, at = _trimmed(x, y, at, kept)
        if not x or not y:
            continue
        only_x, only_y = set(x), set(y)
        if not only_x <= only_y or not only_y <= only_x:
            keep = [k for k, line in enumerate(y) if line in only_x]
            todo.append(([line for line in x if line in only_y], [y[k] for k in keep], [at[k] for k in keep]))
            continue
        places = _greedy(x, y)
        if places is None:
            i = len(x) // 2
            if i == 0:  # one line, which the other text has
                kept[at[y.index(x[0])]] = 1
                continue
            j = int(np.argmax(_lengths(x[:i], y) + _lengths(x[i:][::-1], y[::-1])[::-1]))
            todo += [(x[:i], y[:j], at[:j]), (x[i:], y[j:], at[j:])]
            continue
        for k in places:
            kept[at[k]] = 1
    return kept


def _trimmed(x: list[int], y: list[int], at, kept: bytearray):
    """Both texts without the lines that they begin and end with alike, which are kept."""
    least, first, last = min(len(x), len(y)), 0, 0
    while first < least and x[first] == y[first]:
        kept[at[first]] = 1
        first += 1
    while last < least - first and x[-1 - last] == y[-1 - last]:
        kept[at[len(y) - 1 - last]] = 1
        last += 1
    return x[first : len(x) - last], y[first : len(y) - last], at[first : len(y) - last]


def _greedy(x: list[int], y: list[int]) -> list[int] | None:
    """Places of ``y`` in a longest common sequence, or None where that takes too many edits or steps."""
    n, m = len(x), len(y)
    steps = 8 * (n + m) + 10_000
    reached = {1: 0}
    trail: list[dict[int, int]] = []
    for edits in range(min(n + m, MOST_EDITS) + 1):
        trail.append(dict(reached))
        for k in range(-edits, edits + 1, 2):
            if k > n or -k > m:
                continue
            down = k == -edits or (k != edits and reached.get(k - 1, -1) < reached.get(k + 1, -1))
            i = reached.get(k + 1, -1) if down else reached.get(k - 1, -1) + 1
            if i < 0 or i > n or i - k > m or i - k < 0:
                reached[k] = min(max(i, 0), n)
                continue
            start = i
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            steps -= i - start + 1
            reached[k] = i
            if i == n and i - k == m:
                return _walk_back(trail, n, m)
        if steps < 0:
            return None
    return None


def _walk_back(trail: list[dict[int, int]], n: int, m: int) -> list[int]:
    out = []
    i, j = n, m
    for edits in range(len(trail) - 1, -1, -1):
        reached, k = trail[edits], i - j
        down = k == -edits or (k != edits and reached.get(k - 1, -1) < reached.get(k + 1, -1))
        before = k + 1 if down else k - 1
        pi = reached.get(before, 0)
        pj = pi - before
        stop_i, stop_j = (0, 0) if edits == 0 else (pi, pj + 1) if down else (pi + 1, pj)
        while i > stop_i and j > stop_j:
            i, j = i - 1, j - 1
            out.append(j)
        i, j = pi, pj
    return out


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common sequences of ``x`` and each beginning of ``y``."""
    m = len(y)
    places: dict[int, list[int]] = {}
    for j, line in enumerate(y):
        places.setdefault(line, []).append(j)
    held: dict[int, int] = {}
    full = (1 << m) - 1
    v = full
    for line in x:
        mask = held.get(line)
        if mask is None:
            where = places.get(line)
            if where is None:
                continue
            if len(where) > OFTEN:
                bits = np.zeros(m, np.uint8)
                bits[where] = 1
                mask = held[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                mask = 0
                for j in where:
                    mask |= 1 << j
        u = v & mask
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def added(ref: str, target: str) -> list[str]:
    """Lines of ``target`` outside that sequence, in order."""
    if ref == target:
        return []
    b = target.split("\n")
    return [s for s, k in zip(b, kept_lines(ref.split("\n"), b)) if not k]
