"""A longest common subsequence of two short sequences, for use inside a task."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt


def common_lines(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Rows of the table are bits, and of them every root of the number is held."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)] + [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not x or not y:
        return sorted(ends)
    full, where = (1 << len(y)) - 1, {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j

    def below(v: int, line) -> int:
        u = v & where.get(line, 0)
        return ((v + u) | (v - u)) & full

    step = isqrt(len(x)) + 1
    saved = [full]
    v = full
    for i, line in enumerate(x, 1):
        v = below(v, line)
        if i % step == 0:
            saved.append(v)
    rows: dict[int, bytes] = {}

    def grows(i: int, j: int) -> bool:
        """Whether the j-th line of y makes the subsequence with the first i lines of x longer."""
        if i not in rows:
            rows.clear()
            start = i // step * step
            v = saved[start // step]
            for r in range(start, min(start + step, len(x) + 1)):
                if r > start:
                    v = below(v, x[r - 1])
                rows[r] = v.to_bytes(len(y) // 8 + 1, "little")
        return not rows[i][(j - 1) >> 3] >> ((j - 1) & 7) & 1

    out, i, j = [], len(x), len(y)
    while i and j:
        if not grows(i, j):
            j -= 1
        elif i > 1 and grows(i - 1, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((head + i, head + j))
    return sorted(ends + out)
