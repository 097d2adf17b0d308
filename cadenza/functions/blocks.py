"""Longest matching blocks of two texts, as `difflib.SequenceMatcher` without junk finds them, from runs of n-grams."""

from __future__ import annotations

#: Long matches are looked for by n-grams first, which few places share; what lies between them is small.
SIZES = (4, 2, 1)


def _runs(a: str, b: str, box: tuple[int, int, int, int], n: int) -> list[tuple[int, int, int]]:
    """Maximal runs (size, -start in a, -start in b) of at least ``n`` equal characters within a box."""
    a_from, a_to, b_from, b_to = box
    at: dict[str, list[int]] = {}
    for j in range(b_from, b_to - n + 1):
        at.setdefault(b[j : j + n], []).append(j)
    found = []
    for i in range(a_from, a_to - n + 1):
        places = at.get(a[i : i + n])
        if places is None:
            continue
        before = a[i - 1] if i > a_from else ""
        for j in places:
            if before and j > b_from and b[j - 1] == before:
                continue  # inside a run that began earlier
            k, most = n, min(a_to - i, b_to - j)
            while k < most and a[i + k] == b[j + k]:
                k += 1
            found.append((k, -i, -j))
    return found


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, size) in order: the longest block, earliest in a, then in b, and so on at both sides of it.

    A box's longest run of n characters or more is one of its runs of n-grams; boxes inside it have what these leave of the runs. Only
    boxes without any are looked at by shorter n-grams.
    """
    if a == b:
        return [(0, 0, len(a))] if a else []
    blocks = []
    todo: list[tuple] = [((0, len(a), 0, len(b)), 0, [])]
    while todo:
        box, level, runs = todo.pop()
        a_from, a_to, b_from, b_to = box
        short = min(a_to - a_from, b_to - b_from)
        if not short:
            continue
        while not runs and level < len(SIZES) and SIZES[level] > short:
            level += 1
        while not runs and level < len(SIZES):
            runs = _runs(a, b, box, SIZES[level])
            level += not runs
        if not runs:
            continue
        size, i, j = max(runs)
        i, j, n = -i, -j, SIZES[level]
        blocks.append((i, j, size))
        left, right, i_to, j_to = [], [], i + size, j + size
        for k, p, q in runs:
            p, q = -p, -q
            if p < i and q < j:
                rest = min(k, i - p, j - q)
                if rest >= n:
                    left.append((rest, -p, -q))
            skip = max(0, i_to - p, j_to - q)
            if k - skip >= n:
                right.append((k - skip, -p - skip, -q - skip))
        todo.append(((a_from, i, b_from, j), level if left else level + 1, left))
        todo.append(((i_to, a_to, j_to, b_to), level if right else level + 1, right))
    return sorted(blocks)


def ratio(blocks: list[tuple[int, int, int]], a: str, b: str) -> float:
    """The share of characters in blocks; 1 for two empty texts."""
    return 2.0 * sum(size for _, _, size in blocks) / (len(a) + len(b)) if a or b else 1.0
