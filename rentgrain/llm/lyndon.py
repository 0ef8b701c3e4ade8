"""Suffix arrays in linear time by grouping suffixes, without recursion or renaming.

Suffixes are first grouped by their first symbol. Groups are then taken in descending order, and the
symbols a group stands for are appended to the groups of the suffixes right before its members, which
previous-smaller pointers find. In the end a group holds the suffixes with one longest Lyndon prefix.
The order inside the groups follows in one more pass: a suffix comes as early in its group as what
follows its Lyndon prefix comes among all suffixes.
"""

from __future__ import annotations

from collections import defaultdict


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, the first rank of its group and the length of its longest Lyndon prefix."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # members of a group lie next to each other
    place, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for rank, i in enumerate(order):
        if rank and text[i] != text[order[rank - 1]]:
            first = rank
        place[i], group[i] = rank, first
        size[first] += 1
    length, smaller = [1] * n, [-1] * n

    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = sorted(order[start:end])
        ahead: dict[int, int] = {}
        for i in members:
            # The nearest suffix to the left in a lower group; pointers of higher groups are short cuts.
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                ahead[p] = ahead.get(p, 0) + 1
        if ahead:
            grown = length[members[0]]
            by_count = defaultdict(list)
            for p, count in ahead.items():
                by_count[count].append(p)
            # Those with more members behind them rank higher, so they leave their groups first.
            for count in sorted(by_count, reverse=True):
                left = []
                for p in by_count[count]:
                    old = group[p]
                    size[old] -= 1
                    last = old + size[old]
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    length[p] += count * grown
                    left.append((p, old))
                starts = {old: old + size[old] for _, old in left}
                for p, old in left:
                    group[p] = starts[old]
                    size[starts[old]] += 1
        end = start
    return group, length


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; the end of the text is the smallest symbol."""
    n = len(text)
    group, length = lyndon_groups(text)
    before: list[list[int]] = [[] for _ in range(n + 1)]  # suffixes by where their Lyndon prefix ends
    for i in range(n):
        before[i + length[i]].append(i)
    free = list(range(n))  # next rank to give out, by first rank of the group
    found = [0] * n
    for rank in range(-1, n):
        for i in before[found[rank] if rank >= 0 else n]:
            first = group[i]
            found[free[first]] = i
            free[first] += 1
    return found
