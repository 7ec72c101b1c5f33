"""Targets of a mix by plain repetition, for comparison."""

from __future__ import annotations


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    """sizes: (source, size). Shares by weight; what is above a limit goes to the others, until nothing is."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: float(weights[i % len(weights)]) for i, (name, _) in enumerate(order)}
    size, total = dict(order), float(sum(n for _, n in order))
    full = set()
    while True:
        free = [x for x in weight if x not in full]
        left = total - sum(most * size[x] for x in full)
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        above = {x for x in free if share[x] > most * size[x]}
        if not above:
            return {x: most * size[x] if x in full else share[x] for x in weight}
        full |= above
