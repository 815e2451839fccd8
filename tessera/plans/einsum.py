"""Einstein summation: reading subscripts and choosing the order of contractions."""

from __future__ import annotations

import math
import string


def read(subscripts: str, shapes: list[tuple[int, ...]]) -> tuple[list[str], str, dict[str, int]]:
    """Labels of each operand and of the output, and sizes by label. Without an arrow the output has the labels met once, in
    alphabetical order; an ellipsis stands for the leading broadcast axes that the other labels don't name."""
    text = subscripts.replace(" ", "")
    left, arrow, right = text.partition("->")
    terms = left.split(",")
    if len(terms) != len(shapes):
        raise ValueError(f"{len(terms)} terms for {len(shapes)} operands")
    spare = [c for c in string.ascii_letters if c not in text]
    rest = [len(s) - len(t.replace("...", "")) if "..." in t else 0 for t, s in zip(terms, shapes, strict=True)]
    dots = "".join(spare[: max(rest, default=0)])
    terms = [t.replace("...", dots[len(dots) - n :]) for t, n in zip(terms, rest, strict=True)]
    sizes: dict[str, int] = {}
    for term, shape in zip(terms, shapes, strict=True):
        if len(term) != len(shape):
            raise ValueError(f"{term!r} doesn't fit {len(shape)} dimensions")
        for label, n in zip(term, shape, strict=True):
            if not label.isalpha():
                raise ValueError(f"unexpected {label!r} in subscripts")
            if sizes.get(label, 1) not in (1, n) and n != 1:
                raise ValueError(f"label {label!r} has sizes {sizes[label]} and {n}")
            sizes[label] = max(sizes.get(label, n), n) if n != 0 else 0
    if arrow:
        out = right.replace("...", dots)
    else:
        joined = "".join(terms)
        out = dots + "".join(sorted(c for c in set(joined) if joined.count(c) == 1 and c not in dots))
    if len(set(out)) != len(out) or not set(out) <= set(sizes):
        raise ValueError(f"bad output subscripts {out!r}")
    return terms, out, sizes


def order(terms: list[str], out: str, sizes: dict[str, int]) -> list[tuple[int, int, str]]:
    """Pairs of operands to contract, by position in a list from which both are taken and to whose end the result goes, with its labels.

    Greedy: the pair with the fewest products comes first, of equals the one with the smaller result.
    """
    terms, steps = list(terms), []
    while len(terms) > 1:
        best = None
        for i in range(len(terms)):
            for j in range(i + 1, len(terms)):
                both = set(terms[i]) | set(terms[j])
                needed = set(out).union(*(terms[k] for k in range(len(terms)) if k not in (i, j)))
                kept = "".join(sorted(both & needed))
                cost = (math.prod(sizes[c] for c in both), math.prod(sizes[c] for c in kept), i, j)
                if best is None or cost < best[0]:
                    best = (cost, i, j, kept)
        _, i, j, kept = best
        steps.append((i, j, kept))
        terms = [t for k, t in enumerate(terms) if k not in (i, j)] + [kept]
    return steps
