"""Probabilistic automata inferred from example strings by state merging.

The examples form a prefix tree with counts. States are then folded together, shallowest
first, where their continuation frequencies are statistically compatible (Hoeffding's bound,
checked for their successors as well), until only incompatible states remain.
"""

from __future__ import annotations

import math
from collections import Counter, deque

#: Symbols: how a character enters the automata. Vowels differ from consonants, and hexadecimal digits from other letters.
CLASSES = {c: k for k, own in {"0": "0123456789", "a": "ae", "b": "bcdf", "i": "iouy", "g": "ghjklmnpqrstvwxz"}.items() for c in own}
CLASSES |= {c.upper(): k.upper() for c, k in CLASSES.items() if c.isalpha()}
#: How many characters each symbol stands for.
WIDTH = Counter(CLASSES.values())


def symbols(text: str) -> str:
    return "".join([CLASSES.get(c, c) for c in text])


class Automaton:
    """Deterministic, with counts on transitions and stops; an alphabet size for what was never seen."""

    def __init__(self, arcs: list[dict[str, tuple[int, int]]], stops: list[int]):
        self.arcs, self.stops = arcs, stops
        self.totals = [sum(n for _, n in a.values()) + s for a, s in zip(arcs, stops, strict=True)]

    def log10(self, text: str, smoothing: float = 0.01, alphabet: int = 70) -> float:
        """The log10 probability of exactly this string; a step that was never seen ends in state 0 at a small share."""
        state, out = 0, 0.0
        for c in symbols(text):
            to, n = self.arcs[state].get(c, (0, 0))
            out += math.log10((n + smoothing) / (self.totals[state] + smoothing * alphabet) / WIDTH.get(c, 1))
            state = to
        return out + math.log10((self.stops[state] + smoothing) / (self.totals[state] + smoothing * alphabet))


def infer(examples: list[str], alpha: float = 0.01) -> Automaton:
    """Merges the prefix tree of the examples (each counts once for every time it is listed).

    Every arc has a count of its own: after a merge a state is reached by several, so its total is no arc's frequency.
    """
    arcs: list[dict[str, list[int]]] = [{}]
    count, stop = [0], [0]
    for text in examples:
        s = 0
        count[0] += 1
        for c in symbols(text):
            if c not in arcs[s]:
                arcs[s][c] = [len(arcs), 0]
                arcs.append({})
                count.append(0)
                stop.append(0)
            arcs[s][c][1] += 1
            s = arcs[s][c][0]
            count[s] += 1
        stop[s] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differs(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if differs(stop[x], count[x], stop[y], count[y]):
                return False
            for c in arcs[x].keys() | arcs[y].keys():
                p, q = arcs[x].get(c), arcs[y].get(c)
                if differs(p[1] if p else 0, count[x], q[1] if q else 0, count[y]):
                    return False
                if p and q:
                    todo.append((p[0], q[0]))
        return True

    def fold(red: int, blue: int) -> None:
        """Adds the tree at blue to red; blue is a tree, so this ends."""
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            count[x] += count[y]
            stop[x] += stop[y]
            for c, (q, n) in arcs[y].items():
                if c in arcs[x]:
                    arcs[x][c][1] += n
                    todo.append((arcs[x][c][0], q))
                else:
                    arcs[x][c] = [q, n]

    kept, blue = [0], deque(sorted((c, q) for c, (q, _) in arcs[0].items()))
    parents = {q: (0, c) for c, (q, _) in arcs[0].items()}
    while blue:
        _, b = blue.popleft()
        if b not in parents or b in kept:
            continue
        target = next((r for r in kept if compatible(r, b)), None)
        source, c = parents.pop(b)
        if target is None:
            kept.append(b)
        else:
            arcs[source][c][0] = target
            fold(target, b)
        inside = set(kept)
        for r in kept:
            for s, (q, _) in sorted(arcs[r].items()):
                if q not in inside and q not in parents:
                    parents[q] = (r, s)
                    blue.append((s, q))
    number = {s: i for i, s in enumerate(kept)}
    return Automaton([{c: (number[q], n) for c, (q, n) in arcs[s].items()} for s in kept], [stop[s] for s in kept])
