"""Probabilistic automata by state merging: a prefix tree of examples whose compatible states become one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import log, sqrt


#: Log probability of a stop in a state where no example stops, and of a length under that of all examples.
NEVER = log(1e-9)


@dataclass
class Automaton:
    """Per state: log probabilities of ending and of each symbol with the next state; floor for what was never seen.

    least, most: the lengths of the shortest and the longest example. What is shorter than all
    examples costs as much as a stop where none stops; beyond the longest each symbol costs the
    floor, if `closed`.
    """

    end: list[float]
    step: list[dict[str, tuple[float, int]]]
    floor: float = log(1e-4)
    least: int = 0
    most: int = 0
    closed: bool = False

    def loglik(self, symbols: str) -> float:
        state, total = 0, 0.0
        if len(symbols) < self.least:
            total += NEVER
        if self.closed and len(symbols) > self.most:
            total += self.floor * (len(symbols) - self.most)
        for s in symbols:
            got = self.step[state].get(s)
            if got is None:
                total += self.floor
            else:
                total += got[0]
                state = got[1]
        return total + self.end[state]


class _Tree:
    """Counts of a prefix tree; merging folds one subtree into another."""

    def __init__(self, examples: Iterable[str]):
        self.total, self.final, self.next = [0], [0], [{}]
        for x in examples:
            q = 0
            self.total[0] += 1
            for s in x:
                if s not in self.next[q]:
                    self.next[q][s] = len(self.total)
                    self.total.append(0)
                    self.final.append(0)
                    self.next.append({})
                q = self.next[q][s]
                self.total[q] += 1
            self.final[q] += 1

    def differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether the states' ends and symbols, and those of all that follows, differ by no more than chance (Hoeffding's bound)."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            if self.differ(self.final[p], n, self.final[q], m, bound):
                return False
            for s in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(s), self.next[q].get(s)
                if self.differ(self.total[x] if x is not None else 0, n, self.total[y] if y is not None else 0, m, bound):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the subtree at b to state a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.final[p] += self.final[q]
            for s, y in self.next[q].items():
                if s in self.next[p]:
                    todo.append((self.next[p][s], y))
                else:
                    self.next[p][s] = y


def infer(examples: Iterable[str], alpha: float = 0.01, strict: bool = False, closed: bool = False) -> Automaton:
    """strict: stops and lengths that no example has cost NEVER; closed: see Automaton.

    Merges states in breadth-first order: each is folded into the first kept state that it is compatible with, or is kept.
    """
    examples = sorted(examples)
    t, bound = _Tree(examples), sqrt(0.5 * log(2 / alpha))
    kept, held = [0], {0}
    while True:
        # the first edge from a kept state to one that isn't kept
        found = next(((p, s) for p in kept for s in sorted(t.next[p]) if t.next[p][s] not in held), None)
        if found is None:
            break
        p, s = found
        q = t.next[p][s]
        r = next((r for r in kept if t.compatible(r, q, bound)), None)
        if r is None:
            kept.append(q)
            held.add(q)
        else:
            t.next[p][s] = r
            t.fold(r, q)
    at = {q: i for i, q in enumerate(kept)}
    ends, uses = [0] * len(kept), [dict.fromkeys(t.next[q], 0) for q in kept]
    for x in examples:  # the merged states' probabilities
        q = 0
        for s in x:
            uses[q][s] += 1
            q = at[t.next[kept[q]][s]]
        ends[q] += 1
    sizes = [len(x) for x in examples] or [0]
    out = Automaton([], [], least=min(sizes) if strict else 0, most=max(sizes), closed=closed)
    for q, used in enumerate(uses):
        n = ends[q] + sum(used.values()) + 1.0
        out.end.append(NEVER if strict and not ends[q] else log((ends[q] + 0.01) / n))
        out.step.append({s: (log((c + 1e-3) / n), at[t.next[kept[q]][s]]) for s, c in used.items()})
    return out
