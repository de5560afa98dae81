"""Weighted finite-state transducers over the tropical semiring: weights add along a path, the least path wins."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

#: The empty label, and the one that stands for every label that its state has no other arc for; as an output it is the
#: label that was read.
EPSILON, PASS = "", None


@dataclass
class Wfst:
    """arcs: state -> (input, output, weight, next state); finals: state -> weight."""

    start: Hashable = 0
    arcs: dict = field(default_factory=dict)
    finals: dict = field(default_factory=dict)

    def add(self, state, label, out, weight: float, then) -> None:
        self.arcs.setdefault(state, []).append((label, out, weight, then))

    def by_input(self) -> dict:
        """state -> input -> [(output, weight, next state)]"""
        return {s: _group(arcs) for s, arcs in self.arcs.items()}


def _group(arcs) -> dict:
    found: dict = {}
    for label, out, weight, then in arcs:
        found.setdefault(label, []).append((out, weight, then))
    return found


def linear(labels: Iterable) -> Wfst:
    """The acceptor of one string."""
    out, n = Wfst(), 0
    for n, x in enumerate(labels, 1):
        out.add(n - 1, x, x, 0.0, n)
    out.finals[n] = 0.0
    return out


def compose(a: Wfst, b: Wfst) -> Wfst:
    """a, then b on its output. Only states that can be reached are built; paths that differ in the order of empty
    moves alone have equal weights, which an idempotent semiring allows. An arc of a that passes its label on meets all
    of b's arcs but those of labels that a's state names."""
    out, table = Wfst((a.start, b.start)), b.by_input()
    todo, seen = [out.start], {out.start}
    while todo:
        p, q = state = todo.pop()
        if p in a.finals and q in b.finals:
            out.finals[state] = a.finals[p] + b.finals[q]
        moves = [(EPSILON, o, w, (p, then)) for o, w, then in table.get(q, {}).get(EPSILON, ())]
        named = {arc[0] for arc in a.arcs.get(p, ())}
        for label, mid, weight, then in a.arcs.get(p, ()):
            if label is PASS and mid is PASS:
                moves += [(x, o, weight + w, (then, r)) for x, found in table.get(q, {}).items() if x is PASS or x != EPSILON and x not in named for o, w, r in found]
            elif mid == EPSILON:
                moves.append((label, EPSILON, weight, (then, q)))
            else:
                moves += [(label, o, weight + w, (then, r)) for o, w, r in table.get(q, {}).get(mid, ())]
        for label, o, weight, then in moves:
            out.add(state, label, o, weight, then)
            if then not in seen:
                seen.add(then)
                todo.append(then)
    return out


def renumbered(a: Wfst, names: dict | None = None) -> Wfst:
    """The same transducer with states 0, 1, ...; names: numbers that are given."""
    name = dict(names or {a.start: 0})
    out = Wfst(name[a.start])
    for s, arcs in a.arcs.items():
        for label, o, w, then in arcs:
            out.add(name.setdefault(s, len(name)), label, o, w, name.setdefault(then, len(name)))
    out.finals = {name[s]: w for s, w in a.finals.items() if s in name}
    return out


class Segmenter:
    """A transducer that reads one entry of a lexicon after another, as tables: behind each entry an empty move emits its
    name at the entry's weight and leads back to the state home; the arc PASS of home reads any other label as OTHER."""

    def __init__(self, a: Wfst, home: int):
        size = max([a.start, home, *a.arcs, *(then for arcs in a.arcs.values() for *_, then in arcs)]) + 1
        self.start, self.home, self.other = a.start, home, float("inf")
        #: state -> label -> (the state behind it, the entry that ends there, its weight)
        self.step: list[dict] = [{} for _ in range(size)]
        ends: list[tuple] = [(None, 0.0)] * size
        for state, arcs in a.arcs.items():
            for label, out, weight, then in arcs:
                if label is PASS:
                    self.other = weight
                elif label == EPSILON and out != EPSILON:
                    ends[state] = (out, weight)
                else:
                    self.step[state][label] = then
        for table in self.step:
            for label, then in table.items():
                table[label] = (then, *ends[then])

    def shortest(self, labels, start: int, before: int, other: int, pairs: dict, admits) -> list[tuple[int, int, int]]:
        """The least path through linear(labels), this transducer and a pair acceptor, as (entry, begin, end).

        The composition is walked in the order of places; its states between entries are (place, last entry), and of each the
        least weight and where it came from are kept. pairs and admits are the acceptor: which entries may follow
        another, as far as known, and by asking. before stands before the first entry."""
        step, home, size = self.step, self.home, len(labels)
        first = step[home]
        last: list[int | None] = [None] * (size + 1)
        weight, begin = [0.0] * (size + 1), [0] * (size + 1)
        back: list[int | None] = [None] * (size + 1)
        more: dict[int, list[tuple[float, int, int, int]]] = {}  # further states of a place, where there are any
        last[0] = before

        def rival(at: int, entry: int, total: float, i: int, of: int) -> None:
            """A path to a place that may have others: the lesser of the same state, or a state more."""
            if last[at] is None:
                last[at], weight[at], begin[at], back[at] = entry, total, i, of
            elif entry == last[at]:
                if total < weight[at]:
                    weight[at], begin[at], back[at] = total, i, of
            else:
                more[at] = [*(x for x in more.get(at, ()) if x[1] != entry), min([*(x for x in more.get(at, ()) if x[1] == entry), (total, entry, i, of)])]

        none: dict = {}
        for i in range(size):
            state, of, total = start if i == 0 else home, last[i], weight[i]
            if of is None:
                continue
            known, rest = pairs.get(of, none), more.get(i, ()) if more else ()
            for j in range(i, size):
                arc = step[state].get(labels[j])
                if arc is None:
                    break
                state, entry, cost = arc
                if entry is None:
                    continue
                ok = known.get(entry)
                if ok or ok is None and admits(of, entry):
                    if last[j + 1] is None:
                        last[j + 1], weight[j + 1], begin[j + 1], back[j + 1] = entry, total + cost, i, of
                    else:
                        rival(j + 1, entry, total + cost, i, of)
                for extra, entry_of, _, _ in rest:
                    if admits(entry_of, entry):
                        rival(j + 1, entry, extra + cost, i, entry_of)
            if last[i + 1] is None or labels[i] not in first and labels[i] != EPSILON:
                for extra, entry_of in [(total, of), *((x[0], x[1]) for x in rest)]:
                    rival(i + 1, other, extra + self.other, i, entry_of)
        out, place, entry = [], size, last[size]
        if not more:  # one state at each place, as a byte-pair model has
            while place:
                out.append((last[place], begin[place], place))
                place = begin[place]
            return out[::-1]
        _, entry = min([(weight[size], entry), *((x[0], x[1]) for x in more.get(size, ()))])
        while place:
            if entry == last[place]:
                i, of = begin[place], back[place]
            else:
                i, of = next((x[2], x[3]) for x in more[place] if x[1] == entry)
            out.append((entry, i, place))
            place, entry = i, of
        return out[::-1]


def shortest_path(a: Wfst) -> tuple[float, list] | None:
    """Weight and outputs of the least path, weights being non-negative; None without a path."""
    best, heap, n = {a.start: 0.0}, [(0.0, 0, a.start, None)], 0
    done: dict = {}
    while heap:
        weight, _, state, back = heapq.heappop(heap)
        if state in done:
            continue
        done[state] = back
        if state is None:
            outputs, back = [], done[None]
            while back is not None:
                state, o = back
                if o != EPSILON:
                    outputs.append(o)
                back = done[state]
            return weight, outputs[::-1]
        moves = [(o, w, then) for _, o, w, then in a.arcs.get(state, ())]
        if state in a.finals:
            moves.append((EPSILON, a.finals[state], None))
        for o, w, then in moves:
            if then not in done and weight + w < best.get(then, float("inf")):
                best[then] = weight + w
                n += 1
                heapq.heappush(heap, (weight + w, n, then, (state, o)))
    return None
