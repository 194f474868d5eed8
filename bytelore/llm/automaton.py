"""Byte automata: expressions over byte classes, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from collections.abc import Iterable

Node = tuple


def chars(text: str | bytes | Iterable[int]) -> Node:
    """One byte out of a set."""
    return ("set", frozenset(text.encode() if isinstance(text, str) else text))


def word(text: str, any_case: bool = False) -> Node:
    return seq(*(chars({*c.encode()} | ({*c.lower().encode(), *c.upper().encode()} if any_case else set())) for c in text))


def seq(*parts: Node) -> Node:
    return ("seq", parts)


def alt(*parts: Node) -> Node:
    return ("alt", parts)


def star(part: Node) -> Node:
    return ("star", part)


def maybe(part: Node) -> Node:
    return alt(part, seq())


def plus(part: Node) -> Node:
    return seq(part, star(part))


def at_least(part: Node, n: int) -> Node:
    return seq(*[part] * n, star(part))


def turned(node: Node) -> Node:
    """The expression of the reversed strings."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "star":
        return ("star", turned(node[1]))
    parts = tuple(turned(x) for x in node[1])
    return (kind, parts[::-1] if kind == "seq" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, node: Node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.new()
            self.moves[start] = (node[1], end)
            return end
        if kind == "seq":
            for part in node[1]:
                inner = self.new()
                self.empty[start].append(inner)
                start = self.build(part, inner)
            return start
        end = self.new()
        for part in node[1] if kind == "alt" else [node[1]]:
            inner = self.new()
            self.empty[start].append(inner)
            self.empty[self.build(part, inner)].append(inner if kind == "star" else end)
            if kind == "star":
                self.empty[inner].append(end)
        return end


class Automaton:
    """Deterministic automaton of several rules at once.

    `rows[state][byte]` is the next state; states from `first_accepting` on accept, `accepts[state]` lists the rules.
    With `anywhere`, a rule accepts at each position where one of its strings ends; else strings begin at the start.
    """

    def __init__(self, rules: list[Node], anywhere: bool):
        nfa = _Nfa()
        start = nfa.new()
        ends = {}
        for k, rule in enumerate(rules):
            inner = nfa.new()
            nfa.empty[start].append(inner)
            ends[nfa.build(rule, inner)] = k
        if anywhere:
            again = nfa.new()
            nfa.moves[again] = (frozenset(range(256)), start)
            nfa.empty[start].append(again)

        def close(states: Iterable[int]) -> frozenset[int]:
            found, todo = set(states), list(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in found:
                        found.add(x)
                        todo.append(x)
            return frozenset(x for x in found if nfa.moves[x] or x in ends)

        first = close([start])
        names, todo, table = {first: 0}, [first], []
        while todo:
            here = todo.pop()
            by_byte: list[list[int]] = [[] for _ in range(256)]
            for x in here:
                if nfa.moves[x]:
                    for b in nfa.moves[x][0]:
                        by_byte[b].append(nfa.moves[x][1])
            row, known = [0] * 256, {}
            for b, to in enumerate(by_byte):
                key = tuple(to)
                if key not in known:
                    there = close(to)
                    if there not in names:
                        names[there] = len(names)
                        todo.append(there)
                    known[key] = names[there]
                row[b] = known[key]
            table.append((names[here], row))
        rows = [row for _, row in sorted(table)]
        accepts = [()] * len(names)
        for states, k in names.items():
            accepts[k] = tuple(sorted({ends[x] for x in states if x in ends}))
        self._minimise(rows, accepts)

    def _minimise(self, rows: list[list[int]], accepts: list[tuple[int, ...]]) -> None:
        """Moore's refinement of classes of states, then numbering: plain states first, accepting ones last."""
        kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        group = [kinds[a] for a in accepts]
        distinct = list(dict.fromkeys(zip(*rows, strict=True)))  # bytes that no state tells apart are one column
        while True:
            seen: dict[tuple, int] = {}
            refined = [seen.setdefault((group[s], *(group[c[s]] for c in distinct)), len(seen)) for s in range(len(rows))]
            if len(seen) == len(set(group)):
                break
            group = refined
        one = {g: s for s, g in reversed(list(enumerate(group)))}
        order = sorted(one, key=lambda g: (bool(accepts[one[g]]), g != group[0], g))
        number = {g: i for i, g in enumerate(order)}
        self.rows = [[number[group[t]] for t in rows[one[g]]] for g in order]
        self.accepts = [accepts[one[g]] for g in order]
        self.first_accepting = sum(not a for a in self.accepts)
        self.start = number[group[0]]
        self.dead = next((i for i, (row, a) in enumerate(zip(self.rows, self.accepts, strict=True)) if not a and set(row) == {i}), -1)

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(position, state) after each byte where some rule accepts."""
        rows, first, found = self.rows, self.first_accepting, []
        row, put = rows[self.start], found.append
        state = self.start
        for at, byte in enumerate(data, 1):
            state = rows[state][byte]
            if state >= first:
                put((at, state))
        return found

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest string that begins at `at`, or -1."""
        rows, first, dead = self.rows, self.first_accepting, self.dead
        state, best = self.start, at if self.start >= first else -1
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if state >= first:
                best = i + 1
            elif state == dead:
                break
        return best
