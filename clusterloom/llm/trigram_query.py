"""Boolean trigram queries that a regular expression implies.

A query is ('all',) (every text may match), ('gram', t), ('and', ...) or
('or', ...). A text that matches the expression satisfies the query, so texts
that don't satisfy it need not be scanned. Expressions are read by Python's
own parser; grams are lower-case, for an index of lower-cased texts.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

#: Strings that a part may be expanded to before it is taken as unknown.
MOST = 64
ALL = ("all",)


def both(kind: str, parts: list[tuple]) -> tuple:
    """Simplified 'and' or 'or' of queries."""
    flat = []
    for p in parts:
        for q in p[1:] if p[0] == kind else (p,):
            if q == ALL:
                if kind == "or":
                    return ALL
            elif q not in flat:
                flat.append(q)
    if kind == "or":  # A or (A and B) is A
        sets = [set(q[1:]) if q[0] == "and" else {q} for q in flat]
        flat = [q for q, own in zip(flat, sets, strict=True) if not any(other < own for other in sets)]
    if not flat:
        return ALL
    return flat[0] if len(flat) == 1 else (kind, *flat)


def of_strings(strings: set[str]) -> tuple:
    """Query of 'one of these strings occurs'."""
    return both("or", [both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else ALL


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < 16:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len({c.lower() for c in out}) <= 8 else None


class _Walker:
    """Walks a sequence, keeping the possible strings since the last unknown part."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.known: set[str] = {""}

    def cut(self) -> None:
        self.parts.append(of_strings(self.known))
        self.known = {""}

    def extend(self, strings: set[str] | None) -> None:
        if strings is None:
            self.cut()
            return
        joined = {a + b for a, b in product(self.known, strings)}
        if len(joined) > MOST:
            self.cut()
            joined = strings if len(strings) <= MOST else {""}
        self.known = joined

    def result(self) -> tuple:
        self.cut()
        return both("and", self.parts)


def _strings(tree) -> set[str] | None:
    """All strings of a part if it is short and finite, else None."""
    out = {""}
    for op, value in tree:
        if op is C.LITERAL:
            own: set[str] | None = {chr(value).lower()}
        elif op is C.IN:
            own = _class(value)
            own = own and {c.lower() for c in own}
        elif op is C.SUBPATTERN:
            own = _strings(value[3])
        elif op is C.BRANCH:
            found = [_strings(b) for b in value[1]]
            own = None if None in found else set().union(*found)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[1] <= 3:
            one = _strings(value[2])
            own = one if one is None else set().union(*({"".join(p) for p in product(one, repeat=n)} for n in range(value[0], value[1] + 1)))
        elif op is C.AT:
            own = {""}
        else:
            own = None
        if not own:
            return None
        out = {a + b for a, b in product(out, own)}
        if len(out) > MOST:
            return None
    return out


def _walk(tree, walker: _Walker) -> None:
    for node in tree:
        op, value = node
        whole = _strings([node])
        if whole is not None:
            walker.extend(whole)
        elif op is C.SUBPATTERN:
            _walk(value[3], walker)
        elif op is C.BRANCH:
            walker.cut()
            found = []
            for branch in value[1]:
                inner = _Walker()
                _walk(branch, inner)
                found.append(inner.result())
            walker.parts.append(both("or", found))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            if value[0]:
                first = _strings(value[2])
                if first is not None:
                    for _ in range(min(value[0], 40)):  # mandatory copies, then an unknown rest
                        walker.extend(first)
                else:
                    _walk(value[2], walker)
            walker.cut()
        else:
            walker.cut()


def trigram_query(pattern: str) -> tuple:
    walker = _Walker()
    _walk(_parser.parse(pattern), walker)
    return walker.result()


def grams(query: tuple) -> set[str]:
    """All trigrams of a query."""
    if query[0] == "gram":
        return {query[1]}
    return set().union(*map(grams, query[1:])) if len(query) > 1 else set()
