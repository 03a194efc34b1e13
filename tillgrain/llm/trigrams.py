"""Boolean trigram queries of regular expressions.

``clauses(regex)`` gives a list of trigram sets: every match holds, lower-cased, all trigrams of at least one
of them. None means that no trigram is mandatory, so an index can't narrow the search.
"""

from __future__ import annotations

import itertools


try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as codes
    import sre_parse as parser

#: A set of possible strings is followed up to this many members, a query up to this many clauses.
MOST_STRINGS, MOST_CLAUSES = 64, 64


def clauses(regex: str) -> list[frozenset[str]] | None:
    whole = _Walk()
    whole.sequence(parser.parse(regex))
    whole.flush()
    return sorted(_minimal(whole.query), key=sorted) if whole.query is not None else None


def _minimal(query: set[frozenset[str]]) -> set[frozenset[str]]:
    return {c for c in query if not any(d < c for d in query)}


class _Walk:
    """Reads a concatenation from left to right. ``texts``: what the part read since the last break may be."""

    def __init__(self):
        self.texts: set[str] = {""}
        self.query: set[frozenset[str]] | None = None

    def both(self, other: set[frozenset[str]] | None) -> None:
        if other is None:
            return
        if self.query is None:
            self.query = other
            return
        product = _minimal({a | b for a, b in itertools.product(self.query, other)})
        if len(product) <= MOST_CLAUSES:
            self.query = product  # else the weaker query, without the new part, stays true

    def flush(self) -> None:
        if all(len(t) >= 3 for t in self.texts):
            self.both({frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in self.texts})
        self.texts = {""}

    def append(self, texts: set[str] | None) -> None:
        if texts is None:
            self.flush()
        elif len(self.texts) * len(texts) > MOST_STRINGS:
            self.flush()
            self.texts = texts
        else:
            self.texts = {a + b for a in self.texts for b in texts}

    def sequence(self, items) -> None:
        for op, value in items:
            self.item(op, value)

    def item(self, op, value) -> None:
        if op is codes.LITERAL:
            self.append({chr(value).lower()})
        elif op is codes.IN:
            self.append(_members(value))
        elif op is codes.SUBPATTERN:
            self.nested([value[-1]])
        elif op is codes.BRANCH:
            self.nested(value[1])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
            low, high, inner = value
            part = _strings(inner)
            if part is not None and high != codes.MAXREPEAT and sum(len(part) ** n for n in range(low, int(high) + 1)) <= MOST_STRINGS:
                self.append({"".join(x) for n in range(low, int(high) + 1) for x in itertools.product(part, repeat=n)})
            else:
                if low and part is not None:
                    self.append(part)  # once at least; how the rest goes on is unknown
                elif low:
                    self.nested([inner])
                self.append(None)
        elif op is not codes.AT:
            self.append(None)

    def nested(self, branches) -> None:
        sets = [_strings(b) for b in branches]
        if all(s is not None for s in sets):
            self.append(set().union(*sets))
            return
        self.flush()
        queries = []
        for b in branches:
            walk = _Walk()
            walk.sequence(b)
            walk.flush()
            queries.append(walk.query)
        if all(q is not None for q in queries):
            self.both(set().union(*queries))


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is codes.LITERAL:
            out.add(chr(value).lower())
        elif op is codes.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _strings(items) -> set[str] | None:
    """All texts that a part may be, if they are few."""
    before = {""}
    for op, value in items:
        if op is codes.LITERAL:
            before = {t + chr(value).lower() for t in before}
        elif op is codes.IN and (some := _members(value)) is not None:
            before = {t + x for t in before for x in some}
        elif op is codes.SUBPATTERN and (some := _strings(value[-1])) is not None:
            before = {t + x for t in before for x in some}
        elif op is codes.BRANCH:
            sets = [_strings(b) for b in value[1]]
            if any(s is None for s in sets):
                return None
            before = {t + x for t in before for x in set().union(*sets)}
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and value[1] != codes.MAXREPEAT and int(value[1]) <= 2 and (some := _strings(value[2])) is not None:
            before = {t + "".join(x) for t in before for n in range(value[0], int(value[1]) + 1) for x in itertools.product(some, repeat=n)}
        else:
            return None
        if len(before) > MOST_STRINGS:
            return None
    return before


def check(regex: str, text: str) -> bool:
    """Whether the query of a regex admits a text: True for every text that the regex matches in."""
    query = clauses(regex)
    low = text.lower()
    return query is None or any(all(t in low for t in c) for c in query)


