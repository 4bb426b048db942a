"""Boolean trigram queries from regular expressions.

The query of an expression is an OR of ANDs of trigrams that every match
contains, in lower case; an AND of nothing means that any text may match. It is
found by keeping, for a part of the expression, the exact strings that it
matches, as long as they are few, and otherwise the query alone.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Exact strings kept for a part of an expression, and ANDs kept in a query, at most; beyond that the part says less.
MOST = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _simplest(q: Query) -> Query:
    """Without the ANDs that a shorter one implies."""
    kept = [a for a in q if not any(b < a for b in q)]
    return frozenset(kept) if len(kept) <= MOST else ANY


def _and(a: Query, b: Query) -> Query:
    return _simplest(frozenset(x | y for x in a for y in b))


def _trigrams(strings: frozenset[str]) -> Query:
    return _simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _part(op, value) -> tuple[frozenset[str] | None, Query]:
    """(the exact strings of a part, or None; what else its matches contain)."""
    if op is C.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is C.IN and value[0][0] is not C.NEGATE:
        chars = set()
        for kind, x in value:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return _sequence(value[-1])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return frozenset().union(*[s for s, _ in parts]), ANY
        return None, _simplest(frozenset().union(*[_and(q, _trigrams(s) if s is not None else ANY) for s, q in parts]))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == 0:
            return None, ANY
        if low == high and strings is not None and len(strings) ** low <= MOST:
            out = frozenset([""])
            for _ in range(low):
                out = frozenset(a + b for a in out for b in strings)
            return out, ANY
        return None, query if strings is None else _trigrams(strings)
    if op is C.AT:
        return frozenset([""]), ANY
    return None, ANY


def _sequence(parts) -> tuple[frozenset[str] | None, Query]:
    exact, whole, query = frozenset([""]), True, ANY
    for op, value in parts:
        strings, more = _part(op, value)
        query = _and(query, more)
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = frozenset(a + b for a in exact for b in strings)
            continue
        query, whole = _and(query, _trigrams(exact)), False
        exact = strings if strings is not None else frozenset([""])
    if whole:
        return exact, query
    return None, _and(query, _trigrams(exact))


def trigram_query(pattern: str) -> Query:
    """The query of pattern; ANY if it has no mandatory trigram."""
    exact, query = _sequence(_parser.parse(pattern))
    return _and(query, _trigrams(exact)) if exact is not None else query
