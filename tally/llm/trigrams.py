"""Boolean trigram queries from regular expressions.

A query is an AND of clauses, a clause an OR of alternatives, an alternative a set of
trigrams that must all be present. Every text that the expression matches satisfies its
query; an empty query says nothing, and the rule has to scan fully.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

MAX_STRINGS = 64

Query = list[list[frozenset[str]]]


def grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _cross(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _exact(items) -> set[str] | None:
    """All strings that a sequence matches, if they are few."""
    strings = {""}
    for op, arg in items:
        part = _exact_one(op, arg)
        if part is None or len(strings) * len(part) > MAX_STRINGS:
            return None
        strings = _cross(strings, part)
    return strings


def _exact_one(op, arg) -> set[str] | None:
    if op is K.LITERAL:
        return {chr(arg)}
    if op is K.IN and len(arg) <= 8 and all(o is K.LITERAL for o, _ in arg):
        return {chr(a) for _, a in arg}
    if op is K.SUBPATTERN:
        return _exact(arg[3])
    if op is K.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1 and (inner := _exact(arg[2])) is not None:
        return inner | {""} if arg[0] == 0 else inner
    return None


def _query(items) -> Query:
    clauses: Query = []
    strings = {""}

    def flush() -> None:
        nonlocal strings
        if all(len(s) > 2 for s in strings):
            clauses.append(sorted({grams(s) for s in strings}, key=sorted))
        strings = {""}

    for op, arg in items:
        part = _exact_one(op, arg)
        if part is not None and len(strings) * len(part) <= MAX_STRINGS:
            strings = _cross(strings, part)
            continue
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            inner = _exact(arg[2])
            if inner is not None and len(strings) * len(inner) <= MAX_STRINGS:
                strings = _cross(strings, inner)
            else:
                clauses.extend(_query(arg[2]))
        elif op is K.SUBPATTERN:
            clauses.extend(_query(arg[3]))
        elif op is K.BRANCH:
            queries = [_query(x) for x in arg[1]]
            if all(queries):
                clauses.append([alternative for q in queries for alternative in q[0]])
        flush()
    flush()
    return clauses


def query(pattern: str) -> Query:
    """The trigram query of a pattern, over lower-cased text."""
    lower = [[frozenset(t.lower() for t in alternative) for alternative in clause] for clause in _query(_parser.parse(pattern, re.ASCII))]
    return [sorted(set(clause), key=sorted) for clause in lower]
