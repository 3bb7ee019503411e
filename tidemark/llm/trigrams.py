"""Which trigrams a text must hold for a regular expression to match: a Boolean query in disjunctive form.

A query is a set of conjunctions; each is a set of lower-case trigrams. The query ``{frozenset()}`` is
always true: such a rule has no mandatory trigram and scans everything.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser

Query = frozenset[frozenset[str]]
TRUE: Query = frozenset([frozenset()])
#: Strings a run of the pattern may stand for before its trigrams are taken and a new run begins.
MOST_STRINGS = 64


def _least(query: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(c for c in query if not any(o < c for o in query))


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x, y in itertools.product(a, b)))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _strings(op, arg) -> set[str] | None:
    """The strings that a node can match, if they are few and known."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _all_strings(arg[3])
    if op is sre.BRANCH:
        branches = [_all_strings(b) for b in arg[1]]
        return None if None in branches else set().union(*branches)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _all_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        inner = _strings(op, arg)
        if inner is None or len(out) * len(inner) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in inner}
    return out


def _query(nodes) -> Query:
    query, run = TRUE, {""}
    for op, arg in nodes:
        inner = _strings(op, arg)
        if inner is not None and len(run) * len(inner) <= MOST_STRINGS:
            run = {a + b for a in run for b in inner}
            continue
        query, run = _both(query, _of_strings(run)), {""}
        if inner is not None:
            run = inner
        elif op is sre.SUBPATTERN:
            query = _both(query, _query(arg[3]))
        elif op is sre.BRANCH:
            query = _both(query, _least(frozenset().union(*[_query(b) for b in arg[1]])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            query = _both(query, _query(arg[2]))
    return _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of ``pattern`` fulfils, once the text is in lower case."""
    return _query(sre_parser.parse(pattern))
