"""Boolean trigram queries from regular expressions (built on the driver from a handful of rules).

A query is a trigram, ("and", [queries]) or ("or", [queries]); None means that any text may match. Letters are
folded to lower case, so a query never misses a match of a pattern that ignores case.
"""

from __future__ import annotations

from itertools import product
from re import _parser as parser

Query = str | tuple | None
#: Sets of literal strings are carried through a concatenation up to this many members.
MOST_STRINGS = 48


def _all(queries: list[Query]) -> Query:
    flat = []
    for q in queries:
        for x in q[1] if isinstance(q, tuple) and q[0] == "and" else [q]:
            if x is not None and x not in flat:
                flat.append(x)
    return None if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(queries: list[Query]) -> Query:
    flat = [x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])]
    if not flat or None in flat:
        return None
    needs = [frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" and all(isinstance(x, str) for x in q[1]) else frozenset([str(q)]) for q in flat]
    # A branch that needs all that another needs, and more, adds nothing.
    kept = [q for k, q in enumerate(flat) if not any(needs[j] < needs[k] or (needs[j] == needs[k] and j < k) for j in range(len(flat)))]
    return kept[0] if len(kept) == 1 else ("or", kept)


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, value) -> tuple[set[str] | None, Query]:
    """(every string that the node can match, or None when unknown; a query that each match fulfils)."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name == "IN":
        members = {chr(x).lower() for kind, x in value if str(kind) == "LITERAL"}
        return (members if all(str(kind) == "LITERAL" for kind, _ in value) and len(members) <= 8 else None), None
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        found = [_sequence(x) for x in value[1]]
        known = all(strings is not None for strings, _ in found)
        if known:
            return set().union(*(s for s, _ in found)), None
        return None, _any([_all([q, _of_strings(s) if s else None]) for s, q in found])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = value
        strings, query = _sequence(body)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), None
        return None, _all([query, _of_strings(strings) if strings else None]) if low else None
    if name == "AT":
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    known, queries = True, []
    for op, value in nodes:
        strings, query = _node(op, value)
        queries.append(query)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        known = False
        queries.append(_of_strings(run))
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    return (run, _all(queries)) if known else (None, _all([*queries, _of_strings(run)]))


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of ``pattern`` fulfils."""
    strings, query = _sequence(parser.parse(pattern))
    return _all([query, _of_strings(strings)]) if strings else query


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))
