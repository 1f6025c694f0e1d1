"""Boolean trigram queries from regular expressions.

A query is a tuple of clauses, all of which must hold; a clause is a set of conjunctions, one of
which must hold; a conjunction is a set of trigrams, all of which must occur in the lower-cased
text. Every text that the regex matches satisfies the query; the empty query asks for nothing, so
its rule has to scan every text.

A part of a regex is described by the strings it may match, if these are few (``exact``), or else
by what its matches begin and end with, and by the query that they satisfy. Parts are joined from
left to right; strings that grow too many or too long leave their trigrams in the query and keep
their ends. What is not understood (a character class of many members, a back reference, another
engine's syntax) counts as any text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

Clause = frozenset[frozenset[str]]
Query = tuple[Clause, ...]

#: Members of a class, strings of a set, characters of an exact string and clauses of a query, at most.
CLASS, STRINGS, CHARS, CLAUSES = 16, 48, 24, 24


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query = ()


ANYTHING = Part(None, frozenset([""]), frozenset([""]))
NOTHING = Part(frozenset([""]), frozenset([""]), frozenset([""]))


def literal(strings: set[str]) -> Part:
    s = frozenset(strings)
    return Part(s, s, s)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def reduced(clause: Clause) -> Clause:
    """Without conjunctions that hold only where another one does."""
    return frozenset(c for c in clause if not any(o < c for o in clause))


def both(a: Query, b: Query) -> Query:
    out = [c for c in dict.fromkeys(a + b)]
    return tuple(c for c in out if not any(o != c and all(any(x <= y for x in c) for y in o) for o in out))[:CLAUSES]


def either(a: Query, b: Query) -> Query:
    """Every clause of the one or every clause of the other; clauses past the bound only narrow less."""
    return both(tuple(reduced(x | y) for x, y in product(a, b)), ())


def one_of(strings: frozenset[str]) -> Query:
    """Some of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return ()
    return (reduced(frozenset(trigrams(s) for s in strings)),)


def few(strings: frozenset[str], keep) -> frozenset[str]:
    """The strings cut by ``keep`` (a length to a cut) to two characters or fewer, until they are few."""
    for n in (2, 1, 0):
        cut = frozenset(keep(s, n) for s in strings)
        if len(cut) <= STRINGS:
            return cut
    return frozenset([""])


def head(s: str, n: int) -> str:
    return s[:n]


def tail(s: str, n: int) -> str:
    return s[len(s) - n :] if n < len(s) else s


def opened(p: Part) -> Part:
    """The part without its exact strings: their trigrams are in its query."""
    if p.exact is None:
        return p
    return Part(None, few(p.exact, head), few(p.exact, tail), both(p.query, one_of(p.exact)))


def held(p: Part) -> Part:
    """The part, opened if its strings are too many or too long."""
    if p.exact is not None and (len(p.exact) > STRINGS or max(map(len, p.exact), default=0) > CHARS):
        return opened(p)
    return p


def crossed(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def after(a: Part, b: Part) -> Part:
    """``a`` and then ``b``."""
    if a.exact is not None and b.exact is not None:
        return held(Part(s := crossed(a.exact, b.exact), s, s, both(a.query, b.query)))
    left, right = a.exact or a.ends, b.exact or b.begins
    met = crossed(left, right) if len(left) * len(right) <= STRINGS * STRINGS else frozenset([""])
    query = both(both(a.query, b.query), one_of(met))
    begins = few(crossed(a.exact, b.begins), head) if a.exact is not None else a.begins
    ends = few(crossed(a.ends, b.exact), tail) if b.exact is not None else b.ends
    for p in (a, b):
        if p.exact is not None:
            query = both(query, one_of(p.exact))
    return Part(None, begins, ends, query)


def choice(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        return held(Part(s := a.exact | b.exact, s, s, either(a.query, b.query)))
    a, b = opened(a), opened(b)
    return Part(None, few(a.begins | b.begins, head), few(a.ends | b.ends, tail), either(a.query, b.query))


def members(items: list) -> set[str] | None:
    """The characters of a class, lower-cased; None if they are many or not plain."""
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg))
        elif name == "RANGE" and arg[1] - arg[0] < 4 * CLASS:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    out = {c.lower() for c in out}
    return out if len(out) <= CLASS and all(c.isascii() for c in out) else None


def part_of(tree) -> Part:
    return reduce(after, (node(op, arg) for op, arg in tree), NOTHING)


def node(op, arg) -> Part:
    name = str(op)
    if name == "LITERAL":
        return literal({chr(arg).lower()}) if arg < 128 else ANYTHING
    if name == "IN":
        found = members(arg)
        return ANYTHING if found is None else literal(found)
    if name == "SUBPATTERN":
        return part_of(arg[3])
    if name == "ATOMIC_GROUP":
        return part_of(arg)
    if name == "BRANCH":
        return reduce(choice, map(part_of, arg[1]))
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return NOTHING
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        one = part_of(inner)
        if least == 0:
            return choice(NOTHING, one) if most == 1 else ANYTHING
        out = reduce(after, [one] * min(least, CHARS))
        return out if least == most and least <= CHARS else after(after(opened(out), ANYTHING), Part(None, frozenset([""]), opened(one).ends))
    return ANYTHING


def query_of(pattern: str) -> Query:
    """The query that every match of ``pattern`` satisfies; () where nothing is certain."""
    from re import _parser

    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError):
        return ()
    return opened(part_of(tree)).query


def vocabulary(queries: list[Query]) -> list[str]:
    return sorted({t for q in queries for clause in q for conjunction in clause for t in conjunction})
