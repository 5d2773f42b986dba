"""Secret rules and the Boolean trigram queries derived from their regexes.

Derivation (after the published approach to regex search with a trigram index):
walk the parsed regex keeping, for each part, the exact strings it can be while
these are few; where they stop being known, their trigrams become a condition:
every trigram of a string (AND), for one of the strings (OR).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as codes  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

#: Exact strings kept while walking; beyond it they are turned into conditions.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` code points, else the match is dropped; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in their listed order, then further public token formats.
#: A greedy run of one class can state its least length in the regex: a run that is too
#: short holds no start of a longer one. For "assign" it can't: a match that is dropped still
#: uses up its text.
RULES = (
    Rule("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
                   r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
BASE_KINDS = ("assign", "access", "hex")

#: A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple[str, frozenset]


def _combine(op: str, parts: list[Query]) -> Query:
    absorbing = op == "or"
    flat: set[Query] = set()
    for part in parts:
        if part is True:
            if absorbing:
                return True
            continue
        if isinstance(part, tuple) and part[0] == op:
            flat |= part[1]
        else:
            flat.add(part)
    if absorbing:  # "A or (A and B)" is "A"
        terms = {x: x[1] if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in flat}
        flat = {x for x in flat if not any(terms[y] < terms[x] for y in flat)}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _condition(strings: set[str]) -> Query:
    return _combine("or", [_combine("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(items: object) -> tuple[set[str] | None, Query]:
    """(exact strings or None, condition) of a sequence; letters are folded to lower case."""
    exact: set[str] | None = {""}
    found: list[Query] = []
    for op, arg in items:  # type: ignore[attr-defined]
        own, condition = _one(op, arg)
        found.append(condition)
        if own is not None and exact is not None and len(own) * len(exact) <= MAX_EXACT:
            exact = {a + b for a in exact for b in own}
            continue
        if exact is not None:
            found.append(_condition(exact))
        exact = None if own is None else own
        if own is None:  # what follows starts anew, and the whole isn't exact any more
            rest, condition = _walk_rest(items, op, arg)
            return None, _combine("and", [*found, condition] if rest is None else [*found, condition, _condition(rest)])
        found.append(True)
    return exact, _combine("and", found)


def _walk_rest(items: object, op: object, arg: object) -> tuple[set[str] | None, Query]:
    listed = list(items)  # type: ignore[call-overload]
    at = next(i for i, x in enumerate(listed) if x[0] is op and x[1] is arg)
    return _walk(listed[at + 1:])


def _one(op: object, arg: object) -> tuple[set[str] | None, Query]:
    if op is codes.LITERAL:
        return {chr(arg).lower()}, True  # type: ignore[arg-type]
    if op is codes.IN:
        if all(x[0] is codes.LITERAL for x in arg):  # type: ignore[attr-defined]
            chars = {chr(x[1]).lower() for x in arg}  # type: ignore[attr-defined]
            return (chars, True) if len(chars) <= 8 else (None, True)
        return None, True
    if op is codes.SUBPATTERN:
        return _walk(arg[-1])  # type: ignore[index]
    if op is codes.BRANCH:
        own = [_walk(x) for x in arg[1]]  # type: ignore[index]
        whole = [x[0] for x in own]
        if all(x is not None for x in whole) and len(joined := set().union(*whole)) <= MAX_EXACT:  # type: ignore[arg-type]
            return joined, True
        return None, _combine("or", [c if s is None else _combine("and", [c, _condition(s)]) for s, c in own])
    if op is codes.MAX_REPEAT:
        low, high, inner = arg  # type: ignore[misc]
        own, condition = _walk(inner)
        if (low, high) == (0, 1) and own is not None:
            return own | {""}, True
        if low == 0:
            return None, True
        return None, condition if own is None else _combine("and", [condition, _condition(own)])
    return None, True


def trigram_query(pattern: str) -> Query:
    """The condition on lower-cased trigrams that every text with a match meets; True if there is none."""
    exact, condition = _walk(parser.parse(pattern))
    return condition if exact is None else _combine("and", [condition, _condition(exact)])


def trigrams_of(query: Query) -> set[str]:
    """All trigrams that ``query`` names."""
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams_of(x) for x in query[1]))  # type: ignore[index]


def check_rule(rule: Rule) -> None:
    """Raise unless ``rule`` is usable: a plain kind name and a regex that cannot match nothing."""
    if not re.fullmatch(r"[a-z_]+", rule.kind) or re.fullmatch(rule.pattern, ""):
        raise ValueError(f"rule {rule.kind!r} has a bad name or matches the empty text")
