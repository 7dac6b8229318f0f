"""Literals that every match of a pattern holds, and one pass that finds those of many.

A scan with many patterns spends its time on texts that match none. A pattern such as
`union\\s+select` can only match where "union" stands, so an automaton over the literals
of all patterns leaves few of them to be tried.
"""
from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from re import _constants as kind
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters outside ASCII that equal an ASCII letter when case is ignored.
FOLDED = {0x017F: "s", 0x212A: "k", 0x0130: "i", 0x0131: "i"}
SHORTEST = 2
_REPEATS = (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT)
_NESTED_CLASS = re.compile(r"\[[^\]]*\[|&&")


def folded(text: str) -> str:
    return text.translate(FOLDED).lower()


def required(pattern: str) -> tuple[str, ...]:
    """Literals of which each match of pattern holds at least one, whatever its case.

    Empty if there are none, or if the pattern uses what Java reads in another way than
    the parser here (classes inside classes, free spacing, escapes of Java's own).
    """
    parsed = _parsed(pattern)
    return tuple(sorted(_best(parsed, SHORTEST))) if parsed else ()


def all_required(pattern: str) -> list[tuple[str, ...]]:
    """Every such set that the pattern names, down to single characters: a match holds a
    literal of each. Sets with few and long literals stand first."""
    parsed = _parsed(pattern)
    found = {s for s in _sets(parsed, 1) if s and all(s)} if parsed else ()
    return [tuple(sorted(s)) for s in sorted(found, key=lambda s: (len(s), -min(map(len, s)), sorted(s)))]


def _parsed(pattern: str):
    if _NESTED_CLASS.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = parser.parse(pattern, re.IGNORECASE)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return None if parsed.state.flags & re.VERBOSE else parsed


def _best(items, shortest: int) -> frozenset[str]:
    """The set of alternatives whose shortest literal is the longest."""
    usable = [s for s in _sets(items, shortest) if s and min(map(len, s)) >= shortest]
    return max(usable, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def _sets(items, shortest: int) -> list[frozenset[str]]:
    """The sets of alternatives of consecutive items."""
    sets, run = [], ""
    for op, arg in items:
        if op is kind.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        sets.append(frozenset([run]))
        run = ""
        if op is kind.SUBPATTERN:
            sets += _sets(arg[-1], shortest)
        elif op is kind.ATOMIC_GROUP:
            sets += _sets(arg, shortest)
        elif op in _REPEATS and arg[0] > 0:
            sets += _sets(arg[2], shortest)
        elif op is kind.IN and all(o is kind.LITERAL and a < 128 for o, a in arg):
            sets.append(frozenset(chr(a).lower() for _, a in arg))
        elif op is kind.BRANCH:
            parts = [_best(branch, shortest) for branch in arg[1]]
            if all(parts):
                sets.append(frozenset().union(*parts))
    sets.append(frozenset([run]))
    return sets


def folded_text(text: Column) -> Column:
    """What `folded` gives, as an expression."""
    letters, plain = "".join(map(chr, FOLDED)), "".join(FOLDED.values())
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, letters, plain)))


def may_match(text: Column, pattern: str) -> Column | None:
    """False for a folded text that lacks a literal which pattern requires; None if it requires none."""
    out = None
    for words in all_required(pattern):
        held = reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
        out = held if out is None else out & held
    return out


@lru_cache(maxsize=4)
def _automaton(needs: tuple[tuple[int, tuple[str, ...]], ...]):
    """Over all literals, each with the numbers that need it. Kept by a worker."""
    import ahocorasick
    numbers: dict[str, list[int]] = {}
    for number, words in needs:
        for word in words:
            numbers.setdefault(word, []).append(number)
    out = ahocorasick.Automaton()
    for word, held in numbers.items():
        out.add_word(word, (word, tuple(held)))
    out.make_automaton()
    return out


def holders(needs: Sequence[tuple[int, tuple[str, ...]]]) -> Callable[[Column], Column]:
    """A column function: the numbers, in order, of which a text holds a literal. A null
    text holds none."""
    fixed = tuple(needs)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(fixed)

        def numbers(text: str | None) -> list[int]:
            words = dict(value for _, value in automaton.iter(folded(text or "")))
            return sorted({k for held in words.values() for k in held})
        for texts in batches:
            yield texts.map(numbers)
    return found
