"""Heading rules as data: any number of patterns as one stage of the plan.

A rule is (priority, key, is_target, pattern).  Every pattern is searched for the
literal texts that any match of it must hold; these of all rules form one
automaton.  A text runs through the automaton once, and only the rules whose literals
it holds are tried, in their order.  The plan has one stage however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as kind
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one stage may hold; a table with more is refused.
MOST_RULES = 200_000
#: Answers remembered by a task; headings repeat.
MEMORY = 100_000
#: Patterns mean what they mean to the ``when`` chain: only ASCII letters have case, \\s, \\d, \\w and \\b are ASCII.
FLAGS = re.IGNORECASE | re.ASCII
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literals(pattern: str) -> set[str]:
    """Lower-cased texts one of which every match holds; empty if there is no such set."""
    return _needed(list(parser.parse(pattern, FLAGS))) or set()


def _needed(nodes: list) -> set[str] | None:
    """The best set of one sequence: that whose shortest text is longest."""
    found: list[set[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            found.append({run})
        run = ""

    for op, value in nodes:
        if op is kind.LITERAL:
            run += chr(value).translate(_LOWER)
            continue
        if op is kind.AT:  # a place, no text
            continue
        end()
        if op is kind.SUBPATTERN:
            inner = _needed(list(value[-1]))
        elif op is kind.BRANCH:
            each = [_needed(list(b)) for b in value[1]]
            inner = None if any(x is None for x in each) else set().union(*each)
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _needed(list(value[2]))
        elif op is kind.ATOMIC_GROUP:
            inner = _needed(list(value))
        else:
            inner = None
        if inner:
            found.append(inner)
    end()
    return max(found, key=lambda s: min(map(len, s)), default=None)


@dataclass
class Matcher:
    """The rules of a table in order, ready to be tried."""

    rules: list[tuple[str, bool, str]]
    tried: int = 0
    known: dict[str, str | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.compiled: list[re.Pattern | None] = [None] * len(self.rules)
        self.targets = {key: target for key, target, _ in reversed(self.rules)}
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for i, (_, _, pattern) in enumerate(self.rules):
            texts = literals(pattern)
            for t in texts:
                by_literal.setdefault(t, []).append(i)
            if not texts:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for t, numbers in by_literal.items():
            self.automaton.add_word(t, numbers)
        self.automaton.make_automaton()
        self.empty = not by_literal

    def first(self, text: str) -> str | None:
        """Key of the first rule that matches."""
        if text not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[text] = self._first(text)
        return self.known[text]

    def _first(self, text: str) -> str | None:
        found = set(self.always)
        if not self.empty:
            for _, numbers in self.automaton.iter(text.translate(_LOWER)):
                found.update(numbers)
        for i in sorted(found):
            self.tried += 1
            rx = self.compiled[i]
            if rx is None:
                rx = self.compiled[i] = re.compile(self.rules[i][2], FLAGS)
            if rx.search(text):
                return self.rules[i][0]
        return None


_MATCHERS: dict[int, Matcher] = {}


def _matcher(number: int, rules: list[tuple[str, bool, str]]) -> Matcher:
    """This worker's matcher of a broadcast table."""
    if number not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[number] = Matcher(rules)
    return _MATCHERS[number]


@dataclass(frozen=True)
class Rules:
    """A registered table.  ``key(text)``: key of the first rule that matches; ``is_target(key)``: flag of the first rule with that key."""

    key: Callable[[Column], Column]
    is_target: Callable[[Column], Column]


def register_rules(pattern_table: DataFrame) -> Rules:
    """Rules from a table (priority, key, is_target, pattern); equal priorities are ordered by key and pattern.

    The table goes through the driver and to every task, so it may have at most
    ``MOST_RULES`` rows.  Rules without key or pattern are left out, those without priority
    come last.  A null text matches nothing, a key without rule is no target.
    """
    rows = pattern_table.where("key is not null and pattern is not null").select("priority", "key", "is_target", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules = [(r["key"], bool(r["is_target"]), r["pattern"]) for r in sorted(rows, key=lambda r: (r["priority"] is None, r["priority"] or 0, r["key"], r["pattern"]))]
    for _, _, pattern in rules:
        re.compile(pattern, FLAGS)  # a wrong pattern is refused here
    shared = pattern_table.sparkSession.sparkContext.broadcast(rules)
    number = shared._jbroadcast.id()

    def key(texts: pd.Series) -> pd.Series:
        first = _matcher(number, shared.value).first
        return pd.Series([None if t is None else first(t) for t in texts.tolist()], dtype=object)

    def is_target(keys: pd.Series) -> pd.Series:
        targets = _matcher(number, shared.value).targets
        return pd.Series([targets.get(k, False) for k in keys.tolist()], dtype=bool)

    return Rules(F.pandas_udf(key, "string"), F.pandas_udf(is_target, "boolean"))
