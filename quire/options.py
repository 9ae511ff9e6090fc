"""Checked options: every entry point states what each option may be, and all problems are told at once."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from typing import Any


class OptionError(ValueError):
    """One or more options cannot be used; ``problems`` lists them."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


@dataclass(frozen=True)
class Rule:
    """A test and the words that finish the sentence "<option> must be ..."."""

    holds: Callable[[Any], bool]
    words: str


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def at_least(low: float) -> Rule:
    return Rule(lambda x: _number(x) and x >= low, f"{low} or more")


def one_of(allowed: Collection[str]) -> Rule:
    return Rule(lambda x: x in allowed, "one of " + " / ".join(allowed))


def optional(rule: Rule) -> Rule:
    return Rule(lambda x: x is None or rule.holds(x), f"{rule.words}, or not given")


COUNT = at_least(1)
COUNT_OR_NONE = optional(COUNT)
NOT_NEGATIVE = at_least(0)
SHARE = Rule(lambda x: _number(x) and 0 < x <= 1, "above 0 and up to 1")
TEXT = Rule(lambda x: isinstance(x, str) and x.strip() != "", "a text that is not blank")


def problems(**options: tuple[Any, Rule]) -> list[str]:
    return [f"{name} must be {rule.words}, not {value!r}" for name, (value, rule) in options.items() if not rule.holds(value)]


def check(**options: tuple[Any, Rule]) -> None:
    """``check(batch_size=(n, COUNT), ...)`` raises one OptionError for all options that break their rule."""
    reject(problems(**options))


def reject(found: list[str]) -> None:
    if found:
        raise OptionError(found)
