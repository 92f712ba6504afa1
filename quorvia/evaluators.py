"""Evaluators answer questions about rows.

``ColumnEvaluator`` gives a Catalyst expression, so judging is a projection; ``TableEvaluator`` joins
recorded answers; ``PythonEvaluator`` calls a function (a model) over Arrow batches of distinct contexts.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.decision import Question, raw_answer


class ColumnEvaluator:
    """``rules``: by instructions, a column or a function of the question that gives one. A Boolean
    question's column is a probability, a choice's a map of probabilities (or a dict of columns, one for
    each option), a score's a number or a struct of score and confidence."""

    identity = "column/1"

    def __init__(self, rules: dict[str, Column | Callable[[Question], Column]], default: Column | None = None):
        self.rules, self.default = rules, default

    def _found(self, question: Question):
        rule = self.rules.get(question.instructions, self.default)
        if rule is None:
            raise KeyError(f"no rule answers {question.instructions!r}")
        return rule(question) if callable(rule) and not isinstance(rule, Column) else rule

    def options(self, question: Question) -> dict[str, Column] | None:
        """A choice's probabilities as a column for each option, if its rule is one."""
        found = self._found(question)
        return found if isinstance(found, dict) else None

    def column(self, question: Question) -> Column:
        found = self._found(question)
        if isinstance(found, dict):
            found = option_map([*found.items()])
        if question.kind == "boolean":
            return raw_answer(p=found)
        if question.kind == "choice":
            return raw_answer(probabilities=found)
        return raw_answer(score=found, confidence=F.lit(1.0))


class TableEvaluator:
    """Recorded answers: a table with ``key`` columns and, per question, a column of raw probabilities."""

    identity = "table/1"

    def __init__(self, answers: DataFrame, keys: list[str], columns: dict[str, str]):
        self.answers, self.keys, self.columns = answers, keys, columns


class PythonEvaluator:
    """``fn(question as dict, contexts: list of dict) -> list of dict`` with p, probabilities, score
    and confidence; an exception fails the batch's answers, never the job."""

    def __init__(self, fn: Callable[[dict, list[dict]], list[dict]], identity: str = "python/1", batch: int = 32, attempts: int = 2, per_minute: int | None = None):
        """``per_minute``: requests that one task sends in any minute; divide an account's allowance by
        the number of tasks that run at once."""
        self.fn, self.identity, self.batch, self.attempts, self.per_minute = fn, identity, batch, attempts, per_minute

    def answer(self, question: dict, contexts: list[str]) -> list[dict]:
        out: list[dict] = []
        sent: deque[float] = deque()
        for at in range(0, len(contexts), self.batch):
            part = [json.loads(c) for c in contexts[at : at + self.batch]]
            for _ in range(self.attempts):
                if self.per_minute:
                    while sent and sent[0] <= time.monotonic() - 60:
                        sent.popleft()
                    if len(sent) >= self.per_minute:
                        time.sleep(max(0.0, sent.popleft() + 60 - time.monotonic()))
                    sent.append(time.monotonic())
                try:
                    got = self.fn(question, part)
                    if len(got) != len(part):
                        raise ValueError("one answer a context is asked for")
                    break
                except Exception as error:  # noqa: BLE001 - a failed request is a failed answer
                    got = [{"error": str(error)[:200] or type(error).__name__}] * len(part)
            out += got
        return out


def option_map(options: list[tuple[str, Column]]) -> Column:
    """A choice's probabilities from a column for each option."""
    return F.create_map(*(x for name, p in options for x in (F.lit(name), p.cast("double"))))


def one_hot_options(value: Column, options, hit: float = 0.9) -> dict[str, Column]:
    """Probability ``hit`` for the option that a column names, the rest shared; the last option takes values not described."""
    rest = (1 - hit) / (len(options) - 1)
    known = F.when(value.isin(*options), value).otherwise(F.lit(options[-1]))
    return {o: F.when(known == o, hit).otherwise(rest) for o in options}


def one_hot(value: Column, options, hit: float = 0.9) -> Column:
    """The map of ``one_hot_options``."""
    return option_map([*one_hot_options(value, options, hit).items()])
