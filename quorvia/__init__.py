"""Semantic analytics on Spark: typed judgments over rows, composed with relational operators."""

from quorvia.decision import Policy, Question
from quorvia.evaluators import ColumnEvaluator, PythonEvaluator, TableEvaluator
from quorvia.judge import judge

__all__ = ["ColumnEvaluator", "Policy", "PythonEvaluator", "Question", "TableEvaluator", "judge"]
