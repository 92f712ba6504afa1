"""Questions, policies and three-state decisions as Catalyst expressions.

A decision is a struct that keeps apart what is known (``output_state``) from how the operation went
(``operation_state``). A missing answer is never false: only VALUE carries a value.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE, UNKNOWN, NOT_EVALUATED = "VALUE", "UNKNOWN", "NOT_EVALUATED"
OPERATION_STATES = tuple(sorted("SUCCEEDED SKIPPED TRUNCATED STALE CANCELLED UNCERTAIN FAILED".split() + [f"BLOCKED_BY_{x}" for x in ("REVIEW", "POLICY", "CONCURRENCY", "DEPENDENCY", "BUDGET")]))
#: Which operation state speaks for a run, the first that occurs.
RUN_PRIORITY = ("CANCELLED", "STALE", "FAILED", "BLOCKED_BY_BUDGET", "BLOCKED_BY_POLICY", "BLOCKED_BY_DEPENDENCY", "TRUNCATED", "SKIPPED", "SUCCEEDED")

DECISION_TYPE = (
    "struct<output_state: string, operation_state: string, value_bool: boolean, value_text: string, value_num: double, "
    "p_true: double, probabilities: map<string, double>, confidence: double, reason: string, cached: boolean>"
)
RAW_TYPE = "struct<p: double, probabilities: map<string, double>, score: double, confidence: double, error: string>"


@dataclass(frozen=True)
class Question:
    """``kind``: boolean (a proposition), choice (one of described options) or score (a rubric)."""

    kind: str
    instructions: str
    options: tuple[str, ...] = ()
    levels: int = 0
    criteria: tuple[tuple[str, str], ...] = ()
    subject: str | None = None

    def __post_init__(self):
        if self.kind not in ("boolean", "choice", "score"):
            raise ValueError(f"unknown kind of question: {self.kind}")
        if not self.instructions.strip():
            raise ValueError("a question needs instructions")
        if self.kind == "choice" and not 2 <= len(set(self.options)) == len(self.options) <= 255:
            raise ValueError("a choice needs 2 to 255 different options")
        if self.kind == "score" and not 2 <= self.levels <= 10:
            raise ValueError("a score needs 2 to 10 levels")

    @property
    def key(self) -> str:
        """Identity of the question; thresholds aren't part of it."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def proposition(instructions: str, subject: str | None = None) -> Question:
    return Question("boolean", instructions, subject=subject)


def choice_of(instructions: str, options, subject: str | None = None) -> Question:
    pairs = tuple(options.items()) if isinstance(options, dict) else tuple((o, o) for o in options)
    return Question("choice", instructions, tuple(k for k, _ in pairs), criteria=pairs, subject=subject)


def score_on(instructions: str, levels: int, subject: str | None = None) -> Question:
    return Question("score", instructions, levels=levels, subject=subject)


@dataclass(frozen=True)
class Policy:
    choice_min: float = 0.55
    score_confidence_min: float = 0.0
    #: A proposition is true from ``accept`` up and false from ``reject`` down.
    accept: float = 0.8
    reject: float = 0.2
    unknown_options: tuple = tuple("insufficient none other unknown".split())

    def __post_init__(self):
        if self.accept <= self.reject or self.reject < 0 or self.accept > 1:
            raise ValueError("a policy needs 0 <= reject < accept <= 1")


@dataclass(frozen=True)
class Limits:
    """Admission limits; None: unlimited."""

    judgments: int | None = None
    requests: int | None = None
    tokens: int | None = None
    batch: int = 32
    request_bytes: int = 64_000
    item_bytes: int = 32_000
    extra: dict = field(default_factory=dict)


def raw_answer(p: Column | None = None, probabilities: Column | None = None, score: Column | None = None, confidence: Column | None = None, error: Column | None = None) -> Column:
    """A model's answer before any policy."""
    null = F.lit(None)
    return F.struct(
        (null if p is None else p).cast("double").alias("p"),
        (null if probabilities is None else probabilities).cast("map<string,double>").alias("probabilities"),
        (null if score is None else score).cast("double").alias("score"),
        (null if confidence is None else confidence).cast("double").alias("confidence"),
        (null if error is None else error).cast("string").alias("error"),
    )


def make_decision(output: Column, operation: Column, *, boolean=None, text=None, num=None, p=None, probabilities=None, confidence=None, reason=None, cached=None) -> Column:
    null = F.lit(None)
    pick = lambda c, t: (null if c is None else c).cast(t)
    return F.struct(
        output.alias("output_state"), operation.alias("operation_state"), pick(boolean, "boolean").alias("value_bool"), pick(text, "string").alias("value_text"), pick(num, "double").alias("value_num"),
        pick(p, "double").alias("p_true"), pick(probabilities, "map<string,double>").alias("probabilities"), pick(confidence, "double").alias("confidence"), pick(reason, "string").alias("reason"), pick(cached, "boolean").alias("cached"),
    )


def missing(operation: str, reason: str | None = None) -> Column:
    return make_decision(F.lit(NOT_EVALUATED), F.lit(operation), reason=F.lit(reason))


def winner(probabilities: Column, options: tuple[str, ...]) -> Column:
    """The likeliest option; of equals the one described first."""
    ranked = F.array(*(F.struct(F.coalesce(probabilities[o], F.lit(-1.0)).alias("p"), F.lit(-i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)))
    return F.array_max(ranked)["o"]


def invalid(question: Question, raw: Column) -> Column:
    """Why an answer can't be taken; null if it can."""
    if question.kind == "boolean":
        return F.when(raw["p"].isNull() | F.isnan(raw["p"]) | ~raw["p"].between(0, 1), F.lit("probability"))
    if question.kind == "choice":
        probs = raw["probabilities"]
        total = sum((F.coalesce(probs[o], F.lit(0.0)) for o in question.options), F.lit(0.0))
        keys = F.size(F.array_except(F.map_keys(probs), F.array(*map(F.lit, question.options)))) > 0
        bad = probs.isNull() | keys | (F.size(probs) != len(question.options)) | F.exists(F.map_values(probs), lambda x: x.isNull() | F.isnan(x) | ~x.between(0, 1)) | (F.abs(total - 1) > 0.03)
        return F.when(bad, F.lit("options"))
    return F.when(raw["score"].isNull() | F.isnan(raw["score"]) | ~raw["score"].between(0, question.levels - 1), F.lit("score"))


def resolve(question: Question, raw: Column, policy: Policy = Policy(), cached: Column | None = None) -> Column:
    """The decision that a policy reads from a raw answer: replayable on saved answers."""
    wrong = invalid(question, raw)
    failed = F.when(raw.isNull(), missing("FAILED", "no answer")).when(raw["error"].isNotNull(), make_decision(F.lit(NOT_EVALUATED), F.lit("FAILED"), reason=raw["error"])).when(wrong.isNotNull(), make_decision(F.lit(NOT_EVALUATED), F.lit("FAILED"), reason=wrong))
    state = lambda known: F.when(known, F.lit(VALUE)).otherwise(F.lit(UNKNOWN))
    done = F.lit("SUCCEEDED")
    if question.kind == "boolean":
        p = raw["p"]
        value = F.when(p >= policy.accept, F.lit(True)).when(p <= policy.reject, F.lit(False))
        made = make_decision(state(value.isNotNull()), done, boolean=value, p=p, cached=cached)
    elif question.kind == "choice":
        best = winner(raw["probabilities"], question.options)
        sure = raw["probabilities"][best]
        known = ~best.isin(*policy.unknown_options) & (sure >= policy.choice_min) if policy.unknown_options else sure >= policy.choice_min
        made = make_decision(state(known), done, text=F.when(known, best), probabilities=raw["probabilities"], confidence=sure, cached=cached)
    else:
        confidence = F.coalesce(raw["confidence"], F.lit(0.0))
        known = confidence >= policy.score_confidence_min
        made = make_decision(state(known), done, num=F.when(known, raw["score"]), probabilities=raw["probabilities"], confidence=confidence, cached=cached)
    return failed.otherwise(made)


def bool_value(p: Column, policy: Policy = Policy()) -> Column:
    """``value_bool`` of the decision on a proposition's probability, without the decision around it:
    what a filter over many rows needs."""
    return F.when(p.between(policy.accept, 1), F.lit(True)).when(p.between(0, policy.reject), F.lit(False))


def text_value(question: Question, probabilities: dict[str, Column], policy: Policy = Policy()) -> Column:
    """``value_text`` of the decision on a choice whose probabilities are plain columns, without maps and
    without the decision around it."""
    if set(probabilities) != set(question.options):
        return F.lit(None).cast("string")
    at = [probabilities[o].cast("double") for o in question.options]
    valid = functools.reduce(lambda a, b: a & b, [p.between(0, 1) for p in at]) & (F.abs(sum(at, F.lit(0.0)) - 1) <= 0.03)
    best = None  # of equals the one described first
    for i, (o, p) in enumerate(zip(question.options, at)):
        value = F.lit(None).cast("string") if o in policy.unknown_options else F.when(p >= policy.choice_min, F.lit(o))
        most = functools.reduce(lambda a, b: a & b, [p >= x for x in at[i + 1 :]], F.lit(True))
        best = F.when(most, value) if best is None else best.when(most, value)
    return F.when(valid, best)


# -- logic


def is_value(d: Column) -> Column:
    return d["output_state"] == VALUE


def _combine(value: Column, decisions: list[Column]) -> Column:
    """A Boolean decision from its three-valued value and the states of what it hangs on."""
    blocked = functools.reduce(lambda a, b: a | b, [d["output_state"] == NOT_EVALUATED for d in decisions])
    return (
        F.when(value.isNotNull(), make_decision(F.lit(VALUE), F.lit("SUCCEEDED"), boolean=value))
        .when(blocked, missing("BLOCKED_BY_DEPENDENCY"))
        .otherwise(make_decision(F.lit(UNKNOWN), F.lit("SUCCEEDED")))
    )


def all_of(*decisions: Column) -> Column:
    """AND: one known false decides, whatever is missing."""
    return _combine(functools.reduce(lambda a, b: a & b, [d["value_bool"] for d in decisions]), list(decisions))


def any_of(*decisions: Column) -> Column:
    """OR: one known true decides, whatever is missing."""
    return _combine(functools.reduce(lambda a, b: a | b, [d["value_bool"] for d in decisions]), list(decisions))


def negated(decision: Column) -> Column:
    return _combine(~decision["value_bool"], [decision])


def stance(support: Column, opposition: Column) -> Column:
    """conflict, support, opposition or insufficient from two Boolean decisions."""
    s, o = support["value_bool"], opposition["value_bool"]
    known = F.when(s & o, "conflict").when(s, "support").when(o, "opposition").otherwise("insufficient")
    return (
        F.when((support["output_state"] == NOT_EVALUATED) | (opposition["output_state"] == NOT_EVALUATED), missing("BLOCKED_BY_DEPENDENCY"))
        .when((support["output_state"] == UNKNOWN) | (opposition["output_state"] == UNKNOWN), make_decision(F.lit(UNKNOWN), F.lit("SUCCEEDED")))
        .otherwise(make_decision(F.lit(VALUE), F.lit("SUCCEEDED"), text=known))
    )


def require_bool(decision: Column) -> Column:
    """The Boolean value, or an error where it isn't known."""
    return F.when(is_value(decision) & decision["value_bool"].isNotNull(), decision["value_bool"]).otherwise(F.raise_error(F.lit("a Boolean decision isn't complete")).cast("boolean"))


def decide(question: Question, context_sha: Column, expected: Column, raw: Column, policy: Policy = Policy()) -> Column:
    """Replay a saved answer under a policy, if it was given for this context."""
    return F.when(context_sha == expected, resolve(question, raw, policy)).otherwise(missing("STALE", "context"))


# -- completeness


def coverage_columns(decision: Column) -> list[Column]:
    """Aggregates that make a manifest row: counts by state, and whether all is known."""
    out, op = decision["output_state"], decision["operation_state"]
    return [
        F.count("*").alias("eligible"),
        F.count_if(out == VALUE).alias("values"),
        F.count_if(out == UNKNOWN).alias("unknown"),
        F.count_if(out == NOT_EVALUATED).alias("not_evaluated"),
        F.count_if(op == "SUCCEEDED").alias("succeeded"),
        F.count_if(op == "FAILED").alias("failed"),
        F.count_if(op == "SKIPPED").alias("skipped"),
        F.count_if(op.startswith("BLOCKED")).alias("blocked"),
        (F.count_if(out != VALUE) == 0).alias("complete"),
    ]


def run_state_columns(decision: Column) -> list[Column]:
    """Output and operation state of a whole run."""
    order = F.create_map(*(F.lit(x) for i, s in enumerate(RUN_PRIORITY) for x in (s, -i)))
    worst = F.max(F.coalesce(order[decision["operation_state"]], F.lit(-len(RUN_PRIORITY))))
    names = F.array(*map(F.lit, RUN_PRIORITY))
    output = F.when(F.count_if(decision["output_state"] != VALUE) == 0, VALUE).when(F.count_if(decision["output_state"] != NOT_EVALUATED) == 0, NOT_EVALUATED).otherwise(UNKNOWN)
    return [output.alias("output_state"), F.element_at(names, 1 - F.coalesce(worst, F.lit(1 - len(RUN_PRIORITY)))).alias("operation_state")]
