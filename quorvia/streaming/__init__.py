"""Incremental judging over Structured Streaming, and state machines over event time (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.decision import Policy, Question
from quorvia.judge import answer_contexts, context_json, context_key, judge, observation_rows


def judge_stream(stream: DataFrame, questions: dict[str, Question], evaluator, *, policy: Policy = Policy()) -> DataFrame:
    """Decisions beside the rows of a stream, where the evaluator is an expression: stateless."""
    return judge(stream, questions, evaluator, policy=policy)


def judge_batches(stream: DataFrame, question: Question, evaluator, *, context: list[str], observations: str, output: str, checkpoint: str, policy: Policy = Policy()):
    """Micro-batches that reuse saved answers: contexts without one are answered and appended to the
    observation table, then the batch is decided from it. A batch that is run again finds its answers
    and overwrites its own output, so results are written once."""
    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mine = None
        try:
            mine = session.read.parquet(observations).where((F.col("question_key") == question.key) & (F.col("evaluator") == evaluator.identity))
        except Exception as error:  # the table begins with the first answer
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        need = batch.select(context_key(context).alias("context_key"), context_json(context).alias("context")).dropDuplicates(["context_key"])
        if mine is not None:
            need = need.join(mine.select("context_key"), "context_key", "left_anti")
        observation_rows(answer_contexts(need, question, evaluator), question, evaluator).write.mode("append").parquet(observations)
        saved = session.read.parquet(observations)
        judge(batch, {"decision": question}, evaluator, policy=policy, context=context, observations=saved).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def trace_stream(events: DataFrame, transitions: dict[tuple[str, str], str], initial: str, *, entity: str, time_col: str, event_col: str, watermark: str = "10 minutes") -> DataFrame:
    """State of each entity after each batch of its events, which are ordered by time within a batch;
    events later than the watermark, or older than the entity's last one, are dropped as late."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, last, n = state.get if state.exists else (initial, 0, 0)
        rows = pd.concat(list(frames)).sort_values([time_col, event_col])
        for t, e in zip(rows[time_col], rows[event_col]):
            us = t.value // 1000
            if us < last:
                continue
            at, last, n = transitions.get((at, e), at), us, n + 1
        state.update((at, last, n))
        yield pd.DataFrame({entity: [key[0]], "state": [at], "n_events": [n]})

    kind = events.schema[entity].dataType.simpleString()
    rows = events.select(entity, time_col, event_col).withWatermark(time_col, watermark)
    return rows.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, state string, n_events bigint", "state string, last bigint, n bigint", "update", "NoTimeout")


def on_change(poll: Callable[[], DataFrame], rebuild: Callable[[], None], last: str | None) -> str:
    """Rebuild when a population's fingerprint differs from the last one; gives the new one."""
    from quorvia.operators.typed import population_hash

    row = population_hash(poll()).first()
    now = f"{row['n_rows']}:{row['hash']}:{row['sum']}"
    if now != last:
        rebuild()
    return now
