"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL updates.

Features are the shares of hashed words and word pairs in a text (lower-cased words and runs of
signs; a word that follows itself is one kind of pair), so a score doesn't depend on length. The
model is fitted on at most ``TRAIN_ROWS`` labelled documents outside the test fold; scoring is a
sparse dot product over the whole text, and only the text.

Edge cases: null and empty texts have no features and get the bias alone; without labels, or with
labels of one kind, the weights stay as the prior has them (score 0.5 without any label); repeated
rows are scored each, and an id repeated in the sample is learnt from once; labels that are null are
ignored; a row without an id is in no test fold; other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import id_and_text, id_ddl, map_arrow, passthrough, quiet_gc, texts_of
from quorvia.llm.sparse import Ftrl, held_out, labelled_sample, ngram_slots, token_hashes, training_rows

BITS = 18
#: Most labelled documents that a fit looks at; a documented bound of the sample.
TRAIN_ROWS = 8_000
EPOCHS = 2
SCALE = 8.0  # weight of all shares against the bias


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and their scaled shares."""
    tokens = token_hashes(text)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0)
    slots, counts = np.unique(ngram_slots(tokens, bits), return_counts=True)
    return slots, counts * (SCALE / len(tokens))


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "quality", train_rows: int = TRAIN_ROWS, bits: int = BITS, fold: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from labelled documents outside the test fold (``fold``)."""
    rows = training_rows(labelled_sample(docs, labels, target, train_rows, fold), partial(features, bits=bits))
    model = Ftrl((1 << bits) + 1, alpha=0.5, beta=1.0, l1=0.02, l2=1e-4)
    for _ in range(EPOCHS):
        for slots, values, grade in rows:
            at, x = np.append(slots, 1 << bits), np.append(values, 1.0)
            w = model.weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            model.update(at, w, (p - (grade > 0)) * x)
    w = model.weights()
    return w[:-1].astype(np.float32), float(w[-1])


def score_text(text: str, weights: np.ndarray, bias: float) -> float:
    tokens = token_hashes(text)
    z = bias
    if len(tokens):
        z += float(weights[ngram_slots(tokens, int(len(weights)).bit_length() - 1)].sum(dtype=np.float64)) * SCALE / len(tokens)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    rows = id_and_text(docs, id_col, text_col)
    weights, bias = fit(rows, labels, **options)

    def run(batch: pa.RecordBatch):
        quiet_gc()
        got = np.array([score_text(t, weights, bias) for t in texts_of(batch)], dtype=np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_arrow(rows, run, f"doc_id {id_ddl(docs, id_col)}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    weights, bias = fit(id_and_text(docs, "doc_id", text_col), labels, **options)

    def run(batch: pa.RecordBatch):
        quiet_gc()
        yield passthrough(batch, [score_text(t, weights, bias) >= threshold for t in texts_of(batch, text_col)])

    return map_arrow(docs, run, docs.schema)
