"""Answer matrices: the probabilities of every declared answer to a fixed basis of questions, and the
Hellinger distance between them, as column expressions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.decision import Policy, Question
from quorvia.judge import judge


@dataclass(frozen=True)
class Basis:
    """Questions in a fixed order, and who answers them. Distances compare equal bases only."""

    questions: tuple[tuple[str, Question], ...]
    evaluator: str

    @property
    def identity(self) -> str:
        return hashlib.sha256(json.dumps([[n, q.key] for n, q in self.questions] + [self.evaluator]).encode()).hexdigest()

    def axes(self, q: Question) -> list[str]:
        return ["false", "true"] if q.kind == "boolean" else sorted(q.options) if q.kind == "choice" else [str(i) for i in range(q.levels)]


def answer_matrix(basis: Basis, decisions: dict[str, Column]) -> Column:
    """``array<struct<question, kind, answers, probs>>``; a missing decision has null cells."""
    rows = []
    for name, q in basis.questions:
        d, axes = decisions[name], basis.axes(q)
        if q.kind == "boolean":
            probs = F.array(1 - d["p_true"], d["p_true"])
        else:
            probs = F.array(*(d["probabilities"][a] for a in axes))
        missing = (d["output_state"] == "NOT_EVALUATED") | (d["p_true"].isNull() if q.kind == "boolean" else d["probabilities"].isNull())
        empty = F.array(*(F.lit(None).cast("double") for _ in axes))
        rows.append(F.struct(F.lit(name).alias("question"), F.lit(q.kind).alias("kind"), F.array(*map(F.lit, axes)).alias("answers"), F.when(missing, empty).otherwise(probs).alias("probs")))
    return F.array(*rows)


def embed(df: DataFrame, basis: Basis, evaluator, *, policy: Policy = Policy(), name: str = "matrix") -> DataFrame:
    judged = judge(df, {f"_{n}": q for n, q in basis.questions}, evaluator, policy=policy)
    out = judged.withColumn(name, answer_matrix(basis, {n: F.col(f"_{n}") for n, _ in basis.questions})).withColumn(f"{name}_basis", F.lit(basis.identity))
    return out.drop(*(f"_{n}" for n, _ in basis.questions))


def flat_vector(matrix: Column) -> Column:
    return F.flatten(F.transform(matrix, lambda r: r["probs"]))


def _roots(probs: Column) -> Column:
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    return F.transform(probs, lambda x: F.sqrt(x / total))


def prepared(matrix: Column) -> Column:
    """Square roots of the normalised probabilities, made once for repeated distances."""
    return F.transform(matrix, lambda r: _roots(r["probs"]))


def prepared_distance(a: Column, b: Column) -> Column:
    """Root mean square over questions of the Hellinger distance; null where a cell is missing."""
    one = lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))
    total = F.aggregate(F.zip_with(a, b, one), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total / F.size(a))


def roots_of(basis: Basis, matrix: Column) -> Column:
    """A struct of the square roots of a matrix's normalised probabilities, a plain field for each
    answer: with the basis known the arithmetic is unrolled and stays in generated code."""
    fields = []
    for i, (_, q) in enumerate(basis.questions):
        cells = [matrix[i]["probs"][j] for j in range(len(basis.axes(q)))]
        total = sum(cells[1:], cells[0])
        fields += [F.sqrt(c / total).alias(f"r{i}_{j}") for j, c in enumerate(cells)]
    return F.struct(*fields)


def roots_distance(basis: Basis, a: Column, b: Column) -> Column:
    """Distance from two structs of ``roots_of``; null where a cell is missing."""
    total = None
    for i, (_, q) in enumerate(basis.questions):
        steps = [(a[f"r{i}_{j}"] - b[f"r{i}_{j}"]) * (a[f"r{i}_{j}"] - b[f"r{i}_{j}"]) for j in range(len(basis.axes(q)))]
        half = 0.5 * sum(steps[1:], steps[0])
        d2 = F.when(half > 1.0, F.lit(1.0)).when(half < 0.0, F.lit(0.0)).otherwise(half)
        total = d2 if total is None else total + d2
    return F.sqrt(total / len(basis.questions))


def pair_distances(pairs: DataFrame, basis: Basis, left: str, right: str, *, left_basis: str | None = None, right_basis: str | None = None, name: str = "distance") -> DataFrame:
    """Distances of matrices side by side; an error for incomplete matrices and for other bases. The
    roots are made in a projection of their own, so each is made once."""
    rows = pairs.withColumn("_l", roots_of(basis, F.col(left))).withColumn("_r", roots_of(basis, F.col(right)))
    d = roots_distance(basis, F.col("_l"), F.col("_r"))
    out = F.when(d.isNull(), F.raise_error(F.lit("an answer matrix isn't complete")).cast("double")).otherwise(d)
    for c in (left_basis, right_basis):
        if c:
            out = F.when(F.col(c) == basis.identity, out).otherwise(F.raise_error(F.lit("answer matrices of different bases")).cast("double"))
    return rows.withColumn(name, out).drop("_l", "_r")


def embedding_distance(a: Column, b: Column, basis_a: Column | None = None, basis_b: Column | None = None) -> Column:
    """Distance of two matrices of any basis; an error for different bases, and for incomplete matrices.
    Where the basis is known when the plan is made, ``pair_distances`` is several times faster."""
    whole = lambda m: F.forall(m, lambda r: F.forall(r["probs"], lambda p: p.isNotNull()))
    d = prepared_distance(prepared(a), prepared(b))
    out = F.when(whole(a) & whole(b), d).otherwise(F.raise_error(F.lit("an answer matrix isn't complete")).cast("double"))
    if basis_a is not None:
        out = F.when(basis_a == basis_b, out).otherwise(F.raise_error(F.lit("answer matrices of different bases")).cast("double"))
    return out


def compact(matrix: Column, basis: Column) -> Column:
    """What a distance needs of a matrix of any basis: ``cells``, the square roots of its normalised
    probabilities (null if it isn't complete), ``sizes`` of its questions and a hash of its basis. It is
    a fraction of the matrix, so rows that are to be joined carry this."""
    whole = F.forall(matrix, lambda r: F.forall(r["probs"], lambda p: p.isNotNull()))
    return F.struct(F.when(whole, F.flatten(prepared(matrix))).alias("cells"), F.transform(matrix, lambda r: F.size(r["probs"]).cast("byte")).alias("sizes"), F.unhex(basis).alias("basis"))


def compact_distance(a: Column, b: Column) -> Column:
    """``embedding_distance`` of two matrices by their ``compact`` forms."""
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), (s["sum"] + half(s["at"], n)).alias("sum"))
    square = lambda at, n: F.aggregate(F.zip_with(F.slice(a["cells"], at, n), F.slice(b["cells"], at, n), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    half = lambda at, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * square(at, n)))
    total = F.aggregate(F.transform(a["sizes"], lambda n: n.cast("int")), F.struct(F.lit(1).alias("at"), F.lit(0.0).alias("sum")), step)["sum"]
    d = F.sqrt(total / F.size(a["sizes"]))
    out = F.when(a["cells"].isNotNull() & b["cells"].isNotNull(), d).otherwise(F.raise_error(F.lit("an answer matrix isn't complete")).cast("double"))
    return F.when(a["basis"] == b["basis"], out).otherwise(F.raise_error(F.lit("answer matrices of different bases")).cast("double"))


#: Rows of both sides that a task of a join should get.
TASK_ROWS = 500_000


def keyed_distances(left: DataFrame, right: DataFrame, key: str, matrix: str, *, name: str = "distance", task_rows: int = TASK_ROWS) -> DataFrame:
    """``key, distance`` of the rows of two tables with equal keys, matrices in their ``compact`` form. The
    tasks are chosen by the rows, not by the compressed bytes, which say little of what a sort holds."""
    tasks = -(-(left.count() + right.count()) // task_rows)
    a, b = left.select(key, F.col(matrix).alias("_a")), right.select(key, F.col(matrix).alias("_b"))
    if tasks > 1:
        a, b = a.repartition(tasks, key), b.repartition(tasks, key)
    return a.join(b, key).select(key, compact_distance(F.col("_a"), F.col("_b")).alias(name))


def embedding_distances(query: DataFrame, candidates: DataFrame, *, id_col: str, matrix: str = "matrix", top_k: int | None = None, basis: Basis | None = None) -> DataFrame:
    """``id, distance`` from one query row to every candidate: one row is broadcast, any number read."""
    if basis is not None:
        one = query.where(F.col(f"{matrix}_basis") == basis.identity).limit(1).select(roots_of(basis, F.col(matrix)).alias("_q"))
        mine = candidates.where(F.col(f"{matrix}_basis") == basis.identity).select(id_col, roots_of(basis, F.col(matrix)).alias("_c"))
        out = mine.crossJoin(F.broadcast(one)).select(id_col, roots_distance(basis, F.col("_c"), F.col("_q")).alias("distance"))
        return out if top_k is None else out.orderBy(F.col("distance").asc_nulls_last(), id_col).limit(top_k)
    q = query.limit(1).select(prepared(F.col(matrix)).alias("_q"), F.col(f"{matrix}_basis").alias("_b"))
    rows = candidates.crossJoin(F.broadcast(q)).where(F.col("_b") == F.col(f"{matrix}_basis"))
    out = rows.select(id_col, prepared_distance(prepared(F.col(matrix)), F.col("_q")).alias("distance"))
    return out if top_k is None else out.orderBy(F.col("distance").asc_nulls_last(), id_col).limit(top_k)


def vector_distances(query: DataFrame, rows: DataFrame, *, id_col: str, vector: str, top_k: int) -> DataFrame:
    """Nearest plain vectors to one, by Euclidean distance in double precision."""
    q = query.limit(1).select(F.col(vector).cast("array<double>").alias("_q"))
    d2 = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.col("_q"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return rows.crossJoin(F.broadcast(q)).select(id_col, F.sqrt(d2).alias("distance")).orderBy("distance", id_col).limit(top_k)
