"""CSV and TSV: delimiter, header and types from a bounded head, cells checked by column expressions."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TESTS = {
    "integer": r"^[+-]?\d{1,18}$", "number": r"^[+-]?(\d{1,28}(\.\d{1,10})?|\.\d{1,10})$", "boolean": r"^(?i:true|false)$", "date": r"^[0-9]{4}(?:-[0-9]{2}){2}$",
    "datetime": r"^[0-9]{4}(?:-[0-9]{2}){2}[T ][0-9]{2}(?::[0-9]{2}){1,2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$",
}
_DDL = {"integer": "bigint", "number": "decimal(38,10)", "boolean": "boolean", "date": "date", "datetime": "timestamp", "text": "string"}


def sniff(head: str) -> str:
    """The delimiter of , ; tab and | that cuts the head's lines alike, into most columns."""
    best = (",", 0)
    for d in ",;\t|":
        widths = {len(r) for r in csv.reader(io.StringIO(head), delimiter=d) if r}
        if len(widths) == 1 and (w := widths.pop()) > best[1]:
            best = (d, w)
    return best[0]


def read(spark: SparkSession, path: str, *, delimiter: str | None = None, columns: dict[str, str] | None = None, null_empty: bool = True) -> DataFrame:
    """All lines as text columns, without inference over the file; the delimiter is sniffed in its head."""
    if delimiter is None:
        delimiter = sniff("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()).lstrip("﻿"))
    df = spark.read.csv(path, header=True, sep=delimiter, mode="PERMISSIVE", quote='"', escape='"', multiLine=False, nullValue="" if null_empty else None, emptyValue=None if null_empty else "")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def inferred(df: DataFrame) -> dict[str, str]:
    """The narrowest type that every cell of a column fits, from one aggregate over the file."""
    row = df.agg(*(F.coalesce(F.bool_and(F.col(c).rlike(p)), F.lit(False)).alias(f"{i}:{kind}") for i, c in enumerate(df.columns) for kind, p in _TESTS.items())).first()
    return {c: next((kind for kind in _TESTS if row[f"{i}:{kind}"]), "text") for i, c in enumerate(df.columns)}


def cell(column: Column, kind: str) -> Column:
    return column if kind == "text" else column.try_cast(_DDL[kind])


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*(cell(F.col(c), kinds.get(c, "text")).alias(c) for c in df.columns))


def cell_errors(df: DataFrame, kinds: dict[str, str], limit: int = 20) -> DataFrame:
    """``column, value`` of cells that aren't their column's type, the first few in order."""
    bad = F.array(*(F.when(F.col(c).isNotNull() & cell(F.col(c), k).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, k in kinds.items() if k != "text"))
    return df.select(F.explode(F.array_compact(bad)).alias("e")).select("e.*").orderBy("column", "value").limit(limit)
