"""Catalog of datasets: strict inference, coercion, attachment with a pinned contract, links, profiles."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"text": "string", "integer": "bigint", "number": "decimal(38,10)", "boolean": "boolean", "date": "date", "datetime": "timestamp", "json": "string"}
_ISO_DATE = re.compile(r"[0-9]{4}(?:-[0-9]{2}){2}$")
_ISO_TIME = re.compile(r"[0-9]{4}(?:-[0-9]{2}){2}[T ][0-9]{2}(?::[0-9]{2}){1,2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$")


def infer(values: list) -> str:
    """boolean, integer, number, json, date, datetime or text of plain values; mixed kinds are refused."""
    kinds = set()
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            kinds.add("boolean")
        elif isinstance(v, int):
            kinds.add("integer")
        elif isinstance(v, (float, Decimal)):
            kinds.add("number")
        elif isinstance(v, (dict, list)):
            kinds.add("json")
        elif isinstance(v, str):
            kinds.add("date" if _ISO_DATE.match(v) else "datetime" if _ISO_TIME.match(v) else "text")
        else:
            raise TypeError(f"no column type for {type(v).__name__}")
    if kinds == {"integer", "number"}:
        return "number"
    if kinds <= {"date", "datetime", "text"} and len(kinds) > 1:
        return "text"
    if len(kinds) > 1:
        raise TypeError(f"mixed kinds {sorted(kinds)}")
    return kinds.pop() if kinds else "text"


def coerce(value, kind: str):
    """A value as its column's type, or an error."""
    if value is None:
        return None
    if kind == "text" and isinstance(value, str):
        return value
    if kind == "boolean" and isinstance(value, bool):
        return value
    if kind in ("integer", "number") and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        d = Decimal(str(value))
        if not d.is_finite():
            raise ValueError("numbers are finite")
        if kind == "number":
            return d
        if d != d.to_integral_value() or abs(d) >= 2**63:
            raise ValueError(f"{value} is no 64-bit integer")
        return int(d)
    if kind == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if kind == "datetime" and isinstance(value, str):
        at = dt.datetime.fromisoformat(value)
        if at.tzinfo is None:
            raise ValueError("a datetime carries its zone")
        return at
    if kind == "json" and isinstance(value, (dict, list)):
        return json.dumps(value, allow_nan=False)
    raise TypeError(f"{value!r} is no {kind}")


def check_names(names: list[str]) -> None:
    if len(names) not in range(1, 65) or len(names) > len(set(names)) or any(not n or len(n.encode()) > 63 or n.startswith("_q") for n in names):
        raise ValueError("1 to 64 different column names of at most 63 bytes, none reserved")


def create(spark: SparkSession, name: str, rows: list[dict], *, columns: dict[str, str] | None = None, limit: int = 10_000) -> DataFrame:
    """A dataset from inline rows, with inferred or declared types, as a view of that name."""
    if len(rows) > limit:
        raise ValueError(f"at most {limit} inline rows; attach larger sources")
    names = list(columns or dict.fromkeys(k for r in rows for k in r))
    check_names(names)
    kinds = columns or {n: infer([r.get(n) for r in rows]) for n in names}
    data = [tuple(coerce(r.get(n), kinds[n]) for n in names) for r in rows]
    df = spark.createDataFrame(data, T._parse_datatype_string(", ".join(f"`{n}` {TYPES[kinds[n]]}" for n in names)))
    df.createOrReplaceTempView(f"`{name}`")
    return df


def fingerprint(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


class Catalog:
    """Attached sources by name with pinned schemas, and links between them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.links = spark, {}, []

    def attach(self, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
        df = self.spark.read.format(fmt).options(**options).load(path)
        check_names(df.columns)
        self.sources[name] = {"path": path, "format": fmt, "options": options, "contract": fingerprint(df)}
        df.createOrReplaceTempView(f"`{name}`")
        return df

    def validate(self, name: str) -> bool:
        """Whether the source still has the schema it was attached with."""
        s = self.sources[name]
        return fingerprint(self.spark.read.format(s["format"]).options(**s["options"]).load(s["path"])) == s["contract"]

    def detach(self, name: str) -> None:
        del self.sources[name]
        self.spark.catalog.dropTempView(name)

    def apply(self, manifest: list[dict]) -> list[str]:
        """Attach a batch of sources, all or none."""
        done = []
        try:
            for m in manifest:
                self.attach(**m)
                done.append(m["name"])
        except Exception:
            for name in done:
                self.detach(name)
            raise
        return done

    def link(self, left: str, columns: list[str], right: str, key: list[str]) -> None:
        """Declare that columns of one source refer to a key of another; the key must be unique."""
        other = self.spark.table(right)
        if other.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique in {right}")
        self.links.append((left, tuple(columns), right, tuple(key)))


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """One row: counts, and whether the column is proven unique (a null isn't)."""
    c = F.col(column)
    return df.agg(F.count("*").alias("n_rows"), F.count(c).alias("non_null"), F.count_distinct(c).alias("distinct")).withColumn("proven", (F.col("n_rows") == F.col("non_null")) & (F.col("non_null") == F.col("distinct")))


def profile(df: DataFrame, column: str, examples: int = 10) -> DataFrame:
    """Null and blank counts of a whole column and its first distinct values in order."""
    c = F.col(column).cast("string")
    counts = df.agg(F.count("*").alias("n_rows"), F.count_if(c.isNull()).alias("nulls"), F.count_if(F.trim(c) == "").alias("blanks"))
    few = df.where(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v").limit(examples).agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return counts.crossJoin(F.broadcast(few))


def domain_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Evidence for a link: how many distinct values of one column occur in another."""
    x = a.select(F.col(a_col).alias("v")).where("v is not null").distinct()
    y = b.select(F.col(b_col).alias("v")).where("v is not null").distinct().withColumn("in_b", F.lit(1))
    return x.join(y, "v", "left").agg(F.count("*").alias("distinct_values"), F.count("in_b").alias("found"))


def match_values(df: DataFrame, column: str, request: str, limit: int = 10) -> DataFrame:
    """Stored values that share words with a request, best first."""
    words = F.array(*map(F.lit, sorted(set(re.findall(r"\w+", request.lower()))))).cast("array<string>")
    v = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    mine = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"\w+"), F.lit(0)))
    scored = v.withColumn("shared", F.size(F.array_intersect(mine, words))).where("shared > 0").withColumn("share", F.col("shared") / F.size(mine))
    return scored.orderBy(F.desc("share"), "value").limit(limit).select("value", "shared", "share")


_OPS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v), "prefix": lambda c, v: c.startswith(v), "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull()}


def filters(specs: list[tuple]) -> Column:
    """Up to 16 (column, op[, value]) filters together."""
    if len(specs) > 16:
        raise ValueError("at most 16 filters")
    out = F.lit(True)
    for column, op, *value in specs:
        if op == "in" and len(value[0]) > 100:
            raise ValueError("at most 100 values")
        out = out & _OPS[op](F.col(column), value[0] if value else None)
    return out


def keyset_page(df: DataFrame, key: list[str], *, after: tuple | None = None, where: list[tuple] = (), size: int = 1_000) -> DataFrame:
    """The next page in the order of the key, after a cursor; ``has_more`` on each row. Comparison and
    filters reach the scan, and the page is a distributed top-k."""
    rows = df.where(filters(list(where))) if where else df
    if after is not None:
        later = F.lit(False)
        for i in range(len(key)):
            step = F.col(key[i]) > F.lit(after[i])
            for j in range(i):
                step = (F.col(key[j]) == F.lit(after[j])) & step
            later = later | step
        rows = rows.where(later & (F.col(key[0]) >= F.lit(after[0])))
    from pyspark.sql import Window as W

    top = rows.orderBy(*key).limit(size + 1)
    n = F.row_number().over(W.orderBy(*key))  # over one page
    return top.withColumn("_n", n).withColumn("has_more", F.max("_n").over(W.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def result_window(df: DataFrame, order: list[str], *, rows: int = 1_000, size: int = 4 << 20) -> DataFrame:
    """An exact prefix of a result by rows and bytes, with ``truncated``."""
    from pyspark.sql import Window as W

    w = W.orderBy(*order)  # over at most rows + 1 rows
    top = df.orderBy(*order).limit(rows + 1).withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    fits = (F.col("_n") <= rows) & (F.col("_b") <= size)
    return top.withColumn("truncated", F.bool_or(~fits).over(W.partitionBy())).where(fits).drop("_n", "_b")


def latest_versions(messages: DataFrame, key: list[str], *version: str) -> DataFrame:
    """The last version of each record; further columns settle ties."""
    from pyspark.sql import Window as W

    return messages.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*map(F.desc, version)))).where("_n = 1").drop("_n")
