"""SQL with a semantic predicate: guarded text, dialect shims, and SEMANTIC inlined as expressions.

``run_sql`` checks a single read statement against the allow-list, rewrites calls whose meaning differs
from Spark's, and replaces ``SEMANTIC(column, 'definition')`` and ``SEMANTIC_FEATURE(column, 'name')``
with the evaluator's own expression under the policy. The predicate is then an ordinary three-valued
Boolean expression: Catalyst pushes it, prunes columns under it and evaluates it only for rows that
exact conjuncts, written before it, let through. It works wherever an expression may stand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.decision import proposition
from quorvia.functions.dialect import ALLOWED, SHIMS, split_arguments
from quorvia.judge import judge

#: Words of the language that a parenthesis may follow.
_WORDS = frozenset("select from where on in as over and or not when then else between like filter group by having order union intersect except all distinct with values using exists any some partition rows range within limit offset join interval case end is recursive grouping sets rollup cube lateral desc asc decimal numeric varchar char unbounded preceding following".split())
_FORBIDDEN = re.compile(r"(?i)\b(create|drop|alter|truncate|grant|revoke|insert|update|delete|merge|call|set|into|for\s+update|for\s+share|lock|refresh|cache|use|load|msck|analyze)\b")
MAX_LENGTH = 30_000
_CALL = r"\b(?!\d)(\w+)\s*\("


class SqlError(ValueError):
    pass


def masked(text: str) -> str:
    """The text with strings, quoted names and comments blanked, of the same length, as Spark's lexer
    takes them: backslashes escape in strings but in raw ones, and bracketed comments nest. What doesn't
    end, and hints, are refused."""
    out, at, n = list(text), 0, len(text)
    while at < n:
        c, begin = text[at], at
        if c in "'\"":
            raw = at > 0 and text[at - 1] in "rR" and not (at > 1 and (text[at - 2].isalnum() or text[at - 2] == "_"))
            at += 1
            while at < n and text[at] != c:
                at += 1 if raw or text[at] != "\\" else 2
            at += 1
        elif c == "`":
            at = text.find("`", at + 1) + 1 or n + 1
        elif text.startswith("--", at):
            while at < n and text[at] not in "\r\n":
                at += 2 if text.startswith("\\\n", at) else 1
        elif text.startswith("/*", at):
            if text.startswith("/*+", at):
                raise SqlError("no hints")
            depth = 0
            while at < n:
                step = text[at : at + 2]
                depth += {"/*": 1, "*/": -1}.get(step, 0)
                at += 2 if step in ("/*", "*/") else 1
                if not depth:
                    break
            at += n if depth else 0
        else:
            at += 1
            continue
        if at > n:
            raise SqlError("a quoted text or comment that doesn't end")
        out[begin:at] = " " * (at - begin)
    return "".join(out)


def guard(text: str, extra: frozenset[str] = frozenset()) -> None:
    """Refuse all but one read statement over plain names and allowed functions."""
    if len(text) > MAX_LENGTH:
        raise SqlError(f"over {MAX_LENGTH} characters")
    bare = masked(text).strip().rstrip(";")
    if ";" in bare:
        raise SqlError("one statement at a time")
    if not re.match(r"(?i)\s*(select|with|\()", bare):
        raise SqlError("a read statement is asked for")
    if m := _FORBIDDEN.search(bare):
        raise SqlError(f"{m.group().lower()} isn't allowed")
    if re.search(r"[?$]\d*|:[A-Za-z]\w*", re.sub(r"::", "", bare)):
        raise SqlError("no parameters in the text")
    if re.search(r"(?i)\b(from|join)\s+\w+\s*\.\s*\w+", bare):
        raise SqlError("no schema-qualified names")
    if m := re.search(r"(?i)\b\w+\s*\.\s*\w+\s*\(", bare):
        raise SqlError("no schema-qualified functions")
    # names of common tables may be followed by a parenthesis too
    names = {m.group(1).lower() for m in re.finditer(r"(?i)\b(\w+)\s*(?:\([\w\s,]*\))?\s+as\s*\(", bare)}
    for m in re.finditer(_CALL, bare):
        word = m.group(1).lower()
        if word not in ALLOWED and word not in _WORDS and word not in names and word not in extra:
            raise SqlError(f"the function {word} isn't allowed")


def rewrite_calls(text: str, rules: dict[str, Callable[[list[str]], str]]) -> str:
    """Replace calls by name, innermost first, outside strings and comments."""
    at = len(text)
    while True:
        bare = masked(text)
        calls = [m for m in re.finditer(_CALL, bare[:at]) if m.group(1).lower() in rules]
        if not calls:
            return text
        m = calls[-1]
        depth, i = 0, m.end() - 1
        while i < len(bare):
            depth += {"(": 1, ")": -1}.get(bare[i], 0)
            if depth == 0:
                break
            i += 1
        inside = text[m.end() : i]
        text = text[: m.start()] + rules[m.group(1).lower()](split_arguments(inside)) + text[i + 1 :]
        at = m.start()


_STOPS = frozenset("select where and or not on when then else case having by as in from between like is distinct all any some union intersect except limit with exists qualify using".split())
_QUANTIFIED = re.compile(r"(?i)(>=|<=|<>|!=|=|>|<)\s*(any|some|all)\s*\(\s*(?=select\b|with\b)")


def _left_operand(bare: str, end: int) -> int:
    """Where the expression that ends there begins."""
    at = end
    while at > 0:
        c = bare[at - 1]
        if c == ")":
            depth = 0
            while at > 0:
                at -= 1
                depth += {")": 1, "(": -1}.get(bare[at], 0)
                if depth == 0:
                    break
        elif c in "(,;" or c in "=<>!":
            break
        elif m := re.search(r"[A-Za-z_]\w*$", bare[:at]):
            if m.group().lower() in _STOPS:
                break
            at = m.start()
        else:
            at -= 1
    while at < end and bare[at].isspace():
        at += 1
    return at


def any_all(text: str) -> str:
    """Comparisons with ANY or ALL of a subquery by its extremes and counts, in three-valued logic: over
    no rows ANY is false and ALL true, and nulls leave open what the other rows don't decide."""
    while True:
        bare = masked(text)
        found = list(_QUANTIFIED.finditer(bare))
        if not found:
            return text
        m = found[-1]
        op, kind = m[1].replace("!=", "<>"), "all" if m[2].lower() == "all" else "any"
        open_at = bare.index("(", m.start())
        depth, close = 0, open_at
        while close < len(bare):
            depth += {"(": 1, ")": -1}.get(bare[close], 0)
            if depth == 0:
                break
            close += 1
        begin = _left_operand(bare, m.start())
        x, query = text[begin : m.start()].strip(), text[open_at + 1 : close].strip()
        of = lambda what: f"(SELECT {what} FROM ({query}) _q(_c))"  # noqa: E731,B023
        low, high, rows, known = of("min(_c)"), of("max(_c)"), of("count(*)"), of("count(_c)")
        some = {"=": f"({x}) IN ({query})", "<>": f"(({x}) <> {low} OR ({x}) <> {high})", ">": f"({x}) > {low}", ">=": f"({x}) >= {low}", "<": f"({x}) < {high}", "<=": f"({x}) <= {high}"}
        no = {"=": f"(({x}) <> {low} OR ({x}) <> {high})", "<>": f"({x}) IN ({query})", ">": f"({x}) <= {high}", ">=": f"({x}) < {high}", "<": f"({x}) >= {low}", "<=": f"({x}) > {low}"}
        decided, otherwise = (some[op], "false") if kind == "any" else (no[op], "true")
        out = f"(CASE WHEN {rows} = 0 THEN {otherwise} WHEN {decided} THEN {'true' if kind == 'any' else 'false'} WHEN {known} < {rows} OR ({x}) IS NULL THEN NULL ELSE {otherwise} END)"
        if (op, kind) == ("=", "any"):
            out = f"({x} IN ({query}))"
        elif (op, kind) == ("<>", "all"):
            out = f"({x} NOT IN ({query}))"
        text = text[:begin] + " " + out + text[close + 1 :]


class Semantics:
    """Definitions by text and features by name, each an SQL expression over ``{col}``.

    A definition's expression is a probability; a feature's may be of any type (``kind``). A definition
    in ``evaluators`` is judged by an evaluator of any kind, with saved answers and limits as ``judge``
    takes them, over the rows of the table that the column is of; its decisions stand in columns of that
    table, ``judged`` by column and definition, before the statement runs."""

    def __init__(
        self, definitions: dict[str, str] | None = None, features: dict[str, tuple[str, str]] | None = None, accept: float = 0.8, reject: float = 0.2,
        evaluators: dict[str, object] | None = None, options: dict | None = None,
    ):
        self.definitions, self.features, self.accept, self.reject = definitions or {}, features or {}, accept, reject
        self.evaluators, self.options = evaluators or {}, options or {}

    @staticmethod
    def definition(a: list[str]) -> str:
        return a[1].strip()[1:-1].replace("''", "'")

    def predicate(self, a: list[str], whole: bool = False) -> str:
        """``whole``: a decision that stays open stops the statement."""
        definition = self.definition(a)
        rest = f" ELSE CAST(raise_error('unresolved semantic decision under a subquery, EXISTS or outer join: {definition.replace(chr(39), '').replace(chr(92), '')}') AS BOOLEAN)" if whole else ""
        if definition in self.evaluators:
            prefix, _, column = a[0].strip().rpartition(".")
            held = f"{prefix}{'.' if prefix else ''}{self.column(column, definition)}"
            return f"(CASE WHEN {a[0]} IS NULL THEN NULL WHEN {held} IS NOT NULL THEN {held}{rest} END)"
        if definition not in self.definitions:
            raise SqlError(f"no definition {definition!r}")
        p = "(" + self.definitions[definition].replace("{col}", a[0]) + ")"
        return f"(CASE WHEN {a[0]} IS NULL THEN NULL WHEN {p} >= {self.accept} THEN true WHEN {p} <= {self.reject} THEN false{rest} END)"

    @staticmethod
    def column(column: str, definition: str) -> str:
        return f"_semantic_{hashlib.sha256(f'{column.lower()}:{definition}'.encode()).hexdigest()[:12]}"

    def judged(self, text: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables, with the decisions that the statement asks an evaluator for."""
        asked: list[tuple[str, str]] = []
        rewrite_calls(text, {"semantic": lambda a: asked.append((a[0].strip().rpartition(".")[2], self.definition(a))) or "true"})
        out = dict(tables)
        for column, definition in dict.fromkeys(asked):
            if definition not in self.evaluators:
                continue
            owners = [t for t, df in tables.items() if column.lower() in (c.lower() for c in df.columns)]
            if not owners:
                raise SqlError(f"no table given has the column {column}")
            for t in owners:
                held = self.column(column, definition)
                decided = judge(out[t], {held: proposition(definition)}, self.evaluators[definition], needed=F.col(column).isNotNull(), **self.options)
                out[t] = decided.withColumn(held, F.col(f"{held}.value_bool"))
        return out

    def feature(self, a: list[str]) -> str:
        name = a[1].strip()[1:-1]
        if name not in self.features:
            raise SqlError(f"no feature {name!r}")
        kind, expr = self.features[name]
        if kind == "boolean":
            p = "(" + expr.replace("{col}", a[0]) + ")"
            return f"(CASE WHEN {a[0]} IS NULL THEN NULL WHEN {p} >= {self.accept} THEN true WHEN {p} <= {self.reject} THEN false END)"
        return "(" + expr.replace("{col}", a[0]) + ")"


def needs_whole(text: str) -> bool:
    """Whether an unresolved predicate could change the answer silently: there is a subquery, EXISTS or
    outer join beside it. A common table isn't a subquery."""
    bare = masked(text).lower()
    if not re.search(r"\bsemantic\s*\(", bare):
        return False
    nested = re.sub(r"\bas\s*\(\s*(?=select|with)", "as ", bare)
    return bool(re.search(r"\(\s*(?:select|with)\b|\bexists\b|\b(?:left|right|full)\s+(?:outer\s+)?join\b", nested))


def check_partial(text: str, complete: bool) -> None:
    """The rule as a check of a statement whose decisions are known to be whole or not."""
    if not complete and needs_whole(text):
        raise SqlError("unresolved semantic decisions under a subquery, EXISTS or outer join")


def check_lineage(text: str) -> None:
    """SEMANTIC on the side that an outer join fills with nulls is refused."""
    bare = masked(text)
    filled = {m[1].lower() for m in re.finditer(r"(?i)\bleft\s+(?:outer\s+)?join\s+\w+(?:\s+as)?\s+(\w+)\s+on\b", bare)}
    for m in re.finditer(r"(?i)\b(\w+)(?:\s+as)?\s+(\w+)\s+(?:right|full)\s+(?:outer\s+)?join", bare):
        filled.add(m[2].lower())
    for m in re.finditer(r"(?i)\bsemantic\s*\(\s*(\w+)\s*\.", bare):
        if m[1].lower() in filled:
            raise SqlError(f"SEMANTIC on {m[1]}, which an outer join fills with nulls")


def prepare(text: str, semantics: Semantics | None = None) -> str:
    guard(text)
    check_lineage(text)
    whole = needs_whole(text)
    out = any_all(text)
    if semantics:
        out = rewrite_calls(out, {"semantic": lambda a: semantics.predicate(a, whole), "semantic_feature": semantics.feature})
    return rewrite_calls(out, SHIMS).strip().rstrip(";")


def check_parsed(spark: SparkSession, text: str) -> None:
    """No function in the parsed statement that the guard, which reads the text, didn't see."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    seen = set(re.findall(r"\w+", masked(text).lower()))  # some operators are functions to the parser
    hidden = {m.group(1).lower() for m in re.finditer(r"'(\w+)\(", plan)} - seen
    if hidden:
        raise SqlError(f"the function {min(hidden)} isn't allowed")


def run_sql(spark: SparkSession, text: str, semantics: Semantics | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of a guarded statement over views, or over given tables. Under a subquery, EXISTS or
    outer join a semantic decision that stays open stops it."""
    ready = prepare(text, semantics)
    check_parsed(spark, ready)
    if semantics and semantics.evaluators:
        tables = semantics.judged(text, tables or {})
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    out = spark.sql(ready)
    return out.drop(*(c for c in out.columns if c.startswith("_semantic_")))


# -- changes


def preview_change(df: DataFrame, key: list[str], where, assignments: dict | None, *, limit: int | None = 1_000) -> DataFrame:
    """Rows that an update (``assignments``) or delete (None) would change, before and after; an error if
    they are more than ``limit``. With None any number of them: a projection, so nothing is gathered."""
    hit = df.where(where)
    if limit is not None and hit.limit(limit + 1).count() > limit:
        raise SqlError(f"more than {limit} rows are affected")
    after = F.lit(None) if assignments is None else F.struct(*((assignments[c] if c in assignments else F.col(c)).alias(c) for c in df.columns))
    return hit.select(*key, F.struct(*df.columns).alias("before"), after.alias("after"))


def commit_change(df: DataFrame, key: list[str], reviewed: DataFrame, path: str) -> DataFrame:
    """The new snapshot, written to a new path: reviewed rows replaced or removed, if they are still as
    they were when reviewed."""
    now = df.select(*key, F.struct(*df.columns).alias("now"))
    if reviewed.join(now, key, "left").where(~F.col("before").eqNullSafe(F.col("now"))).limit(1).count():
        raise SqlError("rows changed since the review")
    rest = df.join(reviewed.select(*key), key, "left_anti").select(*df.columns)
    out = rest
    if dict(reviewed.dtypes)["after"] != "void":
        out = rest.unionByName(reviewed.where("after is not null").select("after.*"))
    out.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def insert_rows(df: DataFrame, rows: DataFrame, key: list[str], path: str) -> DataFrame:
    """The snapshot with new rows, whose keys must be new."""
    if rows.join(df, key, "left_semi").limit(1).count() or rows.groupBy(*key).count().where("count > 1").limit(1).count():
        raise SqlError("keys that are there already")
    df.unionByName(rows.select(*df.columns)).write.parquet(path)
    return df.sparkSession.read.parquet(path)
