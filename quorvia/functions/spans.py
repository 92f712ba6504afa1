"""Spans of text: sentences, passages, dates and typed scalars, as arrays of structs with offsets.

Offsets are code points. What built-in expressions can't give, offsets of repeated matches, comes from
Arrow functions; exact typed conversion uses Python decimals.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, text: string>>"
_ENDS = ".。!！?？"
SENTENCE_SQL = rf"[^{_ENDS}\n]+(?:$|[{_ENDS}])"
_SENTENCE = re.compile(SENTENCE_SQL)


def sentence_spans(text: str | None) -> list[dict]:
    """Sentences trimmed of white space, with the offsets of what is left."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        s = m.group()
        lead = len(s) - len(s.lstrip())
        body = s.strip()
        if body:
            out.append({"start": m.start() + lead, "end": m.start() + lead + len(body), "text": body})
    return out


def sentences(text: Column) -> Column:
    @F.pandas_udf(SPAN)
    def run(x: pd.Series) -> pd.Series:
        return x.map(sentence_spans)

    return run(text)


def sentence_texts(text: Column) -> Column:
    """The sentences without offsets, by built-in expressions alone."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_SQL), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


_TOKEN = re.compile(r"\S+")


def passage_spans(text: str | None, mode: str = "auto", token_limit: int = 160) -> list[dict]:
    """Passages by blank lines, lines or the whole document, each of at most ``token_limit`` tokens."""
    text = text or ""
    if mode == "auto":
        mode = "paragraph" if re.search(r"\n\s*\n", text) else "line" if "\n" in text else "document"
    cut = {"paragraph": r"\n\s*\n", "line": r"\n", "document": r"\Z(?!)"}[mode]
    out, at = [], 0
    for end, nxt in [*((m.start(), m.end()) for m in re.finditer(cut, text)), (len(text), len(text))]:
        tokens = [(m.start() + at, m.end() + at) for m in _TOKEN.finditer(text[at:end])]
        for i in range(0, len(tokens), token_limit):
            part = tokens[i : i + token_limit]
            out.append({"start": part[0][0], "end": part[-1][1], "text": text[part[0][0] : part[-1][1]]})
        at = nxt
    return out


def passages(text: Column, mode: str = "auto", token_limit: int = 160) -> Column:
    @F.pandas_udf(SPAN)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: passage_spans(t, mode, token_limit))

    return run(text)


_MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_CN_DAYS = "一二三四五六日"
_RELATIVE = dict(zip("yesterday today tomorrow 昨天 今天 明天".split(), (-1, 0, 1) * 2))
#: The look-ahead passes over most places by one letter, before the alternatives are tried.
_DATE = re.compile(
    r"(?=[0-9JFMASONDYTLjfmasondytlſ今昨明上])(?:(?P<iso>[0-9]{4}(?:-[0-9]{1,2}){2})|(?P<cn>[0-9]{4}\s?年\s?[0-9]{1,2}\s?月\s?[0-9]{1,2}\s?日)|(?P<slash>(?:[0-9]{1,2}/){2}[0-9]{4})"
    r"|(?P<named>(?i:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})"
    r"|(?P<rel>(?i:\b(?:today|yesterday|tomorrow)\b)|今天|昨天|明天)|(?P<last>(?i:\blast\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b)|上周[一二三四五六日天]))"
)


def date_spans(text: str | None, today: dt.date, locale: str) -> list[dict]:
    """Dates in a text; ``value`` is null where the locale leaves the order of day and month open or
    the date doesn't exist."""
    out = []
    for m in _DATE.finditer(text or ""):
        kind, s, value = m.lastgroup, m.group(), None
        n = [int(x) for x in re.findall(r"\d+", s)]
        try:
            if kind in ("iso", "cn"):
                value = dt.date(*n)
            elif kind == "slash" and locale in ("en-US", "en-GB"):
                value = dt.date(n[2], n[0], n[1]) if locale == "en-US" else dt.date(n[2], n[1], n[0])
            elif kind == "named":
                value = dt.date(n[1], _MONTHS[s.split()[0].lower()], n[0])
            elif kind == "rel":
                value = today + dt.timedelta(_RELATIVE[s.lower()])
            elif kind == "last":
                day = _DAYS.index(s.split()[-1].lower()) if s[0] not in "上" else _CN_DAYS.index(s[-1].replace("天", "日"))
                value = today - dt.timedelta((today.weekday() - day - 1) % 7 + 1)
        except ValueError:
            value = None
        out.append(dict(zip(("start", "end", "text", "value"), (*m.span(), s, value))))
    return out


_SCALES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9, "万": 10**4, "亿": 10**8, "千": 10**3, "百万": 10**6}
_NUMBER = re.compile(r"^(?P<open>\()?\s*(?P<sign>[-+−])?\s*(?P<cur>[$€£¥]|USD|EUR|GBP|CNY)?\s*(?P<sign2>[-+−])?(?P<body>\d[\d,. ]*)(?P<exp>[eE][-+]?\d{1,3})?\s*(?P<scale>thousand|million|billion|bn|k|m|万|亿|千|百万)?\s*(?P<pct>%)?\s*(?P<cur2>元|美元|dollars?|euros?)?\s*(?P<close>\))?$", re.I)
NUMERIC_BOUND = Decimal(10) ** 28
_EXACT = Context(prec=60)


def to_number(text: str | None, *, decimal: str = ".", group: str = ",", percent: str = "keep") -> Decimal | None:
    """An exact number of at most 28 whole and 10 decimal digits, or None. ``percent``: keep the figure,
    take it as a ratio, or reject it."""
    m = _NUMBER.match((text or "").strip())
    if not m or bool(m["open"]) != bool(m["close"]):
        return None
    body = m["body"].strip().replace(" ", "")
    whole, _, rest = body.partition(decimal)
    if group and group in whole:
        parts = whole.split(group)
        if not 1 <= len(parts[0]) <= 3 or any(len(p) != 3 for p in parts[1:]):
            return None
        whole = "".join(parts)
    if not whole.isdigit() or rest and not rest.isdigit():
        return None
    try:
        value = Decimal(f"{whole}.{rest or 0}")
    except InvalidOperation:
        return None
    value = _EXACT.multiply(value, Decimal(_SCALES.get((m["scale"] or "").lower(), 1)))
    if m["exp"]:
        value = value.scaleb(int(m["exp"][1:]), context=_EXACT)
    if m["pct"]:
        if percent == "reject":
            return None
        value = value.scaleb(-2, context=_EXACT) if percent == "ratio" else value
    if m["open"] or "-" in (m["sign"] or "") + (m["sign2"] or "") or "−" in (m["sign"] or "") + (m["sign2"] or ""):
        value = value.copy_negate()
    if value and not -12 < value.adjusted() < 28:
        return None
    if value.copy_abs() >= NUMERIC_BOUND:
        return None
    exact = value.quantize(Decimal(1).scaleb(-10), context=_EXACT)
    return value if exact == value else None


def convert(text: str | None, kind: str, **options):
    """text, integer, number or date from its exact wording; None where it isn't one."""
    if text is None:
        return None
    if kind == "text":
        return text
    if kind == "date":
        found = date_spans(text.strip(), dt.date(1970, 1, 1), options.get("locale", ""))
        return found[0]["value"] if len(found) == 1 and found[0]["text"] == text.strip() and not re.match(r"(?i)today|yest|tomo|last|[今昨明上]", text.strip()) else None
    number = to_number(text, **options)
    if number is None or kind == "number":
        return number
    return int(number) if number == number.to_integral_value() and abs(number) < 2**63 else None


def number_column(text: Column, **options) -> Column:
    @F.pandas_udf("decimal(38,10)")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: to_number(t, **options))

    return run(text)


_FIGURE = (
    r"(?:[-+−]\s?)?(?:(?:[$€£¥]|(?:USD|EUR|GBP|CNY)(?![A-Za-z]))\s?)?[-+−]?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?(?:[eE][-+]?[0-9]{1,3})?"
    r"(?:\s?(?:thousand|million|billion)(?![A-Za-z])|(?:bn|[kKmM])(?![A-Za-z])|\s?(?:百万|[万亿千]))?(?:\s?%)?(?:\s?(?:元|美元))?"
)
_SCALAR = re.compile(rf"(?i)(?=[(\-+−$€£¥UEGC0-9])(?<![A-Za-z0-9_.])(?:\({_FIGURE}\)|{_FIGURE})(?![0-9]|[.,][0-9])")


def scalar_spans(text: str | None) -> list[dict]:
    """Literal numbers, with sign, currency, exponent, scale and accounting parentheses, and dates of a
    passage. Digits within a word, a version or an ungrouped run of points aren't numbers."""
    text = text or ""
    dates = [(d["start"], d["end"]) for d in date_spans(text, dt.date(1970, 1, 1), "en-US")]
    spans = dates + [m.span() for m in _SCALAR.finditer(text) if not any(s < m.end() and m.start() < e for s, e in dates)]
    return [{"start": s, "end": e, "text": text[s:e]} for s, e in sorted(spans)]


_EN = {w: i for i, w in enumerate("nineteen eighteen seventeen sixteen fifteen fourteen thirteen twelve eleven ten nine eight seven six five four three two one zero".split()[::-1])} | {w: 10 * i for i, w in enumerate("ninety eighty seventy sixty fifty forty thirty twenty".split()[::-1], 2)}
_CN = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
_CN_UNIT = dict(zip("十百千万亿", (10**k for k in (1, 2, 3, 4, 8))))


def chinese_number(s: str) -> int | None:
    total = section = digit = 0
    for c in s:
        if c in _CN:
            digit = _CN[c]
        elif c in _CN_UNIT:
            unit = _CN_UNIT[c]
            if unit >= 10_000:
                total, section, digit = (total + section + digit) * unit, 0, 0
            else:
                section, digit = section + (digit or 1) * unit, 0
        else:
            return None
    return total + section + digit


def literals(request: str) -> dict[str, list]:
    """Numbers, quoted strings, dates and month ranges that a request names."""
    quoted = [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", request)]
    rest = re.sub(r"\"[^\"]*\"|'[^']*'", " ", request)
    dates = re.findall(r"\b[0-9]{4}(?:-[0-9]{2}){2}\b", rest)
    rest = re.sub(r"\b[0-9]{4}(?:-[0-9]{2}){2}\b", " ", rest)
    months = []
    for m in re.finditer(r"(?i)\b(" + "|".join(_MONTHS) + r")\s+(\d{4})\b", rest):
        first = dt.date(int(m[2]), _MONTHS[m[1].lower()], 1)
        months.append((first, (first.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)))
    rest = re.sub(r"(?i)\b(" + "|".join(_MONTHS) + r")\s+\d{4}\b", " ", rest)
    numbers = [Decimal(x.replace(",", "")) for x in re.findall(r"-?(?<![.\w])[0-9][,0-9]*(?:\.[0-9]+)?(?!\w)", rest)]
    numbers += [Decimal(_EN[w]) for w in re.findall(r"[a-z]+", rest.lower()) if w in _EN]
    numbers += [Decimal(n) for w in re.findall(r"[零一二三四五六七八九两〇十百千万亿]+", rest) if (n := chinese_number(w)) is not None]
    return {"numbers": numbers, "strings": quoted, "dates": [dt.date.fromisoformat(d) for d in dates], "months": months}
