"""Functions of the accepted SQL surface that Spark spells or computes differently.

The names a statement may call are ``ALLOWED``; ``SHIMS`` rewrites those whose meaning differs from
Spark's built-in of the same name. ``translate_pattern`` turns date patterns over.
"""

from __future__ import annotations

import re

ALLOWED = frozenset(
    """abs all and any array_agg avg bool_and bool_or case cast ceil ceiling char_length coalesce concat concat_ws count cume_dist
    current_date current_time current_timestamp date date_add date_sub date_trunc datediff dense_rank exists exp extract first_value
    floor greatest group_concat if json_extract json_extract_scalar jsonb_extract jsonb_extract_scalar lag last_value lead least left
    length ln log logical_and logical_or lower ltrim max min mod not nth_value ntile nullif or percent_rank percentile_cont
    percentile_disc power rank regexp_replace replace right round row_number rtrim semantic semantic_feature split_part sqrt stddev
    stddev_pop stddev_samp str_to_date str_to_time strftime string_agg substring sum time time_to_str timestamp timestamp_trunc to_char
    to_date to_timestamp trim try_cast ts_or_ds_to_date ts_or_ds_to_timestamp upper var_pop var_samp variance""".split()
)

_PATTERN = (("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("Mon", "MMM"), ("Month", "MMMM"), ("Day", "EEEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"), ("US", "SSSSSS"), ("MS", "SSS"))
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


def translate_pattern(pattern: str) -> str:
    """A to_char or strftime pattern in Spark's letters."""
    if "%" in pattern:
        return re.sub(r"%[A-Za-z]", lambda m: _STRFTIME[m.group()], pattern)
    out, at = "", 0
    while at < len(pattern):
        for a, b in sorted(_PATTERN, key=lambda x: -len(x[0])):
            if pattern.startswith(a, at):
                out, at = out + b, at + len(a)
                break
        else:
            c = pattern[at]
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return out


def json_path(path: str) -> str:
    """A path array like {a,b} as $.a.b."""
    return "$." + ".".join(path.strip("{}").split(",")) if path.startswith("{") else path if path.startswith("$") else f"$.{path}"


def split_arguments(text: str) -> list[str]:
    """Arguments at the top level of a call's inside."""
    out, depth, at, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    last = text[at:].strip()
    return [*out, last] if last else out


def _literal(s: str) -> str:
    return s.strip()[1:-1]


SHIMS = {
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "group_concat": lambda a: f"listagg({', '.join(a)})",
    "logical_and": lambda a: f"bool_and({a[0]})",
    "logical_or": lambda a: f"bool_or({a[0]})",
    "to_char": lambda a: f"date_format({a[0]}, '{translate_pattern(_literal(a[1]))}')",
    "strftime": lambda a: f"date_format({a[0]}, '{translate_pattern(_literal(a[1]))}')",
    "time_to_str": lambda a: f"date_format({a[0]}, '{translate_pattern(_literal(a[1]))}')",
    "to_date": lambda a: f"to_date({a[0]}" + (f", '{translate_pattern(_literal(a[1]))}'" if len(a) > 1 else "") + ")",
    "str_to_date": lambda a: f"to_date({a[0]}, '{translate_pattern(_literal(a[1]))}')",
    "to_timestamp": lambda a: f"to_timestamp({a[0]}" + (f", '{translate_pattern(_literal(a[1]))}'" if len(a) > 1 else "") + ")",
    "str_to_time": lambda a: f"to_timestamp({a[0]}, '{translate_pattern(_literal(a[1]))}')",
    "ts_or_ds_to_date": lambda a: f"to_date({a[0]})",
    "ts_or_ds_to_timestamp": lambda a: f"cast({a[0]} as timestamp)",
    "timestamp_trunc": lambda a: f"date_trunc('{a[1].strip(chr(39))}', {a[0]})",
    "date": lambda a: f"to_date({a[0]})",
    "time": lambda a: f"date_format({a[0]}, 'HH:mm:ss')",
    "timestamp": lambda a: f"cast({a[0]} as timestamp)",
    "current_time": lambda a: "date_format(current_timestamp(), 'HH:mm:ss')",
    "json_extract": lambda a: f"get_json_object({a[0]}, '{json_path(_literal(a[1]))}')",
    "json_extract_scalar": lambda a: f"get_json_object({a[0]}, '{json_path(_literal(a[1]))}')",
    "jsonb_extract": lambda a: f"get_json_object({a[0]}, '{json_path(_literal(a[1]))}')",
    "jsonb_extract_scalar": lambda a: f"get_json_object({a[0]}, '{json_path(_literal(a[1]))}')",
}
SHIMS["regexp_replace"] = lambda a: f"regexp_replace({', '.join(a[:3])})" if len(a) > 3 and "g" in a[3] else _first_replace(a)


def _first_replace(a: list[str]) -> str:
    """Only the first match is replaced unless the flags have g: anchored by a lazy prefix."""
    pattern = _literal(a[1])
    return f"regexp_replace({a[0]}, '(?s)\\\\A(.*?)(?:{pattern})', concat('$1', {a[2]}))"
