"""Secret scan: patterns propose candidates, a random forest removes the false ones.

Candidates are well-known key shapes, values assigned to telling names, and long mixed strings. Each
becomes features of its length, characters and their transitions, coverage by a dictionary of frequent
syllables, the path it stands under and the words beside it. A forest of decision trees, trained from labelled
findings, gives the probability that a candidate is a secret. ``labelled_findings`` makes the findings
used unless others are given: real shapes against placeholders, digests of commits and files, uuids,
numbers, identifiers, links and plain words.

Edge cases: null and empty texts have no candidates; a secret that stands several times is reported
at each place; each input row gives a row; a null path is the empty path; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import id_ddl, map_arrow, quiet_gc, texts_of

THRESHOLD = 0.5
TREES, DEPTH, FINDINGS, SEED = 40, 9, 3000, 7

_SHAPES = re.compile(
    r"(?<![A-Za-z0-9])(?:(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])|(?P<git>gh[pousr]_[A-Za-z0-9]{30,})|(?P<chat>xox[abeoprs]-[A-Za-z0-9-]{10,})"
    r"|(?P<api>sk-[A-Za-z0-9_-]{20,})|(?P<map>AIza[A-Za-z0-9_-]{35})|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*))"
    r"|(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z))"
)
_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ", "-----BEGIN ")
_ASSIGNED = re.compile(r"(?i)(?P<name>token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|key)[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?P<value>[^\s\"'<>,;]{6,})")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+\d)[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_NAMES = re.compile(r"(?i)token|secret|passw|passwd|pwd|key|auth|cred|bearer")
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|\*\*\*|test|fake|redacted|<|\$\{|1234|abcd")
_INERT = re.compile(r"(?i)commit|sha|md5|hash|checksum|digest|revision|etag|uuid|guid|version|href|http|version|build|color")
_TESTS = re.compile(r"(?i)test|example|sample|fixture|mock|doc|spec|demo")
_SYLLABLES = frozenset("the and ing ion ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat und ein ich sch der die das que los las del para con por ado men les des une tion tre eur eau".split())


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, by start, the longer first; they may overlap."""
    found: list[tuple[int, int, str]] = []
    if any(h in text for h in _HINTS):
        found += [(m.start(), m.end(), m.lastgroup) for m in _SHAPES.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span("value"), "assigned") for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "mixed") for m in _MIXED.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or span[:2] != out[-1][:2]:
            out.append(span)
    return out


_DIGIT = re.compile(r"[0-9]")
_KINDS = {"aws": 1, "git": 2, "chat": 3, "api": 4, "map": 5, "jwt": 6, "pem": 7, "assigned": 8, "mixed": 9}


def features(value: str, left: str, right: str, path: str, kind: str) -> list[float]:
    n = len(value) or 1
    body = value.strip("\"'`!?.,;:#$%&*|")
    classes = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in body]
    count = Counter(classes)
    freq = Counter(body)
    m = len(body) or 1
    lower = body.lower()
    covered = np.zeros(m, bool)
    for k in (3, 4):
        for i in range(len(lower) - k + 1):
            if lower[i : i + k] in _SYLLABLES:
                covered[i : i + k] = True
    runs = max((len(r) for r in re.findall(r"(.)\1*", body, re.S) and [x.group() for x in re.finditer(r"(.)\1*", body, re.S)]), default=0)
    steps = sum(1 for a, b in zip(body, body[1:]) if abs(ord(a) - ord(b)) == 1)
    before = left[-40:]
    return [
        float(n), -sum(v / m * math.log2(v / m) for v in freq.values()), len(freq) / m,
        count["u"] / m, count["l"] / m, count["d"] / m, count["s"] / m,
        sum(a != b for a, b in zip(classes, classes[1:])) / m,
        sum(a == "l" and b == "d" or a == "d" and b == "l" for a, b in zip(classes, classes[1:])) / m,
        float(covered.mean()), float(runs), steps / m,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", body))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", body))),
        float(bool(_PLACEHOLDER.search(value))), float(body.isdigit()), float("/" in body or "\\" in body), float(body.count(".")),
        float(bool(_NAMES.search(before))), float(bool(_INERT.search(before))), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before.rstrip(" ").endswith(("\"", "'"))),
        float(bool(_PLACEHOLDER.search(right[:30]))), float(bool(_TESTS.search(path))), float(path.count("/")), float(_KINDS.get(kind, 0)),
    ]


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, str, int]]:
    """(value, words before, words after, path, kind, is a secret), made from a seed."""
    r = random.Random(seed)
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: "".join(r.choice(("the", "tion", "er", "an", "ing", "re", "st", "ha", "ou", "ea", "que", "ment", "sch", "ein", "con", "ar")) for _ in range(r.randint(1, 4)))
    prose = lambda k=5: " ".join(word() for _ in range(k))
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "access_key", "client_secret", "auth_token", "private_key", "TOKEN", "PASSWORD", "API_KEY", "credential", "Authorization: Bearer"]
    ops = [" = \"", "=", ": ", " = '", ": \"", "=\"", " := \"", " = "]
    paths = ["", "src0", "src7", "config/app.yml", "deploy/prod.env", "lib/client.py", "notes.txt"]
    made = []
    for _ in range(count):
        path, pre, post = r.choice(paths), prose() + " ", r.choice(["\" ", " ", "' ", ""]) + prose()
        if r.random() < 0.5:
            pick = r.randrange(13)
            value, kind = (
                (draw(hexa, r.choice((16, 18, 24, 32, 40, 64))), "assigned"), (draw(alnum, r.randint(10, 48)), "assigned"), (draw(b64, r.randint(24, 64)) + "=" * r.randint(0, 2), "assigned"),
                (r.choice(("AKIA", "ASIA")) + draw(string.ascii_uppercase + string.digits, 16), "aws"), ("ghp_" + draw(alnum, 36), "git"), ("xoxb-" + draw(string.digits, 11) + "-" + draw(alnum, 24), "chat"),
                ("sk-" + draw(alnum, r.randint(24, 48)), "api"), ("eyJ" + draw(b64[:62], 20) + "." + draw(b64[:62], 40) + "." + draw(b64[:62], 43), "jwt"), (draw(alnum + "!@#%^&*", r.randint(8, 20)), "assigned"),
                (draw(r.choice((alnum, b64)), r.randint(24, 120)), "mixed"), ("AIza" + draw(alnum + "_-", 35), "map"),
                ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(draw(b64, 64) for _ in range(r.randint(3, 25))) + "\n-----END RSA PRIVATE KEY-----", "pem"),
                (word() + draw(string.digits, r.randint(1, 4)) + r.choice((str.lower, str.capitalize))(word()) + draw(string.ascii_uppercase + string.digits + "!#", r.randint(0, 3)), "assigned"),
            )[pick]
            if kind == "assigned":
                pre += r.choice(names) + r.choice(ops)
                if r.random() < 0.15:
                    value = value.upper()
            if r.random() < 0.2:
                value += r.choice(["!!", "###", "%%%", ".", "$$$"]) if kind == "assigned" else ""
            made.append((value, pre, post, path, kind, 1))
            continue
        pick = r.randrange(11)
        if pick == 0:  # placeholders
            value, pre, kind = r.choice(("your_token_here", "changeme", "xxxxxxxxxxxxxxxx", "EXAMPLE_KEY_1234", "<password>", "${TOKEN}", "dummy-secret-value", "********", "redacted", "example1234example")), pre + r.choice(names) + r.choice(ops), "assigned"
        elif pick == 1:
            value, pre, kind = draw(hexa, r.choice((32, 40, 64))), pre + r.choice(("commit ", "sha256: ", "md5=", "checksum ", "digest: ", "revision ", "etag: ", "sha1 = ")), "mixed"
        elif pick == 2:
            value, kind = "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), "mixed"
        elif pick == 3:
            value, kind = draw(string.digits, r.randint(20, 30)), "mixed"
        elif pick == 4:
            value, kind = "/".join(word() for _ in range(4)) + f"/v{r.randint(1, 9)}/" + word(), "mixed"
        elif pick == 5:
            value, kind = "_".join(word() for _ in range(4)) + str(r.randint(0, 99)), "mixed"
        elif pick == 6:
            value, pre, kind = word() + word(), pre + r.choice(names) + r.choice((": ", " = ", "=")), "assigned"
        elif pick == 7:
            value, pre, kind = "AKIA" + r.choice(("IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEEXAMPLE12")), pre, "aws"
        elif pick == 8:
            value, pre, kind = draw(alnum, r.randint(8, 30)), pre + r.choice(names) + r.choice(ops), "assigned"
            path = r.choice(("tests/fixtures/keys.py", "docs/example.md", "spec/mock_auth.rb"))
            value = "test_" + value
        elif pick == 9:
            value, pre, kind = r.choice(("os.environ['TOKEN']", "getPassword()", "settings.API_KEY", "null", "undefined", "process.env.SECRET", "config.password")), pre + r.choice(names) + " = ", "assigned"
        else:
            value, kind = (word() + "-" + word() + "-" + word() + f"-{r.randint(2000, 2030)}-" + word() + word()), "mixed"
        made.append((value, pre, post, path, kind, 0))
    return made


class Forest:
    """Bagged trees with Gini splits over a random subset of features at each node."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, least: int = 3):
        self.trees, self.depth, self.seed, self.least = trees, depth, seed, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.roots = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            self.roots.append(self._grow(x[rows], y[rows], rng, self.depth))
        return self

    def _grow(self, x, y, rng, depth):
        share = float(y.mean()) if len(y) else 0.5
        if depth == 0 or len(y) < 2 * self.least or share in (0.0, 1.0):
            return share
        best = None
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.least) & (cut <= len(y) - self.least)]
            if not len(cut):
                continue
            a, pa_, n, total = cut, t[cut - 1], len(y), t[-1]
            b, pb = n - a, total - pa_
            cost = pa_ * (a - pa_) / a + pb * (b - pb) / b
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (cost[i], f, (v[cut[i] - 1] + v[cut[i]]) / 2)
        if best is None:
            return share
        _, f, at = best
        left = x[:, f] <= at
        return (int(f), float(at), self._grow(x[left], y[left], rng, depth - 1), self._grow(x[~left], y[~left], rng, depth - 1))

    def probability(self, row: list[float]) -> float:
        total = 0.0
        for node in self.roots:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.roots)


def train(findings) -> Forest:
    """A forest from (value, words before, words after, path, kind, is a secret) rows."""
    x = np.array([features(*f[:5]) for f in findings])
    return Forest().fit(x, np.array([f[5] for f in findings], np.float64))


@lru_cache(maxsize=2)
def _default_forest() -> Forest:
    return train(labelled_findings())


def find_secrets(text: str, path: str, forest: Forest, threshold: float = THRESHOLD) -> tuple[int, list[tuple[int, int, str, float]]]:
    """Number of candidates, and (start, end, kind, probability) of those that are secrets; secrets
    that overlap are one."""
    spans = candidates(text)
    out = []
    for start, end, kind in spans:
        if out and end <= out[-1][1]:
            continue
        p = forest.probability(features(text[start:end], text[max(0, start - 60) : start], text[end : end + 40], path, kind))
        if p >= threshold:
            while end > start + 1 and text[end - 1] in "!?.,;:#$%&*|":
                end -= 1
            if out and start < out[-1][1]:
                start, kind, p = out[-1][0], out[-1][2], max(p, out.pop()[3])
            out.append((start, end, kind, p))
    return len(spans), out


def scan(docs: DataFrame, *, findings: list | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, n_candidates, n_secrets, secrets``: spans in code points with kind and probability."""
    given = train(findings) if findings else None
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batch: pa.RecordBatch):
        quiet_gc()
        forest = given or _default_forest()
        n, hits = [], []
        for text, where in zip(texts_of(batch), batch.column("path").to_pylist()):
            k, found = find_secrets(text, where, forest, threshold)
            n.append(k)
            hits.append([{"start": s, "end": e, "kind": kind, "probability": p} for s, e, kind, p in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(hits, kind)], ["doc_id", "n_candidates", "n_secrets", "secrets"])

    return map_arrow(rows, run, f"doc_id {id_ddl(docs, id_col)}, n_candidates bigint, n_secrets bigint, secrets array<struct<start: int, end: int, kind: string, probability: double>>")


def redact(docs: DataFrame, *, findings: list | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]", text_col: str = "text", path_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with each secret replaced by ``mark``, and the length column,
    where there is one, brought up to date for texts that changed."""
    given = train(findings) if findings else None
    names, has_path, has_length = docs.columns, path_col in docs.columns, length_col in docs.columns

    def run(batch: pa.RecordBatch):
        quiet_gc()
        forest = given or _default_forest()
        paths = batch.column(path_col).to_pylist() if has_path else [""] * batch.num_rows
        lengths = batch.column(length_col).to_pylist() if has_length else None
        texts = batch.column(text_col).to_pylist()
        for i, text in enumerate(texts):
            found = find_secrets(text, str(paths[i] or ""), forest, threshold)[1] if text else ()
            if found:
                out, at = [], 0
                for s, e, *_ in found:
                    out += [text[at:s], mark]
                    at = e
                texts[i] = "".join([*out, text[at:]])
                if lengths:
                    lengths[i] = len(texts[i])
        columns = [pa.array(texts, batch.schema.field(c).type) if c == text_col else pa.array(lengths, batch.schema.field(c).type) if c == length_col else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, docs.schema)
