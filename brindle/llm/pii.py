"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Expectation-maximisation over all votes of the corpus estimates how reliable each labeler is for each kind; its
posteriors train the span classifier that decides on candidates. Base spans (exact patterns) always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_append, map_rows, unused

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Kinds whose regex labeler verifies a checksum; it starts as almost certain, with as much weight as the data.
CHECKED = ("card", "iban")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[(]\s?at\s?[\])]\s?")
_DOT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_VALUE = re.compile(r"[=:]\x20?[\"']?([A-Za-z0-9_+/=-]{12,})")
_KEY = re.compile(r"([A-Za-z_-]{2,24})[\"']?\x20?\Z")

# Fixed values of the gazetteer.
TLDS = frozenset("com org net edu gov mil int info biz io ai app dev de fr es it nl pl uk us ca au jp cn in br mx ch at be se no dk fi pt ru eu co".split())
IBAN_LENGTH = dict(DE=22, FR=27, ES=24, IT=27, NL=18, BE=16, AT=20, CH=21, GB=22, PL=28, PT=25, SE=24, NO=15, DK=18, FI=18, IE=22, LU=20)
SECRET_KEYS = frozenset("token secret password passwd pwd apikey api_key api-key access_key auth authorization bearer private_key client_secret".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "64", "65", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420", "972")
CUES = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "whatsapp", "sms"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("token", "secret", "passw", "pwd", "key", "auth", "credential", "login"),
}
AGAINST = ("version", "isbn", "issn", "page", "seite", "order", "invoice", "sku", "serial", "figure", "table", "section", "release", "http", "www")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str, sign: re.Pattern | None = None, domain: re.Pattern = _DOMAIN):
    """Leftmost non-overlapping addresses, found from their signs: the run of local characters before one can only begin
    an address with that sign, so this equals a scan with the whole pattern and takes linear time."""
    done, at = 0, -1
    while True:
        if sign is None:
            at = after = text.find("@", at + 1)
            after += 1
        else:
            m = sign.search(text, at + 1)
            at, after = (m.start(), m.end()) if m else (-1, 0)
        if at < 0:
            return
        low = at
        if sign is not None and low > done and text[low - 1] == " ":
            low -= 1
        start = low
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < low and (m := domain.match(text, after)):
            yield start, m.end()
            done, at = m.end(), m.end() - 1


def _ip_fits(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in BASE_KINDS, then start; code points, end exclusive."""
    return _scan(text)[0]


def _scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and card-like runs whose check digit is wrong."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    cards, wrong = [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19:
            (cards if luhn(d) else wrong).append(("card", m.start(), m.end()))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_fits(m.group())] if text.count(".") > 2 else []
    out += cards
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out, wrong


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def candidates(text: str, wrong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans beyond the base patterns that labelers vote on."""
    out = list(wrong)
    if "at" in text:
        out += [("email", s, e) for s, e in _emails(text, _AT, _DOT_DOMAIN)]
    out += [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    if "-" in text:
        out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    out += [("secret", m.start(1), m.end(1)) for m in _VALUE.finditer(text)]
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, int, int]:
    """The regex, gazetteer and context labelers' votes: 1 for, 0 against, 2 none."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - 40) : start].lower()
    shape, known = 2, 2
    if kind == "email":
        last = span.rpartition(".")[2].rstrip(")] ").lower()
        shape, known = int(last.isalpha() and len(last) > 1), int(last in TLDS)
    elif kind == "ip":
        parts = span.split(".")
        shape, known = int(all(p == "0" or p[0] != "0" for p in parts)), 0 if parts[0] in ("0", "127") else 2
    elif kind == "card":
        shape, known = int(luhn(digits)), int(digits[0] in "3456" or digits[:2] == "22")
    elif kind == "phone":
        shape = int(8 <= len(digits) <= 15 if span[0] == "+" else digits[0] > "1" and digits[3] > "1")
        known = int(digits.startswith(CALLING)) if span[0] == "+" else 2
    elif kind == "iban":
        plain = span.replace(" ", "")
        shape = int(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
        known = int(IBAN_LENGTH.get(plain[:2]) == len(plain))
    elif kind == "ssn":
        shape, known = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"), 2
    else:
        name = _KEY.search(before.rstrip("\"' ").rstrip("=:"))
        shape = int(_entropy(span) > 3 and any(c.isdigit() for c in span))
        known = int(name.group(1).lower().strip("_-") in SECRET_KEYS) if name else 2
    context = 1 if any(c in before for c in CUES[kind]) else 0 if any(c in before for c in AGAINST) else 2
    return shape, known, context


def pattern(text: str, kind: str, start: int, end: int) -> str:
    """The discrete features of a span: kind, votes, length and entropy bands."""
    a, b, c = votes(text, kind, start, end)
    span = text[start:end]
    return f"{kind}|{a}{b}{c}|{min(5, (end - start).bit_length())}|{min(4, int(_entropy(span)))}"


@dataclass(frozen=True)
class Model:
    """reliability: (kind, labeler) -> (right on personal data, right on others); accepted: patterns taken as personal data."""

    reliability: dict
    weights: dict
    threshold: float = 0.5

    def probability(self, p: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(p))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(p: str) -> list[str]:
    kind, v, size, entropy = p.split("|")
    return ["bias", f"k={kind}", *(f"{kind}:{i}={x}" for i, x in enumerate(v)), *(f"v{i}={x}" for i, x in enumerate(v)), f"{kind}:l={size}", f"{kind}:h={entropy}"]


class Taken:
    """The union of spans as sorted disjoint ranges; whether a range is free of them is one binary search."""

    def __init__(self, spans: Iterable[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.add(spans)

    def add(self, spans: Iterable[tuple[str, int, int]]) -> None:
        ranges = sorted([*zip(self.starts, self.ends, strict=True), *((s, e) for _, s, e in spans)])
        self.starts, self.ends = [], []
        for s, e in ranges:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


def pattern_counts(docs: DataFrame) -> DataFrame:
    """pattern, n over all spans and candidates of all texts; there are a few thousand patterns at most, whatever the corpus."""

    def run(texts):
        c: Counter = Counter()
        for t in texts:
            if t:
                base, wrong = _scan(t)
                c.update(pattern(t, *s) for s in base)
                taken = Taken(base)
                c.update(pattern(t, *s) for s in candidates(t, wrong) if taken.free(s[1], s[2]))
        return {"pattern": list(c), "n": list(c.values())}

    return map_rows(docs, run, "pattern string, n bigint", "text").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(counts: dict[str, int], rounds: int = 50) -> Model:
    """Dawid-Skene EM by kind on the votes, then logistic regression of the posteriors on all features.

    Starts from the share of votes in favour; smoothing keeps a labeler from being certain. Deterministic.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = [k.split("|")[0] for k in keys]
    vote = np.array([[int(x) for x in k.split("|")[1]] for k in keys]).reshape(len(keys), 3)
    cast = vote < 2
    q = np.clip(((vote == 1).sum(1) + 0.5) / (cast.sum(1) + 1), 0.05, 0.95)
    q[(vote[:, 0] == 0)] = np.minimum(q[vote[:, 0] == 0], 0.2)
    reliability = {}
    for k in sorted(set(kind)):
        rows = np.flatnonzero([x == k for x in kind])
        m, v, c = n[rows], vote[rows], cast[rows]
        for _ in range(rounds):
            w = m * q[rows]
            prior = (w.sum() + 1) / (m.sum() + 2)
            sure = np.array([m.sum() if k in CHECKED else 0.0, 0, 0])
            good = np.array([((w * (v[:, j] == 1)).sum() + 8 + 0.98 * sure[j]) / ((w * c[:, j]).sum() + 10 + sure[j]) for j in range(3)])
            bad = np.array([(((m - w) * (v[:, j] == 0)).sum() + 8 + 0.98 * sure[j]) / (((m - w) * c[:, j]).sum() + 10 + sure[j]) for j in range(3)])
            yes = np.log(prior) + (np.log(good) * (v == 1) + np.log(1 - good) * (v == 0)).sum(1)
            no = np.log(1 - prior) + (np.log(1 - bad) * (v == 1) + np.log(bad) * (v == 0)).sum(1)
            q[rows] = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
        for j, name in enumerate(("regex", "gazetteer", "context")):
            reliability[k, name] = (float(good[j]), float(bad[j]))
    names = sorted({f for k in keys for f in features(k)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, k in enumerate(keys):
        x[i, [at[f] for f in features(k)]] = 1
    w, weight = np.zeros(len(names)), np.sqrt(n)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(names))
        w -= np.clip(np.linalg.solve(h, x.T @ (weight * (p - q)) + 0.05 * w), -3, 3)
    return Model(reliability, dict(zip(names, w.tolist(), strict=True)))


def train(docs: DataFrame) -> Model:
    """Fit on the votes of every text. An empty table gives a model that accepts nothing beyond base spans."""
    counts = {r.pattern: r.n for r in pattern_counts(docs).collect()}
    return fit(counts) if counts else Model({}, {"bias": -30.0})


def all_spans(text: str, model: Model, memo: dict[str, bool]) -> tuple[list, list]:
    """(base spans, all spans), each by kind and start. A candidate is added if it overlaps no base span or earlier one."""
    base, wrong = _scan(text)
    more = []
    for s in candidates(text, wrong):
        p = pattern(text, *s)
        if p not in memo:
            memo[p] = model.probability(p) >= model.threshold
        if memo[p]:
            more.append(s)
    if not more:
        return base, base
    taken, spans = Taken(base), list(base)
    for _, same in groupby(more, key=lambda x: x[0]):  # spans of one kind are in order and do not overlap each other
        new = [x for x in same if taken.free(x[1], x[2])]
        taken.add(new)
        spans += new
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row; null texts are empty. No shuffle."""

    def run(ids, texts):
        memo: dict[str, bool] = {}
        found = [all_spans(t or "", model, memo) for t in texts]
        out = {"doc_id": ids, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found], "n_spans": [len(a) for _, a in found]}
        return out | {f"n_{k}": [sum(x[0] == k for x in b) for b, _ in found] for k in BASE_KINDS}

    return map_rows(docs, run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint", "doc_id", "text")


def redacted(text: str | None, model: Model, memo: dict[str, bool]) -> str | None:
    """The text with ``[KIND]`` in place of each span; overlapping spans become one, named by the first."""
    if not text:
        return text
    _, spans = all_spans(text, model, memo)
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with redacted texts; n_chars, where there is one, follows the text."""
    name = unused(docs, "redacted")

    def run(texts):
        memo: dict[str, bool] = {}
        return {name: [redacted(t, model, memo) for t in texts]}

    rows = map_append(docs, run, f"`{name}` string", "text").withColumn("text", F.col(f"`{name}`"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
