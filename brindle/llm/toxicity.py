"""Toxicity: a weighted lexicon, learned from labelled rows and matched by Aho-Corasick in folded texts.

Folding maps look-alike letters and digit substitutions to plain letters. Entries are whole words and beginnings of words;
a hit inside an exception phrase does not count; the sum of weights is normalised by length and calibrated.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_append, map_rows, materialise, release, unused

# Letters of other scripts that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авеіјкмнорсѕтухԁһӏԛԝαβεικνορτυχ", "abeijkmhopcstyxdhlqwabeiknoptyx", strict=True))
SUBSTITUTES = dict(zip("013457@$€", "oieastase", strict=True))
DROPPED = "­​‌‍⁠﻿"
BREAKS = "\t\n\x0b\x0c\r!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~¡¿«»“”„‘’‚…–—·•   　"
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | dict.fromkeys(BREAKS, " ") | dict.fromkeys(DROPPED))

#: Phrases in which an otherwise toxic word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "idiot proof", "pond scum", "sore loser rule", "stupid simple", "moron city")

#: Labelled rows that are learned from, at most; the ones whose hashed ids are smallest.
MAX_LABELLED = 20_000
PREFIX = range(3, 9)
#: An entry needs this log-likelihood ratio (4 toxic documents and no clean one suffice) and this log odds.
LEAST_G, LEAST_WEIGHT = 17.0, 2.5


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, look-alikes and substitutions as plain letters, breaks as spaces; a space at either end."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


def entries_of(text: str) -> set[str]:
    """The lexicon entries that match a text: each word between spaces, and its beginnings after a space."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIX if k <= len(w))
    return out


@dataclass(frozen=True)
class Model:
    """entries: (entry, weight); slope and bias map normalised sums to probabilities; power is that of the length."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    bias: float
    power: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.entries:
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            key = f" {' '.join(fold(phrase).split())} "
            a.add_word(key, (len(key), None))
        if len(a):
            a.make_automaton()
        return a


_BUILT: dict[int, tuple] = {}


def _automaton(model: Model):
    key = hash(model)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = model.automaton()
    return _BUILT[key]


def hits(text: str | None, automaton) -> tuple[float, int]:
    """(sum of weights, number of words). A word counts once, with the heaviest entry that matches it."""
    words = fold(text or "").split()
    n = len(words) + 1
    if not len(automaton):
        return 0.0, n
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:  # a hit is excused if a phrase that begins at or before it reaches beyond it
        excused.sort()
        starts, reach, far = [], [], -1
        for a, b in excused:
            far = max(far, b)
            starts.append(a)
            reach.append(far)
        at = {s: bisect_right(starts, s) for s in best}
        best = {s: w for s, w in best.items() if not at[s] or reach[at[s] - 1] <= s}
    return sum(sorted(best.values())), n


def scores(texts: list[str | None], model: Model) -> list[float]:
    automaton = _automaton(model)
    found = [hits(t, automaton) for t in texts]
    x = np.array([w / n**model.power for w, n in found])
    return (1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -30, 30)))).tolist()


def held_out(doc_id) -> "F.Column":
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """text, toxic, half of at most ``most`` distinct labelled (doc_id, text) rows outside the held-out fold.

    An id with any label 1 is toxic. Ids and hashes are chosen first, so texts of chosen rows only are kept. half, 0 or
    1, is a hash of the text: what one half of the rows teaches is calibrated on the other.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    chosen = rows.select("doc_id", "th").join(F.broadcast(known), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(most)
    found = rows.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])  # ``most`` rows of three numbers
    return found.select("text", "toxic", F.pmod(F.xxhash64("th"), F.lit(2)).cast("int").alias("half"))


def _counts(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """entry, a, b: the number of texts of either half with each entry, summed within batches before the shuffle."""

    def run(texts, halves):
        c: Counter = Counter()
        for t, h in zip(texts, halves, strict=True):
            found = entries_of(t or "")
            c.update((e, h) for e in (found if only is None else found & only))
        names = {e for e, _ in c}
        return {"entry": list(names), "a": [c[e, 0] for e in names], "b": [c[e, 1] for e in names]}

    return map_rows(rows, run, "entry string, a bigint, b bigint", "text", "half", rows=256).groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _g(t: float, c: float, n1: float, n0: float) -> float:
    """The log-likelihood ratio of t of n1 against c of n0."""

    def part(k, n, p):
        return (k * np.log(k / (n * p)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if k < n and p < 1 else 0.0)

    p = (t + c) / (n1 + n0)
    return 2 * (part(t, n1, p) + part(c, n0, p))


def _fewest(n1: int, n0: int) -> int:
    """How many toxic texts an entry needs at least: without any clean one it must reach LEAST_G."""
    return next((k for k in range(1, n1 + 1) if _g(k, 0, n1, n0) >= LEAST_G), n1 + 1) if n1 and n0 else 1 << 60


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> tuple[tuple[str, float], ...]:
    """Every entry that tells toxic texts from clean ones, the strongest first."""
    fewest, found = _fewest(n1, n0), []
    for entry, k in toxic.items():
        if k >= fewest:
            c = clean.get(entry, 0)
            weight = np.log((k + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
            if weight >= LEAST_WEIGHT and (g := _g(k, c, n1, n0)) >= LEAST_G:
                found.append((-g, entry, round(float(weight), 6)))
    return tuple((e, w) for _, e, w in sorted(found))


def train(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = MAX_LABELLED) -> Model:
    """Learn the lexicon, then its calibration, from a bounded number of labelled rows (``most``).

    Entries of toxic rows that are frequent enough to be able to pass are counted first, then these among clean rows; all
    that pass the two thresholds are kept. For the calibration each half of the rows is scored with a lexicon of the other
    half, so no row is judged by entries it has taught. Without a row of either label the lexicon is empty and every
    score is 0. A doc_id that is repeated in ``docs`` or ``labels`` counts once for each of its texts.
    """
    rows = materialise(training_rows(docs, labels, most).repartition(12), "labelled")
    n = {(bool(r.toxic), r.half): r.n for r in rows.groupBy((F.col("toxic") == 1).alias("toxic"), "half").agg(F.count("*").alias("n")).collect()}
    size = lambda toxic, halves=(0, 1): sum(n.get((toxic, h), 0) for h in halves)
    if not size(True) or not size(False):
        return Model((), exceptions, 0.0, -30.0, 1.0)
    need = _fewest(size(True), size(False)), *(_fewest(size(True, [h]), size(False, [h])) for h in (0, 1))
    toxic = _counts(rows.filter("toxic = 1"), None).filter((F.col("a") + F.col("b") >= need[0]) | (F.col("a") >= need[1]) | (F.col("b") >= need[2]))
    t = {r.entry: (r.a, r.b) for r in toxic.collect()}
    c = {r.entry: (r.a, r.b) for r in _counts(rows.filter("toxic <> 1"), frozenset(t)).collect()}
    entries = _lexicon({e: sum(k) for e, k in t.items()}, {e: sum(k) for e, k in c.items()}, size(True), size(False))
    drafts = [Model(_lexicon({e: k[h] for e, k in t.items()}, {e: k[h] for e, k in c.items()}, size(True, [h]), size(False, [h])), exceptions, 1.0, 0.0, 1.0) for h in (0, 1)]

    def run(texts, toxic, halves):
        automata = [d.automaton() for d in drafts]
        both = [hits(x, automata[1 - h]) for x, h in zip(texts, halves, strict=True)]
        return {"weight": [w for w, _ in both], "words": [k for _, k in both], "toxic": [int(y == 1) for y in toxic]}

    seen = map_rows(rows, run, "weight double, words bigint, toxic int", "text", "toxic", "half").toPandas().sort_values(["words", "weight", "toxic"])
    release(rows)
    fits = [(*_logistic((seen.weight / seen.words**p).to_numpy(), seen.toxic.to_numpy(float)), p) for p in (0.25, 0.5, 1.0)]
    loss, slope, bias, power = min(fits)
    return Model(entries, exceptions, slope, bias, power)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float, float]:
    """(loss, slope, bias) of a one-variable logistic regression, by Newton steps on standardised values."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - y) + np.array([ridge, 1e-6]) * w), -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(w[0] / scale), float(w[1])


def score_table(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null texts score like empty ones; nothing is shuffled.

    Only the text enters a score; equal texts have equal ones. A null id is not held out.
    """

    def run(ids, out, texts):
        p = scores(texts, model)
        return {"doc_id": ids, "held_out": out, "score": p, "predicted": [int(s >= threshold) for s in p]}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, run, "doc_id bigint, held_out boolean, score double, predicted int", "doc_id", "held_out", "text")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with all their columns."""
    name = unused(docs, "toxicity")
    rows = map_append(docs, lambda texts: {name: scores(texts, model)}, f"`{name}` double", "text")
    return rows.filter(F.col(f"`{name}`") < threshold).drop(name)
