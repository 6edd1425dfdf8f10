"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Tokens are the lower-cased words of a text; a long word is also known by its first 4, 5 and 6 bytes, so inflected
forms share evidence. Each token's log-odds between toxic and other labelled texts has a Dirichlet prior
(``PRIOR`` pseudo-counts and a share of the token's overall rate) and a variance; the most certain of a word's four
forms speaks for it, and only if it lies far enough from zero: of the deviations in ``CERTAIN`` the one that tells
the kept-out rows apart best. Every other word costs ``GAP``, also one that only repeats the word before it.

A text's maximal-scoring segments are found in one pass (linear time): each is a passage none of whose parts
would score more by being joined with or cut from its neighbours. A passage of score S in n words is expected
K n exp(-lambda S) times in harmless text, with lambda from the harmless scores and K from harmless maxima; passages
add up to one figure per text, and a logistic curve fitted on rows kept out of the counts turns it into a chance.

Learning takes about ``sample_rows`` labelled rows at most, chosen by a hash of the id, equal texts once. Spark sums
the texts that hold each form; forms of fewer than ``MIN_TEXTS`` texts can never be certain and stay out of the model,
which so is bounded by the sample. Forms are known by ``BITS`` bits of a hash. Whole texts are scored where they lie.

Null and empty texts have no passage and get the curve's lowest value. Labels other than 0 and 1 are not learned
from; without any labelled row no passage is found. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.llm.arrays import WORD, Hasher, lowered, mix, pieces, runs
from almenara.llm.language import Table
from almenara.llm.sampling import labelled_sample
from almenara.session import pin

BITS = 40
MIN_TEXTS = 4
SAMPLE_ROWS = 40_000
PRIOR = 0.5
PRIOR_WEIGHT = 1.0
CERTAIN = (2.0, 2.4, 2.8, 3.2, 3.6)
GAP = -0.5
TOP = 8.0
PREFIXES = (4, 5, 6)
NONE = np.uint64(2**64 - 1)


@dataclass
class Model:
    """Score of each known form with certainty, the two extreme-value constants and the logistic curve."""

    forms: Table
    odds: np.ndarray
    certainty: np.ndarray
    certain: float = CERTAIN[-1]
    rate: float = 1.0
    constant: float = 0.1
    slope: float = 1.0
    level: float = 0.0


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of a piece: starts, ends, text number, and the hash of each form (``NONE``: the word is too short)."""
    low, _ = lowered(data)
    starts, ends, doc = runs(WORD[low], at)
    shift = np.uint64(64 - BITS)
    hasher = Hasher(low, seed=3)
    cells = [hasher(starts, ends) >> shift]
    for k in PREFIXES:
        long = ends - starts > k
        stop = np.minimum(starts + k, ends)
        cells.append(np.where(long, mix(hasher(starts, stop) + np.uint64(k)) >> shift, NONE))
    return starts, ends, doc, cells


def word_scores(model: Model, cells: list[np.ndarray], certain: float) -> np.ndarray:
    """Score of each word: the log-odds of its most certain form, or the price of a gap."""
    best, score = np.zeros(len(cells[0]), np.float32), np.full(len(cells[0]), GAP)
    for cell in cells:
        place = model.forms.find(cell)
        known = np.flatnonzero(place >= 0)
        sure = np.abs(model.certainty[place[known]])
        better = sure > best[known]
        known, place, sure = known[better], place[known[better]], sure[better]
        best[known] = sure
        score[known] = np.where(sure >= certain, np.clip(model.odds[place], -TOP, TOP), GAP)
    return np.where(score > 0, score, np.minimum(score, GAP))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), in order, in linear time."""
    places = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest lower start
    for p in places.tolist():
        first, end, before, after = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, end, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, b - a) for f, e, a, b, _ in stack]


def passages(model: Model, texts: pa.Array, certain: float | None = None) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]]]:
    """The number of words of each text, and by row the passages (first byte, last byte + 1, score) where there are any."""
    found: dict[int, list[tuple[int, int, float]]] = {}
    words = np.zeros(len(texts), np.int64)
    for lo, hi, data, at in pieces(texts):
        starts, ends, doc, cells = tokens(data, at)
        score = word_scores(model, cells, model.certain if certain is None else certain)
        again = np.flatnonzero((cells[0][1:] == cells[0][:-1]) & (doc[1:] == doc[:-1])) + 1
        score[again] = np.minimum(score[again], GAP)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        words[lo:hi] = np.diff(cut)
        for k in np.unique(doc[score > 0]).tolist():
            a, b = cut[k], cut[k + 1]
            found[lo + k] = [(int(starts[a + f] - at[k]), int(ends[a + e - 1] - at[k]), s) for f, e, s in segments(score[a:b])]
    return words, found


def evidence(model: Model, words: int, found: list[tuple[int, int, float]]) -> float:
    """Log of how far a text's passages exceed what harmless text of its length would show."""
    s = model.rate * np.array([x[2] for x in found])
    top = s.max()
    return float(top + np.log(np.exp(s - top).sum()) - np.log(max(model.constant * words, 1e-9)))


def count_cells(texts: pa.Array, toxic: np.ndarray) -> pd.DataFrame:
    """Texts of either kind that hold each form: one partial table per call."""
    out = []
    for lo, hi, data, at in pieces(texts, 4 << 20):
        _, _, doc, cells = tokens(data, at)
        flat = np.concatenate([doc[c != NONE] << BITS | c[c != NONE].astype(np.int64) for c in cells]) if len(doc) else np.zeros(0, np.int64)
        own = np.unique(flat)
        kind = toxic[lo:hi].astype(np.int64)[own >> BITS]
        out.append(own & ((1 << BITS) - 1) | kind << BITS)
    seen, n = np.unique(np.concatenate(out) if out else np.zeros(0, np.int64), return_counts=True)
    return pd.DataFrame({"kind": seen >> BITS, "cell": seen & ((1 << BITS) - 1), "n": n})


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn counts from four fifths of the sample and the calibration from the rest."""
    rows, _ = labelled_sample(documents, labels, sample_rows, key, text, label)
    rows = rows.withColumn("part", F.pmod(F.shiftright("h", 22), F.lit(5)))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield count_cells(pa.array(b["text"], pa.large_string()), b["label"].to_numpy())

    sums = rows.filter("part > 0").mapInPandas(count, "kind long, cell long, n long").groupBy("cell").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    # The forms of a bounded sample that several texts share, and the totals of all forms.
    sums = pin(sums)
    totals = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("toxic", "clean")], F.count(F.lit(1))).first()
    known = sums.filter(F.col("toxic") + F.col("clean") >= MIN_TEXTS).toArrow()
    model, usable = log_odds(*(c.to_numpy() for c in known.columns), tuple(map(float, totals)))
    if not usable:
        return model
    return calibrate(model, rows.filter("part = 0"))


def log_odds(forms: np.ndarray, toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float, float]) -> tuple[Model, bool]:
    """Log-odds of each form and its deviations from zero; False if either kind of text is missing.

    ``totals`` are the sums of both counts over all forms, also those left out, and the number of all forms.
    """
    order = np.argsort(forms)
    forms, toxic, clean = forms[order].astype(np.uint64), toxic[order].astype(float), clean[order].astype(float)
    prior = PRIOR + PRIOR_WEIGHT * (toxic + clean) / max(totals[0] + totals[1], 1)
    whole = PRIOR * totals[2] + PRIOR_WEIGHT
    a, b = toxic + prior, clean + prior
    odds = np.log(a / np.maximum(totals[0] + whole - a, 1)) - np.log(b / np.maximum(totals[1] + whole - b, 1))
    usable = min(totals[0], totals[1]) > 0
    certainty = odds / np.sqrt(1 / a + 1 / b) * usable
    return Model(Table(forms), odds.astype(np.float32), certainty.astype(np.float32)), usable


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Set the certainty asked for, lambda, K and the curve from rows that were not counted."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = pa.array(b["text"], pa.large_string())
            for certain in CERTAIN:
                words, found = passages(shared.value, text, certain)
                top = [max((x[2] for x in found[k]), default=0.0) if k in found else 0.0 for k in range(len(b))]
                yield pd.DataFrame({"certain": certain, "label": b["label"].to_numpy(), "words": words, "top": top})

    # The sample is bounded, so are its figures.
    seen = rows.mapInPandas(best, "certain double, label int, words long, top double").toPandas()
    tried = []
    for certain in CERTAIN:
        own = seen[seen["certain"] == certain]
        if len(own):
            tried.append(fitted(model, certain, own["label"].to_numpy(float), own["words"].to_numpy(float), own["top"].to_numpy()))
    return min(tried, key=lambda t: (t[0], -t[1].certain))[1] if tried else model


def fitted(model: Model, certain: float, label: np.ndarray, words: np.ndarray, top: np.ndarray) -> tuple[float, Model]:
    """The model with its constants for one certainty, and its loss (each kind of row weighs the same)."""
    clean = label == 0
    hits = clean & (top > 0)
    length = max(words[clean].sum(), 1.0)
    # lambda solves  sum of p(s) exp(lambda s) = 1  over harmless words: gaps almost always, hits at their own rate.
    hit_rate = min(max(float(hits.sum()), 0.5) / length, 0.05)
    hit = float(top[hits].mean()) if hits.any() else float(top[~clean & (top > 0)].mean()) if (~clean & (top > 0)).any() else 5.0
    lo, hi = 1e-3, 50.0 / max(hit, 1.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if hit_rate * np.exp(mid * hit) + (1 - hit_rate) * np.exp(mid * GAP) < 1 else (lo, mid)
    rate = (lo + hi) / 2
    # Maxima follow 1 - exp(-K n exp(-lambda S)): K from the share of harmless texts with any passage.
    out = replace(model, certain=certain, rate=rate, constant=float(hit_rate * np.exp(rate * hit)))
    x = np.array([evidence(out, max(w, 1), [(0, 0, s)]) for w, s in zip(words, top)])
    slope, level = logistic(x, label)
    p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + level, -35, 35))), 1e-6, 1 - 1e-6)
    loss = sum(-np.log(np.where(side, np.where(label == 1, p, 1 - p), 1)).sum() / max(side.sum(), 1) for side in (clean, ~clean))
    return loss, replace(out, slope=slope, level=level)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and level of a curve through two kinds of rows, each kind of equal weight, held down a little."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(weight * (p - y) * x).sum() + ridge * a, (weight * (p - y)).sum() + ridge * b * 0.01])
        h = weight * p * (1 - p)
        m = np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + ridge * 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -5, 5)
    return max(float(a), 1e-3), float(b)


def chances(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """The chance that each text is toxic, and its passages as byte ranges."""
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    words, all_found = passages(model, texts)
    x = -np.log(np.maximum(model.constant * np.maximum(words, 1), 1e-9))
    for row, found in all_found.items():
        n = int(words[row])
        x[row] = evidence(model, n, found)
        spans[row] = [{"first_byte": f, "end_byte": e, "score": s, "expected": float(model.constant * n * np.exp(-model.rate * s))} for f, e, s in found]
    return 1.0 / (1.0 + np.exp(-np.clip(model.slope * x + model.level, -35, 35))), spans


SPANS = "array<struct<first_byte:long,end_byte:long,score:double,expected:double>>"
_SPANS = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", spans: str = "passages") -> DataFrame:
    """``docs`` with the chance of being toxic and the passages found (byte ranges of the UTF-8 text)."""
    docs = docs.drop(name, spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance, found = chances(shared.value, batch.column(kept.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance), pa.array(found, _SPANS)], names=[*kept, name, spans])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double, `{spans}` {SPANS}")
