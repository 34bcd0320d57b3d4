"""Toxicity: cumulative-link ordinal regression over sparse text features.

A text's features are its distinct lower-cased words and the beginnings of its words (4 to
6 letters, so inflected forms share a feature), each once.  Severity grades run from 0
(clean) to ``grades``.  One weight vector is shared by all thresholds t1 < t2 < ...:
P(grade >= k) = sigmoid(w . x - t_k).  Expected severity is the sum of P(grade >= k) over k.

Labels of more than two values are the grades themselves.  Labels that are only 0 and 1 say
nothing of severity, so grades are deduced: the labelled rows are dealt into folds, a model of
one threshold is fitted without each fold, and a row of label 1 gets its grade by the third that
its margin under the model that has not seen it falls into.  Grade 1 is thus a toxic text that
others hardly give away.  This is a ranking by how plainly a text is toxic, not a human judgement.

The cut for rejection is chosen on rows not fitted on as well: the ordinal model is fitted without
each fold, and the cut has the fewest errors among the probabilities of the rows left out.
Features are screened by their smoothed log-odds on the sample, which does not grow with it, and
selected by the lasso penalty; the fitted weights are few and travel to the tasks with the function.

Edge cases: null text is empty and scores by the thresholds alone; null labels and labels
of unknown documents are left out; several labels of one document count as the largest; with no
label 1 or no label 0 nothing is rejected; a text of any length is read whole; texts with equal
features score alike, and a text at the cut is rejected; repeated rows are scored each; columns
named severity, toxicity or rejected are replaced, all others kept; an empty table gives no row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import thrifty
from tessella.llm.quality import labelled_sample

WORD = re.compile(r"\w+")
#: Fixed value: the least smoothed log-odds of a feature that marks label 1.
MARKING = 2.0
BEGINNINGS = (4, 5, 6)


def words_of(token: str) -> list[str]:
    word = token.lower().strip(".,;:!?()[]\"'|*#$%&")
    return [word] if word.isalnum() else WORD.findall(word)


def features_of(token: str) -> list[str]:
    """Words of a blank-free token, lower-cased, and their beginnings marked by a star."""
    words = words_of(token)
    return words + [f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n]


class Reader:
    """Distinct known features of a text.  Most tokens repeat, so what a token gives is kept
    for up to ``most`` tokens."""

    def __init__(self, known=None, most: int = 300_000):
        self.known = known  # None: all features
        self.stems = None if known is None else {f[:4] for f in known}
        self.most = most
        self.cache: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> set[str]:
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        found: set[str] = set()
        for token in set(text.split()):
            given = cache.get(token)
            if given is None:
                if self.known is None:
                    given = tuple(features_of(token))
                elif any(w[:4] in self.stems for w in words_of(token)):
                    given = tuple(f for f in features_of(token) if f in self.known)
                else:
                    given = ()
                if len(token) < 100:
                    cache[token] = given
            if given:
                found.update(given)
        return found


class Ordinal:
    """weights: feature to weight; thresholds: ascending, one per grade; cut: the probability
    of grade 1 or more from which a text is rejected."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], cut: float = 0.5):
        self.weights = weights
        self.thresholds = thresholds
        self.cut = cut

    def severity(self, features: set[str]) -> tuple[float, float]:
        """(expected severity, probability of grade 1 or more) of a text with these features."""
        margin = sum(sorted(self.weights.get(f, 0.0) for f in features))
        p = [1 / (1 + math.exp(min(max(t - margin, -500.0), 500.0))) for t in self.thresholds]
        return sum(p), p[0]


def grade(margin: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades of texts labelled 0 or 1: label 1 is split evenly by margin."""
    out = np.zeros(len(toxic), np.int64)
    at = np.flatnonzero(toxic)
    if len(at):
        cuts = np.quantile(margin[at], np.linspace(0, 1, grades + 1)[1:-1])
        out[at] = 1 + np.searchsorted(cuts, margin[at], side="left")
    return out


def fit_ordinal(columns: np.ndarray, pointer: np.ndarray, y: np.ndarray, width: int, grades: int, penalty: float, steps: int = 1500):
    """(weights, thresholds) by proximal Adam steps on the cumulative-link likelihood.
    ``columns[pointer[i]:pointer[i + 1]]`` are the features of row i, each with value 1."""
    rows = np.repeat(np.arange(len(y)), np.diff(pointer))
    w = np.zeros(width)
    share = np.array([np.mean(y >= k) for k in range(1, grades + 1)])
    t = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    t = np.maximum.accumulate(t + np.arange(grades) * 1e-3)
    mean, square = np.zeros(width + grades), np.zeros(width + grades)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        margin = np.bincount(rows, w[columns], minlength=len(y))
        up = np.ones((len(y), grades + 2))
        up[:, -1] = 0
        up[:, 1:-1] = sigmoid(margin[:, None] - t)
        slope = up * (1 - up)
        at = np.arange(len(y))
        p = np.maximum(up[at, y] - up[at, y + 1], 1e-9)
        d_margin = -(slope[at, y] - slope[at, y + 1]) / p / len(y)
        d_t = np.array([(np.where(y == k, slope[:, k] / p, 0) - np.where(y == k - 1, slope[:, k] / p, 0)).sum() for k in range(1, grades + 1)]) / len(y)
        d_w = np.bincount(columns, d_margin[rows], minlength=width)
        both = np.concatenate([d_w, d_t])
        mean += 0.1 * (both - mean)
        square += 0.001 * (both * both - square)
        rate = 0.05 * (1 - 0.9 * step / steps)
        scale = rate / (np.sqrt(square / (1 - 0.999**step)) + 1e-7)
        move = scale * mean / (1 - 0.9**step)
        w = w - move[:width]
        # the penalty is scaled as the step is, so it weighs against the mean gradient
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:width] * penalty, 0)
        t = np.maximum.accumulate(t - move[width:])
    return w, t


def log_odds(n: int, n_toxic: int, all_, bad, log=np.log):
    """Smoothed log-odds of label 1 in texts with a feature, over those of the sample."""
    base = n_toxic / n
    return log((bad + base) / (all_ - bad + (1 - base))) - math.log(base / (1 - base))


def screen(seen: dict[str, tuple[int, int]], n: int, n_toxic: int, least: int = 2, most: int = 1024) -> list[str]:
    """The features that mark label 1; of more than ``most`` those whose chi-square with the
    label is largest; seen: (texts with the feature, toxic ones among them)."""
    scores = []
    for f, (all_, bad) in seen.items():
        if least <= all_ < n and 0 < n_toxic < n and log_odds(n, n_toxic, all_, bad) > MARKING:
            gap = bad * n - all_ * n_toxic
            scores.append((-gap * gap / (all_ * (n - all_)), f))
    return [f for _, f in sorted(scores)[:most]]


def _part(columns: np.ndarray, pointer: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, packed as those of all."""
    sizes = np.diff(pointer)[rows]
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(pointer[rows], sizes)
    return columns[at], np.concatenate([[0], np.cumsum(sizes)])


def left_out(columns, pointer, y, fold, width: int, penalty: float, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(margin, probability of grade 1 or more) of each row under the model fitted without its fold."""
    margin, p = np.zeros(len(y)), np.zeros(len(y))
    owner = np.repeat(np.arange(len(y)), np.diff(pointer))
    for f in np.unique(fold):
        seen = np.flatnonzero(fold != f)
        own = y[seen]
        w, t = fit_ordinal(*_part(columns, pointer, seen), own, width, max(int(own.max()), 1), penalty, steps)
        mine = fold == f
        margin[mine] = np.bincount(owner, w[columns], minlength=len(y))[mine]
        p[mine] = 1 / (1 + np.exp(np.clip(t[0] - margin[mine], -500, 500)))
    return margin, p


def train(sets: list[set[str]], labels: np.ndarray, chosen: list[str], grades: int = 3, penalty: float = 0.0002, folds: int = 4) -> Ordinal:
    """Fit on feature sets of labelled texts, restricted to ``chosen``."""
    toxic = (labels > 0).astype(np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Ordinal({}, [40.0 + k for k in range(grades)])
    vocabulary = {f: k for k, f in enumerate(chosen)}
    ids = [sorted(vocabulary[f] for f in features if f in vocabulary) for features in sets]
    pointer = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    columns = np.concatenate([np.array(i, np.int64) for i in ids]) if pointer[-1] else np.zeros(0, np.int64)
    fold = np.zeros(len(toxic), np.int64)
    for label in (0, 1):  # both labels are dealt evenly
        fold[toxic == label] = np.arange(int((toxic == label).sum())) % folds
    apart = min(toxic.sum(), (1 - toxic).sum()) >= folds  # else no row can be left out
    y = labels.astype(np.int64)
    if y.max() > 1:
        grades = int(y.max())
    else:
        margin = left_out(columns, pointer, toxic, fold, len(chosen), penalty)[0] if apart else np.zeros(len(toxic))
        y = grade(margin, toxic, grades)
    w, t = fit_ordinal(columns, pointer, y, len(chosen), grades, penalty)
    model = Ordinal({f: float(w[k]) for f, k in vocabulary.items() if w[k]}, [float(x) for x in t])
    if apart:
        model.cut = best_cut(left_out(columns, pointer, y, fold, len(chosen), penalty)[1], toxic)
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the fewest errors on the sample: the middle of the widest such gap."""
    order = np.argsort(p, kind="stable")
    low, high = np.concatenate([[0.0], p[order]]), np.concatenate([p[order], [1.0]])
    below = np.concatenate([[0], np.cumsum(toxic[order])])
    errors = below + (len(p) - np.arange(len(p) + 1)) - (toxic.sum() - below)
    best = np.flatnonzero((errors == errors[high > low].min()) & (high > low))
    at = best[np.argmax((high - low)[best])]
    return float((low[at] + high[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000, features: int = 1024, **options) -> Ordinal:
    """Fit on at most ``most`` labelled rows and ``features`` screened features: feature counts
    are added up in the tasks, and only the chosen features of the sample reach the driver."""
    def count(batches):
        read, seen = Reader(most=50_000), {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([n for n, _ in seen.values()]), pa.array([b for _, b in seen.values()])], ["f", "n", "bad"])
            seen.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist()):
                for f in ("", *read(text.as_py() or "")):
                    n, bad = seen.get(f, (0, 0))
                    seen[f] = n + 1, bad + (y > 0)
                if len(seen) > 200_000:
                    yield rows()
        if seen:
            yield rows()

    sample = labelled_sample(docs, labels, label, most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    counts = sample.mapInArrow(thrifty(count), "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = counts.filter("f = ''").first()
    if whole is None:
        return train([], np.zeros(0), [])
    n, bad = whole["n"], whole["bad"]
    if not 0 < bad < n:
        return train([], np.zeros(0), [])
    gap = F.col("bad") * float(n) - F.col("n") * float(bad)
    marking = log_odds(n, bad, F.col("n"), F.col("bad"), F.log) > MARKING
    top = counts.filter((F.col("f") != "") & (F.col("n") >= 2) & (F.col("n") < n) & marking).orderBy((gap * gap / (F.col("n") * (n - F.col("n")))).desc(), "f")
    chosen = screen({r["f"]: (r["n"], r["bad"]) for r in top.limit(features).collect()}, n, bad, most=features)
    known = frozenset(chosen)

    def read_sets(batches):
        read = Reader(known)
        for batch in batches:
            sets = [sorted(read(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string())), batch.column(2)], ["doc_id", "features", "label"])

    table = sample.mapInArrow(thrifty(read_sets), "doc_id long, features array<string>, label double").toPandas().sort_values("doc_id")
    return train([set(x) for x in table["features"]], table["label"].to_numpy(), chosen, **options)


def score(docs: DataFrame, model: Ordinal, threshold: float | None = None) -> DataFrame:
    """All columns of ``docs`` with severity (expected grade), toxicity (probability of grade 1
    or more) and rejected (toxicity >= threshold, the model's own cut unless given); columns
    of these names are replaced."""
    threshold = model.cut if threshold is None else threshold
    added = ("severity", "toxicity", "rejected")
    kept = [f for f in docs.schema.fields if f.name not in added]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    at = [f.name for f in kept].index("text")
    schema = T.StructType([*kept, T.StructField("severity", T.DoubleType()), T.StructField("toxicity", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        read = Reader(frozenset(model.weights))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):  # whole rows go back: in small batches they take little room at once
                part = batch.slice(lo, 1000)
                found = [model.severity(read(x.as_py() or "")) for x in part.column(at)]
                more = [pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], pa.float64()), pa.array([p >= threshold for _, p in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *added])

    return rows.mapInArrow(thrifty(run), schema)
