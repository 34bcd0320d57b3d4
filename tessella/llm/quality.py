"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each whole text are counted in one pass.  Small regression trees are boosted
on a bounded sample of labelled rows; every path from a root to a node becomes a rule (a
conjunction of threshold conditions), a logistic model with lasso penalty weighs rules and
clipped statistics, and what keeps a weight is compiled into one Spark column expression.

Edge cases: null text is empty and has all statistics 0; null labels and labels of unknown
documents are left out; with no or one-sided labels the score is the share of label 1 (0.5
where there is none); several labels of one document count as the largest; a text of any
length is counted whole; texts with equal statistics score alike, and a statistic at a rule's
threshold is not above it; repeated rows are scored each; an empty table gives no row; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "n_bytes n_words n_lines mean_word upper digits symbols pipes marks stops blanks non_ascii "
    "distinct_words top_word distinct_lines top_line repeat_next end_marks"
).split()
SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)


def statistics_of(text: str) -> list[float]:
    """Values of STATISTICS of one text."""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, w, k = len(data), max(len(words), 1), max(len(lines), 1)
    share = lambda chars: float(counts[list(chars)].sum()) / n
    seen, line_of = Counter(words), Counter(lines)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), len(text) / w,
        share(range(65, 91)), share(range(48, 58)), share(b"#$%&*@^~=+_<>{}[]\\/"), share(b"|"), share(b"!?"), share(b".,;:"),
        share(b" \t\r\n"), float(counts[128:].sum()) / n, len(seen) / w, max(seen.values(), default=0) / w,
        len(line_of) / k, max(line_of.values(), default=0) / k, repeats / w, sum(x[-1] in ".!?" for x in lines) / k,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) of every whole text."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [statistics_of(x.as_py() or "") for x in part.column(1)]
                table = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


# --- trees and rules ---------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def _grow(x, residual, edges, rows, depth, least, path: Rule, found: list, out, rate):
    """One regression tree, greedily; appends the path of every node below the root."""
    if path:
        found.append(path)
    best = None
    if depth and len(rows) >= 2 * least:
        total, n = residual[rows].sum(), len(rows)
        for k in range(x.shape[1]):
            bins = np.searchsorted(edges[k], x[rows, k], side="left")
            count = np.cumsum(np.bincount(bins, minlength=len(edges[k]) + 1))[:-1]
            left = np.cumsum(np.bincount(bins, residual[rows], minlength=len(edges[k]) + 1))[:-1]
            right = n - count
            fits = (count >= least) & (right >= least)
            if fits.any():
                gain = np.where(fits, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(right, 1), -np.inf)
                j = int(gain.argmax())
                if best is None or gain[j] > best[0]:
                    best = gain[j], k, float(edges[k][j])
        if best is not None and best[0] <= total**2 / n + 1e-9:
            best = None
    if best is None:
        out[rows] += rate * residual[rows].mean()
        return
    _, k, cut = best
    below = x[rows, k] <= cut
    _grow(x, residual, edges, rows[below], depth - 1, least, (*path, (k, False, cut)), found, out, rate)
    _grow(x, residual, edges, rows[~below], depth - 1, least, (*path, (k, True, cut)), found, out, rate)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, seed: int = 7) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows."""
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 48))) for k in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: list[Rule] = []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(random.choice(len(y), max(1, len(y) // 2), replace=False))
        step, rules = np.zeros(len(y)), []
        _grow(x, residual, edges, rows, int(random.integers(2, depth + 1)), max(5, len(y) // 500), (), rules, step, rate)
        margin += step * 4
        found += rules
    return list(dict.fromkeys(found))


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, j] *= (x[:, k] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient; the intercept is free."""
    n, d = z.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    start = np.random.default_rng(0).normal(size=d)
    for _ in range(20):
        start = z.T @ (z @ start)
        norm = np.linalg.norm(start)
        start /= norm + 1e-12
    rate = 1 / (norm / (4 * n) + 0.25)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        step = v - rate * (z.T @ error) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = c - rate * error.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return b, w


class RuleEnsemble:
    """intercept + sum of weighted rules and clipped, scaled statistics, as a probability."""

    def __init__(self, intercept, rules, linear):
        self.intercept = intercept  # float
        self.rules = rules  # [(rule, weight)]
        self.linear = linear  # [(statistic, low, high, weight per unit)]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 0.001, **trees) -> RuleEnsemble:
        if len(y) == 0 or y.min() == y.max():
            p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
            return cls(float(np.log(p / (1 - p))), [], [])
        rules = tree_rules(x, y, **trees)
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        spread = np.maximum(np.clip(x, low, high).std(axis=0), 1e-9)
        z = rule_matrix(x, rules)
        scale = np.maximum(z.std(axis=0), 0.05)
        whole = np.hstack([z / scale, (np.clip(x, low, high) - low) / spread * 0.4])
        b, w = lasso_logistic(whole, y, penalty)
        kept = [(rule, float(a)) for rule, a in zip(rules, w[: len(rules)] / scale) if a]
        linear = [(k, float(low[k]), float(high[k]), float(a * 0.4 / spread[k])) for k, a in enumerate(w[len(rules) :]) if a]
        return cls(float(b), kept, linear)

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        if self.rules:
            margin += rule_matrix(x, [r for r, _ in self.rules]) @ np.array([a for _, a in self.rules])
        for k, low, high, a in self.linear:
            margin += a * (np.clip(x[:, k], low, high) - low)
        return 1 / (1 + np.exp(-margin))

    def column(self) -> Column:
        """The score as one expression over columns named as in STATISTICS."""
        terms = [F.lit(self.intercept)]
        for rule, a in self.rules:
            holds = None
            for k, above, cut in rule:
                c = F.col(STATISTICS[k])
                one = c > cut if above else c <= cut
                holds = one if holds is None else holds & one
            terms.append(F.when(holds, F.lit(a)).otherwise(F.lit(0.0)))
        for k, low, high, a in self.linear:
            terms.append(a * (F.least(F.greatest(F.col(STATISTICS[k]), F.lit(low)), F.lit(high)) - low))
        while len(terms) > 1:  # a balanced sum keeps the expression shallow
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, by a hash of doc_id: the
    bound of what the classifiers are fitted on.  Labels are chosen before texts are read."""
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, **options) -> RuleEnsemble:
    """Fit on at most ``most`` labelled rows; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, label, most)
    table = _sample_statistics(sample).toPandas().sort_values(["doc_id", *STATISTICS])
    return RuleEnsemble.fit(table[STATISTICS].to_numpy(np.float64), table["label"].to_numpy(np.float64), **options)


def _sample_statistics(sample: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [statistics_of(x.as_py() or "") for x in batch.column(1)]
            table = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))), batch.column(2)], ["doc_id", *STATISTICS, "label"])

    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(run, SCHEMA + ", label double")


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, score) of every document."""
    return statistics(docs).select("doc_id", model.column().alias("score"))
