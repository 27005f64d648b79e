"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

One Arrow pass turns each whole text into a short vector of statistics (logs of
counts, logits of shares). A class is a Gaussian whose covariance is shrunk towards the
pooled one and a multiple of the identity. Fitting needs only sums of outer products,
which are aggregated over all labelled rows; a score is the difference of the two log
densities, from Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import stored, text_batches, text_hash, without

FEATURES = (
    "log_words", "log_word_length", "log_word_spread", "upper", "symbols", "digits", "stops", "commas", "distinct", "repeats",
    "top_word", "symbol_words", "lone_symbols", "capital_words", "line_repeats", "log_line_words", "long_words", "non_ascii",
)

_KIND = np.zeros(256, np.int64)  # of a byte: 0 white space, 1 lower, 2 upper, 3 digit, 4 full stop, 5 comma, 6 symbol, 7 not ASCII, 8 line feed
_KIND[33:127] = 6
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[46, 63, 33]], _KIND[44], _KIND[128:], _KIND[10] = 4, 5, 7, 8


def _logit(share: float, n: int) -> float:
    """Logit of a share of n things, half a thing away from 0 and 1."""
    return math.log((share * n + 0.5) / (n - share * n + 0.5))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; an empty text has defined values, too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9).tolist() if raw else [0] * 9
    words = (text or "").split()
    n = len(words)
    visible = max(1, len(raw) - counts[0] - counts[8])
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    ids: dict[str, int] = {}
    numbered = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeats = int(np.count_nonzero(numbered[1:] == numbered[:-1])) if n > 1 else 0
    top = int(np.bincount(numbered).max()) if n else 0
    distinct = list(ids)
    plain = [w.isalnum() for w in distinct]  # once per distinct word
    often = np.bincount(numbered) if n else np.zeros(0, np.int64)
    kinds = np.zeros((3, len(distinct)))
    for k, w in enumerate(distinct):
        if not plain[k]:
            kinds[0, k] = not w.rstrip(".,;:!?").isalnum() or len(w) - len(w.rstrip(".,;:!?")) > 1
            kinds[1, k] = not any(map(str.isalnum, w))
        kinds[2, k] = w[:1].isupper()
    symbol_words, lone, capital = (kinds @ often).tolist() if n else (0, 0, 0)
    lines = [x for x in (text or "").split("\n") if x]
    line_repeats = len(lines) - len(set(lines))
    return [
        math.log1p(n),
        math.log(max(1.0, float(lengths.mean()))),
        math.log1p(float(lengths.std())),
        _logit(counts[2] / visible, visible),
        _logit(counts[6] / visible, visible),
        _logit(counts[3] / visible, visible),
        _logit(counts[4] / visible, visible),
        _logit(counts[5] / visible, visible),
        math.log((len(distinct) + 1) / (n + 1)) / math.log(n + 2),
        _logit(repeats / max(1, n), max(1, n)),
        _logit(top / max(1, n), max(1, n)),
        _logit(symbol_words / max(1, n), max(1, n)),
        _logit(lone / max(1, n), max(1, n)),
        _logit(capital / max(1, n), max(1, n)),
        _logit(line_repeats / max(1, len(lines)), max(1, len(lines))),
        math.log1p(n / max(1, len(lines))),
        _logit(float(np.count_nonzero(lengths > 12)) / max(1, n), max(1, n)),
        _logit(counts[7] / visible, visible),
    ]


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, features array<double>) for every row; whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "text_hash", "features"])

    rows = documents.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, features array<double>")


@dataclass(frozen=True)
class Gaussian:
    """A class: log prior, mean, and the inverse of the covariance's Cholesky factor with its log determinant."""

    log_prior: float
    mean: tuple[float, ...]
    whiten: tuple[tuple[float, ...], ...]
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of each row, without the constant that all classes share."""
        z = (x - np.array(self.mean)) @ np.array(self.whiten).T
        return self.log_prior - 0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det


@dataclass(frozen=True)
class QualityModel:
    """Scaling of the features, the two classes, and the temperature that tames the log-density difference."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    good: Gaussian
    bad: Gaussian
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.centre)) / np.array(self.scale)
        difference = (self.good.log_density(x) - self.bad.log_density(x)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(difference, -500, 500)))


#: Shrinkage towards the pooled covariance and towards the identity, and temperatures, that ``fit`` chooses from.
SHRINK_POOLED, SHRINK_IDENTITY, TEMPERATURES = (0.1, 0.3, 0.5, 0.7, 0.9), (0.001, 0.005, 0.02, 0.1), (1.0, 2.0, 4.0, 8.0, 16.0)
FOLDS = 4
#: About so many rows of each fold and class the choice is judged on; the sums are of all rows.
JUDGED_ROWS = 1_000


@dataclass(frozen=True)
class Sums:
    """Number, sums and sums of products of one class's rows."""

    n: int
    s: np.ndarray
    p: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.p + other.p)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.s - other.s, self.p - other.p)


def model_of(sums: dict[int, Sums], shrink_pooled: float, shrink_identity: float, temperature: float) -> QualityModel:
    """The discriminant of two classes, from their sums alone."""
    d = len(FEATURES)
    total = sum(x.n for x in sums.values())
    means = {c: x.s / x.n for c, x in sums.items()}
    scatter = {c: x.p - x.n * np.outer(means[c], means[c]) for c, x in sums.items()}
    centre = sum(x.s for x in sums.values()) / total
    within = sum(scatter.values()) / total
    scale = np.sqrt(np.maximum(np.diag(within), 1e-8))
    pooled = within / np.outer(scale, scale)

    def gaussian(c: int) -> Gaussian:
        own = scatter[c] / sums[c].n / np.outer(scale, scale)
        cov = (1 - shrink_pooled) * own + shrink_pooled * pooled
        cov = (1 - shrink_identity) * cov + shrink_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        whiten = np.linalg.inv(lower)
        log_det = 2 * float(np.log(np.diag(lower)).sum())
        return Gaussian(math.log(sums[c].n / total), tuple(((means[c] - centre) / scale).tolist()), tuple(map(tuple, whiten.tolist())), log_det)

    return QualityModel(tuple(centre.tolist()), tuple(scale.tolist()), gaussian(1), gaussian(0), temperature)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def fit(features: DataFrame, labels: DataFrame, shrink_pooled: float | None = None, shrink_identity: float | None = None, temperature: float | None = None) -> QualityModel | None:
    """Fit on (doc_id, features) joined with (doc_id, quality 0/1); None if a class has no row.

    All labelled rows count: per class and fold their number, sums and sums of products are
    aggregated, about 200 numbers each whatever the input's size. What is not given of the shrinkages and the temperature is chosen by
    cross-validation over ``FOLDS`` folds of these labelled rows, and of no others: the choice of the least log loss on
    about ``JUDGED_ROWS`` rows of each fold and class, twice as many at most. Labels that are null or neither 0 nor 1 are
    left out; of repeated labels each counts.
    """
    d = len(FEATURES)
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    rows = features.join(marked, "doc_id").withColumn("fold", _fold(F.col("doc_id")))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.get("features", F.lit(i))
    grouped = rows.groupBy("quality", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x(i)) for i in range(d))).alias("s"), F.array(*(F.sum(x(i) * x(j)) for i, j in pairs)).alias("p")
    )
    by_fold: dict[tuple[int, int], Sums] = {}
    for r in grouped.collect():  # two classes times the folds
        full = np.zeros((d, d))
        for (i, j), value in zip(pairs, r["p"]):
            full[i, j] = full[j, i] = value
        by_fold[r["quality"], r["fold"]] = Sums(r["n"], np.array(r["s"]), full)
    sums: dict[int, Sums] = {}
    for (c, _), part in sorted(by_fold.items(), key=lambda item: item[0]):
        sums[c] = sums[c] + part if c in sums else part
    if len(sums) < 2:
        return None
    options = [known if value is None else (value,) for value, known in ((shrink_pooled, SHRINK_POOLED), (shrink_identity, SHRINK_IDENTITY), (temperature, TEMPERATURES))]
    grid = list(product(*options))
    return model_of(sums, *(grid[0] if len(grid) == 1 else _chosen(rows, sums, by_fold, grid)))


def _chosen(rows: DataFrame, sums: dict[int, Sums], by_fold: dict[tuple[int, int], Sums], grid: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """The choice of the least log loss, both classes counting alike, on rows of folds that their model has not seen."""
    share = F.create_map(*(x for c, held in sums.items() for x in (F.lit(c), F.lit(min(1.0, FOLDS * JUDGED_ROWS / held.n)))))
    dealt = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(dealt < F.element_at(share, F.col("quality"))).select("quality", "fold", "features")
    drawn = some.limit(4 * FOLDS * JUDGED_ROWS).toArrow()  # about half as many rows; the limit bounds chance
    judged = np.array(drawn["features"].combine_chunks().flatten()).reshape(drawn.num_rows, -1)
    order = np.lexsort(judged.T)  # whatever order the rows come in, the sums below are the same
    judged, quality, fold = judged[order], drawn["quality"].to_numpy()[order], drawn["fold"].to_numpy()[order]
    loss = dict.fromkeys(grid, 0.0)
    for f in range(FOLDS):
        rest = {c: x - by_fold[c, f] if (c, f) in by_fold else x for c, x in sums.items()}
        mine = {c: judged[(fold == f) & (quality == c)] for c in sums}
        if min(x.n for x in rest.values()) < 2:
            continue
        for choice in grid:
            model = model_of(rest, *choice)
            for c, held in mine.items():
                if len(held):
                    share = np.clip(model.scores(held), 1e-12, 1 - 1e-12)
                    loss[choice] -= float(np.log(share if c else 1 - share).mean())
    return min(grid, key=lambda choice: (loss[choice], [-x for x in choice]))


def score(features: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, text_hash, score): the probability that a document is good; 0.5 for all without a model."""
    if model is None:
        return features.select("doc_id", "text_hash", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(rows), pa.float64())], ["doc_id", "text_hash", "score"])

    return features.select("doc_id", "text_hash", "features").mapInArrow(run, f"doc_id {dict(features.dtypes)['doc_id']}, text_hash long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that never lend their label: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash and score of every row, by a model of the labels that are not held out."""
    features = stored(document_statistics(documents), "quality-statistics")
    return score(features, fit(features, labels.filter(~held_out(F.col("doc_id")))))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Edge cases: a null or empty text has the statistics of no words and a score like
    any other; null ids pass through (not held out, without label); repeated rows are scored one by one; other
    columns, lang and source among them, are never read. Without labels of both classes every score is 0.5. An
    empty table gives no row.
    """
    return _scored(documents, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score reaches the threshold.

    Each row is judged by its own text: rows that repeat a doc_id, or have none, stay or go one by one. Null and empty texts are
    judged like any other; long texts are read whole; an empty table gives none; columns of any names pass through.
    """
    rejected = stored(_scored(documents, labels).filter(F.col("score") < threshold).select("doc_id", "text_hash").distinct(), "rejected")
    return without(documents, rejected)
