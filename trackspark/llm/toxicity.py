"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import materialise, only_ids, small_batches, tidy, told, without_ids

#: Labelled documents that the classifiers are fitted on, at most.
TRAIN_ROWS = 8_000
#: A feature counts if it is on one side of a category by so many standard
#: deviations more than chance has it.
LEAST_Z = 3.5
#: Bytes of a word's beginning that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
FOLDS = 3
#: Features that a task counts before it passes them on.
HELD_FEATURES = 150_000
STEPS = 150
#: Training documents of which the fit works out sums at a time.
BLOCK_ROWS = 1_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SIGN = np.array([33 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def features(text: str) -> np.ndarray:
    """The distinct words of a text, their beginnings, and the runs of signs, as sorted hashes.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case.
    """
    found, data, step = [], text.encode("utf-8", "replace"), 1 << 18
    start = 0
    while start < len(data):  # long texts in parts that end between words
        end = min(len(data), start + step)
        while end < len(data) and (_INSIDE[data[end]] or _SIGN[data[end]]):
            end += 1
        found.append(_features(np.frombuffer(data, np.uint8, end - start, start)))
        start = end
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _features(data: np.ndarray) -> np.ndarray:
    folded = _FOLD[data]
    inside = np.concatenate([[False], _INSIDE[folded], [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[folded] * up[:-1], dtype=np.uint64)])
    found = []
    sign = np.concatenate([[False], _SIGN[folded], [False]])
    runs = np.flatnonzero(sign[1:] & ~sign[:-1]), np.flatnonzero(sign[:-1] & ~sign[1:])
    kinds = [(starts, ends), *[(starts, np.minimum(ends, starts + k)) for k in BEGINNINGS], runs]
    for kind, (starts, cut) in enumerate(kinds):
        # The same factor for both ends of a span, whatever its place in the text.
        spans = (sums[cut] - sums[starts]) * up[len(data) - starts]
        key = spans if len(data) == 0 else spans * _inverse(len(data))
        key = (key ^ (key >> np.uint64(29))) * _MUL + np.uint64(kind + 1)
        found.append(np.unique(key))
    return np.concatenate(found)


def _inverse(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), -n, 1 << 64))


@dataclass
class Linear:
    """A logistic model of one category; ``known`` is shared by the whole chain."""

    weights: np.ndarray
    earlier: np.ndarray  # weights of the earlier categories' log odds
    bias: float

    def log_odds(self, at: np.ndarray, earlier: Sequence[float]) -> float:
        return float(self.weights[at].sum() + self.bias + np.dot(self.earlier, earlier))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Training documents as index lists into the known features.

    Sums go over blocks of documents, so that what they hold beside the lists is small.
    """

    def __init__(self, lists: list[np.ndarray], width: int):
        self.index = np.concatenate(lists, dtype=np.int32) if lists else np.zeros(0, np.int32)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.width = width

    def take(self, rows: np.ndarray) -> Rows:
        return Rows([self.index[self.starts[i] : self.starts[i + 1]] for i in rows], self.width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of some documents at a time: which, where each one's list starts and ends, and the lists."""
        for first in range(0, len(self), BLOCK_ROWS):
            own = slice(first, min(first + BLOCK_ROWS, len(self)))
            starts = self.starts[own.start : own.stop + 1]
            yield own, starts - starts[0], self.index[starts[0] : starts[-1]]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for own, starts, index in self._blocks():
            sums = np.concatenate([[0.0], np.cumsum(weights[index])])
            out[own] = sums[starts[1:]] - sums[starts[:-1]]
        return out

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for own, starts, index in self._blocks():
            out += np.bincount(index, np.repeat(values[own], np.diff(starts)), self.width)
        return out


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> Linear:
    """A logistic regression by full-batch Adam steps, the same on every run."""
    n, k = earlier.shape
    rate = y.mean() if n else 0.0
    start = float(_odds(np.array(rate)))
    theta = np.zeros(rows.width + k + 1)
    theta[-1] = start
    if n == 0 or rate in (0.0, 1.0):
        return Linear(theta[: rows.width], theta[rows.width : -1], start)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        z = rows.dot(theta[: rows.width]) + earlier @ theta[rows.width : -1] + theta[-1]
        wrong = (_sigmoid(z) - y) / n
        grad = np.concatenate([rows.spread(wrong), earlier.T @ wrong, [wrong.sum()]])
        grad[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Linear(theta[: rows.width], theta[rows.width : -1], float(theta[-1]))


@dataclass
class Chain:
    """Models of the categories in order, each fed the earlier ones' log odds."""

    categories: list[str]
    known: np.ndarray
    models: list[Linear]

    def predict(self, text: str | None) -> list[float]:
        at = _places(self.known, features(text or ""))
        odds: list[float] = []
        for model in self.models:
            odds.append(float(np.clip(model.log_odds(at, odds), -9.2, 9.2)))
        return [float(_sigmoid(z)) for z in odds]


def telling(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature: those of ``texts`` (text, a 0/1 label or null per name) that tell a category's sides apart.

    Tasks count documents and labels by feature before a shuffle by feature
    merges them. A feature of one document never passes, so what passes is a
    small part of the features.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.uint64), np.zeros((0, 2 * len(names)))

        def merged(lists: list[np.ndarray], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([held, *lists]), return_inverse=True)
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            out = np.column_stack([np.bincount(at[len(held) :], m[owner], len(every)) for m in marks])
            out[at[: len(held)]] += sums
            return every, out

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array(held.view(np.int64)), *[pa.array(c) for c in sums.T]]
            return pa.RecordBatch.from_arrays(columns, names=["feature", *counted])

        for batch in batches:
            labels = [np.array(c.to_pylist(), float) for c in batch.columns[1:]]
            marks = np.array([m for y in labels for m in (~np.isnan(y), np.nan_to_num(y))], float)
            for start in range(0, batch.num_rows, 64):
                lists = [features(t.as_py() or "") for t in batch.column(0)[start : start + 64]]
                held, sums = merged(lists, marks[:, start : start + 64])
                if len(held) > HELD_FEATURES:
                    yield passed_on()
                    held, sums = held[:0], sums[:0]
        if len(held):
            yield passed_on()

    whole = texts.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.count, F.sum)]).first()  # one row
    counted = [f"{n}_{part}" for n in names for part in ("docs", "ones")]
    each = (
        texts.select("text", *names)
        .mapInArrow(tidy(count), "feature long, " + ", ".join(f"{c} double" for c in counted))
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in counted])
    )
    tells = F.lit(False)
    for n in names:
        docs, ones = whole[f"{n}_count"], whole[f"{n}_sum"]
        if docs and 0 < ones < docs:
            rate = ones / docs
            seen = F.col(f"{n}_docs")
            spread = F.sqrt(seen * rate * (1 - rate) + 1)
            tells |= F.abs(F.col(f"{n}_ones") - seen * rate) / spread >= LEAST_Z
    return each.filter(tells).select("feature")


def _places(known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where in ``known`` the features are that are there."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return at[known[at] == own]


def fit_chain(
    known: np.ndarray, rows: Rows, targets: Mapping[str, np.ndarray], folds: np.ndarray
) -> Chain:
    """The chain of the categories of ``targets`` (0, 1 or NaN for no label).

    ``rows`` has each training document's places in ``known``. A model's
    training rows get the earlier categories' probabilities from models that
    have not seen the row: those fitted on the other folds.
    """
    earlier = np.zeros((len(rows), 0))
    models = []
    for k, y in enumerate(targets.values()):
        has = np.flatnonzero(~np.isnan(y))
        models.append(fit(rows if len(has) == len(rows) else rows.take(has), earlier[has], y[has]))
        if k + 1 < len(targets):
            unseen = np.zeros(len(rows))
            for f in range(FOLDS):
                own, other = np.flatnonzero(folds == f), has[folds[has] != f]
                model = fit(rows.take(other), earlier[other], y[other])
                part = rows.take(own)
                unseen[own] = _sigmoid(part.dot(model.weights) + earlier[own] @ model.earlier + model.bias)
            earlier = np.column_stack([earlier, _odds(unseen)])
    return Chain(list(targets), known, models)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Column],
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain:
    """Fit a chain on a bounded sample of the labelled documents.

    ``categories`` gives, in the chain's order, each category's 0/1 column of
    ``labels``. The sample is the ``train_rows`` labelled ids that come first by
    a hash, so it is the same on every run. Its features stay on the executors,
    where those that tell something are chosen; the driver gets these and, for
    each document, the numbers of those that it has. Of several texts of one id
    one is used, the same on every run.
    """
    names = list(categories)
    small_batches(docs.sparkSession)
    marked = (
        labels.select(F.col(id_col).alias("id"), *[c.cast("double").alias(n) for n, c in categories.items()])
        .filter("id is not null")
        .groupBy("id")
        .agg(*[F.max(n).alias(n) for n in names])
    )
    sample = materialise(marked.orderBy(F.xxhash64("id"), "id").limit(train_rows), "labelled")
    texts = only_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sample.select("id"), "id")
    kind = texts.schema["id"].dataType.simpleString()

    found = materialise(texts.join(F.broadcast(sample), "id"), "labelled_texts")
    listed = telling(found, names).toArrow()
    known = np.sort(listed.column("feature").to_numpy().view(np.uint64))
    shared = told(docs.sparkSession, known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_places(shared.value, features(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["id", "places"])

    placed = found.select("id", "text").mapInArrow(tidy(place), f"id {kind}, places array<int>")
    fitted = (
        placed.groupBy("id")
        .agg(F.min("places").alias("places"))
        .join(F.broadcast(sample), "id")
        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
        .orderBy("id")
        .limit(train_rows)
        .toArrow()
    )
    lists = [x.values.to_numpy() for x in fitted.column("places")]
    targets = {n: np.array(fitted.column(n).to_pylist(), float) for n in names}
    folds = fitted.column("fold").to_numpy()
    rows = Rows(lists, len(known))
    del fitted, lists  # the rows have their own copy
    return fit_chain(known, rows, targets, folds)


def default_categories() -> dict[str, Column]:
    """Low quality first, then toxic: the categories that the labels have."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def score(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Column] | None = None,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, p_<category> of each category, rejected.

    ``rejected`` says that the last category's probability is ``threshold`` or
    more. All whole texts are scored, by a model of bounded size.

    Edge cases: a null or empty text has no features and gets the base rate;
    without labels, or with one class only, a category's probability is its
    base rate (0 without rows) for all; labels that are null are not used; of
    several labels of an id the largest counts; rows that repeat are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    categories = categories or default_categories()
    chain = train(docs, labels, categories, id_col=id_col, text_col=text_col)
    known = told(docs.sparkSession, chain)
    names = [f"p_{n}" for n in categories]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.value.predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([row[k] for row in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (
        rows.mapInArrow(tidy(predict), ", ".join([f"id {kind}", *[f"{n} double" for n in names]]))
        .withColumn("rejected", F.col(names[-1]) >= threshold)
        .withColumnRenamed("id", id_col)
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the documents that :func:`score` rejects; all columns stay."""
    found = score(docs, labels, id_col=id_col, text_col=text_col, **options)
    return without_ids(docs, materialise(found.filter("rejected").select(id_col), "toxic"), id_col)
