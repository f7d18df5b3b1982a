"""A quality classifier from trusted positives and unlabelled text: non-negative positive-unlabelled learning.

Unlabelled text is all text that is not held out, with whatever labels it has ignored: the mixture that the risk is defined on.
Twelve numbers of each such text are kept, and all that follows are sums over all of these rows:

1. First logistic models tell positives from unlabelled text, each without a fifth of the rows.
2. The class prior is the least ratio, over thresholds of these models, of the share of unlabelled texts above it and the
   share of positives above it (best bin estimation). Each row is scored by the model that has not seen it, and each ratio is
   judged by its upper bound.
3. The classifier minimises the non-negative unbiased risk under that prior.

With the logistic loss, both are convex: Newton steps need the sums of losses, slopes and curvatures at a point, so a step is one
pass over the rows and a few hundred numbers for the driver. Sums are of whole parts of 2**-24, the same in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb
from strandline.llm.textfeatures import NAMES, Scaler, features

THRESHOLD = 0.7
#: Parts of one that sums are counted in, folds of the first models, and the pull of weights towards 0 (see ``pull``).
UNIT, FOLDS, RIDGE = 1 << 24, 5, 1e-3
#: Passes of a descent at most, parts of a step tried in each, and the gain below which it ends: some eight passes are taken.
PASSES, STEPS, CLOSE = 40, (1.0, 0.5, 0.25, 1 / 16, 1 / 64, 1 / 256), 1e-6
#: Bins of the first model's log odds, from -LIMIT to LIMIT; chance with which a bin's bounds may be wrong.
BINS, LIMIT, DELTA = 200, 10.0, 0.05
#: Features that tell of the form of a text. Its length, and what it mentions (numbers, quoted or very long strings), are left out.
_FORM = [NAMES.index(n) for n in ("upper", "lower", "blank", "stop", "shout", "bar", "mark", "distinct", "top_word", "adjacent", "upper_words", "marked_words")]


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2


def sample_ids(ids: DataFrame, most: int) -> list[int]:
    """At most ``most`` ids, by least hash: the same for any order and partitioning of the rows."""
    return [r[0] for r in ids.filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most).collect()]


def sampled_texts(docs: DataFrame, ids: list[int], doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` with these ids; the list is bounded by a parameter, and so is the broadcast."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(wanted), "id", "left_semi")


@tb.task("quality")
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
            x = features(data, offsets)[0][:, _FORM]
            yield pa.record_batch([batch.column("id").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def totals(x: np.ndarray, good: np.ndarray, fold: np.ndarray, models: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sums, in parts of 1 / UNIT, for each model (fold that it does not see, weights), over all rows and over the positives.

    Of each row: 1, the loss of taking it for a negative, the row itself, and that loss' slope and curvature.
    """
    i, j = np.triu_indices(x.shape[1])
    pairs = x[:, i] * x[:, j]
    out = []
    for skip, w in models:
        z = (x * w).sum(axis=1)
        s = _sigmoid(z)[:, None]
        of_row = np.rint(np.column_stack([np.ones(len(x)), np.logaddexp(0, z), x, s * x, s * (1 - s) * pairs]) * UNIT).astype(np.int64)
        seen = fold != skip
        out.append([of_row[seen].sum(axis=0), of_row[seen & good].sum(axis=0)])
    return np.array(out)


class Means:
    """The means that ``totals`` adds up for."""

    def __init__(self, sums: np.ndarray, d: int):
        self.n = int(sums[0]) // UNIT
        v = sums[1:] / max(1, int(sums[0]))
        self.loss, self.x, self.slope = v[0], v[1 : d + 1], v[d + 1 : 2 * d + 1]
        self.curve = np.zeros((d, d))
        self.curve[np.triu_indices(d)] = v[2 * d + 1 :]
        self.curve += np.triu(self.curve, 1).T


class Point(NamedTuple):
    """Weights, and there the objective, its slope and curvature, and something that must not fall below 0."""

    w: np.ndarray
    loss: float
    slope: np.ndarray
    curve: np.ndarray
    room: float


def told_apart(u: Means, p: Means, w: np.ndarray) -> Point:
    """Positives against unlabelled rows, both sides of one weight."""
    return Point(w, (p.loss - w @ p.x + u.loss) / 2, (p.slope - p.x + u.slope) / 2, (p.curve + u.curve) / 2, np.inf)


def negative_risk(u: Means, p: Means, prior: float) -> float:
    """R_U(-) - prior * R_P(-): the estimate of the negatives' risk, which is below 0 only when the model overfits."""
    return u.loss - prior * p.loss


def unbiased_risk(prior: float):
    """prior * R_P(+) + R_U(-) - prior * R_P(-), where the last two together are not below 0.

    The loss of a row taken for a positive is that of taking it for a negative, less the margin, so positives add a plane.
    """

    def at(u: Means, p: Means, w: np.ndarray) -> Point:
        return Point(w, u.loss - prior * (w @ p.x), u.slope - prior * p.x, u.curve, negative_risk(u, p, prior))

    return at


def pull(d: int, n: int) -> np.ndarray:
    """The ridge of each of d weights, fitted on n rows: as strong as one row, and a little more; none for the last, the bias."""
    return np.append(np.full(d - 1, RIDGE + 1 / max(1, n)), 0)


def descend(sums, objective, starts: list[tuple[int, np.ndarray]], parts: tuple[float, ...] = STEPS) -> list[np.ndarray]:
    """The weights of least ``objective`` with a small ridge, for several models at once, from ``starts`` (fold not seen, weights).

    ``sums`` gives the totals for a list of models. Of the ``parts`` of a Newton step, tried in one pass, that of least value among
    those that keep their room is taken. A model for which none gains is done: it is at the least value, or at the edge of its room.
    """
    d = len(starts[0][1])

    def points(models: list[tuple[int, np.ndarray]]) -> list[Point]:
        found = []
        for (_, w), (u, p) in zip(models, sums(models), strict=True):
            x, ridge = objective(all_rows := Means(u, d), Means(p, d), w), pull(d, all_rows.n)
            found.append(x._replace(loss=x.loss + (ridge * w * w).sum() / 2, slope=x.slope + ridge * w, curve=x.curve + np.diag(ridge + 1e-9)))
        return found

    now, live = points(starts), list(range(len(starts)))
    for _ in range(PASSES):
        steps = {k: np.linalg.solve(now[k].curve, -now[k].slope) for k in live}
        tried = iter(points([(starts[k][0], now[k].w + s * step) for k, step in steps.items() for s in parts]))
        live = []
        for k in steps:
            best = min((x for x in [next(tried) for _ in parts] if x.room >= 0), key=lambda x: x.loss, default=now[k])
            if now[k].loss - best.loss >= CLOSE:
                live.append(k)
            now[k] = min(best, now[k], key=lambda x: x.loss)
        if not live:
            break
    return [x.w for x in now]


class Linear:
    def __init__(self, scale: Scaler, w: np.ndarray):
        self.scale, self.w = scale, w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((self.scale(x) * self.w).sum(axis=1))


def pu_weights(sums, d: int, prior: float) -> np.ndarray:
    """The weights of least non-negative risk."""
    w = np.zeros(d)
    w[-1] = np.log(prior / (1 - prior))
    return descend(sums, unbiased_risk(prior), [(-1, w)])[0]


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from counts of scores by bin, rising: as near to 0 and 1 as the number of unlabelled rows supports.

    Two positives or fewer bound no ratio; the prior is then 0.5.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = [np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled)]
    slack_p, slack_u = [np.sqrt(np.log(4 / DELTA) / 2 / n) for n in (n_p, n_u)]
    bound = np.where(q_p > slack_p, (q_u + slack_u + slack_p) / np.maximum(q_p, 1e-12), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(q_u[k] / q_p[k], 1 / (n_u + 2), (n_u + 1) / (n_u + 2))) if np.isfinite(bound[k]) else 0.5


def bins(x: np.ndarray, good: np.ndarray, fold: np.ndarray, models: dict[int, np.ndarray]) -> np.ndarray:
    """Counts, by kind (positives, all) and bin of the log odds, of rows scored by the model that does not see their fold."""
    out = np.zeros((2, BINS), np.int64)
    for k, w in models.items():
        own = fold == k
        b = np.clip(((x[own] * w).sum(axis=1) + LIMIT) * (BINS / 2 / LIMIT), 0, BINS - 1).astype(np.int64)
        out[0] += np.bincount(b[good[own]], minlength=BINS)
        out[1] += np.bincount(b, minlength=BINS)
    return out


def learnt(sums, binned, d: int) -> np.ndarray:
    """Weights of the classifier, from a way to get ``totals`` and one to get ``bins`` over all rows."""
    size = {k: [Means(x, d).n for x in s] for k, s in enumerate(sums([(k, np.zeros(d)) for k in range(FOLDS)]))}
    able = [k for k, (_, positives) in size.items() if positives]
    first = descend(sums, told_apart, [(k, np.zeros(d)) for k in able], STEPS[::2]) if able else []
    prior = best_bin(*binned(dict(zip(able, first, strict=True))))
    return pu_weights(sums, d, prior)


def _added(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """The sum of ``of_batch`` (x, good, fold) over all batches: whole numbers, ``width`` of which reach the driver."""

    @tb.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            x = batch.column("x")
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            total += of_batch(values, batch.column("good").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy()).ravel()
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], names=["k", "v"])

    out = np.zeros(width, np.int64)
    for k, v in rows.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, x (numbers of the text), good (labelled 1) and fold of all documents with an id that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").filter("quality = 1").select("id").distinct().withColumn("good", F.lit(True))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("__text")).filter("id IS NOT NULL").filter(~held_out("id"))
    rows = texts.mapInArrow(_features, "id long, x array<double>").join(known, "id", "left")
    return rows.select("id", "x", F.coalesce("good", F.lit(False)).alias("good"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Linear | None:
    """The model, or None where there is no positive to learn from.

    Positives are documents labelled 1; the unlabelled text is all documents, labels ignored. Rows held out take no part. Nothing
    is sampled: each pass adds up all rows.
    """
    rows = shared.keep(learning_rows(docs, labels, doc_id, text), "features")
    d = len(_FORM) + 1
    raw = _added(rows, lambda x, good, fold: np.append(np.rint(np.column_stack([np.sqrt(x), x]) * UNIT).astype(np.int64).sum(axis=0), [len(x), good.sum()]), 2 * d)
    n, positives = raw[-2:].tolist()
    if not positives:
        return None
    mean = raw[: d - 1] / UNIT / n
    scale = Scaler.of(mean, np.sqrt(np.maximum(raw[d - 1 : -2] / UNIT / n - mean * mean, 0)))
    width = 2 + 2 * d + d * (d + 1) // 2

    def sums(models: list[tuple[int, np.ndarray]]) -> np.ndarray:
        return _added(rows, lambda x, good, fold: totals(scale(x), good, fold, models), 2 * width * len(models)).reshape(len(models), 2, width)

    def binned(models: dict[int, np.ndarray]) -> np.ndarray:
        return _added(rows, lambda x, good, fold: bins(scale(x), good, fold, models), 2 * BINS).reshape(2, BINS)

    w = learnt(sums, binned, d)
    shared.drop(docs.sparkSession, rows)
    return Linear(scale, w)


def _score(model, text: int | None):
    @tb.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("__row")
            for i, j, data, offsets in tb.chunks(batch, batch.column("__text") if text is None else tb.field(row, text)):
                score = model(features(data, offsets)[0][:, _FORM]) if model else np.full(j - i, 0.5)
                yield pa.record_batch([row.slice(i, j - i), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["__row", "score", "predicted"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that are predicted 1, with their columns, whatever the names of these.

    All rows come back where there is no positive to learn from: a score of 0.5 for all rejects no one. A null text is judged as
    an empty one, and a row without doc_id like any other. Rows with equal texts stay or go together. An empty table gives an
    empty one.
    """
    shared.lean(docs.sparkSession)
    model = fit(docs, labels, doc_id, text)
    return docs if model is None else _scored(docs, model, doc_id, text, True).filter("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The columns of ``docs``, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.7 on).

    Weights and class prior come from all rows that are not held out (see above); with two positives or fewer the prior is
    taken as 0.5. A score depends on the text alone. Columns of these names are replaced. A null text counts as empty and has a score like
    any other; a row without doc_id is not held out and not learnt from; rows with equal texts have equal scores; labels
    other than 1 are not used; where nothing can be learnt, all scores are 0.5. An empty table
    gives an empty one.
    """
    shared.lean(docs.sparkSession)
    return _scored(docs, fit(docs, labels, doc_id, text), doc_id, text, with_text)


def _scored(docs: DataFrame, model: Linear | None, doc_id: str, text: str, with_text: bool) -> DataFrame:
    columns = docs.columns if with_text else [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *([] if with_text else [F.col(f"`{text}`").alias("__text")]))
    out = rows.mapInArrow(_score(model, columns.index(text) if with_text else None), f"__row {rows.schema['__row'].dataType.simpleString()}, score double, predicted int")
    out = out.withColumn("held_out", F.coalesce(F.crc32(F.col("__row").getField(doc_id).cast("string")) % 4 == 2, F.lit(False)))
    return shared.unpacked(out, columns, ["held_out", "score", "predicted"])
