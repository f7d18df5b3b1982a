"""Mixing documents to target weights of domains that each document belongs to in part only.

1. A classifier learnt from the table of labels gives each document posteriors over the domains low, clean and toxic.
2. A document at rate r is expected to add r * tokens * posterior tokens to each domain. Projected gradient
   steps fit nonnegative rates, from 1 for all, so that these sums match the targets by least squares. A step
   needs the domain sums alone: three numbers, added up over all documents. As a rate follows from the posteriors
   and the steps so far, no rate is stored.
3. A rate becomes a whole number of copies, rounded up with the chance of its fraction, by the hash of doc_id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb
from strandline.llm.quality import held_out, sample_ids, sampled_texts
from strandline.llm.textfeatures import NAMES, Scaler, features

DOMAINS = ("low", "clean", "toxic")
#: Expected share of the tokens, and most labelled rows that the classifier is fitted on.
TARGETS, FITTED = {"low": 0.02, "clean": 0.95, "toxic": 0.03}, 8_000
#: Sums are counted in whole thousandths of tokens, so that they do not depend on the order of adding.
UNIT, STEPS, CLOSE = 1000, 60, 1e-6
#: Share of the wanted tokens that may be missed without a warning.
MISSED = 0.02
#: Share of the largest eigenvalue that is added to the metric: directions in which there are hardly any tokens, and targets
#: that cannot be met there, then move no rate by much.
DAMPING = 0.05
_BITS, _LEAST = 16, 5


def _shrunk(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


@tb.task("mixing")
def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
            x, (hashes, at) = features(data, offsets)
            words = [np.unique(_shrunk(hashes[p:q])).astype(np.int32) for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column("id").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int32()))], names=["id", "x", "words"])


class DomainModel:
    """Multinomial logistic regression on the features of a text and on the weights of evidence of its words."""

    def __init__(self, x: np.ndarray, words: list[np.ndarray], y: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 1e-3):
        toxic, rest = [np.bincount(np.concatenate([words[i] for i in np.flatnonzero(k)] or [np.empty(0, np.int64)]).astype(np.int64), minlength=1 << _BITS) for k in (y == 2, y != 2)]
        n, m = max(1, (y == 2).sum()), max(1, (y != 2).sum())
        evidence = np.log((toxic + 0.5) / (n + 1)) - np.log((rest + 0.5) / (m + 1))
        self.evidence = np.where(toxic + rest >= _LEAST, np.clip(evidence, -3, 5), 0).astype(np.float32)
        z = np.column_stack([x, np.array([self._shares(self.evidence[w]) for w in words])])
        self.scale = Scaler(z)
        z = self.scale(z)
        self.w = w = np.zeros((z.shape[1], len(DOMAINS)))
        share = (np.bincount(y, minlength=len(DOMAINS)) + 0.5) / (len(y) + 1.5)
        w[-1] = np.log(share)
        goal = np.eye(len(DOMAINS))[y]
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            g = z.T @ (self._soft(z @ w) - goal) / len(y) + decay * w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @staticmethod
    def _shares(evidence: np.ndarray) -> tuple[float, float]:
        """Of the distinct words: share with strong evidence for toxic, and their mean evidence above 0."""
        n = max(1, len(evidence))
        return (evidence > 2).sum() / n, np.maximum(evidence, 0).sum() / n

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and numbers of words."""
        x, (hashes, at) = features(data, offsets)
        code = _shrunk(hashes)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        distinct = np.unique(text * (1 << _BITS) + code)
        owner, e = distinct >> _BITS, self.evidence[distinct & (1 << _BITS) - 1]
        n = len(at) - 1
        many = np.maximum(np.bincount(owner, minlength=n), 1)
        z = np.column_stack([x, np.bincount(owner, e > 2, n) / many, np.bincount(owner, np.maximum(e, 0), n) / many])
        return self._soft(self.scale(z) @ self.w), np.diff(at)


def fit_domains(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: int = FITTED) -> DomainModel | None:
    """Learnt from at most ``fitted`` labelled documents, of least hash of doc_id; None without any."""
    domain = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 2).when(F.col("quality") == 1, 1)
    known = labels.select(F.col("doc_id").alias("id"), domain.alias("y")).filter("y IS NOT NULL").filter(~held_out("id")).dropDuplicates(["id"])
    ids = sample_ids(known.join(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id")), "id", "left_semi").select("id"), fitted)
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    label = {r[0]: r[1] for r in known.join(F.broadcast(wanted), "id", "left_semi").select("id", "y").collect()}
    rows = sampled_texts(docs, ids, doc_id, text).mapInArrow(_with_words, "id long, x array<double>, words array<int>").toArrow()
    at = rows["id"].to_numpy()
    order = np.argsort(at, kind="stable")
    x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, len(NAMES))[order]
    words = rows["words"].combine_chunks()
    flat, cuts = np.asarray(words.flatten()), np.concatenate(([0], np.cumsum(np.asarray(words.value_lengths()))))
    return DomainModel(x, [flat[cuts[i] : cuts[i + 1]] for i in order], np.array([label[i] for i in at[order]]))


def _limits(posteriors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most rate of each document, from those of its likeliest domain; of domains as likely, the greatest."""
    top = posteriors == posteriors.max(axis=1, keepdims=True)
    return np.where(top, bounds[:, 0], 0).max(axis=1), np.where(top, bounds[:, 1], 0).max(axis=1)


def rates(posteriors: np.ndarray, steps: list[np.ndarray], bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points from which the next step goes) after the steps so far: each step is a gradient in domain space, put
    into effect on every document, held at 0 or within its bounds, and carried on with Nesterov's momentum."""
    least, most = (0, np.inf) if bounds is None else _limits(posteriors, bounds)
    r = ahead = np.ones(len(posteriors))
    for k, g in enumerate(steps):
        new = np.minimum(most, np.maximum(least, ahead - posteriors @ g))
        ahead = new + k / (k + 3) * (new - r)
        r = new
    return r, ahead


def _posterior(model, n_domains: int):
    @tb.task("mixing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch, 0):
                p, n = model(data, offsets)
                yield pa.record_batch([pa.array(n, pa.int64()), *[pa.array(np.round(p[:, d], 6)) for d in range(n_domains)]], names=["n", *[f"p{d}" for d in range(n_domains)]])

    return run


def _sums(steps: list[np.ndarray], square: bool, bounds: np.ndarray | None):
    """Of each batch: tokens of each pair of domains in thousandths, or expected ones of each domain, at the rates and ahead of them."""

    @tb.task("mixing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            p = np.column_stack([batch.column(k).to_numpy() for k in range(1, batch.num_columns)])
            w = p[:, :, None] * p[:, None, :] if square else p[:, None, :] * np.stack(rates(p, steps, bounds), axis=1)[:, :, None]
            got = np.rint(w.reshape(len(n), -1) * (n * UNIT)[:, None]).astype(np.int64).sum(axis=0)
            yield pa.record_batch([pa.array([list(got)], pa.list_(pa.int64()))], names=["v"])

    return run


def _total(table: DataFrame, steps: list[np.ndarray], width: int, square: bool, bounds: np.ndarray | None = None) -> np.ndarray:
    got = table.mapInArrow(_sums(steps, square, bounds), "v array<long>").agg(*[F.coalesce(F.sum(F.col("v")[k]), F.lit(0)) for k in range(width)]).first()
    return np.array(got, np.float64) / UNIT


def fit_rates(table: DataFrame, targets: dict[str, float], total: float | None = None, anchor: str = "clean", bounds: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected tokens by domain, target tokens) for a table (n, p0, p1, ...) of tokens and posteriors.

    Without a total, it is such that the tokens of ``anchor`` at rate 1 have their share. Errors are weighed by the inverse of the
    damped sum(tokens * p p'), which is also the metric of a step: no step is too long. ``bounds`` has a row (least, most) for
    each domain, for the rates of the documents that are likeliest in it.
    """
    names = list(targets)
    share = np.array([targets[d] for d in names]) / sum(targets.values())
    metric = _total(table, [], len(names) ** 2, True).reshape(len(names), -1)
    inverse = np.linalg.inv(metric + np.eye(len(names)) * (DAMPING * np.linalg.eigvalsh(metric)[-1] + 1e-9))
    steps: list[np.ndarray] = []
    now = ahead = _total(table, steps, 2 * len(names), False, bounds)[: len(names)]
    goal = share * (now[names.index(anchor)] / max(share[names.index(anchor)], 1e-9) if total is None else total)
    for _ in range(STEPS):
        if np.abs(now - goal).sum() <= CLOSE * max(goal.sum(), 1):
            break
        steps.append(inverse @ (ahead - goal))
        before, sums = now, _total(table, steps, 2 * len(names), False, bounds)
        now, ahead = sums[: len(names)], sums[len(names) :]
        if np.abs(before - now).sum() <= CLOSE * max(goal.sum(), 1):
            break  # the targets cannot be met with rates of 0 or more, or within bounds; this is the nearest
    return steps, now, goal


def _mixed(model, steps: list[np.ndarray], bounds: np.ndarray | None, names: list[str], text: int | None):
    @tb.task("mixing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("__row")
            luck = batch.column("__luck").to_numpy()
            for i, j, data, offsets in tb.chunks(batch, batch.column("__text") if text is None else tb.field(row, text)):
                p, n = model(data, offsets)
                p = np.round(p, 6)
                r = rates(p, steps, bounds)[0]
                copies = np.where(n > 0, np.floor(r + luck[i:j]), 1).astype(np.int64)
                yield pa.record_batch([row.slice(i, j - i), pa.array(n, pa.int64()), *[pa.array(p[:, d]) for d in range(len(names))], pa.array(r), pa.array(copies)], names=["__row", "n_tokens", *[f"p_{d}" for d in names], "rate", "copies"])

    return run


class Even:
    """Where there is nothing to learn from: every domain is as likely."""

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = tb.words(data, offsets)[2]
        return np.full((len(at) - 1, len(DOMAINS)), 1 / len(DOMAINS)), np.diff(at)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, doc_id: str = "doc_id", text: str = "text", fitted: int = FITTED, with_text: bool = True, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The columns of ``docs``, n_tokens (words), p_low, p_clean, p_toxic, rate and copies.

    ``fitted`` is the most labelled documents that the domains' classifier is learnt from (those of least hash of doc_id); all else is
    worked out over all documents. ``targets`` are weights of the domains; ``total`` is the wanted number of tokens (by default such that the
    clean domain keeps its own). ``bounds`` are the least and most rate (the least at most 1, the most at least 1) of documents
    whose likeliest domain it is; the other rates make up for them, as far as they can; a warning tells by how much targets are
    missed. Columns of these names are replaced. A null or wordless text has no tokens, so no rate
    can matter: it stays once. Rows with equal texts have equal rates; copies are drawn by the hash of doc_id and text,
    so repeated rows get equal numbers; rows without doc_id are drawn by their text. An empty table gives an empty one.
    """
    if set(targets) != set(DOMAINS) or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError(f"targets must be weights of 0 or more for {DOMAINS}, not all 0")
    if any(d not in DOMAINS or not 0 <= least <= 1 <= most for d, (least, most) in (bounds or {}).items()):
        raise ValueError(f"bounds must hold 1 and be 0 or more, for {DOMAINS}")
    targets = {d: targets[d] for d in DOMAINS}
    shared.lean(docs.sparkSession)
    model = fit_domains(docs, labels, doc_id, text, fitted) or Even()
    table = shared.keep(docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(_posterior(model, len(DOMAINS)), "n long, p0 double, p1 double, p2 double"), "posteriors")
    limits = np.array([bounds.get(d, (0, np.inf)) for d in DOMAINS]) if bounds else None
    steps, met, goal = fit_rates(table, targets, total, bounds=limits)
    if np.abs(met - goal).sum() > MISSED * max(goal.sum(), 1):
        warnings.warn(f"targets are missed: expected tokens {dict(zip(DOMAINS, np.rint(met).astype(int).tolist(), strict=True))}, wanted {np.rint(goal).astype(int).tolist()}", stacklevel=2)
    columns = docs.columns if with_text else [c for c in docs.columns if c != text]
    luck = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *([] if with_text else [F.col(f"`{text}`").alias("__text")]), luck.alias("__luck"))
    added = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    ddl = f"__row {rows.schema['__row'].dataType.simpleString()}, n_tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}, rate double, copies long"
    return shared.unpacked(rows.mapInArrow(_mixed(model, steps, limits, list(DOMAINS), columns.index(text) if with_text else None), ddl), columns, added)


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says; rows with null or 0 copies go. An empty table gives an empty one."""
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).drop("__copy")
