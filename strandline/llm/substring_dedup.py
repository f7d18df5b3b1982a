"""Substring dedup by super-k-mers: windows of words that start more than once are cut out of all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bloom, repeats, shared
from strandline.llm import textbytes as tb


def spec(window: int = 35, minimiser: int = 8) -> repeats.Spec:
    """window: words in a window; minimiser: words in the gram whose least hash names a window's bucket."""
    if not 2 <= minimiser <= window:
        raise ValueError("the minimiser must have 2 words at least, and fit into the window")
    return repeats.Spec("word", window, minimiser, window - minimiser + 1)


class SuperKmers(repeats.Search):
    """Windows whose minimiser is found once only in all texts cannot repeat. It is counted twice: over all texts,
    and again over distinct texts, where copies of whole texts no longer count."""

    def marks(self, u: repeats.Units) -> tuple[np.ndarray, np.ndarray]:
        grams = repeats.gram_hashes(self.spec, u)
        runs = repeats.anchors(self.spec, u, grams)
        text, start, n = repeats.within(u, runs, self.spec.window, self.spec.window)
        own = n > 0
        text = text[own]
        out = np.zeros(len(text), repeats.MARK)
        out["place"], out["start"], out["windows"] = runs[2][own] - u.at[text], start[own] - u.at[text], n[own]
        out["key"] = tb.mix(grams[runs[2][own]], 1)
        return text, out

    def first_keys(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(marks), bool), marks["key"]

    def refine(self, marked: DataFrame) -> tuple[Callable, bytes | None]:
        @tb.task("repeats")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield repeats.key_batch(repeats.read_marks(batch.column("marks"))[0]["key"])

        again, hot = repeats.counted_filter(marked.select("marks").mapInArrow(run, "key long, n long"))
        found = marked.sparkSession.sparkContext.broadcast(again)
        return lambda _, marks: bloom.passes(found.value, marks["key"]), hot


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35, minimiser: int = 8, with_text: bool = True) -> DataFrame:
    """Cut each word covered by a window of ``window`` words that starts anywhere else too, in the same row or another.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Windows are judged on the input.
    Consecutive windows that share a minimiser travel as one packed string to its bucket, where sorting counts
    windows exactly; windows of minimisers with very many strings are counted one by one instead (see ``repeats``).

    Returns the columns of ``docs`` with ``text`` replaced by the kept words joined by one blank (left out without
    ``with_text``), and n_words, n_removed, n_spans (removed runs) and kept_sha256. Columns of these names are replaced.
    A null text has no words and becomes empty; a text shorter than a window stays whole; rows with equal texts,
    repeated rows too, are copies of each other; an empty table gives an empty one; nulls elsewhere pass through.
    One text of n bytes, and what is worked out of it, must fit into a worker's memory (about 100 n).
    """
    out = repeats.remove_repeats(docs, text, SuperKmers(spec(window, minimiser)), with_text)
    out = out.withColumnRenamed("n_units", "n_words")
    added = ["n_words", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        return shared.unpacked(out.withColumn(text, F.col("kept").cast("string")), docs.columns, [text, *added]).select(*dict.fromkeys([*docs.columns, *added]))
    return shared.unpacked(out, docs.columns, added, (text,))
