"""Encoding whole columns of texts part by part, where no match of the GPT-2 pattern can cross the cuts.

A blank or a line feed between two characters that are not white space always begins a match: texts are cut before these.
Arrow cuts and finds the distinct parts of a run of texts; only distinct parts reach Python, and those seen before
are not encoded again. Texts with other white space, or with two such characters in a row, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm import textbytes as tb

#: Ids one after the other, and the start and the number of those of each part.
Pool = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Marks that are matches of their own after letters.
MARKS = ".,;:"
#: Parts, and bytes of a part's text, that a worker keeps.
CACHED, LONGEST = 160_000, 48
#: White space (as Python and Unicode have it) other than blank and line feed; two in a row; or one at the end.
_ODD = r"[\t\r\f\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|[ \n]\z"


class Kept:
    """Ids of parts seen lately: two generations, so that what comes again stays and what does not goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, parts: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, parts))
        if self.old:
            young, old = self.young, self.old.get
            for i, ids in enumerate(found):
                if ids is None and (ids := old(parts[i])) is not None:
                    found[i] = young[parts[i]] = ids
        return found

    def add(self, parts: list[str], ids: list[bytes]) -> None:
        self.young.update([(p, x) for p, x in zip(parts, ids, strict=True) if len(p) <= LONGEST])
        if len(self.young) > CACHED // 2:
            self.old, self.young = self.young, {}


def shown(part: str) -> str:
    """A part as it stands in its text: line feeds belong to the part, blanks come before it."""
    return part if part[0] == "\n" else " " + part


def by_stems(parts: list[str], known: Kept, encode: Callable[[list[str]], list[bytes]], marks: dict[str, bytes]) -> list[bytes]:
    """Ids of parts. A mark after letters is a match of its own, so the letters are looked for, and kept, alone."""
    stems = [p[:-1] if p[-1] in marks and p[:-1].isalpha() else p for p in parts]
    wanted = list(dict.fromkeys(stems))
    found = dict(zip(wanted, known.find(wanted), strict=True))
    missing = [p for p, ids in found.items() if ids is None]
    new = encode(missing)
    known.add(missing, new)
    found.update(zip(missing, new, strict=True))
    return [found[s] if len(s) == len(p) else found[s] + marks[p[-1]] for s, p in zip(stems, parts, strict=True)]


def kept_ids(known: Kept, parts: Callable[[list[str]], list[bytes]], width: int) -> Callable[[pa.Array], Pool]:
    """Ids of distinct parts, from those kept or else from ``parts``."""

    def run(distinct: pa.Array) -> Pool:
        known.young[""] = b""
        all_parts = distinct.to_pylist()
        found = known.find(all_parts)
        gaps = [i for i, ids in enumerate(found) if ids is None]
        missing = [all_parts[i] for i in gaps]
        new = parts(missing) if missing else []
        for i, ids in zip(gaps, new, strict=True):
            found[i] = ids
        known.add(missing, new)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        return np.frombuffer(b"".join(found), f"<u{width}"), np.cumsum(sizes) - sizes, sizes

    return run


def encode(texts: pa.Array, distinct_ids: Callable[[pa.Array], Pool], whole: Callable[[list[str]], list[bytes]], width: int, cuts: bool = True, apart: list[str] = ()) -> list[np.ndarray]:
    """Ids of each text, from ``distinct_ids`` (all ids, and start and number for each distinct part, as ``shown``) and ``whole`` (ids of any strings).

    A text is taken to begin with a line feed, whose id, one only, is left out again. Texts that contain a string of
    ``apart`` are encoded whole.
    """
    n = len(texts)
    out: list[np.ndarray] = [None] * n
    texts = pc.fill_null(texts, "")
    led = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
    odd = pc.match_substring_regex(led, _ODD).to_numpy(zero_copy_only=False) if cuts else np.ones(n, bool)
    for string in apart:
        odd = odd | pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(odd)
    for i, ids in zip(at.tolist(), whole(texts.take(pa.array(at)).to_pylist()) if len(at) else (), strict=True):
        out[i] = np.frombuffer(ids, f"<u{width}")
    at = np.flatnonzero(~odd)
    if not len(at):
        return out
    # each text begins with a part of no characters, which stands for nothing
    lists = pc.split_pattern(pc.replace_substring(led if len(at) == n else led.take(pa.array(at)), "\n", " \n"), " ")
    coded = lists.flatten().dictionary_encode()
    number = np.int32 if texts.nbytes < 1 << 30 else np.int64  # a text has no more ids than bytes
    pool, starts, sizes = distinct_ids(coded.dictionary)
    index = coded.indices.to_numpy()
    size = sizes.astype(number)[index]
    ids = pool[tb.places(starts.astype(number)[index], size)]
    stops = np.cumsum(size, dtype=np.int64)[np.cumsum(lists.value_lengths().to_numpy()) - 1]
    for i, p, q in zip(at.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
        out[i] = ids[p + 1 : q]
    return out
