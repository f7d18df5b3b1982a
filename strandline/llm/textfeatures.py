"""Numbers that describe a whole text, for the classifiers: shares of byte classes, of repeated words, of line shapes."""

from __future__ import annotations

import numpy as np

from strandline.llm import textbytes as tb

_CLASSES = ["upper", "lower", "digit", "blank", "line", "stop", "comma", "shout", "bar", "mark", "quote", "bracket", "control", "wide"]
_CLASS = np.full(256, _CLASSES.index("mark"), np.int64)
for _name, _members in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("digit", b"0123456789"), ("blank", b" \t"), ("line", b"\n\r"), ("stop", b".?"), ("comma", b",;:-"), ("shout", b"!"), ("bar", b"|"), ("quote", b"'\"`"), ("bracket", b"()[]{}<>"), ("control", bytes([*range(9), 11, 12, *range(14, 32), 127])), ("wide", bytes(range(128, 256)))):
    _CLASS[list(_members)] = _CLASSES.index(_name)
NAMES = [*_CLASSES, "bytes", "words", "word_length", "long_words", "one_byte_words", "distinct", "top_word", "adjacent", "upper_words", "marked_words", "line_words"]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One row of NAMES for each text, and (word hashes, index of each text's first word)."""
    n, k = len(offsets) - 1, len(_CLASSES)
    size = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * k, size) + _CLASS[data], minlength=n * k).reshape(n, k)
    starts, ends, at = tb.words(data, offsets)
    hashes = tb.word_hashes(data, starts, ends)
    words = np.diff(at)
    text = np.repeat(np.arange(n), words)
    length = ends - starts
    many, total = np.maximum(words, 1), np.maximum(size, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(text, flag, n) / many

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    key = np.sort((text.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))) if n < 1 << 20 else None
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(hashes) else np.empty(0, np.int64)
    owner = (key[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(first, len(hashes))))
    begin_class, end_class = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    upper = (begin_class == 0) & (length > 1) & (_CLASS[data[np.minimum(starts + 1, len(data) - 1)]] == 0) if len(starts) else np.empty(0, bool)
    out = np.column_stack([
        counts / total[:, None], np.log1p(size), np.log1p(words), np.bincount(text, length, n) / many, share(length > 24), share(length == 1),
        np.bincount(owner, minlength=n) / many, top / many, share(same), share(upper), share(end_class == _CLASSES.index("mark")), words / (counts[:, _CLASSES.index("line")] + 1) / 50,
    ])
    return out, (hashes, at)


class Scaler:
    """Standardised square roots: shares near 0 count most."""

    def __init__(self, x: np.ndarray):
        x = np.sqrt(x)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3

    @classmethod
    def of(cls, mean: np.ndarray, std: np.ndarray) -> Scaler:
        """From the mean and standard deviation of square roots."""
        out = cls.__new__(cls)
        out.mean, out.std = mean, std + 1e-3
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.sqrt(x) - self.mean) / self.std, -3, 3)
        return np.column_stack([z, np.ones(len(z))])
