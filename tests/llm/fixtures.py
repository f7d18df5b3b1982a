"""Small tables with every odd case, and plain versions of what the operators compute."""

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def passage(seed, n):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(n))


def odd_rows():
    base = passage(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", None),
        (2, base, "en", None, 1),  # a copy
        (2, base, "en", None, 1),  # a repeated row
        (3, " ".join(near), None, "a", 2),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, "   \t\n ", "en", "a", 0),
        (7, "one two", "en", "a", 0),
        (None, base, "en", "a", 0),
        (None, None, "en", "a", 0),
        (8, passage(5, 40) + "\n" + passage(9, 60) + "\r\n" + passage(5, 40), "en", "a", 0),  # repeats itself
        (9, passage(77, 3000), "en", "b", 0),
        (10, "Ünï cödé 漢字 🤦🏼 " * 60, "de", "b", 0),
        (11, passage(9, 60).replace(" ", "\t"), "en", "b", 0),
        (12, "a " * 500, "en", "b", 0),
        (13, "x" * 5000, "en", "b", 0),
        (14, "One TWO", "en", "b", 0),
    ]
    return rows


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def covered_words(rows, window):
    """(n_words, n_removed, kept bytes) of each text, from counts of all windows."""
    from collections import Counter

    ws = [words(r[1]) for r in rows]
    n = Counter(tuple(w[k : k + window]) for w in ws for k in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def covered_bytes(rows, length):
    from collections import Counter

    ts = [(r[1] or "").encode() for r in rows]
    n = Counter(t[k : k + length] for t in ts for k in range(len(t) - length + 1))
    out = []
    for t in ts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


def shingles(text, size):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
