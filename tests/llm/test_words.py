import random
import re

import numpy as np
import pyarrow as pa

from snapsift.llm import words as w

PATTERNS = {"alnum": (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True), "spaced": (w.SPACED, r"[^\x20\x09-\x0D]+", False)}
LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = [None, "", " ", "a", "Ab aB ab", "ab", "cd", "é É x\u0085y", "A1-b2_c3", "\U0001f600x", "x" * 100_000 + " y", "x" * 100_000, "tail\n"]


def test_words_and_hashes_as_by_pattern():
    for table, pattern, lower in PATTERNS.values():
        for most in (1, 7, 1 << 20):
            found, hashes = [], []
            for piece in w.pieces(pa.array(TEXTS).slice(1), table, most):
                hashes += piece.hashes(lower).tolist()
                for low, high in zip(piece.bounds[:-1], piece.bounds[1:], strict=True):
                    found.append([piece.data[a:b].tobytes().decode() for a, b in zip(piece.start[low:high], piece.end[low:high], strict=True)])
            assert found == [re.findall(pattern, t.translate(LOWER) if False else t) if not lower else _spans(t, pattern) for t in TEXTS[1:]]
            flat = [x.translate(LOWER) if lower else x for ws in found for x in ws]
            assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))


def _spans(text, pattern):
    low = text.translate(LOWER)
    return [text[m.start():m.end()] for m in re.finditer(pattern, low)]


def test_windows_stay_in_their_text():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 0, 5)]
    piece = next(w.pieces(pa.array(texts), w.SPACED))
    for size in (1, 2, 3, 5):
        starts = w.window_starts(piece.bounds, size).tolist()
        assert starts == [
            i for i in range(len(piece.start)) if i + size <= len(piece.start) and piece.doc[i] == piece.doc[i + size - 1]
        ]
        hashes = w.window_hashes(piece.hashes(), size)
        flat = [x for t in texts for x in t.split()]
        assert len({(tuple(flat[i:i + size]), int(hashes[i])) for i in starts}) == len({int(hashes[i]) for i in starts})


def test_no_texts():
    assert list(w.pieces(pa.array([], pa.string()), w.ALNUM)) == []
    assert len(w.window_hashes(np.zeros(2, np.uint64), 3)) == 0
