"""Windows over the character spans of words (SC-13, WN-5)."""

from __future__ import annotations

import re

import pandas as pd

# Fixed value: a word as in ``text.word_tokens``.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def window_spans(text: str, size: int, overlap: int) -> list[dict]:
    """Windows of ``size`` words, each ``size - overlap`` words after the last.

    ``char_start`` and ``char_end`` are code point offsets of the first word's
    start and the last word's end; the window's text is the original between
    them, white space included.  A window that reaches the last word is the last.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    out = []
    for first in range(0, max(len(words) - overlap, 1) if words else 0, size - overlap):
        last = min(first + size, len(words)) - 1
        start, end = words[first][0], words[last][1]
        out.append({"chunk_index": len(out), "first_token": first, "n_tokens": last - first + 1,
                    "char_start": start, "char_end": end, "chunk_text": text[start:end]})
    return out


def series_spans(size: int, overlap: int):
    def windows(texts: pd.Series) -> pd.Series:
        return pd.Series([window_spans(t, size, overlap) if isinstance(t, str) else None for t in texts], dtype=object)
    return windows
