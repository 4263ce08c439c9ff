"""Word bounds in buffers of UTF-8 texts that lie side by side."""

from __future__ import annotations

import numpy as np

_bytes = np.arange(256)
#: Each byte with A-Z as a-z; other letters stay as they are.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Bytes of words in lower-cased texts: a-z and every byte of other characters, with and without digits.
LETTERS = ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
LETTERS_DIGITS = LETTERS | ((_bytes >= 48) & (_bytes <= 57))


def word_bounds(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of ``members`` bytes; a run ends with its text."""
    word = members[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def texts_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.searchsorted(offsets, starts, side="right") - 1
