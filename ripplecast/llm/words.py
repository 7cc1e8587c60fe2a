"""Hashes of the words of many texts at once, with numpy.

The hash of a word is a polynomial in its bytes, taken from one running sum over the whole slice
of texts and then mixed; A-Z count as a-z. Texts are hashed in pieces of about a megabyte, cut
between words, so memory does not follow the length of a text beyond 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word: anything but blanks, or letters, digits and all beyond ASCII.
NOT_BLANK = ~_BLANK
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """Powers of a base modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        size = max(count, _PIECE + (1 << 16))
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a piece."""
    member = np.zeros(len(raw) + 2, dtype=np.int8)
    member[1:-1] = inside[raw]
    edge = np.diff(member)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts]), starts


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Joined texts of about a megabyte, with the places and ends of the texts in them."""
    held, places, ends, size = [], [], [], 0
    for place, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > _PIECE:  # a very long text is cut at a line end or space
                stop = at + _PIECE
                cut = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop))
                if cut <= at:
                    later = [p for p in (text.find(b" ", stop), text.find(b"\n", stop)) if p >= 0]
                    cut = min(later, default=len(text))
                stop = cut
            held += [text[at:stop], b" "]
            size += stop - at + 1
            places.append(place)
            ends.append(size)
            if size >= _PIECE:
                yield b"".join(held), places, ends
                held, places, ends, size = [], [], [], 0
            at = stop
            if at >= len(text):
                break
    if held:
        yield b"".join(held), places, ends


def word_hashes(texts: list[bytes], inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    for joined, places, ends in _pieces(texts):
        hashes, starts = _piece_hashes(np.frombuffer(joined, dtype=np.uint8), inside)
        found.append(hashes)
        upto = np.searchsorted(starts, ends)
        np.add.at(counts, places, np.diff(upto, prepend=0))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at the offsets from every place where the last of them exists."""
    count = len(words) - offsets[-1]
    if count <= 0:
        return words[:0]
    total = np.zeros(count, dtype=np.uint64)
    for k, offset in enumerate(offsets):
        total += words[offset : offset + count] * _STEPS[k]
    return mix(total + np.uint64(len(offsets)) * _STEPS[63] + np.uint64(offsets[-1]))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text, or of its few words."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    runs = window_hashes(words, tuple(range(width)))
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        start = end - count
        if count >= width:
            sets.append(np.unique(runs[start : end - width + 1]))
        else:
            sets.append(window_hashes(words[start:end], tuple(range(count))) if count else words[:0])
    return sets
