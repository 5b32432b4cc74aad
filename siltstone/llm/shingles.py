"""64-bit hashes of words and word shingles of whole texts, vectorised over batches."""

from __future__ import annotations

import numpy as np

from siltstone.llm.common import PIECE_CHARS, mix64, pieces

_ODD = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CHUNK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after another, and each text's number of words."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _power(_ODD, len(raw)), out=total[1:])
        words = mix64((total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased; none for null."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if held:
            words, counts = _chunk(held)
            for i, part in zip(owner, np.split(words, np.cumsum(counts)[:-1]), strict=True):
                out[i].append(part)
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _at_words(text) if text else ():
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size > _CHUNK:
                flush()
    flush()
    return [np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64) for parts in out]


def _at_words(text: str):
    """Pieces of a text that end at white space; a word longer than a piece is kept whole."""
    rest = ""
    for piece in pieces(text):
        piece = rest + piece
        if piece[-1:] in " \t\n\v\f\r" or len(piece) < PIECE_CHARS:
            rest = ""
            yield piece.encode("utf-8", "surrogatepass")
        else:
            rest = piece
    if rest:
        yield rest.encode("utf-8", "surrogatepass")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, in order; one of all words if there are fewer."""
    n = len(words)
    if not n:
        return words
    take = min(k, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - take + 1, take, np.uint64)
        for j in range(take):
            acc = mix64(acc * _ODD + words[j : n - take + 1 + j])
    return acc
