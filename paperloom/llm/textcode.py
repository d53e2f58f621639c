"""Words of texts as numpy codes, one pass of C code over each text."""

from __future__ import annotations

import numpy as np
import xxhash

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
#: A-Z to lower case; every ASCII byte that is no letter or digit to a space.
_WORD_TABLE = bytes.maketrans(_UPPER + _SEPARATORS, _UPPER.lower() + b" " * len(_SEPARATORS))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters beyond ASCII, A-Z in lower case."""
    return text.translate(_WORD_TABLE).split()


def tokens(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.lower().split()


class WordHash(dict):
    """64-bit code of each word, kept for words that come again."""

    limit, longest = 400_000, 64

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = code
        return code

    def codes(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit codes mixed (an invertible finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers without linear relations, one for each place in a shingle.
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Code of each run of ``k`` consecutive words; of the whole sequence if it is shorter; none without words."""
    n = len(codes)
    k = min(k, n)
    if not n:
        return codes
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += mixed(codes[j : n - k + 1 + j]) * _PLACES[j]
    return mixed(out + np.uint64(k))


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPAN = 64
#: Random numbers by place in a word and byte, none for white space; a word's code is their sum.
_BYTES = np.random.default_rng(41).integers(1 << 63, size=(_SPAN, 256), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[:, _WHITE] = 0
_BYTES = _BYTES.reshape(-1)


def token_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``tokens`` of all texts in a row, and where each text's begin and end."""
    joined = b" ".join(texts).lower()
    raw = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    word = ~_WHITE[raw]
    word[1:] &= _WHITE[raw[:-1]]
    first = np.flatnonzero(word)
    bounds = np.searchsorted(first, begins)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    size = np.diff(np.append(first, len(raw)))
    place = np.arange(first[0], len(raw), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    code = np.add.reduceat(_BYTES.take(((place & (_SPAN - 1)) << 8) | raw[first[0] :]), first - first[0])
    # White space after a word adds nothing to its sum; only the word itself can be too long for it.
    for k in np.flatnonzero(size > _SPAN).tolist():
        w = joined[first[k] : first[k] + size[k]].rstrip(b" \t\n\r\x0b\x0c")
        if len(w) > _SPAN:
            code[k] = xxhash.xxh3_64_intdigest(w)
    return code, bounds


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text, the sorted distinct codes of its shingles (see ``shingles``)."""
    codes, bounds = token_codes(texts)
    mx = mixed(codes)
    out = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for j in range(k):
        out += mx[j : len(codes) - k + 1 + j] * _PLACES[j] if len(out) else np.zeros(0, np.uint64)
    out = mixed(out + np.uint64(k))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s = np.sort(out[a : b - k + 1] if b - a >= k else shingles(codes[a:b], k))
        sets.append(s if len(s) < 2 else s[np.append(True, s[1:] != s[:-1])])
    return sets
