"""Byte-level BPE of whole columns in numpy: no Python loop over words or characters.

A batch of texts becomes one array of code points. Word borders come from comparisons of neighbouring character
classes, equal words are found by two position-independent rolling hashes, and the distinct words are merged
together: the symbols of all words lie in one flat array, and each round looks up every neighbouring pair by binary
search over the sorted pair keys and merges, in each word, the pair of lowest rank.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd

_END, _LETTER, _NUMBER, _OTHER, _SPACE = range(5)
#: The code points with the Unicode property White_Space.
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MISS = np.iinfo(np.int32).max
_SHIFT = np.int64(1 << 20)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs: an id for each byte, sorted pair keys with the id they merge to, a class per code point."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    classes: np.ndarray


def _classes() -> np.ndarray:
    import regex

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, text):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = _OTHER
    out[_WHITE] = _SPACE
    return out


def load_vocabulary(path: str) -> Vocabulary:
    """Read a file of base64 tokens and ranks. A pair of tokens can merge if their bytes together are a token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs = [
        (ranks[t[:i]] * int(_SHIFT) + ranks[t[i:]], r)
        for t, r in ranks.items()
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    keys, ids = np.array(sorted(pairs), np.int64).T
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Vocabulary(byte_ids, np.ascontiguousarray(keys), ids.astype(np.int32), _classes())


def _starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """True where a word starts: a change of class, with the rules for blanks before words and for contractions."""
    start = np.empty(len(points), bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _END))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    for p in np.flatnonzero(points == 0x27):
        if p + 1 >= len(points) or kinds[p + 1] != _LETTER or (p and (kinds[p - 1] == _OTHER or points[p - 1] == 0x20)):
            continue
        two = (points[p + 1], points[p + 2] if p + 2 < len(points) else 0)
        if two[0] in (0x73, 0x74, 0x6D, 0x64):
            n = 2
        elif two in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            n = 3
        else:
            continue
        start[p + 1 : p + n] = False
        start[p + n] = True
    return start


_known_powers: list = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2**64, kept for the next chunk."""
    if _known_powers and len(_known_powers[0][0]) >= n:
        return [(a[:n], b[:n]) for a, b in _known_powers]
    out = []
    for base in _BASES:
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        out.append((both[0], both[1]))
    _known_powers[:] = out if n <= 1 << 22 else []
    return out


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array and how many each word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_ids, done_word = [], []
    while len(ids):
        found = np.full(len(ids), _MISS, np.int32)
        near = np.flatnonzero(word[1:] == word[:-1])
        keys = ids[near] * _SHIFT + ids[near + 1]
        at = np.searchsorted(v.pair_keys, keys)
        at[at == len(v.pair_keys)] = 0
        found[near] = np.where(v.pair_keys[at] == keys, v.pair_ids[at], _MISS)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(ids)])
        least = np.minimum.reduceat(found, first)
        lowest = np.repeat(least, size)
        ended = lowest == _MISS
        done_ids.append(ids[ended])
        done_word.append(word[ended])
        live = ~ended
        ids, word, found, lowest = ids[live], word[live], found[live], lowest[live]
        if not len(ids):
            break
        chosen = found == lowest
        # of overlapping equal pairs, every second one from the left
        at = np.flatnonzero(chosen)
        run = np.r_[True, np.diff(at) != 1]
        offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[offset % 2 == 0]
        ids[at] = found[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, word = ids[keep], word[keep]
    ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
    return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


def _words(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each word of the texts, in order, its text's number and its distinct word's number; the distinct words."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds = v.classes[points]
    kinds[ends] = _END
    begin = np.flatnonzero(_starts(points, kinds))
    end = np.r_[begin[1:], len(points)]
    real = kinds[begin] != _END
    begin, end = begin[real], end[real]
    owner = np.searchsorted(ends, begin)
    mixed = points.astype(np.uint64) + np.uint64(0x7F4A7C15F39CC061)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    hashes = []
    for power, inverse in _powers(len(points)):
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed * power, out=sums[1:])
        hashes.append((sums[end] - sums[begin]) * inverse[begin])
    number, distinct = pd.factorize(hashes[0])
    example = np.zeros(len(distinct), np.int64)
    example[number[::-1]] = np.arange(len(number))[::-1]
    if not np.array_equal(hashes[1], hashes[1][example][number]):  # two words with one hash: compare the words
        number, strings = pd.factorize(np.array([joined[a:b] for a, b in zip(begin, end)], object))
        return owner, number, [s.encode() for s in strings]
    return owner, number, [joined[a:b].encode() for a, b in zip(begin[example].tolist(), end[example].tolist())]


def encode(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and how many each text has. An empty text has none."""
    if not any(texts):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    owner, number, words = _words(texts, v)
    ids, size = merge_words(words, v)
    many = size[number]
    per_text = np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)
    from_ = np.cumsum(size) - size
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return ids[np.repeat(from_[number], many) + within], per_text


def count(texts: list[str], v: Vocabulary) -> np.ndarray:
    """How many ids each text has."""
    if not any(texts):
        return np.zeros(len(texts), np.int64)
    owner, number, words = _words(texts, v)
    size = merge_words(words, v)[1]
    return np.bincount(owner, weights=size[number], minlength=len(texts)).astype(np.int64)
