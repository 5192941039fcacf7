"""Exact counts within one text, shared by the operators that judge texts."""

from __future__ import annotations

from collections import Counter

import numpy as np

from palimpsest.llm.common import mix64

WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def count_of(text: bytes, characters: bytes) -> int:
    """How many of the text's bytes are among ``characters`` (ASCII)."""
    return len(text) - len(text.translate(None, characters))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def numbered(tokens: list[bytes]) -> np.ndarray:
    """Each word's number, by first appearance."""
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int64, len(tokens))


def words_in_repeats(ids: np.ndarray) -> int:
    """Words that lie in a window of five words which the text holds twice or more, the first one included."""
    n = len(ids) - WINDOW + 1
    if n < 2 or ids.max() == len(ids) - 1:
        return 0
    columns = [ids[i : i + n] for i in range(WINDOW)]
    hashed = mix64(ids)
    with np.errstate(over="ignore"):
        keys = sum(hashed[i : i + n] * _MULTIPLIERS[i] for i in range(WINDOW))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    first, second = order[:-1][same], order[1:][same]
    if all((c[first] == c[second]).all() for c in columns):
        twice = np.zeros(n, bool)
        twice[first] = twice[second] = True
    else:  # two different windows share a hash
        windows = list(zip(*(c.tolist() for c in columns), strict=True))
        found = Counter(windows)
        twice = np.fromiter((found[w] > 1 for w in windows), bool, n)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())
