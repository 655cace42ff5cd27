"""Quality rules by repetition coverage.

A text is cut into words of `[^\\x20\\x09-\\x0D]+`. For each n-gram length a rolling hash over the word
codes finds the n-grams that occur twice or more; what counts is the share of the words' characters
that lie inside such n-grams, so a repeated passage counts once however many n-grams it spans; for the
shortest lengths it is the share of the single heaviest n-gram. Lines
equal to an earlier line are measured the same way. Equal hashes are compared word by word, so a
collision never counts.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest tolerated share, in per cent of word characters, inside n-grams found twice or more.
COVERAGE_LIMITS = {5: 40, 6: 40, 8: 35, 10: 35}
# The same for the one n-gram that has the most characters over all its places. Short n-grams are found again in any long
# text, so what all of them cover grows with its length; the share of a single one does not.
TOP_LIMITS = {2: 20, 3: 18, 4: 16}
# The same for lines equal to an earlier one, in per cent of the characters of lines with a word.
LINE_LIMIT = 40
# Symbols per hundred words.
SYMBOL_LIMIT = 25
BASE_WINDOW = 5
BASE_WORDS = 10
BASE_REPEATED = 20

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars")]
    + [("dup_chars", pa.list_(pa.int64())), ("top_chars", pa.list_(pa.int64())), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
RESULT_DDL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_chars bigint, "
    "dup_line_chars bigint, dup_chars array<bigint>, top_chars array<bigint>, base_failed boolean, kept boolean"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _times(hashes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """How often each window of n words occurs."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    same = sorted_hashes[1:] == sorted_hashes[:-1]
    times = np.ones(len(hashes), dtype=np.int64)
    if not same.any():
        return times
    left, right = order[:-1][same], order[1:][same]
    if any((words[left + j] != words[right + j]).any() for j in range(n)):
        windows = np.lib.stride_tricks.sliding_window_view(words, n)
        _, place, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        return count[place.ravel()]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.append(begin, len(hashes)))
    times[order] = np.repeat(sizes, sizes)
    return times


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any of the windows marked by their start."""
    steps = np.zeros(size + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:size]) > 0


def measure(text: bytes | None, limits: dict[int, int] = COVERAGE_LIMITS, tops: dict[int, int] = TOP_LIMITS) -> dict:
    """All measures of one text; a missing text has no words and fails the base rules."""
    text = text or b""
    words = text.split()
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    lengths = np.fromiter((len(w.decode("utf-8", "replace")) for w in vocabulary), np.int64, len(vocabulary))
    chars = lengths[codes] if len(words) else np.zeros(0, np.int64)
    total = int(chars.sum())

    seen: set[bytes] = set()
    line_chars = dup_line_chars = n_dup_lines = 0
    for line in text.split(b"\n"):
        if not line.strip(_BLANKS):
            continue
        size = len(line.decode("utf-8", "replace"))
        line_chars += size
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += size
        seen.add(line)

    mixed = _mixed(codes.astype(np.uint64))
    hashes, dup_chars, top_chars, repeat_words = mixed, {n: 0 for n in limits}, {n: 0 for n in tops}, 0
    upto = np.concatenate([[0], np.cumsum(chars)])
    for n in range(2, max(*limits, *tops, BASE_WINDOW) + 1):
        if len(words) < n:
            break
        hashes = hashes[:-1] * _BASE + mixed[n - 1:]
        if n not in limits and n not in tops and n != BASE_WINDOW:
            continue
        times = _times(hashes, codes, n)
        starts = times > 1
        if not starts.any():
            break  # a longer n-gram cannot be repeated either
        if n in tops:
            top_chars[n] = int((times * (upto[n:] - upto[:-n]))[starts].max())
            if n not in limits and n != BASE_WINDOW:
                continue
        inside = _covered(starts, n, len(words))
        if n in limits:
            dup_chars[n] = int(chars[inside].sum())
        if n == BASE_WINDOW:
            repeat_words = int(inside.sum())

    symbols = sum(text.count(bytes([s])) for s in _SYMBOLS)
    failed = len(words) < BASE_WORDS or 100 * repeat_words > BASE_REPEATED * len(words)
    too_much = (
        any(100 * dup_chars[n] > limits[n] * total for n in limits)
        or any(100 * top_chars[n] > tops[n] * total for n in tops)
        or 100 * dup_line_chars > LINE_LIMIT * line_chars
        or 100 * symbols > SYMBOL_LIMIT * len(words)
    )
    return {
        "n_words": len(words), "word_chars": total, "n_symbols": symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeat_words, "line_chars": line_chars, "dup_line_chars": dup_line_chars,
        "dup_chars": [dup_chars[n] for n in limits], "top_chars": [top_chars[n] for n in tops], "base_failed": failed, "kept": not failed and not too_much,
    }


def _measured(texts: pa.Array) -> pa.Array:
    return pa.array([measure(t) for t in texts.cast(pa.large_binary()).to_pylist()], RESULT)


def measures(text: str | Column = "text") -> Column:
    """The measures and the verdict of each text as one struct column."""
    return F.arrow_udf(_measured, RESULT_DDL)(F.col(text) if isinstance(text, str) else text)


def with_verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and all measures of every document.

    Null and empty texts have no words and are rejected; repeated rows each get their own result.
    """
    return docs.select("doc_id", measures(text).alias("m")).select("doc_id", "m.*")


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(measures(text)["kept"])
