"""Whole-text encoding with a byte-level BPE vocabulary, with the ids of the tokenizers library.

The library keeps offsets and token texts of everything it encodes, which costs several times the
encoding. Here a rank encoder built from the same vocabulary file does the bulk. It is used for texts on
which both are sure to agree: characters whose class has not changed since Unicode 3.2, and no run of
letters or blanks so long that its merges would dominate. All other texts go through the library.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the split pattern of this byte-level pre-tokenizer.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_RUN = 2000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_SYMBOLS = dict(enumerate(byte_alphabet()))
_BYTES = {c: b for b, c in _SYMBOLS.items()}


def as_symbols(text: str) -> str:
    """The text's bytes in the byte alphabet."""
    return text.encode().decode("latin-1").translate(_SYMBOLS)


def token_bytes(token: str) -> bytes:
    return bytes(_BYTES[c] for c in token)


@functools.cache
def _settled() -> re.Pattern:
    """Texts of nothing but characters whose class is the same in Unicode 3.2 and now."""
    old = unicodedata.ucd_3_2_0
    spans, start = [], None
    for code in range(0x30000):
        c = chr(code)
        fine = old.category(c)[0] == unicodedata.category(c)[0] != "C" or c in "\t\n\r"
        if fine and start is None:
            start = code
        elif not fine and start is not None:
            spans.append((start, code - 1))
            start = None
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(f"[{inside}]*")


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {token_bytes(t): i for t, i in vocab.items() if t not in special}
        self.special = set(special)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bulk = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) > LONGEST_RUN and (max(map(len, text.split())) if text.strip() else len(text)) > LONGEST_RUN:
            return self.library(text)
        if not text.isascii() and _settled().fullmatch(text) is None:
            return self.library(text)
        if len(text) > LONGEST_RUN and re.search(rf"\s{{{LONGEST_RUN}}}", text):
            return self.library(text)
        return self.bulk.encode_to_numpy(text, allowed_special=self.special).astype("<u4", copy=False)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
