"""BPE with forced boundaries, for vocabularies with word ends.

No merge can reach across two neighbouring bytes that stand side by side in no token of the
vocabulary, so the text may be cut there and the pieces encoded on their own: their ids, one after the
other, are those of the whole. The table of such byte pairs is read off the vocabulary. Blanks occur in
no token at all, so all texts fall into chunks between blanks; inside a chunk the table gives further
cuts, and only the piece that ends a word gets the word-end mark. Chunks recur, so each is cut and
encoded once and kept in a table that is emptied when it is full.

Null texts are empty texts: no ids, decoded to the empty text. A text of one long word is cut like any
other. Repeated rows each get their own result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from savora.llm.common import record_batches
from savora.llm.tokens import as_symbols, byte_alphabet, token_bytes

# Entries of a table of pieces, and bytes of the texts and ids in each table; longer texts are encoded each time.
TABLE_ENTRIES, TABLE_BYTES, LONG_TEXT = 300_000, 32 << 20, 256
_BLANKS = b" \t\n\x0b\x0c\r"
# Letters that normalising only lower-cases, one by one, with punctuation behind them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DDL = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether two bytes stand side by side in any token."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        codes = np.frombuffer(token, dtype=np.uint8)
        inside[codes[:-1], codes[1:]] = True
    return inside


class CutEncoder:
    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.end = spec["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.ending = self.tokenizer.model
        self.inner = models.BPE(spec["vocab"], merges)
        raw = [token_bytes(t.removesuffix(self.end) if self.end else t) for t in spec["vocab"]]
        self.inside = pairs_inside(raw)
        blanks = list(_BLANKS)
        if self.inside[blanks].any() or self.inside[:, blanks].any():
            raise ValueError("blanks occur inside tokens of this vocabulary")
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {c: np.array([i], dtype="<u4").tobytes() for c, i in added.items()}
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.entries = entries
        alphabet = byte_alphabet()
        self.pairs = {alphabet[a] + alphabet[b] for a, b in np.argwhere(self.inside).tolist()}
        self.chunks: dict[bytes, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.held = {id(t): 0 for t in (self.chunks, self.first, self.last)}

    def _hold(self, table: dict, text: str | bytes, ids: bytes) -> None:
        """Keep a result, in a table that is emptied when it gets too large."""
        if len(text) > LONG_TEXT:
            return
        if len(table) >= self.entries or self.held[id(table)] >= TABLE_BYTES:
            table.clear()
            self.held[id(table)] = 0
        table[text] = ids
        self.held[id(table)] += len(text) + len(ids)

    def _piece(self, symbols: str, ends_word: bool) -> bytes:
        table = self.last if ends_word else self.first
        found = table.get(symbols)
        if found is None:
            ids = [t.id for t in (self.ending if ends_word else self.inner).tokenize(symbols)]
            found = np.array(ids, dtype="<u4").tobytes()
            self._hold(table, symbols, found)
        return found

    def _word(self, symbols: str) -> bytes:
        """Ids of one pre-token, cut at the byte pairs of no token."""
        pairs, ids, start = self.pairs, [], 0
        for cut in range(1, len(symbols)):
            if symbols[cut - 1:cut + 1] not in pairs:
                ids.append(self._piece(symbols[start:cut], False))
                start = cut
        ids.append(self._piece(symbols[start:], True))
        return b"".join(ids)

    def _words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk, in byte symbols."""
        plain = _PLAIN.fullmatch(chunk)
        if plain is not None:
            letters = plain[1].lower()
            letters = letters if letters.isascii() else as_symbols(letters)
            return [letters, plain[2]] if plain[2] else [letters]
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]

    def _chunk(self, chunk: bytes) -> bytes:
        parts = [chunk.decode()]
        if self.special is not None and b"<|" in chunk:
            parts = self.special.split(parts[0])
        out = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            else:
                out += map(self._word, self._words(part))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text in UTF-8, as little-endian unsigned 32-bit integers."""
        chunks = text.split()
        new = {c: self._chunk(c) for c in set(chunks) if c not in self.chunks}
        parts = [new[c] if c in new else self.chunks[c] for c in chunks] if new else list(map(self.chunks.__getitem__, chunks))
        for chunk, ids in new.items():
            self._hold(self.chunks, chunk, ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Without a decoder, a vocabulary's texts are its tokens side by side."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def cut_encoder(path: str) -> CutEncoder:
    return CutEncoder(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit) and ``decoded`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = cut_encoder(path)

        def rows():
            for batch in batches:
                for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                    ids = coder.encode(body.cast(pa.binary()).as_py() or b"")
                    yield doc_id.as_py(), len(ids) // 4, ids, coder.decode(ids)

        yield from record_batches(rows(), SCHEMA)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text").mapInArrow(run, DDL)
