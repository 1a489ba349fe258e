"""Whole-text byte-level BPE with a bounded memo of space-delimited chunks.

Byte-level BPE never merges across its pre-tokens, and a pre-token never
reaches over a single space that stands between two non-space characters:
the space opens the next pre-token. A text cut at such spaces therefore
encodes chunk by chunk to the very ids of the whole text, and a chunk seen
before needs no second encoding. Chunks with other white space at an end are
never cut off; they stay with their neighbours.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Ids of whole texts; ``memo_items`` bounds the memo, whose older half goes when it is full."""

    LONGEST = 48  # longer chunks are encoded but not remembered

    def __init__(self, path: str, memo_items: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        #: Texts that hold an added token are encoded whole: the library cuts it out before anything else.
        self.added = re.compile("|".join(map(re.escape, sorted(added.values(), key=len, reverse=True)))) if added else None
        size = max(vocab.values(), default=0) + 2
        self.byte_len, self.spaced = np.zeros(size, np.int64), np.zeros(size, bool)
        for piece, i in vocab.items():
            self.byte_len[i] = len(added[i].encode()) if i in added else len(piece)  # one character of a byte-level piece stands for one byte
            self.spaced[i] = i not in added and piece[:1] == "\u0120"  # the byte-level letter of a space
        self.memo_items = memo_items
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes] | None:
        """Ids of chunks, each behind a space, by one call; None if one has white space at an end.

        Inside a chunk is no space, so its ids begin at the one piece that opens with a space.
        """
        if any(not c or c[0].isspace() or c[-1].isspace() for c in chunks):
            return None
        ids = self._ids(" " + " ".join(chunks))
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(chunks):
            return None
        cuts, raw = [*(4 * at).tolist(), 4 * len(ids)], ids.tobytes()
        found = {c: raw[a:b] for c, a, b in zip(chunks, cuts, cuts[1:])}
        self.memo |= {c: b for c, b in found.items() if len(c) <= self.LONGEST}
        if len(self.memo) > self.memo_items:
            self.memo = dict(islice(self.memo.items(), len(self.memo) - self.memo_items // 2, None))
        return found

    def _all(self, parts: list[str]) -> list[bytes] | None:
        found = list(map(self.memo.get, parts))
        if None in found:
            new = self._learn(list(dict.fromkeys(p for p, b in zip(parts, found) if b is None)))
            if new is None:
                return None
            found = [new[p] if b is None else b for p, b in zip(parts, found)]
        return found

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text, the same as the library's for that text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.added is not None and self.added.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        last = b""
        found = self._all(rest) if first and not first[-1].isspace() else None
        if found is None:
            first, *rest = CUT.split(text)
            if rest and rest[-1][-1].isspace():  # white space that closes the text is encoded with what it follows
                last = self._ids(" " + rest.pop()).tobytes()
            found = self._all(rest)
            if found is None:
                return self._ids(text)
        return np.frombuffer(self._ids(first).tobytes() + b"".join(found) + last, dtype="<u4")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset after each id; the pieces of a text are its bytes, in order."""
        return np.cumsum(self.byte_len[ids])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker; its memo serves the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
