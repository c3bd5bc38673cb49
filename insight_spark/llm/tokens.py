"""Token ids of whole texts with public tokenizers, memoised per chunk between white space."""

from __future__ import annotations

import base64
import gc
import re
from functools import lru_cache

import numpy as np

MARK_ID, MARK = 49406, b"<|startoftext|>"
LONG = 64
COMMA, STOP = re.compile(rb",(?<=[a-z],)(?=[\x20\n])"), re.compile(rb"\.(?<=[a-z]\.)(?=[\x20\n])")


class ChunkIds:
    """Ids of the vocabulary with word ends, equal to encoding the whole text.

    That tokenizer lowers case, drops white space, and never joins across it or across the border of
    letters and punctuation, so a text's ids are the ids of its chunks in order. Chunks seen before come from two generations of a bounded dictionary; the
    others of a batch are encoded together, set apart by a control token.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.young, self.old = most, {}, {}

    def learn(self, chunks: set[bytes]) -> None:
        """Put the ids of these chunks, none of them in the young generation, there."""
        known, old = self.young, self.old
        fresh = []
        for chunk in chunks:
            ids = old.get(chunk)
            if ids is None:
                fresh.append(chunk)
            else:
                known[chunk] = ids
        joined = [c for c in fresh if b"<|" not in c]
        for at in range(0, len(joined), 500):
            part = joined[at : at + 500]
            text = MARK.join(part).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.append(np.flatnonzero(ids == MARK_ID), len(ids)) * 4).tolist()
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(part, ends, strict=True):
                known[chunk] = raw[start:end]
                start = end + 4
        for chunk in fresh:
            if b"<|" in chunk:
                text = chunk.decode("utf-8", "replace")
                known[chunk] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.young) > self.most:
            self.young, self.old = {}, {c: ids for c, ids in self.young.items() if len(c) <= LONG}
        get, out, missing, waiting = self.young.get, [], set(), []
        gc.disable()  # millions of short strings, no cycles
        for text in texts:
            if b"<|" not in text:  # else control strings could arise
                text = STOP.sub(b" .", COMMA.sub(b" ,", text.lower()))
            chunks = text.split()
            ids = list(map(get, chunks))
            if None in ids:
                missing.update(c for c, x in zip(chunks, ids, strict=True) if x is None)
                waiting.append((len(out), chunks))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if missing:
            self.learn(missing)
        for k, chunks in waiting:
            out[k] = b"".join(map(self.young.__getitem__, chunks))
        gc.enable()
        return out


@lru_cache(maxsize=4)
def word_ids(path: str) -> ChunkIds:
    """One encoder per Python worker."""
    return ChunkIds(path)


@lru_cache(maxsize=4)
def byte_ids(path: str):
    """Byte-level encoder of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
