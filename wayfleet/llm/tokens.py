"""Token ids of whole texts by a public byte-level BPE file of the tokenizers library.

A byte-level BPE splits a text before it merges, and no split reaches from a word into the white
space behind it. A text may therefore be cut there into chunks (white space and what follows it)
whose ids in a row are those of the whole text, and a slice's distinct chunks are encoded once each.
They go through tiktoken, which gives the same ids from the same vocabulary (ids rank the merges)
faster; a test compares all this with the tokenizers library. A text with white space outside ASCII
or with a special token's text goes through the tokenizers library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfleet.llm.common import raw

#: Distinct chunks whose ids a Python worker keeps: the first it meets, so nearly all frequent ones.
#: Later ones are encoded again in each slice; ids don't depend on it.
CACHE = 400_000
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def vocabulary() -> str:
    """The public tokenizer file; it is a parameter of each operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """size of each id in bytes: self.bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        to_byte = letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = "|".join([_WIDE_SPACE, *map(re.escape, self.special)])
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for i in range(len(self.bytes)):
            self.bytes[i] = len(self.tokenizer.id_to_token(i) or "")

        self.number: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in a row, and where each text's ids start (one more entry: the end)."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._chunked(texts)
        ids, starts = self._chunked(texts.filter(pa.array(~odd)))
        rest = iter([ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        whole = iter([np.asarray(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)])
        parts = [next(whole if o else rest) for o in odd]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.bpe.encode_ordinary(c) for c in chunks]
        starts = np.zeros(len(got) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)), out=starts[1:])
        return np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(starts[-1])), starts

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = raw(texts)
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        space = _SPACE[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[off[:-1][off[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        ends = np.append(begin, len(data)).astype(np.int64)
        d = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = d.dictionary.to_numpy(zero_copy_only=False)
        known = np.fromiter((self.number.get(c, -1) for c in distinct), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(known < 0)
        ids, starts = self.ids, self.starts
        if len(new):
            chunks = distinct[new].tolist()
            more, at = self._encode(chunks)
            ids, starts = np.concatenate([ids, more]), np.concatenate([starts, starts[-1] + at[1:]])
            known[new] = np.arange(len(self.number), len(self.number) + len(new))
            if len(self.number) + len(new) <= CACHE:
                self.number.update(zip(chunks, known[new].tolist(), strict=True))
                self.ids, self.starts = ids, starts
        n = known[d.indices.to_numpy(zero_copy_only=False)]
        size = starts[n + 1] - starts[n]
        to = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(starts[n] - to[:-1], size) + np.arange(to[-1])], to[np.searchsorted(begin, off)]
