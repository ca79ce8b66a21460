"""Fast whole-text encoding with a ``tokenizers`` file: repeated words are encoded once.

Texts are cut before spaces and newlines that follow a character which surely
isn't white space.  No match of the byte-level pattern spans such a place, nor
does an added token like ``<|endoftext|>``, so the ids of the parts, put
together, are the ids of the whole text.  Equal parts of a slice of texts are
found by dictionary encoding; only parts that the worker hasn't met lately reach
the library.  Added tokens are what the library makes of them; texts with one
that holds white space or takes the white space after it are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once.
SLICE = 6_000_000
#: Parts that a worker remembers, in each of two generations.
MEMORY = 250_000
#: Bytes of unknown parts that are encoded as one text.
JOINED = 4_000


def _solid_end(part: bytes) -> bool:
    last = part[-1]
    return 33 <= last <= 126 or (last >= 128 and len(part) > 1 and 0xC3 <= part[-2] <= 0xDF)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Consecutive rows of a binary array, about ``size`` bytes at a time, a row at least."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


class TextEncoder:
    """Encodes arrays of texts; one per worker process and file."""

    _made: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splits = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level tokenizer, whose texts can be cut")
        self._library = Tokenizer.from_file(path)
        vocabulary = self._library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        # A byte is one character of a token, but for added tokens, which are written as they are.
        self._length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self._length[i] = len(token)
        self._uncut: list[bytes] = []
        for i, token in self._library.get_added_tokens_decoder().items():
            self._length[i] = len(token.content.encode())
            if token.rstrip or any(c.isspace() for c in token.content):
                self._uncut.append(token.content.encode())
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin and the last end).  Nulls count as empty."""
        texts = texts.cast(pa.binary()).fill_null(b"")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        if at[0] == at[-1]:
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        if self._uncut and any(token in value for value in texts.to_pylist() for token in self._uncut):
            each = [np.array(e.ids, self.dtype) for e in self._library.encode_batch_fast([v.decode() for v in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(each), np.r_[0, np.cumsum([len(e) for e in each])]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        parts, order = self._parts(data, at)
        words = parts.dictionary.to_pylist()
        known = self._known(words)
        sizes = np.array([len(v) for v in known], np.int64) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(known), self.dtype)
        index = parts.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(starts[index] - ends + counts, counts) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.searchsorted(order, at)]

    @staticmethod
    def _parts(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        gaps = np.flatnonzero((data == 32) | (data == 10))
        gaps = gaps[gaps > 0]
        before = data[gaps - 1]
        two = data[np.maximum(gaps - 2, 0)]
        solid = ((before > 32) & (before < 127)) | ((before >= 128) & (two >= 0xC3) & (two <= 0xDF) & (gaps > 1))
        cuts = np.zeros(len(data) + 1, bool)
        cuts[gaps[solid]] = True
        cuts[at] = True
        cuts[-1] = False
        cuts[0] = True
        order = np.flatnonzero(cuts)
        offsets = np.r_[order, len(data)].astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return array.dictionary_encode(), np.r_[order, len(data)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        young, old = self._young, self._old
        out: list[bytes | None] = [young.get(w) for w in words]
        missing = []
        for i, v in enumerate(out):
            if v is None:
                if (v := old.get(words[i])) is not None:
                    out[i] = young[words[i]] = v
                else:
                    missing.append(i)
        for i, v in zip(missing, self._encoded([words[i] for i in missing]), strict=True):
            out[i] = young[words[i]] = v
        if len(young) > MEMORY:
            self._old, self._young = young, {}
        return out

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of parts.  Those that begin with a gap and end solidly are encoded many at a time and told apart by their tokens' lengths."""
        groups: list[list[int]] = []
        alone: list[int] = []
        size = JOINED
        for i, w in enumerate(words):
            if w[0] not in (32, 10) or not _solid_end(w):
                alone.append(i)
                continue
            if size >= JOINED:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += len(w)
        out: list[bytes] = [b""] * len(words)
        fast = self._library.encode_batch_fast
        if groups:
            texts = [b"".join([words[i] for i in g]).decode() for g in groups]
            for k in range(0, len(texts), 64):
                for g, e in zip(groups[k : k + 64], fast(texts[k : k + 64], add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, self.dtype)
                    reached = np.r_[0, np.cumsum(self._length[ids])]
                    ends = np.cumsum([0, *[len(words[i]) for i in g]])
                    cut = np.searchsorted(reached, ends)
                    if not np.array_equal(reached[np.minimum(cut, len(reached) - 1)], ends):
                        alone += g
                        continue
                    raw, step = ids.tobytes(), self.dtype.itemsize
                    for i, a, b in zip(g, (cut[:-1] * step).tolist(), (cut[1:] * step).tolist(), strict=True):
                        out[i] = raw[a:b]
        for k in range(0, len(alone), 256):
            some = alone[k : k + 256]
            for i, e in zip(some, fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.dtype).tobytes()
        return out
