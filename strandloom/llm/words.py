"""Words of many texts at once, as numpy and Arrow arrays: runs of anything but ASCII white space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts in a row, each text's first byte and the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return held, at - at[0]


@dataclass
class Words:
    """The words of n texts in a row."""

    data: np.ndarray  # bytes of all words, without what is between
    offsets: np.ndarray  # each word's first byte in data, and the end
    borders: np.ndarray  # each text's first word, and the end

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, at = text_bytes(texts)
        inside = ~SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(at))
        begins[at[full]] = inside[at[full]]
        ends[at[full + 1] - 1] = inside[at[full + 1] - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        offsets = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(ends - begins, out=offsets[1:])
        return cls(data[inside], offsets, np.searchsorted(begins, at))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(each word's number, the distinct words)."""
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(self.data))])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        sizes = np.diff(self.offsets)
        texts = np.diff(np.concatenate([[0], np.cumsum(kept)])[self.borders])
        bytes_ = self.data[np.repeat(kept, sizes)]
        ends = np.cumsum(sizes[kept])
        spaced = np.insert(bytes_, ends, 0x20)  # a space behind each word
        ends = ends + np.arange(1, len(ends) + 1)
        last = np.cumsum(texts)  # words up to the end of each text
        full = texts > 0
        drop = np.ones(len(spaced), bool)
        drop[ends[last[full] - 1] - 1] = False  # but not behind the last
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:] = np.concatenate([[0], ends])[last] - np.cumsum(full)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spaced[drop])))
