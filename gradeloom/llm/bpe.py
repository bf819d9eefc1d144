"""Whole-text encoding with the public byte-pair vocabularies, one distinct chunk at a time.

A pre-tokenizer never joins text across the cuts made here, so a text's ids are the ids of
its chunks, one after another.  A chunk is a stretch of the text's own bytes: nothing is
copied to cut it.  Chunks are looked up, a group of texts at a time, among those that the
worker knows; only chunks that it doesn't know go through the ``tokenizers`` library.
Cuts are made only where the vocabularies certainly cut: before a single space, around a
single line feed, and between a letter (A-Z and Latin-1) and ``.,;:!?``.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gradeloom.llm.shared import hold

#: Unicode's White_Space property, spelled out.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space belongs to the ids, texts with a run of it are encoded whole.
RUN = f"[{SPACE}][{SPACE}]"
#: A space and letters only: such a chunk can go through the library in one line with others.
WORD = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Bytes of the chunks that a worker remembers, and of the longest that it does.  Beyond the
#: bound those that were met least go (results don't change).
REMEMBERED, LONGEST = 8_000_000, 64
#: Words that go through the library as one line.
LINE = 100
#: Texts are worked on in groups of about so many bytes.
GROUP = 10_000_000

STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: After a byte 0xC3 these end a Latin-1 letter (all of À-ÿ but × and ÷).
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of large strings without nulls, and the number of chunks before each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    feed = data == 10
    first = (data == 32) | feed
    first[1:] |= feed[:-1]
    stop = np.flatnonzero(STOPS[data])
    stop = stop[stop > 0]
    before = data[stop - 1]
    first[stop[LETTERS[before] | (LATIN[before] & (data[stop - 2] == 0xC3) & (stop > 1))]] = True
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    bounds = np.append(np.flatnonzero(first), len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return chunks, np.searchsorted(bounds, offsets)


def gathered(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids that end at ``ends``, those numbered ``which``, one after another, and
    where each of them ends."""
    size = np.diff(ends, prepend=ends.dtype.type(0))
    own = size[which]
    out = np.cumsum(own, dtype=np.int64)
    if not len(out) or not out[-1]:
        return ids[:0], out
    at = np.repeat(((ends - size)[which] - out + own).astype(np.int32), own)
    at += np.arange(out[-1], dtype=np.int32)
    return ids.take(at), out


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, keeps_space: bool, memory: float = 1.0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.inner = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.most, self.size = int(REMEMBERED * memory), max(1, int(GROUP * min(1, 2 * memory)))
        self.known = pa.array([], pa.binary())
        self.ids, self.ends, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # what a token takes of the text, or whether it ends a word
            self.width[i] = len(token) if keeps_space else token.endswith("</w>")

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and where each text's end."""
        found = [array("I", e.ids) for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.frombuffer(x, np.uint32) for x in found if x] or [np.zeros(0, np.uint32)])
        return ids, np.cumsum([len(x) for x in found], dtype=np.int64)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks.  Chunks that are one word go through the library many at a
        time: their ids are told apart by the bytes that each id stands for, or by the ids that
        end a word."""
        text = new.cast(pa.string())
        word = pc.match_substring_regex(text, WORD).to_numpy(zero_copy_only=False)
        words = text.filter(pa.array(word)).to_pylist()
        line_ids, _ = self._library(["".join(words[i : i + LINE]) for i in range(0, len(words), LINE)])
        each = pc.binary_length(new).to_numpy()[word] if self.keeps_space else np.ones(len(words), np.int64)
        line_ends = np.searchsorted(np.cumsum(self.width[line_ids]), np.cumsum(each)) + 1
        rest_ids, rest_ends = self._library(text.filter(pa.array(~word)).to_pylist())
        # words first, then the others: back to the order of ``new``
        order = np.empty(len(new), np.int64)
        order[np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])] = np.arange(len(new))
        return gathered(np.concatenate([line_ids, rest_ids]), np.concatenate([line_ends, rest_ends + len(line_ids)]), order)

    def _forget(self) -> None:
        """Long chunks, and beyond the bound those that were met least, go."""
        size = pc.binary_length(self.known).to_numpy()
        keep = size <= LONGEST
        if size[keep].sum() > self.most:
            order = np.argsort(np.where(keep, -self.met, 1), kind="stable")
            keep[order[np.cumsum(size[order]) > self.most // 2]] = False
            self.met >>= 1
        if not keep.all():
            keep = np.flatnonzero(keep)
            self.ids, ends = gathered(self.ids, self.ends, keep)
            self.known, self.ends, self.met = self.known.take(pa.array(keep)), ends.astype(np.int32), self.met[keep]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit; null and empty texts have none."""
        found = []
        for ids, ends in self.runs(pa.array(texts, pa.large_string())):
            found += [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]
        return found

    def runs(self, texts: pa.Array, end: int | None = None):
        """Of texts (null: empty), group by group: all ids, one text's after another's, and
        where each text's end.  ``end`` is put after each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            until = int(np.searchsorted(size, (size[at - 1] if at else 0) + self.size, "right"))
            part = texts.slice(at, max(1, until - at))
            ids, ends = self._group(part)
            if end is not None:
                ids, ends = np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)
            yield ids, ends
            at += len(part)

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.flatnonzero(pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)) if self.keeps_space else ()
        chunks, before = cut(pc.if_else(pc.match_substring_regex(texts, RUN), "", texts) if len(whole) else texts)
        which = pc.index_in(chunks, value_set=self.known)
        if which.null_count:
            new = chunks.filter(which.is_null()).dictionary_encode()
            ids, ends = self._learn(new.dictionary)
            indices = np.array(which.fill_null(0))
            indices[which.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + new.indices.to_numpy()
            self.ends = np.concatenate([self.ends, (ends + len(self.ids)).astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, new.dictionary])
            self.met = np.concatenate([self.met, np.zeros(len(ends), np.int64)])
        else:
            indices = which.to_numpy()
        self.met += np.bincount(indices, minlength=len(self.met))
        ids, ends = gathered(self.ids, self.ends, indices)
        self._forget()
        ends = np.concatenate([[0], ends])[before]
        if len(whole):
            own, own_ends = self._library([texts[int(t)].as_py() for t in whole])
            # what was left empty before is put in its place
            parts = np.split(ids, ends[1:-1])
            for t, x in zip(whole.tolist(), np.split(own, own_ends[:-1]), strict=True):
                parts[t] = x
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_space: bool, memory: float = 1.0) -> Encoder:
    """This worker's encoder of a vocabulary file; ``memory`` scales what it remembers and how
    much text it works on at a time."""
    hold("bpe", _ENCODERS.clear)
    key = (path, keeps_space, memory)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def forget() -> None:
    _ENCODERS.clear()
