"""Whole texts to token ids with a public tokenizer, word by word.

The tokenizer works on pieces that never span white space, so the ids of a text are those of its words one after the
other. Words are encoded once for a batch and kept, with their ids, in a worker's memory for later batches: two Arrow
columns, bounded in bytes. When they grow beyond the bound, the half that was met most often stays, so frequent words
outlive the stream of words that come once. Words made of Latin letters and plain marks go to the tokenizer's model in
one call: their pieces need neither normalising but for case nor its general splitter. All other words go through the
whole tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, words

#: Bytes that a worker's words and their ids may take up.
MEMORY_BYTES = 8 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column of adjoining values, given where each ends in the data."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class WordEncoder:
    """Ids of whole texts as uint16 or uint32 little-endian bytes; `width` is the bytes of an id."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)  # shared: a worker holds the vocabulary once; simple words hold no added tokens
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values())
        self.width = 2 if top < 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.last = np.zeros(top + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.memory_bytes = memory_bytes
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)

    def _by_whole(self, new: pa.Array) -> pa.Array:
        found = self.whole.encode_batch_fast(new.to_pylist(), add_special_tokens=False)
        return pa.array([np.array(e.ids, self.type).tobytes() for e in found], pa.large_binary())

    def _by_pieces(self, new: pa.Array) -> pa.Array | None:
        """The ids of simple words; None if a piece doesn't end in just one closing token."""
        parted = pc.utf8_lower(new)
        for a, b in ((_LETTERS, _MARKS), (_MARKS, _LETTERS)):
            parted = pc.replace_substring_regex(parted, f"([{a}])([{b}])", r"\1 \2")
        counts = pc.add(pc.count_substring(parted, " "), 1).to_numpy(zero_copy_only=False)
        line = " ".join(parted.to_pylist())
        ids = np.array(self.pieces.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.type)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != counts.sum():
            return None
        return _binary(ids.tobytes(), ends[np.cumsum(counts) - 1] * self.width)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Adds words that aren't known yet, and tells the place of each."""
        simple = pc.and_(pc.match_substring_regex(new, f"^[{_LETTERS}{_MARKS}]+$"), pc.invert(pc.match_substring(new, "<|")))
        some = new.filter(simple)
        found = self._by_pieces(some) if len(some) else None
        parts = [(some, found)] if found is not None else []
        rest = new.filter(pc.invert(simple)) if found is not None else new
        if len(rest):
            parts.append((rest, self._by_whole(rest)))
        self.known = pa.concat_arrays([self.known, *(w for w, _ in parts)])
        self.ids = pa.concat_arrays([self.ids, *(i for _, i in parts)])
        self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        late = np.zeros(len(new), bool) if found is None else ~simple.to_numpy(zero_copy_only=False)
        place = np.empty(len(new), np.int64)
        place[np.argsort(late, kind="stable")] = np.arange(len(self.known) - len(new), len(self.known))
        return place

    def _forget(self) -> None:
        if self.known.nbytes + self.ids.nbytes > self.memory_bytes:
            stay = pa.array(np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2]))
            self.known, self.ids, self.met = self.known.take(stay), self.ids.take(stay), self.met[stay.to_numpy()] // 2

    def encode(self, texts: pa.Array) -> list[bytes]:
        flat, counts = words(texts)
        if not len(flat):
            return [b""] * len(texts)
        self._forget()
        coded = flat.cast(pa.large_string()).dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        place, chosen = pc.fill_null(place, 0).to_numpy(), coded.indices.to_numpy()
        if new.any():
            place = place.copy()
            place[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        self.met[place] += np.bincount(chosen, minlength=len(place))
        ids = self.ids.take(pa.array(place)).take(coded.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = ids.buffers()[2].to_pybytes()
        cuts = offsets[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@kept
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
