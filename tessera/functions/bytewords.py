"""Exact, fast encoding of text columns with a public byte-level BPE file.

The pre-tokeniser of such a vocabulary never joins a non-white character to a white one that
follows it, so a text may be cut before every space that follows a non-white character without
changing its ids. The pieces (words with their leading space) repeat, so each distinct piece is
encoded once by the tokenizers library and its ids are copied from there, all in Arrow arrays.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of distinct pieces and their ids that a worker remembers (about a million words); beyond that it starts anew.
MEMO = 40_000_000
#: New words that are encoded as one text; the bytes of its ids tell where each word's end.
JOINED = 2_000
_CLOSING = ".,;:!?*$%&|#\"()"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space before a space: such texts are cut by _CUT, which looks at the character before.
_ODD = _WHITE + " "
#: A piece that may not stand before another one.
_LOOSE = rf"^$|{_WHITE}$"
_CUT = re.compile(r"(?<=\S)(?= )")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are remembered here
        vocabulary = self.tokenizer.get_vocab()  # a byte-level token has a character for each byte
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        """The words that are known and the bytes of their ids: first words, and words after a space."""
        self.memo: list[tuple[pa.Array, pa.Array]] = [(pa.array([], pa.large_string()), pa.array([], pa.large_binary()))] * 2

    def _encode_new(self, new: pa.Array, prefix: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(an order of the words, the words in it, the bytes of their ids)."""
        order, groups = np.arange(len(new)), [] if prefix else new.to_pylist()
        if prefix:
            loose = pc.match_substring_regex(new, _LOOSE).to_numpy(zero_copy_only=False)
            order = np.concatenate([np.flatnonzero(~loose), np.flatnonzero(loose)])
            closed, rest = new.filter(pa.array(~loose)), new.filter(pa.array(loose))
            lists = pa.ListArray.from_arrays(pa.array([*range(0, len(closed), JOINED), len(closed)], pa.int32()), closed)
            groups = [prefix + g for g in pc.binary_join(lists, pa.scalar(prefix, pa.large_string())).to_pylist()] + [prefix + w for w in rest.to_pylist()]
            new = pa.concat_arrays([closed, rest])
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        bytes_before = np.cumsum(pc.binary_length(new).to_numpy() + len(prefix))
        last = np.searchsorted(np.cumsum(self.widths[flat]), bytes_before, side="right")
        ends = np.concatenate([[0], last]).astype(np.int64) * flat.itemsize
        return order, new, pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(flat)])

    def _ids(self, words: pa.Array, prefix: str) -> pa.Array:
        """The bytes of the ids of each distinct piece prefix + word."""
        which = 1 if prefix else 0
        at = pc.index_in(words, self.memo[which][0])
        if at.null_count:
            new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            order, *found = self._encode_new(words.take(pa.array(new)), prefix)
            number = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            number[new[order]] = len(self.memo[which][0]) + np.arange(len(new))
            self.memo[which] = tuple(pa.concat_arrays(x) for x in zip(self.memo[which], found, strict=True))
            at = pa.array(number)
        return self.memo[which][1].take(at)

    def _later(self, words: pa.Array) -> pa.Array:
        """The same for words after a space. Closing punctuation starts a pre-token after a letter or digit, so such words are put together from a stem and that."""
        stems = pc.utf8_rtrim(words, _CLOSING)
        closes = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, r"[\pL\pN]$"))
        coded = pc.if_else(closes, stems, words).dictionary_encode()
        ids = self._ids(coded.dictionary, " ").take(coded.indices)
        at = np.flatnonzero(closes.to_numpy(zero_copy_only=False))
        if not len(at):
            return ids
        tails = pc.replace_substring_regex(words.take(pa.array(at)), r"(?s)^.*[\pL\pN]", "").dictionary_encode()
        number = np.full(len(words), len(tails.dictionary), np.int64)
        number[at] = tails.indices.to_numpy()
        ends = pa.concat_arrays([self._ids(tails.dictionary, ""), pa.array([b""], pa.large_binary())])
        return pc.binary_join_element_wise(ids, ends.take(pa.array(number)), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]; a null text has none."""
        if sum(x.nbytes for memo in self.memo for x in memo) > MEMO:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), texts, pa.scalar("", pa.large_string())) if odd.any() else texts
        words = pc.split_pattern(plain, " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        firsts, where = np.unique(code[starts[:-1]], return_inverse=True)
        code[starts[:-1]] = len(coded.dictionary) + where
        known = [self._later(coded.dictionary), self._ids(coded.dictionary.take(pa.array(firsts)), "")]
        if odd.any():  # such a text stands as one empty piece so far, its own are put in that one's place
            cuts = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            more = pa.array([p for cut in cuts for p in cut], pa.large_string()).dictionary_encode()
            counts = np.diff(starts)
            counts[odd] = [len(cut) for cut in cuts]
            own, before = np.repeat(odd, counts), np.repeat(odd, np.diff(starts))
            spread = np.zeros(len(own), np.int64)
            spread[own] = more.indices.to_numpy() + sum(map(len, known))
            spread[~own] = code[~before]
            known.append(self._ids(more.dictionary, ""))
            code, starts = spread, np.concatenate([[0], np.cumsum(counts)])
        found = pa.concat_arrays(known).take(pa.array(code))
        _, ends, data = found.buffers()
        offsets = np.frombuffer(ends, np.int64)[starts] // 4
        return offsets, np.frombuffer(data, np.uint32)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = path or ""
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]
