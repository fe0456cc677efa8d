"""Token ids of texts for a fixed context, with ways to shorten long texts. The vocabulary is a file of the tokenizers library whose path is a parameter.

What is drawn by lot follows from a seed and the text, so every run and partitioning gives the same ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytewords import Encoder

CONTEXT = 77
#: Bytes of texts that are encoded at once; the tokenizers library's result takes some 40 times that.
CHUNK = 2_000_000
#: Words whose priority a task remembers.
MEMO = 200_000
REDUCTIONS = ("cut", "simple", "random", "shuffle", "syntax")


def fitted(ids: np.ndarray, room: int, reduction: str, seed: int) -> np.ndarray:
    """At most `room` ids: the first ones (cut), a block (simple), some in order (random) or in any order (shuffle)."""
    if len(ids) <= room or reduction in ("cut", "syntax"):
        return ids[:room]
    draw = np.random.default_rng(seed)
    if reduction == "simple":
        start = int(draw.integers(0, len(ids) - room + 1))
        return ids[start : start + room]
    chosen = draw.permutation(len(ids))[:room]
    return ids[chosen if reduction == "shuffle" else np.sort(chosen)]


def prioritised(words: list[str], room: int, priority: Callable[[str], int]) -> list[str]:
    """At most `room` words, the least priorities first and then the earlier ones, in their order."""
    if len(words) <= room:
        return words
    order = np.argsort(np.fromiter(map(priority, words), np.int64, len(words)), kind="stable")[:room]
    return [words[i] for i in np.sort(order).tolist()]


class _Known(dict):
    """What a function of words gives, remembered for MEMO words."""

    def __init__(self, function: Callable[[str], int]):
        self.function = function

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = self.function(word)
        return found


class _Coder:
    """Ids of whole texts. A byte-level vocabulary's words are encoded once and their ids copied (see bytewords); texts that hold an added token, and other vocabularies, go through the library."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        own = json.loads(self.library.to_str())
        split, model = own["pre_tokenizer"] or {}, own["model"]
        plain = not (own["normalizer"] or own["truncation"] or own["padding"]) and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.words = Encoder(vocabulary) if plain and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] else None
        self.added = [x["content"] for x in own["added_tokens"]]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        aside = [self.words is None or any(a in t for a in self.added) for t in texts]
        odd = iter(self.library.encode_batch_fast([t for t, x in zip(texts, aside, strict=True) if x], add_special_tokens=False) if any(aside) else ())
        if not all(aside):
            offsets, ids = self.words.encode(pa.array(["" if x else t for t, x in zip(texts, aside, strict=True)], pa.large_string()))
        for k, x in enumerate(aside):
            yield np.array(next(odd).ids, np.int64) if x else ids[offsets[k] : offsets[k + 1]]


_coders: dict[str, _Coder] = {}


def _coder(vocabulary: str) -> _Coder:
    """One a worker process and vocabulary; reading one takes a second."""
    if vocabulary not in _coders:
        _coders[vocabulary] = _Coder(vocabulary)
    return _coders[vocabulary]


def _slices(texts: pa.Array, most: int = CHUNK) -> Iterator[list[str]]:
    """The texts in lists of about `most` bytes at most (or one text); null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def reduced_ids(
    rows: DataFrame, vocabulary: str, start: int, end: int, outs: dict[str, str], text: str = "text", context: int = CONTEXT, pad: int = 0, seed: int = 0,
    priority: Callable[[str], int] = lambda word: 4,
) -> DataFrame:
    """rows with a column of ids for each reduction in outs (name: reduction), as token_ids gives them. Each text is read and encoded once for all reductions but "syntax", some texts at a time."""
    if bad := set(outs.values()) - set(REDUCTIONS):
        raise ValueError(f"no reduction {', '.join(sorted(bad))}")
    kinds = list(outs.values())

    @F.arrow_udf(f"struct<{', '.join(f'_{k}: array<int>' for k in range(len(kinds)))}>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded, rank = _coder(vocabulary), _Known(priority).__getitem__

        for part in parts:
            lines = np.full((len(kinds), len(part), context), pad, np.int32)

            def put(k: int, row: int, ids: np.ndarray) -> None:
                line, n = lines[k, row], len(ids)  # noqa: B023
                line[0], line[1 : n + 1], line[n + 1] = start, ids, end

            at = 0
            for texts in _slices(part):
                if any(kind != "syntax" for kind in kinds):
                    for row, (t, ids) in enumerate(zip(texts, coded(texts), strict=True), at):
                        lot = xxhash.xxh3_64_intdigest(t, seed=seed)
                        for k, kind in enumerate(kinds):
                            if kind != "syntax":
                                put(k, row, fitted(ids, context - 2, kind, lot))
                if "syntax" in kinds:
                    short = [" ".join(prioritised(t.split(), context - 2, rank)) for t in texts]
                    for row, ids in enumerate(coded(short), at):
                        for k, kind in enumerate(kinds):
                            if kind == "syntax":
                                put(k, row, fitted(ids, context - 2, kind, 0))
                at += len(texts)
            edges = pa.array(np.arange(0, (len(part) + 1) * context, context, dtype=np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, pa.array(x.ravel())) for x in lines], [f"_{k}" for k in range(len(kinds))])

    whole = rows.withColumn("_reduced", encode(F.col(text)))
    return whole.withColumns({name: F.col("_reduced")[f"_{k}"] for k, name in enumerate(outs)}).drop("_reduced")


def token_ids(
    rows: DataFrame, vocabulary: str, start: int, end: int, text: str = "text", out: str = "ids", context: int = CONTEXT, pad: int = 0, reduction: str = "cut", seed: int = 0,
    priority: Callable[[str], int] = lambda word: 4,
) -> DataFrame:
    """rows with out: start, the text's ids, end, padded to `context`. Texts that are too long are shortened by `reduction`; "syntax" leaves out words first (nouns 1, adjectives 2, verbs 3, others 4 by
    `priority`) and then cuts. Null texts are empty."""
    return reduced_ids(rows, vocabulary, start, end, {out: reduction}, text, context, pad, seed, priority)


def texts_of(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text", special: tuple[int, ...] = ()) -> DataFrame:
    """rows with out: the text of the ids without the special ones."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        coder, skip = Tokenizer.from_file(vocabulary), set(special)
        for part in parts:
            yield pd.Series([coder.decode([i for i in own if i not in skip], skip_special_tokens=False) for own in part])

    return rows.withColumn(out, decode(F.col(ids)))


def kept_patches(patches: DataFrame, key: str, patch: str, drop: float, seed: int = 0) -> DataFrame:
    """A share of 1 - drop of each key's patches (one at least), drawn by a seeded hash."""
    from pyspark.sql import Window

    by = Window.partitionBy(key)
    ranked = patches.withColumn("_rk", F.row_number().over(by.orderBy(F.xxhash64(F.lit(seed), key, patch), patch))).withColumn("_n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("_rk") <= F.greatest(F.lit(1), F.floor(F.col("_n") * (1 - drop)))).drop("_rk", "_n")
