"""Token counts of a byte-level BPE with the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone by the library; those that come back as
their own single token are proven whole, once for each Python worker. A pre-token among them counts one without merging. Only
the other pre-tokens go through the library's merges, each distinct one once (the memory of results is bounded and its older
half forgotten when full, which costs time but no result). The pre-token rule is read from the vocabulary's file; files
with another rule than the one known here are refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from .common import arrow_mapped, slices

#: The pre-token pattern of byte-level vocabularies that name none of their own; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a worker remembers: pre-tokens and their characters.
MEMORY, CHARACTERS = 400_000, 16_000_000
LIMIT = 512


def whole_tokens(path: str) -> set[str]:
    """Vocabulary strings, as text, that the library encodes alone as their one token."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts, ids = [], []
    for name, i in t.get_vocab(with_added_tokens=False).items():
        text = t.decode([i], skip_special_tokens=False)
        if text and "�" not in text:
            texts.append(text)
            ids.append(i)
    found = t.encode_batch(texts, add_special_tokens=False)
    return {x for x, i, e in zip(texts, ids, found, strict=True) if e.ids == [i]}


def known_rule(path: str) -> bool:
    """Whether a vocabulary's texts are cut by PATTERN alone: byte level, no prefix blank, nothing normalized."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class _Counts(dict):
    """Number of tokens of a pre-token; 1 for proven ones, else merged on first sight."""

    def __init__(self, tokenizer: Tokenizer, whole: set[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.proven, self.size = tokenizer, len(self), 0

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self.size += len(piece)
        if len(self) - self.proven > MEMORY or self.size > CHARACTERS:
            added = list(self)[self.proven :]
            for x in added[: len(added) // 2 + 1]:
                self.size -= len(x)
                del self[x]
        self[piece] = n
        return n


class _Counter:
    """Counts the tokens of texts; special strings inside them are one token each."""

    def __init__(self, path: str):
        if not known_rule(path):
            raise ValueError(f"the pre-token rule of {path} is not known")
        tokenizer = Tokenizer.from_file(path)
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.at = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        inner = Tokenizer.from_file(path)
        inner.encode_special_tokens = True
        # pieces come cut already, so the inner tokenizer must not cut them again
        inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find, self.get = regex.compile(PATTERN).findall, _Counts(inner, whole_tokens(path)).__getitem__

    def __call__(self, text: str) -> int:
        if self.at is None or not self.at.search(text):
            return sum(map(self.get, self.find(text)))
        return len(self.at.findall(text)) + sum(sum(map(self.get, self.find(x))) for x in self.at.split(text))


_COUNTERS: dict[str, _Counter] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _COUNTERS.get(path) or _COUNTERS.setdefault(path, _Counter(path))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = np.fromiter((count(x) for x in texts), np.int64, len(texts))
                size = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > LIMIT)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text).

    path is a byte-level BPE file on every machine. Null and empty texts have 0 bytes and 0 tokens; special
    strings inside a text count as the one special token, as the library does by default; repeated rows and
    null ids are returned as they come; very long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    return arrow_mapped(docs.select("doc_id", "text"), _counted(path), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
