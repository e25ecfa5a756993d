"""SentencePiece encoding and decoding over a trie of marked words.

Text is marked as the model does it (a leading mark, blanks as marks) and cut before each run of marks, and
around line feeds; no piece crosses such a cut, so words are encoded alone. A task's distinct words are
sorted and walked as a trie, depth first: the forward state of a prefix is kept on the path and all words that
share the prefix reuse it.

The model at hand is of the merging kind, where the path with the best sum of scores is not what the
library returns. The forward state is therefore its exact counterpart: a prefix's state is the last piece of its
encoding, and a piece may follow another only if the two, written together, are merged into just these
two. For every prefix exactly one predecessor fits, so the forward pass gives the library's ids. Characters
outside the vocabulary become their bytes. What two pieces written together become is asked of the merge rule
once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import arrow_mapped, slices

MARK = "▁"
#: Bytes of text that are cut at once: a word takes some twenty times its bytes as a Python text.
SLICE = 1 << 20
#: Bounds of what is remembered, some 130 MB in all: pairs of pieces by a worker; words and their characters by a task.
MEMORY, WORDS, CHARACTERS = 400_000, 250_000, 4_000_000


class TrieEncoder:
    """Ids of marked words."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        n = m.get_piece_size()
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.ids = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        # pieces that merging reaches from their characters
        self.reached = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.same = {p: p for p in self.reached}
        # ends of such pieces; True for whole ones
        self.ends = {p[i:]: False for p in self.reached for i in range(len(p))} | dict.fromkeys(self.reached, True)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            # the vocabulary's own texts are kept, not cuttings of words
            key = (self.same.get(left, left), self.same.get(right, right))
            known = self.fits[key] = self.merge(left + right) == [left, right]
        return known

    def encode(self, words: list[str], flat: array) -> list[int]:
        """Append the ids of sorted distinct words to flat and give their number for each; shared prefixes are worked out once.

        Blanks in words are marks.
        """
        sizes = []
        find = self.ids.get
        # state[d]: the last piece of the encoding of the current path's first d characters
        state: list[str] = [""]
        path, end_of, fits, follows = "", self.ends.get, self.fits.get, self.follows
        for word in words:
            word = word.replace(" ", MARK)
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                a = d - 1
                piece = word[a:d]
                while True:
                    if not a:
                        state.append(piece)
                        break
                    before = state[a]
                    fit = fits((before, piece))
                    if fit or (fit is None and follows(before, piece)):
                        state.append(piece)
                        break
                    # the next longer piece that may be the last one; a character alone always may
                    known = False
                    while not known and known is not None and a:
                        a -= 1
                        piece = word[a:d]
                        known = end_of(piece)
                    if not known:
                        state.append(self.merge(word[:d])[-1])  # no chain of pieces fits; the merge rule itself decides
                        break
            path, pieces, d = word, [], len(word)
            while d:
                pieces.append(state[d])
                d -= len(state[d])
            before = len(flat)
            for piece in reversed(pieces):
                i = find(piece)
                if i is None:
                    flat.extend([self.bytes[x] for x in piece.encode("utf-8", "surrogatepass")])
                else:
                    flat.append(i)
            sizes.append(len(flat) - before)
        return sizes

    def cut(self, text: str) -> list[str]:
        """Words with blanks for marks, which take a byte a character where a mark would make it two."""
        return _CUT.findall(" " + text.replace(MARK, " ")) if text else []


_CUT = re.compile("\n| +[^ \n]*|[^ \n]+")


class _Memory:
    """Ids of words that a task has seen before; the half of them that is used least is forgotten when there are too many."""

    def __init__(self, path: str):
        self.coder = TrieEncoder(path)
        self.decoder = Decoder(self.coder.model)
        self.clear()

    def clear(self) -> None:
        """Nothing is known; a worker that waits for tasks holds no words."""
        self.known, self.characters = {}, 0
        # ids of all known words one after the other, and where each word's lie
        self.flat, self.start, self.size = array("i"), array("q"), array("q")
        self.uses = np.zeros(0, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """The place in start and size of each word."""
        if len(self.known) > WORDS or self.characters > CHARACTERS:
            self.forget()
        new = sorted(set(words).difference(self.known))
        at = len(self.flat)
        for w, n in zip(new, self.coder.encode(new, self.flat), strict=True):
            self.known[w] = len(self.size)
            self.start.append(at)
            self.size.append(n)
            self.characters += len(w)
            at += n
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        uses = np.bincount(codes, minlength=len(self.size))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return codes

    def forget(self) -> None:
        # a place is also the word's rank in known
        places = np.sort(np.argsort(self.uses, kind="stable")[len(self.known) // 2 + 1 :])
        kept = list(compress(self.known, np.isin(np.arange(len(self.known)), places, assume_unique=True).tolist()))
        self.uses = self.uses[places] // 2
        old, start, places = self.flat, self.start, places.tolist()
        self.size = array("q", [self.size[i] for i in places])
        self.flat, self.start = array("i"), array("q")
        for i, n in zip(places, self.size, strict=True):
            self.start.append(len(self.flat))
            self.flat.extend(old[start[i] : start[i] + n])
        self.known = {w: i for i, w in enumerate(kept)}
        self.characters = sum(map(len, kept))


_MEMORY: dict[str, _Memory] = {}


class Decoder:
    """Texts of runs of ids. Pieces are joined; the library is asked for runs with bytes, unknown or control pieces only."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        n = model.get_piece_size()
        self.pieces = pa.array([model.id_to_piece(i).replace(MARK, " ") for i in range(n)], pa.string())
        self.odd = np.array([model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)], bool)

    def texts(self, edges: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Run i goes from edges[i] to edges[i + 1]; one blank at a run's start is the leading mark."""
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), self.pieces.take(pa.array(ids)))
        joined = pc.binary_join(lists, "")
        joined = pc.if_else(pc.starts_with(joined, " "), pc.utf8_slice_codeunits(joined, 1), joined)
        seen = np.concatenate([[0], np.cumsum(self.odd[ids])])
        asked = np.flatnonzero(seen[edges[1:]] > seen[edges[:-1]])
        if len(asked):
            mask = np.zeros(len(joined), bool)
            mask[asked] = True
            said = [self.model.decode(ids[edges[i] : edges[i + 1]].tolist()) for i in asked]
            joined = pc.replace_with_mask(joined, pa.array(mask), pa.array(said, pa.string()))
        return joined


def known_model(path: str) -> None:
    """Refuse models whose ids this does not give: only merging ones without a normaliser, with leading mark and bytes."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    train, norm = model.trainer_spec, model.normalizer_spec
    merging = train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if not merging or not plain or any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError(f"{path}: not a merging model with byte fallback and the identity as normaliser")


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _MEMORY.get(path) or _MEMORY.setdefault(path, _Memory(path))
        coder, decoder = memory.coder, memory.decoder
        memory.clear()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cut = [coder.cut(x or "") for x in part.column("text").to_pylist()]
                counts = np.array([len(x) for x in cut], np.int64)
                codes = memory.of([w for x in cut for w in x])
                del cut
                pool, start = (np.frombuffer(x, k) if len(x) else np.zeros(0, k) for x, k in ((memory.flat, np.int32), (memory.start, np.int64)))
                n = np.frombuffer(memory.size, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(n)])
                # position of each token in the pool of ids of distinct words
                where = np.arange(total[-1]) - np.repeat(total[:-1] - start[codes], n)
                edges = total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                ids = pool[where]
                del pool, start  # the memory's arrays can grow again
                back = decoder.texts(edges, ids)
                same = pc.equal(back, pc.fill_null(part.column("text").cast(pa.string()), ""))
                digest = [hashlib.sha256(x).hexdigest() for x in back.cast(pa.binary()).to_pylist()]
                tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(edges).astype(np.int64)), tokens, same, pa.array(digest, pa.string())],
                    ["doc_id", "n_tokens", "token_ids", "round_trip", "decoded_sha256"],
                )
        memory.clear()

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip, decoded_sha256) of every row of docs(doc_id, text).

    path is a SentencePiece model file on every machine, of the kind that known_model() takes. token_ids are the library's ids without begin and end. Each row's ids
    are decoded again: round_trip tells whether that gives the text, decoded_sha256 is its digest. Null counts as empty and
    has no tokens; repeated rows and null ids are returned as they come; very long texts and words are read whole; other columns are
    ignored; an empty table gives no rows.
    """
    known_model(path)
    return arrow_mapped(docs.select("doc_id", "text"), _encoded(path), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean, decoded_sha256 string")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sentencepiece.SentencePieceProcessor(model_file=path))
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column("token_ids")), 0).to_numpy(zero_copy_only=False)
            ids = b.column("token_ids").flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), decoder.texts(edges, ids)], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of encoded(doc_id, token_ids); null and empty lists give an empty text, an empty table no rows."""
    return arrow_mapped(encoded.select("doc_id", "token_ids"), _decoded(path), "doc_id long, text string")
