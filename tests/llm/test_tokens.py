"""What the token operators remember, refuse and give back."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
import sentencepiece
from tokenizers import Tokenizer

from estatelens.llm import queries, sentencepiece_codec, token_counts

MODEL, VOCABULARY = "piece_bpe_32k.model", "byte_bpe_50k.json"


def test_whole_documents_are_decoded(odd):
    path = queries.tokenizer(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_codec.encode(odd, path).join(odd.select("doc_id", "text"), "doc_id").collect():
        if r.n_tokens == len(lib.encode(r.text or "")) and list(r.token_ids) == lib.encode(r.text or ""):
            back = lib.decode(list(r.token_ids))
            assert r.round_trip == (back == (r.text or "")) and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_null_and_empty_ids_give_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (None, []), (2, [5, 6])], "doc_id long, token_ids array<int>")
    path = queries.tokenizer(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {(r.doc_id, r.text) for r in sentencepiece_codec.decode(df, path).collect()} == {(1, ""), (None, ""), (2, lib.decode([5, 6]))}


def test_forgotten_words_are_worked_out_again(monkeypatch):
    path = queries.tokenizer(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 5)
    memory = sentencepiece_codec._Memory(path)
    words = [f"▁word{i % 13}{'x' * (i % 7)}" for i in range(200)]
    for at in range(0, 200, 9):
        part = words[at : at + 9]
        places = memory.of(part)
        got = [list(memory.flat[memory.start[i] : memory.start[i] + memory.size[i]]) for i in places]
        assert got == [lib.encode(w.replace("▁", " ").strip()) for w in part]
        assert len(memory.known) <= 16 and memory.characters == sum(map(len, memory.known))


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 50)
    memory = sentencepiece_codec._Memory(queries.tokenizer(MODEL))
    for i in range(20):
        memory.of([" often", " again"] * 3 + [f" once{i}x{k}" for k in range(20)])
        assert {" often", " again"} <= set(memory.known) and len(memory.uses) == len(memory.size) == len(memory.known)


_PEAK = """
import pyarrow as pa
from estatelens.llm import queries, sentencepiece_codec

def batches():
    for b in range(4):
        texts = [" ".join(f"wo{b}r{r}d{k}é" for k in range(400)) for r in range(500)]
        yield pa.record_batch([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])

def resident(key):
    return next(int(x.split()[1]) >> 10 for x in open("/proc/self/status") if x.startswith(key))

path = queries.tokenizer("piece_bpe_32k.model")
sentencepiece_codec._MEMORY[path] = sentencepiece_codec._Memory(path)
before = resident("VmRSS")
rows = sum(x.num_rows for x in sentencepiece_codec._encoded(path)(batches()))
print(rows, resident("VmHWM") - before)
"""


def test_a_worker_stays_small_over_many_distinct_words():
    """800,000 distinct words; two workers and a heap of 1,800 MB share 3,000 MB in an executor."""
    root = os.path.dirname(os.path.dirname(sentencepiece_codec.__file__.rpartition("/")[0]))
    said = subprocess.run([sys.executable, "-c", _PEAK], capture_output=True, text=True, check=True, cwd=root, timeout=300)
    rows, grown = map(int, said.stdout.split())
    assert rows == 2000 and grown < 220


def test_forgotten_pieces_are_merged_again(monkeypatch):
    path = queries.tokenizer(VOCABULARY)
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "MEMORY", 4)
    count = token_counts._Counter(path)
    for i in range(60):
        text = f"zqxj{i % 11}vvk plain qqzx{i % 5}w" * 3
        assert count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_other_rules_are_refused(tmp_path):
    with open(queries.tokenizer(VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    assert token_counts.known_rule(queries.tokenizer(VOCABULARY))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="rule"):
            token_counts._Counter(str(tmp_path / "v.json"))


def test_words_of_many_characters(spark):
    long = "".join(chr(97 + (i * 7919) % 26) for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, long + " " + long[:100])], "doc_id long, text string")
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(MODEL))
    assert {r.doc_id: list(r.token_ids) for r in sentencepiece_codec.encode(df, queries.tokenizer(MODEL)).collect()} == {r.doc_id: lib.encode(r.text) for r in df.collect()}
    tok = Tokenizer.from_file(queries.tokenizer(VOCABULARY))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, queries.tokenizer(VOCABULARY)).collect()} == {r.doc_id: len(tok.encode(r.text).ids) for r in df.collect()}


def test_joined_pieces_equal_the_library():
    import random

    import numpy as np

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(MODEL))
    decoder = sentencepiece_codec.Decoder(model)
    rng = random.Random(2)
    runs = [[rng.randrange(model.get_piece_size()) for _ in range(rng.randrange(6))] for _ in range(3000)]
    runs += [model.encode(t) for t in ("", " ", "  two", "▁ mark", "日本 語\n", "\x00 é", "a" * 9, "   ", "\n x")]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    assert decoder.texts(edges, np.array([i for r in runs for i in r], np.int32)).to_pylist() == [model.decode(r) for r in runs]


@pytest.mark.parametrize("change", [{"model_type": 1}, {"byte_fallback": False}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True}, {"precompiled_charsmap": b"x"}])
def test_other_models_are_refused(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.tokenizer(MODEL), "rb") as f:
        model.ParseFromString(f.read())
    for key, value in change.items():
        setattr(model.trainer_spec if hasattr(model.trainer_spec, key) else model.normalizer_spec, key, value)
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    sentencepiece_codec.known_model(queries.tokenizer(MODEL))
    with pytest.raises(ValueError, match="merging"):
        sentencepiece_codec.known_model(str(tmp_path / "m.model"))
