"""The pipeline against a plain version of every stage."""

import math
import re
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import sentencepiece
from test_odd_cases import WORD, brute_components

from estatelens.llm import mixing, queries, toxicity


def permuted(x, n, seed, back=False):
    p, a, b, c = mixing.PRIME, mixing.A, mixing.B, mixing.C
    for r in range(mixing.ROUNDS, 0, -1) if back else range(1, mixing.ROUNDS + 1):
        high = (r * a + seed * b + 12345) % p * c % p
        other = ((high * 2**31 + (high * a + r) % p) % n - x + n) % n
        top = max(x, other)
        low = (top % 2**31 % p * a + (top >> 31) * b + r * b + seed * c) % p
        x = other if (low * a % p * b % p >> 10) & 1 else x
    return x


def part(d):
    """The part of its source that an id lies in."""
    x = d % mixing.PRIME * mixing.A % mixing.PRIME
    x = (x ^ x >> 13) * mixing.B % mixing.PRIME
    return (x ^ x >> 11) % mixing.PARTS


def mixed(docs):
    """(doc_id, text) of the mix of {doc_id: (text, source)}."""
    size = {d: len(WORD.findall(t)) for d, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values() if s is not None}) + ([None] if any(s is None for _, s in docs.values()) else [])
    own = {s: sum(size[d] for d in docs if docs[d][1] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    free, target = set(sources), {}
    while True:
        left = sum(own.values()) - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 3 * own[s]}
        if not over:
            break
        target |= {s: 3 * own[s] for s in over}
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = []
    for number, s in enumerate(sources):
        blocks = -(-own[s] // mixing.BLOCK)
        times = defaultdict(int)  # of each place of the source
        left, q = math.floor(target[s] + 0.5), 0
        while left and own[s]:
            first = permuted(q % blocks, blocks, number + 1) * mixing.BLOCK
            n = min(left, mixing.BLOCK, own[s] - first)
            for i in range(first, first + n):
                times[i] += 1
            left, q = left - n, q + 1
        first = 0
        for d in sorted((d for d in docs if docs[d][1] == s), key=lambda d: (part(d), d)):
            words = WORD.findall(docs[d][0])
            if not words:
                out.append((d, docs[d][0]))
            taken = [times[first + i] for i in range(len(words))]
            for turn in range(1, max(taken, default=0) + 1):
                kept = [w for w, n in zip(words, taken, strict=True) if n >= turn]
                out.append((d, docs[d][0] if len(kept) == len(words) else " ".join(kept)))
            first += len(words)
    return out


def test_pipeline(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "source mixing", "sentencepiece"]
    docs = {r.doc_id: (r.text, r.source) for r in read("documents").collect()}
    model = toxicity.fit(read("documents"), read("labels"), toxicity.remainder("doc_id", 3) != 1)

    def toxic(text):
        n, found = toxicity.evidence(pa.array([text]), model)
        z = model.bias + model.slope * toxicity.significance(int(n[0]), found[0], model)
        return 1 / (1 + math.exp(-z)) >= 0.7

    docs = {d: x for d, x in docs.items() if not toxic(x[0])}
    seen = {}
    for d in sorted(docs):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[d][0]), d)
    docs = {d: docs[d] for d in seen.values()}
    root = brute_components([(d, t) for d, (t, _) in docs.items()], 5, 80)
    docs = {d: x for d, x in docs.items() if root[d] == d}
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = sorted((d, lib.encode(t)) for d, t in mixed(docs))
    got = sorted((r.doc_id, list(r.token_ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names
