"""Language-model scores of running text, with contexts across words, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from test_odd_cases import words

from estatelens.llm import lm_scoring, queries


def stream(text):
    return (" " + "".join(w + " " for w in words(text)) + "\n").encode()


def brute_scores(rows):
    k, contexts = lm_scoring.ORDER, defaultdict(Counter)

    def before(b, i, o):
        return (bytes(k) + b[:i])[i + k - o :]

    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            b = stream(t)
            for i in range(1, len(b)):
                for o in range(k + 1):
                    contexts[before(b, i, o)][b[i]] += 1

    def length(b):
        total = 0.0
        for i in range(1, len(b)):
            out = set()
            for o in range(k, -1, -1):
                seen = contexts.get(before(b, i, o), {})
                left = {s: c for s, c in seen.items() if s not in out}
                all_ = sum(left.values())
                if b[i] in left:
                    total += math.log10((2 * left[b[i]] - 1) / 2 / all_)
                    break
                total += math.log10(len(left) / 2 / all_) if left else 0
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total

    return [(d, length(stream(t))) for d, t in rows]


@pytest.mark.parametrize("frequent", [500_000, 3])
def test_scores_of_running_text(odd, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT_KEYS", frequent)
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(lm_scoring, "GATHERED", 2 * frequent)
    want = sorted(((str(d), x) for d, x in brute_scores([(r.doc_id, r.text) for r in odd.collect()])))
    got = lm_scoring.score_texts(odd).collect()
    flat = sorted((str(r.doc_id), r.score) for r in got)
    assert [d for d, _ in flat] == [d for d, _ in want]
    assert [x for _, x in flat] == pytest.approx([x for _, x in want], abs=1e-6)
    tokens = [(r.doc_id, [*words(r.text), "\n"]) for r in odd.collect()]
    train = Counter(x for d, w in tokens if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for x in w)
    n, v = sum(train.values()), len(train)
    rest = sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(x in train for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 4)) for d, w in tokens)
    assert rest == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)


def test_the_model_beats_the_base_on_held_out_rows(spark):
    rows = lm_scoring.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert tokens > 20_000 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_order_of_words_matters(spark, tmp_path):
    fluent = "the cat sat on the mat and the dog ran to the door"
    docs = [(i, fluent) for i in range(30)] + [(100, fluent), (101, " ".join(sorted(fluent.split())))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[100] > got[101] + 1


def test_no_texts(none):
    assert lm_scoring.score_texts(none).count() == 0
