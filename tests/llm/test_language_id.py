"""Language identification against plain sums over runs of letters, on odd rows, and by held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import language_id as li
from estatelens.llm import queries
from estatelens.llm.toxicity import remainder

TEXTS = ["Der Hund, die Katze!", "", None, " 12 \n?", "é", "a", "日本語のテキスト 漢字", "ÀÉ Straße İ ǅ 𐐷𐐏", "x" * 50, "the  the\tthe--the", "ß", "<b>one</b> two three " * 40, "\x00a\x00"]


def plain(text):
    """The bundle of one text, run by run."""
    letters = [c.lower() if len(c.lower()) == 1 else c for c in "".join(c if c.isalpha() else " " for c in text or "")]
    text = " " + " ".join("".join(letters).split()) + " " if "".join(letters).strip() else " "
    out = np.zeros(li.DIMENSIONS)
    one = {c: li.vectors(np.array([(ord(c) << 42) | (ord(c) << 21) | ord(c)]))[0] for c in set(text)}
    assert all(set(v.tolist()) <= {-1, 1} for v in one.values())
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        out += li.vectors(np.array([(ord(a) << 42) | (ord(b) << 21) | ord(c)]))[0]
    return out


def bundled(texts):
    return np.concatenate([x for _, x in li.bundles(texts)])


def test_bundles_equal_plain_sums():
    assert (bundled(TEXTS) == np.array([plain(t) for t in TEXTS])).all()


@pytest.mark.parametrize(("name", "value"), [("CELLS", 40), ("BOUND", 3), ("DENSE", 1), ("PIECE", 7), ("BLOCK", 2)])
def test_bundles_do_not_depend_on_how_texts_are_cut(monkeypatch, name, value):
    want = bundled(TEXTS)
    monkeypatch.setattr(li, name, value)
    assert (bundled(TEXTS) == want).all()


def test_binding_turns_and_multiplies():
    letter = li.vectors(np.array([(c << 42) | (c << 21) | c for c in (97, 98, 99)]))
    a, b, c = (np.sign(x) for x in letter)
    # the vector of one letter: that of its triple run, unbound by brute force over its own turns
    assert abs(a @ b) < 200 and abs(b @ c) < 200
    ab, ba = li.vectors(np.array([(97 << 42) | (98 << 21) | 32, (98 << 42) | (97 << 21) | 32]))
    assert abs(ab.astype(int) @ ba.astype(int)) < 200


def learnt(docs):
    rest = remainder("doc_id", 3)
    return li.languages(docs, rest != 1, F.coalesce(rest == 1, F.lit(False)))


def test_odd_rows(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "de" if i % 2 else None, *[None] * 11) for i, t in enumerate(TEXTS)], odd.schema))
    got = learnt(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.lang_pred, r.score) for r in got}
    assert len({x[0] for x in by}) >= 30 and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    held = {r.doc_id: r.held_out for r in got}
    import zlib

    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 3 == 1) for k, v in held.items())
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    blank = {d for d, t in texts if not any(c.isalpha() for c in t or "")}
    mixed = {d for d, t in texts if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} <= blank and {r.doc_id for r in got if r.lang_pred != "und"} <= mixed


def test_nothing_learnt_and_empty(spark, none):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    assert {tuple(r) for r in li.languages(docs, F.lit(True), F.lit(False)).collect()} == {(i, False, "und", 0.0) for i in (1, 2, 3)}
    assert learnt(none).count() == 0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        li.fit(docs, F.lit(True))


def test_held_out_accuracy_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op12_language_id(spark, sf_dir).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d, r in got.items() if r[0]]
    assert sum(got[d][1] == true[d] for d in held) >= 0.97 * len(held)
    again = learnt(docs.repartition(5, F.rand(3)))
    assert {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in again.collect()} == got


def test_scores_follow_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    usable = F.crc32(F.col("text").cast("binary")) % 3 != 1
    same = li.languages(docs, usable, F.lit(False)).drop("held_out")
    other = docs.withColumn("doc_id", 10**9 - F.col("doc_id") * 64).withColumn("source", F.lit("x"))
    moved = li.languages(other, usable, F.lit(False)).select(((10**9 - F.col("doc_id")) / 64).cast("long").alias("doc_id"), "lang_pred", "score")
    assert sorted(same.collect()) == sorted(moved.collect())


def test_short_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = li.fit(docs, remainder("doc_id", 3) != 1)
    rng, right, n = random.Random(1), 0, 0
    for r in docs.where(remainder("doc_id", 3) == 1).collect():
        words = (r.text or "").split()
        if len(words) > 20:
            at = rng.randrange(len(words) - 12)
            right += li.judged([" ".join(words[at : at + 12])], profiles)[0][0] == r.lang
            n += 1
    assert right >= 0.9 * n
