"""The divergence audit against a plain version, on odd rows, ties, many sources and small chunks."""

import random
import re
from collections import Counter, defaultdict

import pytest

from estatelens.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """rows of (text, lang, source)."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted(w for w, n in held[lang].items() if n >= 30)
        others = sorted(s for la, s in groups if la == lang)

        def share(counters):
            n = {w: sum(c[w] for c in counters) for w in kept}
            total = sum(n.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (n[w] + 5) // total for w in kept}

        p, q = share([count[lang, source]]), share([count[lang, s] for s in others])
        pairs = []
        for s in others:
            if s != source:
                r = share([count[lang, s]])
                pairs.append((-sum(abs(p[w] - r[w]) for w in kept), s.encode(), s))
        terms = sorted((q[w] - p[w], w.encode(), w) for w in kept if count[lang, source][w] and p[w] > q[w])
        for part, found in (("pair", sorted(pairs)), ("term", terms[:50])):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in sd.divergence(df).collect())


def corpus():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "Zé", "日", "q", "𐐷x", "ÀB") for b in ("", "n", "nn", "é", "ü", "ｚ", "zz", "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m")]
    rows = []
    for i in range(400):
        n = rng.choice([0, 1, 3, 40, 80])
        text = " ".join(rng.choice(words[: 20 + 5 * (i % 20)]) for _ in range(n)) + rng.choice(["", "1 2", "\x00_", "x9y"])
        rows.append((text, rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src1", "Src2", "ß", "", None])))
    return rows + [(None, "en", "silent"), ("", "xx", None), ("tie " * 3, "xx", "a"), (None, None, "only")] + [("rare alike", "yy", s) for s in "ab" for _ in range(20)]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_equals_the_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame([(i, t, la, s, i, "x") for i, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, `a.b` string")
    got = rows_of(df.repartition(3))
    assert got == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_odd_rows_long_texts_and_repeats(spark, odd):
    assert rows_of(odd) == brute([(r.text, r.lang, r.source) for r in odd.collect()])
    long = [("word " * 300_000 + "x" * 400_000, "en", "a"), ("word " * 30, "en", "b")] * 20
    assert rows_of(spark.createDataFrame(long, "text string, lang string, source string")) == brute(long)


def test_a_long_term_of_many_documents_is_kept(spark):
    rows = [("é" * 100_000 + f" n{i}", "en", "ab"[i % 2]) for i in range(40)]
    assert rows_of(spark.createDataFrame(rows, "text string, lang string, source string")) == brute(rows)


def test_empty_table(none):
    assert sd.divergence(none).count() == 0


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    c, t = np.array([0, 1, 5, 10**15, 8 * 10**15, 123456789012345]), np.array([5, 3, 7, 3 * 10**15 + 1, 8 * 10**15 + 3, 987654321098765])
    assert sd.shares(c, t).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(c, t, strict=True)]
