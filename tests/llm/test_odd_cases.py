"""Every operator on nulls, empty, long and repeated texts, clashing columns and empty tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm import exact_dedup, fingerprints, line_dedup, lm_scoring, mixing, near_dedup, queries, sentencepiece_codec, sharding, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(odd, k, percent):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_components(rows, k, percent)
    got = near_dedup.near_duplicates(odd, k, percent).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((d, len(shingles(t, k))) for d, t in rows), key=str)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_sketches_fill_every_bin():
    import numpy as np

    s = near_dedup.sketches([np.array([7], np.uint64), np.arange(1000, dtype=np.uint64), np.zeros(0, np.uint64)])
    assert (s[:2] != near_dedup._FULL).all() and (s[2] == near_dedup._FULL).all()
    a = np.arange(3000, dtype=np.uint64)
    x = near_dedup.sketches([a[:2000], a[1000:]])
    assert abs((x[0] == x[1]).mean() - 1 / 3) < 0.15


def test_exact_duplicates(odd):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in odd.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    want = sorted(((d, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=str)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_long_equal_texts_are_one(spark):
    long = "word " * 20000
    df = spark.createDataFrame([(i, long + ("x" if i == 2 else "")) for i in range(4)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(df).collect()} == {(0, 0), (1, 0), (2, 2), (3, 0)}


def test_fingerprints(odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        n = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - n] + rows[i - 1][1][:n]).encode()).hexdigest()))
    got = fingerprints.fingerprints(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert all(r.near_edited == 1 for r in got if r.n_chars < 2)


def test_next_rows_cross_windows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "WINDOW_ROWS", 7)
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "text").collect()}
    assert got == {i * i: f"t{(i - 1) % 100}" for i in range(100)}


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    sizes = {(r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect()}
    assert {(r.doc_id, r["size"]) for r in got} == sizes and len(got) == odd.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source_size] = [by[r.source_size][0] + r.taken, r.target, r.source_size]
    assert all(abs(t - g) <= 2 * mixing.BLOCK for t, g, _ in by.values())


def test_targets_stop_at_three_times_the_size(spark):
    df = spark.createDataFrame([("a", 90), ("b", 5), ("c", 5), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {"a": 70.0, "b": 15.0, "c": 15.0, None: 0.0}


def test_mixed_documents_hold_what_is_taken(odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(v == 0 or k in got for k, v in want.items())


def test_token_counts(odd):
    path = queries.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()), key=str)
    got = token_counts.token_counts(odd, path).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_token_counts_equal_the_library_on_all_documents(spark, sf_dir):
    path = queries.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == want


def test_sentencepiece_round_trip(odd, spark, sf_dir):
    path = queries.tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = sorted(((r.doc_id, lib.encode(r.text or "")) for r in docs.collect()), key=str)
        enc = sentencepiece_codec.encode(docs, path)
        got = enc.collect()
        assert sorted(((r.doc_id, list(r.token_ids)) for r in got), key=str) == want
        assert all(r.n_tokens == len(r.token_ids) for r in got)
        back = sorted(((r.doc_id, r.text) for r in sentencepiece_codec.decode(enc, path).collect()), key=str)
        texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
        assert [b for b in back if "▁" not in b[1] and b[1] != " mark"] == [t for t in texts if "▁" not in t[1]] or docs is odd


def test_sharding(odd):
    got = sharding.shards(odd, 16).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    import numpy as np

    keys = np.arange(-50, 3000, 7).astype(np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys.view(np.uint64), n).tolist() == [jump(int(k) % 2**64, n) for k in keys]


def test_toxicity_runs_on_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_line_dedup(spark):
    page = "<html><head><style>x</style><!-- n --></head><body><p>{}</p><div>Menu  of<br>site</div></body></html>"
    rows = [(i, f"http://u@A.example:80/{i}", page.format(f"own {i}")) for i in range(6)] + [(9, "https://b.example/", page.format("lone")), (10, None, None), (11, "x", "")]
    rows.append(rows[0])
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {(i, "a.example", 3, 2, f"own {i}") for i in range(6)} | {(9, "b.example", 3, 0, "lone\nMenu of\nsite"), (10, "", 0, 0, ""), (11, "", 0, 0, "")}
    assert got == want


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        near_dedup.near_duplicates(none),
        near_dedup.drop_near_duplicates(none),
        toxicity.toxicity(none, labels),
        toxicity.drop_toxic(none, labels),
        fingerprints.fingerprints(none),
        lm_scoring.score_texts(none),
        mixing.mix(none),
        mixing.mixed_documents(none),
        token_counts.token_counts(none, queries.tokenizer("byte_bpe_50k.json")),
        line_dedup.drop_boilerplate(pages),
        sentencepiece_codec.encode(none, queries.tokenizer("piece_bpe_32k.model")),
        exact_dedup.exact_duplicates(none),
        exact_dedup.drop_exact_duplicates(none),
        sharding.shards(none),
    ):
        assert df.count() == 0


def test_small_hosts_are_spared_unless_asked(spark):
    rows = [(i, f"http://h{i // 3}.example/{i}", f"<p>menu</p><p>own {i}</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    # hosts of three pages: below MIN_PAGES all lines stay
    assert {r.n_dropped for r in line_dedup.drop_boilerplate(pages).collect()} == {0}
    assert {(r.n_dropped, r.text[:3]) for r in line_dedup.drop_boilerplate(pages, ratio=0.4, min_pages=3).collect()} == {(1, "own")}
    # a lone page holds each of its lines on all pages of its host
    assert {r.text for r in line_dedup.drop_boilerplate(pages.where("page_id in (0, 3)"), min_pages=1).collect()} == {""}


def test_long_broken_pages_take_seconds(spark):
    import time

    n = 1_200_000
    pages = ["<!-- a " * (n // 6), "<script <script <script " * (n // 20) + "</script>", "<script>" * (n // 8), "<" * n, "<p " * (n // 3), "</p" * (n // 3), "x" * n + "<style>" * 1000, "<b" * (n // 2) + "<p>", "<" * n + "<br>", "<script>x</script>" * (n // 18)]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", t * 4) for i, t in enumerate(pages)], "page_id long, url string, html string").repartition(len(pages))
    began = time.time()
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(df).select("page_id", "n_lines").collect()}
    assert time.time() - began < 90 and len(got) == len(pages)
    assert got[9].n_lines == 0 and got[0].n_lines == 1


def test_hidden_parts(spark, duck):
    pages = ["<SCRIPT a='1'>x</Script >y</script>z", "a<!-- <script> -->b<script>c", "<style>q</style><style>r", "<!-- never", "x <!-- a -- > b --> c <!-- d", "a < b > c", "p<q", "\uffff<\uffffscript>k</script>", "<br/>one<br />two<BR>three</p\n>four", "<script><!-- </script> --> after", "tail <p"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in line_dedup.drop_boilerplate(df, min_pages=99).collect()}
    assert got == {0: "z", 1: "a\nbc", 2: "r", 3: "<!-- never", 4: got[4], 5: "a c", 6: "p<q", 7: "", 8: "one\ntwo\nthree\nfour", 9: "--> after", 10: "tail <p"}
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [(i, None, t) for i, t in enumerate(pages)])
    sql = queries.oracle_sql()["op7_line_dedup"].replace(f">= {line_dedup.MIN_PAGES})", ">= 99)")
    assert {r[0]: r[1] for r in con.execute(f"select page_id, text from ({sql})").fetchall()} == got
