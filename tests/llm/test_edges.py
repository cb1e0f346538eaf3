"""Each operator on nulls, empty and long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackmill.llm import bpe, components, decontaminate, langid, merkle, near, quality, repeats, secrets, simhash, topk, urls

WORDS = "the of and tion ere ing onth reat blend stone water light under paper glass river".split()
DOCS = "doc_id long, text string, lang string, t string, d long, key string, fp long, start int"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "en", "x", 5, "k", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = prose(1, 60_000)
TEXTS = [None, "", " ", "é", prose(2), prose(2), prose(3), LONG, "Of " * 300, "\n\n\t", "日本語😀"]


@pytest.fixture(scope="module")
def docs(spark):
    # a null key and a repeated row besides
    odd = spark.createDataFrame([(None, prose(4), None, None, None, None, None, None), (4, prose(2), "en", "x", 5, "k", 7, 1)], DOCS)
    return docs_of(spark, TEXTS).union(odd).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


TOKENS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_round_trip(spark, docs):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, TOKENS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0
    assert bpe.round_trip(docs, TOKENS, public_tokenizers.PATTERN).count() == docs.count()
    assert bpe.round_trip(empty(spark), TOKENS, public_tokenizers.PATTERN).collect() == []
    coded = bpe.encode(docs, TOKENS, public_tokenizers.PATTERN, offsets=True)
    for r in coded.filter("doc_id in (3, 10)").collect():
        text = TEXTS[r["doc_id"]]
        assert len(r["ids"]) == len(r["byte_starts"]) == len(r["char_starts"])
        assert [len(text.encode()[:b].decode("utf-8", "ignore")) for b in r["byte_starts"]] == r["char_starts"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, TOKENS).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    odd = spark.createDataFrame([(1, [-1, 72, None, len(TOKENS), 2**31 - 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, TOKENS).collect()} == {1: "\ufffd" + TOKENS[72].decode() + "\ufffd" * 3, 2: None, 3: ""}


def test_tokens_and_digests(spark, docs):
    rows = bpe.tokens_and_digests(docs, TOKENS, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    own = bpe.codec(TOKENS, public_tokenizers.PATTERN)
    for r in rows:
        if r["doc_id"] is not None:
            data = own.encode(TEXTS[r["doc_id"]] or "")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(r["ids"]), hashlib.sha256(data).hexdigest()) and r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.tokens_and_digests(empty(spark), TOKENS, public_tokenizers.PATTERN).collect() == []


def test_secrets(spark, docs):
    got = secrets.digests(docs)
    assert got.count() == docs.count() and got.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert secrets.digests(empty(spark)).collect() == []
    long = LONG + " token: abcdef123456 " + LONG
    twice = secrets.redact(docs_of(spark, [long, long])).collect()
    assert [r["text"] for r in twice] == [LONG + " [SECRET] " + LONG] * 2
    cleaned = secrets.redact(docs_of(spark, [None, "", "a token: abcdef123456 b", "x AKIA" + "Q7" * 8 + " y"]))
    assert [r["text"] for r in cleaned.orderBy("doc_id").collect()] == [None, "", "a [SECRET] b", "x [SECRET] y"]
    assert cleaned.columns == docs.columns


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(urls, "TERMS", 3)
    with pytest.raises(ValueError):
        urls.weights(urls.vocabulary(spark))


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme casino"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/5?q"), (6, "x://example.com/en/7a"), (7, "x://a.b#casino"), (8, "x://free.bets/"), (9, "x://free.free/"), (5, "HTTP://WWW.Example.COM/en/5?q")]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id int, url string, host string, verdict string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert [got[i]["verdict"] for i in range(1, 10)] == ["allow", "allow", "block", "allow", "block", "allow", "block", "block", "allow"]
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("www.example.com", "/en/5", "com/en/")
    assert (got[6]["rule"], got[3]["host"], got[3]["path"], got[1]["host"]) == ("example.com/en/7", "", "", "")
    own = spark.createDataFrame([("Scheme", 1), ("no", 1), ("", 5), (None, 5), ("free", None)], "term string, weight int")
    assert {r["page_id"]: (r["verdict"], r["weight"]) for r in urls.judge(pages, terms=own).filter("page_id in (1, 3, 8)").collect()} == {1: ("allow", 0), 3: ("block", 2), 8: ("allow", 0)}
    assert urls.judge(pages, terms=own.limit(0)).filter("weight != 0").count() == 0
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).collect() == []


def test_top_k(spark):
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0]), (20, []), (7, [0.3])]
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, block int, width int")
    got = topk.top_k(df, "vec_id % 20 = 0", 3).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in sorted(got)] == [(0, 1, 1, 5120), (0, 2, 2, 5120), (0, 3, 7, 1216), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0)]
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").collect() == [] and topk.top_k(df, "vec_id = 99").collect() == []
    assert len(topk.top_k(df, "vec_id = 0", 50).collect()) == 5  # fewer than k
    # exact up to 62 bits, where doubles would make ties; beyond it no order is made up
    large = [[1, 2**25], [2**30, 2**30], [2**30, 2**30 + 1], [2**30 + 1, 2**30], [-(2**30), 2**30], [2**30, 2**30], [0, 0]]
    huge = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in enumerate(large)] + [(None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for q in (1, 2):
        want = sorted((-sum(a * b for a, b in zip(large[q], v)), i) for i, v in enumerate(large) if i != q)
        assert [(r["vec_id"], -r["score"]) for r in topk.top_k(huge, f"vec_id = {q}").orderBy("rank").collect()] == [(i, s) for s, i in want]
    for beyond in ([1e30], [2.0**30]):
        with pytest.raises(Exception, match="62 bits"):
            topk.top_k(spark.createDataFrame([(0, beyond), (1, beyond)], "vec_id long, embedding array<double>"), "vec_id = 0").collect()


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    assert got[0]["fp"] == got[1]["fp"] == got[2]["fp"] == got[9]["fp"] == 0 and got[9]["component"] == 0
    assert got[5]["component"] == got[4]["component"] == 4
    assert simhash.groups(docs).count() == docs.count() and simhash.groups(empty(spark)).collect() == []
    kept = near.near_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (4, 5)").count() == 1
    assert sorted(r["doc_id"] for r in kept.filter("doc_id < 3 or doc_id = 9").collect()) == [0, 2, 9]  # white space differs, so three texts
    assert near.near_duplicates(empty(spark)).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)] + [(300, x) for x in range(301, 340)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[100] == 100 and got[339] == 300 and len(got) == 41 + 2 + 40
    assert components.components(edges.limit(0)).collect() == []


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, prose(2, 20), 1), (2, None, 1), (3, "short", 1), (4, prose(77, 40), 1), (1, prose(2, 20), 1)], "item_id long, text string, doc_id int")
    got = decontaminate.matches(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(4, 1), (4, 1), (5, 1)]
    assert decontaminate.matches(docs, items.limit(0)).collect() == [] and decontaminate.matches(empty(spark), items).collect() == []
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_repeats(spark, docs):
    got = {}
    for r in repeats.strip(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[0][0]["kept"] == b"" and got[0][0]["n_bytes"] == 0
    size = len(prose(2).encode())
    assert [r["n_removed"] for r in got[4] + got[5]] == [size] * 3
    assert got[8][0]["n_removed"] == 900 and got[6][0]["n_removed"] == 0 and got[None][0]["n_removed"] == 0
    assert repeats.strip(empty(spark)).collect() == []


def test_merkle(spark):
    url, payload = F.col("url"), F.col("html")
    rows = [(1, "a", "x"), (1, "a", "x"), (2, None, "y"), (3, "", "y"), (None, "n", None), (-5, "m", ""), (10**12, "z", "w")]
    make = lambda r: merkle.tree(spark.createDataFrame([(*x, 1, "q") for x in r], "page_id long, url string, html string, n int, digest string"), F.col("page_id"), merkle.warc_digest(url, payload))
    a = make(rows)
    assert merkle.audit(a, make(list(reversed(rows)))).collect() == []
    changed = [(1, "a", "x"), (2, "", "y"), (3, "", "y"), (None, "n", ""), (-5, "m", ""), (11, "new", "w")]
    got = {r["position"]: (r["state"], r["n_a"], r["n_b"]) for r in merkle.audit(a, make(changed)).collect()}
    assert got == {1: ("altered", 2, 1), 2: ("altered", 1, 1), None: ("altered", 1, 1), 10**12: ("missing", 1, 0), 11: ("extra", 0, 1)}
    none = make(rows[:0])
    assert merkle.audit(none, none).collect() == [] and len(merkle.audit(a, none).collect()) == 6


def test_classifiers(spark, docs):
    learn = F.lit(True)
    taught = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    model = langid.fit(taught, learn, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 9))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(empty(spark), learn, "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty(spark), model).collect() == []
    labels = spark.createDataFrame([(4, 1, "t"), (6, 1, "t"), (8, 0, "t"), (8, 0, "t"), (7, None, "t"), (None, 1, "t"), (3, 5, "t")], "doc_id long, quality int, text string")
    judge = quality.fit(docs, labels, learn)
    rows = {r["doc_id"]: r for r in quality.score(docs, judge).collect()}
    assert rows[0]["score"] == rows[1]["score"] == judge.prior and rows[4]["predicted"] == 1 and rows[8]["predicted"] == 0
    assert quality.fit(docs, labels.limit(0), learn) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(empty(spark), judge).collect() == []
    kept = quality.keep(docs, judge)
    assert kept.columns == docs.columns and quality.keep(empty(spark), judge).collect() == []
    fine = {i for i, r in rows.items() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in kept.collect()} == fine and quality.keep(docs, None).count() == docs.count()
