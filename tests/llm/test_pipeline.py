"""The pipeline's stages on planted cases, and its run over the smallest tables."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from trackmill.llm import near

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and tion ere ing onth reat blend stone water light under paper glass river orange window".split()


def prose(r, n):
    return [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts, least=0.8):
    """The first text of each group, by all pairs: equal texts, and those whose sets of shingles are alike."""
    sets = [frozenset(shingles(t)) if t.split() else None for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        near = Counter(j for x in s or () for j in held.get(x, ()))
        same = [j for j, n in near.items() if n >= least * (len(s) + len(sets[j]) - n) - 1e-9]
        for j in same + [j for j in range(i) if s is None and texts[j] == texts[i]]:
            a, b = sorted((find(i), find(j)))
            root[b] = a
        for x in s or ():
            held.setdefault(x, []).append(i)
    return {find(i) for i in range(len(texts))}


def kept(spark, texts):
    return {x["doc_id"] for x in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(7)
    texts = []
    for _ in range(25):
        base = prose(r, r.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    texts += ["", " ", "", "one two", "One two", "a b c d e", "a b c d e f", "a b c d f"]
    assert kept(spark, texts) == groups(texts)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_near_duplicates_of_a_table(spark):
    """Every group of sf0.01, which has near copies of several kinds: none lost, none added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    ids = {i: d["doc_id"] for i, d in enumerate(docs)}
    got = {d["doc_id"] for d in near.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id").collect()}
    assert got == {ids[i] for i in groups([d["text"] or "" for d in docs])}


@pytest.mark.parametrize("small", [32, 2])
def test_crowd_with_a_common_passage(spark, monkeypatch, small):
    """Texts that share most of their words with a crowd: some alike to a few others, most to none."""
    monkeypatch.setattr(near, "SMALL", small)
    r = random.Random(17)
    passage, texts = prose(r, 60), []
    for _ in range(90):
        own = prose(r, r.randint(8, 30))
        texts += [" ".join([*own, *passage])] + [" ".join([*own, *passage, *prose(r, r.randint(0, 4))])] * (r.random() < 0.3)
    assert kept(spark, texts) == groups(texts)


def test_rounds_read_what_the_last_left(spark, monkeypatch):
    """All classes of shared keys meet their groups once; later rounds only those of crowds, and at last of keys that hold two groups."""
    monkeypatch.setattr(near, "SMALL", 4)
    r = random.Random(19)
    read, texts, made = [], [], near.rooted
    for _ in range(3):  # crowds that their first heads don't join wholly
        base = prose(r, 150)
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randint(2, 4)):
                copy[r.randrange(150)] = r.choice(WORDS)
            texts.append(" ".join(copy))
    for _ in range(40):  # copies that they do join
        own = prose(r, 150)
        texts += [" ".join(own), " ".join([*own, "more"])]

    def counted(met, joined):
        found = made(met, joined)
        assert "[node" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)
        read.append((met.count(), found.count()))
        return found

    monkeypatch.setattr(near, "rooted", counted)
    assert kept(spark, texts) == groups(texts)
    assert len(read) > 2 and read[0][1] < 0.6 * read[0][0]
    assert all(n <= before[1] for (n, _), before in zip(read[1:-1], read)) and read[-1][0] == read[0][1]


def test_rows_with_clashing_names_and_null_or_repeated_keys(spark):
    r = random.Random(19)
    one, two = (" ".join(prose(r, 80)) for _ in range(2))
    rows = [(None, one, 1, "x"), (None, two, 2, "x"), ("b", one, 3, "y"), ("a", two + " more", 4, "z"), (None, None, 5, "z"), ("c", "", 6, "z"), ("d", one, 7, "a"), ("d", one, 8, "b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, node long, `a.b` string")
    got = near.near_duplicates(docs)
    assert got.columns == docs.columns and sorted(x["node"] for x in got.collect()) == [1, 2, 5]
    alone = [x["node"] for _ in range(2) for x in near.near_duplicates(docs.filter("node in (7, 8)")).collect()]
    assert len(alone) == 2 and alone[0] == alone[1]


def test_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 4)
    r = random.Random(9)
    base = prose(r, 150)
    texts = [" ".join(base)]
    for _ in range(40):
        copy = list(base)
        copy[r.randrange(len(copy))] = r.choice(WORDS)
        texts.append(" ".join(copy))
    assert kept(spark, texts) == {0}


@pytest.mark.parametrize("edit", ["cut 10", "cut 18", "append 20", "header 20", "replace"])
def test_near_copies_by_kind_of_edit(spark, edit):
    r = random.Random(11)
    texts = []
    for _ in range(60):
        base = prose(r, r.randint(60, 200))
        n = len(base)
        made = {
            "cut 10": lambda: base[: n - n // 10],
            "cut 18": lambda: base[: n - n * 18 // 100],
            "append 20": lambda: base + prose(r, n * 20 // 100),
            "header 20": lambda: prose(r, n * 20 // 100) + base,
            "replace": lambda: [*base[: n // 2], "other", *base[n // 2 + 1 :]],
        }[edit]()
        texts += [" ".join(base), " ".join(made)]
    pairs = [i for i in range(0, 120, 2) if len(shingles(texts[i]) & shingles(texts[i + 1])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[i + 1]))]
    assert len(pairs) >= 50
    assert kept(spark, texts) == set(range(120)) - {i + 1 for i in pairs}


@pytest.mark.parametrize("kind", ["families", "chain"])
def test_crowd_that_is_not_alike_to_its_heads(spark, monkeypatch, kind):
    monkeypatch.setattr(near, "SMALL", 4)
    r = random.Random(13)
    if kind == "chain":  # each text is alike to those beside it only
        words = prose(r, 500)
        texts = [" ".join(words[at : at + 150]) for at in range(0, 350, 10)]
        r.shuffle(texts)
        want = {0}
    else:  # families that share most of their words
        base, texts = prose(r, 150), []
        tails = [prose(r, 24) for _ in range(8)]
        for _ in range(8):
            for tail in tails:
                copy = [*base, *tail]
                copy[r.randrange(len(base))] = r.choice(WORDS)
                texts.append(" ".join(copy))
        want = set(range(8))
    assert kept(spark, texts) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "tokens":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0.5 * counts[0]
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality":  # it reads the labels of a folder
            assert stage(spark, docs, SMALL).count() == 0
