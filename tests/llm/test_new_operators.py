"""Toxicity through a noisy channel, the audit of filters' interaction, and whitening: against brute force, and on odd inputs."""

import itertools
import math
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from trackmill.llm import interaction, queries, toxicity, whitening

SMALL = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors):
    """By numpy over Python's integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums])
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, mean, values[::-1], directions[:, ::-1]


def assert_whitened(rows, keys, vectors):
    x, n, sums, mean, values, directions = plain_whitening(vectors)
    k = min(16, len(values))
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(found) == len(keys) * k == len(rows)
    own = np.array([[found[key, c + 1]["whitened"] for c in range(k)] for key in keys])
    want = (np.array(x, dtype=float) - mean) @ directions[:, :k] / np.sqrt(values[:k])
    sign = np.sign((own * want).sum(axis=0))
    assert np.abs(own * sign - want).max() < 1e-6
    for key, row in zip(keys, x):
        assert found[key, 1]["n"] == n and found[key, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(row, sums))
    assert all(abs(found[keys[0], c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-4 for c in range(k))
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-4


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_whitening_is_that_of_all_vectors(spark):
    rows = [r for r in read("embeddings") if r["embedding"] is not None]
    assert_whitened(queries.op13_embedding_whitening(spark, SMALL).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_odd_tables(spark):
    draw = np.random.default_rng(3)
    good = (draw.normal(size=(60, 3)) @ np.diag([5, 1, 0.2]) + [1e6, -3, 0]).round(3).tolist()
    rows = [(i, v, "c") for i, v in enumerate(good)] + [(100, good[0], "c"), (101, None, "c"), (102, [1.0, None, 2.0], "c"), (103, [float("nan"), 1.0, 1.0], "c"), (104, [float("inf"), 1.0, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(5)
    assert_whitened(whitening.whiten(df).collect(), [*range(60), 100], [*good, good[0]])
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id in (0, 100)")).collect() == []
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (None, [1.0, 6.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["explained"]) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]  # the first entry never varies
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")).collect() == []
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e300]), (2, [1.0])]):
        with pytest.raises(Exception, match="different lengths|exceeds 64 bits"):
            whitening.whiten(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).collect()


def test_moments_merge_in_any_grouping():
    draw = np.random.default_rng(5)
    x = draw.integers(-50, 50, (200, 4)) + 10**12
    whole = whitening.Moments.of(x)
    for cuts in ([1], [3, 7, 100], list(range(1, 200))):
        parts = [whitening.Moments.of(p) for p in np.split(x, cuts)]
        while len(parts) > 1:
            parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
        assert parts[0].n == 200 and list(parts[0].sums) == list(whole.sums) and np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12)


# ---------------------------------------------------------------- interaction


def plain_audit(docs, labels):
    """All orders, document by document."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    least = {}
    for d in docs:
        t = d["text"] or ""
        if d["doc_id"] is not None:
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    masks = []
    for d in docs:
        t = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": d["doc_id"] is not None and d["doc_id"] > least[t]}
        masks.append((d["lang"] or "", {f for f in fails if fails[f]}, d["doc_id"] in good, d["doc_id"] in toxic))
    out, share = {}, {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = [m for m in own if f in m[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def assert_audit(df, docs, labels):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(got) == len(rows) and got == plain_audit(docs, labels)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_interaction_is_that_of_each_document(spark):
    assert_audit(queries.op12_filter_interaction(spark, SMALL), read("documents"), read("labels"))


def test_interaction_on_odd_tables(spark):
    many = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "", many, many, "A B", "é" * 5000, "a\x0bb # c", many + " 50%", "x " * 500, "Ａ b"]
    docs = [(i, t, "x" if i % 2 else None, i) for i, t in enumerate(texts)] + [(None, many, "x", 0), (None, None, None, 0), (3, many, "x", 3), (3, many, "y", 3), (1, "", "", 1)]
    labels = [(0, 1, 0, "a"), (1, 0, 1, "a"), (3, 1, 1, "a"), (4, 1, None, "a"), (4, 0, 1, "a"), (None, 1, 1, "a"), (99, 1, 1, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int")
    k = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    as_rows = [dict(zip(("doc_id", "text", "lang"), r)) for r in docs]
    assert_audit(interaction.audit(d, k), as_rows, [dict(zip(("doc_id", "quality", "toxic"), r)) for r in labels if r[0] is not None])
    assert_audit(interaction.audit(d, k.limit(0)), as_rows, [])
    assert interaction.audit(d.limit(0), k).collect() == []


def test_interaction_of_more_parts_than_a_task_holds(spark, monkeypatch):
    docs = [(i, f"text {i % 7}", f"p{i % 23}") for i in range(200)]
    monkeypatch.setattr(interaction, "PARTS", 3)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert_audit(interaction.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")), [dict(zip(("doc_id", "text", "lang"), r)) for r in docs], [])


# ---------------------------------------------------------------- toxicity

PROSE = "the water under paper glass river stone light blend reat onth ing tion of and".split()


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(PROSE[i] for i in r.integers(0, len(PROSE), n))


def labelled(spark):
    """Insults in plain spelling among prose: odd ids are toxic."""
    texts = [(i, prose(i) + (" you worthless idiot " if i % 2 else " you shining lamp ") + prose(1000 + i)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id long, text string, k int, term string, row string")
    labels = spark.createDataFrame([(i, i % 2, "t") for i, _ in texts], "doc_id long, toxic int, text string")
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    return toxicity.fit(docs, labels, F.lit(True))


DISGUISES = ["1d10t", "id1ot", "!diot", "i.d.i.o.t", "i d i o t", "i-d-1-o-t", "idiooooot", "iiiidiot", "id*ot", "w0rthl3ss", "worthle55", "W O R T H L E S S", "w0rthlesssss"]


@pytest.mark.parametrize("word", DISGUISES)
def test_disguised_words_are_restored(model, word):
    made, changed = model.channel.clear(f"under the {word} of stone")
    assert changed and re.search(r"\b(idiot|worthless)\b", made) and made.startswith("under the ") and made.endswith(" of stone")
    assert model.score(f"{prose(5)} {word} {prose(6)}")[0] > model.score(f"{prose(5)} lamp {prose(6)}")[0]


def all_paths(channel, stretch):
    """Every reading of a stretch with its cost, by trying all choices."""
    runs, at = [], 0
    while at < len(stretch):
        n = len(stretch[at:]) - len(stretch[at:].lstrip(stretch[at]))
        runs.append((stretch[at], n, at))
        at += n
    tail = max((i + 1 for i, c in enumerate(stretch) if c.isalpha()), default=0)
    singles = len(stretch) // 2 + 1 if len(stretch) > 4 and all(c in " .-_" for c in stretch[1::2]) else 0
    for chosen in itertools.product(*(channel.choices(c, n, singles, at >= tail) for c, n, at in runs)):
        text = "".join(out for out, _ in chosen)
        symbols = [0, 0]
        cost = sum(c for _, c in chosen)
        for s in [int(toxicity.tables()[0][ord(c)]) for c in text + " "]:
            if s or symbols[-1]:
                cost += float(channel.costs[symbols[-2], symbols[-1], s])
                symbols.append(s)
        yield cost, text


def test_the_path_is_the_best_of_all(model):
    draw = np.random.default_rng(9)
    signs = list("abdeiorstwlh013457$!@*") + ["ss", "oo", "iii", "00"]
    for _ in range(150):
        stretch = "".join(signs[i] for i in draw.integers(0, len(signs), draw.integers(2, 7)))
        made, paths = toxicity.Channel(model.channel.costs).restored(stretch), sorted(all_paths(model.channel, stretch))
        assert made in {t for c, t in paths if c < paths[0][0] + 1e-4}, (stretch, made, paths[:3])


def test_counts_and_stretches():
    text = "Ab  ab"
    codes = toxicity.triples(text)
    a, b = 1, 2
    assert codes.tolist() == [(x * 64 + y) * 64 + z for x, y, z in ((0, 0, a), (0, a, b), (a, b, 0), (b, 0, a), (0, a, b), (a, b, 0))]
    where = lambda t: [t[s:e] for s, e in toxicity.stretches(t)]
    assert where("plain text, with 12 numbers & a 3") == [] and where("a b") == [] and where("") == []
    assert where("x1 yes! sooo a b c") == ["x1", "yes!", "sooo", "a b c"] and where("aaa") == ["aaa"] and where("xaaa") == ["xaaa"] and where("aa a") == []
    parts = list(toxicity.chunks("ab cd\n" * 100_000))
    assert "".join(parts) == "ab cd\n" * 100_000 and len(parts) > 1 and list(toxicity.chunks("a " * 400_000)) == ["a " * 400_000]


def test_learning_and_odd_texts(spark, model):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(rows[i]["predicted"] == i % 2 for i in range(200))
    long = prose(7, 200_000)
    odd = [(1, None), (2, ""), (3, "日本語😀"), (4, long), (5, long + " id1ot"), (None, "worthless idiot"), (5, long + " id1ot"), (6, "a" * 400_000), (7, "1" * 400_000 + "x"), (8, "\x00\n İ")]
    got = toxicity.score(spark.createDataFrame([(*r, "s") for r in odd], "doc_id long, text string, score string"), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] < 0.5 and by[4]["predicted"] == 0 and by[5]["n_restored"] == 1 and by[5]["score"] > by[4]["score"] and by[None]["predicted"] == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
    one = toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True))
    assert one is None and {r["score"] for r in toxicity.score(docs, None).collect()} == {0.5}
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)) is None and toxicity.fit(docs, labels, F.lit(False)) is None
    restored = toxicity.restore(spark.createDataFrame([(1, "An 1d10t"), (2, None)], "doc_id long, text string"), model.channel).collect()
    assert [tuple(r) for r in sorted(restored)] == [(1, "an idiot", 1), (2, "", 0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_toxicity(spark):
    """Rows that were not learnt from: most of the toxic ones are found, and clean ones left alone."""
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op11_toxicity_channel(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(y == p for y, p in held) / len(held) > 0.93 and not any(p for y, p in held if y == 0)
