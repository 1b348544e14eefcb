import random
import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.llm import toxicity as tx

from .helpers import SCHEMA, no_docs, odd_docs


def docs(spark, n=300):
    rnd = random.Random(4)
    plain = [f"{a}{b}" for a in ("lam", "ner", "sol", "tir") for b in ("ado", "ine", "ust", "eth")]
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [rnd.choice(plain) for _ in range(60)]
        if bad:
            w[rnd.randrange(60)] = rnd.choice(["nasty", "vile", "grubux" + rnd.choice("abcdef"), "grubux" + rnd.choice("ghijk")])
        rows.append((i, " ".join(w), "en", "s", 1, 0.5, "x", "y", "z"))
        marks.append((i, None, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    d, labels = docs(spark)
    rows = tx.toxicity(d, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 300 and len(held) > 30
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = tx.keep_harmless(d, labels)
    assert kept.columns == d.columns and kept.count() == 300 - sum(r["predicted"] for r in rows)


def brute_em(x, a0, b0, prior, rounds, repeats, anchor):
    """The label model on a plain matrix: posteriors, rates and residual correlations written out row by row."""
    share, a, b = np.ones(x.shape[1]), a0, b0
    for _ in range(rounds):
        weights = share * np.log(a / b)
        lo, hi = -80.0, 80.0
        for _ in range(80):
            bias = (lo + hi) / 2
            q = 1 / (1 + np.exp(-(x @ weights + bias)))
            lo, hi = (lo, bias) if q.mean() > prior else (bias, hi)
        left = x - (q[:, None] * a + (1 - q)[:, None] * b)
        scale = np.sqrt((left**2).sum(0)) + 1e-9
        rho = left.T @ left / np.outer(scale, scale)
        np.fill_diagonal(rho, 1)
        share = 1 / np.maximum(1, np.where(rho > repeats, rho, 0).sum(1))
        a, b = ((q @ x + 0.1) / (q.sum() + 1) + anchor * a0) / (1 + anchor), (((1 - q) @ x + 0.01) / ((1 - q).sum() + 1) + anchor * b0) / (1 + anchor)
    return q, rho, share


def votes_of(rng, n=3000):
    y = rng.random(n) < 0.2
    x = np.stack([rng.random(n) < np.where(y, on, off) for on, off in ((0.7, 0.02), (0.6, 0.05), (0.5, 0.05), (0.3, 0.3), (0.1, 0.6))], 1)
    return y, np.concatenate([x, x[:, :1]], 1).astype(float)  # the last voter repeats the first


def test_label_model_equals_plain_em_and_needs_no_labels(spark):
    y, x = votes_of(np.random.default_rng(0))
    rows = [([int(k) for k in np.flatnonzero(r)], 1) for r in x]
    patterns = spark.createDataFrame(rows, "hits array<int>, c long")
    a, b = np.array([0.5, 0.5, 0.5, 0.4, 0.3, 0.5]), np.array([0.1, 0.1, 0.1, 0.4, 0.5, 0.1])
    model = tx.label_model(patterns.repartition(3), 6, a, b, 0.2)
    merged = tx.label_model(patterns.groupBy("hits").count().toDF("hits", "c"), 6, a, b, 0.2)
    q, rho, share = brute_em(x, a, b, 0.2, tx.ROUNDS, tx.REPEATS, tx.ANCHOR)
    got = 1 / (1 + np.exp(-(x @ model["weights"] + model["bias"])))
    assert np.abs(got - q).max() < 0.02 and np.abs(model["correlations"] - rho).max() < 0.02 and np.abs(model["share"] - share).max() < 0.01
    assert np.abs(merged["weights"] - model["weights"]).max() < 1e-3
    assert ((got >= 0.5) == y).mean() > 0.9 and model["correlations"][0, 5] > 0.95 and model["share"][0] < 0.55 and model["share"][3] > 0.9
    assert model["weights"][4] < 0 < model["weights"][2]  # a voter for the clean class


def test_beginnings_that_occur_twice(spark):
    tables = tx.voter_tables(np.zeros(0, np.int64), np.zeros(0, np.int64))
    data = np.frombuffer(b"grubuxab grubuxcd", np.uint8)
    hashes = {len(k): h for k, (h, _) in zip(("w", *("x" * n for n in tx.PREFIXES)), tx.units(data, np.array([0, len(data)])), strict=True)}
    key = np.array([hashes[6][0]], np.uint64).view(np.int64)
    tables = tx.voter_tables(np.zeros(0, np.int64), key)
    import pyarrow as pa

    found = [(text.tolist(), voter.tolist()) for _, _, text, voter in tx.votes(tables, pa.array(["grubuxab grubuxcd", "grubuxab", None, "x"]))]
    assert found == [([0], [0])]


def test_odd_rows(spark):
    d, labels = docs(spark, 100)
    rows = tx.toxicity(odd_docs(spark), labels).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert tx.toxicity(no_docs(spark), labels).count() == 0
    assert {r["predicted"] for r in tx.toxicity(d, labels.where("false")).collect()} == {0}
    assert {r["predicted"] for r in tx.toxicity(d, labels.where("toxic = 1")).collect()} == {0}
    twice = labels.union(labels.where("doc_id < 10")).union(spark.createDataFrame([(5, 1, None), (None, 1, 1)], labels.schema))
    assert tx.toxicity(d, twice).count() == 100


def test_the_driver_holds_little_while_it_trains(spark):
    """Neither a dense matrix of the sample's votes nor copies of the matrix of correlations."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain, bad = [word(6) for _ in range(40)], [word(10) for _ in range(160)]
    rows = [(i, " ".join([rnd.choice(plain) for _ in range(20)] + rnd.sample(bad, 10 * (i % 5 == 0)))) for i in range(3000)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    model = tx.train(d, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model["w"]) > 1000 and peak < 40e6
    kept = {r["doc_id"] for r in tx.keep_harmless(d, labels).collect()}
    assert kept == {i for i, _ in rows if i % 5}


def test_votes_are_summed_as_by_a_matrix():
    rng = np.random.default_rng(2)
    x = rng.random((50, 9)) < 0.2
    x[[0, 49]], x[:, 8] = False, False  # texts and a voter without a vote
    votes = tx.Votes(pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32())), 9)
    w, d = rng.normal(size=9), rng.normal(size=50)
    assert np.allclose(votes.of_texts(w), x @ w) and np.allclose(votes.of_voters(d), d @ x)
