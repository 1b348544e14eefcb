import random
import re

from graphloom.llm import decontaminate as dc

from .helpers import no_docs, odd_docs


def brute(docs, items):
    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    out = {}
    for d, t in docs:
        for i, u in items:
            q = sh(u)
            n = len(q & sh(t))
            if q and 100 * n >= 75 * len(q):
                out[d, i] = (len(q), n)
    return out


def data():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 12, 30, 30, 60, 200])] + [(50, "only three words"), (51, None), (52, "...")]
    docs = [(100, "only three words"), (101, None), (102, "")]
    for k in range(30):
        w = items[k % 7][1].split()
        for _ in range(k // 7):
            w[rnd.randrange(len(w))] = word()
        docs.append((k, " ".join(word() for _ in range(rnd.randint(0, 500))) + " " + ", ".join(w).upper() + " " + " ".join(word() for _ in range(50))))
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, sh string, v string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, ni string")
    return {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in dc.contained_items(d, i).collect()}


def test_matches_brute_force(spark):
    docs, items = data()
    want = brute(docs, items)
    assert len(want) >= 15 and run(spark, docs, items) == want


def test_without_broadcast_and_with_repeats(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert run(spark, docs + docs[:5], items + items[:2]) == brute(docs, items)


def test_exactly_three_quarters_in_pieces_all_over_the_document(spark):
    """Contained shingles that lie apart, at and just below the threshold, in partitions of every size."""
    rnd, docs, items = random.Random(9), [], []
    for k, n in enumerate([8, 16, 31, 32, 100, 1000]):
        words = [f"w{k}x{j}" for j in range(n + 4)]
        items.append((k, " ".join(words)))
        runs = [" ".join(words[i : i + 5]) for i in range(n)]
        for d, share in enumerate((0.75, 0.74)):
            own = rnd.sample(runs, -(-3 * n // 4) if d == 0 else -(-3 * n // 4) - 1)
            docs.append((10 * k + d, " ".join(f"{r} {' '.join(f'f{rnd.random()}' for _ in range(3))}" for r in own)))
    want = brute(docs, items)
    assert {d for d, _ in want} >= {10 * k for k in range(6)} and run(spark, docs, items) == want


def test_partitions_need_no_more_than_their_signatures(spark):
    from pyspark.sql import functions as F

    entries = spark.range(1, 300).select(F.col("id").alias("key"), F.col("id").cast("int").alias("ni"), F.expr("transform(sequence(1L, id), i -> xxhash64(id, i))").alias("sh"))
    signatures, partitions = dc.partitioned(entries, 75)
    kept = {r["key"]: r["count"] for r in signatures.groupBy("key").count().collect()}
    assert all(kept[n] >= n - -(-3 * n // 4) + 1 and kept[n] <= n // 2 + 1 for n in kept) and len(kept) == 299
    rows = {r["class"]: r for r in partitions.collect()}
    assert sorted(rows) == list(range(9)) and rows[8]["top"] < 2**62 and rows[8]["room"] == 192


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contained_items(no_docs(spark), items).count() == 0
    assert dc.contained_items(odd_docs(spark), items.where("false")).count() == 0
    anonymous = spark.createDataFrame([(None, "no id at all here today")], "item_id long, text string")
    assert [tuple(r) for r in dc.contained_items(odd_docs(spark), anonymous).collect()] == [(None, None, 2, 2, 1.0)]
