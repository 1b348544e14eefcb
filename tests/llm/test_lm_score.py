import math

from graphloom.llm.lm_score import cross_entropy_difference

from .helpers import no_docs, odd_docs


def test_target_like_texts_score_lower(spark):
    docs = spark.createDataFrame([(i, ("red apples and green pears " if i % 2 else "cold iron and grey stone ") * 5, "x") for i in range(40)], "doc_id long, text string, score string")
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    rows = {r["doc_id"]: r for r in cross_entropy_difference(docs, target).collect()}
    assert len(rows) == 40 and all(abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-6 for r in rows.values())
    assert max(rows[i]["score"] for i in range(1, 40, 2)) < 0 < min(rows[i]["score"] for i in range(0, 40, 2))


def test_counts_by_hand(spark):
    """One word twice: its losses follow from the counts alone."""
    docs = spark.createDataFrame([(1, "a a")], "doc_id long, text string")
    r = cross_entropy_difference(docs, docs.select("doc_id")).first()
    uni = (2 + 1) / (2 + 2**18)
    want = -(math.log((1 + 4 * uni) / (1 + 4)) + math.log((1 + 4 * uni) / (1 + 4))) / 2
    assert r["n_tokens"] == 2 and abs(r["target_loss"] - want) < 1e-4 and abs(r["score"]) < 1e-9


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = cross_entropy_difference(docs, docs.select("doc_id").where("doc_id = 1")).collect()
    assert len(rows) == 9
    for r in rows:
        assert (r["n_tokens"] == 0) == (r["score"] is None)
    assert len({(r["score"]) for r in rows if r["doc_id"] == 6}) == 1
    assert cross_entropy_difference(no_docs(spark), docs.select("doc_id")).count() == 0
    assert cross_entropy_difference(docs, docs.select("doc_id").where("false")).count() == 9


def test_models_grow_with_the_corpus(spark):
    """More words than 2**18: each pair of the corpus occurs once, so all losses are those of a single count."""
    n, each = 300, 1000
    docs = spark.createDataFrame([(i, " ".join(f"w{i * each + j}" for j in range(each))) for i in range(n)], "doc_id long, text string")
    rows = cross_entropy_difference(docs, docs.select("doc_id")).collect()
    uni = 2 / (2 * n * each)
    rest = -math.log((1 + 4 * uni) / (1 + 4))
    first = -math.log((1 + 4 * uni) / (n + 4))
    want = ((each - 1) * rest + first) / each
    assert len(rows) == n and all(abs(r["background_loss"] - want) < 1e-9 and abs(r["score"]) < 1e-9 for r in rows)
