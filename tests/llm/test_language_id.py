from pyspark.sql import functions as F

from graphloom.llm.language_id import identify_language, keep_known

from .helpers import SCHEMA, no_docs, odd_docs

WORDS = {"en": "the house with three windows and the wheel", "de": "das Häuschen mit großen Fenstern und für über", "fr": "où êtes vous allé avec le garçon français"}


def docs(spark):
    rows = [(i, " ".join(WORDS[g].split()[(i + j) % 7] for j in range(40)), g) for i in range(120) for g in [sorted(WORDS)[i % 3]]]
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, "x", "y", "z") for i, t, g in rows], SCHEMA)


def test_held_out_accuracy(spark):
    d = docs(spark)
    rows = identify_language(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 120 and len(held) > 15 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)


def test_odd_rows(spark):
    d = docs(spark).union(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = {r["doc_id"]: r for r in identify_language(d).collect()}
    assert [rows[1000 + i]["lang_pred"] for i in (2, 3, 5, 7)] == ["und"] * 4 and rows[1002]["score"] == 0
    assert rows[1004]["lang_pred"] != "und"
    kept = keep_known(d)
    assert kept.columns == d.columns and {1002, 1003, 1005, 1007}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 120
    assert identify_language(no_docs(spark)).count() == 0
    assert {r["lang_pred"] for r in identify_language(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_rare_language_is_learned(spark, monkeypatch):
    from graphloom.llm import language_id

    monkeypatch.setattr(language_id, "MAX_ROWS", 60)
    d = docs(spark)
    rare = spark.createDataFrame([(5000 + i, "какой же это был длинный и тёплый вечер " * 4, "ru", "s", 1, 0.5, "x", "y", "z") for i in range(12)], SCHEMA)
    many = d.union(d.withColumn("doc_id", F.col("doc_id") + 200)).union(d.withColumn("doc_id", F.col("doc_id") + 400)).union(rare)
    rows = identify_language(many).where("doc_id >= 5000").collect()
    assert len(rows) == 12 and {r["lang_pred"] for r in rows} == {"ru"}
