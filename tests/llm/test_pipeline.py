import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from graphloom.llm import common, near_dedup, toxicity


def test_each_stage_removes_its_own(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    clean = {i: " ".join(word() for _ in range(80)) for i in range(1, 61)}
    toxic = {i: " ".join(word() for _ in range(40)) + " zzvile " + " ".join(word() for _ in range(40)) for i in range(100, 130)}
    item = " ".join(word() for _ in range(30))
    copies = {200: clean[7], 201: clean[7].upper(), 202: clean[8] + " more"}
    leaked = {300: " ".join(word() for _ in range(60)) + " " + item}
    junk = {400: "1234 ---", 401: None, 402: ""}
    rows = [(i, t, "en", "s", len(t or "")) for d in (clean, toxic, copies, leaked, junk) for i, t in d.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.collect()})
    left = {*clean, *copies, *leaked, *junk}
    assert kept[0] == left
    left -= set(junk)
    assert kept[1] == left
    left -= set(copies)
    assert kept[2] == left
    left -= set(leaked)
    assert kept[3] == left == set(clean)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: sp.encode(t) for i, t in clean.items()} and all(r["same"] for r in rows)


def test_a_worker_holds_little_beside_its_batch():
    """An executor's heap leaves little room: temporary numbers are made for some of a batch's texts at a time."""
    texts = pa.array(["some words of a text that is like others, " * 100] * 2000)  # 8 MB
    assert texts.nbytes > 8e6 and common.BATCH_BYTES <= 2 << 20
    tables = toxicity.voter_tables(np.array([1], np.int64), np.array([2], np.int64))
    for work in (lambda: [x for x in toxicity.votes(tables, texts)], lambda: [len(x) for x in near_dedup.shingle_sets(texts, 5)]):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6
