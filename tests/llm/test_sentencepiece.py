import time

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sentencepiece_match as sm
from graphloom.llm.sentencepiece_match import encode_decode

from .helpers import SCHEMA, no_docs, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", "  a  b\n\tc  ", "é一😀 ﬁ x", "   ", "a    b     c", " x y　z w", "日本 語 abc 日 日", "\r\n x", " \n a   日b", "aaaaaaaaaaaaaaaaaaaaaaaa aaaaaaab", "Straßenbahn İstanbul ǅ", "don't can’t 12345 $%&***", "x" * 300 + " " + "ab" * 200]


def test_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd_docs(spark, [(100 + i, t, "en") for i, t in enumerate(TEXTS)])
    rows = encode_decode(docs, MODEL).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == sp.encode(text[r["doc_id"]]), r["doc_id"]
        assert r["same"] and r["decoded"] == text[r["doc_id"]]


def test_word_marks_and_empty_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(1, "▁a ▁b", "", "", 1, 0.0, "", "", "")], SCHEMA)
    r = encode_decode(docs, MODEL).first()
    assert r["ids"] == sp.encode("▁a ▁b") and not r["same"] and r["decoded"] == sp.decode(r["ids"])
    assert encode_decode(no_docs(spark), MODEL).count() == 0


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLES = sm.Model(MODEL)
PARTS = ["house", "  ", "tree", " ", "     ", "“", "”", "–", "\n", "\t", "aaa", "हिन्दी", "देव", "日本", "é", "1", "　", "▁", "😀", "...", "\0", "<s>", "<0x0A>", "the", "ing", " " * 17]


def ids(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    flat, n = TABLES.join_marks(*sm._cache(MODEL, TABLES).ids(*sm._marked(data, offsets)))
    ends = np.cumsum(n)
    return [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=4))
def test_odd_spacing_equals_the_library(texts):
    assert ids(texts) == LIBRARY.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    assert ids([text]) == [LIBRARY.encode(text)]


def test_runs_of_spaces_of_every_length():
    texts = [" " * k + "tree" + " " * j + "日" for k in range(70) for j in (0, 1, 16, 33)]
    assert ids(texts) == LIBRARY.encode(texts)


def test_long_texts_take_time_in_proportion_and_are_never_merged(monkeypatch):
    monkeypatch.setattr(sm.Model, "merge", None)
    sm._encoders.clear()
    for t in ("house  tree  and  ", "“house” – “tree” — ", "हिन्दी देवनागरी में ", "aZb0/", "a"):
        text = t * (130_000 // len(t))
        began = time.perf_counter()
        got = ids([text])
        assert time.perf_counter() - began < 10 and got == [LIBRARY.encode(text)]
