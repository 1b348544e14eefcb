import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import token_files as tf

from .helpers import no_docs, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=1500), st.integers(9, 16))
def test_codes_round_trip(ids, limit):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=300) ** 3
    lengths = tf.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 + 1e-12
    stream, blocks = tf.encode_bits(ids, lengths, tf.canonical_codes(lengths))
    assert (tf.decode_blocks(stream, blocks, len(ids), lengths) == ids).all()


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1, 1])
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((counts * tf.code_lengths(counts)).sum()) == total


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_IDS", 2000)
    extra = [(20 + i, f"Some words, it's {i} of them here  now\n\n {'tail ' * i}", "en") for i in range(40)] + [(90, "a <|endoftext|> b", "en"), (91, "x  y 　 z é à", "fr")]
    docs = odd_docs(spark, extra)
    tok = Tokenizer.from_file(PATH)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: -(2**63) if r["doc_id"] is None else r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in tf.token_files(docs, PATH).collect()), key=lambda r: r[1])
    assert got == want
    assert tf.token_files(no_docs(spark), PATH).count() == 0
