"""Cross-entropy difference of matched n-gram models (operator 1)."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_WORDS, bitmap, materialize, prepare, probe
from .textops import STEP, mix, text_slices, words

#: The least size of the shared vocabulary; one of more words counts as its number of distinct words.
VOCABULARY = 1 << 18
#: Weight of the unigram distribution in the pair model (Dirichlet smoothing), the same for both models.
SMOOTHING = 4.0
#: Bytes of text in a block: its words and pairs are looked up together.
BLOCK_BYTES = 12 << 20
#: Bytes of text for each bucket of keys, and the least number of buckets.
BUCKET_BYTES = 16 << 20
BUCKETS = 256

_STATE = "block long, head binary, words binary, sequence binary"
_ASKED = "block long, bucket int, keys binary, counts binary"
_FOUND = "block long, bucket int, totals binary, words long, b long, t long, hb long, ht long"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    raw = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_keys(x: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _events(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text)."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_slices(texts):
        _, h, of = words(data, offsets)
        hashes.append(h)
        sizes.append(np.diff(of))
    return np.concatenate(hashes), np.concatenate(sizes)


def _states(batches):
    """Blocks of texts: ids and sizes, the hashes of the distinct words, and each word as its place among them."""

    def row(held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids, texts, target = (table[i].combine_chunks() for i in range(3))
        h, sizes = _events(texts)
        w, word = np.unique(h, return_inverse=True)
        head = np.concatenate([x.astype(np.int64) for x in (ids.fill_null(0).to_numpy(), np.array(ids.is_valid()), sizes, target.to_numpy(zero_copy_only=False))])
        block = int.from_bytes(os.urandom(8), "little") >> 1
        columns = [pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (_pack(head), _pack_keys(w), _pack(word.astype(np.uint32))))]
        return pa.RecordBatch.from_arrays(columns, ["block", "head", "words", "sequence"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK_BYTES:
            yield row(held)
            held, size = [], 0
    if sum(map(len, held)):
        yield row(held)


def _pairs(sizes: np.ndarray, w: np.ndarray, word: np.ndarray):
    """Of a block: (history of each word, pair of each word, keys of the pairs ascending, word and history of each pair).

    Words are places in ``w``; the history of a text's first word is the place after the last.
    """
    v = len(w)
    word = word.astype(np.int64)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[(np.cumsum(sizes) - sizes)[sizes > 0]] = v
    codes, pair = np.unique(history * (v + 1) + word, return_inverse=True)
    pw, ph = codes % (v + 1), codes // (v + 1)
    keys = mix(np.append(w, np.uint64(0))[ph] * STEP + w[pw])
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return history, rank[pair], keys[order], pw[order], ph[order]


def _ask(buckets: int):
    """What blocks ask for: even buckets hold pairs and their counts (all, target), odd ones words and theirs as words and as histories."""

    def rows(block, head, words, sequence):
        _, _, sizes, target = _unpack(head, np.int64).reshape(4, -1)
        w, word = _unpack_keys(words), _unpack(sequence, np.uint32)
        if not len(word):
            return
        history, pair, keys, _, _ = _pairs(sizes, w, word)
        mark = np.repeat(target > 0, sizes)
        count = lambda x, n: (np.bincount(x, minlength=n)[:n], np.bincount(x[mark], minlength=n)[:n])
        for kind, k, counts in ((0, keys, count(pair, len(keys))), (1, w, (*count(word, len(w)), *count(history, len(w))))):
            b = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.append(np.flatnonzero(np.diff(b, prepend=np.uint64(buckets))), len(k))
            table = np.array(counts, np.uint32)
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield block, int(b[i]) * 2 + kind, _pack_keys(k[i:j]), _pack(table[:, i:j])

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(rows(*row))
                for i in range(0, len(found), 64):
                    columns = zip(*found[i : i + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "keys", "counts"])

    return run


def _total(asked: pa.Table) -> pa.Table:
    """One bucket of the tables of counts: the totals of each block's keys, in its order, and a row of sums (block -1)."""
    bucket = asked["bucket"][0].as_py()
    width = 4 if bucket % 2 else 2
    parts = [_unpack_keys(x.as_py()) for x in asked["keys"]]
    counts = np.concatenate([_unpack(x.as_py(), np.uint32).reshape(width, -1) for x in asked["counts"]], axis=1)
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.array([np.bincount(at, weights=x, minlength=len(keys)) for x in counts]).astype(np.int64)
    ends = np.cumsum([0, *map(len, parts)])
    blobs = [_pack(total[:, at[i:j]]) for i, j in zip(ends, ends[1:], strict=False)]
    sums = [len(keys), *(int(x.sum()) for x in total)] if bucket % 2 else [0] * 5
    n = len(blobs)
    columns = [pa.array([*asked["block"].to_pylist(), -1], pa.int64()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*blobs, None], pa.binary())]
    return pa.table([*columns, *(pa.array([None] * n + [x], pa.int64()) for x in sums)], ["block", "bucket", "totals", "words", "b", "t", "hb", "ht"])


def _score(totals: tuple[int, int], starts: tuple[int, int], vocabulary: int):
    def run(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["bucket"])
        state = rows[0]
        ids, valid, sizes, _ = _unpack(state["head"], np.int64).reshape(4, -1)
        losses = [np.full(len(ids), np.nan), np.full(len(ids), np.nan)]
        if len(rows) > 1:
            _, sequence, _, word, history = _pairs(sizes, _unpack_keys(state["words"]), _unpack(state["sequence"], np.uint32))
            pairs, of = (np.concatenate([_unpack(r["totals"], np.int64).reshape(width, -1) for r in rows[1:] if r["bucket"] % 2 == kind], axis=1) for kind, width in ((0, 2), (1, 4)))
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            for model in (0, 1):
                unigram = (of[model] + 1.0) / (totals[model] + vocabulary)
                before = np.append(of[2 + model], starts[model])
                loss = -np.log((pairs[model] + SMOOTHING * unigram[word]) / (before[history] + SMOOTHING))
                losses[model][full] = np.add.reduceat(loss[sequence], first) / sizes[full]
        theirs, ours = losses
        columns = [pa.array(ids, mask=valid == 0), pa.array(sizes), *(pa.array(x, from_pandas=True) for x in (ours, theirs, ours - theirs))]
        return pa.table(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _unlikely(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows that ``probe`` leaves out, and those with a null id."""
    word = F.pmod(F.xxhash64(df[column]), F.lit(BITMAP_WORDS)).cast("int")
    hit = F.coalesce(F.expr(f"shiftright(bits, cast(pmod(shiftright(xxhash64({column}), 24), 64) as int)) & 1"), F.lit(0)) == 1
    return df.withColumn("_word", word).join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word", "left").where(~hit | F.col(column).isNull()).drop("_word", "bits")


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, text, target): only rows that may be in the target are shuffled."""
    ids = materialize(target_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), "target")
    bits = materialize(bitmap(ids, "_id"), "bits")
    rows = docs.select("doc_id", "text")
    maybe = probe(rows.where("doc_id is not null"), "doc_id", bits)
    marked = maybe.join(ids, maybe["doc_id"] == ids["_id"], "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))
    return marked.union(_unlikely(rows, "doc_id", bits).withColumn("target", F.lit(False)))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs`` (doc_id, text).

    A target and a background bigram model have the same vocabulary and smoothing; the losses are means over a
    text's words in nats, and the score is target minus background: lower is more like the target. The background is
    all rows of ``docs``, the target those whose doc_id is in ``target_ids``. Words and pairs are counted one by one,
    under whole 64-bit hashes: the tables of counts grow with the corpus and lie in buckets of keys, each for a
    bounded amount of text. Texts are cut into blocks; a block asks each bucket once for the words and pairs that it
    holds, however often, so a word or pair in every text is a row for each block at most.

    Null and empty texts, and those without a word, have 0 tokens and null losses and score. A target without rows
    leaves a uniform target model. Repeated rows count and are scored as often as they occur; other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    states = materialize(_marked(docs, target_ids).mapInArrow(_states, _STATE), "blocks")
    found = materialize(states.mapInArrow(_ask(buckets), _ASKED).groupBy("bucket").applyInArrow(_total, _FOUND), "counts")
    # the words that are no history end their texts, and as many begin one
    n_words, b, t, hb, ht = (x or 0 for x in found.where("block < 0").agg(*(F.sum(c) for c in ("words", "b", "t", "hb", "ht"))).first())
    score = _score((b, t), (b - hb, t - ht), max(VOCABULARY, n_words))
    rows = found.where("block >= 0").select("block", "bucket", "totals").withColumns({c: F.lit(None).cast("binary") for c in ("head", "words", "sequence")})
    rows = rows.union(states.select("block", F.lit(-1), F.lit(None).cast("binary"), "head", "words", "sequence"))
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return rows.groupBy("block").applyInArrow(score, schema)
