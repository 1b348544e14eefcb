"""Token ids in Huffman-coded files (operator 9).

File layout, little-endian: magic ``GLHF0001``; u32 header length; header JSON (end id, block size, number of
documents and of ids); code lengths, one byte an id; document table (i64 doc_id, u64 ids so far, of each);
checkpoints (u64 bit offset of each block); the bit stream. Codes are canonical: by length, then id. A block holds
``BLOCK`` ids and can be decoded on its own from its checkpoint.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, prepare
from .pieces import ChunkCache
from .storage import opener
from .textops import text_slices

#: Longest code in bits: decoding tables have 2**16 rows.
LIMIT = 16
#: Ids in a block.
BLOCK = 512
MAGIC = b"GLHF0001"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    weights = counts[used].astype(np.float64)
    order = np.argsort(weights, kind="stable")
    leaves = weights[order]
    # each level: leaves and packages merged by weight; remember for every item whether it is a leaf
    packages, kinds = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        kinds.append(at < len(leaves))
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        leaf = int(kind[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    out[used[order]] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id and code length for every 16 bits that may follow."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << LIMIT, np.int32)
    rows = np.repeat(order, span)
    symbol[: len(rows)] = rows
    return symbol, lengths[symbol].astype(np.int64)


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of each block)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    value = codes[ids].astype(np.uint64) << (np.uint64(64) - (starts % 32 + size).astype(np.uint64))
    at = starts // 32
    edge = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.zeros(0, np.int64)
    if len(edge):
        packed = np.bitwise_or.reduceat(value, edge)
        words[at[edge]] |= packed >> np.uint64(32)
        words[at[edge] + 1] |= packed & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8 + 8], starts[::BLOCK]


def decode_blocks(stream: bytes, offsets: np.ndarray, count: int, lengths: np.ndarray) -> np.ndarray:
    """All ids: one step decodes one id of every block."""
    symbol, size = decode_table(lengths)
    data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    wide = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out = np.zeros(len(offsets) * BLOCK, np.int32).reshape(len(offsets), BLOCK) if len(offsets) else np.zeros((0, BLOCK), np.int32)
    at = offsets.astype(np.int64).copy()
    left = np.full(len(offsets), BLOCK)
    if len(left):
        left[-1] = count - BLOCK * (len(offsets) - 1)
    for j in range(BLOCK):
        n = len(offsets) if j < (left[-1] if len(left) else 0) else len(offsets) - 1
        if n <= 0:
            break
        bits = (wide[at[:n] >> 3] >> (8 - (at[:n] & 7)).astype(np.uint32)) & 0xFFFF
        out[:n, j] = symbol[bits]
        at[:n] += size[bits]
    return out.reshape(-1)[:count]


def write_file(path: str, doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, end_id: int) -> None:
    stream, blocks = encode_bits(ids, lengths, codes)
    header = json.dumps({"end_id": end_id, "block": BLOCK, "documents": len(doc_ids), "ids": len(ids), "codes": len(lengths)}).encode()
    parts = [MAGIC, struct.pack("<I", len(header)), header, lengths.tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), blocks.astype("<u8").tobytes(), stream]
    opener(path).write(path, b"".join(parts))


def read_file(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(doc_ids, number of ids up to each document's end, ids, header)."""
    raw = opener(path).read(path)
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack_from("<I", raw, 8)[0]
    header = json.loads(raw[12 : 12 + size])
    at, n = 12 + size, header["documents"]
    lengths = np.frombuffer(raw, np.uint8, header["codes"], at)
    at += header["codes"]
    doc_ids = np.frombuffer(raw, "<i8", n, at)
    ends = np.frombuffer(raw, "<u8", n, at + 8 * n).astype(np.int64)
    at += 16 * n
    blocks = np.frombuffer(raw, "<u8", -(-header["ids"] // BLOCK), at)
    at += 8 * len(blocks)
    return doc_ids, ends, decode_blocks(raw[at:], blocks, header["ids"], lengths), header


_caches: dict = {}


def _chunk_ids(path: str) -> ChunkCache:
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        wide = tok.get_vocab_size() > 1 << 16

        def encode(chunks: list[bytes]):
            coded = [e.ids for e in tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            lens = np.fromiter(map(len, coded), np.int32, len(coded))
            return np.fromiter((i for c in coded for i in c), np.int64, int(lens.sum())).astype(np.uint32 if wide else np.uint16), lens

        _caches[path] = ChunkCache(encode, np.uint32 if wide else np.uint16)
    return _caches[path]


def _tokenise(path: str, end_id: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches):
        cache = _chunk_ids(path)
        for b in batches:
            for first, last, data, offsets in text_slices(b.column(1)):
                ids, n = cache.ids(data, offsets)
                full = np.insert(ids, np.cumsum(n), end_id)
                ends = np.cumsum(n + 1) * full.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(full)])
                own = b.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, own.to_numpy())), own, raw.cast(pa.binary())], ["shard", "doc_id", "ids"])

    return run


def _tally(width: int, codes: int):
    def run(batches):
        total = np.zeros(codes, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}"), minlength=codes)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "c"])

    return run


#: Ids in a file, about.
FILE_IDS = 4 << 20


def _write(folder: str, width: int, lengths, codes, end_id: int):
    """Runs of documents in order become files; a name tells the run, so a repeated task writes the same file."""

    def run(batches):
        held, size = [], 0

        def flush():
            shard, first, crc, _ = held[0]
            ids = np.frombuffer(b"".join(h[3] for h in held), f"<u{width}")
            ends = np.cumsum([len(h[3]) // width for h in held])
            path = f"{folder}/{shard:06d}/{first}-{crc:08x}-{held[-1][1]}-{held[-1][2]:08x}-{len(held)}.glh"
            write_file(path, np.array([h[1] for h in held]), ends, ids, lengths.value, codes.value, end_id)
            columns = [pa.array([x], pa.int64()) for x in (shard, first, crc, held[-1][1], len(ids))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([path])], ["shard", "first", "crc", "last", "n", "path"])

        for b in batches:
            for shard, doc, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                row = (shard, doc, zlib.crc32(ids), ids)
                if held and (row[:3] < held[-1][:3] or shard != held[-1][0] or size >= FILE_IDS * width):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(ids)
        if held:
            yield flush()

    return run


def _read(batches):
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            doc_ids, ends, ids, _ = read_file(path)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = memoryview(ids.astype("<u4"))
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            none = doc_ids == NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=none), pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


NO_ID = -(2**63)


def shard_bounds(ids: DataFrame, shards: int) -> list[int]:
    """At most ``shards`` - 1 quantiles of doc_id: a bounded list, whatever the table."""
    if shards < 2:
        return []
    found = ids.agg(F.percentile_approx("k", [i / shards for i in range(1, shards)], 10 * shards).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode all texts, count the ids, write Huffman-coded files; (shard, first, last, n, path, before, ...), one row a file.

    Files follow each other in ascending doc_id order (null first); ``before`` is the number of ids in the files
    before. Texts are tokenised where they are read; only their ids are shuffled, by ranges of doc_id.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_path(spark, "token-files")
    from tokenizers import Tokenizer

    codes = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = 4 if codes > 1 << 16 else 2
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = shard_bounds(base.select("k"), 4 * parts)
    coded = base.mapInArrow(_tokenise(tokenizer, end_id, bounds), "shard long, doc_id long, ids binary")
    tokens = materialize(coded.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids")), "tokens")
    counts = np.zeros(codes, np.int64)
    table = tokens.select("ids").mapInArrow(_tally(width, codes), "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    counts[table["id"].to_numpy()] = table["c"].to_numpy()
    lengths = code_lengths(counts)
    share = spark.sparkContext.broadcast
    schema = "shard long, first long, crc long, last long, n long, path string"
    files = materialize(tokens.mapInArrow(_write(folder, width, share(lengths), share(canonical_codes(lengths)), end_id), schema), "file-list")
    order = Window.partitionBy(F.lit(0)).orderBy("shard", "first", "crc", "last", "path")
    return files.withColumn("before", F.sum("n").over(order) - F.col("n"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of ``write_token_files``."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "before").repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write and read back all documents.

    Null and empty texts hold the end id alone. Repeated rows follow each other; rows with one doc_id are ordered by
    a checksum of their ids. A null doc_id comes first. An empty table gives no file and no row. Strings of added tokens
    inside texts become those tokens, as the library's plain call does. Other columns are ignored.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id))
