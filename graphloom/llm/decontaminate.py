"""Test items inside documents by size-partitioned MinHash containment (operator 5). DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a table that may be broadcast, of about 40 bytes each; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20
WORD_BREAK = "[^\\\\p{L}\\\\p{N}]+"


def with_shingles(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """``df`` without ``text`` and with ``sh``: distinct hashes of its runs of ``n`` words (letters and digits,
    lower case), or of the whole where there are fewer; empty for null."""
    words = F.expr(f"filter(split(lower(coalesce({text}, '')), '{WORD_BREAK}'), w -> w <> '')")
    hashed = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w))).drop(text)
    run = ", ".join(f"_w[i + {j}]" for j in range(n))
    few = "aggregate(_w, cast(size(_w) as bigint), (a, x) -> xxhash64(a, x))"
    return hashed.withColumn("sh", F.expr(f"CASE WHEN size(_w) >= {n} THEN array_distinct(transform(sequence(0, size(_w) - {n}), i -> xxhash64({run}))) WHEN size(_w) > 0 THEN array({few}) ELSE cast(array() as array<bigint>) END")).drop("_w")


def partitioned(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures, partitions) of items (key, ni, sh).

    A partition holds the items of one size class (powers of two). The signature of an item is made of its smallest
    hashes: as many as its class needs for a document with ``percent`` of any item of the class to hold one of them,
    (100 - percent) in a hundred of the class's largest size, and one more. A partition is (class, the least size of
    a document that contains one of its items, the largest hash in its signatures): a document's own signature for
    the partition is made of its hashes up to that one, so partitions of large items probe with a part of its set.
    """
    sized = entries.withColumn("class", F.floor(F.log2("ni")).cast("int"))
    most = F.expr("shiftleft(2L, class) - 1")
    kept = F.floor(most * (100 - percent) / 100.0).cast("int") + 1
    signatures = sized.withColumn("v", F.explode(F.slice(F.array_sort("sh"), 1, kept))).select("class", "v", "key", "ni")
    partitions = signatures.groupBy("class").agg(F.max("v").alias("top"), F.min("ni").alias("least")).select("class", "top", F.ceil(F.col("least") * percent / 100.0).cast("int").alias("room"))
    return signatures, partitions


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): items of which a document has ``percent`` or more.

    Items are partitioned by the size of their shingle sets, and each partition has MinHash signatures of its own
    length, see ``partitioned``. One scan of the documents probes every partition that a document is large enough
    for with the document's signature for it; whatever shares a value is a candidate, so none is missed. Candidates,
    (document, item) pairs, are then verified on the full sets of both: texts of documents without a candidate are
    not shingled again, and none is shuffled unless there are very many candidates.

    A pair of a document and an item is found by their id and text, so repeated ids do not mix. Null and empty texts
    have no shingle and match nothing; a text or item with fewer than ``n`` words is one shingle, so it matches only
    an equal one. Repeated rows and repeated ids give one row for each pair of ids, the one with the largest
    containment; null ids are ids. Empty tables give no rows; other columns are ignored.
    """
    # written before it is filtered: a filter on ``sh`` would be moved below and repeat its whole expression
    own = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("key"), "text")
    entries = materialize(with_shingles(own, "text", n), "items").withColumn("ni", F.size("sh")).where("ni > 0")
    signatures, partitions = partitioned(entries, percent)
    signatures = materialize(signatures, "signatures")
    partitions = [r.asDict() for r in materialize(partitions, "partitions").collect()]  # one a power of two
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    probes = with_shingles(base.select("h", "text"), "text", n)
    # hashes of a document that some partition probes with, given the document's size
    wanted = " OR ".join(f"(nd >= {p['room']} AND v <= {p['top']}L)" for p in partitions if p["top"] != -(2**63)) or "false"
    if any(p["top"] == -(2**63) for p in partitions):
        wanted = "true"
    exploded = probes.select("h", F.size("sh").alias("nd"), F.explode_outer("sh").alias("v"))  # outer: no filter on ``sh`` is inferred
    hits = exploded.where(wanted).join(_bounded(signatures), "v").where(f"100 * nd >= {percent} * ni")
    found = materialize(hits.select("h", "key").distinct(), "candidates")
    texts = base.join(_bounded(materialize(found.select("h").distinct(), "found")), "h", "left_semi").distinct()
    sets = materialize(with_shingles(texts, "text", n), "document_sets")
    sized = entries.select("key", "item_id", "ni", F.col("sh").alias("ish"))
    both = found.join(sets, "h").join(sized, "key").withColumn("n_shared", F.size(F.array_intersect("ish", "sh")))
    both = both.where(f"100L * n_shared >= {percent}L * ni").select("doc_id", "item_id", F.col("ni").cast("long").alias("n_item_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("ni")).alias("containment"))
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item_shingles", "m.n_shared", "m.containment")
