"""Near-duplicate documents by bottom-k sketches of one hash function (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialize, prepare, probe
from .components import connected_components
from .textops import shingles, text_slices, words

#: Values kept in a sketch.
K = 64
#: Sketch values that two sets at the threshold share at least: 48 are expected of 64, with deviation 3.5.
LEAST_SHARED = 26
#: Estimated likeness below which a candidate is dropped: more than five deviations under the threshold.
LEAST_ESTIMATE = 0.45
#: Rounds that link what is open to one member of each list, before all pairs that are still open are made.
ROUNDS = 3
SIGN = np.uint64(1 << 63)


def shingle_sets(column: pa.Array, n: int = 5):
    """Sorted distinct shingle hashes of each text, as signed longs in the order of the hashes."""
    for first, last, data, offsets in text_slices(column):
        _, h, of = words(data, offsets)
        sh, at = shingles(h, of, n)
        sh = (sh ^ SIGN).view(np.int64)
        for i in range(last - first):
            own = np.sort(sh[at[i] : at[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sketch(k: int, n: int):
    def run(batches):
        for b in batches:
            sizes, digests, parts = [], [], []
            for own in shingle_sets(b.column(1), n):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                parts.append(own[:k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(parts)], ["doc_id", "n", "cls", "sk"])

    return run


def _sets(n: int):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            done, digests, parts, total = 0, [], [], 0
            for own in shingle_sets(b.column(1), n):
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                parts.append(own)
                total += len(own)
                if total > 1 << 18:
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(parts)), pa.array(digests, pa.binary()), _lists(parts)], ["doc_id", "cls", "items"])
                    done, digests, parts, total = done + len(parts), [], [], 0
            yield pa.RecordBatch.from_arrays([ids.slice(done, len(parts)), pa.array(digests, pa.binary()), _lists(parts)], ["doc_id", "cls", "items"])

    return run


#: SQL for a set's hashes as a bitmap of 1,024 bits.
_BITS = "transform(sequence(0L, 15L), i -> aggregate(filter(items, x -> (x & 15L) = i), 0L, (s, x) -> s | shiftleft(1L, cast(shiftright(x, 4) & 63L as int))))"


def _close(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = K, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    1. One pass over the texts gives each row the size, a digest and the ``k`` smallest hashes of its shingle set.
       Rows of equal sets form a class, aggregated before the shuffle.
    2. Inverted lists over the classes' values: a class is listed under its rarest values only, as many as a set at
       the threshold can miss; a value that one class holds makes no list. A passage shared by many documents is
       thus no list of its own unless it makes up most of a document.
    3. Each list compares its members with its hub, and these links are contracted. Classes of lists that still
       hold different components are listed anew by their full sets, under the rarest quarter of the shingles, which
       leaves out common passages exactly. Entries that by their list's sizes can be of no pair go; rounds of
       comparing with one member of each list's largest component contract the others; what is still open is
       compared across components. Pairs inside a component are never made.
    4. Candidates must have sizes and union-sketch estimates that allow the threshold; then the full sets are
       intersected. Links are contracted to components; ``kept`` marks the smallest id of each.

    Null and empty texts, and texts without a word, have no shingle and are linked with nothing. Repeated rows are
    rows of one class. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select("doc_id", "text")
    sk = materialize(base.mapInArrow(_sketch(k, n), "doc_id long, n long, cls binary, sk array<long>"), "sketches")
    classes = materialize(sk.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("sk").alias("sk")), "classes")
    links = _links(base, classes, percent, k, n)
    label = connected_components(links)
    # a component's id is the smallest id of its classes
    named = materialize(label.join(classes.select(F.col("cls").alias("node"), "rep"), "node"), "labels")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = materialize(named.join(smallest, "label").select(F.col("node").alias("cls"), "component_id"), "components")
    own = materialize(classes.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id")), "class_components")
    out = sk.select("doc_id", "n", "cls").join(own, "cls", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _links(base: DataFrame, classes: DataFrame, percent: int, k: int, n: int) -> DataFrame:
    items = classes.select("cls", "n", F.explode("sk").alias("v"))
    counts = items.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = items.join(materialize(counts, "counts"), "v")
    # of min(n, k) values a match has at least `need`: it shares one of the (values - need + 1) rarest
    need = F.when(F.col("n") * 100 < k * percent, F.ceil(F.col("n") * percent / 100.0)).otherwise(F.lit(LEAST_SHARED))
    lists = shared.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("l"))
    keep = (F.least("n", F.lit(k)) - need + 1) - (F.least("n", F.lit(k)) - F.size("l"))
    idx = lists.withColumn("keep", keep.cast("int")).where("keep > 0").select("cls", "n", F.size("l").alias("m"), F.explode(F.slice("l", 1, F.least("keep", F.size("l")))).alias("e")).select("cls", "n", "m", "e.v")
    idx = materialize(idx, "lists")
    cand = materialize(classes.join(idx.select("cls").distinct(), "cls", "left_semi"), "candidates")
    bits = materialize(bitmap(cand.select("rep"), "rep"), "bits")
    sets = probe(base, "doc_id", bits).mapInArrow(_sets(n), "doc_id long, cls binary, items array<long>")
    sets = materialize(sets.join(cand.select(F.col("rep").alias("doc_id"), "cls"), ["doc_id", "cls"], "left_semi").dropDuplicates(["cls"]).select("cls", "items"), "sets")
    # the hub of a list is the member with the most values that others have too: the likely origin of its copies
    hubs = materialize(idx.groupBy("v").agg(F.max(F.struct("m", "cls", "n")).alias("h")).select("v", "h.cls", "h.n").toDF("v", "a", "na"), "hubs")
    star = idx.join(hubs, "v").where((F.col("cls") != F.col("a")) & _close("n", "na", percent)).select("a", F.col("cls").alias("b")).distinct()
    first = materialize(_verify(star, cand, sets, percent, k), "links")
    label = materialize(connected_components(first).select(F.col("node").alias("cls"), "label"), "first_labels")
    tagged = materialize(idx.join(label, "cls", "left").select("v", "cls", "n", F.coalesce("label", "cls").alias("label")), "tagged")
    rest = _open(tagged).select("cls", "n", "label").distinct()
    # what is left is listed by full sets: exactly, the rarest quarter of a document's shingles
    deep = materialize(rest.join(sets, "cls").select("cls", "n", "label", F.explode("items").alias("v")), "deep")
    counts = materialize(deep.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    full = deep.join(counts, "v").groupBy("cls", "n", "label").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("l"))
    keep = F.size("l") - F.ceil(F.col("n") * percent / 100.0) + 1
    full = full.withColumn("keep", keep.cast("int")).where("keep > 0").select("cls", "n", F.size("l").alias("m"), "label", F.posexplode(F.slice("l", 1, F.least("keep", F.size("l")))).alias("at", "e")).select("e.v", "cls", "n", (F.col("m") - F.col("at")).alias("m"), "label")
    full = materialize(_bounded(materialize(full, "full_lists"), percent), "bounded")
    some = materialize(full.select("cls").distinct(), "some")
    cand = materialize(cand.join(some, "cls", "left_semi"), "some_candidates")
    sets = materialize(sets.join(some, "cls", "left_semi"), "some_sets")
    bits = sets.select("cls", F.expr(_BITS).alias("bits")).select("cls", *(F.col("bits")[i].alias(f"x{i}") for i in range(16)))
    full = materialize(full.join(bits, "cls"), "open")
    # members of each list that are not of its most frequent component are compared with one that is, another each
    # round, so that a large group of variants is one component before its pairs are made
    found = first
    full = _ranked(full)
    for salt in range(ROUNDS):
        # first the one with the most left in common with others, then any
        rank = F.xxhash64("cls", "v", F.lit(salt)) if salt else F.struct(F.col("m") - F.col("n"), "m", "cls")
        hub = full.where("label = most").groupBy("v").agg(F.max_by(F.struct(*(x for x in full.columns if x not in ("v", "most"))), rank).alias("h")).select("v", "h.*")
        links = materialize(_verify(_pairs(full.where("label <> most").drop("most"), materialize(hub, "hubs"), percent), cand, sets, percent, k), "links")
        if links.isEmpty():
            break
        found = found.union(links)
        names = full.select("cls", "label").distinct()
        joined = links.join(names.toDF("a", "la"), "a").join(names.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        label = materialize(connected_components(joined).toDF("label", "to"), "labels")
        full = full.drop("most").join(label, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        full = _ranked(materialize(_bounded(materialize(full, "relabelled"), percent), "open"))
    # of two entries with different labels one at least is not of the list's most frequent label
    minor = materialize(full.where("label <> most").drop("most"), "minor")
    return found.union(_verify(_pairs(minor, full.drop("most"), percent), cand, sets, percent, k))


def _ranked(lists: DataFrame) -> DataFrame:
    """The entries of the lists with the list's most frequent component, ``most``."""
    major = lists.groupBy("v", "label").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "label")).alias("m")).select("v", F.col("m.label").alias("most"))
    return lists.join(materialize(major, "major"), "v")


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of entries of one list that are of different components and whose bounds allow the threshold."""
    side = lambda df, c: df.toDF(*("v" if x == "v" else f"{x}{c}" for x in df.columns))
    # two sets share at most what either has left in its list (shingles that some other set has, rarest first) from
    # the first entry in common on: m of n; and at most what the bits that only one of them has leave
    only = " + ".join("bit_count(x{0}{{0}} & ~x{0}{{1}})".format(i) for i in range(16))
    rest = f"least(na - ({only.format('a', 'b')}), nb - ({only.format('b', 'a')}))"
    both = side(left, "a").join(side(right, "b"), "v").where("labela <> labelb")
    for most in ("least(ma, mb)", rest):
        both = both.where(f"100 * ({most}) >= {percent} * (na + nb - {most})")
    return both.select(F.least("clsa", "clsb").alias("a"), F.greatest("clsa", "clsb").alias("b")).distinct()


def _bounded(lists: DataFrame, percent: int) -> DataFrame:
    """The entries of the lists (v, cls, n, m, label, ...) that hold more than one component, without those that no
    pair needs: with what is left in both lists a set of m must reach the threshold beside the list's smallest set."""
    spans = lists.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("smallest"), F.max("m").alias("longest")).where("lo <> hi").drop("lo", "hi")
    joined = lists.join(materialize(spans, "spans"), "v")
    # 100 * m >= percent * (n + other - m), where the other set has percent of n, and the smallest's size, at least
    enough = f"100L * (100 + {percent}) * least(m, longest) >= {percent} * (100L * n + greatest(100L * smallest, {percent}L * n))"
    return joined.where(enough).drop("smallest", "longest")


def _open(lists: DataFrame) -> DataFrame:
    """The entries of the lists (v, cls, n, label) that hold more than one component."""
    mixed = lists.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    return lists.join(materialize(mixed, "mixed"), "v")


def _verify(pairs: DataFrame, cand: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose union-sketch estimate allows the threshold and whose full sets reach it."""
    left = cand.select(F.col("cls").alias("a"), F.col("sk").alias("ska"))
    right = cand.select(F.col("cls").alias("b"), F.col("sk").alias("skb"))
    union = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, k)
    estimate = F.size(F.array_intersect(union, F.array_intersect("ska", "skb"))) / F.size(union)
    likely = materialize(pairs.join(left, "a").join(right, "b").where(estimate >= LEAST_ESTIMATE).select("a", "b"), "likely")
    both = likely.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(f"100L * i >= {percent}L * (na + nb - i)").select("a", "b")
