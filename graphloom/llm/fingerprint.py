"""Invertible Bloom lookup sketches of documents (operator 4). DataFrame and SQL functions only.

The functions on numpy arrays and plain texts read and write the same format outside Spark: the operator does not
call them.
"""

from __future__ import annotations

import base64
import re
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Cells of a block of a sketch, in three parts.
PART = 3
CELLS = 3 * PART
#: Digests in a block of a sketch, at most.
BLOCK = 4
#: Hash functions that a block is tried with: two digests with the same cells get stuck. About one in five does.
SALTS = 64
#: A sentence of more characters is cut again, by its content.
LONG = 160
#: What is longer than twice that even so is cut after an atom whose hash is the least of as many on both sides.
REACH = 8
#: An atom is a word with its space; beyond so many characters without a space, each is an atom.
LONG_WORD = 24
#: Hash functions that two sketches are laid out with, one after another: each settles more than a third of what is left.
LAYOUTS = 64
#: Rows of ids in a range of the order of documents, about.
RANGE_ROWS = 500_000

SENTENCE = "\n| (?<=[^m-z][.!?] )"
#: A long sentence is cut at a space between letters of these kinds, wherever it stands.
PHRASE = " (?<=[dgor0-4] )(?=[a-dm-pw])"
ATOM = f"(?<= )|(?<=[^ ]{{{LONG_WORD}}})"
#: The same as Java has it, which measures in units of 16 bits and could cut between two of them.
ATOM_SQL = f"(?<= )|(?<=[^ ]{{{LONG_WORD},{2 * LONG_WORD}}})(?![\\\\x{{DC00}}-\\\\x{{DFFF}}])"
#: A cell as it is written: xor of digests, count, xor of check hashes.
CELL = np.dtype([("k", ">u8"), ("c", ">i2"), ("h", ">u4")])


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body``, where ``name`` stands for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut_sql(p: str) -> str:
    """SQL for the digests of a piece cut at the least hashes. Whether it is cut at a place depends on the atoms beside it alone."""
    least = f"hs[i] <= hs[i - 1] AND hs[i] <= hs[i + 1] AND forall(sequence(2, {REACH}), d -> hs[i] <= hs[i - d] AND hs[i] <= hs[i + d])"
    ends = f"concat(array(-1), filter(sequence({REACH}, size(hs) - 1 - {REACH}), i -> {least}), array(size(hs) - 1))"
    hashed = "transform(sequence(1, size(b) - 1), j -> xxhash64(array_join(slice(ws, b[j - 1] + 2, b[j] - b[j - 1]), '')))"
    cut = _let("transform(ws, w -> xxhash64(w))", "hs", _let(ends, "b", hashed))
    return _let(f"filter(split({p}, '{ATOM_SQL}'), w -> w <> '')", "ws", f"IF(size(ws) > {2 * REACH}, {cut}, array(xxhash64({p})))")


def digests_sql(text: str) -> str:
    """SQL for the distinct digests of ``text``, in order, see ``digests``."""
    phrases = f"flatten(transform(split(p, '{PHRASE}'), q -> IF(length(q) > {2 * LONG}, {_cut_sql('q')}, array(xxhash64(q)))))"
    pieces = f"filter(split({text}, '{SENTENCE}'), p -> p <> '')"
    return f"array_sort(array_distinct(flatten(transform({pieces}, p -> IF(length(p) > {LONG}, {phrases}, array(xxhash64(p)))))))"


#: The numbers of ``mix`` as SQL has them.
_STEP, _MIX1, _MIX2 = (x - 2**64 for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(started: str, last: str) -> str:
    """SQL for ``mix`` of an array of digests that the salt is added to, and ``last``, a lambda, of each."""
    first = f"transform({started}, x -> (x ^ shiftrightunsigned(x, 30)) * {_MIX1}L)"
    second = f"transform({first}, x -> (x ^ shiftrightunsigned(x, 27)) * {_MIX2}L)"
    return f"transform(transform({second}, x -> x ^ shiftrightunsigned(x, 31)), {last})"


def _masks(keys: str, salt: str) -> str:
    """SQL for each digest's cells as a number: four bits a cell, 1 where the digest is."""
    started = ", ".join(f"transform({keys}, k -> k + ({salt} * 3 + {j + 1}) * {_STEP}L)" for j in range(3))
    cell = f"((shiftrightunsigned(x, 1) % {PART}) * 2 + (x & 1)) % {PART}"  # of x without a sign
    one = f"(x, i) -> shiftleft(1L, cast(4 * ({PART} * (i div size({keys})) + {cell}) as int))"
    return _let(_mixed(f"concat({started})", one), "w", f"transform({keys}, (k, i) -> w[i] | w[i + size({keys})] | w[i + 2 * size({keys})])")


def _peels(masks: str) -> str:
    """SQL for whether peeling lists all digests of a block: in the sketch of a set a cell can be peeled if and only if
    its count is 1, so the rounds are gone through by counts, which are the sums of the masks."""
    part = 16**PART - 1
    alone = " OR ".join(f"(((t & (m * 15)) ^ m) & {part << 4 * PART * j}L) = 0" for j in range(3))
    step = _let("aggregate(left, 0L, (t, m) -> t + m)", "t", f"filter(left, m -> NOT ({alone}))")
    rounds = f"sequence(1, {BLOCK})"
    return f"aggregate({rounds}, {masks}, (left, r) -> IF(size(left) = 0, left, {step}), left -> size(left) = 0)"


def _block_sql() -> str:
    """SQL for block g of a sketch, with the digests ``ks``, as a string: the first hash function that it peels with, the cells."""
    tried = _let(_masks("ks", "s"), "ms", f"IF({_peels('ms')}, named_struct('s', s, 'ms', ms), f)")
    found = f"aggregate(sequence(0L, {SALTS - 1}L), named_struct('s', -1L, 'ms', cast(array() as array<bigint>)), (f, s) -> IF(f.s >= 0, f, {tried}))"
    checks = _mixed(f"transform(ks, k -> k + 78 * {_STEP}L)", "x -> x & 4294967295L")
    entries = _let(checks, "hs", "transform(ks, (k, i) -> named_struct('k', k, 'm', f.ms[i], 'h', hs[i]))")
    fold = "aggregate(es, 0L, (x, e) -> IF((e.m & b) <> 0, {}, x))"
    rest = f"hex({2**48}L + {fold.format('x + 4294967296L')} + {fold.format('x ^ e.h')})"
    cell = f"concat(lpad(hex({fold.format('x ^ e.k')}), 16, '0'), substr({rest}, 2))"
    bits = f"array({', '.join(f'{16**c}L' for c in range(CELLS))})"
    body = _let(entries, "es", f"base64(unhex(array_join(transform({bits}, b -> {cell}), '')))")
    return _let(found, "f", f"IF(f.s < 0, raise_error('a block of a sketch gets stuck with all hash functions'), concat(g, ':', f.s, ':', {body}))")


def sketch_sql(keys: str) -> str:
    """SQL for the sketch of an array of distinct digests in order, as a string.

    Each block holds the next ``BLOCK`` digests, with the first hash function that it can be peeled with by itself: so a
    sketch lists its whole set and depends on it alone, and no block is ever too full.
    """
    blocks = f"greatest(1, cast(ceil(size({keys}) / {float(BLOCK)}D) as int))"
    each = _let(f"slice({keys}, g * {BLOCK} + 1, {BLOCK})", "ks", _block_sql())
    return f"concat(size({keys}), '.', {blocks}, '.', IF(size({keys}) = 0, '', array_join(transform(sequence(0, {blocks} - 1), g -> {each}), '.')))"


def difference_sql(a: str, b: str) -> str:
    """SQL for the number of digests that the sketches which list ``a`` and ``b`` differ in.

    Both are laid out in cells under one hash function, twice as many as digests, and subtracted. Cells of nothing
    are settled, cells of one digest are peeled, and what the others hold is laid out under the next hash function.
    """
    none = "cast(array() as array<int>)"
    placed = "array_sort(transform(z.es, e -> named_struct('g', pmod(xxhash64(e.k, r), 2 * size(z.es)), 'k', e.k, 's', e.s)))"
    cuts = f"concat(array(0), IF(size(o) > 1, filter(sequence(1, size(o) - 1), i -> o[i].g <> o[i - 1].g), {none}), array(size(o)))"
    cell = "aggregate(es, named_struct('c', 0L, 'k', 0L, 'h', 0L), (x, e) -> named_struct('c', x.c + e.s, 'k', x.k ^ e.k, 'h', x.h ^ xxhash64(e.k, 77)))"
    left = "CASE WHEN x.c = 0 AND x.k = 0 AND x.h = 0 THEN 0 WHEN abs(x.c) = 1 AND xxhash64(x.k, 77) = x.h THEN 1 ELSE 2 END"
    one = _let("slice(o, b[j] + 1, b[j + 1] - b[j])", "es", _let(cell, "x", f"named_struct('left', {left}, 'es', es)"))
    cells = _let(cuts, "b", f"transform(sequence(0, size(b) - 2), j -> {one})")
    again = "transform(flatten(transform(filter(cs, c -> c.left = 2), c -> c.es)), e -> named_struct('k', e.k, 's', e.s))"
    step = _let(placed, "o", _let(cells, "cs", f"named_struct('d', z.d + size(filter(cs, c -> c.left = 1)), 'es', {again})"))
    both = ", ".join(f"transform({x}, k -> named_struct('k', k, 's', {s}L))" for x, s in ((a, 1), (b, -1)))
    end = "IF(size(z.es) = 0, z.d, raise_error('two sketches get stuck with all hash functions'))"
    return f"aggregate(sequence(1, {LAYOUTS}), named_struct('d', 0, 'es', concat({both})), (z, r) -> IF(size(z.es) = 0, z, {step}), z -> {end})"


@contextmanager
def _wrapping(spark: SparkSession):
    """Products of expressions that are built inside wrap around at 64 bits, as ``mix`` needs."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42)


def _cut(piece: str) -> list[str]:
    """The pieces of a text cut at the least hashes. Whether it is cut at a place depends on the atoms beside it alone."""
    atoms = [a for a in re.split(ATOM, piece) if a]
    if len(atoms) <= 2 * REACH:
        return [piece]
    hs = np.array([_hash(a) for a in atoms], np.uint64).view(np.int64)
    inner = hs[REACH:-REACH]
    least = np.ones(len(inner), bool)
    for d in range(1, REACH + 1):
        least &= (inner <= hs[REACH - d : len(hs) - REACH - d]) & (inner <= hs[REACH + d : len(hs) - REACH + d])
    ends = [0, *(np.flatnonzero(least) + REACH + 1).tolist(), len(atoms)]
    return ["".join(atoms[i:j]) for i, j in zip(ends, ends[1:])]


def digests(text: str) -> np.ndarray:
    """The distinct digests of ``text``: its lines are cut at the ends of sentences, but for those whose last letter is
    of the second half of the alphabet, long ones at spaces between letters of some kinds, and what is long after that
    again by its content."""
    out = []
    for piece in filter(None, re.split(SENTENCE, text)):
        for phrase in re.split(PHRASE, piece) if len(piece) > LONG else [piece]:
            out += [_hash(p) for p in (_cut(phrase) if len(piece) > LONG and len(phrase) > 2 * LONG else [phrase])]
    return np.unique(np.array(out, np.uint64))


def mix(k: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of digests, another for every salt."""
    x = k + (np.atleast_1d(np.asarray(salt, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def check(k: np.ndarray) -> np.ndarray:
    return (mix(k, 77) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _toggle(table: np.ndarray, k: np.ndarray, block: np.ndarray, salt: np.ndarray, sign: np.ndarray) -> None:
    """Insert digests into their blocks' cells, or delete them where the sign is negative."""
    h, at = check(k), block * CELLS
    for j in range(3):
        i = at + (mix(k, salt * 3 + j) % np.uint64(PART)).astype(np.int64) + j * PART
        np.add.at(table["c"], i, sign)
        np.bitwise_xor.at(table["k"], i, k)
        np.bitwise_xor.at(table["h"], i, h)


def cells(k: np.ndarray, block: np.ndarray, salt: np.ndarray, blocks: int) -> np.ndarray:
    """The sketch of digests dealt to blocks: count, xor of digests and xor of check hashes for each cell."""
    table = np.zeros(blocks * CELLS, np.dtype([("k", np.uint64), ("c", np.int64), ("h", np.uint32)]))
    _toggle(table, k, block, salt, np.ones(len(k), np.int64))
    return table


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.copy()
    out["c"] -= b["c"]
    out["k"] ^= b["k"]
    out["h"] ^= b["h"]
    return out


def peel(table: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, their blocks, whether each block is peeled to the end) of a sketch with a salt for each block."""
    table, ks, bs = table.copy(), [], []
    at = np.arange(len(table))
    while True:
        at = at[np.abs(table["c"][at]) == 1]
        at = at[check(table["k"][at]) == table["h"][at]]
        if not len(at) or len(ks) > CELLS:  # each round takes a digest of every block that is not stuck
            break
        k, b, c = table["k"][at], at // CELLS, table["c"][at]
        order = np.lexsort((k, b))
        k, b, c = k[order], b[order], c[order]
        first = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]
        k, b, c = k[first], b[first], c[first]
        _toggle(table, k, b, salts[b], -c)
        ks.append(k)
        bs.append(b)
        at = (np.unique(b)[:, None] * CELLS + np.arange(CELLS)).ravel()
    clean = ~((table["c"] != 0) | (table["k"] != 0) | (table["h"] != 0)).reshape(-1, CELLS).any(axis=1)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty.astype(np.uint64), *ks]), np.concatenate([empty, *bs]), clean


def blocks_for(size: np.ndarray) -> np.ndarray:
    """Numbers of blocks of sketches of so many digests: powers of two."""
    return 2 ** np.ceil(np.log2(np.maximum(size, BLOCK) / BLOCK)).astype(np.int64)


def _dealt(k: np.ndarray, owner: np.ndarray, blocks: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest, and where each owner's blocks begin."""
    start = np.r_[0, np.cumsum(blocks)]
    return start[owner] + (mix(k, 1000 + salt) % blocks[owner].astype(np.uint64)).astype(np.int64), start


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def sketches(sets: list[np.ndarray]) -> tuple[list[str], list[np.ndarray]]:
    """The sketch of each set of digests, as a string, and what peeling it lists.

    A sketch has as few blocks, a power of two, as all can be peeled with by themselves, each with the first of SALTS
    hash functions that it can be: it lists its whole set, so it can be compared with a sketch of any size. All this
    depends on the set alone: equal texts have equal sketches. A set whose sketch gets stuck is sketched again in
    twice the blocks.
    """
    texts, listed = [""] * len(sets), [np.zeros(0, np.uint64)] * len(sets)
    left = np.arange(len(sets))
    blocks = blocks_for(np.array([len(s) for s in sets]))
    while len(left):
        k, owner = _flat([sets[i] for i in left])
        g, start = _dealt(k, owner, blocks[left])
        salts = np.full(start[-1], -1)
        table, found = cells(k[:0], g[:0], g[:0], start[-1]), []
        for salt in range(SALTS):
            open_ = salts < 0
            mine = open_[g]
            tried = np.full(start[-1], salt)
            one = cells(k[mine], g[mine], tried[g[mine]], start[-1])
            got, at, clean = peel(one, tried)
            new = open_ & clean
            salts[new] = salt
            whole = np.repeat(new, CELLS)
            table[whole] = one[whole]
            found.append((got[new[at]], at[new[at]]))
            if (salts >= 0).all():
                break
        got, at = (np.concatenate(x) for x in zip(*found))
        whose = np.searchsorted(start, at, side="right") - 1
        order = np.lexsort((got, whose))
        got, begins = got[order], np.searchsorted(whose[order], np.arange(len(left) + 1))
        raw, used = table.astype(CELL), np.zeros(start[-1], bool)
        used[g] = True
        again = []
        for i, s in enumerate(left):
            mine = range(start[i], start[i + 1])
            if (salts[start[i] : start[i + 1]] < 0).any():
                again.append(s)
                continue
            listed[s] = got[begins[i] : begins[i + 1]]
            body = [f"{b - start[i]}:{salts[b]}:" + base64.b64encode(raw[b * CELLS : (b + 1) * CELLS].tobytes()).decode() for b in mine if used[b]]
            texts[s] = f"{len(listed[s])}.{blocks[s]}." + ".".join(body)
        left = np.array(again, np.int64)
        blocks[left] *= 2
    return texts, listed


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The Jaccard index of each pair of sets that sketches list: both are laid out in as many blocks as they need
    together, subtracted and peeled; blocks that get stuck are laid out in more, with other hash functions."""
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    ka, oa = _flat(a)
    kb, ob = _flat(b)
    pair, blocks, salt = np.arange(len(a)), blocks_for(na + nb), 0
    d = np.zeros(len(a), np.int64)
    while len(pair):
        ga, start = _dealt(ka, oa, blocks, salt)
        gb, _ = _dealt(kb, ob, blocks, salt)
        salts = np.full(start[-1], salt)
        _, at, clean = peel(subtract(cells(ka, ga, salts[ga], start[-1]), cells(kb, gb, salts[gb], start[-1])), salts)
        owner = np.repeat(np.arange(len(pair)), blocks)
        np.add.at(d, pair[owner[at[clean[at]]]], 1)
        stuck = np.flatnonzero(~clean)
        name = np.full(start[-1], -1)
        name[stuck] = np.arange(len(stuck))
        ka, oa = ka[name[ga] >= 0], name[ga][name[ga] >= 0]
        kb, ob = kb[name[gb] >= 0], name[gb][name[gb] >= 0]
        size = np.bincount(oa, minlength=len(stuck)) + np.bincount(ob, minlength=len(stuck))
        pair, blocks, salt = pair[owner[stuck]], np.maximum(2, -(-size // (BLOCK // 2))), salt + 1
    return np.where(na + nb == 0, 1.0, (na + nb - d) / np.maximum(na + nb + d, 1))


def previous(ids: DataFrame) -> DataFrame:
    """(k, h, pk, ph) for rows (k, h) distinct by both: the row before each, descending, in a circle.

    The rows are parted into ranges of (k, h) by their quantiles, so a range holds its share whatever the ids are;
    each is ordered by itself, and the ends of the ranges, one row each, tell what comes before their first rows.
    """
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // RANGE_ROWS))
    ranged = materialize(ids.select("k", "h").repartitionByRange(parts, "k", "h").select("k", "h", F.spark_partition_id().alias("run")), "ranges")
    row = F.struct("k", "h")
    inside = ranged.withColumn("p", F.lag(row).over(Window.partitionBy("run").orderBy(F.col("k").desc(), F.col("h").desc())))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("e").desc())  # one row a range
    last = F.last("e").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ranged.groupBy("run").agg(F.min(row).alias("e")).select("run", F.coalesce(F.lag("e").over(order), last).alias("e"))
    joined = inside.join(F.broadcast(materialize(ends, "range_ends")), "run").withColumn("p", F.coalesce("p", "e"))
    return joined.select("k", "h", F.col("p.k").alias("pk"), F.col("p.h").alias("ph"))


NO_ID = -(2**63)


def edited_versions(docs: DataFrame) -> DataFrame:
    """(k, h, n, edited, text, pk, ph): each text, its edited text, and the document that it is the next of.

    The last third of the code points is replaced by the first as many of the next document, descending doc_id.
    The texts are shuffled once, by their ids; a third of them goes to the document before.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    lengths = materialize(base.select("k", "h", F.length("text").cast("long").alias("n")), "ids")
    single = materialize(lengths.distinct(), "distinct_ids")
    order = previous(single)
    order = materialize(order.join(single.select(F.col("k").alias("pk"), F.col("h").alias("ph"), F.col("n").alias("pn")), ["pk", "ph"]).select("k", "h", "pk", "ph", "pn"), "order")
    own = base.join(order, ["k", "h"])
    givers = own.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.expr("left(text, cast(pn div 3 as int))").alias("head"))
    if single.count() < lengths.count():  # rows that repeat give the same to the one before
        givers = givers.dropDuplicates(["k", "h"])
    both = own.join(givers, ["k", "h"]).withColumn("n", F.length("text").cast("long"))
    return both.select("k", "h", "n", F.expr("concat(left(text, cast(n - n div 3 as int)), left(head, cast(n div 3 as int)))").alias("edited"), "text", "pk", "ph")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A text's fingerprint is an invertible Bloom lookup sketch of the digests of its sentences, long ones cut by
    content: ``<digests>.<blocks>.<block>:<hash function>:<cells>...``, 14 bytes a cell in base 64.
    A sketch is as large as it must be to list its own digests, see ``sketch_sql``. Likeness, the Jaccard index of the
    two digest sets, comes from what the sketches list: it is laid out in as many cells as both together need,
    subtracted and peeled, see ``difference_sql``.

    Null texts are empty; an empty text has an empty sketch, and two empty texts are alike (1.0). Equal texts have
    equal fingerprints. A single document is its own next. Rows with one doc_id are ordered by a hash of the text;
    repeated rows count as one in the order and each gives a row. A null doc_id comes last. Other columns are
    ignored. Blocks and cells are bounded, so a text of any length takes time in proportion.
    """
    with _wrapping(docs.sparkSession):
        versions = edited_versions(docs).select("k", "h", "n", "pk", "ph", F.sha2("edited", 256).alias("sha"), F.expr(digests_sql("text")).alias("a"), F.expr(digests_sql("edited")).alias("e"))
        sets = materialize(versions, "digests")
        # the digests of each document go to the one that it is the next of; strings, several times their size, are made
        # after the last shuffle
        nexts = sets.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.col("a").alias("x")).dropDuplicates(["k", "h"])
        both = sets.join(nexts, ["k", "h"]).select("k", "n", "sha", "a", "e", "x", *(F.expr(difference_sql("a", c)).alias(f"d{c}") for c in "ex"))
        near = {c: F.expr(f"IF(size(a) + size({c}) = 0, 1.0D, (size(a) + size({c}) - d{c}) / (size(a) + size({c}) + d{c}))") for c in "ex"}
        return both.select(
            F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
            F.col("n").alias("n_chars"),
            F.col("sha").alias("edited_sha256"),
            F.expr(sketch_sql("a")).alias("fingerprint"),
            F.expr(sketch_sql("e")).alias("edited_fingerprint"),
            near["e"].alias("near_edited"),
            near["x"].alias("near_next"),
        )
