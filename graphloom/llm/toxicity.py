"""Weakly supervised toxicity scores (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .textops import BASE, BYTE, mix, powers, text_bytes, text_slices

#: Labelled rows that voters are mined from and the classifier is fitted on, at most: those with the smallest hashes.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: Voters mined for the toxic and for the clean class, at most: those with the best-supported odds.
MAX_VOTERS, MAX_CLEAN_VOTERS = 1024, 128
#: Least log odds of a voter for its class, one standard error subtracted.
LEAST_ODDS = 1.0
#: Lengths in bytes of the word beginnings that are pattern voters, beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Residual correlation from which on two voters repeat each other.
REPEATS = 0.6
ROUNDS = 6
#: Weight of a voter's first rates, beside those that the votes of all texts say: a voter that is mostly alone would
#: otherwise be judged by nothing but itself.
ANCHOR = 0.5
#: Weight of a clean text taken for toxic against a toxic one missed, where the border between the classes is set.
CLEAN_WEIGHT = 1.5
#: Surface patterns: shares of all bytes above which a pattern votes.
SURFACES = ((frozenset(b"!"), 0.004), (frozenset(b"?"), 0.004), (frozenset(b"*#$%&@"), 0.05), (frozenset(range(65, 91)), 0.2), (frozenset(range(48, 58)), 0.1))

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def units(data: np.ndarray, offsets: np.ndarray):
    """For each kind of unit its hashes and their texts: whole words (runs of letters), then beginnings of words."""
    n = len(data)
    if not n:
        return
    solid = LETTER[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return
    text = np.searchsorted(offsets, starts, "right") - 1
    seg = np.diff(starts, append=n)
    s0 = int(starts[0])
    at = np.arange(s0, n, dtype=np.int64) - np.repeat(starts, seg)
    value = np.where(solid[s0:], BYTE[data[s0:]] * powers(int(seg.max()))[at], np.uint64(0))
    size = np.add.reduceat(solid[s0:].astype(np.int64), starts - s0)
    yield mix(np.add.reduceat(value, starts - s0)), text
    p, h = powers(max(PREFIXES) + 1), np.zeros(len(starts), np.uint64)
    for j in range(max(PREFIXES)):
        h = h + BYTE[data[np.minimum(starts + j, n - 1)]] * p[j]
        if j + 1 in PREFIXES:
            longer = size > j + 1
            yield mix(h[longer] * BASE + np.uint64(j + 1)), text[longer]


def surfaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of votes for each text."""
    out = np.zeros((len(offsets) - 1, len(SURFACES)), bool)
    size = np.maximum(np.diff(offsets), 1)
    for k, (chars, share) in enumerate(SURFACES):
        table = np.zeros(256, np.int64)
        table[list(chars)] = 1
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) > share * size
    return out


def _features(batches):
    """Distinct unit hashes of each text, the beginnings that it has twice or more, and its surface votes as bits."""
    longs = pa.list_(pa.int64())
    for b in batches:
        for i in range(b.num_rows):
            data, offsets = text_bytes(b.column(2).slice(i, 1))
            found = [h for h, _ in units(data, offsets)]
            own = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            again, n = np.unique(np.concatenate(found[1:]), return_counts=True) if found else (own, own)
            votes = surfaces(data, offsets)[0] @ (1 << np.arange(len(SURFACES)))
            columns = [b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([x.view(np.int64)], longs) for x in (own, again[n > 1])), pa.array([votes], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "y", "f", "g", "s"])


def voter_tables(once: np.ndarray, twice: np.ndarray) -> dict:
    """Tables to find voters by unit hashes: those that vote if a unit occurs, those that vote if it occurs again."""
    seen = np.zeros(1 << 22, bool)
    for keys in (once, twice):
        seen[keys.view(np.uint64) >> np.uint64(42)] = True
    return {"once": once, "twice": twice, "seen": seen, "n": len(once) + len(twice) + len(SURFACES)}


def votes(tables: dict, column: pa.Array):
    """(first text, last text, text of each vote, voter): the votes of a column of texts, by runs of texts."""
    once, twice, seen = tables["once"], tables["twice"], tables["seen"]
    for first, last, data, offsets in text_slices(column):
        pairs = []
        for kind, (h, text) in enumerate(units(data, offsets) if len(once) + len(twice) else ()):
            maybe = seen[h >> np.uint64(42)]
            h, text = h[maybe].view(np.int64), text[maybe]
            for keys, base, least in ((once, 0, 1), (twice, len(once), 2)):
                if len(keys) and (kind or least == 1):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    ok = keys[at] == h
                    pair, n = np.unique(text[ok] * tables["n"] + base + at[ok], return_counts=True)
                    pairs.append(pair[n >= least])
        text, k = np.nonzero(surfaces(data, offsets))
        pairs.append(text * tables["n"] + len(once) + len(twice) + k)
        pair = np.unique(np.concatenate(pairs))
        yield first, last, pair // tables["n"], pair % tables["n"]


def _patterns(shared):
    """The distinct sets of votes of each batch, and how many texts cast them."""

    def run(batches):
        tables = voter_tables(*shared.value)
        for b in batches:
            for first, last, text, voter in votes(tables, b.column(0)):
                ends = np.searchsorted(text, np.arange(last - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(voter.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(np.ones(last - first, np.int64))], ["hits", "c"])

    return run


def _dense(batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(votes as rows of a matrix, weights) of a batch of patterns."""
    hits = batch.column(0)
    x = np.zeros((batch.num_rows, n), np.float32)
    x[np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy())), hits.flatten().to_numpy()] = 1
    return x, batch.column(1).to_numpy().astype(float)


def _together(n: int):
    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            x, c = _dense(b, n)
            total += x.T @ (x * c[:, None].astype(np.float32))
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[i].tobytes() for i in used], pa.binary())], ["i", "row"])

    return run


def _sum_rows(table: pa.Table) -> pa.Table:
    row = sum(np.frombuffer(r, float) for r in table["row"].to_pylist())
    return pa.table([table["i"][:1], pa.array([row.tobytes()], pa.binary())], ["i", "row"])


#: Rows of the matrix of correlations that are worked on at a time.
BLOCK = 64
#: Bins of evidence, 1/32 wide.
BINS, LOW = 4096, -64.0


def _evidence(weights: np.ndarray):
    """How many texts have evidence of each size."""

    def run(batches):
        total = np.zeros(BINS)
        for b in batches:
            x, c = _dense(b, len(weights))
            total += np.bincount(np.clip(((x @ weights - LOW) * 32).astype(int), 0, BINS - 1), weights=c, minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bin", "c"])

    return run


def _expect(weights: np.ndarray, bias: float):
    """Sums over texts: of posteriors and their products, then for each voter of posteriors where it votes."""

    def run(batches):
        total = np.zeros(4 + len(weights))
        for b in batches:
            x, c = _dense(b, len(weights))
            q = _sigmoid(x @ weights + bias)
            total[:4] += (c * q).sum(), (c * q * q).sum(), (c * q * (1 - q)).sum(), (c * (1 - q) ** 2).sum()
            total[4:] += (c * q) @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(column: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == part


def balance(counts: np.ndarray, prior: float) -> float:
    """The bias that makes the mean posterior ``prior``, by the counts of texts in each bin of evidence."""
    at, lo, hi = LOW + (np.arange(BINS) + 0.5) / 32, -80.0, 80.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (_sigmoid(at + mid) * counts).sum() > prior * counts.sum() else (mid, hi)
    return (lo + hi) / 2


def label_model(patterns: DataFrame, n: int, toxic: np.ndarray, clean: np.ndarray, prior: float, rounds: int = ROUNDS, anchor: float = ANCHOR) -> dict:
    """Voters' rates and correlations by expectation maximisation over ``patterns`` (hits, c): the votes of all texts.

    No label enters: a text's posterior comes from its votes alone. Each of the ``n`` voters votes at one rate on
    toxic and at another on clean texts, and speaks by the logarithm of their quotient; one that is silent says
    nothing. ``toxic`` and ``clean`` are the rates to start from, and weigh ``anchor`` in every later estimate. ``prior``, the share of toxic texts, stays, so the
    classes cannot change places. Residual correlations between voters, given the label, tell which repeat each
    other: the evidence of such is shared among them. What reaches the driver is bounded by the number of voters.
    """
    together = np.zeros((n, n))
    for r in patterns.mapInArrow(_together(n), "i int, row binary").groupBy("i").applyInArrow(_sum_rows, "i int, row binary").collect():
        together[r["i"]] = np.frombuffer(r["row"], float)
    total = float(patterns.agg(F.sum("c")).first()[0] or 0)
    a, b, share, rho = toxic, clean, np.ones(n), np.zeros((n, n))
    model = {}
    for _ in range(rounds):
        weights = (share * np.log(a / b)).astype(np.float32)
        counts = np.zeros(BINS)
        for r in patterns.mapInArrow(_evidence(weights), "bin int, c double").groupBy("bin").agg(F.sum("c").alias("c")).collect():
            counts[r["bin"]] = r["c"]
        bias = balance(counts, prior)
        sums = np.zeros(4 + n)
        for r in patterns.mapInArrow(_expect(weights, bias), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r["k"]] = r["v"]
        model = {"weights": weights, "bias": bias, "fires_on_toxic": a, "fires_on_clean": b}
        on, qq, qp, pp = sums[:4]
        fired = np.diag(together)
        one, none = sums[4:], fired - sums[4:]
        # cross-products of what is left of the votes once the rates of their texts' labels are taken off
        mean = one * a + none * b
        scale = np.sqrt(np.maximum(fired - mean - mean + qq * (a * a) + qp * (a * b + b * a) + pp * (b * b), 0)) + 1e-9
        share = np.ones(n)
        for i in range(0, n, BLOCK):  # some rows at a time: the driver holds two matrices and little more
            k = slice(i, i + BLOCK)
            left = together[k] - (np.outer(one[k], a) + np.outer(none[k], b)) - (np.outer(a[k], one) + np.outer(b[k], none))
            left += qq * np.outer(a[k], a) + qp * (np.outer(a[k], b) + np.outer(b[k], a)) + pp * np.outer(b[k], b)
            rho[k] = left / np.outer(scale[k], scale)
            np.fill_diagonal(rho[k, k], 1.0)
            share[k] = 1 / np.maximum(1, np.where(rho[k] > REPEATS, rho[k], 0).sum(1))
        a, b = ((found + anchor * first) / (1 + anchor) for found, first in (((one + 0.1) / (on + 1), toxic), ((none + 0.01) / (total - on + 1), clean)))
        a, b = np.clip(a, 1e-6, 1), np.clip(b, 1e-6, 1)
        model |= {"correlations": rho, "share": share}
    return model


class Votes:
    """The votes of a sample as its texts' voters one after another: a matrix of them is nearly all zeros, and would
    be the largest thing in the driver's memory. ``hits``: a list of voters for each text."""

    def __init__(self, hits: pa.ListArray, voters: int):
        sizes = np.diff(hits.offsets.to_numpy())
        self.texts, self.voters = len(hits), voters
        self.text, self.voter = np.repeat(np.arange(self.texts, dtype=np.int32), sizes), hits.flatten().to_numpy()

    def of_texts(self, w: np.ndarray) -> np.ndarray:
        """For each text the sum of ``w`` over its voters."""
        return np.bincount(self.text, weights=w[self.voter], minlength=self.texts)

    def of_voters(self, d: np.ndarray) -> np.ndarray:
        """For each voter the sum of ``d`` over its texts."""
        return np.bincount(self.voter, weights=d[self.text], minlength=self.voters)


def linear_classifier(x: Votes, q: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by Adam on the whole sample."""
    weight = weight / weight.sum()
    w, c = np.zeros(x.voters), -2.0
    m = v = np.zeros(x.voters + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.of_texts(w) + c, -30, 30)))
        d = (p - q) * weight
        g = np.append(x.of_voters(d) + ridge * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, c = w - step[:-1], c - step[-1]
    return w, float(c)


def _tops(mined: DataFrame, least: float, most: int, hits: str) -> DataFrame:
    return mined.where(F.col("z") > least).orderBy((F.col("z") * F.sqrt(hits)).desc(), "f", "twice").limit(most)


def _border(score: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the labelled rows best."""
    at = np.quantile(score, np.linspace(0, 1, 513))
    at = np.unique(np.concatenate([(at[1:] + at[:-1]) / 2, np.linspace(-4, 4, 161)]))
    gain = [(score[y == 1] >= t).mean() - CLEAN_WEIGHT * (score[y == 0] >= t).mean() for t in at]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    return float(at[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Mine voters from a bounded sample of the labelled rows of ``labels`` (doc_id, toxic) that are not held out, fit
    the label model to the votes of all rows of ``docs``, and the classifier to its posteriors on the sample."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = known.where("y = 1").orderBy(*order).limit(MAX_TOXIC).union(known.where("y = 0").orderBy(*order).limit(MAX_CLEAN))
    chosen = materialize(chosen, "sample")  # MAX_TOXIC + MAX_CLEAN rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), "y", "text")
    feats = sample.mapInArrow(_features, "h long, y int, f array<long>, g array<long>, s long")
    feats = materialize(feats.dropDuplicates(["y", "h"]), "features")  # copies count once
    totals = feats.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    model = {"once": np.zeros(0, np.int64), "twice": np.zeros(0, np.int64), "w": np.zeros(len(SURFACES)), "c": -4.0}
    if not totals[0] or not totals[1]:
        return model
    pos, neg = float(totals[0]), float(totals[1])
    each = F.explode(F.expr("concat(transform(f, x -> named_struct('f', x, 'twice', false)), transform(g, x -> named_struct('f', x, 'twice', true)))")).alias("e")
    mined = feats.select("y", each).groupBy("e.f", "e.twice").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("k")).where("t + k > 1")
    odds, error = F.log((F.col("t") + 0.5) / pos) - F.log((F.col("k") + 0.5) / neg), F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("k") + 0.5))
    mined = materialize(mined.select("f", "twice", "t", "k", odds.alias("o"), error.alias("e")).where(F.abs("o") - F.col("e") > LEAST_ODDS), "mined")
    found = _tops(mined.withColumn("z", F.col("o") - F.col("e")), LEAST_ODDS, MAX_VOTERS, "t").union(_tops(mined.withColumn("z", -F.col("o") - F.col("e")), LEAST_ODDS, MAX_CLEAN_VOTERS, "k"))
    found = sorted((r["twice"], r["f"], r["t"], r["k"]) for r in found.collect())
    if not found:
        return model
    once, twice = (np.array([f for w, f, _, _ in found if w == x], np.int64) for x in (False, True))
    shared = spark.sparkContext.broadcast((once, twice))
    patterns = docs.select("text").mapInArrow(_patterns(shared), "hits array<int>, c long").groupBy("hits").agg(F.sum("c").alias("c"))
    patterns = materialize(patterns, "patterns")
    x, y = _sample_votes(feats, once, twice)
    t = np.array([t for _, _, t, _ in found] + x.of_voters(y == 1)[len(found) :].tolist(), float)
    k = np.array([k for _, _, _, k in found] + x.of_voters(y == 0)[len(found) :].tolist(), float)
    fitted = label_model(patterns, x.voters, (t + 0.1) / (pos + 0.2), (k + 0.1 * pos / neg) / (neg + 0.2), sizes[1] / (sizes[0] + sizes[1]))
    q = _sigmoid(x.of_texts(fitted["weights"]) + fitted["bias"])
    # both classes weigh the same
    weight = np.where(q >= 0.5, 1 / max((q >= 0.5).sum(), 1), 1 / max((q < 0.5).sum(), 1))
    w, c = linear_classifier(x, q, weight)
    return {"once": once, "twice": twice, "w": w, "c": c - _border(x.of_texts(w) + c, y)}


def _sample_votes(feats: DataFrame, once: np.ndarray, twice: np.ndarray) -> tuple[Votes, np.ndarray]:
    """(votes, labels) of the sample."""

    def run(batches):
        for b in batches:
            lists = []
            for f, g, s in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                hits = [base + np.searchsorted(keys, np.intersect1d(own, keys)) for own, keys, base in ((np.array(f, np.int64), once, 0), (np.array(g, np.int64), twice, len(once)))]
                lists.append([*np.concatenate(hits).tolist(), *(len(once) + len(twice) + j for j in range(len(SURFACES)) if s >> j & 1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["y", "hits"])

    rows = feats.select("y", "f", "g", "s").mapInArrow(run, "y int, hits array<int>").toArrow()
    return Votes(rows["hits"].combine_chunks(), len(once) + len(twice) + len(SURFACES)), rows["y"].to_numpy()


def _scores(model: dict, column: pa.Array) -> np.ndarray:
    logit = np.full(len(column), model["c"])
    for first, last, text, voter in votes(model, column):
        logit[first:last] += np.bincount(text, weights=model["w"][voter], minlength=last - first)
    return _sigmoid(logit)


def _loaded(shared) -> dict:
    return shared.value | voter_tables(shared.value["once"], shared.value["twice"])


def _score(shared):
    def run(batches):
        model = _loaded(shared)
        for b in batches:
            score = _scores(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _keep(shared, at: int):
    def run(batches):
        model = _loaded(shared)
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at)) < 0.5))

    return run


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``toxicity`` predicts 0 for: a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_keep(shared, docs.columns.index("text")), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Voters are words (a lexicon), beginnings of words that occur, beginnings that occur twice or more, and surface
    shares; each votes or abstains. Labelled rows that are not held out choose the voters and the class each starts
    to speak for. A generative label model over the votes of all rows, without labels, estimates the voters' rates
    and correlations; a linear classifier is trained on its posterior labels, and the labels set the border between
    the classes. Scoring reads the whole text and nothing else, as a map without a shuffle.

    Null and empty texts get the score of a text in which no voter fires. Without labels, or with one class only,
    every text gets a low constant score. Of a doc_id with several labels the largest counts; null labels and labels
    other than 0 and 1 are ignored. Repeated rows are scored alike, a null doc_id is a row like others (its
    checksum is that of the empty string) and other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
