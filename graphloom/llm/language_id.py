"""Language identification by a byte convolutional network (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare
from .textops import text_slices
from .toxicity import held_out

#: Labelled rows of a language that the network is fitted on, at most: those with the smallest hashes.
MAX_ROWS = 2000
#: Bytes in a window.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EPOCHS, BATCH, RATE = 12, 128, 0.02

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def fit(x: np.ndarray, y: np.ndarray, classes: int) -> dict:
    """Train on windows ``x`` (rows x WINDOW bytes) by Adam; convolutions are sums of table rows, one a byte."""
    rng = np.random.default_rng(7)
    params = {f"t{w}": rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
    params |= {"out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - 0.8 * epoch / EPOCHS)
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            rows = order[i : i + BATCH]
            xb, n = x[rows], len(rows)
            pooled, where = [], {}
            for w in WIDTHS:
                t = WINDOW - w + 1
                out = sum(params[f"t{w}"][j][xb[:, j : j + t]] for j in range(w)) + params[f"b{w}"]
                where[w] = out.argmax(1)
                pooled.append(np.take_along_axis(out, where[w][:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            p = _softmax(hidden @ params["out"] + params["bias"])
            p[np.arange(n), y[rows]] -= 1
            p /= n
            grads = {"out": hidden.T @ p + 1e-4 * params["out"], "bias": p.sum(0)}
            back = (p @ params["out"].T) * (raw > 0)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"b{w}"] = g.sum(0)
                grads[f"t{w}"] = np.zeros_like(params[f"t{w}"])
                for j in range(w):
                    np.add.at(grads[f"t{w}"][j], (xb[np.arange(n)[:, None], where[w] + j], np.arange(FILTERS)[None]), g)
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                params[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def compiled(params: dict) -> dict:
    """Tables by byte pair: each filter's response is then a sum of at most two rows."""
    t2, t3, t4 = (params[f"t{w}"] for w in WIDTHS)
    pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
    first = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], 1).astype(np.float32)
    return {"first": first, "second": pair(t4[2], t4[3]).astype(np.float32), "third": t3[2].astype(np.float32), "bias": np.concatenate([params[f"b{w}"] for w in WIDTHS]), "out": params["out"], "top": params["bias"]}


def window_probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows ``x`` (rows x WINDOW bytes)."""
    byte = np.ascontiguousarray(x.T)
    code = (byte[:-1].astype(np.int32) << 8) | byte[1:]
    f, best = FILTERS, None
    for a in range(0, WINDOW - 3, 16):
        e = min(a + 16, WINDOW - 3)
        out = net["first"][code[a:e]]
        out[:, :, f : 2 * f] += net["third"][byte[a + 2 : e + 2]]
        out[:, :, 2 * f :] += net["second"][code[a + 2 : e + 2]]
        out = out.max(0)
        best = out if best is None else np.maximum(best, out)
    # the positions at the end that only the narrower filters reach
    for w, k in ((2, 0), (3, 1)):
        for t in range(WINDOW - 3, WINDOW - w + 1):
            out = net["first"][code[t]][:, k * f : (k + 1) * f]
            if w == 3:
                out = out + net["third"][byte[t + 2]]
            best[:, k * f : (k + 1) * f] = np.maximum(best[:, k * f : (k + 1) * f], out)
    return _softmax(np.maximum(best + net["bias"], 0) @ net["out"] + net["top"])


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of all texts, the text of each): the last one of a text is filled up with spaces."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.full(int(first[-1]) * WINDOW, 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], size)] = data
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), n)


def _one_window(batches):
    """One of the windows of each text, by the row's hash: any place of the whole text, as long as in a prediction."""
    for b in batches:
        found = []
        for h, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            x, _ = windows(raw, np.array([0, len(raw)]))
            x = x[LETTER[x].any(1)]
            found.append(x[h % len(x)].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["h", "lang", "w"])


def train(docs: DataFrame) -> dict:
    """Fit on one window of each of a bounded sample of rows with a language that are not held out, MAX_ROWS a language.

    The sample is the rows with the smallest hashes of id and text, counted first, so that little more than it is
    ever ordered, and ids before texts; rows that repeat count once. Every language of the rows is learned.
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out(parts=4, part=2))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("c"))
    # a share of each language that holds MAX_ROWS with near certainty
    share = F.least(F.lit(1.0), (2 * MAX_ROWS + 100) / F.col("c"))
    near = rows.select("lang", "h").join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = materialize(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MAX_ROWS).drop("r"), "sample")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # MAX_ROWS a language
    rows = materialize(sample.select("h", "lang", "text").mapInArrow(_one_window, "h long, lang string, w binary"), "windows").orderBy("lang", "h").toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    if not langs:
        return {"langs": []}
    x = np.frombuffer(b"".join(rows["w"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([langs.index(v) for v in rows["lang"].to_pylist()])
    return {"langs": langs, "net": compiled(fit(x, y, len(langs)))}


def _languages(model: dict, column: pa.Array, lettered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, -1 for none; its score) of each text."""
    langs, net = model["langs"], model.get("net")
    pred, score = np.full(len(column), -1), np.zeros(len(column))
    for first, last, data, offsets in text_slices(column) if langs else ():
        x, text = windows(data, offsets)
        total = np.zeros((last - first, len(langs)))
        weight = np.zeros(last - first)
        for i in range(0, len(x), 1024):
            part, own = x[i : i + 1024], text[i : i + 1024]
            letters = LETTER[part].sum(1) / WINDOW
            np.add.at(total, own, window_probabilities(net, part) * letters[:, None])
            np.add.at(weight, own, letters)
        share = total / np.maximum(weight, 1e-9)[:, None]
        pred[first:last] = share.argmax(1)
        score[first:last] = np.clip(share.max(1), 0, 1)
    ok = np.array(lettered.to_pylist(), bool)
    return np.where(ok, pred, -1), np.where(ok, score, 0.0)


def _predict(shared):
    def run(batches):
        names = np.array([*shared.value["langs"], "und"], dtype=object)
        for b in batches:
            pred, score = _languages(shared.value, b.column(2), b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keep(shared, at: int, least: float):
    def run(batches):
        for b in batches:
            pred, score = _languages(shared.value, b.column(at), b.column(b.num_columns - 1))
            yield b.filter(pa.array((pred >= 0) & (score >= least)))

    return run


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have letters and a language with ``least`` score or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.withColumn("_lettered", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    return rows.mapInArrow(_keep(shared, docs.columns.index("text"), least), rows.schema).drop("_lettered")


def identify_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    The network learns from text and ``lang`` of rows that are not held out. A prediction reads the whole text, as
    windows of 256 bytes weighed by their letters; ``score`` is the mean probability of the language. Null texts and
    texts without a letter are ``und`` with score 0, and so is every text if no row has a language. Of languages with
    one score the first by name is predicted. Repeated rows are predicted alike, a null doc_id is held out or not by
    the checksum of the empty string, and other columns are ignored. A map over the texts without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select("doc_id", held_out(parts=4, part=2).alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
