import base64
import hashlib
import random
import re
import struct

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import fingerprint as fp

from .helpers import no_docs, odd_docs


def paragraphs(t):
    """Sentences, none of them long."""
    return {p for line in t.split("\n") for p in re.split(r"(?<=[^m-z][.!?]) ", line) if p}


def mixed(k, salt):
    ones = (1 << 64) - 1
    x = (k + (salt + 1) * 0x9E3779B97F4A7C15) & ones
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ones
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ones
    return x ^ (x >> 31)


def places(k, salt):
    return [j * fp.PART + mixed(k, salt * 3 + j) % fp.PART for j in range(3)]


def listed(fingerprint):
    """The digests of a fingerprint, peeled from its string alone, in plain Python."""
    size, blocks, *rest = fingerprint.split(".")
    out = set()
    for block in rest if rest != [""] else []:
        _, salt, text = block.split(":")
        raw = base64.b64decode(text)
        cells = [list(struct.unpack_from(">QHI", raw, i)) for i in range(0, len(raw), 14)]
        assert len(cells) == fp.CELLS
        while pure := [(k, h) for k, c, h in cells if c == 1 and mixed(k, 77) & 0xFFFFFFFF == h]:
            k, h = pure[0]
            out.add(k)
            for i in places(k, int(salt)):
                cells[i] = [cells[i][0] ^ k, cells[i][1] - 1, cells[i][2] ^ h]
        assert not any(any(c) for c in cells)
    assert int(size) == len(out)
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_matches_exact_likeness(spark):
    texts = {i: "\n".join(f"line {j} of {i % 3} {'é' * (j % 4)}" for j in range(i * 3 % 40 + i * 20 * (i % 9 == 0))) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, h string")
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    for at, i in enumerate(order):
        t, nxt = texts[i], texts[order[(at + 1) % len(order)]]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(paragraphs(t), paragraphs(edited))) < 1e-12
        assert abs(r["near_next"] - likeness(paragraphs(t), paragraphs(nxt))) < 1e-12
        # and both follow from the strings alone
        assert abs(r["near_edited"] - likeness(listed(r["fingerprint"]), listed(r["edited_fingerprint"]))) < 1e-12
        follower = rows[order[(at + 1) % len(order)]]
        assert abs(r["near_next"] - likeness(listed(r["fingerprint"]), listed(follower["fingerprint"]))) < 1e-12


def test_peeling_recovers_the_differing_digests():
    a, b = np.array([1, 2, 3, 4, 5], np.uint64), np.array([3, 4, 5, 9], np.uint64)
    zero = np.zeros(5, np.int64)
    left = fp.subtract(fp.cells(a, zero, zero, 1), fp.cells(b, zero[:4], zero[:4], 1))
    got, _, clean = fp.peel(left, zero[:1])
    assert sorted(got) == [1, 2, 9] and clean.all()


def test_likeness_of_random_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3 * n + 1, n).astype(np.uint64)) for n in [*range(60), 500, 3000]]
    others = [np.unique(rng.integers(0, 3 * n + 1, n).astype(np.uint64)) for n in [*range(60), 600, 10]]
    texts, got = fp.sketches(sets)
    for s, t, g in zip(sets, texts, got):
        assert g.tolist() == s.tolist() and listed(t) == set(s.tolist())
    assert np.allclose(fp.likeness(got, others), [likeness(set(s.tolist()), set(o.tolist())) for s, o in zip(sets, others)])


def test_odd_rows(spark):
    rows = fp.fingerprints(odd_docs(spark)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["fingerprint"] == by[3][0]["fingerprint"] and by[2][0]["n_chars"] == 0
    assert by[6][0]["fingerprint"] == by[6][1]["fingerprint"] and len(by[None]) == 1
    assert fp.fingerprints(no_docs(spark)).count() == 0
    one = fp.fingerprints(odd_docs(spark).where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_order_with_null_and_outlying_ids(spark):
    """Ranges hold their share whatever the ids are: one null and one outlier, clusters, one id for a third of all."""
    rows = [(fp.NO_ID, 0), (2**62, 0)] + [(i, 0) for i in range(4000)] + [(10**12 + i, 5) for i in range(2000)] + [(7 * 10**9, h) for h in range(3000)]
    df = spark.createDataFrame(rows, "k long, h long").repartition(5)
    got = {(r["k"], r["h"]): (r["pk"], r["ph"]) for r in fp.previous(df).collect()}
    order = sorted(rows, reverse=True)
    assert got == {x: order[i - 1] for i, x in enumerate(order)}
    parts = df.repartitionByRange(4, "k", "h").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 2 * len(rows) / 4


def test_long_texts_and_sketches_that_get_stuck(spark, monkeypatch):
    # more than a block can hold: many must be sketched again
    texts = ["\n".join(f"line {j} of {i}" for j in range(700)) for i in range(3)]
    sets = [fp.digests(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(fp, "BLOCK", 48)
        crowded, _ = fp.sketches(sets)
    assert [listed(c) for c in crowded] == [set(s.tolist()) for s in sets]
    texts = {i: "\n".join(f"line {j} of {i % 2}" for j in range(n)) for i, n in enumerate((3000, 2990, 400, 30, 24, 26, 1))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    for i in texts:
        nxt = texts[(i - 1) % len(texts)]
        assert abs(rows[i]["near_next"] - likeness(paragraphs(texts[i]), paragraphs(nxt))) < 1e-12
        assert len(listed(rows[i]["fingerprint"])) == len(paragraphs(texts[i]))


def test_unchanged_parts_are_alike_in_lines_of_any_length(spark):
    sentences = " ".join(f"Sentence {i} says what {i * i} is." for i in range(45))
    words = " ".join(f"w{i * i % 997}" for i in range(500))
    signs = "".join(chr(0x4E00 + i * i % 997) for i in range(900))
    other = "\n".join(f"another line {i} of the text beside it" for i in range(90))
    assert len(sentences) > 1000 > len(sentences) * 2 // 3
    for text in (sentences, words, signs):
        docs = spark.createDataFrame([(2, text), (1, other)], "doc_id long, text string")
        row = fp.fingerprints(docs).where("doc_id = 2").first()
        assert row["near_edited"] > 0.3 and row["near_next"] == 0.0


def test_strings_are_made_after_the_last_table_is_written(spark, monkeypatch):
    written, write = [], fp.materialize
    monkeypatch.setattr(fp, "materialize", lambda df, name: written.extend(df.columns) or write(df, name))
    assert fp.fingerprints(odd_docs(spark)).count() == 9
    assert written and not {"fingerprint", "edited_fingerprint"} & set(written)


def test_no_python_runs_on_the_executors(spark, monkeypatch):
    plans, write = [], fp.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fp, "materialize", lambda df, name: plans.append(plan(df)) or write(df, name))
    plans.append(plan(fp.fingerprints(odd_docs(spark))))
    assert len(plans) > 3 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_sql_and_plain_forms_agree(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdemorstwéß0359漢") for _ in range(rng.choice((1, 2, 5, 9, 40))))
    texts = ["".join(word() + rng.choice((" ", " ", " ", ". ", "\n", "! ", "\n\n")) for _ in range(n)) for n in (0, 1, 5, 60, 900)]
    texts += [" ".join(word() for _ in range(300)), "漢字x" * 400, "x y" * 300, "\U0001f600" * 330, " " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").selectExpr("i", f"{fp.digests_sql('t')} AS a")
    with fp._wrapping(spark):
        df = df.selectExpr("i", "a", f"{fp.sketch_sql('a')} AS f")
    for r in df.collect():
        own = set(fp.digests(texts[r["i"]]).tolist())
        assert {x % 2**64 for x in r["a"]} == own == listed(r["f"]) and r["a"] == sorted(r["a"])
    assert spark.conf.get("spark.sql.ansi.enabled") == spark.newSession().conf.get("spark.sql.ansi.enabled")
