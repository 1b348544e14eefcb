import itertools
import random
import re

from graphloom.llm import near_dedup
from graphloom.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, n string, v string"


def brute(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        r = root(k)
        low[r] = min(low.get(r, i), i)
    return sorted((i, len(s), low[root(k)], low[root(k)] == i) for k, (i, s) in enumerate(sets))


def found(spark, rows):
    return sorted(tuple(r) for r in near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect())


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = [(100, None), (101, ""), (102, "  \n\t "), (103, "One two"), (104, "one  TWO"), (105, "É one"), (106, "é one"), (107, "a b c"), (103, "One two")]
    for g in range(12):
        base = [word() for _ in range(rnd.choice([6, 30, 47, 49, 90, 400]))]
        for c in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 15))):
                own[rnd.randrange(len(own))] = word()
            t = " ".join(own)
            rows.append((200 + 10 * g + c, t + " " + passage if g % 3 == 0 else t))
    assert found(spark, rows) == brute(rows)


def test_chain_of_near_copies(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(50 - k, " ".join(w[8 * k : 8 * k + 120])) for k in range(20)]
    got = found(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {31}


def test_large_group_of_variants_is_not_compared_pair_by_pair(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(500):
        p = rnd.random() * 0.08
        rows.append((i, " ".join(f"x{rnd.randrange(10**9)}" if rnd.random() < p else w for w in base)))
    verify, made = near_dedup._verify, []
    monkeypatch.setattr(near_dedup, "_verify", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    assert found(spark, rows) == brute(rows)
    assert sum(made[1:]) < 10  # beside the hubs of sketch lists; 63 when all open pairs were made at once


def test_empty_table(spark):
    assert found(spark, []) == []
