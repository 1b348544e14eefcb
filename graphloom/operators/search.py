"""Ranked symbol search: full text, substring, fuzzy and exact stages over the node table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind_bonus, name_bonus, path_relevance

TOKEN = "[^a-z0-9]+"
# Full-text weights by column, and the constants of BM25.
WEIGHTS = {"name": 20.0, "qualified_name": 5.0}
K1, B = 1.2, 0.75
# Kinds of nodes.
KINDS = (
    "file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field",
    "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route",
    "component", "selector", "css_variable",
)


@dataclass
class Query:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str) -> Query:
    """``kind:``, ``lang:``/``language:``, ``path:`` and ``name:`` filters, values may be quoted; the rest is text, and so
    is ``kind:`` with a value that is no kind."""
    out, text = Query(), []
    into = {"kind": out.kinds, "lang": out.languages, "language": out.languages, "path": out.paths, "name": out.names}
    for m in re.finditer(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', raw):
        prefix, value = m[1], m[2] if m[2] is not None else m[3]
        field_ = (prefix or "").lower()
        if field_ == "kind" and value.lower() in KINDS:
            out.kinds.append(value.lower())
        elif field_ in into and field_ != "kind" and value:
            into[field_].append(value)
        else:
            text.append(f"{prefix}:{value}" if prefix else value)
    out.text = " ".join(text)
    return out


def filtered(nodes: DataFrame, kinds=(), languages=()) -> DataFrame:
    if kinds:
        nodes = nodes.where(F.col("kind").isin(*kinds))
    if languages:
        nodes = nodes.where(F.col("language").isin(*languages))
    return nodes


def inverted_index(nodes: DataFrame, terms: list[str] = ()) -> DataFrame:
    """(id, term, f, len): weighted term frequencies and the number of tokens of each node; with ``terms``, only of
    tokens that one of them begins, and the others never leave their row."""
    toks = {c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN), lambda x: x != "") for c in WEIGHTS}
    size = sum((F.size(t) for t in toks.values()), F.lit(0))

    def weighted(tokens, w: float):
        return F.transform(tokens, lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))

    entries = F.concat(*(weighted(t, WEIGHTS[c]) for c, t in toks.items()))
    if terms:
        entries = F.filter(entries, lambda e: reduce(or_, [e["term"].startswith(t) for t in terms]))
    return nodes.select("id", size.alias("len"), F.explode(entries).alias("e")).groupBy("id", "len", F.col("e.term").alias("term")).agg(F.sum("e.w").alias("f"))


def full_text(nodes: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """(id, score): BM25 over name and qualified name; a term matches every token that it begins."""
    index = inverted_index(nodes, terms)
    lens = nodes.select(sum((F.size(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN), lambda x: x != "")) for c in WEIGHTS), F.lit(0)).alias("len"))
    stats = F.broadcast(lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg")))  # one row
    wanted = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.col("term").startswith(t))
    hits = index.select("id", "len", "f", F.explode(wanted).alias("q")).groupBy("id", "len", "q").agg(F.sum("f").alias("f"))
    df = F.broadcast(hits.groupBy("q").agg(F.count("*").alias("df")))  # one row a term of the query
    scored = hits.join(df, "q").join(stats, how="cross")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg"))
    out = scored.groupBy("id").agg(F.sum(idf * F.col("f") * (K1 + 1) / norm).alias("score"))
    return out.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(k)


def substring(nodes: DataFrame, text: str, k: int = 50) -> DataFrame:
    """(id, score): 1.0 equal, 0.9 beginning, 0.8 inside the name, 0.7 inside the qualified name."""
    t = text.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    score = F.when(F.col("name") == text, 1.0).when(name.startswith(t), 0.9).when(name.contains(t), 0.8).otherwise(0.7)
    hits = nodes.where(name.contains(t) | qualified.contains(t)).select("id", score.alias("score"), F.length("name").alias("_l"))
    return hits.orderBy(F.col("score").desc(), "_l", "id").limit(k).select("id", "score")


def fuzzy(nodes: DataFrame, text: str, per_name: int = 5, names: int = 100) -> DataFrame:
    """(id, distance, score): names within 1 edit (up to 4 letters) or 2, five nodes a name."""
    t, most = text.lower(), 1 if len(text) <= 4 else 2
    low = nodes.select("name").distinct().where(F.abs(F.length("name") - len(t)) <= most)
    near = low.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(t), most)).where("distance >= 0").orderBy("distance", "name").limit(names)
    w = Window.partitionBy("name").orderBy("id")
    rows = nodes.select("id", "name").join(near, "name").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_name)
    return rows.select("id", "distance", (1.0 / (1 + F.col("distance"))).alias("score"))


def exact_names(nodes: DataFrame, names: list[str], limit: int = 50) -> DataFrame:
    """(id, score): 1, and 20 more in files that hold a distinctive name (one in fewer than 10 files)."""
    wanted = sorted({n.lower() for n in names})
    hits = nodes.where(F.lower("name").isin(*wanted)).select("id", F.lower("name").alias("name"), "file_path")
    rare = hits.groupBy("name").agg(F.countDistinct("file_path").alias("c")).where("c < 10").select("name")
    files = hits.join(rare, "name", "left_semi").select("file_path").distinct().withColumn("rare", F.lit(True))
    scored = hits.join(files, "file_path", "left").select("id", "name", (1.0 + F.when(F.col("rare"), 20).otherwise(0)).alias("score"))
    cap = max(8, -(-limit // len(names)))
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).orderBy(F.col("score").desc(), "id").limit(limit).select("id", "score")


def search(nodes: DataFrame, raw: str, limit: int = 100) -> DataFrame:
    """(id, name, score): the first stage of full text, substring and fuzzy that finds anything, and exact names,
    scored with the bonuses of kind, path and name; ``path:`` and ``name:`` filter after scoring."""
    q = parse_query(raw)
    nodes = filtered(nodes, q.kinds, q.languages)
    terms = [t for t in re.split(TOKEN, q.text.lower()) if t]
    if not terms:
        ranked = nodes.select("id", F.lit(0.0).alias("score"))
    else:
        ranked = full_text(nodes, terms, max(5 * limit, 100))
        if ranked.isEmpty():
            ranked = substring(nodes, q.text, max(5 * limit, 100))
        if ranked.isEmpty():
            ranked = fuzzy(nodes, q.text).select("id", "score")
        top = ranked.agg(F.max("score")).first()[0] or 1.0
        extra = nodes.where(F.lower("name").isin(*q.text.lower().split())).select("id", F.lit(top).alias("score"))
        ranked = ranked.union(extra).groupBy("id").agg(F.max("score").alias("score"))
    out = nodes.join(ranked, "id").withColumn("score", F.round(F.col("score") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), terms, "test" in raw.lower()) + name_bonus(F.col("name"), q.text), 6))
    for p in q.paths:
        out = out.where(F.lower("file_path").contains(p.lower()))
    for n in q.names:
        out = out.where(F.lower("name").contains(n.lower()))
    return out.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "name", "score")
