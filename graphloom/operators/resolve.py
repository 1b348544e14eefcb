"""References to edges: every strategy proposes candidates by joins, and the best stage of each reference wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import written


#: Names of more nodes than this are looked up in pools; pairs of a reference with every node are made for the others.
PAIRED = 16
#: Leading directories that count for proximity, and lines beyond which being near in a file counts no more.
DIRECTORIES, LINES = 6, 200
#: Kinds of reference that prefer some kinds of target; all others are one.
BIASED = ("calls", "instantiates", "decorates")


def _directories(path):
    return F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def proximity(a, b):
    """15 for each leading directory in common, 80 at most."""
    same = F.zip_with(_directories(a), _directories(b), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    shared = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    return F.least(shared * 15, F.lit(80))


def _bias(ref, kind):
    callable_, classlike = kind.isin("function", "method"), kind.isin("class", "struct", "interface")
    return F.when((ref == "calls") & callable_, 25).when((ref == "instantiates") & classlike, 25).when((ref == "decorates") & callable_, 25).when((ref == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)


def _exported():
    return F.when(F.col("is_exported"), 10).otherwise(0)


def _scored(pairs: DataFrame) -> DataFrame:
    """``pairs``: refs (r_*) with candidate nodes; adds the score by file, place, language, kind and export."""
    same_file = F.col("file_path") == F.col("r_file")
    near = F.when(same_file, F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("r_line")) / 10)).otherwise(0.0)
    score = F.when(same_file, 100).otherwise(0) + proximity(F.col("r_file"), F.col("file_path")) + F.when(F.col("language") == F.col("r_language"), 50).otherwise(-80) + _bias(F.col("r_kind"), F.col("kind")) + _exported() + near
    return pairs.withColumn("score", score)


def _refs(refs: DataFrame) -> DataFrame:
    names = {"id": "ref_id", "reference_name": "r_name", "reference_kind": "r_kind", "file_path": "r_file", "language": "r_language", "line": "r_line", "from_node_id": "r_from"}
    return refs.select(*(F.col(a).alias(b) for a, b in names.items()))


def _out(df: DataFrame, confidence, stage: int, by: str) -> DataFrame:
    return df.select("ref_id", F.col("id").alias("target"), confidence.cast("double").alias("confidence"), F.lit(stage).alias("stage"), F.lit(by).alias("resolved_by"))


def _asked(known: DataFrame, r: DataFrame, key: str) -> DataFrame:
    """Rows of ``known`` whose key some reference has."""
    return known.join(r.select(key).distinct(), key, "left_semi")


def _first(df: DataFrame, *choices) -> DataFrame:
    """(ref_id, id, rank) by the first of ``choices`` (rank, id), where there is one."""
    best = F.coalesce(*(F.when(id_.isNotNull(), F.struct(F.lit(rank).alias("rank"), id_.alias("id"))) for rank, id_ in choices))
    return df.select("ref_id", best.alias("m")).where("m is not null").select("ref_id", "m.id", "m.rank")


def _ends(r: DataFrame, known: DataFrame, tail) -> DataFrame:
    """(r_name, ends): the smallest id of ``known`` (tail, full, id) whose full name ends with a name of ``r`` (tail,
    r_name). Full names are cut to the lengths asked for under their tail, so both meet by equal text."""
    lengths = r.select("tail", F.length("r_name").alias("n")).distinct()
    cut = _asked(known, r, "tail").groupBy("tail", "full").agg(F.min("id").alias("id")).join(lengths, "tail").where(F.length("full") >= F.col("n")).withColumn("r_name", F.right("full", F.col("n")))
    return cut.where(tail(F.col("r_name")) == F.col("tail")).groupBy("r_name").agg(F.min("id").alias("ends"))


def by_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with a slash against file nodes: equal 0.95, ending 0.85, the only file of that name 0.7."""
    tail = lambda c: F.substring_index(c, "/", -1)
    r = _refs(refs).where(F.col("r_name").contains("/")).select("ref_id", "r_name", tail(F.col("r_name")).alias("tail"))
    files = _asked(nodes.where("kind = 'file'").select("id", F.col("file_path").alias("full"), tail(F.col("file_path")).alias("tail")), r, "tail")
    equal = files.groupBy(F.col("full").alias("r_name")).agg(F.min("id").alias("equal"))
    named = files.groupBy("tail").agg(F.count("*").alias("c"), F.min("id").alias("only"))
    pairs = r.join(named, "tail").join(equal, "r_name", "left").join(_ends(r, files, tail), "r_name", "left")
    best = pairs.groupBy("ref_id").agg(F.min("equal").alias("equal"), F.min("ends").alias("ends"), F.sum("c").alias("c"), F.min("only").alias("only"))
    best = _first(best, (0.95, F.col("equal")), (0.85, F.col("ends")), (0.7, F.when(F.col("c") == 1, F.col("only"))))
    return _out(best, F.col("rank"), 0, "file-path")


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only node of that qualified name 0.95; else one of the last name whose qualified name ends so 0.85."""
    tail = lambda c: F.element_at(F.split(c, "[:.]"), -1)
    r = _refs(refs).where(F.col("r_name").contains("::") | F.col("r_name").contains(".")).select("ref_id", "r_name", tail(F.col("r_name")).alias("tail"))
    exact = _asked(nodes.select("id", F.col("qualified_name").alias("r_name")), r, "r_name").groupBy("r_name").agg(F.count("*").alias("c"), F.min("id").alias("only"))
    ends = _ends(r, nodes.select("id", F.col("name").alias("tail"), F.col("qualified_name").alias("full")), tail)
    pairs = r.select("ref_id", "r_name").join(exact.join(ends, "r_name", "full"), "r_name")
    best = pairs.groupBy("ref_id").agg(F.sum("c").alias("c"), F.min("only").alias("only"), F.min("ends").alias("ends"))
    return _out(_first(best, (0.95, F.when(F.col("c") == 1, F.col("only"))), (0.85, F.col("ends"))), F.col("rank"), 1, "qualified-name")


def by_method(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``receiver.method``: a method of a class of that name 0.85, with a capital 0.8, the only one of the language 0.7."""
    parts = F.split("r_name", "::|\\.")
    r = _refs(refs).withColumn("parts", parts).where("size(parts) = 2").select("ref_id", "r_language", F.get("parts", F.lit(0)).alias("receiver"), F.get("parts", F.lit(1)).alias("member"))
    own = F.split("qualified_name", "::")
    methods = nodes.where("kind = 'method'").where(F.size(own) > 1).select("id", F.col("name").alias("member"), F.element_at(own, -2).alias("owner"), F.col("language").alias("r_language"))
    methods = _asked(methods, r, "member")
    owned = methods.groupBy("member", "owner").agg(F.min("id").alias("id"))
    spoken = methods.groupBy("member", "r_language").agg(F.count("*").alias("c"), F.min("id").alias("only"))
    pairs = _asked(r, methods, "member").withColumn("capital", F.initcap("receiver"))
    pairs = pairs.join(owned.select("member", F.col("owner").alias("receiver"), F.col("id").alias("plain")), ["member", "receiver"], "left")
    pairs = pairs.join(owned.select("member", F.col("owner").alias("capital"), F.col("id").alias("large")), ["member", "capital"], "left").join(spoken, ["member", "r_language"], "left")
    best = pairs.groupBy("ref_id").agg(F.min("plain").alias("plain"), F.min("large").alias("large"), F.sum("c").alias("c"), F.min("only").alias("only"))
    best = _first(best, (0.85, F.col("plain")), (0.8, F.col("large")), (0.7, F.when(F.col("c") == 1, F.col("only"))))
    return _out(best, F.col("rank"), 2, "qualified-name")


def _candidate(score, k) -> list:
    """A candidate of a reference; k counts the nodes that it stands for."""
    same = F.col("language") == F.col("r_language")
    return ["ref_id", k.cast("bigint").alias("k"), F.struct((-score).cast("double").alias("low"), F.col("id").alias("id"), same.alias("same"), (proximity(F.col("r_file"), F.col("file_path")) >= 30).alias("near")).alias("m")]


def _prefixes(path):
    """Keys of the directories that hold a path, up to as many as count."""
    d = _directories(path)
    return F.transform(F.sequence(F.lit(0), F.least(F.size(d), F.lit(DIRECTORIES))), lambda i: F.struct(F.concat(i.cast("string"), F.lit(":"), F.array_join(F.slice(d, F.lit(1), i), "/")).alias("key"), F.least(i * 15, F.lit(80)).alias("bonus")))


def _pooled(r: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates of references by names of many nodes, without pairs of each with each.

    For each directory, and each file, that holds nodes of a name, a pool keeps the best of them (of a language, and
    of any) for each kind of reference. A reference asks the pools of its own file and directories. A pool's
    score is at most the true one, and is true in the innermost pool that both share. Only lines near by count one
    by one: these are met within a file by strips of LINES lines.
    """
    where = F.when(F.col("file_path").isNull(), F.array(F.lit("none"))).otherwise(F.concat(F.transform(_prefixes(F.col("file_path")), lambda x: x["key"]), F.array(F.concat(F.lit("f:"), "file_path"))))
    inner = (*BIASED, "other")
    best = [F.min(F.struct((-(_bias(F.lit(k), F.col("kind")) + _exported())).alias("low"), "id", "file_path", "language")).alias(k) for k in inner]
    spoken = nodes.withColumn("key", F.explode(where)).groupBy(F.col("name").alias("r_name"), "key", F.col("language").alias("r_language")).agg(F.count("*").alias("c"), *best)
    any_ = spoken.groupBy("r_name", "key").agg(F.sum("c").alias("c"), *(F.min(k).alias(k) for k in inner))
    at = lambda key: F.struct(F.lit(key).alias("key"), F.lit(80).alias("bonus"))
    own = F.struct(F.concat(F.lit("f:"), "r_file").alias("key"), (100 + F.least(F.size(_directories(F.col("r_file"))) * 15, F.lit(80))).alias("bonus"))
    asks = F.when(F.col("r_file").isNull(), F.array(at("none"), at("0:"))).otherwise(F.concat(F.array(at("none"), own), _prefixes(F.col("r_file"))))
    asked = r.withColumn("ask", F.explode(asks)).select("*", "ask.key", "ask.bonus").drop("ask")
    pick = F.when(F.col("r_kind") == BIASED[0], F.col(BIASED[0]))
    for k in BIASED[1:]:
        pick = pick.when(F.col("r_kind") == k, F.col(k))
    pick = pick.otherwise(F.col("other"))
    counted = F.when(F.col("key").isin("none", "0:"), F.col("c")).otherwise(0)
    # of any language: as of another one, which is less than a node of the same language has in the other pool
    rows = asked.join(any_, ["r_name", "key"]).select("*", pick.alias("p"), counted.alias("k"), F.lit(-80).alias("tongue"))
    rows = rows.select("ref_id", "r_file", "r_language", "bonus", "k", "tongue", "p.*").union(asked.join(spoken, ["r_name", "key", "r_language"]).select("ref_id", "r_file", "r_language", "bonus", F.lit(0).alias("k"), F.lit(50).alias("tongue"), pick.alias("p")).select("ref_id", "r_file", "r_language", "bonus", "k", "tongue", "p.*"))
    rows = rows.select(*_candidate(F.col("bonus") + F.col("tongue") - F.col("low"), F.col("k")))
    strip = lambda c: F.floor(F.col(c) / LINES)
    lines = nodes.groupBy("name", "file_path", "start_line", "language", "kind", "is_exported").agg(F.min("id").alias("id")).withColumn("strip", strip("start_line"))
    beside = r.withColumn("strip", F.explode(F.array(*(strip("r_line") + i for i in (-1, 0, 1)))))
    pairs = beside.join(lines, (F.col("name") == F.col("r_name")) & (F.col("file_path") == F.col("r_file")) & (lines["strip"] == beside["strip"]))
    return rows.union(_scored(pairs).select(*_candidate(F.col("score"), F.lit(0))))


def by_exact_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only node of the name 0.9 (0.5 across languages); of several the best 0.7 nearby, else 0.4."""
    r = _refs(refs).drop("r_from")
    counts = _asked(nodes.select(F.col("name").alias("r_name")), r, "r_name").groupBy("r_name").agg((F.count("*") > PAIRED).alias("many"))
    counts = written(counts)
    r = r.join(counts, "r_name")
    known = nodes.select("id", "kind", "name", "file_path", "language", "start_line", "is_exported")
    few = _scored(r.where("NOT many").drop("many").join(known, F.col("name") == F.col("r_name"))).select(*_candidate(F.col("score"), F.lit(1)))
    if not counts.where("many").isEmpty():
        large = known.join(counts.where("many").select(F.col("r_name").alias("name")), "name", "left_semi")
        few = few.union(_pooled(r.where("many").drop("many"), large))
    best = few.groupBy("ref_id").agg(F.sum("k").alias("c"), F.min("m").alias("m")).where("c = 1 OR m.low < 1")
    confidence = F.when(F.col("c") == 1, F.when(F.col("m.same"), 0.9).otherwise(0.5)).when(F.col("m.near"), 0.7).otherwise(0.4)
    return _out(best.select("*", "m.id"), confidence, 3, "exact-match")


def by_fuzzy_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only callable of the lower-case name, of the same language 0.5 if there is one, else of any 0.3."""
    r = _refs(refs).select("ref_id", "r_language", F.lower("r_name").alias("low"))
    low = nodes.where(F.col("kind").isin("function", "method", "class")).select("id", F.col("language").alias("r_language"), F.lower("name").alias("low"))
    same = _asked(low, r, "low").groupBy("low", "r_language").agg(F.count("*").alias("s"), F.min("id").alias("same"))
    any_ = same.groupBy("low").agg(F.sum("s").alias("c"), F.min("same").alias("any"))
    pairs = r.join(any_, "low").join(same, ["low", "r_language"], "left")
    best = pairs.groupBy("ref_id").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.min("same").alias("same"), F.sum("c").alias("c"), F.min("any").alias("any"))
    best = _first(best, (0.5, F.when(F.col("s") == 1, F.col("same"))), (0.3, F.when((F.col("s") == 0) & (F.col("c") == 1), F.col("any"))))
    return _out(best, F.col("rank"), 4, "fuzzy")


def resolve(refs: DataFrame, nodes: DataFrame, extra: list[DataFrame] = ()) -> DataFrame:
    """(ref_id, target, confidence, stage, resolved_by): the first stage that finds a target; ``extra`` candidates,
    of imports or frameworks, win by higher confidence, and from 0.9 at once."""
    staged = reduce(DataFrame.union, [f(refs, nodes) for f in (by_path, by_qualified_name, by_method, by_exact_name, by_fuzzy_name)])
    w = Window.partitionBy("ref_id").orderBy("stage", "target")
    names = staged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    for df in extra:
        names = names.union(df.select(*names.columns))
    first = (F.col("stage") < 0) & (F.col("confidence") >= 0.9)
    w = Window.partitionBy("ref_id").orderBy(first.desc(), F.col("confidence").desc(), "stage", "target")
    return names.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_edges(resolved: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references: extends of an interface becomes implements, calls of a class instantiates."""
    r = _refs(refs).join(resolved, "ref_id").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("t_kind")), "target")
    source = nodes.select(F.col("id").alias("r_from"), F.col("kind").alias("s_kind"))
    r = r.join(source, "r_from")
    kind = F.when((F.col("r_kind") == "extends") & F.col("t_kind").isin("interface", "protocol") & ~F.col("s_kind").isin("interface", "protocol"), "implements")
    kind = kind.when((F.col("r_kind") == "calls") & F.col("t_kind").isin("class", "struct"), "instantiates").otherwise(F.col("r_kind"))
    return r.select(F.col("r_from").alias("source"), "target", kind.alias("kind"), F.col("r_line").alias("line"), "confidence", "resolved_by")


def follow_re_exports(imports: DataFrame, re_exports: DataFrame, exported: DataFrame, depth: int = 8) -> DataFrame:
    """(ref_id, target): names imported from a file, through chains of re-exports to the file that defines them.

    ``imports`` (ref_id, file, name), ``re_exports`` (file, name, to_file, to_name; ``*`` passes every name on),
    ``exported`` (file, name, id). Levels are joins, ``depth`` of them; a file and name met again ends a chain.
    """
    at = imports.select("ref_id", "file", "name", F.lit(0).alias("level"))
    levels = [at]
    for level in range(1, depth + 1):
        hop = at.alias("a").join(re_exports.alias("e"), (F.col("a.file") == F.col("e.file")) & ((F.col("a.name") == F.col("e.name")) | (F.col("e.name") == "*")))
        at = hop.select("a.ref_id", F.col("e.to_file").alias("file"), F.when(F.col("e.name") == "*", F.col("a.name")).otherwise(F.col("e.to_name")).alias("name"), F.lit(level).alias("level")).distinct()
        levels.append(at)
    hits = reduce(DataFrame.union, levels).join(exported, ["file", "name"])
    return hits.groupBy("ref_id").agg(F.min(F.struct("level", "id")).alias("m")).select("ref_id", F.col("m.id").alias("target"))
