"""The graph as a view over star-schema tables: nodes, edges and the references they stand for."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_held: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slug(c: str):
    return F.regexp_replace(F.lower(c), " ", "_")


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.concat(_slug("r_name"), F.lit("/"), _slug("n_name")).alias("path"))  # 5 regions


def build_nodes(spark: SparkSession, sf_dir: str, only=None) -> DataFrame:
    """``only``: a condition on nodes, put on each part before the union, so that it reaches the tables."""
    np_ = nation_paths(spark, sf_dir)
    cust = _read(spark, sf_dir, "customer").join(np_, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = _read(spark, sf_dir, "supplier").join(np_, F.col("s_nationkey") == F.col("n_nationkey"))
    part = _read(spark, sf_dir, "part")
    orders = _read(spark, sf_dir, "orders").join(cust.select("c_custkey", "c_name", "c_mktsegment", "path"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")

    def node(df, id_, kind, name, qualified, path, language, start, end, exported, h=none, shape=none):
        line = lambda c: F.col(c).cast("int") if isinstance(c, str) else c.cast("int")
        out = df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"), language.alias("language"), line(start).alias("start_line"), line(end).alias("end_line"), exported.alias("is_exported"), h.alias("ast_hash"), shape.alias("ast_shape_hash"))
        return out if only is None else out.where(only)

    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pname = F.regexp_replace("p_name", " ", "_")
    order = at("order_", "o_orderkey")
    rows = [
        node(np_, F.concat(F.lit("file:"), "path"), "file", F.col("n_name"), F.col("path"), F.col("path"), F.lit("nation"), F.lit(1), F.lit(1), F.lit(False)),
        node(cust, at("class:c", "c_custkey"), "class", F.col("c_name"), F.col("c_name"), F.col("path"), F.lower("c_mktsegment"), "c_custkey", "c_custkey", F.col("c_mktsegment") == "BUILDING"),
        node(supp, at("interface:s", "s_suppkey"), "interface", F.col("s_name"), F.col("s_name"), F.col("path"), F.lit("supplier"), "s_suppkey", "s_suppkey", F.lit(True)),
        node(part, at("function:p", "p_partkey"), "function", pname, F.concat("p_brand", F.lit("::"), pname), F.concat(F.lit("parts/"), F.lower("p_brand")), F.lower("p_type"), "p_partkey", F.col("p_partkey") + F.col("p_size") - 1, F.lit(False), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256), F.sha2(F.concat_ws("|", "p_name", "p_type"), 256)),
        node(orders, at("method:o", "o_orderkey"), "method", order, F.concat("c_name", F.lit("::"), order), F.col("path"), F.lower("c_mktsegment"), "o_orderkey", "o_orderkey", F.col("o_orderstatus") == "F"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def build_edges(spark: SparkSession, sf_dir: str, only=None, repeats: bool = False) -> DataFrame:
    """``only``: a condition on source, target and kind, put on each part before the union, so that it reaches the tables.
    ``repeats`` leaves calls as they are, for what asks only whether there is an edge."""
    np_ = nation_paths(spark, sf_dir)
    cust = _read(spark, sf_dir, "customer").join(np_, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("path").alias("c_path"))
    supp = _read(spark, sf_dir, "supplier").join(np_, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("path").alias("s_path"))
    orders, items = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    none_i, none_d, none_s = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string")
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def edge(df, source, target, kind, line=none_i, confidence=none_d, by=none_s):
        out = df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), line.alias("line"), confidence.cast("double").alias("confidence"), by.alias("resolved_by"))
        return out if only is None else out.where(only)

    far = items.where("l_quantity >= 50 AND l_discount >= 0.09").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    far = far.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).where("c_path <> s_path").select("c_path", "s_path").distinct()
    # only calls repeat: they alone are collapsed, by their numbers, which is cheaper than by text, before the union
    by = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 0).otherwise(1)  # in the order of the names
    calls = items.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("int").alias("line"), F.round(1 - 8 * F.col("l_discount"), 2).alias("confidence"), by.alias("by"))
    if not repeats:
        calls = calls.groupBy("l_orderkey", "l_partkey", "line").agg(F.min("confidence").alias("confidence"), F.min("by").alias("by"))
    calls = edge(calls, at("method:o", "l_orderkey"), at("function:p", "l_partkey"), "calls", F.col("line"), F.col("confidence"), F.element_at(F.array(*map(F.lit, ("exact-match", "fuzzy", "import"))), F.col("by") + 1))
    rows = [
        calls,
        edge(cust, F.concat(F.lit("file:"), "c_path"), at("class:c", "c_custkey"), "contains"),
        edge(supp, F.concat(F.lit("file:"), "s_path"), at("interface:s", "s_suppkey"), "contains"),
        edge(orders, at("class:c", "o_custkey"), at("method:o", "o_orderkey"), "contains"),
        edge(orders.where("o_orderpriority = '1-URGENT'"), at("method:o", "o_orderkey"), at("class:c", "o_custkey"), "references", none_i, F.lit(0.9), F.lit("import")),
        edge(supp.where("s_suppkey > 0"), at("interface:s", "s_suppkey"), F.concat(F.lit("interface:s"), F.floor(F.col("s_suppkey") / 2).cast("bigint").cast("string")), "extends", none_i, F.lit(0.95), F.lit("qualified-name")),
        edge(far, F.concat(F.lit("file:"), "c_path"), F.concat(F.lit("file:"), "s_path"), "imports", none_i, F.lit(0.95), F.lit("import")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), held for the session: every query of one folder shares them, spilled to disk as needed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        nodes = build_nodes(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        edges = build_edges(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        _held[key] = (nodes, edges)
    return _held[key]


def around(spark: SparkSession, sf_dir: str, at: str, id_: str, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with all edges at one symbol (``at``: source or target) and the nodes at their ends, and not
    more, for questions about one symbol: the graph need not be built. Up to ``most`` edges return to the driver,
    and their ends are sought in the tables; more than that stay tables, and nodes are not filtered."""
    edges = build_edges(spark, sf_dir, F.col(at) == id_)
    found = edges.limit(most + 1).collect()
    if len(found) > most:
        return build_nodes(spark, sf_dir), edges
    ids = sorted({x for r in found for x in (r["source"], r["target"]) if x is not None})
    return build_nodes(spark, sf_dir, F.col("id").isin(*ids)), spark.createDataFrame(found, edges.schema)


SQL_GRAPH = """np AS (SELECT n_nationkey, n_name, replace(lower(r_name), ' ', '_') || '/' || replace(lower(n_name), ' ', '_') AS path
  FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT * FROM customer JOIN np ON c_nationkey = n_nationkey), supp AS (SELECT * FROM supplier JOIN np ON s_nationkey = n_nationkey),
nodes AS (
  SELECT 'file:' || path AS id, 'file' AS kind, n_name AS name, path AS qualified_name, path AS file_path, 'nation' AS language, 1 AS start_line, 1 AS end_line, false AS is_exported, NULL::VARCHAR AS ast_hash, NULL::VARCHAR AS ast_shape_hash FROM np
  UNION ALL SELECT 'class:c' || c_custkey, 'class', c_name, c_name, path, lower(c_mktsegment), c_custkey::INT, c_custkey::INT, c_mktsegment = 'BUILDING', NULL, NULL FROM cust
  UNION ALL SELECT 'interface:s' || s_suppkey, 'interface', s_name, s_name, path, 'supplier', s_suppkey::INT, s_suppkey::INT, true, NULL, NULL FROM supp
  UNION ALL SELECT 'function:p' || p_partkey, 'function', replace(p_name, ' ', '_'), p_brand || '::' || replace(p_name, ' ', '_'), 'parts/' || lower(p_brand), lower(p_type), p_partkey::INT, (p_partkey + p_size - 1)::INT, false, sha256(p_name || '|' || p_brand || '|' || p_type), sha256(p_name || '|' || p_type) FROM part
  UNION ALL SELECT 'method:o' || o_orderkey, 'method', 'order_' || o_orderkey, c_name || '::order_' || o_orderkey, path, lower(c_mktsegment), o_orderkey::INT, o_orderkey::INT, o_orderstatus = 'F', NULL, NULL FROM orders JOIN cust ON o_custkey = c_custkey),
raw AS (
  SELECT 'method:o' || l_orderkey AS source, 'function:p' || l_partkey AS target, 'calls' AS kind, l_linenumber::INT AS line, round(1 - 8 * l_discount, 2) AS confidence, CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'exact-match' ELSE 'fuzzy' END AS resolved_by FROM lineitem
  UNION ALL SELECT 'file:' || path, 'class:c' || c_custkey, 'contains', NULL, NULL, NULL FROM cust
  UNION ALL SELECT 'file:' || path, 'interface:s' || s_suppkey, 'contains', NULL, NULL, NULL FROM supp
  UNION ALL SELECT 'class:c' || o_custkey, 'method:o' || o_orderkey, 'contains', NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'method:o' || o_orderkey, 'class:c' || o_custkey, 'references', NULL, 0.9, 'import' FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'interface:s' || s_suppkey, 'interface:s' || (s_suppkey // 2), 'extends', NULL, 0.95, 'qualified-name' FROM supp WHERE s_suppkey > 0
  UNION ALL SELECT DISTINCT 'file:' || c.path, 'file:' || s.path, 'imports', NULL::INT, 0.95, 'import' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust c ON o_custkey = c_custkey JOIN supp s ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.09 AND c.path <> s.path),
edges AS (SELECT source, target, kind, line, min(confidence)::DOUBLE AS confidence, min(resolved_by) AS resolved_by FROM raw GROUP BY source, target, kind, line)"""
