from pyspark.sql import functions as F

from graphloom.operators.search import parse_query
from graphloom.sources.scan import scan, skip_reason


def test_skipped_by_path_and_size(spark):
    want = {"a/main.py": None, "a/api_key.py": "sensitive", "src/my-secrets.ts": "sensitive", "secretary.py": None, "keys/x.p8": "sensitive", "identity": "sensitive", "ID_RSA": "sensitive", "credentials.json": "sensitive", "private.key.go": "sensitive", "node_modules/x.js": "ignored", "a.txt": "language", "tool.pyw": None, "b.kts": None}
    df = spark.createDataFrame([(p, 10) for p in want] + [("big.py", 1 << 21)], "path string, size long")
    got = {r["path"]: r["r"] for r in df.select("path", skip_reason(F.col("path"), F.col("size")).alias("r")).collect()}
    assert got == want | {"big.py": "size"}


def test_contents_of_skipped_files_are_not_hashed(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "secret.py").write_text("y = 2\n")
    rows = {r["path"].lstrip("/"): r for r in scan(spark, str(tmp_path)).collect()}
    assert rows["a.py"]["content"] == "x = 1\n" and rows["a.py"]["content_hash"]
    assert rows["secret.py"]["content"] is None and rows["secret.py"]["content_hash"] is None


def test_unknown_kinds_are_text():
    q = parse_query("kind:invalid foo kind:Function lang:go")
    assert (q.kinds, q.languages, q.text) == (["function"], ["go"], "kind:invalid foo")
