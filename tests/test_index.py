"""A small source tree indexed, asked and synchronised."""

import json

from graphloom import __main__ as cli
from graphloom.api import SymbolGraph
from graphloom.operators import context as X
from graphloom.plans import index as I
from graphloom.sources.scan import scan, scan_stats


def tree(root):
    (root / "pkg").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "pkg/base.py").write_text("class Base:\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return 1\n")
    (root / "pkg/main.py").write_text("from pkg.base import Base\n\n\nclass Child(Base):\n    def go(self):\n        return helper()\n\n\ndef unused():\n    return 2\n")
    (root / "tests/test_main.py").write_text("def test_it():\n    unused_name()\n")
    (root / "server.pem").write_text("SECRET=1\n")
    (root / "notes.txt").write_text("x\n")


def test_index_ask_and_sync(spark, tmp_path, capsys):
    root = tmp_path / "src"
    tree(root)
    stats = {r["reason"]: r["n"] for r in scan_stats(scan(spark, str(root))).collect()}
    assert stats == {"read": 3, "sensitive": 1, "language": 1}
    g = SymbolGraph.index(spark, str(root), str(tmp_path / "one"))
    assert {r["name"] for r in g.callers("helper").collect()} == {"run", "go"}
    assert [r["role"] for r in g.hierarchy("Child").where("role = 'ancestor'").collect()] == ["ancestor"]
    assert "helper" in {r["name"] for r in g.search("helper").collect()}
    assert g.impact("helper", 1).where("name = 'go'").count() == 1
    assert g.context("how does helper work?").where("name = 'helper'").count() == 1
    files = scan(spark, str(root)).where("skip_reason is null")
    block = X.code_blocks(g.context("helper"), g.nodes, files).where("code like 'def helper%'").first()
    assert block["code"] == "def helper():\n    return 1"
    (root / "pkg/base.py").write_text("\n\ndef helper():\n    return 1\n")
    (root / "pkg/new.py").write_text("def fresh():\n    return helper()\n")
    (root / "tests/test_main.py").unlink()
    changes = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in I.sync(spark, str(root), str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert changes == {"base.py": "modified", "new.py": "added", "test_main.py": "removed"}
    h = SymbolGraph.open(spark, str(tmp_path / "two"))
    assert {r["name"] for r in h.callers("helper").collect()} == {"go", "fresh"}
    cli.main(["callers", str(tmp_path / "two"), "helper"])
    out = json.loads(capsys.readouterr().out)
    assert (out["schemaVersion"], out["tool"]) == (1, "callers") and len(out["results"]) == 2


def test_terms_and_metrics(spark):
    assert X.search_terms("How does PaymentService persist_order work?") == ["paymentservice", "payment", "service", "persist_order", "persist", "order"]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "case int, name string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "c"), (2, "q")], "case int, name string")
    got = {r["case"]: (r["recall"], r["precision"], r["mrr"]) for r in X.evaluate(ranked, expected).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
