import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.chat_trees import as_trees, escape, format_trees, format_turns, leaf_paths, masked_text, parse_turns, read_back, unescape

TEXT = st.text(alphabet="<|>\\imstard_n \né", max_size=30)


@given(TEXT)
def test_escape_round_trip(t):
    assert unescape(escape(t)) == t and "<|" not in escape(t)


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", ""]), TEXT), max_size=5))
def test_format_round_trip(turns):
    text, spans = format_turns(turns)
    assert parse_turns(text) == turns
    assert masked_text(text, spans) == "".join(t for r, t in turns if r == "assistant")


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, None), (1, 5, 99, "user", "orphan", 0.0), (2, 1, None, "user", "tie", 0.5), (2, 2, 1, "assistant", "a", 0.5), (2, 3, 1, "assistant", "b", 0.5)]
    m = spark.createDataFrame(rows, "tree_id long, node long, parent long, role string, text string, score double")
    got = {(r["tree_id"], r["rank"]): r for r in format_trees(m, best=2).collect()}
    assert got[1, 1]["leaf"] == 4 and got[1, 1]["n_turns"] == 3 and parse_turns(got[1, 1]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert got[1, 2]["leaf"] == 2 and (got[2, 1]["leaf"], got[2, 2]["leaf"]) == (2, 3)
    assert {r["leaf"] for r in leaf_paths(m).where("tree_id = 1").collect()} == {2, 4, 5}


def test_linear_conversations(spark):
    n = 70
    rows = [(7, k, "assistant" if k % 2 else "user", f"t{k} <|im_end|>") for k in range(n)] + [(8, 0, None, None), (8, 0, None, None), (None, 1, "user", "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_back(format_trees(as_trees(c))).collect()}
    said = "".join(f"t{k} <|im_end|>" for k in range(1, n, 2))
    assert got[7]["n_turns"] == n and got[7]["loss_chars"] == len(said) and got[7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[8]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert read_back(format_trees(as_trees(c.where("false")))).count() == 0
