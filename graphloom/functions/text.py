"""Column functions of the engine: paths, names and ranking scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight that a kind of symbol adds to a search score.
KIND_BONUS = {
    "function": 10,
    "method": 10,
    "interface": 9,
    "trait": 9,
    "protocol": 9,
    "class": 8,
    "route": 9,
    "component": 8,
    "type_alias": 6,
    "struct": 6,
    "enum": 5,
    "module": 4,
    "namespace": 4,
    "property": 3,
    "field": 3,
    "constant": 3,
    "enum_member": 3,
    "variable": 2,
    "import": 1,
    "export": 1,
    "parameter": 0,
    "file": 0,
}


def glob_regex(pattern: str) -> str:
    """An anchored regex for a path glob: ``*`` inside a segment, ``**`` any, ``**/`` any directories, a trailing
    ``/`` everything below."""
    out, i = [], 0
    if pattern.endswith("/"):
        pattern += "**"
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def path_filter(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """True where the path matches some include (or there is none) and no exclude."""
    ok = F.lit(not include)
    for p in include:
        ok = ok | path.rlike(glob_regex(p))
    for p in exclude:
        ok = ok & ~path.rlike(glob_regex(p))
    return ok


def wildcard(value: Column, pattern: str) -> Column:
    """Anchored match with ``*`` and ``?``."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return value.rlike(f"^{body}$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The directory, ``.`` for the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


# Names of directories and files that mark tests, and directories that are not production code.
TEST_DIRS = "tests?|__tests__|specs?|testlib|testing"
OTHER_DIRS = "integration|samples?|examples?|fixtures?|benchmarks?|demos?"
TEST_NAMES = (r"^test[_.]", r"[._-](tests?|specs?)\.[a-z0-9]+$")
TEST_CAMEL = (r"(Tests?|TestCase|Tester|Specs?)\.[A-Za-z0-9]+$", r"(^|/)[A-Za-z0-9]*(Tests?|Spec)/")
AFFECTED_TESTS = (r"\.spec\.", r"\.test\.", "/__tests__/", "/tests?/", "/e2e/", "/spec/")


def is_test_file(path: Column) -> Column:
    """Names and directories that mark tests; camel case is judged as written."""
    low, name = F.lower(path), base_name(path)
    found = low.rlike(f"/({TEST_DIRS})/|^(tests?|specs?)/|(^|/)({OTHER_DIRS})/")
    for p in TEST_NAMES:
        found = found | F.lower(name).rlike(p)
    return found | name.rlike(TEST_CAMEL[0]) | path.rlike(TEST_CAMEL[1])


def is_affected_test(path: Column) -> Column:
    """The narrower test of the affected-tests operator."""
    return path.rlike("|".join(AFFECTED_TESTS))


def kind_bonus(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in KIND_BONUS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def name_bonus(name: Column, query: str) -> Column:
    """80 for the name itself, 60 for one of its words alone, 10 to 40 for a beginning by how much of it is given,
    15 for all words, 10 for a part."""
    q = query.lower().replace(" ", "")
    words = [w for w in re.split(r"\s+", query.lower()) if w]
    n = F.lower(name)
    ladder = F.when(n == q, 80)
    if len(words) > 1:
        ladder = ladder.when(n.isin(words), 60)
    ladder = ladder.when(n.startswith(q), F.floor(F.lit(10.5) + F.lit(30.0) * len(q) / F.length(n)).cast("int"))
    if len(words) > 1:
        every = F.lit(True)
        for w in words:
            every = every & n.contains(w)
        ladder = ladder.when(every, 15)
    return ladder.when(n.contains(q), 10).otherwise(0)


def path_relevance(path: Column, terms: list[str], wants_tests: bool = False) -> Column:
    """10 for a term in the file name, 5 in a directory, else 3 in the path; 15 off for tests not asked for."""
    low, name, dirs = F.lower(path), F.lower(base_name(path)), F.lower(dir_name(path))
    total = F.lit(0)
    for t in terms:
        total = total + F.when(name.contains(t), 10).otherwise(0) + F.when(dirs.contains(t), 5).when(low.contains(t), 3).otherwise(0)
    return total if wants_tests else total - F.when(is_test_file(path), 15).otherwise(0)
