"""Source files to symbols and references, one file a row of ``mapInPandas``.

Python is parsed with the standard ``ast`` module; other languages by line patterns (no grammars are at hand), which
cover top-level and class-level definitions, imports, and HTTP routes. Fingerprints agree among themselves only.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "file_path string, record string, kind string, name string, qualified_name string, start_line int, end_line int, parent string, is_exported boolean, ast_hash string, ast_shape_hash string"

# Languages by file extension.
LANGUAGES = {
    "py": "python", "pyw": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp",
    "php": "php", "rb": "ruby", "rake": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "scala": "scala", "lua": "lua",
    "luau": "luau", "pas": "pascal", "svelte": "svelte", "vue": "vue", "liquid": "liquid", "css": "css",
}

_WORD = r"([A-Za-z_$][\w$]*)"
PATTERNS = {
    "typescript": [("class", rf"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_WORD}"), ("interface", rf"^\s*(export\s+)?interface\s+{_WORD}"), ("function", rf"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_WORD}"), ("function", rf"^\s*(export\s+)?(?:const|let|var)\s+{_WORD}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"), ("type_alias", rf"^\s*(export\s+)?type\s+{_WORD}\s*="), ("enum", rf"^\s*(export\s+)?(?:const\s+)?enum\s+{_WORD}")],
    "go": [("function", rf"^()func\s+{_WORD}\s*\("), ("method", rf"^()func\s+\([^)]*\)\s+{_WORD}\s*\("), ("struct", rf"^()type\s+{_WORD}\s+struct\b"), ("interface", rf"^()type\s+{_WORD}\s+interface\b")],
    "rust": [("function", rf"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_WORD}"), ("struct", rf"^\s*(pub\s+)?struct\s+{_WORD}"), ("trait", rf"^\s*(pub\s+)?trait\s+{_WORD}"), ("enum", rf"^\s*(pub\s+)?enum\s+{_WORD}")],
    "java": [("class", rf"^\s*(public\s+)?(?:abstract\s+|final\s+|static\s+)*class\s+{_WORD}"), ("interface", rf"^\s*(public\s+)?interface\s+{_WORD}"), ("method", rf"^\s+(public\s+)?(?:private\s+|protected\s+|static\s+|final\s+)*[\w<>\[\], ]+\s+{_WORD}\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{{")],
    "ruby": [("class", rf"^\s*()class\s+{_WORD}"), ("module", rf"^\s*()module\s+{_WORD}"), ("method", r"^\s*()def\s+(?:self\.)?([\w?!]+)")],
    "php": [("class", rf"^\s*()(?:abstract\s+|final\s+)?class\s+{_WORD}"), ("function", rf"^\s*()(?:public\s+|private\s+|protected\s+|static\s+)*function\s+{_WORD}")],
}
PATTERNS |= {k: PATTERNS["typescript"] for k in ("tsx", "javascript", "jsx", "svelte", "vue")} | {k: PATTERNS["java"] for k in ("csharp", "kotlin", "scala", "dart")}
IMPORTS = {
    "typescript": r"""^\s*(?:import|export)\b.*?from\s+['"]([^'"]+)['"]|^\s*import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""",
    "go": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$',
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)",
    "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",
    "php": r"^\s*use\s+([\w\\]+)",
}
IMPORTS |= {k: IMPORTS["typescript"] for k in ("tsx", "javascript", "jsx", "svelte", "vue")} | {k: IMPORTS["java"] for k in ("csharp", "kotlin", "scala", "dart")}
ROUTES = [
    r"""\b(?:app|router|server)\.(get|post|put|patch|delete)\(\s*['"`]([^'"`]+)['"`]\s*,.*?([\w.]+)\s*\)\s*;?\s*$""",
    r"""^\s*@\w+\.(get|post|put|patch|delete|route)\(\s*['"]([^'"]+)['"]()""",
    r"""^\s*Route::(get|post|put|patch|delete)\(\s*['"]([^'"]+)['"]\s*,\s*\[?([\w:\\@']+)""",
    r"""@(Get|Post|Put|Patch|Delete)(?:Mapping)?\(\s*['"]([^'"]+)['"]()""",
]


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _shape(node: ast.AST) -> str:
    """The tree without names and constants."""
    return type(node).__name__ + "(" + ",".join(_shape(c) for c in ast.iter_child_nodes(node)) + ")"


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return node.attr if head in (None, "self", "cls", "super") else f"{head}.{node.attr}"
    return None


def python_rows(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []

    def visit(node: ast.AST, scope: list[str], in_class: bool) -> None:
        owner = "::".join(scope) or None
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if in_class else "function"
                qualified = "::".join([*scope, c.name])
                exact, shape = (None, None) if kind == "class" else (_hash(ast.dump(ast.Module(c.body, []))), _hash(_shape(ast.Module(c.body, []))))
                rows.append((path, "node", kind, c.name, qualified, c.lineno, c.end_lineno, owner, not c.name.startswith("_") and not scope, exact, shape))
                for d in c.decorator_list:
                    name = _dotted(d.func if isinstance(d, ast.Call) else d)
                    if name:
                        rows.append((path, "ref", "decorates", name, None, d.lineno, None, qualified, None, None, None))
                for b in getattr(c, "bases", []):
                    if _dotted(b):
                        rows.append((path, "ref", "extends", _dotted(b), None, b.lineno, None, qualified, None, None, None))
                visit(c, [*scope, c.name], kind == "class")
                continue
            if isinstance(c, (ast.Import, ast.ImportFrom)):
                names = [a.name for a in c.names] if isinstance(c, ast.Import) else ["." * c.level + (c.module or "")]
                rows.extend((path, "ref", "imports", n, None, c.lineno, None, owner, None, None, None) for n in names)
            elif isinstance(c, ast.Call) and _dotted(c.func):
                rows.append((path, "ref", "calls", _dotted(c.func), None, c.lineno, None, owner, None, None, None))
            visit(c, scope, False if not isinstance(c, ast.If) else in_class)

    visit(ast.parse(text), [], False)
    return rows


def pattern_rows(path: str, text: str, language: str) -> list[tuple]:
    rows: list[tuple] = []
    for n, line in enumerate(text.split("\n"), 1):
        for kind, pattern in PATTERNS.get(language, ()):
            if m := re.match(pattern, line):
                exported = bool(m[1]) or (language == "go" and m[2][:1].isupper())
                rows.append((path, "node", kind, m[2], m[2], n, n, None, exported, None, None))
                break
        if language in IMPORTS and (m := re.search(IMPORTS[language], line)):
            rows.append((path, "ref", "imports", next(g for g in m.groups() if g), None, n, None, None, None, None, None))
        for pattern in ROUTES:
            if m := re.search(pattern, line):
                route = f"{m[1].upper()} {m[2]}"
                rows.append((path, "node", "route", route, f"{path}::{m[1].upper()}:{m[2]}", n, n, None, False, None, None))
                if m[3]:
                    rows.append((path, "ref", "references", m[3], None, n, None, route, None, None, None))
                break
    return rows


def file_rows(path: str, text: str) -> list[tuple]:
    language = language_of(path)
    if language is None:
        return []
    rows = [(path, "node", "file", path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1, None, False, None, None)]
    try:
        rows += python_rows(path, text) if language == "python" else []
    except SyntaxError as e:
        rows.append((path, "error", "parse", str(e.msg), None, e.lineno, None, None, None, None, None))
    rows += pattern_rows(path, text, language)
    return rows


#: Source files are small on disk and dear to parse, so they are dealt out to so many tasks a core.
TASKS = 4


def extract(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """``files`` (path, content text) to rows of symbols, references and errors; larger files give a warning row."""
    names = [c.split()[0] for c in SYMBOLS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                if text is not None and len(text.encode()) > max_bytes:
                    rows.append((path, "error", "size", "file is too large", None, None, None, None, None, None, None))
                else:
                    rows += file_rows(path, text or "")
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "Int32", "end_line": "Int32", "is_exported": "boolean"})

    tasks = TASKS * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(tasks, "path").mapInPandas(run, SYMBOLS)
