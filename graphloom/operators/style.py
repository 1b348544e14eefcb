"""Style sheets and markup: selectors, specificity, class and token uses, links; regular expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed by the language: pseudo-elements that may be written with one colon.
OLD_PSEUDO_ELEMENTS = ("before", "after", "first-line", "first-letter")
_NAME = r"(?:[\p{L}_-]|\\.)(?:[\p{L}\p{N}_-]|\\.)*"


def specificity(selector: Column) -> Column:
    """A selector's weight by the rules of cascading style sheets, as 100 a + 10 b + c.

    a: ids; b: classes, attributes and pseudo-classes; c: types and pseudo-elements. ``:where(...)`` weighs nothing.
    ``:is``, ``:not`` and ``:has`` weigh what their arguments do, which are counted like the rest of the selector
    (of a list all its members, not the heaviest alone). Strings in attributes and comments hold no selectors.
    """
    bare = F.regexp_replace(F.coalesce(selector, F.lit("")), r"(?s)/[*].*?[*]/", " ")
    attributes = F.regexp_count(bare, F.lit(r"\[[^\]]*\]"))
    rest = F.regexp_replace(bare, r"\[[^\]]*\]", "")
    rest = F.regexp_replace(rest, r":where\([^()]*\)", "")
    rest = F.regexp_replace(rest, r":(?:is|not|has)\(([^()]*)\)", " $1 ")
    # what is left is cut into simple selectors; arguments of other pseudo-classes are not selectors
    rest = F.regexp_replace(rest, r"\([^()]*\)", "")
    old = "|".join(OLD_PSEUDO_ELEMENTS)
    parts = F.regexp_extract_all(rest, F.lit(f"(::?|[.#])?{_NAME}"), F.lit(0))
    kind = lambda x: (
        F.when(x.startswith("#"), 100)
        .when(x.startswith("::") | x.rlike(f"^:(?:{old})$"), 1)
        .when(x.startswith(".") | x.startswith(":"), 10)
        .otherwise(1)
    )
    weights = F.transform(parts, kind)
    return (F.aggregate(weights, F.lit(0), lambda a, w: a + w) + 10 * attributes).cast("int")


def style_rules(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, selector, body) of every rule in ``<style>`` elements."""
    sheets = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("(?s)<style[^>]*>(.*?)</style>"), F.lit(1)))
    rules = pages.select(key, sheets.alias("css")).select(key, F.explode(F.regexp_extract_all("css", F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))).alias("rule"))
    one = rules.select(key, F.explode(F.split(F.substring_index("rule", "{", 1), ",")).alias("selector"), F.regexp_extract("rule", r"\{([^{}]*)\}", 1).alias("body"))
    return one.select(key, F.trim("selector").alias("selector"), F.trim("body").alias("body"))


def class_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, token) for every class named in a ``class`` attribute."""
    attr = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('class="([^"]*)"'), F.lit(1)))
    tokens = pages.select(key, attr.alias("a")).select(key, F.explode(F.split("a", r"\s+")).alias("token"))
    return tokens.where("token <> ''")


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


def custom_properties(rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, token, value) of custom properties defined in rule bodies."""
    d = rules.select(key, F.explode(F.regexp_extract_all("body", F.lit(r"(--[\w-]+\s*:\s*[^;]+)"), F.lit(1))).alias("d"))
    return d.select(key, F.trim(F.substring_index("d", ":", 1)).alias("token"), F.trim(F.expr("substring(d, instr(d, ':') + 1)")).alias("value"))


def token_uses(rules: DataFrame, token: str, key: str = "page_id") -> DataFrame:
    """Keys whose rules use ``var(token)``; the bare name is asked for."""
    if token.startswith("var("):
        raise ValueError("give the bare token name")
    return rules.where(F.col("body").rlike(rf"var\(\s*{token}\s*[,)]")).select(key).distinct()


def unused_selectors(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Class selectors that no markup names."""
    used = tokens.select(F.concat(F.lit("."), "token").alias("selector")).distinct()
    return rules.where(F.col("selector").startswith(".")).select("selector").distinct().join(used, "selector", "left_anti")
