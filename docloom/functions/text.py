"""Text expressions: all are built-in functions, none leaves the JVM but json formatting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_TRIM = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+\z"


def java(pattern: str) -> str:
    """A pattern with ASCII word edges and only \\n as line end, whatever the characters around."""
    # next to a plain letter one look is enough
    p = re.sub(r"\\b(?=[A-Za-z])", lambda _: f"(?<!{_W})", pattern)
    p = re.sub(r"(?<=[A-Za-z])(?<!\\[A-Za-z])\\b", lambda _: f"(?!{_W})", p)
    p = p.replace(r"\b", _EDGE)
    return p.replace("(?m)", "(?md)") if "(?m)" in p else p


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """keep and one row per entry of an array that is dear to compute.

    An inner explode would have the optimizer infer a filter on the array's size and push it down, which computes the array
    a second time and before any repartitioning; an outer one with a filter on its output does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern)))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, java(pattern), to)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, lower case; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^/]\.([^./]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def occurrences(text: Column, term: Column) -> Column:
    """Whole-word occurrences of a term in a text, case ignored; the term is a column."""
    pattern = F.concat(F.lit(f"(?<!{_W})"), escape_regex(F.lower(term)), F.lit(f"(?!{_W})"))
    # an edge needs a word character on one side, so a term that begins or ends with none must touch one
    head = F.when(F.lower(term).rlike(rf"^{_W}"), F.lit(f"(?<!{_W})")).otherwise(F.lit(f"(?<={_W})"))
    tail = F.when(F.lower(term).rlike(rf"{_W}\z"), F.lit(f"(?!{_W})")).otherwise(F.lit(f"(?={_W})"))
    return F.when(F.lower(term).rlike(rf"^{_W}(.*{_W})?\z"), F.regexp_count(F.lower(text), pattern)).otherwise(F.regexp_count(F.lower(text), F.concat(head, escape_regex(F.lower(term)), tail)))


def query_terms(q: Column) -> Column:
    """Lower-cased terms of a query; what stands in double quotes is one. One character or less is none; first ones are kept."""
    raw = F.regexp_extract_all(F.lower(q), F.lit(r'"([^"]*)"|(\S+)'), F.lit(0))
    bare = F.transform(raw, lambda t: F.when(t.rlike(r'^"[^"]*"\z'), F.substring(t, 2, 1 << 30).substr(F.lit(1), F.length(t) - 2)).otherwise(t))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) > 1))


def word_terms(q: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(q), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


def query_hash(q: Column) -> Column:
    return F.base64(F.encode(q, "UTF-8"))


def repo_name(url: Column) -> Column:
    """owner_repo of a repository's address; org_project_repo on the hosts that have projects."""
    bare = F.regexp_replace(url, r"\.git\z", "")
    parts = F.split(bare, "/")
    full = F.filter(parts, lambda p: p != "")
    at = F.array_position(full, "_git")
    three = F.concat_ws("_", F.try_element_at(full, (at - 2).cast("int")), F.try_element_at(full, (at - 1).cast("int")), F.try_element_at(full, (at + 1).cast("int")))
    hosted = (bare.contains("dev.azure.com") | bare.contains("visualstudio.com")) & (at > 2) & (F.size(full) > at)
    fallback = F.substring(F.regexp_replace(F.regexp_replace(bare, r"^https?://", ""), "[^a-zA-Z0-9]", "_"), 1, 50)
    return F.when(hosted, three).when(F.size(parts) >= 2, F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(fallback)


def safe_filename(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_"), "_{2,}", "_")
    return F.substring(F.regexp_replace(s, r"^_+|_+\z", ""), 1, 255)


def is_access_error(message: Column) -> Column:
    from docloom.functions.values import ACCESS_ERRORS

    return F.lower(message).rlike("|".join(ACCESS_ERRORS))


def strip_code_comments(c: Column) -> Column:
    s = F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")
    s = F.regexp_replace(s, r"//[^\r\n]*", "")
    s = F.regexp_replace(s, r"^#!", "")
    return F.regexp_replace(s, r"(?md)^#[^\r\n]*", "")


def strip_css_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")


def strip_markup_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"<!--[\s\S]*?-->", "")


@F.pandas_udf(T.StringType())
def pretty_json(c: pd.Series) -> pd.Series:
    """JSON with an indent of two; what is no JSON is passed on."""
    return c.map(lambda s: _pretty(s)[0] if s is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_key_paths(c: pd.Series) -> pd.Series:
    """Dotted paths of all keys; arrays are not entered but at the root, where positions are keys. Null for no JSON."""
    return c.map(lambda s: _pretty(s)[1] if s is not None else None)


def _pretty(s: str) -> tuple[str, list[str] | None]:
    try:
        value = json.loads(s)
    except ValueError:
        return s, None
    keys: list[str] = []

    def walk(o: object, prefix: str) -> None:
        for k, v in o.items() if isinstance(o, dict) else enumerate(o):  # type: ignore[arg-type]
            keys.append(f"{prefix}.{k}" if prefix else str(k))
            if isinstance(v, dict):
                walk(v, keys[-1])

    if isinstance(value, dict | list):
        walk(value, "")
    return json.dumps(value, indent=2, ensure_ascii=False), keys


def post_process(c: Column, ext: Column) -> Column:
    """A file's text by its extension: comments stripped, JSON formatted, else unchanged."""
    return (
        F.when(ext.isin("js", "ts", "java", "c", "cpp"), strip_code_comments(c))
        .when(ext.isin("css", "scss"), strip_css_comments(c))
        .when(ext.isin("html", "xml"), strip_markup_comments(c))
        .when(ext == "json", pretty_json(c))
        .otherwise(c)
    )


def embedding_text(c: Column) -> Column:
    """Trimmed, cut to 1997 characters and an ellipsis when longer than 2000, then runs of white space made one blank."""
    t = trim(c)
    return F.regexp_replace(F.when(F.length(t) > 2000, F.concat(F.substring(t, 1, 1997), F.lit("..."))).otherwise(t), r"\s+", " ")


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")
