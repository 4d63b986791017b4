"""Rewriting of contents for search: by kind of content, then for all, then a header with the context."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import values as V
from docloom.functions.text import basename, directory, java, json_key_paths, lines, matches, pretty_json, replace, trim


def comments(c: Column, language: Column) -> Column:
    """Texts of comments longer than five characters, pattern by pattern (a doc block counts by two of them)."""
    none = F.array().cast("array<string>")
    kind = F.coalesce(*[F.when(language == lang, k) for lang, k in V.COMMENT_KIND.items()], F.lit(""))
    found = none
    for k, patterns in V.COMMENTS_OF.items():
        each = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(kind == k, each).otherwise(found)
    return F.filter(F.transform(found, trim), lambda t: F.length(t) > 5)


def has_documentation(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [matches(c, p) for p in V.DOC_FLAGS])


def normalise_whitespace(c: Column) -> Column:
    return replace(replace(replace(c, r"[ \t]+", " "), r"\n +", "\n"), r"\n{3,}", "\n\n")


def reduce_syntax_noise(c: Column, language: Column) -> Column:
    script = replace(replace(c, ";{2,}", ";"), r"\){2,}", ")")
    return F.when(language.isin("javascript", "typescript"), script).when(language == "json", pretty_json(c)).otherwise(c)


def mark_identifiers(c: Column, language: Column) -> Column:
    script = replace(c, r"\b(export\s+(?:default\s+)?(?:class|function|const|let|var)\s+)(\w+)", "$1[IDENTIFIER: $2]")
    script = replace(script, r"\b(import\s+[^\n]*?\s+from\s+['\"`])([^'\"`]+)(['\"`])", "$1[MODULE: $2]$3")
    python = replace(replace(c, r"\b(def\s+)(\w+)", "$1[FUNCTION: $2]"), r"\b(class\s+)(\w+)", "$1[CLASS: $2]")
    return F.when(language.isin("javascript", "typescript"), script).when(language == "python", python).otherwise(c)


def normalise_markdown(c: Column) -> Column:
    for p, to in ((r"#{1,6}\s*([^\n]+)", "[HEADER: $1]"), (r"\*\*([^\n]+?)\*\*", "[BOLD: $1]"), (r"\*([^\n]+?)\*", "[ITALIC: $1]"), (r"`([^\n]+?)`", "[CODE: $1]")):
        c = replace(c, p, to)
    return c


def mark_key_concepts(c: Column) -> Column:
    for term in V.KEY_TERMS:
        c = replace(c, rf"(?i)\b({term})\b", "[KEY: $1]")
    return c


def documentation_readability(c: Column) -> Column:
    return replace(replace(replace(c, r"\n{4,}", "\n\n\n"), r"[ \t]{3,}", "  "), r"([.!?])\s*\n\s*([A-Z])", "$1\n\n$2")


def readability(c: Column) -> Column:
    for p, to in ((r"([.!?])\s*([A-Z])", "$1 $2"), (r"([,;])\s*([a-zA-Z])", "$1 $2"), (r"\s{2,}", " "), (r"\n\s*\n\s*\n", "\n\n")):
        c = replace(c, p, to)
    return c


def universal(c: Column) -> Column:
    """Back-slashes, line ends, trailing blanks, blank lines and common encoding damage."""
    c = F.regexp_replace(c, r"\\\\+", r"\\")
    c = F.regexp_replace(c, "\r\n", "\n")
    c = F.regexp_replace(c, r"(?md)[ \t]+$", "")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    for bad, good in V.MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def yaml_keys(c: Column) -> Column:
    return F.filter(F.transform(lines(c), lambda x: F.regexp_extract(x, r"^\s*([a-zA-Z0-9_-]+)\s*:", 1)), lambda k: k != "")


def xml_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"<([a-zA-Z0-9_-]+)(?:\s|>)"), F.lit(1)))


def config_keys(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?md)^([a-zA-Z0-9_-]+)\s*[=:]"), F.lit(1))


def config_terms(c: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.lower(c), F.lit(java(p)), F.lit(0)) for p in V.CONFIG_TERMS]))


def _listed(c: Column, label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(c, F.lit(f"\n[{label}: "), F.concat_ws(", ", items), F.lit("]"))).otherwise(c)


def json_config(c: Column) -> Column:
    keys = json_key_paths(c)
    return F.when(keys.isNull(), c).otherwise(_listed(pretty_json(c), "CONFIG_KEYS", F.coalesce(keys, F.array().cast("array<string>"))))


def enhance_config(c: Column, language: Column) -> Column:
    s = F.when(language == "json", json_config(c)).when(language == "yaml", _listed(c, "YAML_KEYS", yaml_keys(c))).when(language == "xml", _listed(c, "XML_TAGS", xml_tags(c))).otherwise(_listed(c, "CONFIG_KEYS", config_keys(c)))
    return s


def enhance_code(c: Column, language: Column, found: Column) -> Column:
    s = mark_identifiers(reduce_syntax_noise(normalise_whitespace(c), language), language)
    said = F.concat_ws(" ", F.filter(found, lambda t: F.length(t) > 10))
    return F.when(F.length(said) > 0, F.concat(s, F.lit("\n\n/* Extracted Comments: "), said, F.lit(" */"))).otherwise(s)


def context_header(path: Column, kind: Column, language: Column, ext: Column) -> Column:
    parts = F.filter(F.split(directory(path), r"[/\\]"), lambda p: p != "")
    where = F.when(F.size(parts) > 0, F.concat(F.lit("Location: "), F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))))
    return F.concat(F.lit("[Context: "), F.concat_ws(" | ", F.concat(F.lit("File: "), basename(path)), where, F.concat(F.lit("Type: "), kind, F.lit(" ("), language, F.lit(")")), F.when(F.length(ext) > 0, F.concat(F.lit("Format: "), ext))), F.lit("]\n\n"))


def line_kind(line: Column) -> Column:
    t = trim(line)
    return F.when(t.rlike(r"^(function|class|def|import|export|const|let|var)\s"), "code").when(t.rlike(r"^[a-zA-Z0-9_-]+\s*[=:]"), "config").otherwise("docs")


def sections(c: Column) -> Column:
    """Runs of lines of one kind, as array<struct<kind,content>>; blank runs are left out. The first kind is docs."""
    empty = F.array().cast("array<struct<kind:string,content:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        line = F.struct(x["kind"].alias("kind"), F.concat(x["line"], F.lit("\n")).alias("content"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["kind"].alias("kind"), F.concat(last["content"], line["content"]).alias("content"))))
        return F.when((F.size(acc) > 0) & (last["kind"] == x["kind"]), grown).otherwise(F.concat(acc, F.array(line)))

    typed = F.transform(lines(c), lambda x: F.struct(line_kind(x).alias("kind"), x.alias("line")))
    return F.filter(F.aggregate(typed, empty, step), lambda s: F.length(trim(s["content"])) > 0)


@F.pandas_udf(T.StringType())
def placeholder_blocks(c: pd.Series) -> pd.Series:
    """Fenced blocks replaced by numbered placeholders, as the strict sentence-aware chunking does; they are not put back."""
    import re

    def one(s: str) -> str:
        n = iter(range(1 << 30))
        return re.sub(r"```[\s\S]*?```", lambda _: f"__PRESERVED_BLOCK_{next(n)}__", s)

    return c.map(lambda s: one(s) if s is not None else None)


def enhance(df: DataFrame, content: str = "content", path: str = "file_path", kind: str = "content_type", language: str = "language", ext: str = "file_extension") -> DataFrame:
    """df with enhanced_content, has_comments and has_documentation; null content counts as empty."""
    c, k, lang = F.coalesce(F.col(content), F.lit("")), F.col(kind), F.col(language)
    df = df.withColumn("_comments", comments(c, lang)).withColumn("_sections", F.when(k == "mixed", sections(c)))
    inside = F.col("_sections")
    flags = {
        "has_comments": F.when(k == "code", F.size("_comments") > 0).when(k == "mixed", F.exists(inside, lambda s: (s["kind"] == "code") & (F.size(comments(s["content"], lang)) > 0))).otherwise(False),
        "has_documentation": F.when(k == "code", has_documentation(c)).when(k == "docs", True).when(k == "mixed", F.exists(inside, lambda s: (s["kind"] == "docs") | ((s["kind"] == "code") & has_documentation(s["content"])))).otherwise(False),
    }
    df = df.withColumns(flags)
    df = df.withColumn("_config", F.when(k == "config", enhance_config(c, lang)))
    body = F.when(k == "code", enhance_code(c, lang, F.col("_comments"))).when(k == "docs", documentation_readability(mark_key_concepts(normalise_markdown(c)))).when(k == "config", _listed(F.col("_config"), "CONFIG_TERMS", config_terms(F.col("_config")))).otherwise(readability(normalise_whitespace(c)))
    df = df.withColumn("_body", body)
    return df.withColumn("enhanced_content", F.concat(context_header(F.col(path), k, lang, F.col(ext)), universal(F.col("_body")))).drop("_comments", "_sections", "_config", "_body")
