"""Content type, language, quality and authority of texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.functions.text import clamp, count, let, lines, matches, trim


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _score(c: Column, patterns: list[str], each: float, most: float) -> Column:
    return _sum([F.least(F.lit(most), count(c, p) * each) for p in patterns])


def code_score(c: Column) -> Column:
    return F.least(F.lit(1.0), _score(c, V.CODE_SCORE, 0.1, 0.3))


def docs_score(c: Column) -> Column:
    sentences = F.size(F.filter(F.split(c, "[.!?]+"), lambda s: F.length(trim(s)) > 10))
    return F.least(F.lit(1.0), _score(c, V.DOCS_SCORE, 0.05, 0.2) + F.when(sentences > 3, 0.3).otherwise(0.0))


def config_score(c: Column) -> Column:
    return F.least(F.lit(1.0), _score(c, V.CONFIG_SCORE, 0.1, 0.4))


def language(c: Column, ext: Column) -> Column:
    """Language of code: by extension, overruled by the first language of which two patterns match."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in V.EXT_LANGUAGE.items() for x in kv]), ext)
    known = F.coalesce(F.when(ext.isin(list(V.EXT_LANGUAGE)), known), F.lit("unknown"))
    # the first with two or more decides; it overrules a known extension only with three or more
    hits = F.array(*[F.struct(F.lit(lang).alias("lang"), _sum([matches(c, p).cast("int") for p in ps]).alias("n")) for lang, ps in V.LANGUAGE_PATTERNS.items()])
    first = F.element_at(F.concat(F.filter(hits, lambda h: h["n"] >= 2), F.array(F.struct(F.lit("").alias("lang"), F.lit(0).alias("n")))), 1)
    return let(first, lambda f: F.when((f["n"] >= 2) & ((known == "unknown") | (f["n"] > 2)), f["lang"]).otherwise(known))


def semantic_density(c: Column, kind: Column) -> Column:
    spread = F.length(c) - F.length(F.regexp_replace(c, r"\s{3,}", ""))
    doubled = F.size(lines(c)) - F.size(F.array_distinct(F.transform(lines(c), trim)))
    noise = F.when(kind == "code", count(c, r"[{}();,]") + spread).when(kind == "config", doubled * 10).otherwise(count(c, r"[*_`#]"))
    return F.when(F.length(c) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - noise / F.length(c)))


def syntax_noise(c: Column, kind: Column) -> Column:
    def noisy_code(x: Column) -> Column:
        return F.regexp_count(x, F.lit(r"[{}();,\[\]]")) > F.regexp_count(x, F.lit("[a-zA-Z0-9]")) * 0.5

    def noisy_docs(x: Column) -> Column:
        n = F.regexp_count(x, F.lit(r"[*_`#\-=]"))
        return (n > F.length(x) * 0.3) | ((F.length(x) < 10) & (n > 2))

    full = F.filter(F.transform(lines(c), trim), lambda x: F.length(x) > 0)
    n = F.when(kind == "code", F.size(F.filter(full, noisy_code))).when(kind == "docs", F.size(F.filter(full, noisy_docs))).otherwise(0)
    return n / F.greatest(F.size(lines(c)), F.lit(1))


def documentation_presence(c: Column) -> Column:
    return F.least(F.lit(1.0), _score(c, V.COMMENT_PATTERNS, 0.1, 0.3) + _sum([F.when(c.contains(k), 0.1).otherwise(0.0) for k in V.DOC_KEYWORDS]))


def indent_consistent(c: Column) -> Column:
    """Whether the widths of the indents of the non-empty lines have a common divisor of at most 8 (fewer than two do)."""
    indents = F.filter(F.transform(F.filter(lines(c), lambda x: F.length(trim(x)) > 0), lambda x: F.length(F.regexp_extract(x, r"^(\s+)", 1))), lambda n: n > 0)
    # a common divisor over 8 needs every width over 8
    large = F.exists(F.sequence(F.lit(9), F.array_min(indents)), lambda k: F.forall(indents, lambda n: n % k == 0))
    return F.when(F.size(indents) < 2, True).when(F.array_min(indents) <= 8, True).otherwise(~large)


def structural_clarity(c: Column, kind: Column) -> Column:
    blank = F.size(F.filter(lines(c), lambda x: F.length(trim(x)) > 0)) == 0
    code = _sum([F.when(matches(c, p), 0.1).otherwise(0.0) for p in V.STRUCTURE_PATTERNS])
    docs = F.when(matches(c, r"(?m)^#+\s+"), 0.2).otherwise(0.0) + F.when(matches(c, r"(?m)^\s*[-*+]\s+"), 0.1).otherwise(0.0)
    extra = F.when(kind == "code", code).when(kind == "docs", docs).otherwise(0.0)
    return F.when(blank, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + F.when(indent_consistent(c), 0.2).otherwise(0.0) + extra))


def quality(kind: Column, density: Column, noise: Column, presence: Column, clarity: Column) -> Column:
    s = F.when(kind == "docs", density * 0.4 + (1 - noise) * 0.2 + presence * 0.2 + clarity * 0.2).when(kind == "code", density * 0.3 + (1 - noise) * 0.3 + presence * 0.2 + clarity * 0.2).otherwise(density * 0.4 + (1 - noise) * 0.4 + clarity * 0.2)
    return clamp(s, 0.0, 1.0)


def raw_authority(c: Column, path: Column) -> Column:
    p, low = F.lower(path), F.lower(c)
    s = F.lit(0.3) + _sum([F.when(p.contains(m), 0.15).otherwise(0.0) for m in V.PATH_MARKERS]) + _sum([F.when(low.contains(m), 0.05).otherwise(0.0) for m in V.CONTENT_MARKERS])
    s = s + F.when(is_example(c, path), 0.1).otherwise(0.0) - F.when(is_generated(c), 0.2).otherwise(0.0)
    return s + _sum([F.least(F.lit(0.15), count(c, u) * 0.05) for u in V.URL_PATTERNS])


def is_example(c: Column, path: Column) -> Column:
    p, low = F.lower(path), F.lower(c)
    return p.contains("example") | p.contains("sample") | low.contains("example") | low.contains("demo")


def is_generated(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in V.GENERATED_MARKERS])


def authority_markers(c: Column, path: Column) -> Column:
    """What raised the authority: path-, content- and url- markers (a url marker is its pattern, slashes escaped)."""
    p, low = F.lower(path), F.lower(c)
    found = [F.when(p.contains(m), F.lit(f"path-{m}")) for m in V.PATH_MARKERS] + [F.when(low.contains(m), F.lit(f"content-{m}")) for m in V.CONTENT_MARKERS] + [F.when(count(c, u) > 0, F.lit("url-" + u.replace("/", r"\/"))) for u in V.URL_PATTERNS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def classify(df: DataFrame, content: str = "content", path: str = "file_path", ext: str = "file_extension") -> DataFrame:
    """df with code_score, docs_score, config_score, content_type, language, confidence, indicators, the four quality
    factors, quality_score, authority_score, is_official_docs and authority_markers.

    Null content is treated as empty. Each stage is its own projection, so no expression is written out twice.
    """
    c, e = F.coalesce(F.col(content), F.lit("")), F.col(ext)
    df = df.withColumns({"code_score": code_score(c), "docs_score": docs_score(c), "config_score": config_score(c), "_lang": language(c, e)})
    by_ext = F.when(e.isin(V.CODE_EXT), "code").when(e.isin(V.DOCS_EXT), "docs").when(e.isin(V.CONFIG_EXT), "config").otherwise("mixed")
    top = F.greatest("code_score", "docs_score", "config_score")
    # a winner that agrees with the type hands over to the next score that equals the maximum
    chain = [F.when((F.col(f"{k}_score") == top) & (by_ext != k), F.lit(k)) for k in ("code", "docs", "config")]
    winner = F.when(top > 0.7, F.coalesce(*chain))
    df = df.withColumns({"_by_ext": by_ext, "_winner": winner})
    df = df.withColumns(
        {
            "content_type": F.when(F.col("_winner").isNotNull(), "mixed").otherwise(F.col("_by_ext")),
            "language": F.when(F.col("_by_ext") == "code", F.col("_lang")).when(F.col("_by_ext") == "docs", "natural").when(F.col("_by_ext") == "config", F.coalesce(*[F.when(e == k, v) for k, v in V.CONFIG_LANGUAGE.items()], F.lit("config"))).otherwise("unknown"),
            "confidence": F.when(F.col("_by_ext") == "mixed", 0.5).otherwise(F.when(F.col("_winner").isNotNull(), 0.6).otherwise(0.8)),
        }
    )
    df = df.withColumn("indicators", F.filter(F.array(F.when(F.col("_by_ext") != "mixed", F.concat(F.col("_by_ext"), F.lit("-extension-"), e)), F.concat(F.lit("content-suggests-"), F.col("_winner")), F.when((F.col("content_type") == "code") & (F.col("docs_score") > 0.3), F.lit("has-documentation"))), lambda x: x.isNotNull()))
    k = F.col("content_type")
    df = df.withColumns({"semantic_density": semantic_density(c, k), "syntax_noise": syntax_noise(c, k), "documentation_presence": documentation_presence(c), "structural_clarity": structural_clarity(c, k), "_authority": raw_authority(c, F.col(path)), "authority_markers": authority_markers(c, F.col(path))})
    return df.withColumns({"quality_score": quality(k, F.col("semantic_density"), F.col("syntax_noise"), F.col("documentation_presence"), F.col("structural_clarity")), "authority_score": clamp(F.col("_authority"), 0.0, 1.0), "is_official_docs": F.col("_authority") > 0.7}).drop("_lang", "_by_ext", "_winner", "_authority")
