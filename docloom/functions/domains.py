"""Domain tags of contents and domains of queries, from a weighted vocabulary.

The vocabulary is a small table of keywords; it is read once per plan into a literal array, so evidence is folded in the
vocabulary's order and no row of the data is multiplied by the number of keywords.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.functions.text import java, query_hash, word_terms
from docloom.schemas import VOCABULARY

#: The most keywords a vocabulary may have to be written into a plan.
MAX_KEYWORDS = 5_000
Vocabulary = list[tuple[str, float, dict[str, float]]]


def seed(spark: SparkSession) -> DataFrame:
    """The vocabulary at first start as a table."""
    return spark.createDataFrame([(d, list(k.items()), a, b) for d, b, k, a in V.VOCABULARY], VOCABULARY)


def default_vocabulary() -> Vocabulary:
    return [(d, b, k) for d, b, k, _ in V.VOCABULARY]


def load(table: DataFrame) -> Vocabulary:
    """A vocabulary table as a list ordered by domain; the last row of a domain holds. Keywords may be JSON text. Raises beyond
    MAX_KEYWORDS."""
    if table.schema["keywords"].dataType.simpleString() == "string":
        table = from_json(table)
    rows = table.select("domain", "boost_factor", "keywords").where("domain is not null").orderBy("domain").limit(MAX_KEYWORDS + 1).collect()
    out = {r["domain"]: (r["domain"], r["boost_factor"] if r["boost_factor"] is not None else 1.0, {k["keyword"]: k["weight"] for k in r["keywords"] or []}) for r in rows}
    if sum(len(k) for _, _, k in out.values()) > MAX_KEYWORDS:
        raise ValueError(f"a vocabulary of more than {MAX_KEYWORDS} keywords")
    return list(out.values())


def domain_names(table: DataFrame) -> DataFrame:
    """(domain), in order."""
    return table.where("domain is not null").select("domain").distinct().orderBy("domain")


def vocabulary_of(table: DataFrame, domain: str) -> DataFrame:
    """The vocabulary's row of a domain; none if it has none."""
    return table.where(F.col("domain") == domain)


def boost_of(table: DataFrame, domain: str) -> float:
    """A domain's boost, 1.0 without one."""
    row = vocabulary_of(table, domain).select(F.coalesce("boost_factor", F.lit(1.0)).alias("b")).first()
    return row["b"] if row else 1.0


def from_json(table: DataFrame) -> DataFrame:
    """Vocabulary rows whose keywords and authority_patterns are JSON text; rows with bad JSON are left out."""
    t = table.withColumns({"keywords": F.from_json("keywords", "array<struct<keyword:string,weight:double>>"), "authority_patterns": F.from_json("authority_patterns", "array<string>")})
    return t.where(F.col("keywords").isNotNull() & F.col("authority_patterns").isNotNull())


def path_evidence(path: Column) -> Column:
    """array<struct<domain,score>>: 0.8 for each domain of which the path holds an indicator."""
    p = F.lower(path)
    return F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [p.contains(i) for i in ids]), _scored(d, F.lit(0.8))) for d, ids in V.PATH_DOMAINS.items()]), lambda x: x.isNotNull())


def _scored(domain: str, score: Column) -> Column:
    return F.struct(F.lit(domain).alias("domain"), score.cast("double").alias("score"))


def language_evidence(language: Column) -> Column:
    none = F.array().cast("array<struct<domain:string,score:double>>")
    return F.coalesce(*[F.when(language == lang, F.array(*[_scored(d, F.lit(0.6)) for d in ds])) for lang, ds in V.LANGUAGE_DOMAINS.items()], none)


def content_evidence(content: Column, vocabulary: Vocabulary) -> Column:
    """Keywords' counts by weight, normalised by length; domains under 0.1 are none."""
    low = F.lower(content)
    found = []
    for d, _, keywords in vocabulary:
        raw = reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(java(rf"\b{_escape(k.lower())}\b"))) * (w * 0.1) for k, w in keywords.items()], F.lit(0.0))
        found.append((d, F.least(raw / F.log(F.length(content) + 1000.0) * 100, F.lit(1.0))))
    return F.filter(F.array(*[_scored(d, s) for d, s in found]), lambda x: x["score"] >= 0.1)


def _escape(s: str) -> str:
    import re

    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)


def context_evidence(content: Column, path: Column) -> Column:
    """Imports, manifests and container files; contents and paths are taken as they are written, what is imported in lower case."""
    imported = F.transform(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in V.IMPORT_PATTERNS]), F.lower)

    def of(m: Column) -> Column:
        return F.when(reduce(lambda a, b: a | b, [m.contains(x) for x in ("express", "react", "vue", "angular")]), F.lit("web")).when(m.contains("django") | m.contains("flask"), F.lit("py")).otherwise("")

    kinds = F.transform(imported, of)
    n_web, n_py = F.size(F.filter(kinds, lambda k: k == "web")), F.size(F.filter(kinds, lambda k: k == "py"))
    node = path.contains("package.json") | content.contains('"dependencies"')
    express = node & content.contains("express")
    python = ~node & (path.contains("requirements.txt") | path.contains("Pipfile"))
    docker = content.contains("FROM ") | content.contains("COPY ") | path.contains("dockerfile")
    parts = F.array(
        _scored("web-frameworks", n_web * 0.3 + n_py * 0.2 + F.when(express, 0.4).otherwise(0.0)),
        _scored("python", n_py * 0.3 + F.when(python, 0.4).otherwise(0.0)),
        _scored("javascript", F.when(node, 0.4).otherwise(0.0)),
        _scored("devops", F.when(docker, 0.3).otherwise(0.0)),
    )
    return F.filter(parts, lambda x: x["score"] > 0)


def sum_by_domain(evidence: Column) -> Column:
    """Scores added up by domain, in the order domains first appear."""
    names = F.array_distinct(F.transform(evidence, lambda x: x["domain"]))
    return F.transform(names, lambda d: F.struct(d.alias("domain"), F.aggregate(F.filter(evidence, lambda x: x["domain"] == d), F.lit(0.0), lambda a, x: a + x["score"]).alias("score")))


def ranked(scores: Column, value: str = "score") -> Column:
    """Structs by value, descending; equals keep their order."""
    placed = F.transform(scores, lambda x, i: F.struct((-x[value]).alias("v"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def tag(df: DataFrame, content: str = "content", path: str = "file_path", language: str = "language", vocabulary: Vocabulary | None = None) -> DataFrame:
    """df with domain_scores (array<struct<domain,score>>, at least 0.3, best first, at most five) and domain_tags."""
    c, p = F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    df = df.withColumn("_evidence", F.concat(path_evidence(p), language_evidence(F.col(language)), content_evidence(c, vocabulary or default_vocabulary()), context_evidence(c, p)))
    df = df.withColumn("_sums", sum_by_domain(F.col("_evidence")))
    df = df.withColumn("domain_scores", F.slice(ranked(F.filter("_sums", lambda x: x["score"] >= 0.3)), 1, 5))
    return df.withColumn("domain_tags", F.transform("domain_scores", lambda x: x["domain"])).drop("_evidence", "_sums")


def query_intent(df: DataFrame, query: str = "query", vocabulary: Vocabulary | None = None) -> DataFrame:
    """df with detected_domains (array<struct<domain,confidence,matched_keywords,boost_factor>>, at least 0.2, the three best),
    intent_confidence (their mean, 0.5 without any) and query_hash."""
    q = F.coalesce(F.col(query), F.lit(""))
    low = F.lower(q)
    df = df.withColumn("_words", word_terms(q))
    found = []
    for d, boost, keywords in vocabulary or default_vocabulary():
        hit = {k: F.array_contains("_words", k.lower()) | low.contains(k.lower()) for k in keywords}
        matched = F.filter(F.array(*[F.when(h, F.lit(k.lower())) for k, h in hit.items()]), lambda x: x.isNotNull())
        weight = reduce(lambda a, b: a + b, [F.when(h, float(keywords[k])).otherwise(0.0) for k, h in hit.items()])
        found.append(F.struct(F.lit(d).alias("domain"), matched.alias("matched_keywords"), weight.alias("weight"), F.lit(float(boost)).alias("boost_factor")))
    df = df.withColumn("_found", F.array(*found))

    def confident(x: Column) -> Column:
        n = F.size(x["matched_keywords"])
        cover = F.least(F.length(F.concat_ws(" ", x["matched_keywords"])) / F.greatest(F.length(q), F.lit(1)), F.lit(0.8))
        conf = F.least(n / 3, F.lit(1.0)) * 0.4 + F.least(x["weight"] / 2, F.lit(1.0)) * 0.4 + cover * 0.2
        return F.struct(x["domain"].alias("domain"), F.when(n > 0, conf).otherwise(0.0).alias("confidence"), x["matched_keywords"].alias("matched_keywords"), x["boost_factor"].alias("boost_factor"))

    df = df.withColumn("_conf", F.transform("_found", confident))
    df = df.withColumn("detected_domains", F.slice(ranked(F.filter("_conf", lambda x: x["confidence"] >= 0.2), "confidence"), 1, 3))
    mean = F.aggregate("detected_domains", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("detected_domains")
    return df.withColumns({"intent_confidence": F.when(F.size("detected_domains") > 0, mean).otherwise(0.5), "query_hash": query_hash(q)}).drop("_words", "_found", "_conf")


def boost_factor(tags: Column, domains: Column) -> Column:
    """max(1, 1 + boost * confidence) over the detected domains among the tags; 1 without tags."""
    return F.aggregate(F.coalesce(domains, F.array().cast("array<struct<domain:string,confidence:double,matched_keywords:array<string>,boost_factor:double>>")), F.lit(1.0), lambda a, d: F.when(F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), d["domain"]), F.greatest(a, 1 + d["boost_factor"] * d["confidence"])).otherwise(a))
