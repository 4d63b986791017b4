"""Query recommendations from the weight of a query's terms in its best results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.functions.text import occurrences, query_terms

MAX_TERMS, MAX_DOCS, MAX_AGE_DAYS = 8, 5, 30


def term_statistics(queries: DataFrame, results: DataFrame, total: int, docs: int = MAX_DOCS) -> DataFrame:
    """(query_id, term, term_pos, n_docs, df, total_tf, avg_tf, tfidf) of each query's terms in its best results.

    queries: query_id, query. results: query_id, rank, content. total: documents in the index, N of the weight; n_docs and df count
    the analysed results. Queries without results or terms, or with more than
    MAX_TERMS terms, give no row. The join is on query_id; a query meets at most docs results.
    """
    best = results.where(F.col("rank") <= docs).select("query_id", F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    terms = queries.withColumn("terms", query_terms(F.col("query"))).where(F.size("terms").between(1, MAX_TERMS)).select("query_id", F.posexplode("terms").alias("term_pos", "term"))
    met = terms.join(best, "query_id").withColumn("n", occurrences(F.col("content"), F.col("term")))
    g = met.groupBy("query_id", "term", "term_pos").agg(F.count("*").alias("n_docs"), F.sum((F.col("n") > 0).cast("int")).alias("df"), F.sum("n").alias("total_tf"))
    avg = F.when(F.col("df") > 0, F.col("total_tf") / F.col("df")).otherwise(0.0)
    return g.withColumn("avg_tf", avg).withColumn("tfidf", F.col("avg_tf") * F.log((F.lit(total) + 1) / (F.col("df") + 1)))


def is_essential(query: Column, term: Column) -> Column:
    """A term that stands in quotes in the query, as it is written there, or a common word of programming."""
    return query.contains(F.concat(F.lit('"'), term, F.lit('"'))) | F.lower(term).isin(V.ESSENTIAL_TERMS)


def removable(threshold: float = V.THRESHOLD_START) -> Column:
    return (F.col("tfidf") < 1.0) & (F.col("tfidf") < threshold) & ~is_essential(F.col("query"), F.col("term"))


def related(a: Column, b: Column) -> Column:
    """One contains the other, or they are words for the same."""
    pairs = [F.lit(False)] + [((a == k) & b.isin(vs)) | ((b == k) & a.isin(vs)) for k, vs in V.SYNONYMS.items()]
    return (a != b) & (a.contains(b) | b.contains(a) | reduce(lambda x, y: x | y, pairs))


def recommend(queries: DataFrame, results: DataFrame, total: int, threshold: float = V.THRESHOLD_START, now: Column | None = None) -> DataFrame:
    """One row per query that can be improved: suggested_terms, suggestion_strategy, confidence, generated_at, expires_at,
    total_documents, analyzed_documents (the terms looked at).

    If the query has more than two terms, its lightest removable one is taken out; else the heaviest related term over 2 is
    suggested alone; else up to two terms over 3 in at least two results, lightest first, are added.
    """
    now = now if now is not None else F.current_timestamp()
    stats = term_statistics(queries, results, total).join(queries.select("query_id", "query"), "query_id")
    stats = stats.withColumn("removable", removable(threshold))
    order = F.struct("tfidf", "term_pos")
    # at most MAX_TERMS rows per query
    per = stats.groupBy("query_id", "query").agg(
        F.sort_array(F.collect_list(F.struct("tfidf", "term_pos", "term", "df", "removable"))).alias("terms"),
        F.min_by(F.struct("term", "tfidf"), F.when(F.col("removable"), order)).alias("bad"),
    )
    per = per.where("bad is not null")
    bad = F.col("bad.term")
    by_pos = F.transform(F.array_sort(F.transform("terms", lambda t: F.struct(t["term_pos"].alias("p"), t["term"].alias("t")))), lambda x: x["t"])
    good = F.filter("terms", lambda t: ~t["removable"] & (t["tfidf"] > 2) & related(t["term"], bad))
    best = F.element_at(F.concat(F.transform(F.reverse(F.array_sort(F.transform(good, lambda t: F.struct(t["tfidf"].alias("v"), (-t["term_pos"]).alias("p"), t["term"].alias("t"))))), lambda x: x["t"]), F.array(F.lit(None).cast("string"))), 1)
    more = F.slice(F.transform(F.filter("terms", lambda t: (t["tfidf"] > 3) & (t["df"] >= 2) & (t["term"] != bad)), lambda t: t["term"]), 1, 2)
    per = per.withColumns({"_all": by_pos, "_best": best, "_more": more})
    safe = F.size("_all") > 2
    out = per.withColumn("suggestion_strategy", F.when(safe, "removal").when(F.col("_best").isNotNull(), "refinement").when(F.size("_more") > 0, "contextual_addition")).where("suggestion_strategy is not null")
    suggested = F.when(safe, F.filter("_all", lambda t: t != bad)).when(F.col("_best").isNotNull(), F.array(F.col("_best"))).otherwise(F.concat("_all", "_more"))
    conf = F.when(safe, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bad.tfidf") / 5))).when(F.col("_best").isNotNull(), 0.7).otherwise(0.6)
    return out.select("query_id", "query", suggested.alias("suggested_terms"), "suggestion_strategy", F.lit(threshold).alias("tfidf_threshold"), conf.alias("confidence"), now.alias("generated_at"), (now + F.expr(f"interval {MAX_AGE_DAYS} days")).alias("expires_at"), F.lit(total).cast("int").alias("total_documents"), F.size("_all").alias("analyzed_documents"))


def cached(recommendations: DataFrame, now: Column) -> DataFrame:
    """The newest recommendation of each query that has not expired."""
    rest = [c for c in recommendations.columns if c != "query"]
    live = recommendations.where(F.col("expires_at") > now)
    return live.groupBy("query").agg(F.max_by(F.struct(*rest), F.struct("generated_at", "id")).alias("x")).select("query", "x.*")


def unexpired(recommendations: DataFrame, now: Column) -> DataFrame:
    return recommendations.where(~(F.col("expires_at") <= now) | F.col("expires_at").isNull())


def of_known(effectiveness: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Effectiveness rows whose recommendation exists, as after a cascading delete."""
    return effectiveness.join(recommendations.select(F.col("id").alias("recommendation_id")).distinct(), "recommendation_id", "left_semi").select(*effectiveness.columns)


def trailing(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
