"""How distinctive a term is of a record (problem 3).

Joint counts of term and record come from one group-by, the marginal counts of terms from another, and a join brings the two
together; all of it is built-in expressions. Two scores use the same counts:

* ppmi: positive pointwise mutual information, ln(tf * S / (n_term * n_record ** 0.75)) with S the sum of all
  n_record ** 0.75: the record's count is smoothed by a fractional exponent;
* tfidf: tf * ln((N + 1) / (df + 1)).

Records are placed once by their key; joint counts and the ranking within a record need no further shuffle. A term that a
third of all records hold would be a hot key of the join, so the counts of the HOT most frequent terms (a table of bounded
size) are sent to the tasks and only the postings of the other terms are shuffled by term; the arithmetic is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._graph import cut_lineage

#: Exponent of the records' counts.
SMOOTHING = 0.75
#: Terms whose counts are sent to the tasks: the most frequent ones, at most so many of at most LONG characters.
HOT, LONG = 65_536, 64
#: Maximal runs of [a-z0-9_] with two characters and a letter.
TERM = "(?=[0-9_]*[a-z])[a-z0-9_]{2,}"


def terms_of(value: Column, is_text: bool) -> Column:
    """Terms of a text, or the trimmed, lower-cased entries of a list (blank and null entries are none)."""
    if is_text:
        return F.regexp_extract_all(F.lower(value), F.lit(TERM), F.lit(0))
    return F.filter(F.transform(value, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")


def joint_counts(records: DataFrame) -> DataFrame:
    """(record, n_record, term, tf) of records (record, value); each record has a row more, whose term is null."""
    found = records.select("record", terms_of(F.col("value"), records.schema["value"].dataType.simpleString() == "string").alias("terms"))
    terms = F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    # an outer explode, as an inner one lets the optimizer infer a filter that finds the terms a second time
    each = found.select("record", F.coalesce(F.array_size("terms"), F.lit(0)).alias("n_record"), F.explode_outer(terms).alias("term"))
    return each.groupBy("record", "n_record", "term").agg(F.count("*").alias("tf"))


def marginals(joint: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(term, df, n_term, smooth) of joint counts; the row of the null term has N in df and the sum of smoothed counts of records."""
    # summed as decimals, so that the sum doesn't depend on the order
    smooth = F.sum(F.when(F.col("term").isNull() & (F.col("n_record") > 0), F.pow("n_record", F.lit(smoothing)).cast("decimal(28,9)")))
    return joint.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n_term"), F.coalesce(smooth.cast("double"), F.lit(0.0)).alias("smooth"))


def best_terms(records: DataFrame, k: int, score: str = "tfidf", min_df: int = 2, smoothing: float = SMOOTHING, hot: int = HOT) -> DataFrame:
    """(record, term, tf, df, score, rank): the k best terms of each record of records (record, value).

    value is a text or an array of strings. Terms in fewer than min_df records take no part; ties: smaller term first (by its
    bytes). Scores of ppmi have nine decimals, so that rounding errors settle no tie. Null values and records without terms count in N and give no row. record must be unique.
    """
    if score not in ("tfidf", "ppmi"):
        raise ValueError(score)
    joint = joint_counts(records)
    counts = cut_lineage(marginals(joint, smoothing).where((F.col("df") >= min_df) | F.col("term").isNull()))
    every = counts.where("term is null").agg(F.max("df").alias("n"), F.max("smooth").alias("smooth"))  # one row
    by_term = counts.where("term is not null").drop("smooth")
    top = by_term.where(F.length("term") <= LONG).orderBy(F.desc("df"), "term").limit(hot)  # a bounded table
    if score == "tfidf":
        value = F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    else:
        value = F.round(F.greatest(F.lit(0.0), F.log(F.col("tf") * F.col("smooth") / (F.col("n_term") * F.pow("n_record", F.lit(smoothing))))), 9)
    value = F.when(F.col("df").isNotNull(), value)  # greatest passes nulls over
    w = Window.partitionBy("record").orderBy(F.desc_nulls_last("score"), "term")
    rank = F.row_number().over(w)
    found = joint.where("term is not null").join(F.broadcast(top), "term", "left").crossJoin(F.broadcast(every)).withColumn("score", value)
    # where the record stands: of its frequent terms only the best go on
    held = found.withColumn("rank", rank).where((F.col("rank") <= k) | F.col("score").isNull()).drop("rank")
    # the others meet their counts by term; a frequent one has them, and a key of its own that meets nothing
    key = F.when(F.col("df").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col("record").cast("string")))
    late = by_term.select(F.col("term").alias("key"), F.col("df").alias("late_df"), F.col("n_term").alias("late_n"))
    met = held.withColumn("key", key).join(late, "key", "left").withColumns({"df": F.coalesce("df", "late_df"), "n_term": F.coalesce("n_term", "late_n")}).where("df is not null")
    return met.withColumn("score", value).withColumn("rank", rank).where(F.col("rank") <= k).select("record", "term", "tf", "df", "score", "rank")


def chunk_records(chunks: DataFrame) -> DataFrame:
    """(record, value) of chunks with non-null content, one row per chunk_id."""
    one = chunks.where("content is not null and chunk_id is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    return one.select(F.col("chunk_id").alias("record"), F.col("content").alias("value"))


def recommendation_records(recs: DataFrame) -> DataFrame:
    """(record, value) of recommendations with a non-empty suggested_terms, one row per id."""
    one = recs.where("id is not null and size(suggested_terms) > 0").select("id", "suggested_terms").dropDuplicates(["id"])
    return one.select(F.col("id").alias("record"), F.col("suggested_terms").alias("value"))


def distinctive(chunks: DataFrame, recs: DataFrame, score: str = "tfidf", k_chunk: int = 3, k_rec: int = 1) -> DataFrame:
    """(record_kind, record_id, term, tf, df, score, rank) for the best terms of every chunk and recommendation."""
    parts = [best_terms(records, k, score).select(F.lit(kind).alias("record_kind"), F.col("record").alias("record_id"), "term", "tf", "df", "score", "rank") for kind, records, k in (("chunk", chunk_records(chunks), k_chunk), ("recommendation", recommendation_records(recs), k_rec))]
    return parts[0].unionByName(parts[1])
