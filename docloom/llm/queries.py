"""Queries of the operators in this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import leaks, markup, mix, neardup, secrets, similar, split, terms, unify, wrappers


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = similar.similar_pairs(_t(spark, d, "chunks"), k=10, least=0.75)
    return found.select(F.col("id_1").alias("chunk_id_1"), F.col("id_2").alias("chunk_id_2"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.elements(_t(spark, d, "chunks"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_text(_t(spark, d, "chunks").select("chunk_id", "file_path", "content")).select("chunk_id", "clean_text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, with the repository of their file as host."""
    c = _t(spark, d, "chunks").select("chunk_id", "file_path", "content").dropDuplicates(["chunk_id"])
    return c.withColumn("host", F.regexp_extract("file_path", r"^(/[^/]+/[^/]+/[^/]+)/", 1))


def p2_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """Wrappers of the pages of each repository: all its chunks that hold tags."""
    return wrappers.infer(_pages(spark, d))


def p2_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Elements that the wrappers yield, in the form of p2_found."""
    return wrappers.elements(_pages(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctive(_t(spark, d, "chunks"), _t(spark, d, "search_recommendations")).select("record_kind", "record_id", "term")


def p3_ppmi(spark: SparkSession, d: str) -> DataFrame:
    found = terms.distinctive(_t(spark, d, "chunks"), _t(spark, d, "search_recommendations"), score="ppmi")
    return found.select("record_kind", "record_id", "term", "tf", "df", F.round("score", 4).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_t(spark, d, "chunks")).select("chunk_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "chunks").select("chunk_id", "file_path", "content")
    return secrets.redact(chunks, secrets.find_secrets(chunks)).select("chunk_id", "redacted_content")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(_t(spark, d, "chunks"), "chunk_id", "content", width=3, least=0.6, least_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.member_pairs(*_near(spark, d))
    return found.select(F.col("id_1").alias("chunk_id_1"), F.col("id_2").alias("chunk_id_2"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_near(spark, d)).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(_t(spark, d, "chunks"), _t(spark, d, "chunking_config"), by="kind").where("piece_no > 0").select("chunk_id", "cut_at")


def p6_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(_t(spark, d, "chunks"), _t(spark, d, "chunking_config"), by="cohesion")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 24 words with up to 4 words inserted, deleted or replaced; shorter items as a whole, with edits in proportion."""
    return leaks.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), width=24, most=4, recall=0.9, shorter=True)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), tokenizer=mix.default_tokenizer())[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), tokenizer=mix.default_tokenizer())[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.look_alike_pairs(_t(spark, d, "documents"))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    return unify.look_alike_groups(_t(spark, d, "documents"))


def p9_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_text(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "unified_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_clean, p2_wrappers, p2_wrapped, p3_found, p3_ppmi, p4_found, p4_redacted, p5_found, p5_groups, p6_found, p6_cohesion, p7_found, p7_edited, p8_mix, p8_shares, p9_found, p9_groups, p9_unified)}


def _terms_sql(kind: str, name: str, k: int) -> str:
    return f"""{name}_j AS (SELECT record_id, term, count(*) AS tf FROM {name}_t GROUP BY ALL), {name}_d AS (SELECT term, count(*) AS df FROM {name}_j GROUP BY 1 HAVING count(*) >= 2),
{name}_b AS (SELECT '{kind}' AS record_kind, record_id, term FROM {name}_j JOIN {name}_d USING (term) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY tf * ln(((SELECT count(*) FROM {name}) + 1) / (df + 1)) DESC, term) <= {k})"""


P3 = rf"""WITH c AS (SELECT chunk_id AS record_id, any_value(content) AS v FROM chunks WHERE content IS NOT NULL GROUP BY 1),
c_t AS (SELECT record_id, term FROM (SELECT record_id, unnest(regexp_extract_all(lower(v), '[a-z0-9_]+')) AS term FROM c) WHERE length(term) >= 2 AND regexp_matches(term, '[a-z]')),
{_terms_sql("chunk", "c", 3)},
r AS (SELECT id AS record_id, any_value(suggested_terms) AS v FROM search_recommendations WHERE len(suggested_terms) > 0 GROUP BY 1),
r_t AS (SELECT record_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS term FROM (SELECT record_id, unnest(v) AS x FROM r) WHERE x IS NOT NULL AND regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
{_terms_sql("recommendation", "r", 1)}
SELECT * FROM c_b UNION ALL SELECT * FROM r_b"""


def _ppmi_sql(kind: str, name: str, k: int) -> str:
    return f"""{name}_j AS (SELECT record_id, term, count(*) AS tf FROM {name}_t GROUP BY ALL), {name}_n AS (SELECT record_id, sum(tf) AS n FROM {name}_j GROUP BY 1), {name}_d AS (SELECT term, count(*) AS df, sum(tf) AS n_term FROM {name}_j GROUP BY 1 HAVING count(*) >= 2),
{name}_s AS (SELECT record_id, term, tf, df, round(greatest(0, ln(tf * (SELECT sum((n ** 0.75)::DECIMAL(28, 9))::DOUBLE FROM {name}_n) / (n_term * n ** 0.75))), 9) AS score FROM {name}_j JOIN {name}_d USING (term) JOIN {name}_n USING (record_id)),
{name}_b AS (SELECT '{kind}' AS record_kind, record_id, term, tf, df, round(score, 4) AS score FROM {name}_s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, term) <= {k})"""


P3_PPMI = P3.replace(_terms_sql("chunk", "c", 3), _ppmi_sql("chunk", "c", 3)).replace(_terms_sql("recommendation", "r", 1), _ppmi_sql("recommendation", "r", 1))
P5 = """WITH t AS (SELECT chunk_id, any_value(content) AS c FROM chunks WHERE content IS NOT NULL GROUP BY 1), w AS (SELECT chunk_id, regexp_extract_all(lower(c), '[a-z0-9_]+') AS w FROM t),
s AS (SELECT DISTINCT chunk_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_1, b AS chunk_id_2 FROM b JOIN n p ON p.chunk_id = a JOIN n q ON q.chunk_id = b WHERE 5 * k >= 3 * (p.n + q.n - k)"""
P6 = r"""WITH RECURSIVE conf AS (SELECT file_extension AS ext, arg_max(chunk_size, config_version) AS size, greatest(0, least(coalesce(arg_max(overlap, config_version), 0), arg_max(chunk_size, config_version) - 1)) AS ov FROM chunking_config WHERE chunk_size > 0 GROUP BY 1),
t AS (SELECT chunk_id, any_value(file_path) AS p, any_value(content) AS c FROM chunks WHERE content IS NOT NULL GROUP BY 1),
e AS (SELECT chunk_id, c, coalesce(x.size, y.size) AS size, coalesce(x.ov, y.ov) AS ov FROM t LEFT JOIN conf x ON x.ext = CASE WHEN contains(p, '.') THEN string_split(p, '.')[-1] ELSE '*' END LEFT JOIN conf y ON y.ext = '*' WHERE length(c) > coalesce(x.size, y.size)),
k AS (SELECT chunk_id, regexp_extract_all(c, '[ \t\r\n]+|[^ \t\r\n]+') AS toks FROM e), u AS (SELECT chunk_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM k),
o AS (SELECT *, (sum(length(tok)) OVER (PARTITION BY chunk_id ORDER BY i))::BIGINT - length(tok) AS p, lag(tok) OVER (PARTITION BY chunk_id ORDER BY i) AS ws, lag(tok, 2) OVER (PARTITION BY chunk_id ORDER BY i) AS bef FROM u),
cand AS (SELECT chunk_id, list({'p': p, 'k': CASE WHEN regexp_matches(ws, '\n[ \t\r]*\n') THEN 3 WHEN coalesce(right(bef, 1), '') IN ('.', '!', '?') THEN 2 ELSE 1 END}) AS cs FROM o WHERE i > 1 AND NOT regexp_matches(tok, '^[ \t\r\n]') GROUP BY 1),
r AS (SELECT e.chunk_id, length(c)::BIGINT AS n, size::BIGINT AS size, ov::BIGINT AS ov, cs, 0::BIGINT AS s, size::BIGINT AS w FROM e LEFT JOIN cand USING (chunk_id)
UNION ALL SELECT chunk_id, n, size, ov, cs, coalesce(list_max(list_transform(list_filter(cs, lambda x: x.p > s + w // 2 AND x.p <= s + w), lambda x: x.k::BIGINT * 1000000000 + x.p)) % 1000000000, s + w), greatest(size - ov, 1) FROM r WHERE n - s > w)
SELECT chunk_id, s::INT AS cut_at FROM r WHERE s > 0"""


def _windows_sql(table: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)"""


P7 = f"WITH d AS ({_windows_sql('documents', 'doc_id')}), e AS ({_windows_sql('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (k)"


def oracle_sql() -> dict[str, str]:
    """Only where SQL states the same result in good time: the others are approximate, sequential or need Unicode tables."""
    return {"p3_found": P3, "p3_ppmi": P3_PPMI, "p5_found": P5, "p6_found": P6, "p7_found": P7}
