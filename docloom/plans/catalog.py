"""Queries of the engine by name, and the same queries in SQL for comparison.

Each query reads whole tables of a folder of Parquet files. The SQL is written for DuckDB; patterns come from the same
fixed values, so both sides count the same things.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import classify as K
from docloom.functions import domains as D
from docloom.functions import enhance as E
from docloom.functions import text as X
from docloom.functions import values as V
from docloom.functions import vectors
from docloom.functions.chunking import chunk
from docloom.operators import jobs, learning, recommend, retrieval, statistics
from docloom.schemas import ChunkingConfig, SearchOptions
from docloom.sources import store
from docloom.sources.embedding import HashingEmbedder, embed, embed_query
from docloom.sources.session import shared_folder, ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[name or f.__name__] = run
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def n_of(p: str, c: str = "c") -> str:
    return f"len(regexp_extract_all({c}, {lit(p)}))"


def has(p: str, c: str = "c") -> str:
    return f"regexp_matches({c}, {lit(p)})"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, {lit(chr(94) + '[' + chr(92) + 's' + chr(92) + 'x{00a0}' + chr(92) + 'x{feff}]+|[' + chr(92) + 's' + chr(92) + 'x{00a0}' + chr(92) + 'x{feff}]+$')}, '', 'g')"


EXT_SQL = r"lower(regexp_extract(string_split(file_path, '/')[-1], '[^/]\.([^./]+)$', 1))"
#: Distinct contents by chunk, with extension; null counts as empty. The plans below make the small results distinct, not the contents.
BASE = f"base AS (SELECT DISTINCT chunk_id, file_path, coalesce(content, '') AS c, {EXT_SQL} AS ext FROM chunks)"


def base(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "chunks").select("chunk_id", "file_path", F.coalesce("content", F.lit("")).alias("c"), X.extension(F.col("file_path")).alias("ext")))


def joined(c: Column) -> Column:
    return F.concat_ws("|", c)


# ---- vectors

USABLE = "len(embedding) = 512 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return t(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"WITH {Q0} SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def knn_l2_top10(spark, d):
    return retrieval.knn(t(spark, d, "embeddings"), first_vector(spark, d), 10, "distance", id_col="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {Q0}, h AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY s, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS score FROM h WHERE s >= 1.0")
def knn_l2_min_score(spark, d):
    hits = retrieval.knn(t(spark, d, "embeddings"), first_vector(spark, d), 50, "distance", id_col="vec_id")
    return retrieval.with_score_at_least(hits, 1.0).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {Q0} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def knn_cosine_top10(spark, d):
    return retrieval.knn(t(spark, d, "embeddings"), first_vector(spark, d), 10, "similarity", id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {Q0} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q")
def cosine_and_distance(spark, d):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, d)])
    return t(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine"), F.round(vectors.l2(F.col("embedding"), q), 6).alias("distance"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS rank FROM s QUALIFY rank <= 5""")
def knn_batch_top5_per_query(spark, d):
    e = t(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id % 50 = 0"), 5, "l2", id="vec_id", query_id="vec_id").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


HITS = f"""u AS (SELECT chunk_id, any_value(embedding) AS embedding FROM chunks WHERE {USABLE} GROUP BY 1),
q AS (SELECT embedding::DOUBLE[] AS q FROM u ORDER BY chunk_id LIMIT 1),
k AS (SELECT chunk_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM u, q ORDER BY score DESC, chunk_id LIMIT 200),
m AS (SELECT * FROM content_metadata QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, quality_score DESC NULLS LAST, content_type DESC NULLS LAST, language DESC NULLS LAST) = 1),
hits AS (SELECT k.chunk_id, k.score, row_number() OVER (ORDER BY k.score DESC, k.chunk_id) AS rank, m.content_type, m.language, m.domain_tags, m.quality_score, m.source_authority FROM k LEFT JOIN m USING (chunk_id))"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "chunks").select("chunk_id", "embedding")
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    sized = c.where((F.size("embedding") == 512) & F.exists("embedding", lambda x: x != 0))
    q = sized.where(usable).orderBy("chunk_id").select("embedding").first()[0]
    top = retrieval.knn(sized, q, 200, one_per_id=True).select("chunk_id", "score")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "chunk_id")))  # 200 rows
    meta = t(spark, d, "content_metadata").select("chunk_id", "content_type", "language", "domain_tags", "quality_score", "source_authority", "created_at")
    return retrieval.join_metadata(top, meta).drop("created_at")


def shown(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", F.round("score", 6).alias("score"), "content_type", "language")


SHOWN = "SELECT chunk_id, round(score, 6) AS score, content_type, language FROM hits"


@query(f"WITH {HITS} SELECT chunk_id, round(score, 6) AS score, rank, content_type, language, array_to_string(domain_tags, '|') AS tags FROM hits")
def knn_left_join_metadata(spark, d):
    return hits(spark, d).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "content_type", "language", F.when(F.col("domain_tags").isNotNull(), joined(F.col("domain_tags"))).alias("tags"))


@query(f"WITH {HITS} SELECT round(coalesce(avg(score), 0), 6) AS average_score, count(*) AS hits FROM hits")
def search_avg_score(spark, d):
    return retrieval.average_score(hits(spark, d)).select(F.round("average_score", 6).alias("average_score"), "hits")


@query("""WITH r AS (SELECT DISTINCT id, query, total_documents, tfidf_threshold, confidence FROM search_recommendations),
w AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(lower(query), '"([^"]*)"|(\\S+)'), lambda x: CASE WHEN regexp_matches(x, '^"[^"]*"$') THEN substr(x, 2, length(x) - 2) ELSE x END), lambda x: length(x) > 1)) AS terms FROM r)
SELECT id, coalesce(total_documents < 3, false) OR coalesce(confidence, 1.0) < coalesce(tfidf_threshold, 0.0) OR coalesce(len(terms) > 5, false) AS needed FROM w""")
def search_trigger_flag(spark, d):
    r = t(spark, d, "search_recommendations").select("id", "query", "total_documents", "tfidf_threshold", "confidence").distinct()
    rule = retrieval.needs_recommendation(F.coalesce("total_documents", F.lit(3)), F.coalesce("confidence", F.lit(1.0)), F.coalesce("tfidf_threshold", F.lit(0.0)), F.coalesce(F.size(X.query_terms(F.col("query"))), F.lit(0)))
    return r.select("id", rule.alias("needed"))


BOOSTS = {"web-frameworks": (0.6, 1.5), "databases": (0.4, 1.3), "python": (0.5, 1.2)}


@query(f"""WITH {HITS}, b AS (SELECT *, score * greatest(1.0, {', '.join(f"CASE WHEN list_contains(domain_tags, '{k}') THEN 1 + {b} * {c} ELSE 1.0 END" for k, (c, b) in BOOSTS.items())}) AS boosted FROM hits)
SELECT chunk_id, round(boosted, 6) AS score, row_number() OVER (ORDER BY boosted DESC, rank) AS rank FROM b""")
def boost_and_resort(spark, d):
    known = F.array(*[F.struct(F.lit(k).alias("domain"), F.lit(c).alias("confidence"), F.array().cast("array<string>").alias("matched_keywords"), F.lit(b).alias("boost_factor")) for k, (c, b) in BOOSTS.items()])
    return retrieval.boost(hits(spark, d), known).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _filter(name: str, options: SearchOptions, cond: str) -> None:
    @query(f"WITH {HITS} {SHOWN} WHERE content_type IS NULL OR {cond}", name=name)
    def run(spark, d):
        return shown(retrieval.apply_filters(hits(spark, d), options))


_filter("filter_domain", SearchOptions(domain_filter=["python", "databases"]), "coalesce(list_has_any(domain_tags, ['python', 'databases']), false)")
_filter("filter_content_type", SearchOptions(content_type_filter=["code", "docs"]), "content_type IN ('code', 'docs')")
_filter("filter_language", SearchOptions(language_filter=["python", "go"]), "coalesce(language IN ('python', 'go'), false)")
_filter("filter_quality", SearchOptions(min_quality_score=0.5), "coalesce(quality_score, 0) >= 0.5")
_filter("filter_authority", SearchOptions(min_authority_score=0.5), "coalesce(source_authority, 0) >= 0.5")
_filter("filter_all", SearchOptions(content_type_filter=["docs"], min_quality_score=0.3, min_authority_score=0.2), "(content_type IN ('docs') AND coalesce(quality_score, 0) >= 0.3 AND coalesce(source_authority, 0) >= 0.2)")
_filter("filter_gate_strict", SearchOptions(min_quality_score=0.5, strict=True), "true")


@query(f"WITH {HITS} {SHOWN} WHERE content_type IS NULL")
def filter_null_passthrough(spark, d):
    return shown(retrieval.apply_filters(hits(spark, d), SearchOptions(content_type_filter=["no such type"])))


# ---- chunks of documents

DOCS = "docs AS (SELECT concat_ws('/', source, doc_id) AS file_path, text AS c FROM documents WHERE text IS NOT NULL)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "documents").where("text is not null").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content")))


def windows_sql(joined_sql: str) -> str:
    return f"""w AS (SELECT file_path, j, unnest(range(0, length(j), 800)) AS o FROM ({joined_sql}))
SELECT file_path, file_path || ':' || (o // 800) AS chunk_id, (o // 800)::BIGINT AS chunk_index, md5(substr(j, o + 1, 1000)) AS h, strlen(j)::BIGINT AS file_size, o::BIGINT AS chunk_offset, ceil(length(substr(j, o + 1, 1000)) / 4)::BIGINT AS token_count FROM w"""


def as_chunks(out: DataFrame) -> DataFrame:
    return out.select("file_path", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("h"), F.col("file_size").cast("long").alias("file_size"), F.col("chunk_offset").cast("long").alias("chunk_offset"), F.col("token_count").cast("long").alias("token_count"))


def chunked(spark, d, method: str) -> DataFrame:
    return as_chunks(chunk(docs(spark, d), ChunkingConfig(method=method)))


@query(f"WITH {DOCS}, " + windows_sql(f"SELECT file_path, array_to_string(list_filter(regexp_split_to_array(c, '[.!?]+\\s+'), lambda x: {trim_sql('x')} <> ''), ' ') AS j FROM docs"))
def chunk_sentence(spark, d):
    return chunked(spark, d, "sentence-aware")


@query(f"WITH {DOCS}, " + windows_sql(f"SELECT file_path, array_to_string(list_filter(regexp_split_to_array(c, '\\n\\s*\\n'), lambda x: {trim_sql('x')} <> ''), ' ') AS j FROM docs"))
def chunk_paragraph(spark, d):
    return chunked(spark, d, "paragraph-aware")


def last_sql(mark: str) -> str:
    return f"(length(s) - length(string_split(s, '{mark}')[-1]) - 1)"


_DOT = f"greatest({last_sql('.')}, {last_sql('!')}, {last_sql('?')})"
FIXED = f"""pieces(file_path, c, o, n, piece) AS (
  SELECT file_path, c, 1::BIGINT, 0, NULL::VARCHAR FROM docs
  UNION ALL
  SELECT file_path, c, o + e, n + 1, substr(s, 1, e) FROM (SELECT *, CASE WHEN length(s) <= 800 THEN length(s) WHEN {_DOT} > 500 THEN {_DOT} + 1 WHEN {last_sql(' ')} > 300 THEN {last_sql(' ')} ELSE length(s) END AS e FROM (SELECT file_path, c, o, n, substr(c, o, 1000) AS s FROM pieces WHERE o <= length(c))))"""


@query(f"WITH RECURSIVE {DOCS}, {FIXED}, " + windows_sql("SELECT file_path, string_agg(piece, ' ' ORDER BY n) AS j FROM pieces WHERE piece IS NOT NULL GROUP BY file_path"))
def chunk_fixed_breakpoints(spark, d):
    return chunked(spark, d, "fixed")


@query(f"WITH RECURSIVE {DOCS}, {FIXED} SELECT file_path, count(*) AS pieces, max(length(piece))::BIGINT AS longest, sum(length(piece))::BIGINT AS total FROM pieces WHERE piece IS NOT NULL GROUP BY file_path")
def chunk_segments(spark, d):
    from docloom.functions.chunking import fixed_segments

    s = X.exploded(docs(spark, d), fixed_segments(F.col("content"), 1000), "piece", "file_path")
    return s.groupBy("file_path").agg(F.count("*").alias("pieces"), F.max(F.length("piece")).cast("long").alias("longest"), F.sum(F.length("piece")).alias("total"))


@query("SELECT chunk_id, created_at IS NULL AS undated, ceil(length(coalesce(content, '')) / 4)::BIGINT AS estimate FROM chunks")
def token_estimate(spark, d):
    return t(spark, d, "chunks").select("chunk_id", F.col("created_at").isNull().alias("undated"), X.token_estimate(F.coalesce("content", F.lit(""))).cast("long").alias("estimate"))


@query("""WITH p AS (SELECT file_path, chunk_id, chunk_index, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index) - 1 AS position FROM (SELECT DISTINCT file_path, chunk_id, chunk_index FROM chunks)),
w AS (SELECT file_path, position AS o, chunk_index AS target_index FROM p WHERE chunk_index = 2)
SELECT p.file_path, p.chunk_id, p.position, w.target_index::BIGINT AS target_index FROM p JOIN w USING (file_path) WHERE abs(p.position - w.o) <= 3""")
def chunk_context_window(spark, d):
    c = t(spark, d, "chunks").select("file_path", "chunk_id", "chunk_index").distinct()
    want = c.where("chunk_index = 2").select("file_path", "chunk_index")
    return retrieval.context_window(c, want, 3).select("file_path", "chunk_id", F.col("position").cast("long").alias("position"), F.col("target_index").cast("long").alias("target_index"))


@query("""WITH c AS (SELECT DISTINCT file_path, chunk_id, chunk_index, content FROM chunks)
SELECT chunk_id, md5(coalesce(string_agg(content, chr(10) ORDER BY chunk_index) OVER (PARTITION BY file_path ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '')) AS h FROM c""")
def neighbours_frame(spark, d):
    c = t(spark, d, "chunks").select("file_path", "chunk_id", "chunk_index", "content").distinct()
    return retrieval.neighbours(c, 1).select("chunk_id", F.md5("context").alias("h"))


# ---- index

@query("SELECT count(*) AS total_documents, coalesce(sum(total_chunks), 0)::BIGINT AS total_chunks, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens FROM documents_idx")
def index_statistics(spark, d):
    return statistics.index_statistics(t(spark, d, "documents_idx"))


@query("SELECT file_path, count(*) AS total_chunks, coalesce(sum(token_count), 0)::BIGINT AS total_tokens, string_split(file_path, '/')[-1] AS file_name, min(epoch_us(created_at)) FILTER (chunk_index = lowest) AS first_us FROM (SELECT *, min(chunk_index) OVER (PARTITION BY file_path) AS lowest FROM chunks) GROUP BY file_path")
def chunk_stats_by_file(spark, d):
    c = t(spark, d, "chunks")
    return statistics.file_rollup(c).select("file_path", "total_chunks", "total_tokens", "file_name", F.unix_micros("last_modified").alias("first_us"))


@query("SELECT count(DISTINCT file_path) AS files FROM chunks")
def distinct_files(spark, d):
    return statistics.distinct_files(t(spark, d, "chunks"))


@query("SELECT chunk_id, chunk_index, chunk_offset, epoch_us(created_at) AS us FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, chunk_offset DESC NULLS LAST) = 1")
def upsert_chunks(spark, d):
    """The first deliveries of all chunks stored, then the later ones as an upsert; the newest of each chunk holds."""
    c = t(spark, d, "chunks")
    w = Window.partitionBy("chunk_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("chunk_offset").desc_nulls_last())
    ranked = c.select("chunk_id", "chunk_index", "chunk_offset", "created_at", "file_path", "token_count").withColumn("r", F.row_number().over(w))
    ranked = ranked.withColumns({"content": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})
    held = store.Store(spark, shared_folder(spark))
    held.write("chunks", ranked.where("r > 1").drop("r"))
    held.upsert("chunks", ranked.where("r = 1").drop("r"), ["chunk_id"])
    return held.read("chunks").select("chunk_id", "chunk_index", "chunk_offset", F.unix_micros("created_at").alias("us"))


BIG = "(SELECT file_path FROM chunks GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 1)"


def biggest(spark, d) -> str:
    return t(spark, d, "chunks").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").first()[0]


@query(f"SELECT file_path, count(*) AS n FROM chunks WHERE file_path <> {BIG} GROUP BY 1")
def delete_file(spark, d):
    held = store.Store(spark, shared_folder(spark))
    held.write("chunks", t(spark, d, "chunks"))
    held.delete_file(biggest(spark, d))
    return held.read("chunks").groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows FROM documents_idx WHERE false")
def clear_index(spark, d):
    held = store.Store(spark, shared_folder(spark))
    held.write("documents_idx", t(spark, d, "documents_idx"))
    held.clear("documents_idx")
    return held.read("documents_idx").agg(F.count("*").alias("rows"))


@query(f"SELECT chunk_id, chunk_index, md5(coalesce(content, '')) AS h FROM chunks WHERE file_path = {BIG} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1")
def file_chunks_ordered(spark, d):
    return retrieval.file_chunks(t(spark, d, "chunks"), biggest(spark, d)).select("chunk_id", "chunk_index", F.md5(F.coalesce("content", F.lit(""))).alias("h"))


@query("SELECT DISTINCT chunk_id, file_path, chunk_index FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)")
def point_lookup(spark, d):
    c = t(spark, d, "chunks")
    return retrieval.chunk_by_id(c, c.agg(F.min("chunk_id")).first()[0]).select("chunk_id", "file_path", "chunk_index")


@query("SELECT chunk_id, content_type, quality_score, has_comments FROM content_metadata WHERE chunk_id = (SELECT min(chunk_id) FROM content_metadata) QUALIFY row_number() OVER (ORDER BY created_at DESC NULLS LAST) = 1")
def metadata_lookup(spark, d):
    m = t(spark, d, "content_metadata")
    return retrieval.metadata_of(m, m.agg(F.min("chunk_id")).first()[0]).select("chunk_id", "content_type", "quality_score", "has_comments")


@query("SELECT m.chunk_id, count(*) AS n FROM content_metadata m SEMI JOIN chunks c ON m.chunk_id = c.chunk_id GROUP BY 1")
def metadata_of_known_chunks(spark, d):
    return t(spark, d, "content_metadata").join(t(spark, d, "chunks").select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("n"))


# ---- text

def _text_query(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    """f of content and language by extension, over all chunks."""

    @query(f"WITH {BASE} SELECT chunk_id, md5({sql}) AS h, length({sql})::BIGINT AS n FROM base", name=name)
    def run(spark, d):
        return base(spark, d).withColumn("r", f(F.col("c"), by_extension(F.col("ext")))).select("chunk_id", F.md5("r").alias("h"), F.length("r").cast("long").alias("n")).distinct()


def by_extension(ext: Column) -> Column:
    return F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in V.EXT_LANGUAGE.items()], F.lit("unknown"))


LANG_SQL = "CASE ext " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.EXT_LANGUAGE.items()) + " ELSE 'unknown' END"


def sub(c: str, p: str, to: str) -> str:
    return f"regexp_replace({c}, {lit(p)}, {lit(to)}, 'g')"


def chain(steps: list[tuple[str, str]], c: str = "c") -> str:
    for p, to in steps:
        c = sub(c, p, to)
    return c


CODE_STRIP = chain([(r"/\*[\s\S]*?\*/", ""), (r"//[^\r\n]*", ""), (r"^#!", ""), (r"(?m)^#[^\r\n]*", "")])
_text_query("strip_code_comments", lambda c, _: X.strip_code_comments(c), CODE_STRIP)
_text_query("strip_css_comments", lambda c, _: X.strip_css_comments(c), sub("c", r"/\*[\s\S]*?\*/", ""))
_text_query("strip_html_comments", lambda c, _: X.strip_markup_comments(c), sub("c", r"<!--[\s\S]*?-->", ""))
_PREP = trim_sql("c")
_text_query("embedding_prep_text", lambda c, _: X.embedding_text(c), sub(f"CASE WHEN length({_PREP}) > 2000 THEN substr({_PREP}, 1, 1997) || '...' ELSE {_PREP} END", r"\s+", " "))
_text_query("whitespace_normalise", lambda c, _: E.normalise_whitespace(c), chain([(r"[ \t]+", " "), (r"\n +", "\n"), (r"\n{3,}", "\n\n")]))
MD = [(r"#{1,6}\s*([^\n]+)", r"[HEADER: \1]"), (r"\*\*([^\n]+?)\*\*", r"[BOLD: \1]"), (r"\*([^\n]+?)\*", r"[ITALIC: \1]"), (r"`([^\n]+?)`", r"[CODE: \1]")]
_text_query("md_normalise", lambda c, _: E.normalise_markdown(c), chain(MD))
_text_query("key_concepts", lambda c, _: E.mark_key_concepts(c), chain([(rf"(?i)\b({k})\b", r"[KEY: \1]") for k in V.KEY_TERMS]))
_text_query("readability", lambda c, _: E.readability(c), chain([(r"([.!?])\s*([A-Z])", r"\1 \2"), (r"([,;])\s*([a-zA-Z])", r"\1 \2"), (r"\s{2,}", " "), (r"\n\s*\n\s*\n", "\n\n")]))
_text_query("docs_readability", lambda c, _: E.documentation_readability(c), chain([(r"\n{4,}", "\n\n\n"), (r"[ \t]{3,}", "  "), (r"([.!?])\s*\n\s*([A-Z])", "\\1\n\n\\2")]))
_UNI = chain([(r"\\\\+", r"\\"), ("\r\n", "\n"), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n")])
for _bad, _good in V.MOJIBAKE:
    _UNI = f"replace({_UNI}, {lit(_bad)}, {lit(_good)})"
_text_query("universal_normalise", lambda c, _: E.universal(c), _UNI)
_SCRIPT_IDS = chain([(r"\b(export\s+(?:default\s+)?(?:class|function|const|let|var)\s+)(\w+)", r"\1[IDENTIFIER: \2]"), (r"\b(import\s+[^\n]*?\s+from\s+['\"`])([^'\"`]+)(['\"`])", r"\1[MODULE: \2]\3")])
_PYTHON_IDS = chain([(r"\b(def\s+)(\w+)", r"\1[FUNCTION: \2]"), (r"\b(class\s+)(\w+)", r"\1[CLASS: \2]")])
_text_query("identifier_markup", E.mark_identifiers, f"CASE WHEN {LANG_SQL} IN ('javascript', 'typescript') THEN {_SCRIPT_IDS} WHEN {LANG_SQL} = 'python' THEN {_PYTHON_IDS} ELSE c END")
_text_query("syntax_noise_reduce", E.reduce_syntax_noise, f"CASE WHEN {LANG_SQL} IN ('javascript', 'typescript') THEN {chain([(';{2,}', ';'), (r'\){2,}', ')')])} ELSE c END")



@query(f"""WITH {BASE} SELECT chunk_id, ext, md5(CASE WHEN ext IN ('js', 'ts', 'java', 'c', 'cpp') THEN {CODE_STRIP} WHEN ext IN ('css', 'scss') THEN {sub('c', r'/\*[\s\S]*?\*/', '')} WHEN ext IN ('html', 'xml') THEN {sub('c', r'<!--[\s\S]*?-->', '')} WHEN ext = 'json' THEN regexp_replace(c, '\\s+', '', 'g') ELSE c END) AS h FROM base""")
def postprocess_dispatch(spark, d):
    """All chunks; what was formatted as JSON is compared without white space, as SQL cannot format it."""
    r = X.post_process(F.col("c"), F.col("ext"))
    b = base(spark, d).withColumn("r", r)
    return b.select("chunk_id", "ext", F.md5(F.when(F.col("ext") == "json", F.regexp_replace("r", r"\s+", "")).otherwise(F.col("r"))).alias("h")).distinct()


def _list_query(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    @query(f"WITH {BASE} SELECT chunk_id, array_to_string({sql}, '|') AS items FROM base", name=name)
    def run(spark, d):
        return base(spark, d).select("chunk_id", joined(f(F.col("c"), by_extension(F.col("ext")))).alias("items")).distinct()


def first_kept(sql: str) -> str:
    """Distinct entries in order of first appearance."""
    return f"list_filter({sql}, lambda x, i: list_position({sql}, x) = i)"


_list_query("yaml_keys", lambda c, _: E.yaml_keys(c), r"list_filter(list_transform(string_split(c, chr(10)), lambda x: regexp_extract(x, '^\s*([a-zA-Z0-9_-]+)\s*:', 1)), lambda k: k <> '')")
_list_query("xml_tags", lambda c, _: E.xml_tags(c), first_kept(r"regexp_extract_all(c, '<([a-zA-Z0-9_-]+)(?:\s|>)', 1)"))
_list_query("config_keys", lambda c, _: E.config_keys(c), r"regexp_extract_all(c, '(?m)^([a-zA-Z0-9_-]+)\s*[=:]', 1)")
_list_query("config_terms", lambda c, _: E.config_terms(c), first_kept("list_concat(list_concat(" + ", ".join(f"regexp_extract_all(lower(c), {lit(p)})" for p in V.CONFIG_TERMS[:2]) + f"), regexp_extract_all(lower(c), {lit(V.CONFIG_TERMS[2])}))"))
def _comments_sql(kind: str) -> str:
    found = [f"regexp_extract_all(c, {lit(p)}, 1)" for p in V.COMMENTS_OF[kind]]
    every = found[0]
    for f in found[1:]:
        every = f"list_concat({every}, {f})"
    return f"list_filter(list_transform({every}, lambda x: {trim_sql('x')}), lambda x: length(x) > 5)"


_list_query("comment_extract", E.comments, "CASE " + " ".join(f"WHEN {LANG_SQL} IN ({', '.join(lit(x) for x, k in V.COMMENT_KIND.items() if k == kind)}) THEN {_comments_sql(kind)}" for kind in V.COMMENTS_OF) + " ELSE []::VARCHAR[] END")



@query(f"WITH {BASE} SELECT chunk_id, {' OR '.join(has(p) for p in V.DOC_FLAGS)} AS documented FROM base")
def documentation_flag(spark, d):
    return base(spark, d).select("chunk_id", E.has_documentation(F.col("c")).alias("documented")).distinct()


@query(f"""WITH {BASE}, l AS (SELECT chunk_id, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS i FROM base),
k AS (SELECT *, CASE WHEN regexp_matches({trim_sql('line')}, '^(function|class|def|import|export|const|let|var)\\s') THEN 'code' WHEN regexp_matches({trim_sql('line')}, '^[a-zA-Z0-9_-]+\\s*[=:]') THEN 'config' ELSE 'docs' END AS kind FROM l),
g AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM kind THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS grp FROM (SELECT *, lag(kind) OVER (PARTITION BY chunk_id ORDER BY i) AS before FROM k)),
s AS (SELECT chunk_id, grp, kind, string_agg(line || chr(10), '' ORDER BY i) AS t FROM g GROUP BY ALL)
SELECT chunk_id, string_agg(kind || length(t), '|' ORDER BY grp) AS items FROM s WHERE length({trim_sql('t')}) > 0 GROUP BY 1""")
def section_split(spark, d):
    s = F.transform(E.sections(F.col("c")), lambda x: F.concat(x["kind"], F.length(x["content"]).cast("string")))
    return base(spark, d).select("chunk_id", joined(s).alias("items")).where("items <> ''").distinct()


@query(f"""WITH {BASE}, p AS (SELECT *, string_split(file_path, '/') AS parts FROM base)
SELECT chunk_id, '[Context: File: ' || parts[-1] || ' | Location: ' || array_to_string(list_filter(parts[:-2], lambda x: x <> '')[-2:], '/') || ' | Type: code (x)' || CASE WHEN ext <> '' THEN ' | Format: ' || ext ELSE '' END || ']' || chr(10) || chr(10) AS header FROM p""")
def context_header(spark, d):
    return base(spark, d).select("chunk_id", E.context_header(F.col("file_path"), F.lit("code"), F.lit("x"), F.col("ext")).alias("header")).distinct()


REC = "r AS (SELECT DISTINCT id, query FROM search_recommendations WHERE query IS NOT NULL)"


def recs(spark, d) -> DataFrame:
    return t(spark, d, "search_recommendations").select("id", "query").where("query is not null").distinct()


TERMS_SQL = first_kept("""list_filter(list_transform(regexp_extract_all(lower(query), '"([^"]*)"|(\\S+)'), lambda x: CASE WHEN regexp_matches(x, '^"[^"]*"$') THEN substr(x, 2, length(x) - 2) ELSE x END), lambda x: length(x) > 1)""")


@query(f"WITH {REC} SELECT id, array_to_string({TERMS_SQL}, '|') AS terms FROM r")
def tokenize_query(spark, d):
    return recs(spark, d).select("id", joined(X.query_terms(F.col("query"))).alias("terms"))


@query(f"WITH {REC} SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1), '|') AS terms FROM r")
def word_tokens(spark, d):
    return recs(spark, d).select("id", joined(X.word_terms(F.col("query"))).alias("terms"))


@query(f"WITH {REC} SELECT id, to_base64(encode(query)) AS h FROM r")
def query_hash(spark, d):
    return recs(spark, d).select("id", X.query_hash(F.col("query")).alias("h"))


URLS = ["https://github.com/acme/tool.git", "https://github.com/acme/tool", "https://dev.azure.com/org/project/_git/repo", "git@host:acme/tool.git", "https://org.visualstudio.com/project/_git/repo", "plain", ""]
_URLS = "u AS (SELECT unnest([" + ", ".join(map(lit, URLS)) + "]) AS url UNION SELECT concat('https://github.com/', repo, '.git') FROM documents WHERE repo IS NOT NULL), b AS (SELECT url, regexp_replace(url, '\\.git$', '') AS bare FROM u), p AS (SELECT *, string_split(bare, '/') AS parts, list_filter(string_split(bare, '/'), lambda x: x <> '') AS f FROM b), a AS (SELECT *, coalesce(list_position(f, '_git'), 0) AS g FROM p)"


@query(f"""WITH {_URLS} SELECT url, CASE WHEN (bare LIKE '%dev.azure.com%' OR bare LIKE '%visualstudio.com%') AND g > 2 AND len(f) > g THEN f[g - 2] || '_' || f[g - 1] || '_' || f[g + 1] WHEN len(parts) >= 2 THEN parts[-2] || '_' || parts[-1] ELSE substr(regexp_replace(regexp_replace(bare, '^https?://', ''), '[^a-zA-Z0-9]', '_', 'g'), 1, 50) END AS name FROM a""")
def repo_name(spark, d):
    real = t(spark, d, "documents").where("repo is not null").select(F.concat(F.lit("https://github.com/"), "repo", F.lit(".git")).alias("url"))
    return spark.createDataFrame([(u,) for u in URLS], "url string").unionByName(real).distinct().select("url", X.repo_name(F.col("url")).alias("name"))


@query("SELECT DISTINCT file_path, substr(regexp_replace(regexp_replace(regexp_replace(file_path, '[^a-zA-Z0-9._-]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g'), 1, 255) AS name FROM chunks")
def sanitize_filename(spark, d):
    return t(spark, d, "chunks").select("file_path").distinct().withColumn("name", X.safe_filename(F.col("file_path")))


@query(f"SELECT DISTINCT file_path, string_split(file_path, '/')[-1] AS name, {EXT_SQL} AS ext, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM chunks")
def basename_ext(spark, d):
    p = F.col("file_path")
    return t(spark, d, "chunks").select("file_path").distinct().select("file_path", X.basename(p).alias("name"), X.extension(p).alias("ext"), X.directory(p).alias("dir"))


@query("SELECT job_id, message, regexp_matches(lower(message), '" + "|".join(V.ACCESS_ERRORS) + "') AS access FROM (SELECT DISTINCT job_id, message FROM job_events WHERE message IS NOT NULL)")
def access_errors(spark, d):
    return t(spark, d, "job_events").where("message is not null").select("job_id", "message").distinct().withColumn("access", X.is_access_error(F.col("message")))


@query(f"SELECT DISTINCT file_path, {EXT_SQL} IN ({', '.join(map(lit, V.SUPPORTED_EXT))}) AS supported FROM chunks")
def supported_extension(spark, d):
    return t(spark, d, "chunks").select("file_path").distinct().withColumn("supported", X.extension(F.col("file_path")).isin(V.SUPPORTED_EXT))


# ---- classification

def score_sql(patterns: list[str], each: float, most: float) -> str:
    return " + ".join(f"least({most}::DOUBLE, {n_of(p)} * {each}::DOUBLE)" for p in patterns)


CODE_SQL = f"least(1.0, {score_sql(V.CODE_SCORE, 0.1, 0.3)})"
DOCS_SQL = f"least(1.0, {score_sql(V.DOCS_SCORE, 0.05, 0.2)} + CASE WHEN len(list_filter(regexp_split_to_array(c, '[.!?]+'), lambda x: length({trim_sql('x')}) > 10)) > 3 THEN 0.3::DOUBLE ELSE 0 END)"
CONFIG_SQL = f"least(1.0, {score_sql(V.CONFIG_SCORE, 0.1, 0.4)})"


def _score_query(name: str, f: Callable[[Column], Column], sql: str) -> None:
    @query(f"WITH {BASE} SELECT chunk_id, round(({sql})::DOUBLE, 4) AS score FROM base", name=name)
    def run(spark, d):
        return base(spark, d).select("chunk_id", F.round(f(F.col("c")).cast("double"), 4).alias("score")).distinct()


PRESENCE_SQL = f"least(1.0, {score_sql(V.COMMENT_PATTERNS, 0.1, 0.3)} + " + " + ".join(f"CASE WHEN contains(c, {lit(k)}) THEN 0.1 ELSE 0 END" for k in V.DOC_KEYWORDS) + ")"
_score_query("code_score", K.code_score, CODE_SQL)
_score_query("docs_score", K.docs_score, DOCS_SQL)
_score_query("config_score", K.config_score, CONFIG_SQL)
_score_query("doc_presence", K.documentation_presence, PRESENCE_SQL)

KIND_SQL = f"CASE WHEN ext IN ({', '.join(map(lit, V.CODE_EXT))}) THEN 'code' WHEN ext IN ({', '.join(map(lit, V.DOCS_EXT))}) THEN 'docs' WHEN ext IN ({', '.join(map(lit, V.CONFIG_EXT))}) THEN 'config' ELSE 'mixed' END"
CONFIG_LANG_SQL = "CASE ext " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.CONFIG_LANGUAGE.items()) + " ELSE 'config' END"
HITS_SQL = {lang: " + ".join(f"{has(p)}::INT" for p in ps) for lang, ps in V.LANGUAGE_PATTERNS.items()}
TYPED = f"""{BASE}, sc AS (SELECT *, {CODE_SQL} AS code, {DOCS_SQL} AS docs, {CONFIG_SQL} AS config, {KIND_SQL} AS by_ext, {LANG_SQL} AS known, {', '.join(f'{s} AS n_{k}' for k, s in HITS_SQL.items())} FROM base),
fl AS (SELECT *, CASE {' '.join(f"WHEN n_{k} >= 2 THEN '{k}'" for k in HITS_SQL)} END AS first_lang, CASE {' '.join(f"WHEN n_{k} >= 2 THEN n_{k}" for k in HITS_SQL)} END AS first_n, greatest(code, docs, config) AS top FROM sc),
ty AS (SELECT *, CASE WHEN top > 0.7 AND ((code = top AND by_ext <> 'code') OR (docs = top AND by_ext <> 'docs') OR (config = top AND by_ext <> 'config')) THEN 'mixed' ELSE by_ext END AS kind,
 CASE by_ext WHEN 'code' THEN CASE WHEN first_n IS NOT NULL AND (known = 'unknown' OR first_n > 2) THEN first_lang ELSE known END WHEN 'docs' THEN 'natural' WHEN 'config' THEN {CONFIG_LANG_SQL} ELSE 'unknown' END AS lang FROM fl)"""


def typed(spark, d) -> DataFrame:
    return K.classify(base(spark, d).select("chunk_id", "file_path", F.col("c").alias("content"), F.col("ext").alias("file_extension")))


@query(f"WITH {TYPED} SELECT chunk_id, kind AS content_type, lang AS language, CASE WHEN by_ext = 'mixed' THEN 0.5 WHEN kind <> by_ext THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM ty")
def content_type(spark, d):
    return typed(spark, d).select("chunk_id", "content_type", "language", F.col("confidence").cast("double").alias("confidence")).distinct()


@query(f"WITH {TYPED} SELECT chunk_id, CASE WHEN first_n IS NOT NULL AND (known = 'unknown' OR first_n > 2) THEN first_lang ELSE known END AS language FROM ty")
def language_detect(spark, d):
    return base(spark, d).select("chunk_id", K.language(F.col("c"), F.col("ext")).alias("language")).distinct()


LINES = "string_split(c, chr(10))"
DENSITY_SQL = f"""CASE WHEN length(c) = 0 THEN 0 ELSE greatest(0.0, 1 - (CASE kind WHEN 'code' THEN {n_of(r'[{}();,]')} + length(c) - length({sub('c', r'\s{3,}', '')}) WHEN 'config' THEN 10 * (len({LINES}) - len(list_distinct(list_transform({LINES}, lambda x: {trim_sql('x')})))) ELSE {n_of(r'[*_`#]')} END) / length(c)) END"""
_FULL = f"list_filter(list_transform({LINES}, lambda x: {trim_sql('x')}), lambda x: length(x) > 0)"
NOISE_SQL = f"""(CASE kind WHEN 'code' THEN len(list_filter({_FULL}, lambda x: {n_of(r'[{}();,\[\]]', 'x')} > {n_of('[a-zA-Z0-9]', 'x')} * 0.5)) WHEN 'docs' THEN len(list_filter({_FULL}, lambda x: {n_of(r'[*_`#\-=]', 'x')} > length(x) * 0.3 OR (length(x) < 10 AND {n_of(r'[*_`#\-=]', 'x')} > 2))) ELSE 0 END) / greatest(len({LINES}), 1)"""
_INDENTS = f"list_filter(list_transform(list_filter({LINES}, lambda x: length({trim_sql('x')}) > 0), lambda x: length(regexp_extract(x, '^(\\s+)', 1))), lambda n: n > 0)"
CONSISTENT_SQL = f"(len({_INDENTS}) < 2 OR list_reduce({_INDENTS}, lambda a, b: greatest_common_divisor(a, b)) <= 8)"
CLARITY_SQL = f"""CASE WHEN len({_FULL}) = 0 THEN 0 ELSE least(1.0, 0.5 + CASE WHEN {CONSISTENT_SQL} THEN 0.2 ELSE 0 END + CASE kind WHEN 'code' THEN {' + '.join(f'CASE WHEN {has(p)} THEN 0.1 ELSE 0 END' for p in V.STRUCTURE_PATTERNS)} WHEN 'docs' THEN CASE WHEN {has(r'(?m)^#+\s+')} THEN 0.2 ELSE 0 END + CASE WHEN {has(r'(?m)^\s*[-*+]\s+')} THEN 0.1 ELSE 0 END ELSE 0 END) END"""


def _typed_query(name: str, col: str, sql: str) -> None:
    @query(f"WITH {TYPED} SELECT chunk_id, round(({sql})::DOUBLE, 4) AS score FROM ty", name=name)
    def run(spark, d):
        return typed(spark, d).select("chunk_id", F.round(F.col(col).cast("double"), 4).alias("score")).distinct()


_typed_query("semantic_density", "semantic_density", DENSITY_SQL)
_typed_query("syntax_noise", "syntax_noise", NOISE_SQL)
_typed_query("structural_clarity", "structural_clarity", CLARITY_SQL)


@query(f"""WITH {TYPED}, f AS (SELECT chunk_id, kind, {DENSITY_SQL} AS sd, {NOISE_SQL} AS sn, {PRESENCE_SQL} AS dp, {CLARITY_SQL} AS cl FROM ty)
SELECT chunk_id, round(greatest(0, least(1, CASE kind WHEN 'docs' THEN sd * 0.4 + (1 - sn) * 0.2 + dp * 0.2 + cl * 0.2 WHEN 'code' THEN sd * 0.3 + (1 - sn) * 0.3 + dp * 0.2 + cl * 0.2 ELSE sd * 0.4 + (1 - sn) * 0.4 + cl * 0.2 END))::DOUBLE, 4) AS score FROM f""")
def quality_score(spark, d):
    return typed(spark, d).select("chunk_id", F.round("quality_score", 4).alias("score")).distinct()


AUTH_SQL = "0.3 + " + " + ".join([*(f"CASE WHEN contains(lower(file_path), {lit(m)}) THEN 0.15 ELSE 0 END" for m in V.PATH_MARKERS), *(f"CASE WHEN contains(lower(c), {lit(m)}) THEN 0.05 ELSE 0 END" for m in V.CONTENT_MARKERS), "CASE WHEN contains(lower(file_path), 'example') OR contains(lower(file_path), 'sample') OR contains(lower(c), 'example') OR contains(lower(c), 'demo') THEN 0.1 ELSE 0 END", *(f"least(0.15, {n_of(u)} * 0.05)" for u in V.URL_PATTERNS)]) + " - CASE WHEN " + " OR ".join(f"contains(lower(c), {lit(m)})" for m in V.GENERATED_MARKERS) + " THEN 0.2 ELSE 0 END"


@query(f"WITH {BASE}, a AS (SELECT chunk_id, ({AUTH_SQL})::DOUBLE AS a FROM base) SELECT chunk_id, round(greatest(0, least(1, a)), 4) AS score, round(a, 6) > 0.7 AS official FROM a")
def authority_score(spark, d):
    a = K.raw_authority(F.col("c"), F.col("file_path"))
    return base(spark, d).withColumn("a", a).select("chunk_id", F.round(X.clamp(F.col("a"), 0.0, 1.0), 4).alias("score"), (F.round("a", 6) > 0.7).alias("official")).distinct()


_MARKERS_SQL = "list_filter([" + ", ".join([*(f"CASE WHEN contains(lower(file_path), {lit(m)}) THEN {lit('path-' + m)} END" for m in V.PATH_MARKERS), *(f"CASE WHEN contains(lower(c), {lit(m)}) THEN {lit('content-' + m)} END" for m in V.CONTENT_MARKERS), *(f"CASE WHEN {has(u)} THEN {lit('url-' + u.replace('/', chr(92) + '/'))} END" for u in V.URL_PATTERNS)]) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {BASE} SELECT chunk_id, array_to_string({_MARKERS_SQL}, '|') AS markers FROM base")
def authority_markers(spark, d):
    return base(spark, d).select("chunk_id", joined(K.authority_markers(F.col("c"), F.col("file_path"))).alias("markers")).distinct()


# ---- domains

PATH_SQL = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(file_path), {lit(i)})' for i in ids)} THEN {lit(k)} END" for k, ids in V.PATH_DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {BASE} SELECT chunk_id, array_to_string({PATH_SQL}, '|') AS domains FROM base")
def domain_path(spark, d):
    return base(spark, d).select("chunk_id", joined(F.transform(D.path_evidence(F.col("file_path")), lambda x: x["domain"])).alias("domains")).distinct()


@query("SELECT language, CASE language " + " ".join(f"WHEN {lit(k)} THEN {lit('|'.join(v))}" for k, v in V.LANGUAGE_DOMAINS.items()) + " ELSE '' END AS domains, count(*) AS n FROM content_metadata GROUP BY ALL")
def domain_language(spark, d):
    m = t(spark, d, "content_metadata").groupBy("language").agg(F.count("*").alias("n"))
    return m.select("language", joined(F.transform(D.language_evidence(F.col("language")), lambda x: x["domain"])).alias("domains"), "n")


#: Words of these test tables, by kind of domain; the vocabulary at first start hardly occurs in them.
TEST_VOCABULARY: D.Vocabulary = [("retrieval", 1.4, {"index": 1.0, "query": 0.9, "vector": 0.8, "chunk": 0.7, "score": 0.6}), ("storage", 1.3, {"cache": 1.0, "disk": 0.9, "file": 0.5, "record": 0.6}), ("python", 1.2, {"def": 0.5, "class": 0.5, "import": 0.6, "raise": 0.9})]
CONTENT_SQL = {k: "least(1.0, (" + " + ".join(f"{n_of(rf'\b{w}\b', 'lower(c)')} * {x * 0.1}" for w, x in ws.items()) + ") / ln(length(c) + 1000.0) * 100)" for k, _, ws in TEST_VOCABULARY}


@query(f"WITH {BASE}, s AS (" + " UNION ALL ".join(f"SELECT chunk_id, {lit(k)} AS domain, ({q})::DOUBLE AS score FROM base" for k, q in CONTENT_SQL.items()) + ") SELECT chunk_id, domain, round(score, 4) AS score FROM s WHERE score >= 0.1")
def domain_content(spark, d):
    e = D.content_evidence(F.col("c"), TEST_VOCABULARY)
    return X.exploded(base(spark, d), e, "x", "chunk_id").select("chunk_id", "x.domain", F.round("x.score", 4).alias("score")).distinct()


_IMPORTED = "list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(c, {lit(p)}, 1)" for p in V.IMPORT_PATTERNS[:2]) + f"), regexp_extract_all(c, {lit(V.IMPORT_PATTERNS[2])}, 1)), lambda x: lower(x))"
_WEB = "(contains(x, 'express') OR contains(x, 'react') OR contains(x, 'vue') OR contains(x, 'angular'))"
CONTEXT = f"""{BASE}, im AS (SELECT *, {_IMPORTED} AS imp, contains(file_path, 'package.json') OR contains(c, '"dependencies"') AS node FROM base),
ev AS (SELECT *, len(list_filter(imp, lambda x: {_WEB})) AS n_web, len(list_filter(imp, lambda x: NOT {_WEB} AND (contains(x, 'django') OR contains(x, 'flask')))) AS n_py, NOT node AND (contains(file_path, 'requirements.txt') OR contains(file_path, 'Pipfile')) AS py, contains(c, 'FROM ') OR contains(c, 'COPY ') OR contains(file_path, 'dockerfile') AS docker FROM im),
cx AS (SELECT chunk_id, 'web-frameworks' AS domain, n_web * 0.3 + n_py * 0.2 + CASE WHEN node AND contains(c, 'express') THEN 0.4 ELSE 0 END AS score FROM ev UNION ALL SELECT chunk_id, 'python', n_py * 0.3 + CASE WHEN py THEN 0.4 ELSE 0 END FROM ev UNION ALL SELECT chunk_id, 'javascript', CASE WHEN node THEN 0.4 ELSE 0 END FROM ev UNION ALL SELECT chunk_id, 'devops', CASE WHEN docker THEN 0.3 ELSE 0 END FROM ev)"""


@query(f"WITH {CONTEXT} SELECT chunk_id, domain, round(score::DOUBLE, 4) AS score FROM cx WHERE score > 0")
def domain_context(spark, d):
    e = D.context_evidence(F.col("c"), F.col("file_path"))
    return X.exploded(base(spark, d), e, "x", "chunk_id").select("chunk_id", "x.domain", F.round("x.score", 4).alias("score")).distinct()


_PATH_ROWS = " UNION ALL ".join(f"SELECT chunk_id, {lit(k)} AS domain, 0.8 AS score, {i} AS o FROM base WHERE {' OR '.join(f'contains(lower(file_path), {lit(x)})' for x in ids)}" for i, (k, ids) in enumerate(V.PATH_DOMAINS.items()))
_LANGUAGE_ROWS = " UNION ALL ".join(f"SELECT chunk_id, {lit(k)} AS domain, 0.6 AS score, {100 + i} AS o FROM base WHERE {LANG_SQL} = {lit(lang)}" for lang, ks in V.LANGUAGE_DOMAINS.items() for i, k in enumerate(ks))
_CONTENT_ROWS = " UNION ALL ".join(f"SELECT chunk_id, {lit(k)} AS domain, ({q})::DOUBLE AS score, {200 + i} AS o FROM base WHERE ({q}) >= 0.1" for i, (k, q) in enumerate(CONTENT_SQL.items()))


@query(f"""WITH {CONTEXT}, e AS ({_PATH_ROWS} UNION ALL {_LANGUAGE_ROWS} UNION ALL {_CONTENT_ROWS} UNION ALL SELECT chunk_id, domain, score, 300 + CASE domain WHEN 'web-frameworks' THEN 0 WHEN 'python' THEN 1 WHEN 'javascript' THEN 2 ELSE 3 END FROM cx WHERE score > 0),
s AS (SELECT chunk_id, domain, sum(score) AS score, min(o) AS o FROM e GROUP BY 1, 2)
SELECT chunk_id, domain, round(score::DOUBLE, 4) AS score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(score::DOUBLE, 9) DESC, o) <= 5""")
def domain_tags_top5(spark, d):
    rows = D.tag(base(spark, d).withColumn("lang", by_extension(F.col("ext"))), content="c", language="lang", vocabulary=TEST_VOCABULARY)
    return X.exploded(rows, F.col("domain_scores"), "x", "chunk_id").select("chunk_id", "x.domain", F.round("x.score", 4).alias("score")).distinct()


def _intent_sql(k: str, boost: float, words: dict[str, float], i: int) -> str:
    hit = {w: f"(list_contains(words, {lit(w)}) OR contains(lower(query), {lit(w)}))" for w in words}
    n = " + ".join(f"{h}::INT" for h in hit.values())
    weight = " + ".join(f"CASE WHEN {h} THEN {words[w]} ELSE 0 END" for w, h in hit.items())
    text = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {h} THEN {lit(w)} END" for w, h in hit.items()) + "], lambda x: x IS NOT NULL), ' ')"
    return f"SELECT id, {i} AS o, {lit(k)} AS domain, {text} AS matched, least(({n}) / 3, 1.0) * 0.4 + least(({weight}) / 2, 1.0) * 0.4 + least(length({text}) / greatest(length(query), 1), 0.8) * 0.2 AS confidence FROM w WHERE ({n}) > 0"


INTENT = f"{REC}, w AS (SELECT id, query, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1) AS words FROM r), i AS ({' UNION ALL '.join(_intent_sql(k, b, ws, n) for n, (k, b, ws) in enumerate(TEST_VOCABULARY))}), top AS (SELECT * FROM i WHERE confidence >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, o) <= 3)"


@query(f"WITH {INTENT} SELECT id, domain, matched, round(confidence::DOUBLE, 4) AS confidence FROM top")
def query_intent_top3(spark, d):
    q = D.query_intent(recs(spark, d), vocabulary=TEST_VOCABULARY)
    return X.exploded(q, F.col("detected_domains"), "x", "id").select("id", "x.domain", F.concat_ws(" ", "x.matched_keywords").alias("matched"), F.round("x.confidence", 4).alias("confidence"))


@query(f"WITH {INTENT} SELECT r.id, round(coalesce(avg(confidence), 0.5)::DOUBLE, 4) AS confidence FROM r LEFT JOIN top ON r.id = top.id GROUP BY r.id")
def intent_confidence(spark, d):
    return D.query_intent(recs(spark, d), vocabulary=TEST_VOCABULARY).select("id", F.round("intent_confidence", 4).alias("confidence"))


# ---- recommendations

#: Every query meets the chunks whose place among all chunks leaves its own place as remainder.
RESULTS = f"""{REC}, one AS (SELECT id, min(query) AS query FROM r GROUP BY 1), nr AS (SELECT id AS query_id, query, row_number() OVER (ORDER BY id) - 1 AS k FROM one),
ck AS (SELECT chunk_id, any_value(content) AS content FROM chunks GROUP BY 1), nc AS (SELECT content, (row_number() OVER (ORDER BY chunk_id) - 1) AS p FROM ck),
rs AS (SELECT query_id, query, p // (SELECT count(*) FROM nr) + 1 AS rank, lower(coalesce(content, '')) AS content FROM nc JOIN nr ON nr.k = p % (SELECT count(*) FROM nr)),
tq AS (SELECT query_id, query, {TERMS_SQL} AS terms FROM nr),
tt AS (SELECT query_id, query, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS term_pos FROM tq WHERE len(terms) BETWEEN 1 AND 8),
oc AS (SELECT tt.query_id, tt.query, term, term_pos, len(regexp_extract_all(content, '\\b' || regexp_replace(term, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') || '\\b')) AS n FROM tt JOIN rs ON tt.query_id = rs.query_id WHERE rank <= 5),
st AS (SELECT query_id, query, term, term_pos, count(*) AS n_docs, sum((n > 0)::INT)::BIGINT AS df, sum(n)::BIGINT AS total_tf FROM oc GROUP BY ALL),
tf AS (SELECT *, CASE WHEN df > 0 THEN total_tf / df ELSE 0 END * ln(((SELECT count(*) FROM documents_idx) + 1) / (df + 1)) AS tfidf FROM st)"""


def searched(spark, d) -> tuple[DataFrame, DataFrame]:
    q = recs(spark, d).groupBy(F.col("id").alias("query_id")).agg(F.min("query").alias("query"))
    k = _numbered(q, "query_id", "k").persist()
    n = k.count()
    c = _numbered(t(spark, d, "chunks").select("chunk_id", "content").dropDuplicates(["chunk_id"]), "chunk_id", "p")
    met = c.withColumn("k", F.col("p") % n).join(k, "k")
    return k.select("query_id", "query"), met.select("query_id", (F.floor(F.col("p") / n) + 1).alias("rank"), "content")


def n_documents(spark, d) -> int:
    return t(spark, d, "documents_idx").count()


def _numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Rows numbered from 0 in order of a unique column: counts per range partition, then places within each."""
    ranged = df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()).persist()
    sizes = dict(ranged.groupBy("_part").count().collect())  # a row per partition
    at, start = 0, {}
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    base_ = F.element_at(F.create_map(*[F.lit(x) for kv in (start or {0: 0}).items() for x in kv]), F.col("_part"))
    return ranged.withColumn(out, (base_ + F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1).cast("long")).drop("_part")


@query(f"WITH {RESULTS} SELECT query_id, term, n_docs, df, total_tf FROM st")
def term_df_tf(spark, d):
    return recommend.term_statistics(*searched(spark, d), n_documents(spark, d)).select("query_id", "term", "n_docs", F.col("df").cast("long").alias("df"), F.col("total_tf").cast("long").alias("total_tf"))


@query(f"WITH {RESULTS} SELECT query_id, term, round(tfidf, 6) AS tfidf, row_number() OVER (PARTITION BY query_id ORDER BY round(tfidf, 9), term_pos) AS place FROM tf")
def tfidf_scores(spark, d):
    s = recommend.term_statistics(*searched(spark, d), n_documents(spark, d))
    return s.select("query_id", "term", F.round("tfidf", 6).alias("tfidf"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("tfidf", 9), "term_pos")).cast("long").alias("place"))


_ESSENTIAL = f"(contains(query, '\"' || term || '\"') OR term IN ({', '.join(map(lit, V.ESSENTIAL_TERMS))}))"


@query(f"WITH {RESULTS} SELECT query_id, term, tfidf < 1.0 AND tfidf < 0.25 AND NOT {_ESSENTIAL} AS removable FROM tf")
def removable_terms(spark, d):
    q, r = searched(spark, d)
    return recommend.term_statistics(q, r, n_documents(spark, d)).join(q, "query_id").select("query_id", "term", recommend.removable().alias("removable"))


_RELATED = "(t.term <> bad AND (contains(t.term, bad) OR contains(bad, t.term) OR " + " OR ".join(f"(t.term = {lit(k)} AND bad IN ({', '.join(map(lit, vs))})) OR (bad = {lit(k)} AND t.term IN ({', '.join(map(lit, vs))}))" for k, vs in V.SYNONYMS.items()) + "))"


@query(f"""WITH {RESULTS}, b AS (SELECT query_id, term AS bad, tfidf AS bad_tfidf FROM tf WHERE tfidf < 1.0 AND tfidf < 0.25 AND NOT {_ESSENTIAL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tfidf, term_pos) = 1),
g AS (SELECT t.query_id, any_value(bad) AS bad, any_value(bad_tfidf) AS bad_tfidf, list(t.term ORDER BY term_pos) AS every, list(t.term ORDER BY tfidf DESC, term_pos) FILTER (tfidf > 2 AND {_RELATED}) AS better, list(t.term ORDER BY tfidf, term_pos) FILTER (tfidf > 3 AND df >= 2 AND t.term <> bad) AS more FROM tf t JOIN b USING (query_id) GROUP BY 1)
SELECT query_id, array_to_string(CASE WHEN len(every) > 2 THEN list_filter(every, lambda x: x <> bad) WHEN len(better) > 0 THEN better[:1] ELSE list_concat(every, more[:2]) END, '|') AS terms, CASE WHEN len(every) > 2 THEN 'removal' WHEN len(better) > 0 THEN 'refinement' ELSE 'contextual_addition' END AS suggestion_strategy,
round(CASE WHEN len(every) > 2 THEN greatest(0, least(1, bad_tfidf / 5)) WHEN len(better) > 0 THEN 0.7 ELSE 0.6 END::DOUBLE, 6) AS confidence, (SELECT count(*) FROM documents_idx)::INT AS total_documents, len(every)::INT AS analyzed_documents FROM g WHERE len(every) > 2 OR len(better) > 0 OR len(more) > 0""")
def recommendation_strategy(spark, d):
    found = recommend.recommend(*searched(spark, d), n_documents(spark, d), now=F.lit("2025-06-01").cast("timestamp"))
    return found.select("query_id", F.concat_ws("|", "suggested_terms").alias("terms"), "suggestion_strategy", F.round("confidence", 6).alias("confidence"), "total_documents", "analyzed_documents")


NOW = "(SELECT max(generated_at) FROM search_recommendations)"


@query(f"SELECT query, id, suggestion_strategy FROM (SELECT DISTINCT query, id, suggestion_strategy, generated_at FROM search_recommendations WHERE expires_at > {NOW} AND query IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY generated_at DESC NULLS LAST, id DESC) = 1")
def cached_recommendation_latest(spark, d):
    r = t(spark, d, "search_recommendations")
    now = r.agg(F.max("generated_at")).first()[0]
    return recommend.cached(r.where("query is not null"), F.lit(now)).select("query", "id", "suggestion_strategy")


@query(f"SELECT count(*) AS kept FROM search_recommendations WHERE expires_at IS NULL OR expires_at > {NOW}")
def ttl_purge(spark, d):
    r = t(spark, d, "search_recommendations")
    return recommend.unexpired(r, F.lit(r.agg(F.max("generated_at")).first()[0])).agg(F.count("*").alias("kept"))


@query("SELECT e.id, e.recommendation_id FROM recommendation_effectiveness e SEMI JOIN search_recommendations r ON e.recommendation_id = r.id")
def effectiveness_of_known(spark, d):
    return recommend.of_known(t(spark, d, "recommendation_effectiveness"), t(spark, d, "search_recommendations")).select("id", "recommendation_id")


# ---- learning

RECENT = """s AS (SELECT recommendation_id, effectiveness_score::DOUBLE AS x, row_number() OVER (PARTITION BY recommendation_id ORDER BY id DESC) AS r FROM recommendation_effectiveness WHERE effectiveness_score IS NOT NULL AND recommendation_id IS NOT NULL),
l AS (SELECT recommendation_id, list(x ORDER BY r DESC) FILTER (r <= 20) AS h20, list(x ORDER BY r DESC) FILTER (r <= 30) AS h30, count(*) AS n FROM s GROUP BY 1)"""


@query(f"WITH {RECENT} SELECT recommendation_id, n, round(list_reduce(h20, lambda a, x: a * 0.9 + x * 0.1), 6) AS ewma FROM l")
def ewma_effectiveness(spark, d):
    e = t(spark, d, "recommendation_effectiveness").where("effectiveness_score is not null and recommendation_id is not null")
    return learning.recent_statistics(e, "recommendation_id", ["id"], "effectiveness_score").select("recommendation_id", "n", F.round("ewma", 6).alias("ewma"))


@query(f"WITH {RECENT} SELECT recommendation_id, round(CASE WHEN len(h30) < 2 THEN 0 ELSE least(1, list_aggregate(h30, 'var_pop')) END, 6) AS variance FROM l")
def recent_variance(spark, d):
    e = t(spark, d, "recommendation_effectiveness").where("effectiveness_score is not null and recommendation_id is not null")
    return learning.recent_statistics(e, "recommendation_id", ["id"], "effectiveness_score").select("recommendation_id", F.round("variance", 6).alias("variance"))


def _feedback(spark, d) -> DataFrame:
    e = t(spark, d, "recommendation_effectiveness").select("id", "recommendation_id", "effectiveness_score")
    r = t(spark, d, "search_recommendations").select(F.col("id").alias("recommendation_id"), "suggestion_strategy").dropDuplicates(["recommendation_id"])
    return e.join(r, "recommendation_id")


#: A strategy's weight beside those of the others, which stay equal among themselves.
FOLD = f"""WITH RECURSIVE f AS (SELECT suggestion_strategy AS s, effectiveness_score::DOUBLE AS x, row_number() OVER (PARTITION BY suggestion_strategy ORDER BY e.id) AS i FROM recommendation_effectiveness e JOIN (SELECT DISTINCT ON (id) id, suggestion_strategy FROM search_recommendations) r ON e.recommendation_id = r.id WHERE effectiveness_score IS NOT NULL AND suggestion_strategy IS NOT NULL),
h AS (SELECT *, list(x) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN {V.EWMA_WINDOW - 1} PRECEDING AND CURRENT ROW) AS a, list(x) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN {V.VARIANCE_WINDOW - 1} PRECEDING AND CURRENT ROW) AS b FROM f),
m AS (SELECT s, i, x, list_reduce(a, lambda p, q: p * {1 - V.EWMA_ALPHA} + q * {V.EWMA_ALPHA}) AS e, CASE WHEN len(b) < 2 THEN 0 ELSE least(1, list_aggregate(b, 'var_pop')) END AS v FROM h),
r AS (SELECT DISTINCT s, 0::BIGINT AS i, {V.THRESHOLD_START}::DOUBLE AS t, {V.RATE_START}::DOUBLE AS rate, 1.0::DOUBLE AS w, 1.0::DOUBLE AS o, CASE WHEN s IN ({', '.join(map(lit, V.STRATEGIES))}) THEN {len(V.STRATEGIES) - 1} ELSE {len(V.STRATEGIES)} END AS n FROM f
UNION ALL SELECT s, i, greatest({V.THRESHOLD_MIN}, least({V.THRESHOLD_MAX}, t + CASE WHEN e > 0.7 THEN -{V.THRESHOLD_STEP} WHEN e < 0.3 THEN {V.THRESHOLD_STEP} ELSE 0 END)), greatest({V.RATE_MIN}, least({V.RATE_MAX}, rate + CASE WHEN v < 0.1 THEN {V.RATE_STEP} WHEN v > 0.3 THEN -{V.RATE_STEP} ELSE 0 END)), nw / ((nw + n * o) / (n + 1)), o / ((nw + n * o) / (n + 1)), n
FROM (SELECT r.s, m.i, r.t, r.rate, r.o, r.n, m.e, m.v, greatest({V.WEIGHT_MIN}, least({V.WEIGHT_MAX}, r.w + greatest(-{V.WEIGHT_STEP}, least({V.WEIGHT_STEP}, (m.x - 0.5) * r.rate)))) AS nw FROM r JOIN m ON m.s = r.s AND m.i = r.i + 1))
SELECT s AS suggestion_strategy, i AS n, round(t, 6) AS threshold, round(rate, 6) AS rate, round(w, 6) AS weight FROM r QUALIFY row_number() OVER (PARTITION BY s ORDER BY i DESC) = 1"""


@query(FOLD)
def learning_fold(spark, d):
    log = _feedback(spark, d).withColumn("strategy", F.col("suggestion_strategy"))
    f = learning.fold(log, "suggestion_strategy", ["id"], "effectiveness_score", "strategy")
    return f.select("suggestion_strategy", "n", F.round("threshold", 6).alias("threshold"), F.round("rate", 6).alias("rate"), F.round(F.element_at("weights", F.col("suggestion_strategy")), 6).alias("weight"))


WEIGHTS = """w AS (SELECT suggestion_strategy AS s, avg(least(1, greatest(0, effectiveness_score))) + 0.5 AS v FROM recommendation_effectiveness e JOIN (SELECT DISTINCT ON (id) id, suggestion_strategy FROM search_recommendations) r ON e.recommendation_id = r.id WHERE effectiveness_score IS NOT NULL AND suggestion_strategy IS NOT NULL GROUP BY 1)"""


def weights(spark, d) -> DataFrame:
    g = _feedback(spark, d).where("effectiveness_score is not null and suggestion_strategy is not null").groupBy(F.col("suggestion_strategy").alias("s")).agg((F.avg(X.clamp(F.col("effectiveness_score"), 0.0, 1.0)) + 0.5).alias("v"))
    return g.agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("w"))  # a row per strategy


@query(f"WITH {WEIGHTS} SELECT s AS strategy, round(v / (SELECT avg(v) FROM w), 6) AS weight FROM w")
def strategy_weights_normalised(spark, d):
    return weights(spark, d).select(F.explode(learning.normalised_weights(F.col("w"))).alias("strategy", "weight")).select("strategy", F.round("weight", 6).alias("weight"))


@query(f"WITH {WEIGHTS} SELECT s AS strategy, row_number() OVER (ORDER BY v DESC, s) - 1 AS place FROM w")
def strategy_ranking(spark, d):
    return weights(spark, d).select(F.posexplode(learning.strategy_ranking(F.col("w"))).alias("place", "strategy")).select("strategy", F.col("place").cast("long").alias("place"))


# ---- jobs

RANK = "CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 1 ELSE 0 END"
STATE = f"""ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC NULLS LAST, coalesce({RANK}, 0) DESC, coalesce(progress, -1) DESC, coalesce(status, '') DESC, coalesce(message, '') DESC) AS r,
 row_number() OVER (PARTITION BY job_id ORDER BY (progress IS NULL), ts DESC NULLS LAST, progress DESC) AS rp FROM job_events WHERE job_id IS NOT NULL),
st AS (SELECT job_id, max(CASE WHEN r = 1 THEN type END) AS type, max(CASE WHEN r = 1 THEN status END) AS status, max(CASE WHEN rp = 1 THEN progress END) AS p, max(CASE WHEN r = 1 THEN message END) AS message, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1),
state AS (SELECT job_id, type, status, CASE WHEN status = 'completed' THEN 100 ELSE greatest(0, least(100, coalesce(p, 0))) END::DOUBLE AS progress, message, a, b FROM st)"""


@query(f"WITH {STATE} SELECT job_id, type, status, round(progress, 6) AS progress, message, epoch_us(a) AS started, epoch_us(b) AS updated FROM state")
def job_state_fold(spark, d):
    s = jobs.state(t(spark, d, "job_events"))
    return s.select("job_id", "type", "status", F.round("progress", 6).alias("progress"), "message", F.unix_micros("started_at").alias("started"), F.unix_micros("updated_at").alias("updated"))


@query(f"WITH {STATE} SELECT count(*) AS total, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(coalesce(avg((epoch_us(b) - epoch_us(a)) / 1e6) FILTER (status = 'completed'), 0), 3) AS avg_duration FROM state")
def job_statistics(spark, d):
    return jobs.statistics(jobs.state(t(spark, d, "job_events"))).withColumn("avg_duration", F.round("avg_duration", 3))


@query(f"WITH {STATE} SELECT job_id, type FROM state WHERE status = 'running'")
def active_jobs(spark, d):
    return jobs.active(jobs.state(t(spark, d, "job_events"))).select("job_id", "type")


@query(f"WITH {STATE} SELECT job_id, status FROM state WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled') AND b < (SELECT max(ts) FROM job_events) - INTERVAL 24 HOUR, false)")
def job_cleanup(spark, d):
    e = t(spark, d, "job_events")
    return jobs.cleanup(jobs.state(e), F.lit(e.agg(F.max("ts")).first()[0])).select("job_id", "status")


@query(f"WITH {STATE} SELECT CASE WHEN job_id = (SELECT min(job_id) FROM state WHERE status = 'running') THEN 'failed' ELSE status END AS status, count(*) AS n FROM state GROUP BY 1")
def job_cancel(spark, d):
    s = jobs.state(t(spark, d, "job_events"))
    first = s.where("status = 'running'").agg(F.min("job_id")).first()[0]
    return jobs.cancel(s, first).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {STATE} SELECT job_id, round(CASE status WHEN 'completed' THEN 100 WHEN 'failed' THEN 0 ELSE greatest(0, least(100, progress)) END::DOUBLE, 6) AS progress, epoch_us(ts) AS us FROM ev WHERE r = 1")
def latest_progress(spark, d):
    return jobs.latest_progress(t(spark, d, "job_events")).select("job_id", F.round("progress", 6).alias("progress"), F.unix_micros("ts").alias("us"))


@query(f"WITH {STATE} SELECT count(DISTINCT job_id) AS jobs_with_subscribers, count(*) AS subscribers, (SELECT count(*) FROM state) AS cached FROM (SELECT DISTINCT job_id, message FROM job_events WHERE job_id IS NOT NULL)")
def progress_statistics(spark, d):
    e = t(spark, d, "job_events").where("job_id is not null")
    return jobs.progress_statistics(e.select("job_id", "message").distinct(), jobs.latest_progress(e))


# ---- without SQL: Python's JSON, embeddings, streams

@query("""SELECT event_id, '{' || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  "' || k || '": ' || json_extract(props, '$.' || k)::VARCHAR), ',' || chr(10)) || chr(10) || '}' AS pretty FROM events""")
def json_pretty(spark, d):
    return t(spark, d, "events").select("event_id", X.pretty_json(F.col("props")).alias("pretty"))


@query("SELECT event_id, array_to_string(json_keys(props), '|') AS paths FROM events")
def json_key_paths(spark, d):
    return t(spark, d, "events").select("event_id", joined(X.json_key_paths(F.col("props"))).alias("paths"))


@query()
def enhanced_content(spark, d):
    return D.tag(E.enhance(typed(spark, d)), content="enhanced_content").select("chunk_id", "content_type", "has_comments", "has_documentation", F.md5("enhanced_content").alias("h"), joined(F.col("domain_tags")).alias("tags")).distinct()


@query(f"WITH RECURSIVE {DOCS}, {FIXED}, " + windows_sql("SELECT file_path, string_agg(piece, ' ' ORDER BY n) AS j FROM pieces WHERE piece IS NOT NULL GROUP BY file_path").replace("SELECT file_path, file_path || ':'", "SELECT file_path || ':'", 1).replace("AS chunk_id, (o // 800)::BIGINT AS chunk_index, md5(substr(j, o + 1, 1000)) AS h, strlen(j)::BIGINT AS file_size,", "AS chunk_id,").replace("AS token_count FROM w", "AS token_count, 512::BIGINT AS dim, NULL::VARCHAR AS embedding_error FROM w"))
def ingest_end_to_end(spark, d):
    out = embed(chunk(docs(spark, d)))
    return out.select("chunk_id", F.col("chunk_offset").cast("long").alias("chunk_offset"), F.col("token_count").cast("long").alias("token_count"), F.size("embedding").cast("long").alias("dim"), "embedding_error")


@query()
def hash_embed_search(spark, d):
    c = embed(chunk(docs(spark, d)), embedder=HashingEmbedder(256))
    return retrieval.previews(retrieval.knn(c, embed_query("cache index of the vector", HashingEmbedder(256)), 10)).select("chunk_id", "score_text", "preview")


@query(f"WITH {STATE}, n AS (SELECT job_id, count(*) AS events FROM job_events WHERE job_id IS NOT NULL GROUP BY 1) SELECT job_id, status, round(progress, 6) AS progress, events FROM state JOIN n USING (job_id)")
def stream_job_states(spark, d):
    """The job log run as a stream to its end; one last state per job."""
    from docloom.streaming.streams import job_event_stream, job_state_stream

    out = shared_folder(spark)
    states = job_state_stream(job_event_stream(spark, f"{d}/job_events.parque[t]"), ttl_ms=None)
    save = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/{n}")
    states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("job_id string, status string, progress double, message string, events long, batch long").parquet(f"{out}/rows/*")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", F.round("progress", 6).alias("progress"), "events"), "batch").alias("x")).select("job_id", "x.*")


@query(ORACLE["chunk_fixed_breakpoints"])
def stream_ingest_equals_batch(spark, d):
    """The documents run as a stream of micro-batches through the chunking of an ingest; the rows are those of the batch."""
    out = shared_folder(spark)
    src = spark.readStream.schema(t(spark, d, "documents").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/documents.parque[t]")
    rows = src.where("text is not null").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    save = lambda df, n: as_chunks(chunk(spread(df), ChunkingConfig(method="fixed"))).write.mode("overwrite").parquet(f"{out}/rows/{n}")
    rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows/*")
