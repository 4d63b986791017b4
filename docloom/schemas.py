"""Table schemas, option records and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DIM = 512

DOCUMENTS = "file_path string, file_name string, last_modified timestamp, total_chunks int, total_tokens int, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, file_path string, chunk_index int, content string, embedding array<float>, chunk_offset int, token_count int, created_at timestamp"
METADATA = "chunk_id string, content_type string, language string, domain_tags array<string>, quality_score double, source_authority double, processed_content string, raw_content string, file_extension string, has_comments boolean, has_documentation boolean, created_at timestamp"
VOCABULARY = "domain string, keywords array<struct<keyword:string,weight:double>>, authority_patterns array<string>, boost_factor double"
RECOMMENDATIONS = "id string, query string, suggested_terms array<string>, suggestion_strategy string, tfidf_threshold double, confidence double, generated_at timestamp, expires_at timestamp, total_documents int, analyzed_documents int"
EFFECTIVENESS = "id long, recommendation_id string, was_used boolean, improved_results boolean, usage_time timestamp, effectiveness_score double, original_result_count int, improved_result_count int"
LEARNING = "current_tfidf_threshold double, effectiveness_history array<double>, strategy_weights map<string,double>, last_updated timestamp, learning_rate double"
JOB_EVENTS = "job_id string, type string, status string, progress double, message string, ts timestamp"
TABLES = {"documents_idx": DOCUMENTS, "chunks": CHUNKS, "content_metadata": METADATA, "domain_vocabulary": VOCABULARY, "search_recommendations": RECOMMENDATIONS, "recommendation_effectiveness": EFFECTIVENESS, "learning_parameters": LEARNING, "job_events": JOB_EVENTS}


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]


@dataclass
class SearchOptions:
    """limit: hits; min_score: see mode; mode: 'similarity' (cosine, higher is better) or 'distance' (L2, the raw order).

    strict=True keeps the raw behaviour of a score that is a distance: hits at or above min_score, boosted then sorted
    descending, and minimum scores alone do not start the filter stage.
    """

    limit: int = 10
    min_score: float = 0.0
    mode: str = "similarity"
    strict: bool = False
    prefilter: bool = False
    domain_filter: list[str] = field(default_factory=list)
    content_type_filter: list[str] = field(default_factory=list)
    language_filter: list[str] = field(default_factory=list)
    min_quality_score: float | None = None
    min_authority_score: float | None = None


@dataclass
class ChunkingConfig:
    chunk_size: int = 1000
    overlap: int = 200
    method: str = "fixed"
    preserve_code_blocks: bool = False


class EngineError(Exception):
    code = "ENGINE_ERROR"


class FileError(EngineError):
    code = "FILE_ERROR"


class EmbeddingError(EngineError):
    code = "EMBEDDING_ERROR"


class StoreError(EngineError):
    code = "STORE_ERROR"
