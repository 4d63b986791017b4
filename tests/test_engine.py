import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.operators import jobs, learning, recommend, retrieval
from docloom.schemas import JOB_EVENTS, SearchOptions
from docloom.sources import files
from docloom.sources.embedding import HashingEmbedder, embed
from docloom.sources.store import Store, insert_missing, upsert

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def test_engine_round_trip(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Databases\n\nA query on a sql database with an index. " * 40)
    (docs / "b.py").write_text("import os\n\ndef main(x):\n    return os.path.join(x)\n" * 10)
    (docs / "empty.txt").write_text("")
    e = Engine(spark, str(tmp_path / "engine"), HashingEmbedder(512))
    job = e.ingest_path(str(docs))
    assert e.job_status(job)["status"] == "completed"
    n = e.store.read("chunks").count()
    assert n >= 4 and e.index_statistics()["total_documents"] == 2
    e.ingest_path(str(docs))
    assert e.store.read("chunks").count() == n  # replaced, not added
    got = e.search_documents("sql database query", SearchOptions(limit=3))
    assert got["total_results"] == 3 and got["results"][0]["file_path"].endswith("a.md") and got["next_steps"]
    assert e.search("sql", SearchOptions(content_type_filter=["code"], prefilter=True)).where("content_type <> 'code'").count() == 0
    path = got["results"][0]["file_path"]
    assert e.file_details(path, 1, 1).count() in (2, 3) and e.file_details(path, 99).count() == 0
    assert e.remove_file(path) > 0 and e.store.read("chunks").where(F.col("file_path") == path).count() == 0
    bad = e.ingest_path(str(docs / "empty.txt"))
    assert e.job_status(bad)["status"] == "failed"
    report = {r["step"]: r for r in e.flush_all()}
    assert report["chunks"]["ok"] and e.store.read("chunks").count() == 0 and e.store.read("domain_vocabulary").count() == 4


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("chunks").count() == 0
    a = spark.createDataFrame([("f:0", "f", 0, "x", [1.0], 0, 1, T0)], s.read("chunks").schema)
    s.write("chunks", a)
    s.upsert("chunks", a.withColumn("content", F.lit("y")), ["chunk_id"])
    assert [r["content"] for r in s.read("chunks").collect()] == ["y"]
    assert s.delete("chunks", F.col("file_path") == "f") == 1 and s.read("chunks").count() == 0
    assert s.learning_parameters().first()["learning_rate"] == 0.05
    two = spark.createDataFrame([(f"{p}:{i}", p, i, "x", [1.0], 0, 1, T0) for p in ("f", "g") for i in range(3)], s.read("chunks").schema)
    s.store_chunks(two)
    before = s._manifest("chunks")["buckets"]
    s.store_chunks(two.where("file_path = 'f' and chunk_index < 2"))
    after = s._manifest("chunks")["buckets"]
    assert s.read("chunks").count() == 5 and len(before) == 2 and sum(before[k] != after[k] for k in before) == 1  # one bucket was written anew
    s.write("content_metadata", spark.createDataFrame([("g:0",), ("f:1",)], "chunk_id string").select(*[F.col("chunk_id") if f == "chunk_id" else F.lit(None).alias(f) for f in s.read("content_metadata").columns]))
    assert s.delete_file("g") == 3 and s.read("chunks").select("file_path").distinct().count() == 1 and [r[0] for r in s.read("content_metadata").select("chunk_id").collect()] == ["f:1"]
    assert s.clear("chunks") == 2 and s.read("chunks").count() == 0 and s.size() > 0
    for i in range(3):
        s.append("job_events", spark.createDataFrame([("j", "t", "running", float(i), "m", T0)], JOB_EVENTS))
    assert s.read("job_events").count() == 3 and len(s._manifest("job_events")["buckets"]["0"]) == 3
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, upsert(d, spark.createDataFrame([("b", 3), ("c", 4)], d.schema), ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, insert_missing(d, spark.createDataFrame([("b", 3), ("c", 4)], d.schema), ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_pack_and_files(spark, tmp_path):
    for p, t in {"a.md": "A", "x/b.txt": "B", "node_modules/c.md": "C", "d.py": "D", "x/e.json": '{"a":1}'}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert sorted(r["file_path"] for r in files.pack_repository(spark, str(tmp_path)).collect()) == ["a.md", "x/b.txt", "x/e.json"]
    out = files.write_pack(files.pack_repository(spark, str(tmp_path), exclude=["x/*"]), str(tmp_path / "out" / "p.md"))
    assert "## File: a.md" in open(out).read()
    rows = {r["file_name"]: r for r in files.read_files(spark, str(tmp_path), max_mb=0).collect()}
    assert rows["a.md"]["status"] == "too large" and rows["a.md"]["content"] is None
    assert files.is_access_error("HTTP 403") and not files.is_access_error("timeout")


def test_embedding_fallback(spark):
    class Bad(HashingEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return super().embed(texts)

    rows = embed(spark.createDataFrame([("good",), ("bad",), (None,)], "content string"), embedder=Bad(8)).collect()
    assert rows[0]["embedding_error"] is None and len(rows[0]["embedding"]) == 8
    assert rows[1]["embedding"] is None and rows[1]["embedding_error"] == "no"


def test_learning_expressions_equal_the_fold(spark):
    rnd = random.Random(1)
    for scores in ([], [0.5], [1.0] * 5, [rnd.random() for _ in range(100)]):
        row = spark.range(1).select(F.lit(0).alias("z")).withColumn("s", F.array(*[F.lit(x) for x in scores]).cast("array<double>"))
        got = row.select(learning.ewma_expr(F.col("s")), learning.variance_expr(F.col("s"))).first()
        assert got[0] == pytest.approx(learning.ewma(scores)) and got[1] == pytest.approx(learning.variance(scores))
    p = learning.Params()
    for i in range(1100):
        p = learning.update(p, i % 2, "removal")
    assert len(p.history) == 1000 and sum(p.weights.values()) / 3 == pytest.approx(1.0) and 0.1 <= p.threshold <= 0.5 and 0.01 <= p.rate <= 0.1
    assert learning.Params.from_json(p.to_json()) == p
    log = spark.createDataFrame([("a", i, rnd.random()) for i in range(50)] + [("b", 1, None), (None, 1, 0.5)], "k string, i long, s double")
    got = learning.fold(log, "k", ["i"], "s").collect()
    q = learning.Params()
    for r in log.where("k = 'a'").orderBy("i").collect():
        q = learning.update(q, r["s"])
    assert len(got) == 1 and got[0]["threshold"] == pytest.approx(q.threshold) and got[0]["rate"] == pytest.approx(q.rate)


def test_jobs(spark):
    ev = [("j", "t", "running", 150.0, "a", T0), ("j", "t", "completed", None, "b", T0 + timedelta(hours=1)), ("j", "t", "running", 30.0, "late", T0 + timedelta(minutes=1)), ("k", "t", "running", -5.0, "x", T0), ("k", "t", "running", -5.0, "x", T0), (None, "t", "running", 1.0, "x", T0)]
    e = spark.createDataFrame(ev, JOB_EVENTS)
    s = {r["job_id"]: r for r in jobs.state(e).collect()}
    assert s["j"]["status"] == "completed" and s["j"]["progress"] == 100 and s["k"]["progress"] == 0 and s["k"]["events"] == 1
    assert jobs.active(jobs.state(e)).count() == 1 and jobs.cancel(jobs.state(e), "k").where("status = 'failed'").count() == 1
    assert jobs.cleanup(jobs.state(e), F.lit(T0 + timedelta(days=3))).count() == 1
    st = jobs.statistics(jobs.state(e)).first()
    assert st["total"] == 2 and st["avg_duration"] == 3600
    assert jobs.statistics(jobs.state(e.limit(0))).first()["total"] == 0
    got = spark.range(1).select(jobs.interpolated(F.lit("repo"), F.lit("process"), F.lit("embed"), F.lit(0.5)).alias("p")).first()["p"]
    assert got == pytest.approx(30 + 70 * 0.5)


def test_recommendations(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha betas"), (3, ""), (4, " ".join(f"t{i}x" for i in range(9))), (5, '"alpha" beta gamma')], "query_id long, query string")
    text = "alpha alpha alpha beta"
    r = spark.createDataFrame([(i, k, text if k < 3 else "none") for i in range(1, 6) for k in range(1, 6)], "query_id long, rank int, content string")
    got = {x["query_id"]: x for x in recommend.recommend(q, r, 5).collect()}
    assert got[1]["suggestion_strategy"] == "removal" and got[1]["suggested_terms"] == ["alpha", "beta"]
    assert 3 not in got and 4 not in got and got[5]["suggested_terms"] == ["alpha", "beta"]
    assert got[1]["total_documents"] == 5 and got[1]["analyzed_documents"] == 3
    # N is the index's, not the five hits': a term of all hits weighs much in a large index, and the better term stands alone
    two = spark.createDataFrame([(1, "betas beta"), (2, "Plain \"Beta\"")], "query_id long, query string")
    hits = spark.createDataFrame([(i, k, "beta beta beta") for i in (1, 2) for k in (1, 2)], "query_id long, rank int, content string")
    big = {x["query_id"]: x for x in recommend.recommend(two, hits, 1000).collect()}
    assert big[1]["suggestion_strategy"] == "refinement" and big[1]["suggested_terms"] == ["beta"] and big[2]["suggested_terms"] == ["plain", "beta", "beta"]
    live = spark.createDataFrame([("a", "q", T0, T0 + timedelta(days=1)), ("b", "q", T0 + timedelta(hours=1), T0 + timedelta(days=1)), ("c", "q", T0, T0)], "id string, query string, generated_at timestamp, expires_at timestamp")
    assert [x["id"] for x in recommend.cached(live, F.lit(T0)).collect()] == ["b"] and recommend.unexpired(live, F.lit(T0)).count() == 2


def test_boost_keeps_order_of_equals_and_strict_gate(spark):
    h = spark.createDataFrame([("a", 0.5, 1, ["x"]), ("b", 0.5, 2, None), ("c", 0.4, 3, ["y"])], "chunk_id string, score double, rank int, domain_tags array<string>")
    d = F.array(F.struct(F.lit("y").alias("domain"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("matched_keywords"), F.lit(1.5).alias("boost_factor")))
    assert [r["chunk_id"] for r in retrieval.boost(h, d).orderBy("rank").collect()] == ["c", "a", "b"]
    assert retrieval.metadata_predicate(SearchOptions(min_quality_score=0.5, strict=True)) is None
    assert retrieval.metadata_predicate(SearchOptions(min_quality_score=0.5)) is not None


def test_streams(spark, tmp_path):
    from docloom.streaming.streams import file_stream, ingest_stream, job_event_stream, job_state_stream, learning_stream

    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.txt").write_text("words and more words " * 100)
    s = Store(spark, str(tmp_path / "t"))
    for _ in range(2):
        ingest_stream(file_stream(spark, str(docs)), s, str(tmp_path / "cp"), embedder=HashingEmbedder(512)).awaitTermination()
    assert s.read("chunks").count() == 3
    ev = tmp_path / "ev"
    spark.createDataFrame([("j", "t", "running", 10.0, "a", T0), ("j", "t", "completed", None, "b", T0 + timedelta(seconds=5))], JOB_EVENTS).write.parquet(str(ev))
    q = job_state_stream(job_event_stream(spark, str(ev)), None).writeStream.outputMode("update").format("memory").queryName("js").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("js").collect()[-1]["progress"] == 100
    fb = tmp_path / "fb"
    spark.createDataFrame([("removal", 1.0, T0)], "strategy string, score double, ts timestamp").write.parquet(str(fb))
    src = spark.readStream.schema("strategy string, score double, ts timestamp").parquet(str(fb))
    learning_stream(src).writeStream.outputMode("update").format("memory").queryName("ls").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("ls").first()["n"] == 1


def test_recommendations_and_learning_of_the_engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(4):
        (docs / f"{i}.md").write_text(f"# Index {i}\n\nA query on a sql database with an index. " * 20)
    e = Engine(spark, str(tmp_path / "engine"), HashingEmbedder(512))
    seen = []
    stop = e.subscribe(seen.append)
    job = e.ingest_path(str(docs))
    assert [x["progress"] for x in seen] == [0.0, 46.0, 88.0, 100.0] and e.job_status(job)["status"] == "completed"
    stop()
    last = []
    e.subscribe(last.append, job)
    assert [x["progress"] for x in last] == [100.0] and e.cancel_job(job) is False and len(seen) == 4
    got = e.search_documents("sql database index of unheard zzyzx queries")
    rec = got["recommendation"]
    assert rec["suggestion_strategy"] == "removal" and rec["id"].startswith("rec_") and rec["total_documents"] == 4 and len(rec["id"].split("_")[2]) == 9
    assert e.search_documents("sql database index of unheard zzyzx queries")["recommendation"]["id"] == rec["id"]  # the stored one
    p = e.feedback(rec["id"], True, 1.0, 3, True, 0)
    row = e.store.read("recommendation_effectiveness").first()
    assert row["improved_result_count"] is None and row["improved_results"] and p.weights["removal"] > 1 and e.store.current_parameters() == p
    e.reset_learning()
    assert e.store.current_parameters() == learning.Params()
    assert e.store.clear_recommendations() == 1 and e.store.read("recommendation_effectiveness").count() == 0
    (docs / "bad.txt").write_text("")
    assert e.job_status(e.ingest_file((docs / "bad.txt").as_uri(), "bad.txt"))["status"] == "failed"
    assert e.job_status(e.ingest_file((docs / "0.md").as_uri(), "one.md"))["status"] == "completed"
    empty = tmp_path / "empty"
    empty.mkdir()
    assert e.job_status(e.ingest_repo(str(empty)))["status"] in ("failed", "completed")
    assert files.absolute_path("/a/./b/../c") == "/a/c"


def test_vocabulary_lookups_and_json(spark):
    from docloom.functions import domains

    rows = spark.createDataFrame([("b", '[{"keyword": "x", "weight": 0.5}]', "[]", 1.4), ("a", "[]", "[]", None), ("bad", "{", "[]", 9.0)], "domain string, keywords string, authority_patterns string, boost_factor double")
    assert domains.load(rows) == [("a", 1.0, {}), ("b", 1.4, {"x": 0.5})]
    assert [r[0] for r in domains.domain_names(rows).collect()] == ["a", "b", "bad"] and domains.vocabulary_of(rows, "b").count() == 1
    assert domains.boost_of(rows, "a") == 1.0 and domains.boost_of(rows, "b") == 1.4 and domains.boost_of(rows, "none") == 1.0


def test_lookups_by_id_and_hits_of_several_deliveries(spark):
    c = spark.createDataFrame([("a", "/f", [1.0, 0.0], T0), ("a", "/f", [1.0, 0.0], T0 + timedelta(days=1)), ("b", "/f", [0.9, 0.1], T0), ("c", "/f", [0.0, 1.0], T0)], "chunk_id string, file_path string, embedding array<float>, created_at timestamp")
    assert retrieval.chunk_by_id(c, "a").collect()[0]["created_at"].day == 2 and retrieval.chunk_by_id(c, "z").count() == 0
    assert [r["chunk_id"] for r in retrieval.knn(c.select("chunk_id", "embedding"), [1.0, 0.0], 2, one_per_id=True).collect()] == ["a", "b"]
    m = spark.createDataFrame([("a", "docs", T0), ("a", "code", T0 + timedelta(days=1))], "chunk_id string, content_type string, created_at timestamp")
    assert retrieval.metadata_of(m, "a").first()["content_type"] == "code"
    from docloom.functions.vectors import top_k

    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [1.0, 0.0, 0.0])], "query_id string, embedding array<float>")
    d = c.select("chunk_id", "embedding").unionByName(spark.createDataFrame([("x", [0.0, 1.0, 0.0])], "chunk_id string, embedding array<float>"))
    assert {(r["query_id"], r["id"]) for r in top_k(d, q, 1).collect()} == {("q1", "a"), ("q2", "x")}


def test_positions_across_spans(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPAN", 4)
    rows = [(f"f:{i}", "f", i, f"t{i}" if i != 8 else None) for i in range(0, 40, 2)] + [("g:0", "g", 0, "x"), ("f:none", "f", None, "n")]
    df = spark.createDataFrame(rows, "chunk_id string, file_path string, chunk_index int, content string")
    at = {r["chunk_id"]: r["position"] for r in retrieval.positioned(df).collect()}
    assert at["f:none"] == 0 and [at[f"f:{i}"] for i in range(0, 40, 2)] == list(range(1, 21)) and at["g:0"] == 0
    want = spark.createDataFrame([("f", 10), ("f", 12), ("f", 11), ("g", 0)], "file_path string, chunk_index int")
    got = sorted((r["target_index"], r["chunk_index"]) for r in retrieval.context_window(df, want, 1).collect())
    assert got == [(0, 0), (10, 8), (10, 10), (10, 12), (12, 10), (12, 12), (12, 14)]
    near = {r["chunk_id"]: r["context"] for r in retrieval.neighbours(df, 1).collect()}
    assert near["f:10"] == "t10\nt12" and near["f:8"] == "t6\nt10" and near["g:0"] == "x" and near["f:0"] == "n\nt0\nt2" and len(near) == 22
