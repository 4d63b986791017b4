import pytest
from pyspark.sql import functions as F

from docloom.functions import classify as K
from docloom.functions import domains as D
from docloom.functions import enhance as E
from docloom.functions import text as X
from docloom.functions.chunking import chunk, fixed_segments
from docloom.functions.vectors import cosine, l2, top_k
from docloom.schemas import ChunkingConfig


def one(spark, col, **vals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in vals.items()]) if vals else spark.range(1)
    return row.select(col.alias("r")).first()["r"]


def py_pieces(text, size):
    out, i = [], 0
    while i < len(text):
        s = text[i : i + size]
        if len(s) > 0.8 * size:
            dot = max(s.rfind(c) for c in ".!?")
            if dot > 0.5 * size:
                s = s[: dot + 1]
            elif s.rfind(" ") > 0.3 * size:
                s = s[: s.rfind(" ")]
        out.append(s)
        i += len(s)
    return out


@pytest.mark.parametrize("text", ["", "a", "x" * 799, "x" * 800, "x" * 801, "x" * 1800, "word " * 700, ("Sentence one. " * 90) + "tail", "é" * 1001, "a" * 500 + "." + "b" * 600, " " * 1500])
def test_fixed_segments(spark, text):
    assert one(spark, fixed_segments(F.col("c"), 1000), c=text) == py_pieces(text, 1000)


def test_chunks_cover_with_overlap(spark):
    text = "".join(f"w{i} " for i in range(900))
    df = spark.createDataFrame([("/a.md", text), ("/null.md", None), ("/empty.md", ""), ("/one.md", "x")], "file_path string, content string")
    rows = chunk(df).orderBy("file_path", "chunk_index").collect()
    a = [r for r in rows if r["file_path"] == "/a.md"]
    joined = " ".join(py_pieces(text, 1000))
    assert len(a) == -(-len(joined) // 800) and a[0]["chunk_id"] == "/a.md:0"
    assert all(joined[r["chunk_offset"] : r["chunk_offset"] + 1000] == r["content"] for r in a)
    assert [r["file_path"] for r in rows if r["file_path"] != "/a.md"] == ["/one.md"]
    step_one = chunk(spark.createDataFrame([("/b", "abcde")], "file_path string, content string"), ChunkingConfig(2, 5)).count()
    assert step_one == 7  # "ab cd e", one character a step


def test_query_terms(spark):
    q = 'Find "Exact Phrase" now NOW x "" "open end'
    assert one(spark, X.query_terms(F.col("q")), q=q) == ["find", "exact phrase", "now", '"open', "end"]
    assert one(spark, X.word_terms(F.col("q")), q="für a b-c de") == ["de"]


def test_occurrences_are_whole_words(spark):
    assert one(spark, X.occurrences(F.col("a"), F.col("b")), a="cat Cat concat cat. c.t", b="cat") == 3
    assert one(spark, X.occurrences(F.col("a"), F.col("b")), a="c.t cat", b="c.t") == 1


def test_comment_stripping(spark):
    assert one(spark, X.strip_code_comments(F.col("c")), c="#!x\na // b\n/* c\nd */e\n#include\nhttps://y") == "x\na \ne\n\nhttps:"
    assert one(spark, X.strip_markup_comments(F.col("c")), c="<!-- <!-- a --> b -->c") == " b -->c"
    assert one(spark, X.embedding_text(F.col("c")), c="﻿ a \n\t b ") == "a b"
    assert len(one(spark, X.embedding_text(F.col("c")), c="x" * 2001)) == 2000


def test_json(spark):
    assert one(spark, X.pretty_json(F.col("c")), c='{"a":{"b":1},"c":[{"d":2}]}').startswith('{\n  "a"')
    assert one(spark, X.json_key_paths(F.col("c")), c='{"a":{"b":1},"c":[{"d":2}]}') == ["a", "a.b", "c"]
    assert one(spark, X.pretty_json(F.col("c")), c="{no") == "{no" and one(spark, X.json_key_paths(F.col("c")), c="{no") is None


def test_names(spark):
    assert one(spark, X.repo_name(F.col("u")), u="https://dev.azure.com/o/p/_git/r") == "o_p_r"
    assert one(spark, X.repo_name(F.col("u")), u="https://github.com/o/r.git") == "o_r"
    assert one(spark, X.safe_filename(F.col("u")), u="__a b//c__.md_") == "a_b_c_.md"
    assert one(spark, X.extension(F.col("u")), u="/x.y/.env") == "" and one(spark, X.extension(F.col("u")), u="/x/a.TS") == "ts"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]
    assert [round(r[0], 6) for r in df.select(l2(F.col("a"), F.col("b"))).collect()] == [1.414214, 1.0, 0.0]
    with pytest.raises(Exception, match="two sizes"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_top_k_ties_nulls_and_empty(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None), (10, [float("nan"), 1.0]), (11, [1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = top_k(v, q, 3, "l2", id="id", vector="v").orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2]
    assert top_k(v, q.limit(0), 3, id="id", vector="v").count() == 0 and top_k(v.limit(0), q, 3, id="id", vector="v").count() == 0


def test_language_and_type(spark):
    rows = [("function a() { const b = 1; }\nimport x from 'y';\nrequire('z')", "js"), ("def a():\n  import os\nfrom a import b", "py"), ("plain words", "html"), ("package a\nfunc b() {}\nimport (", "go"), (None, "md"), ("key: 1", "yaml")]
    df = spark.createDataFrame([(f"/f.{e}", c, e) for c, e in rows], "file_path string, content string, file_extension string")
    got = {r["file_extension"]: r for r in K.classify(df).collect()}
    assert got["js"]["language"] == "javascript" and got["py"]["language"] == "python" and got["go"]["language"] == "go"
    assert got["html"]["content_type"] == "mixed" and got["html"]["language"] == "unknown" and got["html"]["confidence"] == 0.5
    assert got["md"]["content_type"] == "docs" and got["md"]["semantic_density"] == 0 and got["yaml"]["language"] == "yaml"
    assert all(0 <= r["quality_score"] <= 1 and 0 <= r["authority_score"] <= 1 for r in got.values())


def test_indent(spark):
    assert one(spark, K.indent_consistent(F.col("c")), c="  a\n    b") is True
    assert one(spark, K.indent_consistent(F.col("c")), c=" " * 9 + "a\n" + " " * 18 + "b") is False
    assert one(spark, K.indent_consistent(F.col("c")), c="a\nb") is True


def test_sections_and_header(spark):
    s = one(spark, E.sections(F.col("c")), c="text\nimport a\nlet b\nkey = 1\n\nmore")
    assert [(x["kind"], x["content"]) for x in s] == [("docs", "text\n"), ("code", "import a\nlet b\n"), ("config", "key = 1\n"), ("docs", "\nmore\n")]
    h = one(spark, E.context_header(F.col("p"), F.lit("docs"), F.lit("natural"), F.lit("md")), p="/a/b/c/d.md")
    assert h == "[Context: File: d.md | Location: b/c | Type: docs (natural) | Format: md]\n\n"
    assert one(spark, E.universal(F.col("c")), c="a\r\nb  \n\n\n\n\nâ€™") == "a\nb\n\n\n'"


def test_domains(spark):
    df = spark.createDataFrame([("/app/package.json", 'import x from "express"', "javascript"), ("/x", "", None), (None, None, None)], "file_path string, content string, language string")
    rows = D.tag(df).collect()
    assert rows[0]["domain_tags"][:2] == ["javascript", "web-frameworks"] or set(rows[0]["domain_tags"][:2]) == {"javascript", "web-frameworks"}
    assert rows[1]["domain_tags"] == [] and rows[2]["domain_tags"] == []
    q = D.query_intent(spark.createDataFrame([("sql query on a database",), ("zzz",), (None,)], "query string")).collect()
    assert q[0]["detected_domains"][0]["domain"] == "databases" and q[1]["intent_confidence"] == 0.5 and q[2]["detected_domains"] == []
    seed = D.seed(spark)
    assert [d for d, _, _ in D.load(seed)] == sorted(["javascript", "web-frameworks", "python", "databases"])
