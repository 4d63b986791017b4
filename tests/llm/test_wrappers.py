from docloom.llm import wrappers as W


def reads(w, page):
    return W._read(w, page, 0) == len(page)


def test_slots_groups_and_options():
    a = "<html><b>Books of</b><i>John</i><ul><li>One</li><li>Two</li></ul></html>"
    b = "<html><b>Books of</b><i>Mary</i><img/><ul><li>A</li><li>B</li><li>C</li></ul></html>"
    w = W.align(W.tokens(a), W.tokens(b))
    assert W.show(w) == "<html> <b> =Books of </b> <i> #TEXT </i> (<img>)? <ul> (<li> #TEXT </li>)+ </ul> </html>"
    assert reads(w, W.tokens(a)) and reads(w, W.tokens(b))
    c = "<html><b>Books of</b><i>X</i><ul><li>A</li></ul></html>"
    w = W.align(w, W.tokens(c))
    assert all(reads(w, W.tokens(x)) for x in (a, b, c))
    assert W.show(W.align(W.tokens(a), W.tokens(a))) == " ".join(W.tokens(a))


def test_infer(spark, monkeypatch):
    rows = [("h", "<p>a</p>"), ("h", "<p>b</p>"), ("g", "plain"), (None, "<p>x</p>"), ("n", None), ("o", "<p>" * 5000), ("h", "<b>other</b>")]
    df = spark.createDataFrame(rows, "host string, content string")
    got = {(r["host"], r["tags"]): (r["pages"], W.show(W.loaded(r["wrapper"]))) for r in W.infer(df).collect()}
    assert got["h", "</p> <p>"] == (2, "<p> #TEXT </p>") and got["h", "</b> <b>"] == (1, "<b> =other </b>") and set(got) == {("h", "</p> <p>"), ("h", "</b> <b>"), ("o", "<p>")}
    assert got["o", "<p>"] == (1, " ".join(["<p>"] * 5000))  # whole pages, however long
    assert W.infer(df.limit(0)).count() == 0


def test_a_class_dealt_out_to_tasks_has_one_wrapper(spark, monkeypatch):
    rows = [("h", f"<h1>t{i}</h1><ul>" + "".join(f"<li>x{i}{j}</li>" for j in range(i % 4 + 1)) + "</ul>", f"c{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "host string, content string, chunk_id string")
    monkeypatch.setattr(W, "PART", 5)
    got = W.infer(df).collect()
    assert len(got) == 1 and got[0]["pages"] == 40
    w = W.loaded(got[0]["wrapper"])
    assert all(reads(w, W.tokens(t)) for _, t, _ in rows)
    found = sorted(map(tuple, W.elements(df).collect()))
    assert found == sorted([(c, "heading", 1) for *_, c in rows] + [(f"c{i}", "list_item", j + 1) for i in range(40) for j in range(i % 4 + 1)])
    assert W.elements(df.where("chunk_id = 'c1'")).count() == 0 and W.elements(df.limit(0)).count() == 0
