import pytest
from pyspark.sql import functions as F

from evidara.operators import answer, evaluate, graph, ground
from evidara.plans import analyze as plans
from evidara.plans import catalog

CHUNKS = [
    ("c1", "P001", 10, 12, "Budget issues in procurement planning lead to risks. The budget allocation was irregular."),
    ("c2", "T005", 25, 26, "Single bidder in tender process indicates low competition and possible collusion."),
    ("c3", "E010", 40, 42, "Contract execution delays and payment milestones indicate implementation risks."),
    ("c4", "A003", 30, 31, "Award selection criteria should be transparent. Lowest price not always best value."),
    ("c5", "T002", 20, 21, "Bid rigging is a red flag. Collusion among bidders detected through price patterns."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, indicator_code string, page_start int, page_end int, text string").withColumn("indicator_name", F.concat(F.lit("Name "), "indicator_code")).cache()


def answers(spark, chunks, *texts):
    cands = chunks.withColumn("rank", F.substring("chunk_id", 2, 1).cast("int"))
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, answer string")
    return q.join(answer.gather(q.select("query_id").crossJoin(cands)), "query_id", "left")


@pytest.mark.parametrize(
    "sentence,best,score",
    [
        ("Budget procurement planning had irregularities.", "c1", 0.6),
        ("Contract execution delays are a problem.", "c3", 0.6),
        ("Budget allocation problems in procurement processes.", "c1", 0.6),
        ("Completely unrelated quantum physics discussion here.", None, 0.0),
        ("1.", None, 0.0),
    ],
)
def test_grounding(spark, chunks, sentence, best, score):
    r = ground.verify(answers(spark, chunks, sentence)).first()
    assert (r["best_chunk_id"], r["best_score"], r["supported"]) == (best, score, score >= 0.25)


def test_ratios_refusal_and_citations(spark, chunks):
    a = answers(spark, chunks, "Budget procurement planning had irregularities. Unrelated text.", "Unrelated text.", "")
    v = ground.verify(a)
    r = {x["query_id"]: x for x in ground.ratios(v, a).collect()}
    assert (r[0]["grounding_ratio"], r[0]["passed"], r[0]["refusal"]) == (0.5, True, "")
    assert r[1]["refusal"] == answer.REFUSAL and r[2]["n_sentences"] == 0 and r[2]["grounding_ratio"] == 0.0
    c = ground.citations(v, chunks).collect()
    assert [(x["chunk_id"], x["indicator_code"], x["page_start"]) for x in c] == [("c1", "P001", 10)]
    loose = ground.citations(ground.verify(a, threshold=0.0), chunks).where("query_id = 1").first()
    assert loose["chunk_id"] is None and loose["indicator_code"] is None  # nothing overlaps, yet zero passes
    assert evaluate.grounding_summary(ground.ratios(v, a)).first()["n_refused"] == 2
    with pytest.raises(ValueError):
        ground.verify(a, method="vibes")
    assert ground.verify(a, method="embedding").count() == 3


def test_template_answer_has_sixteen_sentences(spark, chunks):
    a = answers(spark, chunks, "q").withColumn("answer", answer.template_answer(F.col("candidates")))
    text = a.first()["answer"]
    assert text.startswith(answer.TEMPLATE_HEAD + "\n\n1. Señal de riesgo potencial: Name P001 (P001, p.10-12). Requiere revisión humana.\n2. ")
    assert ground.verify(a).count() == 16 and a.select(answer.is_safe(F.col("answer"))).first()[0]
    none = spark.sql(f"select cast(array() as {answer.CANDIDATE}) as c, cast(null as {answer.CANDIDATE}) as n")
    assert none.select(answer.template_answer(F.col("c"))).first()[0] == none.select(answer.template_answer(F.col("n"))).first()[0] == answer.REFUSAL


def test_placeholders(spark):
    c = spark.createDataFrame([(0, 1, "c", None, "", None, None, "t")], "query_id int, rank int, chunk_id string, indicator_name string, indicator_code string, page_start int, page_end int, text string")
    g = answer.gather(c)
    assert g.select(answer.context(F.col("candidates"))).first()[0] == "[Fuente: Desconocida (N/A, p.?-?)] t"
    assert "None (, p.?-?)" in g.select(answer.template_answer(F.col("candidates"))).first()[0]
    p = g.select(answer.prompt(F.lit("Q"), F.col("candidates"))).first()[0]
    assert p.startswith('Fragmento a evaluar:\n"""\nQ\n"""') and p.endswith("FORMATO obligatorio.")


def test_analyze_and_plugged_model(spark, chunks):
    q = spark.createDataFrame([(0, "collusion among bidders"), (1, "payment delays")], "query_id int, query string")
    r = plans.analyze(q, chunks, legs=("bm25",))
    assert r["ratios"].count() == 2 and r["answers"].where("size(candidates) = 5").count() == 2
    out = plans.analyze(q, chunks, legs=("bm25",), generate=lambda df: answer.generate(df, lambda prompt, system: "Collusion among bidders detected." if "collusion" in prompt[:60] else "Nope."))
    assert {x["query_id"]: x["n_supported"] for x in out["ratios"].collect()} == {0: 1, 1: 0}
    assert [x["chunk_id"] for x in out["citations"].collect()] == ["c5"]
    with pytest.raises(ValueError):
        plans.analyze(q, chunks, grounding_method="x")


def test_chat(spark, chunks):
    a = answers(spark, chunks, "Budget procurement planning had irregularities.")
    v = ground.citations(ground.verify(a), chunks)
    cites = v.groupBy("query_id").agg(F.collect_list(F.struct("indicator_code", "indicator_name", "page_start", "sentence")).alias("c"))
    text = cites.select(answer.chat_text(F.lit("A"), F.lit(0.5), F.lit(""), F.col("c"))).first()[0]
    assert "0.50" in text and "1. P001 - Name P001 | pag. 10" in text and "Aviso" not in text
    assert [r[0] for r in spark.createDataFrame([("short",), ("x" * 20,), (None,)], "m string").select(answer.is_askable(F.col("m"))).collect()] == [False, True, False]


def test_graph(spark):
    files = spark.createDataFrame([("docs/a.md", "# A\nsee docs/b.md and [[c]]"), ("docs/b.md", "[[docs/b.md]] [[nowhere]]"), ("specs/c.md", ""), ("x.py", "# no")], "path string, text string")
    want = [("docs/a.md", "docs/b.md"), ("docs/a.md", "specs/c.md"), ("docs/b.md", "docs/b.md")]
    e = graph.edges(files)
    assert sorted(tuple(r) for r in e.collect()) == want
    assert sorted(tuple(r) for r in graph.edges(files, r"[\w/]+\.md").collect()) == want
    assert [r["path"] for r in graph.orphans(files, e).collect()] == ["x.py"]
    assert [tuple(r) for r in files.select(graph.kind_of(F.col("path")), graph.title_of(F.col("path"), F.col("text"))).collect()] == [("doc", "A"), ("doc", "docs/b.md"), ("spec", "specs/c.md"), ("root", "x.py")]
    assert "graph LR" in graph.mermaid(e)
    twice = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "pattern int, path string")
    assert sorted(tuple(r) for r in graph.first_hits(twice).collect()) == [(1, "a"), (3, "b")]


def test_ready_tasks(spark):
    rows = [("a", 0, "done", [], "x"), ("b", 1, "todo", ["a"], "x"), ("c", 2, "todo", ["b"], "x"), ("d", 3, "todo", ["zzz"], "y"), ("e", 4, "todo", [], "y")]
    t = spark.createDataFrame(rows, "id string, pos int, status string, depends_on array<string>, owner_cli string")
    assert [r["id"] for r in graph.ready_tasks(t).orderBy("pos").collect()] == ["b", "e"]
    assert [r["id"] for r in graph.ready_tasks(t, "y").collect()] == ["e"]


def test_references_of_every_page_of_a_host_count(spark, tmp_path):
    rows = [(1, "http://a.org/1", "nothing"), (2, "http://a.org/2", "see b.org"), (3, "http://b.org/", "own b.org"), (4, "http://c.org/1", ""), (5, "http://c.org/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalog.ref_graph_edges(spark, str(tmp_path)).collect()] == [("a.org", "b.org")]
    assert [r["path"] for r in catalog.ref_graph_orphans(spark, str(tmp_path)).collect()] == ["c.org"]


def test_all_edges_and_rows_are_written(spark, tmp_path):
    """More of them than any former limit."""
    import json

    from evidara.sources import tables

    links = spark.range(5001).selectExpr("concat('a', id) as src", "concat('b', id) as dst")
    assert graph.mermaid(links).count("-->") == 5001
    files = spark.createDataFrame([("docs/a.md", "# Alpha\nsee b1"), ("b1", "x"), ("lonely", None)], "path string, text string")
    got = json.loads(graph.graph_json(files, graph.edges(files)))
    assert got["counts"] == {"nodes": 3, "edges": 1, "orphans": 1} and got["edges"] == [{"source": "docs/a.md", "target": "b1"}]
    assert {"id": "docs/a.md", "kind": "doc", "title": "Alpha"} in got["nodes"]
    rows = spark.range(1001).selectExpr("id", "'a|b' as t")
    tables.write_report(rows, str(tmp_path / "r.md"))
    assert len((tmp_path / "r.md").read_text().splitlines()) == 4 + 1001
    tables.write_json_report(rows, str(tmp_path / "r.json"), title="t")
    found = json.loads((tmp_path / "r.json").read_text())
    assert found["title"] == "t" and found["n_rows"] == len(found["rows"]) == 1001


def test_mentions_of_short_and_nested_paths(spark):
    files = spark.createDataFrame([("www.a.com", "to b.org and sub.b.org, c.net/x"), ("b.org", "self b.org, www.a.com"), ("sub.b.org", ""), ("c.net", None), ("", "b.org")], "path string, text string")
    found = lambda **k: sorted(tuple(r) for r in graph.edges(files, **k).collect())
    assert found() == [("", "b.org"), ("b.org", "www.a.com"), ("www.a.com", "b.org"), ("www.a.com", "c.net"), ("www.a.com", "sub.b.org")]


def test_gold_takes_whole_items(spark, tmp_path):
    from evidara.plans import catalog

    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    docs = [(1, f"x {item}."), (2, item[:70]), (3, "so" + item + "s"), (4, "has one two inside"), (5, None), (6, item.replace("sigma", "SIGMA"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, "one two"), (9, "nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["query_id"]: r["relevant"] for r in catalog.gold(spark, str(tmp_path)).collect()} == {7: [1, 3], 8: [4], 9: []}
