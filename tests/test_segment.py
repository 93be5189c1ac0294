import pytest
from pyspark.sql import functions as F

from evidara import schemas
from evidara.operators import segment
from evidara.sources import tables
from evidara.streaming import ingest

LINES = "array<struct<text:string,size:double>>"


def page(spark, lines, text=None):
    return spark.createDataFrame([(1, "\n".join(t for t, _ in lines) if text is None else text, lines)], f"page_num int, full_text string, lines {LINES}")


@pytest.mark.parametrize(
    "html,want",
    [
        ("<title>T</title><h1>Big <b>bold</b> x</h1><p class=x>a <i>b</i> c &amp; d<br>e<script>no</script>", [("T", 20.0), ("Big bold x", 24.0), ("a b c & d", 12.0), ("e", 12.0)]),
        ("<p>plain <b>bold</b> end</p>", [("plain bold end", 14.0)]),
        ("<ul><li>one<p>two</p>three</li>four<li>five</ul>", [("one", 10.0), ("two", 12.0), ("three", 10.0), ("four", 12.0), ("five", 10.0)]),
        ("<p><b>open<br><p>next", [("open", 14.0), ("next", 12.0)]),
        ("1 < 2<!-- <p>hidden</p> --><style>p{}</style>", [("1 < 2", 12.0)]),
        ("<p>a\n  b</p><p> </p><div><div>c", [("a b", 12.0), ("c", 12.0)]),
        ("<script>never closed <p>x", []),
        ("<script>" + "\U0001f600x" * 20_000 + "</script><p>" + "\U0001f600x" * 20_000, [("\U0001f600x" * 20_000, 12.0)]),
        ("", []),
        (None, []),
    ],
)
def test_html_lines(spark, html, want):
    got = spark.createDataFrame([(html,)], "h string").select(segment.html_lines(F.col("h"))).first()[0]
    assert [tuple(r) for r in got] == want


def test_html_lines_hold_all_visible_text(spark):
    """Against the standard library's reader, on pages longer than a block of the scan."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.text = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.off:
                self.text.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html is not null").select("html")
    long = spark.createDataFrame([("".join(f"<div><p>Part {i} <b>has</b> <a href=/x>links</a>.</p>tail {i}</div>" for i in range(300)),)], "html string")
    for r in pages.unionByName(long).select("html", segment.html_lines(F.col("html")).alias("lines")).collect():
        reader = Reader()
        reader.feed(r["html"])
        reader.close()
        bare = lambda t: "".join(t.split())
        assert bare("".join(x["text"] for x in r["lines"])) == bare("".join(reader.text))


@pytest.mark.parametrize(
    "lines,want",
    [
        ([("Small text", 10.0), ("Big second", 19.0), ("Big first", 20.0), ("middle one", 17.5)], "Big first Big second"),
        ([("Price gap R012", 20.0)], "Price gap"),
        ([("R012  Price   gap", 20.0)], "Price gap"),
        ([("Definition", 30.0), ("Methodology of things", 22.0)], None),
        ([("Fraud signs", 20.0)], None),
        ([("12345", 20.0), ("abc", 20.0)], None),
        ([], None),
    ],
)
def test_title(spark, lines, want):
    assert page(spark, lines).select(segment.title(F.col("lines"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("Contract award", "contract"), ("The winning side", "award"), ("Short time between", "tender"), ("Planning it", "planning"), ("Nothing", "unknown"), (None, "unknown")])
def test_stage(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(segment.stage(F.col("t"))).first()[0] == want


def test_blocks(spark):
    long = "word " * 10
    text = f"lost {long}\nDefinition\n{long}\nWhy is this a red flag?\n{long}\nMETHODOLOGY:\n{long}\nExample\nshort\nSource\n{long}"
    got = page(spark, [], text).select(segment.blocks(F.col("full_text"))).first()[0]
    assert [b["kind"] for b in got] == ["core", "formula", "core"] and got[0]["text"].startswith("Definition") and "lost" not in got[0]["text"]
    assert [tuple(b) for b in page(spark, [], "no headers at all").select(segment.blocks(F.col("full_text"))).first()[0]] == [("core", "no headers at all")]
    assert [b["kind"] for b in page(spark, [], "Example\nshort").select(segment.blocks(F.col("full_text"))).first()[0]] == ["core"]


def test_sections(spark):
    body = "sentence of the body " * 5
    lines = [("Part One", 18.0), ("Part Two", 18.0), ("x", 18.0), ("123", 20.0)]
    text = f"Part One\n{body}\nPart Two\n{body}\nsee Part One\n{body}"
    got = page(spark, lines, text).select(segment.sections(F.col("full_text"), F.col("lines"))).first()[0]
    assert [s["name"] for s in got] == ["Part One", "Part Two", "Part One"] and all(s["text"].startswith("sentence") for s in got)
    assert page(spark, lines, "tiny").select(segment.sections(F.col("full_text"), F.col("lines"))).first()[0] == []
    one = page(spark, [("Only (one) + \\E head", 18.0)], body).select(segment.sections(F.col("full_text"), F.col("lines"))).first()[0]
    assert [s["name"] for s in one] == ["Only (one) + \\E head"]
    assert [s["name"] for s in page(spark, [], body).select(segment.sections(F.col("full_text"), F.col("lines"))).first()[0]] == ["General"]
    near = page(spark, [("Alpha beta", 18.0), ("beta", 18.0)], "Alpha beta " + body).select(segment.sections(F.col("full_text"), F.col("lines"))).first()[0]
    assert [s["name"] for s in near] == ["Alpha beta"]


def test_units_and_reports(spark):
    body = "words of a definition that are long enough " * 2
    indicator = f"Price gap R012\nDefinition\n{body}\nWhy is this a red flag\n{body}\nMethodology\n{body}"
    rows = [(3, indicator, [("Contract price gap", 20.0)]), (4, "Method page " + body * 2, [("Method page", 16.0)]), (5, "short", [])]
    pages = spark.createDataFrame(rows, f"page_num int, full_text string, lines {LINES}")
    u = segment.load_pages(pages, "f.pdf")
    assert u.columns == schemas.UNITS.names
    got = sorted(u.collect(), key=lambda r: (r["page_start"], r["block_type"]))
    assert [(r["page_start"], r["block_type"], r["family"], r["stage"], r["indicator_code"]) for r in got] == [(3, "core", "ejecucion/contrato", "contract", "R012"), (3, "formula", "ejecucion/contrato", "contract", "R012"), (4, "section", "metodologia", None, None)]
    assert got[0]["parent_doc_id"] is None and got[1]["parent_doc_id"] == got[0]["doc_id"] and got[2]["doc_id"].startswith("ocp_meta_p004_")
    report = segment.quality_report(u).first()
    assert (report["total_units"], report["indicator_units"], report["methodology_units"], report["criteria_passed"]) == (3, 2, 1, False)
    assert report["missing_families"] == "adjudicacion,competencia/licitacion,planeacion"
    assert segment.violations(u).count() == 0 and segment.orphan_parents(u).count() == 0
    bad = u.withColumn("text", F.lit("12\nHeader\npage 3")).withColumn("family", F.lit("x")).withColumn("parent_doc_id", F.lit("gone"))
    assert {r["problem"] for r in segment.violations(bad).collect()} == {"family", "page_number_first"}
    assert segment.orphan_parents(bad).count() == 3
    assert {r["problem"] for r in segment.violations(u.withColumn("text", F.lit("Header:\nPage 3"))).collect()} == {"layout_labels_only"}


def test_jsonl_and_index(spark, tmp_path):
    path = str(tmp_path / "u.jsonl")
    with open(path, "w") as f:
        f.write('{"query": "a", "relevant_indicator_codes": ["R1"]}\n\n{"query": "b"}\n')
    got = tables.read_jsonl(spark, path, schemas.GOLD).collect()
    assert [(r["query"], r["relevant_families"]) for r in got] == [("a", None), ("b", None)]
    v = spark.createDataFrame([(1, [1.0], "x"), (2, [0.5], "y")], "vec_id long, embedding array<double>, family string")
    tables.save_index(v, str(tmp_path / "i"), "family")
    assert tables.load_index(spark, str(tmp_path / "i")).where("family = 'x'").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_index(spark, str(tmp_path / "none"))
    tables.write_jsonl(v, str(tmp_path / "out"))
    tables.write_report(v, str(tmp_path / "r.md"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and "| vec_id |" in (tmp_path / "r.md").read_text()


def test_pdf_pages_through_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    parse = lambda raw: [{"full_text": p, "lines": [{"text": p, "size": 20.0}]} for p in raw.decode().split("|")]
    got = tables.read_pdf_pages(spark, str(tmp_path / "a.pdf"), parse).orderBy("page_num").collect()
    assert [(r["source_file"], r["page_num"], r["full_text"], r["lines"][0]["size"]) for r in got] == [("a.pdf", 1, "one", 20.0), ("a.pdf", 2, "two", 20.0)]


def test_streamed_chunks_equal_batch(spark, tmp_path):
    from evidara.operators.chunk import chunk_units

    units = spark.createDataFrame([(f"d{i}", "some words here " * (20 * i)) for i in range(1, 6)], "doc_id string, text string")
    units.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        ingest.stream_chunks(ingest.stream_units(spark, str(tmp_path / "in"), units.schema), str(tmp_path / "out"), str(tmp_path / "cp"), 128, 32).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["chunk_id"] for r in got.collect()) == sorted(r["chunk_id"] for r in chunk_units(units, 128, 32).collect())


def test_scan_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("README.md", "docs/a.md", "docs/b.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    got = tables.scan_files(spark, str(tmp_path), ["*.md", "docs/*.md", "none/*", "docs/*"])
    assert sorted((r["pattern"], r["path"], r["text"]) for r in got.collect()) == [(0, "README.md", "text of README.md"), (1, "docs/a.md", "text of docs/a.md"), (3, "docs/b.txt", "text of docs/b.txt")]
    assert tables.scan_files(spark, str(tmp_path), ["none/*"]).count() == 0


def test_pages_are_cut_once(spark):
    """The explosion of units brings no filter that repeats the work on the page."""
    pages = spark.createDataFrame([(1, "<html><body><h1>Title of a page</h1><p>" + "some text " * 20 + "</p></body></html>")], "page_id long, html string")
    plan = segment.indicator_units(segment.pages_from_html(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(" not in plan
