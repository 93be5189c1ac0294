import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidara.operators import chunk

SENTENCE = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor end. "


def brute(text, size, overlap):
    out, start = [], 0
    if not text:
        return out
    if len(text) <= size:
        return [(0, len(text))]
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text[start:end].rfind(" ")
            if space > 0 and space > size * 0.5:
                end = start + space
        out.append((start, min(end, len(text))))
        start = max(end - overlap, start + 1)
    return out


def spans(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [[tuple(s) for s in r["s"]] for r in df.select("i", chunk.spans(F.col("t"), size, overlap).alias("s")).orderBy("i").collect()]


def test_no_space_text(spark):
    got = spans(spark, ["x" * 1100, "x" * 1900, "x" * 2000], 1024, 128)
    assert got == [[(0, 1024), (896, 1100)], [(0, 1024), (896, 1900), (1792, 1900)], [(0, 1024), (896, 1920), (1792, 2000)]]


@pytest.mark.parametrize("size,overlap", [(512, 64), (1024, 128), (256, 64), (128, 32), (10, 9), (1, 0)])
def test_spans_match_the_rule(spark, size, overlap):
    texts = [SENTENCE * 20, "Texto corto.", "", None, "a b " * 300, " " * 700, "ünï " * 150, "\U0001f600 x" * 90]
    assert spans(spark, texts, size, overlap) == [brute(t, size, overlap) for t in texts]


@pytest.mark.parametrize("size,overlap", [(512, 64), (2048, 256), (40_000, 10), (100, 99)])
def test_long_texts_over_many_blocks(spark, size, overlap):
    """Windows across the blocks that the fold looks at, with characters of several bytes and code units there."""
    least = 5_000 if size == 100 else 120_000
    texts = [(piece * (least // len(piece) + 1))[: least + i] for i, piece in enumerate(["word ", "\U0001f600\U0001f600 x", "ünï\n", "z", SENTENCE])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", chunk.pieces(F.col("t"), size, overlap).alias("s")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert [tuple(x) for x in r["s"]] == [(a, b, t[a:b]) for a, b in brute(t, size, overlap)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=80), min_size=10, max_size=30), st.integers(1, 30), st.data())
def test_random_spans(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    assert spans(spark, texts, size, overlap) == [brute(t, size, overlap) for t in texts]


def test_chunks_inherit_and_are_unique(spark):
    u = spark.createDataFrame([("t1", SENTENCE * 20, "planeacion", 3), ("t2", "Texto corto.", "x", 4), ("t3", "", "y", 5)], "doc_id string, text string, family string, page_start int")
    got = chunk.chunk_units(u, 128, 32).collect()
    assert len({r["chunk_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} == {"t1", "t2"}
    for r in got:
        assert r["family"] == ("planeacion" if r["doc_id"] == "t1" else "x") and len(r["text"]) == r["n_chars"] <= 128
    assert sorted(r["chunk_index"] for r in got if r["doc_id"] == "t1") == list(range(sum(r["doc_id"] == "t1" for r in got)))


@pytest.mark.parametrize("size,overlap", [(0, 0), (100, 100), (100, -1)])
def test_bad_parameters(size, overlap):
    with pytest.raises(ValueError):
        chunk.check_parameters(size, overlap)


def test_tails_and_overlap(spark):
    u = spark.createDataFrame([("a", "x" * 1900), ("b", SENTENCE * 20)], "doc_id string, text string")
    assert [tuple(r) for r in chunk.contained_tails(u, 1024, 128).collect()] == [("a", 2)]
    assert chunk.chunk_units(u, 1024, 128, drop_contained_tail=True).where("doc_id = 'a'").count() == 2
    assert {r["overlap"] for r in chunk.overlaps(chunk.chunk_units(u.where("doc_id = 'a'"), 1024, 128)).collect()} == {1004, 108}
    report = chunk.compare_configs(u.union(spark.createDataFrame([("c", "")], "doc_id string, text string"))).where("label = 'medium'").first()
    assert report["total_chunks"] == 5 and report["fragmented_units"] == 2 and report["fragmentation_pct"] == 66.7


def test_real_overlap_is_linear_and_exact(spark):
    """The longest suffix that is a prefix, on texts that repeat themselves and beyond the basic plane."""
    import random
    import time

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\U0001f600é") for _ in range(n))
    pairs = [("", "x"), ("x", ""), ("abc", "abc"), ("aab", "baa"), ("ab" * 50, "ab" * 70), ("x" + "abcdefgh" * 30, "abcdefgh" * 40), ("a" * 20 + "b", "a" * 20), ("a" * 300, "a" * 200), ("\U0001f600é", "é\U0001f600")]
    for _ in range(60):
        shared = word(rng.randrange(0, 12))
        pairs.append((word(rng.randrange(0, 30)) + shared, shared + word(rng.randrange(0, 30))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", chunk.real_overlap(F.col("a"), F.col("b")).alias("n")).collect():
        a, b = pairs[r["i"]]
        assert r["n"] == max(n for n in range(min(len(a), len(b)) + 1) if n == 0 or a[-n:] == b[:n])

    def seconds(n):
        one = spark.createDataFrame([("a" * (n - 1) + "b", "a" * n)], "a string, b string").select(chunk.real_overlap(F.col("a"), F.col("b")).alias("n"))
        start = time.perf_counter()
        assert one.first()["n"] == 0
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.5)


def test_texts_are_cut_once(spark):
    """No inferred filter that repeats the cutting, and a report in one pass without a shuffle of chunks."""
    units = spark.createDataFrame([(1, "a b " * 400), (2, ""), (3, None)], "doc_id int, text string")
    plan = chunk.chunk_units(units, 512, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(" not in plan
    plan = chunk.compare_configs(units)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Window" not in plan
    empty = chunk.compare_configs(units.limit(0)).collect()
    assert len(empty) == 3 and all(r["total_chunks"] == 0 and r["avg_real_overlap"] == 0 and r["max_chunk_len"] == 0 for r in empty)
