import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import dense, evaluate, lexical, plugins, ranking

CORPUS = [
    ("c1", "planeacion", "Planning the procurement budget and needs assessment."),
    ("c2", "competencia-licitacion", "Tender invitation and bidding competition open to all."),
    ("c3", "adjudicacion", "Awarding the contract to the lowest bidder."),
    ("c4", "ejecucion-contrato", "Contract execution delays and payment milestones."),
    ("c5", "competencia-licitacion", "Bid rigging and collusion among competitors."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id string, family string, text string").cache()


def asks(spark, *queries):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id int, query string")


def test_bm25_scores(spark, corpus):
    want = {0: {"c1": 2.168524}, 1: {"c1": 0.332077, "c3": 0.80825, "c4": 0.355281}, 2: {"c1": 0.460185, "c2": 0.431972, "c3": 0.332077, "c4": 0.847622, "c5": 0.492341}}
    got = lexical.search(asks(spark, "planning budget", "the contract", "contract and and"), corpus, 5).collect()
    assert len(got) == 15
    for r in got:
        assert r["score"] == pytest.approx(want[r["query_id"]].get(r["chunk_id"], 0.0), abs=2e-6)
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == ["c1", "c2", "c3", "c4", "c5"]


def test_bm25_edges(spark, corpus):
    got = lexical.search(asks(spark, "contract", "", None), corpus, 2, family="competencia-licitacion").collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in got) == [(q, c) for q in range(3) for c in ("c2", "c5")]
    assert lexical.search(asks(spark, "x"), corpus, 99).count() == 5 and lexical.search(asks(spark, "x"), corpus.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        lexical.search(asks(spark, "x"), corpus, 0)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(size=(60, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    return spark.createDataFrame([(i, [float(x) for x in v[i]], i % 4) for i in range(60)], "vec_id long, embedding array<double>, label int").repartition(3).cache()


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_both_exact_searches_agree(spark, vectors):
    q = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    a = dense.search(q, vectors, 5)
    assert pairs(a) == pairs(dense.search_expressions(q, vectors, 5))
    best = {r["query_id"]: r["vec_id"] for r in a.where("rank = 1").collect()}
    assert all(best[i] == i for i in range(60) if i != 7) and best[7] == 3  # a tie goes to the lower id
    old, dense.QUERY_BLOCK = dense.QUERY_BLOCK, 7
    try:
        assert pairs(dense.search(q, vectors, 5)) == pairs(a)
    finally:
        dense.QUERY_BLOCK = old


def test_filters_and_ids(spark, vectors):
    q = vectors.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    pre, post = dense.search_filtered(q, vectors, 3, "label", 2), dense.search_filtered(q, vectors, 3, "label", 2, "post", 2)
    assert pre.groupBy("query_id").count().where("count <> 3").count() == 0
    wide = {(a, c) for a, _, c, _ in pairs(dense.search(q, vectors, 6)) if c % 4 == 2}
    got = {(a, c) for a, _, c, _ in pairs(post)}
    assert got <= wide and len(got) == sum(min(3, len([1 for a, _ in wide if a == i])) for i in range(9))
    with pytest.raises(ValueError):
        dense.search_filtered(q, vectors, 3, "label", 2, "both")
    pos = dense.positions(vectors, "vec_id", 100)
    assert sorted(tuple(r) for r in pos.collect()) == [(100 + i, i) for i in range(60)]
    named = dense.resolve(pos, spark.createDataFrame([(100,), (7,)], "pos long"), "vec_id")
    assert {r["pos"]: r["vec_id"] for r in named.collect()} == {100: "0", 7: "UNKNOWN"}


def test_vector_checks(spark, vectors):
    assert dense.validate(vectors) == 16
    for bad in (vectors.limit(0), vectors.select("embedding").union(spark.createDataFrame([([1.0],)], "embedding array<double>"))):
        with pytest.raises(ValueError):
            dense.validate(bad)


def test_inverted_file(spark, vectors):
    q = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index, exact = dense.InvertedFile(vectors, lists=8), dense.search(q, vectors, 5)
    assert index.rows.count() == 60
    assert dense.recall(index.search(q, 5, probes=8), exact).first()["recall"] == 1.0
    assert dense.recall(index.search(q, 5, probes=4), exact).first()["recall"] > 0.6
    with pytest.raises(ValueError):
        dense.InvertedFile(vectors.limit(0))


def ranked(spark, ids, scores=None):
    return spark.createDataFrame([(0, c, i + 1, float((scores or {}).get(c, 0))) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int, score double")


def test_fusion(spark):
    got = ranking.rrf(ranked(spark, ["c1", "c2", "c3"]), ranked(spark, ["c2", "c3", "c4"])).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("c2", 0.032522), ("c3", 0.032002), ("c1", 0.016393), ("c4", 0.015873)]
    w = ranking.weighted(ranked(spark, ["c1", "c2"], {"c1": 10, "c2": 5}), ranked(spark, ["c2", "c3"], {"c2": 0.9, "c3": 0.5})).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in w] == [("c1", 0.5), ("c2", 0.5), ("c3", 0.0)]
    single = ranking.weighted(ranked(spark, ["c1"], {"c1": 3}), ranked(spark, [])).collect()
    assert [r["score"] for r in single] == [0.0]


def test_hybrid(spark, corpus):
    c, q = dense.embed(corpus), dense.embed(asks(spark, "contract payment milestones", "bid rigging"), "query")
    got = ranking.hybrid(q, c, 3).collect()
    assert {r["query_id"]: r["chunk_id"] for r in got if r["rank"] == 1} == {0: "c4", 1: "c5"}
    assert {r["chunk_id"] for r in ranking.hybrid(q, c, 3, family="competencia-licitacion", fusion="weighted").collect()} == {"c2", "c5"}
    assert ranking.hybrid(q, c, 2, legs=("bm25",)).count() == 4
    for bad in ({"fusion": "sum"}, {"legs": ("x",)}, {"legs": ()}):
        with pytest.raises(ValueError):
            ranking.hybrid(q, c, 3, **bad)


@pytest.mark.parametrize(
    "query,want",
    [
        ("What are the risks in the planning phase budget?", ["planeacion"]),
        ("Bid rigging during tender competition", ["competencia-licitacion"]),
        ("Award selection and winner evaluation", ["adjudicacion"]),
        ("contract execution and payment milestones", ["ejecucion-contrato"]),
        ("tender award", ["competencia-licitacion", "adjudicacion"]),
        ("something", []),
        ("Evaluación de adjudicación", []),
    ],
)
def test_route(spark, query, want):
    q = asks(spark, query)
    assert q.select(ranking.route(F.col("query")).alias("r")).first()["r"] == want
    routed = ranking.route_queries(q).first()
    assert routed["by"] == ("keywords" if want else "similarity") and len(routed["families"]) == max(1, len(want))


def test_rerank_really_reorders(spark, corpus):
    c = corpus.withColumn("query_id", F.lit(0)).withColumn("query", F.lit("collusion and bid rigging")).withColumn("rank", F.substring("chunk_id", 2, 1).cast("int"))
    got = ranking.rerank(c, 3).orderBy("new_rank").collect()
    assert got[0]["chunk_id"] == "c5" and [r["chunk_id"] for r in got[1:]] == ["c1", "c2"]
    move = ranking.rerank_movement(c, ranking.rerank(c, 3), 3).first()
    assert (move["new_members"], move["moved"]) == (1, 3)
    assert ranking.rerank(c.limit(0)).count() == 0
    back = ranking.rerank(c, 5, lambda q, t: -F.length(t).cast("double")).orderBy("new_rank").first()
    assert back["chunk_id"] == "c3"


def test_metrics(spark):
    codes = F.array(*[F.lit(x) for x in ("R001", "R003", "R005", "R010", "R012", "R018", "R028")])
    rel, none = F.array(*[F.lit(x) for x in ("R001", "R002", "R005")]), F.array().cast("array<string>")
    cells = [evaluate.recall_at(codes, rel, 3), evaluate.recall_at(codes, rel, 5), evaluate.precision_at(codes, rel, 3), evaluate.precision_at(codes, rel, 5), evaluate.recall_at(codes, none, 3), evaluate.precision_at(codes, rel, 0), evaluate.recall_at(none, rel, 3)]
    assert list(spark.range(1).select(*cells).first()) == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2 / 5, 1.0, 0.0, 0.0])
    means = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (None,)], "grounding_ratio double")
    assert evaluate.mean_grounding(means.limit(3)).first()[0] == pytest.approx(0.6)
    assert evaluate.mean_grounding(means).first()[0] == pytest.approx(0.45) and evaluate.mean_grounding(means.limit(0)).first()[0] == 0.0
    pairs_ = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("", "x"), ("a b c d", "a c d e")], "a string, b string")
    got = [tuple(r) for r in pairs_.select(evaluate.rouge_l("a", "b"), evaluate.bleu("a", "b")).collect()]
    assert got[0] == (1.0, pytest.approx(1.0)) and got[1] == (0.0, 0.0) and got[2][0] == 0.75 and 0 < got[2][1] < 1


def plain_bleu(prediction, reference):
    from collections import Counter
    from math import exp, log

    a, b = (prediction or "").split(), (reference or "").split()
    if not set(a) & set(b):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        total += log((sum((x & y).values()) or 0.1) / max(1, len(a) - n + 1)) / 4
    return (1.0 if len(a) > len(b) else exp(1 - len(b) / len(a))) * exp(total)


def test_bleu_against_plain_python(spark):
    texts = ["the cat sat on the mat", "the the the the", "the cat the cat the cat sat", "a", "", "  ", None, "mat the on sat cat the", "x y z " * 300, "x y " * 500 + "z", "ünï the\tcat\nsat"]
    pairs_ = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in pairs_.select("a", "b", evaluate.bleu("a", "b").alias("s")).collect():
        assert r["s"] == pytest.approx(plain_bleu(r["a"], r["b"])), (r["a"], r["b"])
    kept = [plain_bleu(a, b) for a in texts for b in texts if (b or "").strip()]
    assert tuple(evaluate.mean_bleu(pairs_, "a", "b").first()) == (len(kept), pytest.approx(sum(kept) / len(kept), abs=6e-5))
    assert tuple(evaluate.mean_bleu(pairs_.limit(0), "a", "b").first()) == (0, None)


def test_plugged_models_load_once(spark, corpus, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return 2.0

    enc = plugins.encoder(load, lambda m, texts: [[m * len(t), 1.0] for t in texts], batch_size=2)
    v = dense.embed(corpus.coalesce(1), encoder=enc)
    assert dense.norm_audit(v).first()["mean_norm"] == 1.0 and dense.validate(v) == 2
    c = corpus.withColumn("query_id", F.lit(0)).withColumn("query", F.lit("q")).withColumn("rank", F.substring("chunk_id", 2, 1).cast("int"))
    worst_first = plugins.pair_scorer(load, lambda m, pairs: [-len(t) * m for _, t in pairs])
    assert ranking.rerank(c, 1, worst_first).first()["chunk_id"] == "c3"
    with open(log) as f:
        assert 1 <= len(f.read()) <= 16


def test_payloads(spark, corpus):
    r = dense.payloads(corpus).first()["document"]
    assert r["page_content"] == CORPUS[0][2] and r["metadata"]["chunk_id"] == "c1" and r["metadata"]["page_start"] is None


def test_bm25_paths_agree(spark, corpus):
    """Terms that travel with the tasks and a stored index give the same ranks; so do blocks of queries."""
    q = asks(spark, "planning budget", "the contract", "contract and and", "", None, "unknown words")
    want = [tuple(r) for r in lexical.search(q, corpus, 4).orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in lexical.search(q, corpus, 4, query_bytes=1).orderBy("query_id", "rank").collect()] == want
    old, lexical.ROOM = lexical.ROOM, 6
    try:
        assert [tuple(r) for r in lexical.search(q, corpus, 4).orderBy("query_id", "rank").collect()] == want
    finally:
        lexical.ROOM = old


@pytest.mark.parametrize("arguments", [{"k": 0}, {"k": -1}, {"b": 1.5}, {"k1": -1.0}, {"epsilon": -0.1}, {"text": "nothing"}, {"id": "nothing"}, {"family": "x", "family_column": "nothing"}])
def test_bm25_argument_errors(spark, corpus, arguments):
    with pytest.raises(ValueError):
        lexical.search(asks(spark, "x"), corpus, **arguments)
    with pytest.raises(ValueError):
        lexical.search(spark.range(1), corpus)


def test_more_queries_than_a_block(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(dense.QUERY_BLOCK + 1, 4))
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "query_id int, embedding array<double>")
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v[:50])] + [(99, None)], "vec_id int, embedding array<double>")
    got = dense.search(queries, rows, 3)
    assert got.count() == 3 * len(v) and pairs(dense.search(queries, rows, 3, query_block=10_000)) == pairs(got)
    assert dense.search_expressions(queries, rows.where("vec_id < 99"), 1).count() == len(v)


def test_saved_inverted_file_reads_probed_cells(spark, vectors, tmp_path):
    q = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index = dense.InvertedFile(vectors)
    assert len(index.centroids) == 8  # about the square root of 60
    before = pairs(index.search(q, 5))
    index.save(str(tmp_path / "ivf"))
    assert pairs(index.search(q, 5)) == before and len(list((tmp_path / "ivf").glob("cell=*"))) > 1
    assert dense.recall(index.search(q, 5), dense.search(q, vectors, 5)).first()["recall"] > 0.8


def test_null_and_many_positions(spark):
    ids = spark.createDataFrame([(f"k{i:05}",) for i in range(3000)] + [(None,)], "id string").repartition(6)
    pos = dict((r["id"], r["pos"]) for r in dense.positions(ids, "id").collect())
    assert pos[None] == 0 and [pos[f"k{i:05}"] for i in range(3000)] == list(range(1, 3001))


def test_vector_store_round_trip(spark, corpus, tmp_path):
    from evidara.sources import tables

    store = dense.vector_store(corpus)
    tables.save_index(store, str(tmp_path / "store"), partition_by="family")
    q = asks(spark, "planning budget", "contract delays")
    want = dense.quick_query(q, store, 3).orderBy("query_id", "rank").collect()
    got = dense.quick_query(q, tables.load_index(spark, str(tmp_path / "store")), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["score"], r["document"]["page_content"]) for r in got] == [(r["query_id"], r["rank"], r["score"], r["document"]["page_content"]) for r in want] and len(got) == 6
    one = dense.quick_query(q, store, 5, family=CORPUS[0][1]).select("document.metadata.family").distinct().collect()
    assert [r["family"] for r in one] == [CORPUS[0][1]]
