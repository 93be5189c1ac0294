import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import dense, proximity
from evidara.sources import store


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def unit(rng, n, d=32):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def asks(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def report(spark, index, queries, corpus, k=10, ef=proximity.EF):
    return proximity.walk_report(index.walks(queries, k, ef), dense.search(queries, corpus, k), k).first()


def test_graph_is_one_piece_with_links_of_a_bounded_number():
    rng = np.random.default_rng(0)
    far = np.concatenate([rng.normal(size=(80, 8)) + 50 * i for i in range(5)])  # five islands
    links = proximity.linked(far, np.arange(len(far)), 8)
    both = {i: list(x) for i, x in links.items()}
    for i, x in links.items():
        for j in x:
            both[j].append(i)
    assert len(proximity.pieces(both)) == 1 and all(i not in x for i, x in links.items())
    assert max(len(x) for x in links.values()) <= 2 * 8 + 5
    near = proximity.nearest(far, np.arange(len(far)), 3)
    for i in range(0, len(far), 37):
        d = ((far - far[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert near[i].tolist() == np.argsort(d, kind="stable")[:3].tolist()
    levels = proximity.built(unit(rng, 900), 8)
    assert {len(x) for x in levels} >= {1, 2} and min(len(x) for x in levels) == 1
    assert proximity.built(far[:1], 8) == [[[]]] or len(proximity.built(far[:1], 8)) == 1


@pytest.mark.parametrize("shard_rows", [5000, 300])
def test_recall_of_indexed_and_of_foreign_queries(spark, shard_rows, tmp_path):
    rng = np.random.default_rng(1)
    corpus = frame(spark, unit(rng, 1200))
    index = proximity.GraphIndex.build(corpus, m=16, shard_rows=shard_rows).save(f"{tmp_path}/index")
    assert index.rows.select("shard").distinct().count() == (1 if shard_rows == 5000 else 4)
    own = report(spark, index, asks(corpus), corpus)
    foreign = report(spark, index, asks(frame(spark, unit(rng, 60))), corpus)
    assert own["recall"] >= 0.97 and foreign["recall"] >= 0.93 and own["n"] == 12_000
    again = proximity.GraphIndex.load(spark, f"{tmp_path}/index")
    assert sorted(again.search(asks(corpus), 3).collect()) == sorted(index.search(asks(corpus), 3).collect())


def test_few_vectors_are_scored(spark):
    rng = np.random.default_rng(2)
    centres = unit(rng, 20)
    v = np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(2000, 32))
    corpus = frame(spark, v / np.linalg.norm(v, axis=1, keepdims=True))
    r = report(spark, proximity.GraphIndex.build(corpus, m=16), asks(corpus), corpus, ef=20)
    assert r["recall"] >= 0.95 and r["mean_scored"] <= 400


def test_walk_as_wide_as_the_graph_is_exact(spark):
    rng = np.random.default_rng(3)
    v = [*unit(rng, 150), *([unit(rng, 1)[0]] * 60)]  # and a group of copies
    corpus = frame(spark, v)
    index = proximity.GraphIndex.build(corpus, m=4)
    assert index.rows.count() == 151
    got = index.search(asks(corpus), 5, ef=1000)
    assert sorted(got.collect()) == sorted(dense.search(asks(corpus), corpus, 5).select(got.columns).collect())


def test_graph_hard_cases(spark):
    rng = np.random.default_rng(4)
    v = unit(rng, 6)
    corpus = frame(spark, [*v, None, v[0], v[0]], [0, 1, 2, 3, 4, 5, 6, None, 0]).select("*", F.lit("x").alias("node"), F.lit("y").alias("links"))
    queries = frame(spark, [v[0], None], [7, 8])
    got = proximity.GraphIndex.build(corpus).search(asks(queries), 4).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got[:3]] == [(7, 0), (7, 0), (7, None)] and len(got) == 4
    empty = proximity.GraphIndex.build(corpus.limit(0))
    assert empty.search(asks(queries), 4).count() == 0
    assert proximity.GraphIndex.build(corpus).search(asks(queries.limit(0)), 4).count() == 0
    for bad in ({"m": 1}, {"shard_rows": 0}):
        with pytest.raises(ValueError):
            proximity.GraphIndex.build(corpus, **bad)
    with pytest.raises(ValueError):
        empty.search(asks(queries), 0)


def test_stamp_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    a = store.stamp(spark.read.parquet(path))
    assert a == store.stamp(spark.read.parquet(path).where("id > 3"))
    spark.range(11).write.mode("append").parquet(path)
    assert a != store.stamp(spark.read.parquet(path))
    assert store.exists(spark, path) and not store.exists(spark, path + "no")
    assert sorted(store.stored(spark.range(3)).collect()) == sorted(spark.range(3).collect())


def test_an_indexed_query_ends_at_its_own_node(spark):
    """The nearest of an expanded node that encloses the query's best are exact, so nothing else is scored."""
    rng = np.random.default_rng(7)
    v = unit(rng, 3000, 64)
    corpus = frame(spark, v)
    r = report(spark, proximity.GraphIndex.build(corpus), asks(corpus), corpus, ef=10)
    assert r["recall"] >= 0.95 and r["mean_scored"] <= 300
    whole = proximity.radii(v[:20], 32)
    assert np.isinf(whole).all()
    d = np.sort(np.linalg.norm(v - v[5], axis=1))
    assert abs(proximity.radii(v, 32)[5] - d[32]) < 1e-9


def test_an_indexed_query_scores_few_vectors_however_many_shards(spark):
    """Its node is linked to its nearest of all shards; copies are one node; strangers and wide questions walk."""
    rng = np.random.default_rng(8)
    v = [*unit(rng, 1500, 24), *([unit(rng, 1, 24)[0]] * 40)]
    corpus = frame(spark, v)
    index = proximity.GraphIndex.build(corpus, m=16, shard_rows=200)
    assert index.rows.count() == 1501 and index.rows.select("shard").distinct().count() == 8
    r = report(spark, index, asks(corpus), corpus)
    assert r["recall"] == 1.0 and r["mean_scored"] == 17
    strangers = asks(frame(spark, unit(rng, 20, 24)))
    assert report(spark, index, strangers, corpus)["mean_scored"] > 17
    assert index.walks(asks(corpus).limit(3), 20, 32).count() == 3 * 8  # more than the links hold
    linear = proximity.GraphIndex.build(corpus, m=16, shard_rows=200, across_shards=False)
    assert linear.walks(asks(corpus).limit(3), 5).count() == 3 * 8


def test_ties_at_the_last_link_are_walked(spark):
    """Where rows as far as the last link may tie with the best, links alone don't settle the answer."""
    corpus = frame(spark, np.eye(60))  # all as far from each other
    index = proximity.GraphIndex.build(corpus, m=4, shard_rows=20)
    shards = index.rows.select("shard").distinct().count()
    assert index.walks(asks(corpus), 5, ef=10).count() == 60 * shards
    best = index.search(asks(corpus), 1, ef=10).collect()
    assert len(best) == 60 and all(r["vec_id"] == r["query_id"] and r["score"] == 1.0 for r in best)


def test_best_rows_by_single_precision_are_exact():
    rng = np.random.default_rng(9)
    rows = np.round(rng.normal(size=(9001, 6)), 1)  # many ties
    odd = rows.copy()
    odd[7, 2], odd[4000, 0] = np.nan, np.nan
    for queries, corpus in ((rows[:700], rows), (rows[:5] * 1e-9, rows), (rows[:5] * 1e200, rows * 1e100), (rows[:9], odd), (rows[:40], rows[:12])):
        best = dense._Best(len(queries), 10, len(corpus))
        half = len(corpus) // 2
        for part in (slice(0, half), slice(half, None)):
            best.meet(queries, corpus[part], np.arange(len(corpus))[part])
        for i in range(0, len(queries), 7):
            scores = np.round(corpus @ queries[i], 6)
            known = np.flatnonzero(~np.isnan(scores))
            want = known[np.lexsort((known, -scores[known]))][:10]
            assert best.place[i].tolist() == want.tolist()
