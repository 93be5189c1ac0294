import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidara.operators import inverted, lexical
from evidara.operators.inverted import InvertedIndex


def texts(n, seed):
    """Zipf-like words, so that some are frequent and most are rare."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, int(rng.integers(1, 60))), 3000)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i if i % 97 else None, ("a", "b", None)[i % 3], t) for i, t in enumerate(texts(700, 1))]
    rows += [(5000, "a", None), (5001, "b", ""), (5002, "a", "same words here"), (5002, "a", "same words here"), (5003, None, "same words here")]
    return spark.createDataFrame(rows, "chunk_id long, family string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    queries = ["w1 w2 w3", "w1 w1 w17", "w2999 w1500", "same here", "", None, "nothing of this", " ".join(texts(1, 9)), "w1", "w40 w41 w42 w43 w44"]
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 20, "DOCS_AT_ONCE": 10, "BLOCK": 4, "WINDOW": 8, "BLOCKS_A_BATCH": 5}, {"SHARD_TOKENS": 900, "QUERIES": 3, "QUERY_WEIGHTS": 4, "WORDS": 100, "DOCS_AT_ONCE": 3}])
def test_index_equals_search_over_texts(spark, corpus, asked, limits, monkeypatch, tmp_path):
    for name, value in limits.items():
        monkeypatch.setattr(inverted, name, value)
    index = InvertedIndex.build(corpus, f"{tmp_path}/index", facet="family")
    assert index.shards.count() >= (20 if "SHARD_DOCS" in limits else 3)
    for k in (1, 7, 1000):
        assert rows_of(index.search(asked, k)) == rows_of(lexical.search(asked, corpus, k))
    assert rows_of(index.search(asked, 5, "b")) == rows_of(lexical.search(asked, corpus, 5, family="b"))
    other = InvertedIndex(spark, f"{tmp_path}/index", k1=0.9, b=0.3, epsilon=0.1)
    assert rows_of(other.search(asked, 6)) == rows_of(lexical.search(asked, corpus, 6, k1=0.9, b=0.3, epsilon=0.1))


def test_windows_below_the_kth_score_are_skipped(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(inverted, "WINDOW", 8)
    monkeypatch.setattr(inverted, "BLOCK", 4)
    index = InvertedIndex.build(corpus.coalesce(1), f"{tmp_path}/index")
    rare = spark.createDataFrame([(0, "w2999 w1500 w700"), (1, "w300 w301")], "query_id int, query string")
    r = index.walks(rare, 3).agg(F.sum("met").alias("met"), F.sum("windows").alias("windows")).first()
    assert r["met"] < 0.3 * r["windows"]
    assert rows_of(index.search(rare, 3)) == rows_of(lexical.search(rare, corpus, 3))


def test_search_reads_no_text(spark, corpus, asked, tmp_path):
    corpus.write.parquet(f"{tmp_path}/corpus")
    index = InvertedIndex.build(spark.read.parquet(f"{tmp_path}/corpus"), f"{tmp_path}/index", facet="family")
    read = index.search(asked, 5).inputFiles()
    assert read and not any("/corpus/" in f for f in read)
    plan = index.walks(asked, 5)._jdf.queryExecution().toString()
    assert "bucket" in plan and "text" not in [c for c in index.postings.columns + index.docs.columns]


def test_negative_weights_are_exact(spark, tmp_path):
    """Two documents that share all words: the mean idf is negative."""
    tiny = spark.createDataFrame([(1, "x y"), (2, "x y y"), (3, "x")], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "x y"), (1, "z")], "query_id int, query string")
    index = InvertedIndex.build(tiny, f"{tmp_path}/index")
    assert index.about["mean_raw"] < 0
    assert rows_of(index.search(q, 2)) == rows_of(lexical.search(q, tiny, 2)) == rows_of(lexical.search(q, tiny, 2, query_bytes=0))


def test_empty_corpus_and_arguments(spark, corpus, asked, tmp_path):
    index = InvertedIndex.build(corpus.limit(0), f"{tmp_path}/index")
    assert index.search(asked, 3).count() == 0
    assert InvertedIndex.build(corpus.select("*", F.lit(1).alias("pos"), F.lit(2).alias("term")), f"{tmp_path}/odd").search(asked.limit(0), 3).count() == 0
    for bad in ({"b": 2.0}, {"k1": -1.0}, {"epsilon": -1.0}):
        with pytest.raises(ValueError):
            InvertedIndex(spark, f"{tmp_path}/index", **bad)
    with pytest.raises(ValueError):
        index.search(asked, 0)


def test_a_full_shard_takes_little_memory():
    """Four open shards, one of them being written, and a block's dense weights fit well into a task's share of 1 GB."""
    rng = np.random.default_rng(3)
    schema = pa.schema([("shard", pa.int64()), ("facet", pa.string()), ("id", pa.int64()), ("pos", pa.int32()), ("length", pa.int32()), ("term", pa.string()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs", "lengths")), ("most_tf", pa.int32()), ("least_length", pa.int32())])
    words = [f"w{i}" for i in range(50_000)]
    tracemalloc.start()
    shard, n = inverted.Shard("a"), 0
    while not shard.full():
        shard.add(list(range(n, n + 64)), np.full(64, 400), np.minimum(rng.zipf(1.3, 25_600), 49_999).astype(np.int32))
        n += 64
    held = sum(x for b in shard.rows(1, words, schema) for x in b.column("length").to_pylist() if x is not None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == 400 * n and peak < 200 << 20 and 3 * 8 * inverted.SHARD_TOKENS <= 64 << 20
    assert 8 * inverted.QUERIES * inverted.QUERY_WEIGHTS <= 64 << 20


SHARDS = pa.schema([("shard", pa.int64()), ("facet", pa.string()), ("id", pa.int64()), ("pos", pa.int32()), ("length", pa.int32()), ("term", pa.string()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs", "lengths")), ("most_tf", pa.int32()), ("least_length", pa.int32())])


def batch(first, facets, words):
    ids = range(first, first + len(facets))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(facets, pa.string()), pa.array(words, pa.list_(pa.string()))], ["id", "facet", "toks"])


def test_a_task_holds_no_vocabulary_of_all_its_words():
    """A task's memory doesn't grow with the different words that it has met: 800,000 of them, none twice."""

    def batches():
        for i in range(0, 2_000, 100):
            yield batch(i, ["a"] * 100, [[f"word{400 * d + j}" for j in range(400)] for d in range(i, i + 100)])

    tracemalloc.start()
    found = set()
    for b in inverted.shards(batches(), 0, SHARDS):
        found.update(zip(b.column("shard").to_pylist(), b.column("pos").drop_null().to_pylist(), strict=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2_000 and peak < 50 << 20


def test_open_shards_are_bounded_whatever_the_number_of_facets(monkeypatch):
    monkeypatch.setattr(inverted, "OPEN_BYTES", 1 << 20)
    rng, most, live = np.random.default_rng(5), 0, {}
    add, rows = inverted.Shard.add, inverted.Shard.rows

    def added(self, *given):
        nonlocal most
        add(self, *given)
        live[id(self)] = self
        most = max(most, sum(s.bytes for s in live.values()))

    def written(self, *given):
        live.pop(id(self))
        return rows(self, *given)

    monkeypatch.setattr(inverted.Shard, "add", added)
    monkeypatch.setattr(inverted.Shard, "rows", written)
    texts_ = [[f"w{x}" for x in np.minimum(rng.zipf(1.4, 50), 500)] for _ in range(3_000)]
    facets = [None if i % 1_000 == 0 else f"f{i % 1_000}" for i in range(3_000)]
    made = list(inverted.shards((batch(i, facets[i : i + 500], texts_[i : i + 500]) for i in range(0, 3_000, 500)), 7, SHARDS))
    assert not live and most < 1.1 * (1 << 20)
    names, counts = {}, {}
    for b in made:
        for r in b.to_pylist():
            if r["term"] is None:
                names[r["shard"], r["pos"]] = r["id"]
                assert facets[r["id"]] == r["facet"] and r["length"] == 50
    for b in made:
        for r in b.to_pylist():
            for d, tf, n in zip(r["docs"] or [], r["tfs"] or [], r["lengths"] or [], strict=True):
                counts[names[r["shard"], d], r["term"]] = tf
                assert n == 50 and tf <= r["most_tf"] and r["least_length"] == 50
    assert sorted(names.values()) == list(range(3_000))
    assert counts == {(i, w): t.count(w) for i, t in enumerate(texts_) for w in set(t)}


def test_long_documents_are_looked_at_by_their_tokens(monkeypatch):
    monkeypatch.setattr(inverted, "TOKENS_AT_ONCE", 100)
    lists = pa.array([["x"] * n for n in (10, 90, 250, 0, 5, 60, 60)] + [None], pa.list_(pa.string()))
    found = [(f, rows, n.tolist(), len(t)) for f, rows, n, t in inverted.pieces(lists, ["a"] * 8)]
    assert [r for _, rows, _, _ in found for r in rows] == list(range(8)) and all(sum(n) == t for _, _, n, t in found)
    assert max(t for *_, t in found) == 250 and [t for *_, t in found if t > 200] == [250]


def test_a_shard_is_written_some_terms_at_a_time():
    """Besides its tokens, 8 MB, and their places, 16 MB, a full shard takes little while it is written."""
    rng = np.random.default_rng(4)
    words = pa.array([f"w{i}" for i in range(50_000)])
    shard, n = inverted.Shard("a"), 0
    while not shard.full():
        shard.add(list(range(n, n + 64)), np.full(64, 400), rng.integers(0, 50_000, 25_600).astype(np.int32))
        n += 64
    tracemalloc.start()
    pairs = sum(len(x) for b in shard.rows(1, words, SHARDS) for x in b.column("docs").drop_null())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 1_900_000 and peak < 45 << 20


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_postings_are_the_same_however_many_at_once(at_once, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 4)
    rng = np.random.default_rng(6)
    lengths, words = rng.integers(0, 30, 50), [f"w{i}" for i in range(40)]
    texts_ = [np.minimum(rng.zipf(1.5, x), 39).astype(np.int32) for x in lengths]

    def written(limit):
        monkeypatch.setattr(inverted, "PAIRS_AT_ONCE", limit)
        shard = inverted.Shard("a")
        for i in range(0, 50, 5):
            shard.add(list(range(100 - i, 95 - i, -1)), lengths[i : i + 5], np.concatenate(texts_[i : i + 5]))
        return [r for b in shard.rows(1, words, SHARDS) for r in b.to_pylist()]

    rows = written(at_once)
    assert rows == written(1 << 40) and [r["id"] for r in rows[:50]] == list(range(51, 101))
    counts = {(r["term"], d): tf for r in rows[50:] for d, tf in zip(r["docs"], r["tfs"], strict=True)}
    assert counts == {(words[w], 49 - i): int((t == w).sum()) for i, t in enumerate(texts_) for w in set(t.tolist())}


def test_the_build_gets_small_batches(spark, monkeypatch, tmp_path):
    """60 MB of tokens come in batches near BATCH_BYTES, and the session's own limit holds again afterwards."""

    def measured(batches, number, schema):
        for b in batches:
            if b.nbytes > 2 * (8 << 20):
                raise ValueError(f"a batch of {b.nbytes >> 20} MB")
            yield from ()

    monkeypatch.setattr(inverted, "shards", measured)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3_000, numPartitions=1).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("several "), 2_000).alias("text"))
    assert InvertedIndex.build(docs, f"{tmp_path}/index").about["n_docs"] == 0
    assert spark.conf.get(name) == before


def impact(tf, length):
    return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 400))


def blocks_of(n, words, width, seed):
    """A shard of ``n`` documents of ``width`` tokens, as a search task gets it."""
    rng, shard = np.random.default_rng(seed), inverted.Shard("a")
    for i in range(0, n, 64):
        shard.add(list(range(i, i + 64)), np.full(64, width), rng.integers(0, words, 64 * width).astype(np.int32))
    rows = [b for b in shard.rows(1, [f"w{i}" for i in range(words)], SHARDS) if not b.column("term").null_count]
    return pa.Table.from_batches(rows, SHARDS)


def full_block():
    """QUERIES queries with QUERY_WEIGHTS terms, none twice."""
    per = inverted.QUERY_WEIGHTS // inverted.QUERIES
    return [{"q": q, "term": f"w{i}", "w": 1.0 + i % 7} for q in range(inverted.QUERIES) for i in range(per * q, per * (q + 1))]


def peak_of(blocks, asked, n, k):
    tracemalloc.start()
    found = inverted.Searcher(blocks, asked, n, impact).search(k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, found


def test_a_search_of_a_full_shard_copies_little():
    """Weights (64 MB), bounds (5 MB) and postings (32 MB) of a full shard and block, and one more copy of the weights at most."""
    n = inverted.SHARD_TOKENS // 400 // 64 * 64
    blocks = blocks_of(n, inverted.QUERY_WEIGHTS, 400, 8)
    peak, (score, place, met) = peak_of(blocks, full_block(), n, 60)
    assert peak < 200 << 20 and met.min() > 0 and (place < n).all() and (np.diff(score) <= 0).all()


def test_a_search_holds_no_terms_that_the_shard_lacks():
    n, words, k = 640, 100, 9
    peak, (score, place, _) = peak_of(blocks_of(n, words, 20, 9), full_block(), n, k)
    assert peak < 16 << 20
    rng, scores = np.random.default_rng(9), np.zeros((inverted.QUERIES, n))
    tokens = np.concatenate([rng.integers(0, words, 64 * 20).reshape(64, 20) for _ in range(0, n, 64)])
    for x in full_block()[:words]:
        tf = (tokens == int(x["term"][1:])).sum(axis=1)
        scores[x["q"]] += np.where(tf, x["w"] * impact(tf, 20), 0.0)
    scores = np.round(scores, 6)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    assert (place == best).all() and np.allclose(score, np.take_along_axis(scores, best, 1), rtol=0, atol=2e-6)
