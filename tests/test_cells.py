import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import dense


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)


def asks(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def groups(rng, n, d, spread):
    v = np.repeat(rng.normal(size=(12, d)), n // 12, axis=0) + spread * rng.normal(size=(n // 12 * 12, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_cells_equal_exact_search(spark, spread, tmp_path):
    rng = np.random.default_rng(5)
    v = groups(rng, 600, 16, spread) * (1 + rng.integers(0, 3, size=(600, 1)))  # several lengths
    corpus = frame(spark, [*v, *([v[0]] * 40), None])
    file = dense.InvertedFile(corpus, lists=12)
    file.save(f"{tmp_path}/cells")
    cells = dense.Cells(file)
    queries = asks(frame(spark, [*v[::10], rng.normal(size=16), np.zeros(16), None]))
    for k in (1, 10):
        assert sorted(cells.search(queries, k).collect()) == sorted(dense.search(queries, corpus, k).collect())
    r = cells.report(cells.chosen(queries, 10)).first()
    assert r["n_queries"] == 62 and r["pairs"] == 62 * 12 and r["skipped"] >= (0.4 * r["pairs"] if spread < 1 else 0)


def test_cells_with_few_rows_and_bad_arguments(spark):
    corpus = frame(spark, np.eye(3))
    cells = dense.Cells(dense.InvertedFile(corpus, lists=3))
    assert sorted(cells.search(asks(corpus), 10).collect()) == sorted(dense.search(asks(corpus), corpus, 10).collect())
    assert cells.search(asks(corpus.limit(0)), 3).count() == 0
    with pytest.raises(ValueError):
        cells.search(asks(corpus), 0)


def test_a_task_keeps_k_rows_a_query(spark):
    """However many blocks of rows or cells it has met; equal scores by id, also across cells and with null ids."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(3000, 4)), 1)
    corpus = frame(spark, v, [None if i % 500 == 3 else i for i in range(3000)])
    queries = asks(frame(spark, v[:10]))
    schema = dense._found_schema(queries, corpus, "vec_id")
    found = dense._paired(queries, corpus, schema, 5, "vec_id", "embedding")
    want = sorted(dense.search_expressions(queries, corpus, 5).collect(), key=repr)
    assert found.count() == 50 and sorted(dense._ranked(found, 5, "vec_id").collect(), key=repr) == want
    file = dense.InvertedFile(corpus, lists=8)
    found = dense._paired(file._assign(queries, 8, "query_id"), file.rows, schema, 5, "vec_id", "embedding", "cell")
    assert found.count() == 50 and sorted(dense._ranked(found, 5, "vec_id").collect(), key=repr) == want
