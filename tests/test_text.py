import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.functions import text as tx
from evidara.operators import ground


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("1. Uno (R014, p.26-26). Requiere revisión humana.\n2. Dos; tres", ["1.", "Uno (R014, p.26-26).", "Requiere revisión humana.", "2.", "Dos;", "tres"]),
        ("", []),
        (None, []),
        ("  a!\n\n\n b?  c ", ["a!", "b?", "c"]),
        ("p.18-18", ["p.18-18"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, tx.sentences) == want


def test_tokens_are_unicode(spark):
    assert one(spark, "Iechä schön año_1 el", tx.tokens) == ["iechä", "schön", "año_1", "el"]
    assert one(spark, "Iechä schön año_1 el EL iechÄ", tx.tokens3) == ["iechä", "schön", "año_1"]
    assert one(spark, None, tx.tokens) == [] and one(spark, None, tx.tokens3) == []


def test_clean_text(spark):
    assert one(spark, "12\nTitle\n 13 \nbody\t \tx\n\n\n\nend ", tx.clean_text) == "Title\nbody x\n\nend"
    assert one(spark, "  a  ", tx.strip) == "a"


def test_ids_and_overlap(spark):
    assert one(spark, "hola", tx.md5_12) == "4d186321c1a7"
    row = spark.sql("select array('a','b','c') as a, array('c','a') as b, cast(array() as array<string>) as e")
    assert row.select(tx.lexical_overlap(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2 / 3)
    assert row.select(tx.lexical_overlap(F.col("e"), F.col("b"))).first()[0] == 0.0


def test_hash_embedding_has_unit_norm(spark):
    df = spark.createDataFrame([("some words here",), ("",), (None,)], "t string").select(tx.norm(tx.hash_embedding(F.col("t"))).alias("n"))
    assert [round(r["n"], 9) for r in df.collect()] == [1.0, 0.0, 0.0]


def test_fused_dot_rounds_each_step_once(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=64).tolist(), (rng.normal(size=64) * (rng.random(64) < 0.7)).tolist()) for _ in range(200)]
    rows += [([1 / 3, 2 / 3, 1e-9, 5.0], [3.0, -1.5, 1e9, 0.0]), ([], [])]
    want = []
    for a, b in rows:
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s = math.fma(x, y, s)
        want.append(s)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>")
    assert [r[1] for r in sorted(df.select("i", tx.fused_dot(F.col("a"), F.col("b"))).collect())] == want


def test_grounding_ties_fall_as_in_sql(spark):
    """Counts whose likeness is the same in exact arithmetic: only the rounding of the steps tells them apart."""
    rng = np.random.default_rng(2)
    counts = [[rng.integers(0, 3, 64).astype(float) for _ in range(2)] for _ in range(300)]
    unit = [[(v / math.sqrt(v @ v)).tolist() for v in pair] for pair in counts]
    con = duckdb.connect()
    want = [con.execute("SELECT list_inner_product(?::DOUBLE[], ?::DOUBLE[])", pair).fetchall()[0][0] for pair in unit]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(unit)], "i int, a array<double>, b array<double>")
    got = [r[1] for r in sorted(df.select("i", ground._score("embedding", None)[1](F.col("a"), F.col("b"))).collect())]
    assert got == want
