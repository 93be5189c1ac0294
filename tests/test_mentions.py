import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import mentions as m


def plain(texts, names):
    return sorted({(s, d) for s, t in texts for d in names if d and t is not None and d in t}, key=repr)


def found(spark, texts, names):
    t = spark.createDataFrame(texts, "src string, text string").repartition(3)
    return sorted((tuple(r) for r in m.mentions(t, spark.createDataFrame([(d,) for d in names], "dst string")).collect()), key=repr)


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_mentions_against_substring_test(spark, step, monkeypatch):
    monkeypatch.setattr(m, "STEP", step)
    rng = random.Random(step)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    names = [word("ab", n) for n in (1, 2, 3, 4, 7, 12)] + [word("abc/", n) for n in (14, 15, 16, 25, 60)] + ["é", "ñé", "日本語/テスト.md", "docs/plan.md", "docs/plan.md.bak", "", None, "never/there/at/all.md"]
    real = [n for n in names if n]
    texts = [(f"s{i}", word("abc/ ", rng.randrange(0, 80)) + rng.choice(real) + word("ab ", rng.randrange(0, 30))) for i in range(60)]
    texts += [("s1", "see docs/plan.md"), ("s1", "see docs/plan.md"), ("none", None), ("empty", ""), (None, "names docs/plan.md here"), ("long", word("ab", 5000) + names[9] + word("ab", 5000))]
    texts += [(f"c{i}", "the same text names docs/plan.md") for i in range(40)]
    got = found(spark, texts, names)
    assert got == plain(texts, names) and len(got) > 100


def test_empty_sides(spark):
    assert found(spark, [("a", "text")], []) == [] and found(spark, [], ["a"]) == [] and found(spark, [("a", None)], ["a"]) == []


def test_every_name_shares_its_grams_with_texts_that_hold_it():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 9, 14, 15, 40):
        name = bytes(rng.integers(97, 101, n).tolist())
        text = bytes(rng.integers(97, 101, 500).tolist()) + name + bytes(rng.integers(97, 101, 500).tolist())
        own = m.grams(name, *m.CLASSES[m.class_of(n)])
        assert len(own) and set(own.tolist()) <= set(m.grams(text, *m.CLASSES[m.class_of(n)]).tolist())
    assert len(m.grams(text, 8, 8)) < 0.4 * len(text)  # minimizers thin out the grams


def test_no_nested_loop(spark):
    """A million names stay in a table that texts meet by keys."""
    names = spark.range(1_000_000).select(F.concat(F.lit("path/of/some/file-"), F.sha1(F.col("id").cast("string"))).alias("dst"))
    texts = spark.range(200).select(F.col("id").cast("string").alias("src"), F.concat(F.lit("names path/of/some/file-"), F.sha1(F.col("id").cast("string")), F.lit(" and more")).alias("text"))
    out = m.mentions(texts, names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 200
