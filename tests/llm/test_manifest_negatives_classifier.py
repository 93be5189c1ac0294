"""The manifest, hard-negative mining and the quality classifier against plain versions and hard rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import hard_negatives, merkle, quality_classifier
from evidara.llm.common import table
from evidara.llm.queries import queries


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(leaves, fanout):
    """Root and each leaf's proof."""
    at, proofs, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        for i, j in enumerate(at):
            run = nodes[j // fanout * fanout : j // fanout * fanout + fanout]
            proofs[i].append(("".join(run[: j % fanout]), "".join(run[j % fanout + 1 :])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [j // fanout for j in at]
    return nodes[0], proofs


def plain_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, lang, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = own, *plain_tree([plain_leaf(r) for r in own], fanout)
    root, above = plain_tree([trees[g][1] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        own, subroot, proofs = trees[g]
        out += [(r[0], g, plain_leaf(r), subroot, root, p + up) for r, p in zip(own, proofs, strict=True)]
    return out


ORDER = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 12), (3, 2)])
def test_manifest_against_plain_version(spark, docs, fanout, levels):
    more = spark.createDataFrame([(100 + i, f"text {i % 7}", "xx" if i % 3 else "en", "a", i) for i in range(40)], docs.schema)
    df = docs.unionByName(more)
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in merkle.manifest(df, fanout=fanout, levels=levels).collect()]
    want = plain_manifest([tuple(r[c] for c in ORDER) for r in df.collect()], fanout)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_groups_and_one_leaf_groups(spark):
    rows = [(i, f"t{i}", f"lang{i % 50:02d}" if i < 70 else None, None, i) for i in range(73)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in merkle.manifest(df, levels=2).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest([(a, s, g, n, t) for a, t, g, s, n in rows]), key=repr)


def test_single_row_and_empty_table(spark, empty_docs):
    one = spark.createDataFrame([(None, None, None, None, None)], empty_docs.schema)
    r = merkle.manifest(one).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == sha("-----") and r["proof"] == []
    assert merkle.manifest(empty_docs).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(one, fanout=1)


def test_manifest_query_finds_what_was_changed(spark, docs, odd_docs, small, tmp_path):
    for i, df in enumerate((docs, odd_docs)):
        df.drop("path").write.parquet(f"{tmp_path}/{i}/documents.parquet")
    got = [queries()["op11_merkle_manifest"](spark, f"{tmp_path}/{i}") for i in range(2)]
    assert rows_of(got[0], *got[0].columns) == rows_of(got[1], *got[0].columns)
    plain = {(a, leaf): (sub, root, p) for a, _, leaf, sub, root, p in plain_manifest([tuple(r[c] for c in ORDER) for r in table(spark, small, "documents").collect()])}
    n = {r["doc_id"]: r for r in table(spark, small, "documents").collect()}
    found = queries()["op11_merkle_manifest"](spark, small).collect()
    assert len(found) == len(n)
    for r in found:
        sub, root, proof = plain[r["doc_id"], r["leaf"]]
        assert (r["subroot"], r["root"], r["proof_sha256"]) == (sub, root, sha("".join(a + b for a, b in proof)))
        bad = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and n[r["doc_id"]]["n_chars"] is not None
        node = plain_leaf(tuple(n[r["doc_id"]][c] + (bad and c == "n_chars") if c == "n_chars" and n[r["doc_id"]][c] is not None else n[r["doc_id"]][c] for c in ORDER))
        for before, after in proof:
            node = sha(before + node + after)
        assert r["folded_root"] == node and r["verified"] == (not bad) == (node == root)
    assert 0 < sum(not r["verified"] for r in found) < len(found)


def test_no_task_collapses_more_than_a_superblock(spark):
    """A group of 3,000 equal rows is reduced in blocks of 64."""
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    rows = merkle.numbered(df.select(F.lit("sen").alias("g"), merkle.leaf_of([F.col("text")]).alias("digest")), ["digest"])
    assert sorted(r["idx"] for r in rows.collect()) == list(range(3000))
    assert rows.groupBy("g", merkle._block(2, 6)).count().agg(F.max("count")).first()[0] == 64
    assert merkle.collapse(rows, 2, 6).count() == 47
    got = merkle.manifest(df, levels=6).select("root", F.size("proof").alias("n")).distinct().collect()
    want = plain_manifest([(1, "a", "en", 4, "same")] * 3000)
    assert [(r["root"], r["n"]) for r in got] == [(want[0][4], 12)]


# --- hard negatives


def plain_negatives(rows, n_positives=5, n_negatives=10):
    use = []
    for i, (vec_id, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    rank = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, a, label, v in use:
        if a is None or a % 100:
            continue
        pos = rank([(dot(v, w), b) for j, b, other, w in use if other == label and j != i])[:n_positives]
        neg = rank([(dot(v, w), b) for j, b, other, w in use if other != label])
        for p, b in pos:
            out += [(a, b, r + 1, c, p, s) for r, (s, c) in enumerate([x for x in neg if 30 * p <= 100 * x[0] <= 90 * p][:n_negatives])]
    return out


SHAPE = "vec_id long, embedding array<float>, label int"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def shifted():
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def vectors(seed, n=400, d=6):
    """Several norms, a group of copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = (rng.normal(size=d) * rng.choice([0.1, 0.5, 1, 3])).astype(np.float32).tolist()
        rows.append((i * 25, int(rng.integers(0, 3)), v))
    same = [0.5] * d
    rows += [(20_000 + i, i % 4, same) for i in range(60)]  # one vector, several labels
    rows += [(30_000, 1, same), (30_000, 1, same), (None, 2, same), (None, 1, [0.1] * d), (30_100, None, same), (30_200, 1, None)]
    rows += [(30_300, 1, [math.nan] * d), (30_400, 1, [math.inf] + [0.0] * (d - 1)), (30_500, 1, [None] + [0.0] * (d - 1)), (30_600, 2, [0.0] * d), (30_700, 2, []), (30_800, 2, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("BLOCK", 20), ("FEW", 100), ("BUCKET", 16), ("CHUNK", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1)
    df = spark.createDataFrame([(a, v, b) for a, b, v in rows], SHAPE).repartition(3)
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=shifted()), *RESULT)
    assert got == sorted(plain_negatives([(a, b, v) for a, b, v in rows]), key=repr) and len(got) > 500


def test_query_on_the_small_table(spark, small):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, small, "embeddings").collect()]
    assert rows_of(queries()["op12_hard_negatives"](spark, small), *RESULT) == sorted(plain_negatives(rows), key=repr)


def test_negatives_of_empty_tables_and_odd_columns(spark):
    odd = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.8, 0.0], 2)], SHAPE).select("*", *[F.lit("x").alias(c) for c in ("id", "row", "cell", "kind", "square", "vector", "positives", "_label", "score")])
    assert rows_of(hard_negatives.mine(odd, F.col("vec_id") % 100 == 0), *RESULT) == [(0, 1, 1, 2, 65536, 52224)]
    assert hard_negatives.mine(odd.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(odd, F.col("vec_id") == 77).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(odd, F.lit(True), n_negatives=0)


def test_large_components_are_exact(spark):
    """Scores beyond 2**53, where sums of doubles would be wrong."""
    rows = [(0, 1, [1e6 + 1 / 256, 3.0]), (1, 1, [1e6 + 5 / 256, 3.0]), (2, 2, [8e5 + 7 / 256, 1.0]), (3, 2, [8e5 + 3 / 256, 1.0])]
    df = spark.createDataFrame([(a, v, b) for a, b, v in rows], "vec_id long, embedding array<double>, label int")
    assert rows_of(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=shifted()), *RESULT) == sorted(plain_negatives(rows), key=repr)
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e12], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True))


def test_short_buckets_are_skipped(spark):
    """Candidates whose norm can't reach the window are never scored."""
    import pyarrow as pa

    def batch(n, length):
        return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([2] * n), pa.array([length**2 * 65536.0] * n), pa.array([[length, 0.0]] * n)], ["row", "id", "label", "square", "vector"])

    anchor = pa.table({"row": [99], "id": [99], "label": [1], "square": [65536.0], "vector": [[1.0, 0.0]], "positives": [[{"score": 60_000, "id": 5}]]})
    state = hard_negatives.Anchors([anchor], 10, 256, False)
    every = state.wanted(2)
    assert len(state.active(every, 256 * 0.2)) == 0 and len(state.active(every, 256 * 0.3)) == 1  # the window's lower limit
    state.meet(every, batch(12, 0.7))
    assert len(state.active(every, 256 * 0.5)) == 0 and len(state.active(every, 256 * 0.7)) == 1  # the running tenth score
    found = pa.Table.from_batches(list(state.found())).to_pylist()
    assert [r["id"] for r in found] == list(range(10)) and {r["score"] for r in found} == {256 * 179}


def test_one_label_and_one_vector_for_a_third_of_rows(spark, monkeypatch):
    """Copies of one vector fall into all stripes: no task gets them all."""
    monkeypatch.setattr(hard_negatives, "FEW", 50)
    rows = [(i, 1 if i % 3 else i % 10, [0.5, 0.25] if i % 3 else [float(i % 17) / 16, 0.5]) for i in range(600)]
    df = spark.createDataFrame([(a, v, b) for a, b, v in rows], SHAPE)
    assert rows_of(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=shifted()), *RESULT) == sorted(plain_negatives(rows), key=repr)


# --- quality classifier


def plain_statistics(t):
    t = t or ""
    w = t.encode().split()
    n, letters = max(1, len(w)), max(1, sum(c not in " \t\n\v\f\r" for c in t))
    count = lambda items: {x: items.count(x) for x in set(items)}
    windows = count(list(zip(w, w[1:], w[2:], strict=False)))
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    rate = lambda x, whole: math.log(x / whole + 0.01)
    basic = [c for c in t if ord(c) < 0xFFFF]
    raw = t.encode()
    shares = [k / len(raw) for k in count(list(raw)).values()]
    return [
        round(1024 * v)
        for v in (
            math.log(1 + len(w)),
            math.log(1 + letters / n),
            math.log((len(set(w)) + 1) / (len(w) + 1)),
            rate(sum(c in "#*$%&|<>" for c in t), n),
            rate(sum(c.isupper() for c in basic), letters),
            rate(sum(c.isdigit() for c in basic), letters),
            rate(sum(c in ".,;:?" for c in t), n),
            rate(t.count("!"), n),
            rate(max(0, letters - sum(c.isalpha() for c in basic)), letters),
            rate(sum(k for k in windows.values() if k > 1), n),
            rate(len(lines) - len(set(lines)), max(1, len(lines))),
            rate(max(count(w).values(), default=0), n),
            -sum(s * math.log2(s) for s in shares),
            math.log(1 + len(w) / max(1, len(lines))),
        )
    ]


def test_statistics_against_plain_version(docs):
    texts = [r["text"] for r in docs.collect() if len(r["text"] or "") < 30_000]
    for t in [*texts, "A a! A a! A a! \U0001f600 1 2", "\n\n", "x"]:
        assert np.abs(np.array(quality_classifier.statistics(t)) - plain_statistics(t)).max() <= 1  # the logarithms' last digits


def plain_posterior(train, good, x, weight=30, ridge=0.01):
    """Densities by inverse and determinant, not by Cholesky factors."""
    centre, spread = train.mean(axis=0), train.std(axis=0)
    spread[spread < 1e-3] = 1
    z, q = (train - centre) / spread, (x - centre) / spread
    cov = {k: np.cov(z[good == k].T, bias=True) for k in (0, 1)}
    n = {k: (good == k).sum() for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    log = {}
    for k in (0, 1):
        s = (n[k] * cov[k] + weight * pooled) / (n[k] + weight)
        s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        u = q - z[good == k].mean(axis=0)
        log[k] = np.log(n[k]) - 0.5 * np.einsum("ij,jk,ik->i", u, np.linalg.inv(s), u) - 0.5 * np.linalg.slogdet(s)[1]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def test_scores_against_plain_version_and_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    x = {r["doc_id"]: np.array(quality_classifier.statistics(r["text"])) / 1024 for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in x}
    train = [i for i in x if i in labels and not held[i]]
    ids = sorted(x)
    want = dict(zip(ids, plain_posterior(np.array([x[i] for i in train]), np.array([labels[i] for i in train]), np.array([x[i] for i in ids])), strict=True))
    got = queries()["op13_quality_classifier"](spark, sf).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5) and r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(tested) > 50 and sum(a == b for a, b in tested) >= 0.95 * len(tested)
    again = queries()["op13_quality_classifier"](spark, sf).collect()
    assert sorted(got) == sorted(again)


def test_held_out_labels_change_nothing(spark, docs):
    ids = [i for i in range(12) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, i % 2) for i in range(12)]
    a = quality_classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality_classifier.quality_scores(docs, spark.createDataFrame([(i, 1 - q if i in ids else q) for i, q in labels], "doc_id long, quality int"))
    assert ids and rows_of(a, *a.columns) == rows_of(b, *b.columns)


def test_classifier_hard_cases(spark, docs, odd_docs, empty_docs):
    schema = "doc_id long, quality int"
    labels = spark.createDataFrame([(0, 1), (10, 0), (None, 1), (7, None), (999, 1), (2, 0), (2, 1), (6, 0), (8, 1)], schema)
    got = quality_classifier.quality_scores(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or not score between 0 and 1 or predicted is null or held_out is null").count() == 0
    assert got.where("doc_id is null").first()["held_out"]
    odd = quality_classifier.quality_scores(odd_docs, labels)
    assert rows_of(got, *got.columns) == rows_of(odd, *got.columns)
    assert len({r["score"] for r in got.where("doc_id in (0, 1)").collect()}) == 1  # equal texts
    assert quality_classifier.quality_scores(empty_docs, labels).count() == 0
    for rows, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0), (3, 0)], 0.0)):
        only = quality_classifier.quality_scores(docs, spark.createDataFrame(rows, schema))
        assert {r["score"] for r in only.collect()} == {want}
