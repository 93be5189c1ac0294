"""The pipeline stage by stage: what each keeps, against SQL and plain Python, and on hard rows."""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from evidara.llm import byte_bpe  # noqa: E402
from evidara.llm.common import table  # noqa: E402
from evidara.llm.queries import bpe_pattern, oracle_sql, vocabulary  # noqa: E402
from test_operators import brute_targets, words  # noqa: E402


def test_stages_take_effect_and_keep_columns(spark, small):
    docs = table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    seen = [docs]
    for _, f in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialize(f(spark, seen[-1], small)))
    for d in seen[:-1]:
        assert d.columns == docs.columns
    n = [d.count() for d in seen]
    assert n[0] > n[1] > n[2] and n[4] == n[3]
    assert seen[1].join(seen[0], "doc_id", "left_anti").count() == 0 and seen[2].groupBy("doc_id").count().where("count > 1").count() == 0
    assert seen[4].where("not decodes_back or n_tokens <> size(token_ids)").count() == 0


def exact_groups(texts):
    """Each id's least id reachable by five-word-shingle similarities of 0.8 or more, by all pairs."""
    sets, up = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_run_against_brute_force(spark, small):
    """Rules by their SQL, groups by all pairs, the mix by its targets, tokens by the rank library."""
    import duckdb
    import tiktoken

    docs, found = table(spark, small, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.materialize(f(spark, found[-1] if found else docs, small)))
    texts = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rules = next(q for q in oracle_sql() if q.startswith("op1_"))
    good = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({oracle_sql()[rules]})").fetchall() if kept}
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(found[0]) == sorted(good)

    groups = exact_groups({i: texts[i][1] for i in good})
    unique = sorted(set(groups.values()))
    assert ids(found[1]) == unique

    copies, sizes, taken, longest = Counter(ids(found[2])), defaultdict(int), defaultdict(int), defaultdict(int)
    assert set(copies) <= set(unique) and max(copies.values()) <= 3
    for i in unique:
        source, n = texts[i][0], len(words(texts[i][1]))
        sizes[source] += n
        taken[source] += n * copies[i]
        longest[source] = max(longest[source], n)
    want = brute_targets(dict(sizes))
    for source in sizes:
        assert abs(taken[source] - want[source]) <= longest[source] / 2 + 1

    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=bpe_pattern(), mergeable_ranks=ranks, special_tokens={})
    got = found[3].select("doc_id", "token_ids", "ids_sha256").collect()
    for r in got:
        tokens = plain.encode_ordinary(texts[r["doc_id"]][1] or "")
        assert list(r["token_ids"]) == tokens and r["ids_sha256"] == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, small).select("doc_id", "ids_sha256").collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == Counter((r["doc_id"], r["ids_sha256"]) for r in whole) and Counter(r["doc_id"] for r in got) == copies


def test_hard_rows_with_clashing_columns(spark, small, odd_docs):
    docs = odd_docs
    for name, f in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(f(spark, docs, small))
        assert name == "byte_bpe" or after.columns == odd_docs.columns
        docs = after
    assert {8, 10} & {r["doc_id"] for r in docs.select("doc_id").collect()} and docs.where("not decodes_back").count() == 0


def test_run_equals_the_stages(spark, small):
    a, b = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    key = lambda d: sorted((r["doc_id"], r["ids_sha256"]) for r in d.select("doc_id", "ids_sha256").collect())
    assert key(a) == key(b) and a.count() > 0


def test_empty_documents(spark, small, empty_docs):
    docs = empty_docs
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(f(spark, docs, small))
    assert docs.count() == 0
