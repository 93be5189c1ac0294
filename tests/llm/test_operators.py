"""Each operator against a brute-force version on hard rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidara.llm import byte_bpe, html_extract, license_scan, mixing, multiset_hash, quality_rules, sharding, simhash, token_counts, url_filters
from evidara.llm.common import table
from evidara.llm.components import connected_components
from evidara.llm.queries import bpe_pattern, oracle_sql, queries, vocabulary

WS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(f"[{WS}]+", t or "") if w]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_intermediate_tables_can_be_dropped(spark):
    from evidara.llm import common

    t = common.materialize(spark.range(10))
    assert t.count() == 10 and common.intermediate_dir(spark).startswith(common.shared_dir(spark))
    common.drop_intermediate(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{common.intermediate_dir(spark)}/*")


# --- op1


def brute_measures(t):
    w = words(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark, docs, small):
    for df in (docs, table(spark, small, "documents")):
        got = df.select("text", quality_rules.measures(F.col("text")).alias("m")).select("text", "m.*").collect()
        assert got
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(r["text"])


def binomial_cdf(n, k, p):
    from math import comb

    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 50, 400) for k in (0, 1, 2, 5, 20) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        assert r["p"] == pytest.approx(1.0 if r["k"] >= 0.05 * r["n"] else binomial_cdf(r["n"], r["k"], 0.05), rel=1e-9)


def test_cutoffs_are_certified_and_spare_small_strata(spark):
    rows, labels = [], []
    for i in range(900):
        big, bad = i < 800, i % 5 == 0
        rows.append((i, "big" if big else "small", False, 3.5 if bad else 0.1))
        labels.append((i, 0 if bad else 1))
    scored = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, score double")
    cut = {r["stratum"]: r for r in quality_rules.calibrate(scored, spark.createDataFrame(labels, "doc_id long, quality int"), alpha=0.05).collect()}
    assert cut["big"]["cutoff"] == 3.0 and cut["big"]["n_good"] == 640
    assert cut["small"]["cutoff"] == 3.0  # 80 good, none lost: 0.95**80 < 0.05 / 2
    tight = {r["stratum"]: r["cutoff"] for r in quality_rules.calibrate(scored, spark.createDataFrame(labels, "doc_id long, quality int"), alpha=0.01).collect()}
    assert tight == {"big": 3.0, "small": None}  # 80 documents can't certify one percent


def test_fixed_sequence_stops_at_the_first_failure(spark):
    rows = [(i, "en", False, 3.9 if i % 10 == 0 else 0.2) for i in range(500)]
    labels = [(i, 1) for i in range(500)] + [(10_000, 0)]
    rows.append((10_000, "en", False, 3.9))
    cut = quality_rules.calibrate(spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, score double"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r["cutoff"] for r in cut] == [None]  # 4.0 passes but catches nothing, 3.0 loses a tenth


def test_sql_agrees_where_strata_have_cutoffs(spark, tmp_path):
    """Enough labels that three languages certify different cutoffs and a fourth none."""
    import duckdb

    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, labels, marks = [], [], {"en": (30, 4), "de": (14, 2), "fr": (60, 20), "es": (60, 0)}
    for lang, n in (("en", 900), ("de", 900), ("fr", 900), ("es", 120)):
        for i in range(n):
            bad = i % 6 == 0
            w = [vocabulary[j] for j in rng.integers(0, 3000, 60)]
            w += ["#"] * int(rng.integers(marks[lang][0] // 2, marks[lang][0]) if bad else rng.integers(0, marks[lang][1] + 1))
            labels.append((len(rows), 0 if bad else 1, 0))
            rows.append((len(rows), " ".join(w), lang, "a", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries()["op1_quality_rules"](spark, str(tmp_path))
    cutoffs = {r["stratum"]: r["cutoff"] for r in got.select("stratum", "cutoff").distinct().collect()}
    assert cutoffs["es"] is None and len({cutoffs[x] for x in ("en", "de", "fr")} - {None}) == 3
    assert got.where("not kept and not base_failed").count() > 100
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.sql(oracle_sql()["op1_quality_rules"])
    index = [want.columns.index(c) for c in got.columns]
    assert rows_of(got, *got.columns) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=repr)


def test_false_rejections_stay_within_the_risk(spark):
    """Strata whose true loss is known: hardly any of 300 chosen cutoffs loses more than alpha.

    All strata of a run share delta, so at most about one in a run of 100 may fail at delta near 1.
    """
    alpha, n = 0.05, 400
    rng = np.random.default_rng(8)
    for _ in range(3):
        good = rng.random((100, n)) < 0.8
        scores = np.where(good, rng.exponential(1 / 1.2, good.shape), 0.5 + rng.exponential(1.0, good.shape))
        rows = [(d * n + i, f"d{d}", False, float(scores[d, i])) for d in range(100) for i in range(n)]
        scored = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, score double")
        labels = spark.createDataFrame([(d * n + i, int(good[d, i])) for d in range(100) for i in range(n)], "doc_id long, quality int")
        chosen = [r["cutoff"] for r in quality_rules.calibrate(scored, labels, alpha=alpha, delta=0.999).collect() if r["cutoff"] is not None]
        assert len(chosen) > 20 and sum(np.exp(-1.2 * c) > alpha for c in chosen) <= 3  # good scores are exponential


def test_quality_hard_cases(spark, docs, odd_docs, empty_docs):
    labels = spark.createDataFrame([(0, 1), (10, 0), (None, 1), (7, None), (999, 1), (9, 0), (9, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_verdicts(docs, labels)
    assert got.count() == docs.count() and got.where("kept is null or base_failed is null").count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == rows_of(got.where("kept"), "doc_id")
    assert quality_rules.keep_good(odd_docs, none).columns == odd_docs.columns
    assert quality_rules.quality_verdicts(empty_docs, labels).count() == 0 and quality_rules.keep_good(empty_docs, none).count() == 0


# --- op2


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(spark, docs, small):
    for df in (docs, table(spark, small, "documents")):
        got = mixing.mix(df).collect()
        sizes, longest = defaultdict(int), defaultdict(int)
        for r in df.select("source", "text").collect():
            n = len(words(r["text"]))
            sizes[r["source"]] += n
            longest[r["source"]] = max(longest[r["source"]], n)
        want = brute_targets(dict(sizes))
        taken = defaultdict(int)
        for r in got:
            taken[r["source"]] += r["taken"]
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert len(got) == df.count()
        for s in sizes:  # on hard rows one document holds nearly all of its source
            assert abs(taken[s] - want[s]) <= (longest[s] / 2 + 1 if df is docs else max(0.02 * want[s], 50))


def plain_rates(mean, n, total, ratio, most=3):
    """Rates and multiplier of one source by bisection on the dual's gradient."""
    target, phi = ratio * total.sum(), mean / (total.sum() / n.sum())
    words = lambda lam: float((total * np.minimum(most, np.exp(np.minimum(lam * phi, 50)))).sum())
    low, high = -1e4, 1e4
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (low, lam) if words(lam) > target else (lam, high)
    return np.minimum(most, np.exp(np.minimum(lam * phi, 50))), lam


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_solve_the_dual(spark, seed):
    rng = np.random.default_rng(seed)
    rows, targets, ratios = [], [], {}
    for i, ratio in enumerate((0.02, 0.2, 0.7, 0.999, 1.5, 2.5, 2.99)):
        ratios[f"s{i}"] = ratio
        sizes = np.unique(rng.integers(1, 4000, 60))
        n = rng.integers(1, 50, len(sizes))
        rows += [(f"s{i}", int(z), int(k), int(z * k)) for z, k in zip(sizes, n, strict=True)]
        targets.append((f"s{i}", int((sizes * n).sum()), int(n.sum()), float(ratio * (sizes * n).sum())))
    targets += [("full", 10, 1, 30.0), ("none", 10, 1, 0.0), ("empty", 0, 5, 0.0), (None, 7, 1, 14.0)]
    rows += [("full", 10, 1, 10), ("none", 10, 1, 10), ("empty", 0, 5, 0), (None, 7, 1, 7)]
    cells = spark.createDataFrame(rows, "source string, band long, n long, words long")
    goals = spark.createDataFrame(targets, "source string, source_size long, n_docs long, target double")
    got = defaultdict(list)
    for r in mixing.cell_rates(cells, goals).collect():
        got[r["source"]].append(r)
    assert [got[s][0]["rate"] for s in ("full", "none", "empty", None)] == [3.0, 0.0, 1.0, pytest.approx(2.0)]
    for s, ratio in ratios.items():
        n, total, rate = (np.array([r[c] for r in got[s]], float) for c in ("n", "words", "rate"))
        want, lam = plain_rates(total / n, n, total, ratio)
        assert np.allclose(rate, want, rtol=1e-6, atol=1e-9)
        assert rate.max() > rate.min() * (1.2 if ratio != 0.999 else 1.0)  # tilted, not proportional
        target, phi = ratio * total.sum(), (total / n) / (total.sum() / n.sum())
        assert float((total * rate).sum()) == pytest.approx(target, rel=1e-8)
        # weak duality is tight: the entropy of the rates equals the dual's value at the multiplier
        scale = total.sum() / n.sum()
        entropy = float((n * np.where(rate > 0, rate * np.log(np.maximum(rate, 1e-300)) - rate + 1, 1)).sum())
        x = lam * phi
        conjugate = np.where(x > np.log(3), 3 * x - 3 * np.log(3) + 3 - 1, np.exp(np.minimum(x, 5)) - 1)
        dual = lam * target / scale - float((n * conjugate).sum())
        assert abs(entropy - dual) <= 1e-5 * (1 + abs(entropy))


def test_equal_rows_meet_the_target(spark):
    """Only some of many equal rows get the extra copy."""
    rows = [(7, "one two three four five six seven eight nine ten", "en", "a", 1)] * 1000 + [(i, "w " * 13, "en", "b", 1) for i in range(900)] + [(9, "x y", "de", None, 1)] * 2500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_targets({"a": 10_000, "b": 11_700, None: 5_000})
    got = mixing.mix(df.repartition(3))
    assert got.count() == len(rows)
    taken = {r["source"]: r["taken"] for r in got.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    for s, z in (("a", 10), ("b", 13), (None, 2)):
        assert abs(taken[s] - want[s]) <= z / 2 + 1
    assert rows_of(mixing.mix(df.repartition(7)), "doc_id", "taken") == rows_of(got, "doc_id", "taken")
    out = mixing.apply_mix(df.withColumn("m", F.create_map(F.lit("k"), F.col("lang"))))
    assert {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"a": taken["a"] // 10, "b": taken["b"] // 13, None: taken[None] // 2}


def test_mix_reruns_agree_and_apply(spark, docs, odd_docs, empty_docs):
    a = mixing.mix(docs)
    assert rows_of(a, "doc_id", "size", "taken") == rows_of(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.count() == a.agg(F.sum("copies")).first()[0]
    assert mixing.apply_mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix(empty_docs).count() == 0 and mixing.apply_mix(empty_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 40)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.floats(0.01, 2.99))
def test_rates_and_copies(cells, ratio):
    size, n = np.array([c[0] for c in cells], float), np.array([c[1] for c in cells])
    if not size.any():
        return
    target = ratio * float((size * n).sum())
    rates, _ = plain_rates(size, n, size * n, ratio)
    copies = mixing.whole_copies(size, n, rates, target)
    assert ((copies >= 0) & (copies <= 3 * n)).all() and abs(float((copies * size).sum()) - target) <= size.max() / 2 + 1


def test_bands(spark):
    got = {r["id"]: r["band"] for r in spark.range(3000).select("id", mixing.band_of(F.col("id")).alias("band")).collect()}
    for x, band in got.items():
        step = 1 << max(0, x.bit_length() - 9)
        assert band == x // step * step


# --- op3


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in url_filters.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_url_rules(spark, small):
    odd = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com?x", "https://X.Example.com/en/1#t", "https://www.example.com/en/", "ftp://u@h.net/es/x?y://z", "http://evilexample.com/en/", "http://ÀB.net/fr/\n"]
    pages = table(spark, small, "pages").select("page_id", "url", "html").union(spark.createDataFrame([(1000 + i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages).collect()}
    for r in pages.collect():
        host, path, best = brute_rule(r["url"])
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, best and best[0])
        if best:
            assert g["verdict"] == best[1]


def test_aliases_take_blocks_but_never_over_an_allow(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.org/x", link.format("http://b.net/es/1")),
        (2, "https://c.org/y#part", '<META http-equiv=Refresh content="0; URL=https://a.org/x">'),
        (3, "http://d.com/z", link.format("https://c.org/y")),
        (4, "https://e.org/z", "<!-- " + link.format("http://b.net/es/1") + " -->"),
        (5, "https://f.org/a/b", "<link rel='canonical' href='c'>"),
        (6, "https://f.org/a/c", link.format("//c.org/y")),
        (7, "https://g.org/", link.format("mailto:x")),
        (7, "https://g.org/", link.format("mailto:x")),
        (8, None, link.format("http://b.net/es/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("odd"))
    got = rows_of(url_filters.filter_urls(pages), "page_id", "verdict")
    assert got == sorted([(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (6, "block"), (7, "allow"), (7, "allow"), (8, "allow")], key=repr)
    more = spark.createDataFrame([("https://g.org/", "http://b.net/es/1")], "src string, dst string")
    assert (7, "block") in rows_of(url_filters.filter_urls(pages, redirects=more), "page_id", "verdict")
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "href, head, node",
    [
        ("../c/./d", "", "https://f.org/a/c/d"), ("/x/../../y", "", "https://f.org/y"), ("..", "", "https://f.org/a/"), ("c?p=../q", "", "https://f.org/a/b/c?p=../q"), ("?a=1&amp;b=2", "", "https://f.org/a/b/x?a=1&b=2"), ("?a=1&#38;b=2", "", "https://f.org/a/b/x?a=1&b=2"),
        ("y", "<base href='https://g.org/k/'>", "https://g.org/k/y"), ("//h.org/z", "<base href='http://g.org/k/'>", "http://h.org/z"), ("y", "<base href='/k/'>", "https://f.org/a/b/y"), ("http://H.org/../q", "", "http://h.org/../q"),
    ],
)
def test_links_resolve(spark, href, head, node):
    page = spark.createDataFrame([("https://f.org/a/b/x?z", f'{head}<link rel=canonical href="{href}">')], "url string, html string")
    assert [r["dst"] for r in url_filters.link_edges(page).collect()] == [node]


def test_long_chain_and_hub_of_redirects(spark):
    """A chain of 300, a hub of 3,000 with dangling ends, and null urls, through the whole operator."""
    link = '<link rel="canonical" href="{}">'
    rows = [(i, f"https://c.org/{i}", link.format(f"https://c.org/{i + 1}")) for i in range(300)] + [(300, "https://c.org/300", link.format("http://b.net/es/end"))]
    rows += [(1000 + i, f"https://h{i}.com/x" if i % 2 else f"https://h{i}.org/x", link.format("http://example.com/en/hub")) for i in range(3000)]
    rows += [(5000 + i, None if i % 2 else "no scheme", link.format("http://b.net/es/end")) for i in range(1000)] + [(7000, "https://far.org/", link.format("https://dangling.org/nowhere"))]
    got = dict(rows_of(url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "verdict"))
    assert all(got[i] == "block" for i in range(301))
    assert all(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(3000))  # .com is allowed by rule
    assert all(got[5000 + i] == "allow" for i in range(1000)) and got[7000] == "allow"


@pytest.mark.parametrize("edges", [[], [("a", "a")], [("a", "b"), ("b", "a"), (None, "c")], [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], [("hub", f"s{i}") for i in range(200)], [(f"n{i:04}", f"n{i + 1:04}") for i in range(3000)]])
def test_components(spark, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "x string, y string"), "x", "y")
    assert rows_of(got, "node", "component") == sorted(((n, root(n)) for n in up), key=repr)


# --- op4


def test_telling_words_and_rules_cover_the_table():
    words_ = license_scan.telling_words(license_scan.SENTENCES)
    assert len(words_) < 15 and all(any(w in x.lower() for w in words_) for x in license_scan.SENTENCES.values())
    known, cut = license_scan.known_sentences(license_scan.SENTENCES)
    used = {i for _, seq in license_scan.RULES for i in seq}
    assert used == set(license_scan.SENTENCES)  # no dead entry, none unknown
    assert set(license_scan.known_sentences({1: "a b. c", 2: "c"})[1][1]) & {2}


def test_custom_tables(spark):
    """The words that texts are tried for come from the table in use."""
    own = {1: "Zebras may graze here", 2: "ok", 3: "Grass v. 2 is free"}
    df = spark.createDataFrame([(1, "So. Zebras may  graze here! Ok; Grass v. 2 is free."), (2, "nothing of it"), (3, "grass v."), (4, "")], "doc_id long, text string")
    got = df.select("doc_id", license_scan.sentence_ids(F.col("text"), own).alias("ids"), license_scan.match_rules(license_scan.sentence_ids(F.col("text"), own), (("Z", (1, 2)), ("G", (3, 1))), ()).alias("names"))
    assert rows_of(got, "doc_id", "ids", "names") == [(1, [1, 2, 3], ["Z"]), (2, [], []), (3, [], []), (4, [], [])]
    assert df.select(license_scan.sentence_ids(F.col("text"), {}).alias("ids")).where("size(ids) > 0").count() == 0


def test_license_sql_agrees_on_notices(spark, tmp_path):
    """Cut notices, licences inside others and elsewhere, lines and repeats, against the SQL."""
    import duckdb

    s, rng = license_scan.SENTENCES, np.random.default_rng(6)
    texts = ["\n".join(f"{s[i]}." for i in seq) for _, seq in license_scan.RULES] + [" ".join(f"{s[i]}." for i in seq) for _, seq in license_scan.RULES]
    pool = list(s.values()) + ["Some other words", "v", "2.0", "end\nof line", ""]
    texts += ["".join(str(rng.choice(pool)) + str(rng.choice([". ", ".\n", "\n\n", "; ", "\n"])) for _ in range(int(rng.integers(1, 9)))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(oracle_sql()["op4_license_scan"])
    got = queries()["op4_license_scan"](spark, str(tmp_path))
    index = [want.columns.index(c) for c in got.columns]
    assert rows_of(got, *got.columns) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=repr)
    assert got.where("licenses <> ''").count() > 50


def test_license_rules(spark, docs, odd_docs, empty_docs):
    s = license_scan.SENTENCES
    texts = [
        (1, f"Head\n\n{s[3]}:\n\n{s[4]}.\n\n{s[5]}."),
        (2, f"{s[4]}. {s[3]}."),
        (3, "/* " + s[40].replace(" are ", "\nare ") + ":\n" + f"{s[41]}.\n{s[42]}.\n{s[43]}."),
        (4, "Text without a stop\nReleased under the MIT License\nmore"),
        (5, "Licensed under CC BY-NC 4.0. And this:  LICENSED under the apache license,  version 2.0!"),
        (6, None),
        (6, None),
        (7, "unlicensed"),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string").withColumn("licenses", F.lit("odd")))
    assert rows_of(got, "doc_id", "licenses") == [(1, "MIT"), (2, ""), (3, "BSD-3-Clause"), (4, "MIT"), (5, "Apache-2.0,CC-BY-NC-4.0"), (6, ""), (6, ""), (7, "")]
    assert license_scan.scan_licenses(odd_docs).count() == docs.count() and license_scan.scan_licenses(empty_docs).count() == 0


def test_every_sentence_and_rule_is_found_in_running_text(spark):
    s = license_scan.SENTENCES
    rows = [(f"s{i}", f"Some head. {t}. More words follow, v. 2.0. End") for i, t in s.items()]
    rows += [(f"r{i}", "Some head.\n\n" + " ".join(f"{s[x]}." for x in seq) + " More words follow.") for i, (_, seq) in enumerate(license_scan.RULES)]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {i: got[f"s{i}"]["sentence_ids"] for i in s} == {i: "22,23" if i == 21 else str(i) for i in s}  # 21 is cut into 22 and 23
    for i, (name, _) in enumerate(license_scan.RULES):
        assert name in got[f"r{i}"]["licenses"].split(",")


def test_notices_that_are_cut_and_parts_elsewhere(spark):
    s = license_scan.SENTENCES
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    two, three = (" ".join(f"{s[i]}." for i in seq) for seq in ((40, 41, 42), (40, 41, 42, 43)))
    texts = [(1, mpl), (2, "Mozilla Public License, v. 2.0."), (3, mpl.replace("v. 2.0.", "v. of old. 2.0.")), (4, three), (5, f"{three} {three}"), (6, f"{three} {two}"), (7, f"{two} Other. {three}"), (8, two)]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    both = "BSD-2-Clause,BSD-3-Clause"
    assert rows_of(got, "doc_id", "licenses") == [(1, "MPL-2.0"), (2, ""), (3, ""), (4, "BSD-3-Clause"), (5, "BSD-3-Clause"), (6, both), (7, both), (8, "BSD-2-Clause")]


# --- op5


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


SPEC = vocabulary("byte_bpe_50k.json")


def test_tokenizers_outside_the_proof_encode_whole(spark):
    import json

    spec = json.loads(vocabulary("byte_bpe_50k.json"))
    assert token_counts.can_splice(vocabulary("byte_bpe_50k.json")) and not token_counts.can_splice(vocabulary("word_bpe_49k.json"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"content": "a b"}]}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        assert not token_counts.can_splice(json.dumps(spec | change).encode())
    df = spark.createDataFrame([(1, "Some words, HERE and there. " * 60)], "doc_id long, text string")
    tok = token_counts.load_tokenizer(vocabulary("word_bpe_49k.json"))
    assert token_counts.count_tokens(df, vocabulary("word_bpe_49k.json"), chunk_chars=50, overlap_chars=5).first()["n_tokens"] == len(tok.encode(df.first()["text"], add_special_tokens=False).ids)


def test_long_texts_at_the_default_chunk_size(spark):
    rng = np.random.default_rng(2)
    long = " ".join(WORDS[i] + "." * int(i % 7 == 0) for i in rng.integers(0, len(WORDS), 60_000))
    texts = [long, "x" * 150_000, " " * 140_000 + "a b", long[:65_536], long[:65_537]]
    tok = token_counts.load_tokenizer(vocabulary("byte_bpe_50k.json"))
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(list("ab é日\n \t'1.<|>") + ["<|endoftext|>", " the", "ing"]), max_size=400).map("".join), st.integers(1, 90), st.integers(1, 40))
def test_splicing_equals_whole_encoding(text, chunk, overlap):
    tok = token_counts.load_tokenizer(SPEC)
    assert token_counts.count_long(tok, text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, docs, odd_docs, empty_docs):
    tok = token_counts.load_tokenizer(SPEC)
    got = token_counts.count_tokens(docs, SPEC, chunk_chars=3000, overlap_chars=200)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        t = r["text"] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert dict(token_counts.count_tokens(odd_docs, SPEC).dtypes)["n_tokens"] == "bigint"
    assert token_counts.count_tokens(empty_docs, SPEC).count() == 0


# --- op6


def brute_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, d in enumerate(ids):
        groups[root(i)].append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash_components(spark, docs, small, empty_docs, odd_docs):
    for df in (docs.where("doc_id is null or doc_id <> 8"), table(spark, small, "documents")):
        data = df.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r["text"]) for r in data]
        comps = brute_components([r["doc_id"] for r in data], prints, 3)
        want = sorted(((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(data, prints, comps, strict=True)), key=repr)
        assert rows_of(simhash.simhash_components(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(empty_docs).count() == 0 and simhash.simhash_components(odd_docs).count() == docs.count()


@pytest.mark.parametrize("tree_size", [1, 7, 2000])
@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 5), (4, 6), (0, 1), (3, None)])
def test_split_trees_lose_no_link(spark, tree_size, radius, blocks):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(60)} | {int(x) for x in rng.integers(0, 2**63, 40)})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius=radius, blocks=blocks, tree_size=tree_size)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= radius for r in links.collect())
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    comps = brute_components(signed, prints, radius)
    assert [got.get(x, x) for x in signed] == comps


def test_one_of_each_group_stays(spark, docs, odd_docs, empty_docs, small):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [0, 3, 6, 7, 8, 9, 10, 11]
    assert simhash.keep_one_of_each(odd_docs).columns == odd_docs.columns and simhash.keep_one_of_each(empty_docs).count() == 0

    def shingles(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    d = table(spark, small, "documents")
    sets = {r["doc_id"]: shingles(r["text"]) for r in d.collect()}
    stay = {r["doc_id"] for r in simhash.keep_one_of_each(d).select("doc_id").collect()}
    groups = {i: i for i in sets}

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                groups[max(x, y)] = min(x, y)
    want = {root(i) for i in sets}
    assert stay == want


def test_near_dedup_recall_and_precision(spark):
    """Kept documents against exact groups of five-word-shingle sets on sf0.01."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {}
    for r in d.select("doc_id", "text").collect():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    order = sorted(sets, key=lambda i: (len(sets[i]), i))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    stay = {r["doc_id"] for r in simhash.keep_one_of_each(d).select("doc_id").collect()}
    gone = {i for i in sets if root(i) != i}
    assert len(stay & gone) <= 0.01 * len(gone) and not [i for i in sets if i not in stay and i not in gone]


def test_repeated_rows_stay_once_and_reruns_agree(spark):
    rows = [(1, "a b c d e f g h", f"x{i % 3}", None) for i in range(50)] + [(None, "a b c d e f g h", "y", 1), (2, "other words here", "z", 2), (2, "other words here", "z", 2), (2, "quite another text", "z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, t_node int")
    got = [sorted(map(tuple, simhash.keep_one_of_each(df.repartition(n)).collect())) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and [r[:2] for r in got[0]] == [(1, "a b c d e f g h"), (2, "other words here"), (2, "quite another text")]


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    values = sorted({int(x) for x in rng.integers(0, 2**63, 400)} | {int(x) ^ 5 for x in rng.integers(0, 2**63, 5)})
    values += [v ^ (1 << int(rng.integers(0, 63))) for v in values[:100]]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert all(tree.add(v) == tree.index[v] for v in values) and len(tree.values) == len(set(values))
    for v in values[:200]:
        assert sorted(tree.values[i] for i in tree.search(v, 3)) == sorted(w for w in set(values) if (v ^ w).bit_count() <= 3)
    assert tree.visited < 0.75 * 200 * len(tree.values)
    forest = simhash.Forest(3)
    for i in range(5000):  # equal values are no chain
        forest.add(7, i)
    assert len(forest.tree.values) == 1


def test_shards_of_many_fingerprints(spark):
    """Trees of hundreds of nodes, and a hot shard of several trees, against brute force."""
    assert [simhash.shard_plan(n, 3, 256) for n in (0, 1000, 10**6, 10**9, 10**12)] == [(4, 0), (4, 2), (4, 12), (5, 22), (7, 32)]
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**62))
    prints = {int(x) for x in rng.integers(0, 2**63, 900)}
    prints |= {x ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for x in list(prints)[:300]}
    prints |= {centre ^ int(x) for x in rng.integers(0, 2**40, 600)}  # 24 common bits
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = simhash.near_links(nodes, tree_size=300, shard_size=256)
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert [got.get(x, x) for x in prints] == brute_components(prints, prints, 3)


def test_sketch_similarity():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8, 0.95):
        base = [f"w{x}" for x in rng.integers(0, 10**9, 3000)]
        other = [w if rng.random() < share else f"v{i}" for i, w in enumerate(base)]
        a, b = (simhash.text_profile(" ".join(x), 1, 512) for x in (base, other))
        exact = len(set(base) & set(other)) / len(set(base) | set(other))
        found, off = simhash.estimates(np.frombuffer(a[1], np.uint8)[None], np.array([a[3]]), np.frombuffer(b[1], np.uint8), b[3])
        assert abs(found[0] - exact) < 0.09 and (share != 0.8 or abs(found[0] - exact) < off[0] < 0.07)
        assert (a[3], b[3]) == (len(set(base)), len(set(other)))


def five_word_shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_contiguous_edits_are_near_copies(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, planted = [], []
    for i in range(240):
        base = fresh(int(rng.integers(150, 400)))
        n = int(len(base) * (0.04, 0.08, 0.12, 0.18)[i % 4])
        other = (base + fresh(n), base[:-n], base[: -n // 2] + fresh(-(-n // 2)), fresh(n) + base)[i // 4 % 4]
        x, y = five_word_shingles(base), five_word_shingles(other)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        planted += [2 * i + 1] if len(x & y) >= 0.82 * len(x | y) else []
    stay = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert len(planted) > 200 and stay >= {2 * i for i in range(240)}
    assert len(stay & set(planted)) <= 0.01 * len(planted)


def test_drifting_versions_stay_one_group(spark):
    """A text's nearest text in bits often isn't the one that it is similar to."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(3):
        w = [f"w{x}" for x in rng.integers(0, 3000, 600)]
        for _ in range(60):
            rows.append((len(rows), " ".join(w)))
            at, n = int(rng.integers(0, 560)), int(rng.integers(10, 35))
            w = w[:at] + [f"w{x}" for x in rng.integers(0, 3000, n)] + w[at + n :]
    sets = [five_word_shingles(t.split()) for _, t in rows]
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in zip(sets, sets[1:], strict=False) if len(x & y) > 100)
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), tree_size=50)
    assert [r["doc_id"] for r in got.select("doc_id").orderBy("doc_id").collect()] == [0, 60, 120]


# --- op7


def test_sharding(spark, docs, odd_docs, small, empty_docs):
    for df in (docs, table(spark, small, "documents")):
        got = sorted(sharding.balanced_shards(df, partitions=5).collect(), key=lambda r: (r["shard"], r["slot"]))
        total = sum(r["size"] for r in got)
        assert len(got) == df.count() and {r["law"] for r in got} == {"bytes"}
        ids = [(r["doc_id"] is not None, r["doc_id"]) for r in got]
        assert [x for x in ids if x[0]] == sorted(x for x in ids if x[0])  # contiguous in doc_id order
        before, slots = 0, Counter()
        for r in got:
            assert r["shard"] == min(7, (2 * before + r["size"]) * 8 // (2 * total)) and r["slot"] == slots[r["shard"]]
            before += r["size"]
            slots[r["shard"]] += 1
        want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect() if r["doc_id"] is not None)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert sharding.balanced_shards(empty_docs).count() == 0 and sharding.balanced_shards(odd_docs).count() == docs.count()


# --- op8


def test_fingerprints_with_next(spark, docs, small, empty_docs, odd_docs):
    for df in (docs, table(spark, small, "documents")):
        data = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: r[:2])
        got = defaultdict(list)
        for r in multiset_hash.fingerprint_with_next(df, partitions=4).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(data)
        for i, (known, doc_id, text) in enumerate(data):
            following = data[(i + 1) % len(data)][2]
            half = len(text) // 2
            new = text[: len(text) - half] + following[:half]
            v, w, x = (multiset_hash.vector(multiset_hash.paragraphs(t)) for t in (text, new, following))
            row = (len(text), hashlib.sha256(new.encode()).hexdigest(), multiset_hash.to_hex(v), multiset_hash.to_hex(w), multiset_hash.likeness(v, w), multiset_hash.likeness(v, x))
            assert row in [tuple(r)[1:] for r in got[doc_id if known else None]]
    assert multiset_hash.fingerprint_with_next(empty_docs).count() == 0 and multiset_hash.fingerprint_with_next(odd_docs).count() == docs.count()
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert multiset_hash.fingerprint_with_next(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=30), st.lists(st.text(max_size=12), max_size=10), st.randoms())
def test_multiset_hash_is_homomorphic(a, b, random):
    mixed = a + b
    random.shuffle(mixed)
    whole = multiset_hash.vector(mixed)
    assert np.array_equal(multiset_hash.insert(multiset_hash.vector(a), b), whole)
    assert np.array_equal(multiset_hash.delete(whole, b), multiset_hash.vector(a))
    assert np.array_equal(multiset_hash.from_hex(multiset_hash.to_hex(whole)), whole)
    if Counter(a) != Counter(mixed):
        assert not np.array_equal(whole, multiset_hash.vector(a))


def test_likeness_follows_shared_paragraphs():
    a = [f"paragraph {i}" for i in range(400)]
    for share in (0.0, 0.25, 0.5, 0.75):
        b = a[: int(400 * share)] + [f"other {i}" for i in range(400 - int(400 * share))]
        assert abs(multiset_hash.likeness(multiset_hash.vector(a), multiset_hash.vector(b)) - share) < 0.3
    assert multiset_hash.likeness(multiset_hash.vector(a), multiset_hash.vector(a[::-1])) == 1.0


def plain_fingerprint(text):
    """The fingerprint and its sign sums, one paragraph and one lane at a time."""
    lanes, signs = [0] * 16, [0] * 128
    for line in text.split("\n"):
        start = 0
        for m in [*re.finditer(r"[.!?] ", line), None]:
            part, start = (line[start : m.start() + 1], m.end()) if m else (line[start:], None)
            raw = hashlib.shake_128(part.encode()).digest(144)
            for i in range(16):
                lanes[i] = (lanes[i] + int.from_bytes(raw[8 * i : 8 * i + 8], "little")) % 2**64
            for i in range(128):
                signs[i] += 1 if raw[128 + i // 8] >> (7 - i % 8) & 1 else -1
    return "".join(f"{x:016x}" for x in lanes) + "".join(f"{x % 2**32:08x}" for x in signs), signs


def plain_likeness(a, b):
    (x, s), (y, t) = a, b
    norm = sum(v * v for v in s + t)
    return 1.0 if x == y else max(0.0, 1 - sum((v - w) ** 2 for v, w in zip(s, t, strict=True)) / norm) if norm else 0.0


def test_fingerprints_against_plain_python(spark, docs):
    df = docs.where("doc_id is not null and doc_id <> 8").distinct()
    data = sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in multiset_hash.fingerprint_with_next(df, partitions=3).collect()}
    assert len(got) == len(data)
    for i, (doc_id, text) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = map(plain_fingerprint, (text, new, following))
        r = got[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[0], other[0])
        assert r["near_edited"] == pytest.approx(plain_likeness(own, other)) and r["near_next"] == pytest.approx(plain_likeness(own, after))


@pytest.mark.parametrize("n", [32_767, 32_768, 65_535, 65_536, 65_537, 70_000])
def test_frequent_paragraphs_do_not_wrap(n):
    a, b, none = (multiset_hash.vector(p) for p in (["a"] * n, ["b"] * n, []))
    assert not np.array_equal(a, b) and not np.array_equal(a, none)
    assert multiset_hash.likeness(a, b) < 0.5 and multiset_hash.likeness(a, multiset_hash.insert(a, ["c"])) > 0.99
    assert np.array_equal(multiset_hash.from_hex(multiset_hash.to_hex(a)), a)
    assert not np.array_equal(multiset_hash.vector([""] * n), multiset_hash.vector([""]))


def test_likeness_of_many_repeats():
    few, many = (multiset_hash.likeness(multiset_hash.vector(["p"] * (8 * k) + ["q"] * k), multiset_hash.vector(["p"] * (5 * k) + ["q"] * k)) for k in (500, 5_000))
    assert few == pytest.approx(many, abs=1e-9)


def test_equal_rows_may_be_split_over_ranges(spark):
    df = spark.range(400).selectExpr("7L as doc_id", "'one. two' as text").repartition(4)
    got = multiset_hash.fingerprint_with_next(df, partitions=4)
    assert got.count() == 400 and got.distinct().count() == 1 and got.first()["near_next"] == 1.0


# --- op9


RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe_pattern(), mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_codec_equals_the_rank_library(text):
    c = byte_bpe.codec(RANKS, bpe_pattern())
    ids = c.encode(text)
    assert ids == reference_encoding().encode_ordinary(text) and c.decode(ids) == text.encode()


def test_encode_decode(spark, docs, odd_docs, empty_docs):
    enc = reference_encoding()
    got = byte_bpe.encode_decode(docs, RANKS, bpe_pattern(), with_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        ids = enc.encode_ordinary(t)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decodes_back"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    odd = byte_bpe.encode_decode(odd_docs, RANKS, bpe_pattern())
    assert odd.where("ids_sha256 = 'odd ids_sha256'").count() == 0 and len(odd.columns) == len(set(odd.columns))
    assert byte_bpe.encode_decode(empty_docs, RANKS, bpe_pattern()).count() == 0


def test_every_byte_has_a_piece():
    model = byte_bpe.codec(RANKS, bpe_pattern()).model
    assert len(set(byte_bpe.byte_chars())) == 256 and model.vocab_size() == len(byte_bpe.read_ranks(RANKS)) + 1


# --- op10


def test_main_text_of_templates():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header>
    <nav><ul><li><a href=a>a</a></ul></nav><div id=sidebar>Side text, long. Yes.</div><main><article><header><h1>My &amp; Title</h1><p>By x</p></header><div class="ad">Buy!</div>
    <p>First   text, goes\n on.<br>More &lt;b&gt;.</p><p><b>Unclosed.<p>Second.</p><ul><li>one<li>two</ul><form><p>Sign up</p></form><aside>Related.</aside>
    <section class="comments"><p>Great post, thanks. I liked it, a lot, really.</p></section></article></main><div class="cookie-notice">We use cookies, ok.</div><footer>&copy; x</footer></body></html>"""
    assert html_extract.main_text(page) == "My & Title\n\nFirst text, goes on. More <b>.\n\nUnclosed.\n\nSecond.\n\none\n\ntwo"
    plain = "<body><div class=menu><a href=x>a</a></div><div><h2>Head</h2><div class=body><p>One, is here. It has points.</p><p>Two, is here. It has, points.</p></div></div>"
    assert html_extract.main_text(plain) == "Head\n\nOne, is here. It has points.\n\nTwo, is here. It has, points."
    assert [html_extract.main_text(x) for x in (None, "", "<", "<p>", "just text.", "<article></article>", "<nav>open, never closed. <article><p>In.</p>")] == ["", "", "<", "", "just text.", "", "In."]


def test_content_in_several_siblings_is_kept_whole():
    part = lambda n, w: " ".join(f"<p>{w} sentence {i}, with some words. And {w} more, here.</p>" for i in range(n))
    page = f"<body><div class=menu><a href=x>a</a></div><div id=story><div class=a>{part(15, 'First')}</div><div class=b>{part(5, 'Second')}</div></div><div class=site-footer>Foot, text.</div></body>"
    got = html_extract.main_text(page).split("\n\n")
    assert len(got) == 20 and got[0].startswith("First sentence 0") and got[-1].startswith("Second sentence 4")


@pytest.mark.parametrize("open_tag", ["<article class='post comments-open'>", "<main id=content class=has-sidebar>", "<div class='site sidebar-right'>", "<div class='content search-result'>", "<div class=widget>", "<div class=sidebar><article>", "<article class='post hidden x'>"])
def test_modifier_classes_do_not_drop_the_content(open_tag):
    body = [f"Sentence {i}, with some words. And more, here." for i in range(6)]
    page = f"<body><div class=related-posts>Other story, to read.</div>{open_tag}{''.join(f'<p>{b}</p>' for b in body)}<div class=share-buttons>Share this, now.</div></article></main></div><div id=comments><p>Well said, I think.</p></div></body>"
    assert html_extract.main_text(page) == "\n\n".join(body)


def test_long_comments_stay_out():
    said = "".join(f"<p>Reader {i} says, at length, that all is well. Or not, perhaps.</p>" for i in range(40))
    for open_tag, close_tag in (("<article>", "</article>"), ("<div class=story>", "</div>")):
        assert html_extract.main_text(f"<body>{open_tag}<p>Short, but here.</p>{close_tag}<div id=comments class=comments-area>{said}</div></body>") == "Short, but here."
    assert html_extract.main_text(f"<body><article><p>Short, but here.</p><div class=related>{said}</div></article></body>") == "Short, but here."


PROSE = [f"Sentence {i}, with some words. And more of them, here." for i in range(4)]
ART = "".join(f"<p>{x}</p>" for x in PROSE)
SAID = "".join(f"<p>Reader {i} says, at length, that all is well. Or not, perhaps.</p>" for i in range(20))


@pytest.mark.parametrize(
    "page",
    [
        f"<main><article>{ART}</article><article class=comment>{SAID}</article></main>",
        f"<article>{ART}<div class=user-comments>{SAID}</div></article>",
        f"<article>{ART}<div class=userComments>{SAID}</div><div id=nested-comments-2>{SAID}</div></article>",
        f"<main><article>{ART}</article><article class=related><p>Another story, to read.</p></article></main>",
        f"<main><article>{ART}</article><article id=div-comment-7 class='comment-body'>{SAID}</article></main>",
        f"<main>{ART}<article class=related-article><p>Another story, to read.</p></article></main>",
        f"<main><article class='post category-comments tag-newsletter comments-open'>{ART}</article></main>",
        f"<main><article class=promo>{ART}</article></main>",
        f"<body><nav><a href=x>Menu</a></nav><article class=comment>{ART}</article></body>",
    ],
)
def test_marks_on_articles(page):
    """Comments and related stories stay out whatever holds them; a mark on all there is doesn't count."""
    assert html_extract.main_text(page) == "\n\n".join(PROSE)


def test_formulas_and_drawings_are_text():
    assert html_extract.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> always</p></article>") == "Energy is E=mc2 always"
    assert html_extract.main_text("<article><p>A <svg><title>t</title><path d='x'/><text>lab</text><text>el</text></svg> b</p><object data=x>kept</object></article>") == "A lab el b\n\nkept"
    assert html_extract.main_text("<article><p>A<video>no player</video><canvas>no canvas</canvas> b</article>") == "A b"


def varied_pages() -> list[tuple[str, list[str]]]:
    """Pages that name their text, with teasers and link lists that no tag, class or role tells."""
    out = []
    for n in range(3, 9):
        body = [f"Part {i} of {n} has quite a few words, as articles do. It goes on, and on; then it ends." for i in range(n)]
        text = "".join(f"<p>{b}</p>" for b in body)
        cards = "".join(f"<article class=xx><a href=/{i}>Story {i}</a></article>" for i in range(n))
        lines = "".join(f"<li class=yy><a href=/{i}>Place {i}</a></li>" for i in range(2 * n))
        out += [
            (f"<body><main><article>{text}</article>{cards}</main></body>", body),
            (f"<body><main>{cards}<article>{text}</article></main></body>", body),
            (f"<body><main><div class=zz>{text}</div><ul class=yy>{lines}</ul></main></body>", body),
            (f"<body><main><article class=a1>{text}</article><article class=a2>{text}</article>{cards}</main></body>", body + body),
        ]
    return out


def test_scores_decide_inside_articles_and_mains(monkeypatch):
    pages = varied_pages()
    assert len(pages) >= 20 and [html_extract.main_text(p) for p, _ in pages] == ["\n\n".join(b) for _, b in pages]
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: [1.0] * len(blocks))
    assert sum(html_extract.main_text(p) != "\n\n".join(b) for p, b in pages) >= 12


def test_path_scores_are_the_smoothed_ratios():
    """Against the ratios written out: means a path, a Gaussian over two blocks to each side, the product."""
    for page, _ in varied_pages():
        blocks, _ = html_extract.read_blocks(page)
        of = {}
        for b in blocks:
            of.setdefault(b.owner.path, []).append(b)
        mean = lambda b, f: sum(f(x) for x in of[b.owner.path]) / len(of[b.owner.path])

        def smooth(f):
            w = {(i, j): math.exp(-((i - j) ** 2) / 2) for i in range(len(blocks)) for j in range(len(blocks)) if abs(i - j) <= 2}
            return [sum(w[i, j] * mean(blocks[j], f) for j in range(len(blocks)) if (i, j) in w) / sum(w[i, j] for j in range(len(blocks)) if (i, j) in w) for i in range(len(blocks))]

        size, points = smooth(lambda x: len(x.text)), smooth(lambda x: sum(c in ".,;:!?" for c in x.text))
        free = [1 - mean(b, lambda x: x.links) / mean(b, lambda x: len(x.text)) for b in blocks]
        assert html_extract.path_scores(blocks) == pytest.approx([a * (0.1 + p) * f for a, p, f in zip(size, points, free, strict=True)])


UNMARKED = """<body><div><a href=/>Start</a> <a href=/x>All things</a></div><div class=aa><p>Log</p><p>Map</p><p>Top</p><p>Old</p></div>
<div class=bb><h2>Head</h2><p>{}</p><p>{}</p><ul><li>short</ul><p>{}</p></div><div class=cc><p>More</p><p>New</p><p>Own</p><p>Red</p><p>Hot</p></div></body>"""


def test_scores_decide_on_pages_without_marks(monkeypatch):
    """No tag, class or role tells boilerplate here; with constant scores all of the page comes out."""
    prose = [f"Part {i} has quite a few words, as articles do. It goes on, and on; then it ends." for i in range(3)]
    page, want = UNMARKED.format(*prose), "\n\n".join(["Head", prose[0], prose[1], "short", prose[2]])
    assert html_extract.main_text(page) == want
    for wrong in (lambda blocks: [1.0] * len(blocks), lambda blocks: [0.0] * len(blocks), lambda blocks: [float(i % 7) for i in range(len(blocks))]):
        monkeypatch.setattr(html_extract, "path_scores", wrong)
        assert html_extract.main_text(page) != want


def test_wrappers_of_the_whole_page_are_cleared():
    body = [f"Sentence {i}, with some words. And more of them, here; as it must be." for i in range(6)]
    for tag in ("form", "aside", "header", "div role=search", "div class=sidebar"):
        page = f"<body><nav><a href=x>Menu</a></nav><{tag}><div id=story>{''.join(f'<p>{b}</p>' for b in body)}<div class=ad>Buy, now!</div></div></{tag.split()[0]}><footer>Foot, text.</footer></body>"
        assert html_extract.main_text(page) == "\n\n".join(body)
    assert [html_extract.main_text(f"<body><{t}>Short text, here.</{t}></body>") for t in ("nav", "form", "footer", "aside")] == [""] * 4
    assert html_extract.main_text(f"<body><div hidden>{' '.join(body)}</div></body>") == ""


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    peaks = []
    for depth in (25_000, 100_000):
        page = "<div class=a>x, y." * depth
        tracemalloc.start()
        assert len(html_extract.main_text(page)) > 4 * depth
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 5 * peaks[0] and peaks[1] < 250e6


def test_extraction(spark, small):
    pages = table(spark, small, "pages")
    for r in html_extract.extract_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" * 20000 + "deep"), (4, "u", "<a " * 5000), (5, "u", "<div>" * 3000 + "x, y." + "</div>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit("odd"))
    assert rows_of(html_extract.extract_main_text(odd, keep=["page_id"]), "page_id", "n_chars")[0] == (1, 0)
    assert html_extract.extract_main_text(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("<>/pa b\"'=&;!-") + ["<p>", "</p>", "<article>", "</div>", "<div class=ad>", "<script>", "<!--", "text, here. "]), max_size=120).map("".join))
def test_extraction_never_fails(page):
    html_extract.main_text(page)


# --- registration


def test_queries_are_registered(spark, small):
    assert [q.split("_")[0] for q in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, small, name):
    import duckdb
    import pyarrow.dataset as ds

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.register(t, ds.dataset(f"{small}/{t}.parquet").to_table())
    got = queries()[name](spark, small)
    want = con.sql(oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    index = [want.columns.index(c) for c in order]
    assert rows_of(got, *order) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=repr)
