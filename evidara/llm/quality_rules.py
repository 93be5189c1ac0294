"""Quality rules with risk-controlled thresholds.

Measures of a text (whole text, null is empty) give one badness score: the largest of the rule
values over their scales.  A document is rejected if its score exceeds its stratum's cutoff.

Cutoffs come from labelled documents.  In each stratum the fixed grid of cutoffs is tested from
the loosest to the tightest: a cutoff passes if the exact binomial tail P(Bin(n, alpha) <= k)
is at most delta over the number of strata, where n counts the stratum's good documents and k
those that the cutoff would reject; testing stops at the first failure (fixed-sequence testing
over the grid, Bonferroni over the strata).  So with probability 1 - delta no stratum loses more
than a share alpha of its good documents, however the choice among passed cutoffs is made: the
one that catches most bad documents, the loosest of equals.  A stratum without a passed cutoff,
or whose cutoffs catch nothing, rejects nothing.

Everything is DataFrame expressions.  Only counts per stratum leave the labelled join.

Nulls: a null text has no words; a null stratum is a stratum; null labels and labels of unknown
documents don't count; a document with several labels is good if any of them is (the cautious
reading).  Documents that share a doc_id share its labels; repeated rows are measured and judged
one by one, and count one by one among the labelled.  Scores equal to a cutoff are kept.  Texts
are measured whole: a row needs room for the words and window hashes of its own text.  Columns of
any name are carried by ``keep_good`` and ignored by ``quality_verdicts``; empty tables, of
documents or of labels, give no cutoff and reject by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import WS, let, materialize, words

SYMBOLS = "[#*$%&|<>]"
#: A rule alone makes score 1 where it reaches its scale.
SCALES = {"symbol_rate": 0.15, "capital_rate": 0.5, "bang_rate": 0.5, "dup_line_rate": 0.5, "repeat_rate": 0.5}
GRID = (4.0, 3.0, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
ALPHA, DELTA = 0.02, 0.05
MIN_WORDS = 50
BROADCAST_STRATA = 10_000  #: cutoff tables up to this many rows are broadcast, larger ones joined by shuffle


def _count(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first occurrences included.

    Equal windows have equal hashes, so a text whose window hashes all differ has no repeat;
    only the others sort their windows, as strings.
    """
    spots = F.sequence(F.lit(1), F.size(w) - 2)
    window = lambda i: (F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: x["k"].eqNullSafe(F.get(s, j - 1)["k"]) | x["k"].eqNullSafe(F.get(s, j + 1)["k"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

    sorted_windows = F.sort_array(F.transform(spots, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("i"))))
    hashes = F.transform(spots, lambda i: F.xxhash64(*window(i)))
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(differ, F.lit(0).cast("long")).otherwise(covered(let(sorted_windows, starts)))


def measures(text: Column) -> Column:
    """Struct of the counts that rules use."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def with_words(w: Column) -> Column:
            return let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    _count(t, SYMBOLS).alias("n_symbols"),
                    F.size(ls).cast("long").alias("n_lines"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).alias("n_repeat_words"),
                    _count(t, r"\p{Lu}").alias("n_capitals"),
                    _count(t, "!").alias("n_bangs"),
                ),
            )

        return let(words(t), with_words)

    return let(F.coalesce(text, F.lit("")), of)


def with_score(rows: DataFrame) -> DataFrame:
    """Add base_failed and score to rows that have the measures."""
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    rates = {
        "symbol_rate": share("n_symbols", "n_words"),
        "capital_rate": share("n_capitals", "word_chars"),
        "bang_rate": share("n_bangs", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
    }
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("score", F.greatest(*[rates[k] / F.lit(v) for k, v in SCALES.items()]))


def calibrate(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, cutoff, n_good): one row for each stratum of ``scored``; cutoff may be null.

    ``scored`` has doc_id, the stratum column, base_failed and score.  Documents that fail the
    base rules are outside the risk: the cutoff never decides on them.
    """
    if not 0 < alpha < 1 or not 0 < delta < 1:
        raise ValueError("alpha and delta must be in (0, 1)")
    grid = tuple(sorted(grid, reverse=True))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    # Base failures count nothing instead of being filtered out: a filter would be pushed below the
    # projection and measure every text twice.
    tried = scored.select("doc_id", F.col(stratum).alias("stratum"), F.when(~F.col("base_failed"), F.col("score")).alias("score"))
    # Null doc_ids meet no label; a salt keeps them from being joined in one task.
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 4096).otherwise(0)
    held = tried.withColumn("_salt", salt).join(good.withColumn("_salt", F.lit(0).cast("long")), ["doc_id", "_salt"], "left").withColumn("good", F.when(F.col("score").isNotNull(), F.col("good")))
    over = [F.array(F.sum(((F.col("good") == 1) & (F.col("score") > c)).cast("long")), F.sum(((F.col("good") == 0) & (F.col("score") > c)).cast("long"))) for c in grid]
    counts = held.groupBy("stratum").agg(F.count("score").alias("n_tried"), F.sum((F.col("good") == 1).cast("long")).alias("n_good"), F.array(*over).alias("over"))
    counts = counts.where("n_tried > 0")
    # A window over one row a stratum; joining their count would run the whole plan a second time.
    counts = counts.withColumn("n_strata", F.count(F.lit(1)).over(Window.partitionBy()))
    tests = counts.select("stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.posexplode("over").alias("pos", "o"), (F.lit(delta) / F.col("n_strata")).alias("level"))
    tests = tests.select(
        "stratum", "n_good", "pos", F.array(*[F.lit(c) for c in grid])[F.col("pos")].alias("cutoff"), F.coalesce(F.col("o")[0], F.lit(0)).alias("lost"), F.coalesce(F.col("o")[1], F.lit(0)).alias("caught"), "level"
    )
    tests = tests.withColumn("passed", (F.col("n_good") > 0) & (binomial_tail(F.col("n_good"), F.col("lost"), alpha) <= F.col("level")))
    by_stratum = tests.groupBy("stratum").agg(F.min(F.when(~F.col("passed"), F.col("pos"))).alias("stop"), F.first("n_good").alias("n_good"), F.collect_list(F.struct("pos", "cutoff", "caught")).alias("all"))
    usable = F.filter("all", lambda x: (F.col("stop").isNull() | (x["pos"] < F.col("stop"))) & (x["caught"] > 0))
    best = F.array_max(F.transform(usable, lambda x: F.struct(x["caught"], (-x["pos"]).alias("loose"), x["cutoff"])))
    return by_stratum.select("stratum", best["cutoff"].alias("cutoff"), "n_good")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term; 1 where k >= n * p, whose tail is never small.

    A cutoff passes exactly if the Clopper-Pearson upper bound at that level is at most p.
    """
    import math

    ratio = math.log(p) - math.log1p(-p)
    zero = F.struct((n * F.lit(math.log1p(-p))).alias("t"), F.exp(n * F.lit(math.log1p(-p))).alias("sum"))
    step = lambda a, j: a["t"] + F.log((n - j + 1) / j) + F.lit(ratio)
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, lambda a, j: F.struct(step(a, j).alias("t"), (a["sum"] + F.exp(step(a, j))).alias("sum")), lambda a: a["sum"])
    return F.when(k >= n * F.lit(p), 1.0).when(k == 0, zero["sum"]).otherwise(total)


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add stratum's cutoff and kept; the small cutoff table is broadcast if its size allows."""
    cutoffs = materialize(cutoffs)
    side = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoff")
    if cutoffs.count() <= BROADCAST_STRATA:
        side = F.broadcast(side)
    joined = scored.drop("cutoff").join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("score") <= F.col("cutoff"))))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, measures, base_failed, score, cutoff, kept of every document; no texts."""
    measured = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col("text")).alias("m"))
    scored = materialize(with_score(measured.select("doc_id", "stratum", "m.*")))
    return judge(scored, calibrate(scored, labels, "stratum", alpha, delta), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, in one pass without a shuffle.

    The calibration reads the texts once and keeps only counts; the verdict is then computed
    where the row is, so no text is shuffled and repeated doc_ids cannot be mixed up.
    """
    scored = lambda d: with_score(d.select("*", F.col("_m.*")))
    one = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col("text")).alias("_m"))
    cutoffs = calibrate(scored(one), labels, "stratum", alpha, delta)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(stratum).alias("_lang"), measures(F.col("text")).alias("_m"))
    # As above: the lambda keeps the verdict from being split and half of it pushed below the join.
    return judge(scored(rows), cutoffs, "_lang").where(let(F.col("kept"), lambda k: k)).select("_row.*")
