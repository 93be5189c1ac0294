"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) take the weights in turn and share all words;
a target stops at ``most`` times its source's size and the excess is shared anew by weight
(water filling, decided in whole numbers; its windows run over one row a source).

Rates: the document rates r minimise the entropy sum(r log r - r + 1) relative to one copy each,
under the token constraints sum(r * size) = target, one a source, and r <= most.  The convex dual
has one multiplier a source, and its solution tilts every document exponentially,
r = min(most, exp(multiplier * size / mean size)): a source that must shrink gives up its long
documents first, one that must grow repeats them first.  Newton iterations solve the dual for all
sources at once: a round sums gradient and curvature over the documents where they lie and takes
the step in the small table of multipliers, which keeps a bracket of each root and halves it when
a step would leave it.  Documents of about one size share a rate: the sums run over cells of
(source, band), where a band keeps the BAND_BITS leading bits of the size.  So a source has at
most a few thousand cells (256 for each doubling of the size) however many documents it holds.

Copies: rates are rounded to whole copies for each cell, largest sizes first, carrying the error
on, so a source misses its target by less than its sizes allow at the small end.  In a cell the
documents with the least hashes get the extra copy.  The limit hash comes from counts of hash
buckets and a rank inside one bucket, so no cell is ever gathered.  Where it falls among equal
rows, these are counted as one, and as many of them get the extra copy as still may.

Reruns agree: sums are exact (whole multiples of 2**-30 words), and nothing depends on
partitioning.  Null and empty texts have size 0 and rate 1; a null source is a source; a null
doc_id is like any other; very long texts only make their source coarser to round.  Extra columns
are carried (``apply_mix``) or left out (``mix``) and may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import materialize, ship_by_value, words

WEIGHTS = (5, 2, 1)
MOST = 3
BAND_BITS = 9  #: leading bits of a size that tell bands apart; sizes below 2**BAND_BITS are bands of their own
TOLERANCE = 1e-9  #: share of the target by which the words of a source's rates may miss it
BROADCAST_BYTES = 16 << 20  #: decision tables up to this size are broadcast, larger ones joined by shuffle
CHUNK = 1000  #: equal rows made in one go


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; nulls count and so does their place."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        simple = not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)
        parts += [c.isNull(), c if simple else F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})]
    return F.xxhash64(*parts)


def band_of(size: Column) -> Column:
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - BAND_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def is_small(df: DataFrame, wide: str = "source", columns: int = 8) -> bool:
    """Whether up to so many columns of ``df`` may be broadcast; ``wide`` is the only one of any length."""
    n, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0))).first()
    return chars + 16 * (columns + 2) * n <= BROADCAST_BYTES


def held(df: DataFrame, wide: str = "source") -> DataFrame:
    """``df`` with a broadcast hint if its bytes allow."""
    return F.broadcast(df) if is_small(df, wide, len(df.columns)) else df


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.array(*[F.lit(int(w)) for w in weights])[F.pmod(place, F.lit(len(weights)))].cast("long")).withColumn("cap", F.col("source_size") * most)
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("w_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("at", F.row_number().over(fills))
    wide = "decimal(38,0)"
    full = F.col("cap").cast(wide) * F.col("w_left").cast(wide) <= F.col("weight").cast(wide) * F.col("left").cast(wide)
    open_ = F.min(F.when(~full, F.struct("at", "left", "w_left"))).over(whole)
    per = per.withColumn("first_open", open_)
    share = F.col("weight") * F.col("first_open.left") / F.col("first_open.w_left")
    target = F.when(F.col("first_open").isNull() | (F.col("at") < F.col("first_open.at")), F.col("cap").cast("double")).otherwise(share.cast("double"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def cells_of(sizes: DataFrame) -> DataFrame:
    """(source, band, n, words) from rows of (source, size, band)."""
    return sizes.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))


def _same(left: str, right: str, *also: str) -> Column:
    on = F.col(f"{left}source").eqNullSafe(F.col(f"{right}source"))
    for c in also:
        on = on & (F.col(f"{left}{c}") == F.col(f"{right}{c}"))
    return on


def _exact(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: whole multiples of 2**-30."""
    return F.sum((value * float(1 << 30)).cast("decimal(38,0)")).cast("double") / float(1 << 30)


def _tilted(most: int) -> Column:
    return F.exp(F.least(F.col("lam") * F.col("phi"), F.lit(math.log(most))))


def balance(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, mean, fixed, lam): the multipliers of all sources by Newton's method on the dual.

    ``fixed`` is the rate of a source whose target leaves no choice (nothing, all at ``most``, or
    no words); lam is then null.  Rounds go on until every source meets its target within
    TOLERANCE or its bracket holds no further number, which halving ends in any case.
    """
    ratio = F.col("target") / F.col("source_size")
    fixed = F.when(F.col("source_size") <= 0, 1.0).when(F.col("target") <= 0, 0.0).when(ratio >= most * (1 - 1e-12), float(most))
    start = targets.withColumn("fixed", fixed).select(
        "source", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), "fixed", F.when(F.col("fixed").isNull(), F.log(ratio)).alias("lam"),
        F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.col("fixed").isNotNull().alias("done"),
    )
    state = materialize(start, 1)
    hint = F.broadcast if is_small(state) else (lambda df: df)  # the tables of a round have a row a source, too
    while state.where("not done").limit(1).count():
        now = state.where("not done").select(F.col("source").alias("t_source"), "mean", "lam")
        met = cells.join(hint(now), _same("", "t_")).withColumn("phi", F.col("words") / F.col("n") / F.col("mean"))
        got = F.col("words") * _tilted(most)
        free = F.col("lam") * F.col("phi") < math.log(most)
        sums = met.groupBy("source").agg(_exact(got).alias("f"), _exact(F.when(free, got * F.col("phi")).otherwise(0.0)).alias("d")).withColumnRenamed("source", "s_source")
        both = state.join(hint(sums), _same("", "s_"), "left")
        gap = F.col("f") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        both = both.select("source", "target", "mean", "fixed", "lam", "done", "f", "d", gap.alias("gap"), low.alias("low"), high.alias("high"))
        # Newton's step for log(f): the same root, and far fewer steps where f grows exponentially
        step = F.col("lam") + F.when(F.col("d") > 0, (F.log("target") - F.log("f")) * F.col("f") / F.col("d"))
        middle = F.when(F.col("low") == -math.inf, 2 * F.col("lam") - 1).when(F.col("high") == math.inf, 2 * F.col("lam") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        settled = (F.abs("gap") <= TOLERANCE * F.col("target") + 1e-6) | (moved <= F.col("low")) | (moved >= F.col("high"))
        both = both.withColumn("ends", F.col("done") | settled)
        state = materialize(both.select("source", "target", "mean", "fixed", F.when(F.col("ends"), F.col("lam")).otherwise(moved).alias("lam"), "low", "high", F.col("ends").alias("done")), 1)
    return state.select("source", "mean", "fixed", "lam")


def cell_rates(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, band, n, words, target, rate) of every cell."""
    of = balance(cells, targets, most).join(targets.select(F.col("source").alias("t_source"), "target"), _same("", "t_")).withColumnRenamed("source", "b_source").drop("t_source")
    met = cells.join(held(of, "b_source"), _same("", "b_")).withColumn("phi", F.col("words") / F.col("n") / F.col("mean"))
    rate = F.coalesce(F.when(F.col("words") == 0, 1.0), "fixed", F.least(F.lit(float(most)), _tilted(most)))
    return met.select("source", "band", "n", "words", "target", rate.alias("rate"))


def whole_copies(size, n, rates, target: float, most: int = MOST):
    """Copies for each cell, near n * rate, whose words add up to about the target."""
    import numpy as np

    z, n, r = np.asarray(size), np.asarray(n), np.asarray(rates)
    out = np.zeros(len(z), dtype=np.int64)
    order = np.argsort(-z, kind="stable")
    carry = 0.0
    for c in order:
        ideal = float(n[c]) * float(r[c])
        extra = carry / z[c] if z[c] else 0.0
        out[c] = int(min(most * n[c], max(0, np.floor(ideal + extra + 0.5))))
        carry += (ideal - out[c]) * float(z[c])
    rest = target - float((out * z).sum())
    for c in order:  # what clipping left over
        if z[c] and abs(rest) >= z[c] / 2:
            k = int(np.clip(np.floor(rest / z[c] + 0.5), -out[c], most * n[c] - out[c]))
            out[c] += k
            rest -= k * float(z[c])
    return out


def plan_copies(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, band, rate, base, last_hash, take, equal): how the rows of a cell are repeated.

    A row gets ``base`` copies, and one more if its hash is below ``last_hash``; of the ``equal``
    rows that have just this hash, ``take`` get one more.  ``sizes`` has (source, size, band, h).
    """
    cells = materialize(cells_of(sizes), 1)
    rated = cell_rates(cells, targets, most)

    def solve(part: pd.DataFrame) -> pd.DataFrame:  # one source: a few thousand bands at most
        part = part.sort_values("band")
        copies = whole_copies((part["words"] / part["n"]).to_numpy(), part["n"].to_numpy(), part["rate"].to_numpy(), float(part["target"].iloc[0]), most)
        return pd.DataFrame({"source": part["source"], "band": part["band"], "n": part["n"], "rate": part["rate"], "copies": copies})

    solved = materialize(rated.groupBy("source").applyInPandas(solve, "source string, band long, n long, rate double, copies long"), 1)
    solved = solved.withColumn("base", F.expr("cast(copies div n as int)")).withColumn("extra", F.expr("copies % n"))
    some = held(solved.where("extra > 0").select(F.col("source").alias("s_source"), F.col("band").alias("s_band"), "extra"), "s_source")
    hist = sizes.groupBy("source", "band", F.expr("shiftright(h, 48)").alias("bucket")).agg(F.count(F.lit(1)).alias("m"))
    running = Window.partitionBy("s_source", "s_band").orderBy("bucket")
    ranked = hist.join(some, _same("", "s_", "band")).withColumn("upto", F.sum("m").over(running))
    edge = ranked.where("upto >= extra and upto - m < extra").select("s_source", "s_band", F.col("bucket").alias("s_bucket"), (F.col("extra") - F.col("upto") + F.col("m")).alias("need"))
    edge = held(materialize(edge, 1), "s_source")
    inside = sizes.withColumn("bucket", F.expr("shiftright(h, 48)")).join(edge, _same("", "s_", "band", "bucket"))
    equal = inside.groupBy("s_source", "s_band", "need", "h").agg(F.count(F.lit(1)).alias("equal"))  # equal rows are one here
    upto = equal.withColumn("upto", F.sum("equal").over(Window.partitionBy("s_source", "s_band").orderBy("h")))
    limit = upto.where("upto >= need and upto - equal < need").select("s_source", "s_band", F.col("h").alias("last_hash"), (F.col("need") - F.col("upto") + F.col("equal")).alias("take"), "equal")
    return materialize(solved.join(limit, _same("", "s_", "band"), "left").select("source", "band", "rate", "base", "last_hash", "take", "equal"), 1)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add rate and copies to rows that have source, band and h."""
    side = held(plan.select(F.col("source").alias("p_source"), F.col("band").alias("p_band"), "rate", "base", "last_hash", "take", "equal"), "p_source")
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("band") == F.col("p_band")), "left")
    torn = F.coalesce((F.col("h") == F.col("last_hash")) & (F.col("take") < F.col("equal")), F.lit(False))
    more = F.coalesce(F.col("h") <= F.col("last_hash"), F.lit(False)).cast("int")
    out = joined.where(~torn).withColumn("copies", (F.col("base") + more).cast("int")).select(*rows.columns, "rate", "copies")
    if not plan.where("take < equal").limit(1).count():
        return out
    # Equal rows of which only some get the extra copy: one stands for all, and they are made anew.
    keys = ["source", "band", "h"]
    carried = [c for c in [*rows.columns, "rate", "base", "take"] if c not in keys]
    one = joined.where(torn).groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], F.count(F.lit(1)).alias("m"))
    chunks = one.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}")))).repartition("chunk", "h")
    each = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("m"), (F.col("chunk") + 1) * CHUNK))))
    made = each.select(*rows.columns, "rate", (F.col("base") + (F.col("i") <= F.col("take")).cast("int")).cast("int").alias("copies"))
    return out.unionByName(made)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, band, h of every document; one narrow pass over the texts."""
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), row_hash(docs).alias("h"))
    return rows.withColumn("band", band_of(F.col("size")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    rows = materialize(sized(docs))
    targets = materialize(source_targets(rows, weights, most), 1)  # the windows over all sources leave one partition
    out = with_copies(rows, plan_copies(rows, targets, most))
    side = held(targets.select(F.col("source").alias("t_source"), "source_size", "target"), "t_source")
    out = out.join(side, F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to ``most`` times)."""
    rows = materialize(sized(docs))
    plan = plan_copies(rows, materialize(source_targets(rows, weights, most), 1), most)
    marked = docs.select(F.struct(*docs.columns).alias("_row"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), row_hash(docs).alias("h"))
    times = with_copies(marked.withColumn("band", band_of(F.col("size"))), plan).where("copies > 0")
    return times.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


ship_by_value(__name__)
