"""Overlap chunking: greedy windows with a word-boundary cut, as one fold per document, linear in its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.text import let, md5_12

#: The standard configurations (size, overlap, label).
CONFIGS = ((512, 64, "small"), (1024, 128, "medium"), (2048, 256, "large"))


def check_parameters(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need size > 0 and 0 <= overlap < size, got {size} and {overlap}")


BLOCK, ROUNDS = 1 << 15, 512  #: characters that a fold looks at at a time, and windows that it cuts there at most
PART = 1 << 20  #: characters of the parts that blocks are cut from


def _blocks(t: Column, n: Column, width: int) -> Column:
    """A text of ``n`` characters cut every ``width``; first into long parts, as every substring counts from the front.

    Not by a regular expression: where characters of one and two code units alternate, Java's ``.{1,n}`` recurses.
    """
    part = width * max(1, PART // width)
    cut = lambda x, m, w: F.transform(F.sequence(F.lit(0), F.floor((m - 1) / w).cast("int")), lambda i: F.substring(x, i * w + 1, F.lit(w)))
    return F.flatten(F.transform(cut(t, n, part), lambda x: cut(x, F.length(x), width)))


def pieces(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, stop, text) of a text's chunks, offsets in code points; empty text has none.

    A window is cut back to its last space if that lies past its middle and the window ends
    inside the text.  The next window starts ``overlap`` before the unclamped end, so a tail
    wholly inside the last chunk can follow; that is part of the rule.

    The text is cut once, into blocks of some thousand characters: the fold over a block's windows
    looks only at the block and at what a window may need of the next one, so time is in proportion
    to the text's length up to some hundred megabytes.
    """
    check_parameters(size, overlap)
    least_step = max(1, size // 2 + 1 - overlap)
    width = max(size, min(BLOCK, ROUNDS * least_step))
    piece = "array<struct<start:int,stop:int,text:string>>"

    def fold(t: Column, n: Column) -> Column:
        def within(block: Column, first: Column, start: Column) -> Column:
            """Windows that start in the block whose first character is ``first``."""

            def step(state: Column, _: Column) -> Column:
                def cut(w: Column) -> Column:
                    at = state["start"]
                    back = F.locate(" ", F.reverse(w))
                    space = F.when(back > 0, F.lit(size) - back).otherwise(F.lit(-1))

                    def advance(end: Column) -> Column:
                        made = F.struct(at.alias("start"), F.least(end, n).alias("stop"), F.substring(w, F.lit(1), end - at).alias("text"))
                        return F.struct(F.greatest(end - overlap, at + 1).alias("start"), F.concat(state["out"], F.array(made)).alias("out"))

                    return let(F.when((at + size < n) & (space > 0) & (2 * space > size), at + space).otherwise(at + size), advance)

                here = state["start"] < F.least(n, first + width)
                return F.when(here, let(F.substring(block, state["start"] - first + 1, F.lit(size)), cut)).otherwise(state)

            rounds = F.sequence(F.lit(1), F.lit(-(-width // least_step) + 1))
            return F.aggregate(rounds, F.struct(start.alias("start"), F.array().cast(piece).alias("out")), step)

        def over(blocks: Column) -> Column:
            def one(state: Column, i: Column) -> Column:
                block = F.concat(F.get(blocks, i), F.coalesce(F.substring(F.get(blocks, i + 1), 1, size), F.lit("")))
                done = let(block, lambda x: within(x, i * width, state["start"]))
                return let(done, lambda d: F.struct(d["start"].alias("start"), F.concat(state["outs"], F.array(d["out"])).alias("outs")))

            start = F.struct(F.lit(0).alias("start"), F.array().cast(f"array<{piece}>").alias("outs"))
            return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), start, one, lambda s: s["outs"]))

        many = let(_blocks(t, n, width), over)
        one = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop"), t.alias("text")))
        return F.when(n <= 0, F.array().cast(piece)).when(n <= size, one).otherwise(many)

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.length(t), lambda n: fold(t, n)))


def spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, stop) of a text's chunks, as ``pieces`` cuts them."""
    return F.transform(pieces(text, size, overlap), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def chunk_units(units: DataFrame, size: int = 1024, overlap: int = 128, drop_contained_tail: bool = False) -> DataFrame:
    """One row a chunk: the unit's columns, chunk_id, chunk_index, char_offset, n_chars, text.

    ``drop_contained_tail`` leaves out tails that lie wholly inside the chunk before them.
    """
    rest = [c for c in units.columns if c not in ("text", "chunk_id", "chunk_index", "char_offset", "n_chars")]
    s = pieces(F.col("text"), size, overlap)
    if drop_contained_tail:
        s = let(s, lambda a: F.filter(a, lambda x, i: F.coalesce(x["stop"] > F.get(a, i - 1)["stop"], F.lit(True))))
    # outer, as an inner one gets a filter on the array's size that cuts every text again
    cut = units.select(*rest, F.posexplode_outer(s).alias("chunk_index", "s")).where("chunk_index is not null")
    made = cut.select(*rest, "chunk_index", F.col("s.start").alias("char_offset"), (F.col("s.stop") - F.col("s.start")).alias("n_chars"), F.col("s.text").alias("text"))
    cid = F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"), F.lit("_"), md5_12(F.col("text")))
    return made.select(cid.alias("chunk_id"), *rest, "chunk_index", "char_offset", "n_chars", "text")


def contained_tails(units: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index) of the chunks that lie wholly inside the one before."""
    s = let(spans(F.col("text"), size, overlap), lambda a: F.filter(F.transform(a, lambda x, i: F.struct(i.alias("chunk_index"), (x["stop"] <= F.get(a, i - 1)["stop"]).alias("inside"))), lambda x: x["inside"]))
    return units.select("doc_id", F.explode(s).alias("s")).select("doc_id", "s.chunk_index")


HEAD, FEW = 8, 16  #: characters by which places for an overlap are found, and how many of them are tried one by one
#: (modulus, base) of the two hashes by which a suffix and a prefix are compared.
HASHES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


def real_overlap(previous: Column, current: Column) -> Column:
    """Length of the longest suffix of one text that is a prefix of the next.

    Places where the next text's first HEAD characters occur are tried from left to right, so the first that
    fits is the longest; shorter overlaps are tried by length.  Where a text repeats itself, so that HEAD occurs
    more than FEW times without overlapping, one fold over the lengths takes its place, linear in the shorter
    text: the suffix grows at its front and the prefix at its end, each by a step of two polynomial hashes,
    and the longest length at which all agree is compared as text.  Should that fail, by a collision in 62
    bits, lengths are tried one by one.
    """

    def tried(a: Column, b: Column, longest: Column, times: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            at = F.call_function("locate", F.substring(b, 1, HEAD), a, s["from"])
            n = F.length(a) - at + 1
            fits = F.substring(a, at, n) == F.substring(b, F.lit(1), n)
            return F.when(s["best"] >= 0, s).otherwise(let(F.struct(at.alias("at"), fits.alias("fits"), n.alias("n")), lambda t: F.struct((t["at"] + 1).alias("from"), F.when(t["at"] == 0, 0).when(t["fits"], t["n"]).otherwise(-1).alias("best"))))

        start = F.struct(F.greatest(F.lit(1), F.length(a) - longest + 1).alias("from"), F.lit(-1).alias("best"))
        # each place found without overlap hides HEAD - 1 others at most; one more step finds no place
        long = F.aggregate(F.sequence(F.lit(0), HEAD * times), start, step, lambda s: F.greatest(s["best"], F.lit(0)))
        short = F.filter(F.sequence(F.lit(1), F.least(longest, F.lit(HEAD - 1))), lambda n: F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.lit(1), n))
        return let(F.when(longest >= HEAD, long).otherwise(F.lit(0)), lambda n: F.when(n > 0, n).otherwise(F.coalesce(F.array_max(short), F.lit(0))))

    def found(a: Column, b: Column, longest: Column) -> Column:
        suffix, prefix = F.substring(a, F.length(a) - longest + 1, longest), F.substring(b, F.lit(1), longest)
        steps = F.zip_with(F.split(F.reverse(suffix), ""), F.split(prefix, ""), lambda x, y: F.struct(F.ascii(x).cast("long").alias("x"), F.ascii(y).cast("long").alias("y")))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        hashes = [F.struct(one.alias("power"), none.alias("suffix"), none.alias("prefix")).alias(f"h{i}") for i in range(len(HASHES))]
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("best"), *hashes)

        def grown(h: Column, s: Column, modulus: int, base: int) -> Column:
            return F.struct((h["power"] * base % modulus).alias("power"), ((h["suffix"] + s["x"] * h["power"]) % modulus).alias("suffix"), ((h["prefix"] * base + s["y"]) % modulus).alias("prefix"))

        def step(state: Column, s: Column) -> Column:
            made = F.struct(*[grown(state[f"h{i}"], s, *h).alias(f"h{i}") for i, h in enumerate(HASHES)])

            def judged(m: Column) -> Column:
                same = m["h0"]["suffix"] == m["h0"]["prefix"]
                for i in range(1, len(HASHES)):
                    same = same & (m[f"h{i}"]["suffix"] == m[f"h{i}"]["prefix"])
                n = state["n"] + 1
                return F.struct(n.alias("n"), F.when(same, n).otherwise(state["best"]).alias("best"), *[m[f"h{i}"].alias(f"h{i}") for i in range(len(HASHES))])

            return let(made, judged)

        fits = lambda n: F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.lit(1), n)
        slow = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), longest), fits)), F.lit(0))
        return let(F.aggregate(steps, start, step, lambda s: s["best"]), lambda n: F.when((n == 0) | fits(n), n).otherwise(slow))

    longest = F.least(F.length(previous), F.length(current))
    end = lambda n: F.substring(previous, F.length(previous) - n + 1, n)
    times = lambda n: F.when(n >= HEAD, F.floor((n - F.length(F.replace(end(n), F.substring(current, 1, HEAD), F.lit("")))) / HEAD).cast("int")).otherwise(F.lit(0))
    either = lambda n: let(times(n), lambda t: F.when(t <= FEW, tried(previous, current, n, t)).otherwise(found(previous, current, n)))
    return F.when(longest > 0, let(longest, either)).otherwise(F.lit(0))


def overlaps(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, overlap) of every chunk but a document's first."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    pairs = chunks.withColumn("before", F.lag("text").over(w)).where("before is not null")
    return pairs.select("doc_id", "chunk_index", real_overlap(F.col("before"), F.col("text")).alias("overlap"))


def compare_configs(units: DataFrame, configs=CONFIGS) -> DataFrame:
    """One row a configuration: counts, lengths, fragmentation and mean real overlap.

    The fragmented share is of all units, empty ones included; averages are rounded half-even.
    """

    def measured(size: int, overlap: int) -> Column:
        """Of a unit's chunks: number, characters, longest, shortest, and the sum of the real overlaps."""

        def of(p: Column) -> Column:
            lengths = F.transform(p, lambda x: x["stop"] - x["start"])
            shared = F.transform(F.filter(F.transform(p, lambda x, i: F.struct(F.get(p, i - 1)["text"].alias("a"), x["text"].alias("b"))), lambda x: x["a"].isNotNull()), lambda x: real_overlap(x["a"], x["b"]).cast("long"))
            total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, v: t + v)
            return let(lengths, lambda n: F.struct(F.size(p).cast("long").alias("k"), total(n).alias("chars"), F.array_max(n).alias("longest"), F.array_min(n).alias("shortest"), total(shared).alias("shared")))

        return let(pieces(F.col("text"), size, overlap), of)

    # one pass for all configurations: texts are cut once each and neither exploded nor shuffled
    each = units.select(*[measured(size, overlap).alias(f"c{i}") for i, (size, overlap, _) in enumerate(configs)])
    sums = lambda i: F.struct(F.coalesce(F.sum(f"c{i}.k"), F.lit(0)).alias("k"), F.sum(f"c{i}.chars").alias("chars"), F.max(f"c{i}.longest").alias("longest"), F.min(f"c{i}.shortest").alias("shortest"), F.coalesce(F.sum((F.col(f"c{i}.k") > 1).cast("long")), F.lit(0)).alias("fragmented"), F.sum(F.greatest(F.col(f"c{i}.k") - 1, F.lit(0))).alias("pairs"), F.sum(f"c{i}.shared").alias("shared"))
    named = [F.struct(F.lit(label).alias("label"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.col(f"s{i}").alias("s")) for i, (size, overlap, label) in enumerate(configs)]
    rows = each.agg(F.count(F.lit(1)).alias("n_units"), *[sums(i).alias(f"s{i}") for i in range(len(configs))]).select("n_units", F.explode(F.array(*named)).alias("r"))
    mean = lambda total, n: F.when(n > 0, total / n).otherwise(0.0)
    return rows.select(
        "r.label",
        "r.size",
        "r.overlap",
        F.col("r.s.k").alias("total_chunks"),
        F.bround(mean(F.col("r.s.chars"), F.col("r.s.k")), 1).alias("avg_chunk_len"),
        F.coalesce("r.s.longest", F.lit(0)).alias("max_chunk_len"),
        F.coalesce("r.s.shortest", F.lit(0)).alias("min_chunk_len"),
        F.col("r.s.fragmented").alias("fragmented_units"),
        F.bround(mean(F.col("r.s.fragmented"), F.col("n_units")) * 100, 1).alias("fragmentation_pct"),
        F.bround(mean(F.col("r.s.shared"), F.col("r.s.pairs")), 1).alias("avg_real_overlap"),
    )
