"""Text and vector expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"  #: Unicode word characters; Java's and RE2's \w are ASCII only
WORD3 = r"[\p{L}\p{N}_]{3,}"
STRIP = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


SCAN_BLOCK = 256  #: items whose output a scan gathers before it joins the rest


def scan(items: Column, zero: Column, step, emit, element: str) -> Column:
    """Fold over an array that also gives out elements: ``emit(state, item)``, an array, before ``step``.

    Output is gathered by blocks of SCAN_BLOCK items, so long arrays aren't copied at every item.
    ``element`` is the type of what is given out.
    """
    none = F.array().cast(f"array<{element}>")
    one = lambda t, x: F.struct(step(t["state"], x).alias("state"), F.concat(t["out"], emit(t["state"], x)).alias("out"))

    def whole(held: Column) -> Column:
        def block(s: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(held, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), F.struct(s["state"].alias("state"), none.alias("out")), one)
            return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(s["outs"], F.array(p["out"])).alias("outs")))

        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{element}>>").alias("outs"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / SCAN_BLOCK).cast("int"))
        return F.when(F.size(held) > 0, F.flatten(F.aggregate(blocks, start, block, lambda s: s["outs"]))).otherwise(none)

    return let(items, whole)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(c, STRIP, "")


def md5_12(c: Column) -> Column:
    """First 12 hex digits of the MD5 of a text: the content part of every id."""
    return F.substring(F.md5(c.cast("binary")), 1, 12)


def tokens(c: Column) -> Column:
    """Lower-cased word tokens, repeats kept; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens3(c: Column) -> Column:
    """Distinct lower-cased tokens of three characters or more."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD3), F.lit(0))), F.array().cast("array<string>"))


def clean_text(c: Column) -> Column:
    """Drop page-number lines, collapse blanks and runs of empty lines, trim."""
    c = F.regexp_replace(c, r"(?U)^(\d{1,3})\s*\n", "\n")
    c = F.regexp_replace(c, r"(?U)\n\s*\d{1,3}\s*\n", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! ? ; before white space, and at line ends."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?;])\s+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def lexical_overlap(sentence: Column, other: Column) -> Column:
    """Share of the first array's tokens that the second holds; 0 without tokens."""
    n = F.size(sentence)
    return F.when(n > 0, F.size(F.array_intersect(sentence, other)) / n).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def multiply_add(x: Column, y: Column, total: Column) -> Column:
    """``total + x * y`` rounded once, as a fused multiply-add does; for doubles far from overflow.

    The product's error comes from halves of 26 bits (Dekker), the sum's from its parts (Knuth); both go back in.
    """

    def halves(v: Column) -> Column:
        return let(v * 134217729.0, lambda c: let(c - (c - v), lambda high: F.struct(high.alias("high"), (v - high).alias("low"))))

    def added(p: Column, error: Column) -> Column:
        def corrected(s: Column) -> Column:
            return let(s - total, lambda part: s + ((total - (s - part)) + (p - part) + error))

        return let(total + p, corrected)

    def product(p: Column) -> Column:
        error = lambda a, b: ((a["high"] * b["high"] - p) + a["high"] * b["low"] + a["low"] * b["high"]) + a["low"] * b["low"]
        return let(halves(x), lambda a: let(halves(y), lambda b: let(error(a, b), lambda e: added(p, e))))

    return let(x * y, product)


def fused_dot(a: Column, b: Column) -> Column:
    """Inner product in element order with each step rounded once, like DuckDB's ``list_inner_product``.

    Unrounded scores that tie in exact arithmetic then fall alike in both engines.
    """
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: (p["x"] != 0) & (p["y"] != 0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: multiply_add(p["x"], p["y"], s))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """Default offline encoder: token counts in MD5 buckets, L2-normalised.

    The bucket is the first 7 hex digits of the token's MD5 modulo ``dim``, so any engine can
    reproduce it.  A text without tokens gives the zero vector.
    """
    bucket = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int") % dim

    def vector(buckets: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        return let(counts, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))

    return let(F.transform(tokens(c), bucket), vector)
