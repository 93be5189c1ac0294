"""Hard cases that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + (str(x % 997) if x % 3 else "") + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def hard_rows():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    return [
        (0, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, " ".join(near), "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n\x0b\x0c\r ", "de", None, 0),
        (6, "one", "en", "b", 3),
        (7, "Ünï cödé \U0001f600 日本語 a\u00a0b", "fr", "c", 1),
        (8, prose(60_000, 3), "en", "c", 9),
        (9, "line of words here\n" * 40, "en", "a", 2),
        (9, "line of words here\n" * 40, "en", "a", 2),
        (None, prose(70, 5), "en", "c", 5),
        (10, "### $$$ *** " * 60 + prose(60, 6), "en", "a", 7),
        (11, "x" * 20_000, "es", "c", 7),
    ]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(hard_rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same with extra columns named like outputs."""
    from pyspark.sql import functions as F

    extra = ["fp", "size", "shard", "n_tokens", "kept", "score", "stratum", "cutoff", "component_id", "copies", "h", "rate", "m", "hash", "node", "sketch", "target", "path", "_row", "n_bytes", "ids_sha256", "base_failed", "tie", "part"]
    return docs.select("*", *[F.lit(f"odd {c}").alias(c) for c in extra])
