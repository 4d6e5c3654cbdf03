import random

import pytest

#: Columns whose names the operators use for their own.
CLASHING = ["code", "size", "key", "id", "unit", "spans", "row", "rows", "fingerprint", "n_words", "starts", "stops", "base", "all", "scan", "rate", "target", "piece", "copies", "held_out", "score", "kind", "bucket", "rank"]


def words(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "in", "ed", "É", "ß"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with nulls, blanks, copies, near copies, a very long text and repeated rows."""
    rng = random.Random(4)
    base = words(rng, 120)
    passage = words(rng, 60)
    out = [(k, words(rng, rng.randint(1, 90)), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for k in range(40)]
    out += [(100 + k, base, "en", "a") for k in range(6)]
    out += [(110 + k, base.replace(" ", "  \t", k) + (" tail" if k % 2 else ""), "en", "a") for k in range(6)]
    out += [(120, f"{words(rng, 20)} {passage} {words(rng, 9)}", "en", "b"), (121, f"{words(rng, 3)} {passage}", "en", "b"), (122, passage + " x " + passage, "en", "b")]
    out += [(130, None, "en", "c"), (131, "", None, "c"), (132, " \n\t ", "en", None), (133, "one", "en", "c"), (134, "one two", "en", "c"), (135, "123 !!", "en", "c"), (136, "a b", "en", "c")]
    out += [(140, words(rng, 30_000), "de", "z"), (None, "no id here at all", "en", "z"), (None, None, None, None), (7, out[7][1], out[7][2], out[7][3]), (7, "another text with the id of one above", "en", "b")]
    return out


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)], F.char_length("text").cast("long").alias("n_chars")).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
