"""Units that are read once aren't written, and the text functions keep their results without cutting every text into words."""

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import text as T


@pytest.mark.parametrize("name", ["narration_units", "unit_timeline", "narration_totals", "chapter_islands", "cache_hits"])
def test_units_are_not_written(spark, name):
    kept = lambda: {t.name for t in spark.catalog.listTables(pattern="lectern_units_*")}
    before = kept()
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns
    assert kept() == before


def test_blanks_and_stops(spark):
    text = "\u2003One\t two.\x01  Dr. No\u00a0 said: “Go!”  J. B. left… \x85Now. www at https://www.a.b/c\n"
    row = spark.createDataFrame([(text,)], "text string").select(T.inline("text").alias("i"), T.sentences("text").alias("s")).first()
    assert row.i == "One two.\x01 Dr. No said: “Go!” J. B. left… Now. www at https://www.a.b/c"
    assert row.s == ["One\t two.", "Dr. No\u00a0 said: “Go!”", "J. B. left…", "Now.", "www at https://www.a.b/c"]
    said = T.with_speech(spark.createDataFrame([(text,), ("=\u200b",), (None,)], "text string")).select("spoken", F.size("repairs").alias("n")).collect()
    assert [tuple(r) for r in said] == [('One two.\x01 Dr. No said: "Go!" J. B. left... Now. www at a dot b slash c', 5), ("equals", 2), ("", 0)]
