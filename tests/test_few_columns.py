"""Queries write of the units what they read, and short ways give the results of the long ones."""

from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import text as T
from lectern.plans import narration


def test_pieces_are_chunks(spark):
    texts = ["", " ", "a", " a", "a ", "a  b", "a b", "a\tb", "x" * 9, "word " * 5 + "end", "a b", "é ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(T.pieces("text", 8).alias("short"), T.chunks("text", 8).alias("long")).collect()
    assert all(r.short == r.long for r in rows)


def test_units_are_written_with_few_columns(spark):
    kept = lambda: {t.name for t in spark.catalog.listTables(pattern="lectern_units_*")}
    before = kept()
    queries.manifest_counts(spark, "/root/testdata/sf0.001")
    assert [spark.table(n).columns for n in kept() - before] == [["book_id", "unit_ord", "text"]]


def test_section_cues_keep_their_order(spark):
    lib, plan, _ = queries.planned(spark, "/root/testdata/sf0.001")
    listed = lambda cues: [tuple(r) for r in cues.filter(F.col("cue_id").startswith("section:")).orderBy("book_id", "cue_ord").select("book_id", "cue_id", "kind", "unit_start", "unit_end").collect()]
    assert listed(narration.section_cues(plan.units, narration.pruned(lib.sections)[0])) == listed(plan.cues)
