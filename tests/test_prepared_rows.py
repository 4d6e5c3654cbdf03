"""Preflight finds all of a sentence in its row: no word is a row, moves or is written."""

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import phonemes as P
from lectern.operators import prepare

UNITS = "book_id string, unit_ord long, unit_id string, section_id string, text string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_stay_in_their_row(spark):
    units = spark.createDataFrame([("b", 0, "u0", "s", "the Café. A-b 12!")], UNITS)
    lexicon = spark.createDataFrame([("the", "ðə")], "word string, phonemes string")
    made = prepare.prepare(units, lexicon, spark.createDataFrame([(0, "twelve", "twɛlv")], "ord int, word string, phonemes string"))
    for table in (made.issues, made.sentences):
        assert "Join" not in plan_of(table) and "Aggregate" not in plan_of(table)
    assert [(r.text, r.phonemes, r.mended) for r in made.sentences.orderBy("sentence_index").collect()] == [("the Café.", "ðə cafe.", 1), ("A-b 12!", None, 0)]
    assert [(r.token, r.text) for r in made.issues.collect()] == [("A-b", "A-b 12!")]


def test_signs_and_blanks(spark):
    texts = [" “One”, two\x01 \x01(three)… ", "“Don’t” — 'x'", "— …", "A", "\x01", "Yes.  No…\t9"]
    made = prepare.prepare(spark.createDataFrame([("b", k, f"u{k}", "s", t) for k, t in enumerate(texts)], UNITS))
    said = [(r.unit_ord, r.sentence_index, r.phonemes) for r in made.sentences.orderBy("unit_ord", "sentence_index").collect()]
    assert said == [(0, 1, "“one”, two (three)…"), (1, 1, None), (2, 1, "— …"), (3, 1, "a"), (5, 1, "yes."), (5, 2, "no…"), (5, 3, None)]
    assert [(r.issue_ord, r.token) for r in made.issues.orderBy("issue_ord").collect()] == [(0, "Don't"), (1, "9")]


def test_dictionary(spark):
    tables = [spark.sql("select * from values ('a', null), ('b', 'x'), (null, 'n') as t(word, phonemes)"), spark.sql("select concat('w', id) word, concat('p', id) phonemes from range(300)").union(spark.sql("select * from values ('a', 'y'), ('b', 'z'), ('b', 'q') as t(word, phonemes)"))]
    entry = prepare.dictionary(spark, tables)
    found = spark.sql("select array('a', 'b', 'w7', 'w299', 'none', null) as w").select(F.transform("w", entry)).first()[0]
    assert found == ["y", "x", "p7", "p299", None, None]
    assert prepare.dictionary(spark, []) is None


def test_held_rows_give_the_same_report(spark):
    units = spark.createDataFrame([("b", 0, "u0", "s", "Hello wörld. Again!"), ("b", 1, "u1", "s", "the xyz1 end."), ("b", 2, "u2", "t", " "), ("c", 0, "u3", "t", "€ ok"), ("c", 1, "u4", "t", None)], UNITS)
    held = []

    def hold(df, label):
        held.append(df.columns)
        return df.localCheckpoint()

    full = units.withColumn("repairs", F.expr("map('dash', cast(2 as bigint))"))
    shown = lambda made: sorted(str(r) for r in prepare.report(full, made, made.issues).collect()) + sorted(str(r) for r in made.issues.collect())
    assert shown(prepare.prepare(units, hold=hold)) == shown(prepare.prepare(units)) and len(held) == 1


def test_marks_are_looked_for_where_they_stand(spark):
    row = spark.sql("select 'n̩ g' a, 'fine' b, 'a‍b' c, cast(null as string) d").select(*[f(c).alias(f"{f.__name__}_{c}") for c in "abcd" for f in (P.repaired, P.repairs, P.normalized, P.problem)]).first()
    assert list(row) == ["ən g", 1, None, "no sound for 'g'", "fine", 0, "fine", None, "ab", 0, "ab", None, None, None, None, None]


@pytest.mark.parametrize("name", ["unresolved_issues", "suggestion_tokens"])
def test_issues_read_units_once(spark, name):
    kept = lambda: {t.name for t in spark.catalog.listTables(pattern="lectern_units_*")}
    before = kept()
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns
    assert kept() == before
