"""Plans: every rule of speech is evaluated once, and narrow queries read narrow columns."""

from pyspark.sql import functions as F

from lectern.functions import text as T


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_evaluated_once(spark, tmp_path):
    spark.createDataFrame([(1, "a $ b")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    said = T.with_speech(spark.read.parquet(str(tmp_path / "t")))
    split = T.exploded(said, ["doc_id"], T.sentences("spoken"), "no", "sentence")
    counted = said.select(F.explode_outer("repairs").alias("rule", "n")).filter("rule is not null").groupBy("rule").agg(F.sum("n").alias("n"))
    for df, used in ((said, 1), (split, 1), (counted, 1)):
        plan = plan_of(df)
        assert plan.count(", ©,  copyright )") == used and plan.count(", ×,  times )") == used
    assert [tuple(r) for r in counted.collect()] == [("currency_expansion", 1)]


def test_narrow_reads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.filter("doc_id > 5").select("doc_id", T.word_count("text").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "GreaterThan(doc_id,5)" in plan


def test_originals_once(spark):
    """A long paragraph is written once, not with each of its sentences, and still given with each."""
    from functools import partial

    from lectern.plans import narration
    from lectern.sources.text import import_text
    from lectern.storage import dealt, in_buckets

    text = "CHAPTER ONE\n" + "Rain fell on us. " * 300
    rows, parts = dealt(spark.createDataFrame([("a", "a.txt", text), ("b", "b.txt", "One. Two.")], "book_id string, path string, text string"), "book_id")
    kept = []

    def keep(df, label):
        kept.append(in_buckets(df, label, parts))
        return kept[-1]

    plan = narration.plan(import_text(rows, keep=partial(in_buckets, parts=parts)), keep=keep, parts=parts)
    assert sum(len(str(r)) for r in kept[0].drop("repairs", "start", "stop", "unit_id").collect()) < 60 * len(text)
    got = plan.units.filter("book_id = 'a' and item_id like '%block%'").select("original_text").distinct().collect()
    assert [r[0] for r in got] == ["Rain fell on us. " * 299 + "Rain fell on us."]
    # units are numbered and timed by book without another exchange
    assert "Exchange" not in kept[0].groupBy("book_id").count()._jdf.queryExecution().executedPlan().toString()


def test_mended_words_kept(spark):
    """The words that are mended are written by ``keep`` once, one row each, and give the same result as without."""
    from lectern.operators.prepare import prepare

    units = spark.createDataFrame([("b", 0, "u0", "s", "Café café 12 ok."), ("b", 1, "u1", "s", "Fine.")], "book_id string, unit_ord int, unit_id string, section_id string, text string")
    kept = []

    def keep(df, label):
        kept.append(df)
        return df

    shown = lambda made: [tuple(r) for r in made.issues.select("unit_id", "kind", "token").orderBy("unit_id").collect()]
    with_keep = prepare(units, keep=keep)
    assert sorted(r.word for r in kept[0].collect()) == ["Café", "café"] and len(kept) == 1
    assert shown(with_keep) == shown(prepare(units)) == [("u0", "unknown_g2p_token", "12")]
