"""Preflight: every unit cut, pronounced and packed before any speech is made, all problems in one go.

Pronunciation is a lookup: overrides first, under three spellings of a word, then a lexicon, then a fallback
expression. The words of a sentence are looked up where it stands, in a dictionary that every task has, so no token is
a row or moves. A word that stays unknown is tried without signs, in small letters, without accents and spelled out;
what works replaces the word alone and the sentence keeps its other words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phonemes as P
from ..functions.text import ascii_fold, chunks, exploded, inline, packed_sentences, sentences, spellings, tokens, trim
from .issues import by_kind, kept_first, unresolved

CHARACTERS, PHONEMES = 400, 200
#: A limit that no text reaches and regular expressions still take.
WHOLE = 1 << 30
UNPRONOUNCED = "a word has no pronunciation; one can be given as WORD=IPA"
# a word runs from a token's first letter, digit or apostrophe to its last; what is around words are signs and blanks
_SAID = r"\p{IsAlphabetic}\p{IsDigit}'"
# these read texts whose blanks are collapsed; the first finds what a text has if it is more than one sentence
_STOPS = r"""[.!?…]["'”’)\]]* """
_WORD = rf"[{_SAID}]++(?:[^{_SAID} ]++[{_SAID}]++)*+"


@dataclass
class Prepared:
    units: DataFrame
    sentences: DataFrame
    issues: DataFrame


def letters_as_phonemes(word: Column) -> Column:
    """The fallback where no lexicon is installed: plain letters stand for themselves; null for other words."""
    return F.when(word.rlike("^[A-Za-z]+\\z"), F.replace(F.lower(word), F.lit("g"), F.lit("ɡ")))


def overrides(pronunciations: DataFrame) -> DataFrame:
    """``word, phonemes`` of ``pronunciations`` under each spelling; the last given wins."""
    spelled = pronunciations.select("ord", "phonemes", F.explode(spellings("word")).alias("word"))
    return spelled.groupBy("word").agg(F.max_by("phonemes", "ord").alias("phonemes"))


def bad_pronunciations(pronunciations: DataFrame) -> DataFrame:
    """Entries whose word is empty or has blanks, or whose phonemes are empty or not in the vocabulary."""
    word = trim("word")
    good = (word != "") & ~word.rlike(r"[\s\x85\xA0]") & (trim("phonemes") != "") & P.supports(P.repaired(trim("phonemes")))
    return pronunciations.filter(~F.coalesce(good, F.lit(False)))


def dictionary(spark: SparkSession, tables: list[DataFrame]) -> Callable[[Column], Column] | None:
    """A lookup of a word's phonemes in ``tables(word, phonemes)``, the first that has it, null if none; of a table's equal words the least phonemes.

    The entries are one constant, which each task gets once: as many slots as words, a word in the slot of its hash. It
    is a variable of the session, so the words of all tables have to fit in memory.
    """
    if not tables:
        return None
    ranked = [t.select("word", F.struct(F.lit(k).alias("rank"), "phonemes").alias("found")).filter("word is not null and found.phonemes is not null") for k, t in enumerate(tables)]
    entries = reduce(DataFrame.unionByName, ranked).groupBy("word").agg(F.min("found")["phonemes"].alias("phonemes"))
    slots = max(1, entries.count())
    slot = lambda word: F.pmod(F.hash(word), F.lit(slots))
    filled = entries.groupBy(slot(F.col("word")).cast("long").alias("id")).agg(F.collect_list(F.struct("word", "phonemes")).alias("words"))
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("words", F.array().cast("array<struct<word:string,phonemes:string>>")).alias("words"))))
    made = spark.range(slots).join(filled, "id", "left").agg(F.transform(listed, lambda x: F.map_from_entries(x["words"])).alias("slots"))
    name = f"lectern_words_{uuid.uuid4().hex}"
    spark.sql(f"declare variable {name} array<map<string, string>>")
    spark.sql(f"set var {name} = (select slots from {{made}})", made=made)
    return lambda word: F.element_at(F.get(F.expr(f"system.session.{name}"), slot(word)), word)


def mended(word: Column, sound: Callable[[Column], Column]) -> Column:
    """``candidate, second``: the first other form of a word that has a sound, and that; null if none has."""
    known = lambda c, said: F.get(F.filter(F.transform(F.array(c), lambda x: F.struct(x.alias("candidate"), said(x).alias("second"))), lambda x: x["second"].isNotNull() & (x["candidate"] != word)), 0)

    def spelled(letters: Column) -> Column:
        sounds = F.transform(F.split(letters, " "), sound)
        return F.when(~F.exists(sounds, lambda x: x.isNull()), F.array_join(sounds, " "))

    letters = F.when(word.rlike("^[A-Za-z]+\\z"), F.array_join(P.characters(F.upper(word)), " "))
    return F.coalesce(known(F.lower(word), sound), known(ascii_fold(word), sound), known(F.lower(ascii_fold(word)), sound), known(letters, spelled))


def prepare(units: DataFrame, lexicon: DataFrame | None = None, pronunciations: DataFrame | None = None, max_characters: int = CHARACTERS, max_phonemes: int = PHONEMES, fallback=letters_as_phonemes, keep: Callable[[DataFrame, str], DataFrame] | None = None, hold: Callable[[DataFrame, str], DataFrame] | None = None) -> Prepared:
    """``units(book_id, unit_ord, unit_id, section_id, text)`` with ``status`` and ``phoneme_chunks``; their sentences; their issues.

    All of a sentence is found in its row; issues are numbered by book. ``keep`` may write the words that were mended,
    one row each. ``hold`` may write what sentences and issues are told from, so that both have it from one pass; units
    and sentences then lack their phonemes, and no text is written but that of issues.
    """
    tables = [*([overrides(pronunciations)] if pronunciations is not None else []), *([lexicon] if lexicon is not None else [])]
    entry = dictionary(units.sparkSession, tables)
    sound = lambda word: fallback(word) if entry is None else F.coalesce(entry(word), fallback(word))
    unit = ["book_id", "unit_ord"]
    key = [*unit, "chunk", "sentence_index"]
    text = F.coalesce("text", F.lit(""))
    # a unit with nothing to say has one row, without a sentence
    cut = units.select(*unit, "unit_id", text.alias("given"), inline(text).alias("spaced")).select(*unit, "unit_id", F.when(F.col("spaced") == "", F.col("given")).alias("blank"), "spaced")
    pieces = F.when((F.char_length("spaced") <= max_characters) & (F.col("spaced") != ""), F.array("spaced")).otherwise(chunks("spaced", max_characters))
    many = lambda p: p.rlike(_STOPS) | F.contains(p, F.lit("\u0001"))
    listed = F.flatten(F.transform(pieces, lambda p, n: F.transform(F.when(many(p), sentences(p)).otherwise(F.array(p)), lambda s: F.struct(n.alias("chunk"), s.alias("sentence")))))
    told = cut.select(*unit, "unit_id", "blank", F.posexplode_outer(listed).alias("at", "told")).select(*unit, "told.chunk", (F.col("at") + 1).alias("sentence_index"), "unit_id", "blank", "told.sentence")
    # a sentence has no U+0001, which stands for words here: Java compiles a pattern to split by anew for each text, but no sole sign
    # arrays meet in zip_with, which has each made once a row; one that a function of elements names is made for every element
    straight = F.replace(F.replace(F.col("sentence"), F.lit("‘"), F.lit("'")), F.lit("’"), F.lit("'"))
    spaced = told.withColumn("straight", straight).withColumn("spaced", F.when(F.contains("straight", F.lit("  ")), inline("straight")).otherwise(F.col("straight")))
    words = spaced.withColumn("words", F.regexp_extract_all("spaced", F.lit(_WORD), F.lit(0))).withColumn("signs", F.split(F.regexp_replace("spaced", _WORD, "\u0001"), "\u0001"))
    known = words.withColumn("sounds", F.transform("words", sound)).withColumn("lost", F.exists("sounds", lambda x: x.isNull()))
    tried = known.withColumn("second", F.when(F.col("lost"), F.zip_with("words", "sounds", lambda w, s: F.when(s.isNull(), mended(w, sound)))))
    places = F.filter(F.transform(tokens("spaced"), lambda t, n: F.when(t.rlike(f"[{_SAID}]"), n)), lambda n: n.isNotNull())
    placed = F.zip_with("words", places, lambda w, n: F.struct(n.alias("at"), w.alias("from")))
    replaced = F.filter(F.zip_with(placed, "second", lambda p, m: F.struct(p["at"].alias("at"), p["from"].alias("from"), m["candidate"].alias("to"))), lambda x: x["to"].isNotNull())
    none = F.array().cast("array<struct<at:int,from:string,to:string>>")
    said = tried.withColumn("sounds", F.when(F.col("lost"), F.zip_with("sounds", "second", lambda s, m: F.coalesce(s, m["second"]))).otherwise(F.col("sounds")))
    said = said.withColumn("mended", F.when(F.col("lost"), F.size(F.filter("second", lambda m: m.isNotNull()))).otherwise(0)).withColumn("mends", F.when(F.col("mended") > 0, replaced).otherwise(none))
    first = said.withColumn("unknown", F.when(F.col("lost"), F.get(F.filter(F.zip_with("words", "sounds", lambda w, s: F.when(s.isNull(), w)), lambda w: w.isNotNull()), 0)))
    # one more sign than words, as a sign may be empty
    joined = F.array_join(F.zip_with("signs", "sounds", lambda sign, s: F.concat(sign, F.coalesce(s, F.lit("")))), "")
    checked = first.withColumn("raw", F.when(F.col("unknown").isNull(), joined)).withColumn("detail", F.when(F.col("unknown").isNotNull(), F.lit(UNPRONOUNCED)).otherwise(P.problem("raw")))
    checked = checked.withColumn("phonemes", F.when(F.col("detail").isNull(), P.normalized("raw"))).withColumn("repairs", F.when(F.col("detail").isNull(), P.repairs("raw")).otherwise(0))
    if keep is not None:
        forms = F.zip_with("words", "second", lambda w, m: F.struct(w.alias("word"), m["candidate"].alias("candidate"), m["second"].alias("second")))
        keep(exploded(tried.filter("lost"), [], F.filter(forms, lambda x: x["candidate"].isNotNull()), None, "m").select("m.*").distinct(), "mended")
    kind = F.when(F.col("unknown").isNotNull(), "unknown_g2p_token").when(F.col("detail").startswith("no sound for"), "unsupported_phoneme").otherwise("unknown_g2p_token")
    problem = lambda kind, token, text, detail: F.array(F.struct(kind.alias("kind"), token.alias("token"), text.alias("text"), detail.alias("detail")))
    problems = F.when(F.col("blank").isNotNull(), problem(F.lit("empty_narration_unit"), F.lit(None).cast("string"), F.col("blank"), F.lit("the unit has nothing to say"))).when(F.col("sentence").isNotNull() & F.col("detail").isNotNull(), problem(kind, F.col("unknown"), F.col("sentence"), F.col("detail")))
    checked = checked.select(*key, "unit_id", "sentence", "phonemes", "repairs", "mends", "mended", problems.alias("problems"))
    if hold is not None:
        checked = hold(checked.select(*key, "unit_id", F.when(F.col("sentence").isNotNull(), F.lit("")).alias("sentence"), F.lit(None).cast("string").alias("phonemes"), "repairs", "mended", "problems"), "sentences").withColumn("mends", none)
    raised = exploded(checked, ["book_id", "unit_ord", F.when(F.col("sentence").isNotNull(), F.col("sentence_index")).otherwise(0).alias("sentence_index"), "unit_id"], F.col("problems"), None, "problem").select("book_id", "unit_ord", "sentence_index", "unit_id", "problem.*")
    spoken = checked.filter("sentence is not null")
    signature = F.concat_ws(":", "kind", F.when(F.col("kind") == "empty_narration_unit", F.col("unit_id")).otherwise(F.coalesce("token", "detail")))
    order = Window.partitionBy("book_id").orderBy("unit_ord", "sentence_index")
    issues = raised.select("book_id", (F.row_number().over(order) - 1).alias("issue_ord"), signature.alias("signature"), "kind", "token", "unit_id", "sentence_index", "text", F.lit(1).cast("long").alias("occurrences"), "detail")
    # a piece of text is packed only if all of its sentences are pronounced
    packed = spoken.groupBy(*unit, "chunk").agg(F.every(F.col("phonemes").isNotNull()).alias("whole"), F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "phonemes"))), lambda x: x["phonemes"]).alias("said"), F.sum("repairs").alias("repairs"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "mends"))), lambda x: x["mends"])).alias("mends"))
    chunked = packed.withColumn("packed", F.when(F.col("whole"), packed_sentences("said", max_phonemes)).otherwise(F.array().cast("array<string>")))
    each = chunked.groupBy(*unit).agg(F.every("whole").alias("whole"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "packed"))), lambda x: x["packed"])).alias("phoneme_chunks"), F.sum("repairs").alias("phoneme_repairs"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "mends"))), lambda x: x["mends"])).alias("mends"))
    ready = units.join(each, unit).withColumn("status", F.when(F.col("whole"), "ready").otherwise("blocked")).drop("whole")
    return Prepared(ready, spoken.select(*key, "unit_id", F.col("sentence").alias("text"), "phonemes", "repairs", "mended"), issues)


def warnings_as_issues(warnings: DataFrame, kind: str) -> DataFrame:
    """``book_id, warning_ord, warning`` as issues of the whole book."""
    return warnings.select("book_id", F.col("warning_ord").cast("long").alias("issue_ord"), F.concat(F.lit(f"{kind}:"), "warning").alias("signature"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("token"), F.lit("book").alias("unit_id"), F.lit(0).alias("sentence_index"), F.lit("").alias("text"), F.lit(1).cast("long").alias("occurrences"), F.col("warning").alias("detail"))


def report(units: DataFrame, prepared: Prepared, issues: DataFrame) -> DataFrame:
    """One row a book: what was scanned and repaired, issues by kind, how many block, whether the book is complete."""
    repairs = F.aggregate(F.map_values("repairs"), F.lit(0).cast("long"), lambda a, x: a + x)
    scanned = units.groupBy("book_id").agg(F.count("*").alias("scanned_units"), F.sum(repairs).alias("text_repairs"))
    said = prepared.sentences.groupBy("book_id").agg(F.count("*").alias("scanned_sentences"), F.sum("repairs").alias("automatic_repairs"), F.sum("mended").alias("best_effort_pronunciations"))
    merged = kept_first(issues)
    own = F.array_sort(F.collect_list(F.struct("kind", "occurrences")))
    kinds = by_kind(merged).groupBy("book_id").agg(own.alias("kinds"))
    met = scanned.join(said, "book_id", "left").join(kinds, "book_id", "left").join(unresolved(merged), "book_id", "left")
    none = F.array().cast("array<struct<kind:string,occurrences:bigint>>")
    automatic = F.when(F.col("automatic_repairs") > 0, F.array(F.struct(F.lit("automatic_repair").alias("kind"), F.col("automatic_repairs").cast("long").alias("occurrences")))).otherwise(none)
    return met.select(
        "book_id", "scanned_units", F.coalesce("scanned_sentences", F.lit(0)).alias("scanned_sentences"), F.coalesce("automatic_repairs", F.lit(0)).alias("automatic_repairs"), "text_repairs", F.coalesce("best_effort_pronunciations", F.lit(0)).alias("best_effort_pronunciations"),
        F.coalesce("unresolved", F.lit(0)).alias("unresolved"), F.map_from_entries(F.array_sort(F.concat(F.coalesce("kinds", none), automatic))).alias("issues_by_kind"), (F.coalesce("unresolved", F.lit(0)) == 0).alias("complete"),
    )


def mismatches(units: DataFrame, prepared: DataFrame) -> DataFrame:
    """Rows of a prepared table that don't fit the plan: another text or id at the same place, missing, or not ready."""
    from .lookup import zipped_differences

    ready = prepared.withColumn("status", F.coalesce("status", F.lit("ready")))
    return zipped_differences(units.withColumn("status", F.lit("ready")), ready, ["book_id", "unit_ord"], ["unit_id", "text", "original_text", "status"])


def phonemized(units: DataFrame, lexicon: DataFrame | None = None, pronunciations: DataFrame | None = None, max_phonemes: int = PHONEMES, fallback=letters_as_phonemes) -> DataFrame:
    """``book_id, unit_ord, unit_id, phoneme_chunks`` of whole texts, not cut by characters first; raises the first problem in reading order."""
    made = prepare(units, lexicon, pronunciations, WHOLE, max_phonemes, fallback)
    first = made.issues.orderBy("book_id", "issue_ord").select("unit_id", "detail").head()
    if first is not None:
        raise ValueError(f"{first.unit_id}: {first.detail}")
    return made.units.select("book_id", "unit_ord", "unit_id", "phoneme_chunks")
