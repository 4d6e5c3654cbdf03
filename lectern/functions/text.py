"""Text functions as Column expressions: blanks, speech normalisation, sentences and packing.

Everything runs in the JVM. Blanks are Unicode's White_Space characters, spelled out because Java's ``\\s``, Spark's
``trim`` and Python's ``split`` each mean something else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks, as the inside of a Java character class.
BLANKS = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{BLANKS}]"
# what begins a pattern for blanks or for stops: a look that rules nearly all characters out
_MAY_BLANK, _MAY_STOP = "(?![!-~])", "(?![abcdefghijklmnopqrstuvwxyz ])"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: str | Column) -> Column:
    """Without blanks at either end."""
    return F.regexp_replace(col(c), rf"^{WS}+|{_MAY_BLANK}{WS}+\z", "")


def tokens(c: str | Column) -> Column:
    """The runs of non-blanks."""
    return F.filter(F.split(col(c), f"{WS}+"), lambda t: t != "")


def inline(c: str | Column) -> Column:
    """Blanks collapsed to one space, none at the ends. Single spaces, nearly all blanks, are no match and stay as they are."""
    return F.trim(F.regexp_replace(col(c), _MAY_BLANK + rf"(?: {_MAY_BLANK}{WS}+|[{BLANKS.replace(' ', '')}]{WS}*)", " "))


def word_count(c: str | Column) -> Column:
    return F.size(tokens(c))


def ascii_lower(c: str | Column) -> Column:
    """A-Z in small letters; ``lower`` would change other letters, and some lengths."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: str | Column) -> Column:
    return F.translate(col(c), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def paragraphs(c: str | Column) -> Column:
    """Whole text: line ends unified, blanks collapsed in lines, lines of a paragraph joined, one empty line between paragraphs."""
    lines = F.transform(F.split(col(c), r"\r\n|\r|\n"), inline)
    joined = F.array_join(lines, "\n")
    spaced = F.regexp_replace(F.regexp_replace(joined, r"^\n+|\n+\z", ""), r"\n\n+", "\u0001")
    return F.regexp_replace(F.regexp_replace(spaced, "\n", " "), "\u0001", "\n\n")


# The rules of speech normalisation in their order, as (rule, what it replaces, replacement). A text is
# replaced as it is; a pattern stands in REGEX with a sign that every match holds.
LITERAL_RULES = [
    ("soft_hyphen_line_join", "-\r\n", ""),
    ("soft_hyphen_line_join", "-\n", ""),
    ("soft_hyphen_line_join", "-\r", ""),
    ("soft_hyphen", "\u00ad", ""),
    ("currency_expansion", r"\$([0-9,.]+)", "$1 dollars"),
    ("non_breaking_space", "\u00a0", " "),
    ("non_breaking_space", "\u2007", " "),
    ("non_breaking_space", "\u202f", " "),
    ("zero_width", "\u200b", ""),
    ("zero_width", "\u200c", ""),
    ("zero_width", "\u200d", ""),
    ("zero_width", "\ufeff", ""),
    ("dash", "—", ", "),
    ("dash", "–", ", "),
    ("curly_quote", "“", '"'),
    ("curly_quote", "”", '"'),
    ("curly_apostrophe", "‘", "'"),
    ("curly_apostrophe", "’", "'"),
    ("ellipsis", "…", "..."),
    ("currency_expansion", "$", " dollars "),
    ("multiply_expansion", "×", " times "),
    ("equals_expansion", "=", " equals "),
    ("copyright_expansion", "©", " copyright "),
    ("spaced_ellipsis", rf"\.{WS}*\.{WS}*\.", "..."),
    ("numeric_citation", r"\[[0-9,\- ]+\]", ""),
]
REGEX = {r"\$([0-9,.]+)": "$", rf"\.{WS}*\.{WS}*\.": ".", r"\[[0-9,\- ]+\]": "["}
URL_TOKEN = r"""(?s)^([(\[{"']*)(https?://.*?)([.,;:!?)\]}"']*)\z"""
# How the signs of an address are spoken.
URL_SIGNS = [(".", "dot"), ("/", "slash"), ("-", "dash"), ("_", "underscore"), ("?", "question mark"), ("&", "and"), ("=", "equals"), ("#", "hash")]


def spoken_url(token: Column) -> Column:
    """A token that holds an address, spelled out; the scheme goes only where ``www.`` follows it."""
    core = F.regexp_replace(F.regexp_extract(token, URL_TOKEN, 2), r"^https?://www\.", "")
    for sign, name in URL_SIGNS:
        core = F.replace(core, F.lit(sign), F.lit(f" {name} "))
    return F.concat(F.regexp_extract(token, URL_TOKEN, 1), inline(core), F.regexp_extract(token, URL_TOKEN, 3))


def _applied(pattern: str, by: str, before: str, after: str) -> tuple[Column, Column]:
    """What a rule leaves of the column ``before``, and how often it acted, told from that and ``after``.

    A text that is replaced as it is changes its length by the same amount each time, so it is counted for free.
    """
    old = F.col(before)
    if pattern in REGEX:
        there = F.contains(old, F.lit(REGEX[pattern])) & old.rlike(pattern)
        return F.when(there, F.regexp_replace(old, pattern, by)).otherwise(old), F.when(there, F.regexp_count(old, F.lit(pattern))).otherwise(0)
    if pattern > "~":
        new, count = _replaced(old, pattern, by, after)
        return F.when(F.col("__odd"), new).otherwise(old), F.when(F.col("__odd"), count).otherwise(0)
    return _replaced(old, pattern, by, after)


def _replaced(old: Column, pattern: str, by: str, after: str) -> tuple[Column, Column]:
    step = len(by.encode()) - len(pattern.encode())
    size = F.octet_length if step else F.char_length
    step = step or len(by) - len(pattern)
    return F.replace(old, F.lit(pattern), F.lit(by)), ((size(F.col(after)) - size(old)) / step).cast("int")


def with_speech(df: DataFrame, text: str = "text", spoken: str = "spoken", report: str = "repairs") -> DataFrame:
    """``df`` with the text as it is read aloud and a map of how often each rule changed it (rules that didn't are absent).

    A rule reads what the rule before it left, so each is a projection of its own, used twice by the next, which keeps
    the optimizer from merging them. A filter on the results would be pushed below all of them and repeat the chain:
    filter on rows exploded from them (``exploded``) instead.
    """
    signs = "".join(sorted({c for rule in LITERAL_RULES for c in rule[1] if c > "~"}))
    work, counts = df.withColumn("__s0", F.coalesce(F.col(text), F.lit(""))), []
    # rules for signs beyond ASCII have nothing to do in a text without any, and no rule makes one
    work = work.withColumn("__odd", (F.octet_length("__s0") > F.char_length("__s0")) & F.col("__s0").rlike(f"(?![ -~])[{signs}]"))
    for k, (rule, pattern, by) in enumerate(LITERAL_RULES):
        before, after = f"__s{k}", f"__s{k + 1}"
        new, count = _applied(pattern, by, before, after)
        counts.append((rule, f"__n{k}"))
        work = work.withColumn(after, new).withColumn(f"__n{k}", count).drop(before)
    last = f"__s{len(LITERAL_RULES)}"
    # only texts that may hold an address are cut into words; the others' are null
    work = work.withColumn("__t", F.when(F.contains(F.col(last), F.lit("://")), tokens(last)))
    is_url = lambda t: F.contains(t, F.lit("://")) & t.rlike(URL_TOKEN)
    work = work.withColumn("__url", F.when(F.col("__t").isNotNull(), F.size(F.filter("__t", is_url))).otherwise(0))
    counts.append(("url", "__url"))
    said = F.filter(F.transform("__t", lambda t: F.when(is_url(t), spoken_url(t)).otherwise(t)), lambda t: t != "")
    work = work.withColumn(spoken, F.when(F.col("__url") > 0, F.array_join(said, " ")).otherwise(inline(last)))
    totals: dict[str, list[str]] = {}
    for rule, name in counts:
        totals.setdefault(rule, []).append(name)
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])).cast("long")
    pairs = F.array(*[F.struct(F.lit(rule).alias("key"), total(names).alias("value")) for rule, names in sorted(totals.items())])
    return work.withColumn(report, F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))).drop("__t", "__odd", last, *[n for _, n in counts])


def exploded(df: DataFrame, keep: list[str], listed: str | Column, at: str | None, name: str) -> DataFrame:
    """``keep``, the place ``at`` (if asked for) and each element ``name`` of a list; rows with an empty list are left out.

    The outer form and a filter on the element: a plain explode makes the optimizer infer a filter on the list's size
    and push it to the scan, where all that made the list is evaluated a second time, outside of code generation.
    """
    made = df.select(*keep, F.posexplode_outer(listed).alias(at, name)) if at else df.select(*keep, F.explode_outer(listed).alias(name))
    return made.filter(F.col(name).isNotNull())


# Abbreviations whose point doesn't end a sentence.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc"]
_LETTER = r"\p{IsAlphabetic}"
# the point first: what stands before it is looked at only there
_STOP = rf"""(?:[!?…]|\.(?<!(?<!{_LETTER}){_LETTER}\.)(?<!(?<!{_LETTER})(?i:{"|".join(ABBREVIATIONS)})\.))["'”’)\]]*"""


def sentences(c: str | Column) -> Column:
    """Sentences with their closing signs; a point after one letter or an abbreviation doesn't end one."""
    # a mark takes all blanks behind a stop along, so only the ends of the whole text have any to trim
    ends = F.concat(F.substring(col(c), 1, 1), F.substring(col(c), -1, 1))
    whole = F.replace(col(c), F.lit("\u0001"), F.lit(" "))
    marked = F.regexp_replace(F.when(ends.rlike("[^!-~]"), trim(whole)).otherwise(whole), rf"{_MAY_STOP}({_STOP})(?:{WS}+|\z)", "$1\u0001")
    return F.array_remove(F.split(marked, "\u0001"), "")


def _flush(out: Column, current: Column) -> Column:
    return F.when(current != "", F.array_append(out, current)).otherwise(out)


def _pack_step(limit: int):
    def step(acc: Column, word: Column) -> Column:
        out, cur = acc["out"], acc["cur"]
        fits = F.char_length(cur) + F.when(cur != "", 1).otherwise(0) + F.char_length(word) <= limit
        pieces = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        full = F.char_length(F.element_at(pieces, -1)) == limit
        broken = F.struct(
            F.concat(_flush(out, cur), F.when(full, pieces).otherwise(F.slice(pieces, F.lit(1), F.size(pieces) - 1))).alias("out"),
            F.when(full, F.lit("")).otherwise(F.element_at(pieces, -1)).alias("cur"),
        )
        joined = F.struct(out.alias("out"), F.when(cur != "", F.concat(cur, F.lit(" "), word)).otherwise(word).alias("cur"))
        fresh = F.struct(_flush(out, cur).alias("out"), word.alias("cur"))
        return F.when(fits, joined).when(F.char_length(word) <= limit, fresh).otherwise(broken)

    return step


def _empty() -> Column:
    return F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))


def chunks(c: str | Column, limit: int) -> Column:
    """Words packed into as few pieces of at most ``limit`` characters as a greedy reading gives; longer words are cut."""
    if limit < 1:
        raise ValueError("a piece needs room for a character")
    return F.aggregate(tokens(c), _empty(), _pack_step(limit), lambda acc: _flush(acc["out"], acc["cur"]))


def pieces(c: str | Column, limit: int) -> Column:
    """``chunks`` of texts that nearly all are one piece as they are, their blanks collapsed already."""
    text = col(c)
    blanks = text.rlike(rf"{_MAY_BLANK}(?:^ | (?= |\z)|[{BLANKS.replace(' ', '')}])")
    return F.when((F.char_length(text) <= limit) & (text != "") & ~blanks, F.array(text)).otherwise(chunks(text, limit))


def packed_sentences(c: str | Column, limit: int) -> Column:
    """Sentences packed whole into pieces of at most ``limit`` characters; a longer one is packed by words, alone."""
    if limit < 1:
        raise ValueError("a piece needs room for a phoneme")
    kept = F.filter(F.transform(col(c), trim), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        out, cur = acc["out"], acc["cur"]
        over = F.struct(F.concat(_flush(out, cur), chunks(s, limit)).alias("out"), F.lit("").alias("cur"))
        fits = F.char_length(cur) + F.when(cur != "", 1).otherwise(0) + F.char_length(s) <= limit
        joined = F.struct(out.alias("out"), F.when(cur != "", F.concat(cur, F.lit(" "), s)).otherwise(s).alias("cur"))
        return F.when(F.char_length(s) > limit, over).when(fits, joined).otherwise(F.struct(_flush(out, cur).alias("out"), s.alias("cur")))

    return F.aggregate(kept, _empty(), step, lambda acc: _flush(acc["out"], acc["cur"]))


def terminated(c: str | Column) -> Column:
    """A list item with a point, unless it ends a sentence already."""
    t = trim(c)
    return F.when(t.rlike(r"[.!?…]\z"), t).otherwise(F.concat(t, F.lit(".")))


def is_page_number(c: str | Column) -> Column:
    return col(c).rlike(rf"^{WS}*[0-9]+{WS}*\z")


# Letters and the plain ones that stand for them.
FOLD_FROM = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝ"
FOLD_TO = "aaaaaaaeeeeeiiiiioooooouuuuuncyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCY"


def ascii_fold(c: str | Column) -> Column:
    return F.translate(col(c), FOLD_FROM, FOLD_TO)


def spellings(c: str | Column) -> Column:
    """A word as it is, in small letters and with one capital, without repeats."""
    low = F.lower(col(c))
    return F.array_distinct(F.array(col(c), low, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))))


def terminal_safe(c: str | Column) -> Column:
    """Control and direction characters replaced, so that a terminal shows the text as it is."""
    return F.regexp_replace(col(c), r"[\p{Cc}\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069&&[^\n\r\t]]", "\ufffd")


def escape_html(c: str | Column) -> Column:
    out = col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def escape_metadata(c: str | Column) -> Column:
    """For chapter metadata files: signs and line ends behind a backslash, carriage returns left out."""
    marked = F.regexp_replace(F.replace(col(c), F.lit("\r"), F.lit("")), r"([\\=;#])", r"\\$1")
    return F.replace(marked, F.lit("\n"), F.lit("\\n"))
