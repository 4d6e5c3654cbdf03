"""Headings, section kinds, numbering and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, ascii_upper, col, tokens, trim

# Number words of a heading.
NUMBER_WORDS = (
    "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN "
    "TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY"
).split()
# Semantic tokens and the kind of section that each names, in the order in which they count.
SEMANTIC_KINDS = [
    ("Part", ["part", "volume"]),
    ("Chapter", ["chapter"]),
    ("Appendix", ["appendix"]),
    ("Notes", ["footnotes", "endnotes"]),
    ("Bibliography", ["bibliography"]),
    ("Index", ["index"]),
    ("Section", ["section", "subchapter"]),
    ("FrontMatter", ["frontmatter", "titlepage", "title-page", "copyright-page", "copyright", "dedication", "epigraph", "foreword", "preface", "introduction", "prologue"]),
    ("BackMatter", ["backmatter", "afterword", "acknowledgments", "colophon", "epilogue"]),
    ("BodyMatter", ["bodymatter", "text"]),
]
# Kinds of cues by kind of section, kinds that chapters are made of, kinds that sections aren't.
CUE_KINDS = {"Book": "Book", "Part": "Part", "Chapter": "Chapter", "Section": "Section", "Appendix": "Section", "Notes": "Section"}
MAJOR_KINDS = ["Part", "Chapter", "FrontMatter", "Appendix", "Notes", "BackMatter"]
HIDDEN_KINDS = ["Book", "BodyMatter", "Index"]
# Sections that are not read aloud.
SKIPPED_KINDS = ["Index", "Notes"]
SKIPPED_TITLES = ["copyright", "copyright page", "table of contents", "contents", "notes", "endnotes", "index", "credits", "connect with hmh"]
#: How a section's kind is named in warnings; the others are one word.
KIND_LABELS = {"FrontMatter": "front matter", "BodyMatter": "body matter", "BackMatter": "back matter"}


def kind_label(kind: str | Column) -> Column:
    k = col(kind)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair]), k), F.lower(k))


def heading_kind(c: str | Column) -> Column:
    first = ascii_lower(F.get(tokens(c), 0))
    return F.when(first.isin("part", "book"), "Part").when(first == "chapter", "Chapter").otherwise("Section")


def is_heading_identifier(c: str | Column) -> Column:
    upper = ascii_upper(c)
    return F.coalesce(upper.rlike(r"^(?:[0-9]+|[IVXLCDM]+)\z") | upper.isin(NUMBER_WORDS), F.lit(False))


def display_heading(line: str | Column) -> Column:
    """Shouted headings with one capital a word; words of the letters I V X L C keep theirs. Others stay as they are."""
    one = lambda w: F.when(w.rlike(r"^(?:\P{IsAlphabetic}|[IVXLC])*\z"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.when(col(line).rlike(r"\p{IsLowercase}"), col(line)).otherwise(F.array_join(F.transform(tokens(line), one), " "))


def text_heading(line: str | Column) -> Column:
    """``struct(kind, title)`` of a line with collapsed blanks that is a heading, else null.

    Up to 120 characters; chapter, part or book and a number; no more than that unless all letters are capitals or a
    colon or dash sets the title off.
    """
    words = tokens(line)
    begins = col(line).rlike("^(?i:chapter|part|book) ")
    first, second, third = (F.get(words, k) for k in range(3))
    kind = F.when(ascii_lower(first) == "chapter", "Chapter").when(ascii_lower(first).isin("part", "book"), "Part")
    number = F.regexp_replace(second, "^[:.\\-–—]+|[:.\\-–—]+\\z", "")
    shouted = ~col(line).rlike(r"[\p{IsAlphabetic}&&\P{IsUppercase}]")
    apart = second.endswith(":") | F.coalesce(third.isin(":", "-", "–", "—"), F.lit(False))
    good = kind.isNotNull() & is_heading_identifier(number) & ((F.size(words) <= 2) | shouted | apart)
    # hardly any line begins so, and the others need no more than that look
    return F.when(begins & (F.char_length(col(line)) <= 120), F.when(good, F.struct(kind.alias("kind"), display_heading(line).alias("title"))))


def semantic_kind(c: str | Column) -> Column:
    """The kind that a list of semantic tokens names, by the first rule that any token meets; null if none does."""
    listed = F.transform(F.split(col(c), r"[ \t\n\f\r]+"), lambda t: F.regexp_replace(t, "^doc-", ""))
    out = None
    for kind, names in SEMANTIC_KINDS:
        met = F.arrays_overlap(listed, F.array(*map(F.lit, names)))
        out = F.when(met, kind) if out is None else out.when(met, kind)
    return out


def cue_kind(c: str | Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CUE_KINDS.items() for x in pair]), col(c)), F.lit("Other"))


def is_skipped(kind: str | Column, title: str | Column) -> Column:
    """Whether a section, with all below it, is left out of the narration."""
    name = trim(ascii_lower(F.coalesce(col(title), F.lit(""))))
    return col(kind).isin(SKIPPED_KINDS) | name.isin(SKIPPED_TITLES) | name.endswith(" credits")


def roman(n: str | Column) -> Column:
    """Small roman numerals of a number from 1 up; each thousand is an m."""
    number = col(n).cast("long")
    digit = lambda power: (number / power).cast("long") % 10
    places = [F.get(F.array(*map(F.lit, row.split(","))), digit(power)) for power, row in ((100, ",c,cc,ccc,cd,d,dc,dcc,dccc,cm"), (10, ",x,xx,xxx,xl,l,lx,lxx,lxxx,xc"), (1, ",i,ii,iii,iv,v,vi,vii,viii,ix"))]
    return F.concat(F.repeat(F.lit("m"), (number / 1000).cast("int")), *places)


def alphabetic(n: str | Column) -> Column:
    """a to z, then aa, ab: numbers in base 26 without a zero; empty for 0."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    start = F.struct(col(n).cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["left"] - 1
        return F.when(acc["left"] > 0, F.struct(F.floor(rest / 26).cast("long").alias("left"), F.concat(F.substring(letters, (rest % 26 + 1).cast("int"), F.lit(1)), acc["out"]).alias("out"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])


def page_label(style: str | Column, prefix: str | Column, number: str | Column) -> Column:
    """A page's label by its range: D, R, r, A, a, or no number for a null style. Another style gives null."""
    s, n = col(style), col(number)
    text = F.when(s.isNull(), "").when(s == "D", n.cast("string")).when(s == "R", F.upper(roman(n))).when(s == "r", roman(n)).when(s == "A", F.upper(alphabetic(n))).when(s == "a", alphabetic(n))
    return F.concat(F.coalesce(col(prefix), F.lit("")), text)


def has_scheme(c: str | Column) -> Column:
    return col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def _bytes_of(c: Column) -> Column:
    """Percent codes as bytes; ``c`` has only whole codes."""
    pieces = F.regexp_extract_all(c, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+"), F.lit(0))
    hexed = F.transform(pieces, lambda p: F.when(p.startswith("%"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.unhex(F.array_join(hexed, ""))


def percent_decoded(c: str | Column) -> Column:
    """Null if a code is broken or the bytes aren't UTF-8."""
    whole = ~col(c).rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(whole, F.try_validate_utf8(_bytes_of(col(c)).cast("string")))


def percent_decoded_or_raw(c: str | Column) -> Column:
    """Broken codes stay; the whole stays as it was if the bytes aren't UTF-8."""
    guarded = F.regexp_replace(col(c), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_validate_utf8(_bytes_of(guarded).cast("string")), col(c))


def archive_path(base: str | Column, reference: str | Column) -> Column:
    """A reference from a folder of an archive, decoded and without dots; null if it's empty, absolute, or leaves the archive."""
    decoded = percent_decoded(F.regexp_extract(col(reference), r"(?s)^[^?#]*", 0))
    good = (decoded != "") & ~decoded.startswith("/") & ~F.contains(decoded, F.lit("\\")) & ~F.contains(F.substring_index(decoded, "/", 1), F.lit(":"))
    parts = F.filter(F.split(F.concat_ws("/", col(base), decoded), "/"), lambda p: ~p.isin("", "."))
    none = F.lit(None).cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none)
        return F.when(acc.isNull(), none).when(part == "..", up).otherwise(F.array_append(acc, part))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(good & (F.size(walked) > 0), F.array_join(walked, "/"))


def stem(path: str | Column) -> Column:
    """The file's name without its last extension."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1), F.lit("")), name)


def source_id(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def chapter_filename(index: str | Column, section: str | Column) -> Column:
    label = F.element_at(F.split(F.coalesce(col(section), F.lit("narration")), ":"), -1)
    return F.concat(F.format_string("%03d", col(index)), F.lit("-"), F.regexp_replace(ascii_lower(label), "[^A-Za-z0-9]", "-"), F.lit(".txt"))
