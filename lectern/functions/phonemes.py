"""Phonemes: repair of syllabic consonants, vocabulary and token ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# The vocabulary's characters and their ids.
VOCABULARY = {
    ";": 1, ":": 2, ",": 3, ".": 4, "!": 5, "?": 6, "—": 9, "…": 10, '"': 11, "(": 12, ")": 13, "“": 14, "”": 15, " ": 16,
    "\u0303": 17, "ʣ": 18, "ʥ": 19, "ʦ": 20, "ʨ": 21, "ᵝ": 22, "ꭧ": 23, "A": 24, "I": 25, "O": 31, "Q": 33, "S": 35, "T": 36, "W": 39, "Y": 41,
    "ᵊ": 42, "a": 43, "b": 44, "c": 45, "d": 46, "e": 47, "f": 48, "h": 50, "i": 51, "j": 52, "k": 53, "l": 54, "m": 55, "n": 56, "o": 57, "p": 58,
    "q": 59, "r": 60, "s": 61, "t": 62, "u": 63, "v": 64, "w": 65, "x": 66, "y": 67, "z": 68, "ɑ": 69, "ɐ": 70, "ɒ": 71, "æ": 72, "β": 75, "ɔ": 76,
    "ɕ": 77, "ç": 78, "ɖ": 80, "ð": 81, "ʤ": 82, "ə": 83, "ɚ": 85, "ɛ": 86, "ɜ": 87, "ɟ": 90, "ɡ": 92, "ɥ": 99, "ɨ": 101, "ɪ": 102, "ʝ": 103,
    "ɯ": 110, "ɰ": 111, "ŋ": 112, "ɳ": 113, "ɲ": 114, "ɴ": 115, "ø": 116, "ɸ": 118, "θ": 119, "œ": 120, "ɹ": 123, "ɾ": 125, "ɻ": 126, "ʁ": 128,
    "ɽ": 129, "ʂ": 130, "ʃ": 131, "ʈ": 132, "ʧ": 133, "ʊ": 135, "ʋ": 136, "ʌ": 138, "ɣ": 139, "ɤ": 140, "χ": 142, "ʎ": 143, "ʒ": 147, "ʔ": 148,
    "ˈ": 156, "ˌ": 157, "ː": 158, "ʰ": 162, "ʲ": 164, "↓": 169, "→": 171, "↗": 172, "↘": 173, "ᵻ": 177,
}
MOST = 510
#: Joiners and the byte order mark, dropped anywhere; the mark that makes a consonant a syllable; aliases of two signs.
DROPPED, SYLLABIC, ALIASES = "[\u200c\u200d\ufeff]", "\u0329", ("ɝ`´", "ɚˈˈ")
#: Consonants that the mark turns into a schwa and themselves.
CONSONANTS = "nlmɹr"


def repaired(c: str | Column) -> Column:
    """Each marked consonant as a schwa and the consonant. Further marks act on the consonant again."""
    clean = F.regexp_replace(col(c), DROPPED, "")
    marked = F.regexp_extract_all(clean, F.lit(f"(?s)[{CONSONANTS}]{SYLLABIC}+|."), F.lit(0))
    one = lambda p: F.when((F.char_length(p) > 1), F.concat(F.repeat(F.lit("ə"), F.char_length(p) - 1), F.substring(p, 1, 1))).otherwise(p)
    return F.when(F.contains(col(c), F.lit(SYLLABIC)), F.array_join(F.transform(marked, one), "")).otherwise(clean)


def repairs(c: str | Column) -> Column:
    """How many marks ``repaired`` acts on."""
    clean = F.regexp_replace(col(c), DROPPED, "")
    marks = F.regexp_extract_all(clean, F.lit(f"[{CONSONANTS}]({SYLLABIC}+)"), F.lit(1))
    return F.when(F.contains(col(c), F.lit(SYLLABIC)), F.aggregate(marks, F.lit(0), lambda n, p: n + F.char_length(p))).when(col(c).isNotNull(), 0)


#: The inside of a class of the vocabulary's characters.
_KNOWN = "".join(f"\\x{{{ord(x):x}}}" for x in VOCABULARY)
#: A character outside the vocabulary, behind a look that rules nearly all known ones out.
_ODD = f"(?s)(?![a-fh-z ,.ɡ])[^{_KNOWN}]"


def _aliased(c: str | Column) -> Column:
    out = repaired(c)
    for sign, other in zip(*ALIASES):
        out = F.replace(out, F.lit(sign), F.lit(other))
    return out


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def unsupported(c: str | Column) -> Column:
    """Characters outside the vocabulary, in the order in which they first come."""
    return F.array_distinct(F.regexp_extract_all(_aliased(c), F.lit(_ODD), F.lit(0)))


def supports(c: str | Column) -> Column:
    """Whether the text's own characters are in the vocabulary, as they are, without a repair."""
    plain = F.translate(F.regexp_replace(col(c), DROPPED, ""), *ALIASES)
    return ~plain.rlike(_ODD)


def normalized(c: str | Column) -> Column:
    """Repaired and aliased phonemes; null if empty or unsupported."""
    return F.when(~_aliased(c).rlike(_ODD) & (_aliased(c) != ""), _aliased(c))


def problem(c: str | Column) -> Column:
    """Why ``normalized`` is null; null if it isn't."""
    odd = F.concat(F.lit("no sound for '"), F.array_join(unsupported(c), ""), F.lit("'"))
    return F.when(_aliased(c).rlike(_ODD), odd).when(_aliased(c) == "", "nothing to say")


def token_ids(c: str | Column) -> Column:
    """Ids with a zero at either end; null if unsupported, empty or above the limit."""
    ids = F.create_map(*[x for s, i in VOCABULARY.items() for x in (F.lit(s), F.lit(i))])
    text = normalized(c)
    return F.when(F.char_length(text) <= MOST, F.concat(F.array(F.lit(0)), F.transform(characters(text), lambda x: F.element_at(ids, x)), F.array(F.lit(0))))
