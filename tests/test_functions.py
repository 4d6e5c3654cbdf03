"""The literal cases of the text functions."""

import pytest

from lectern.functions import phonemes as P
from lectern.functions import structure as S
from lectern.functions import text as T


@pytest.fixture(scope="module")
def ev(spark):
    return lambda f, *x: spark.createDataFrame([tuple(x)], ", ".join(f"x{k} string" for k in range(len(x)))).select(f(*[f"x{k}" for k in range(len(x))]).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def speech(spark):
    def of(x):
        row = T.with_speech(spark.createDataFrame([(x,)], "text string")).first()
        return row.spoken, row.repairs

    return of


def test_sentences(ev):
    assert ev(T.sentences, "Rain came early. “Who is there?” the miller said!\n\nNo answer") == ["Rain came early.", "“Who is there?”", "the miller said!", "No answer"]
    assert ev(T.sentences, "Prof. Okoro thanked Ms. Lund. Both sat down.") == ["Prof. Okoro thanked Ms. Lund.", "Both sat down."]
    assert ev(T.sentences, "plan B. costs 7.25 and o…ne. Oh…") == ["plan B. costs 7.25 and o…ne.", "Oh…"]
    assert ev(T.sentences, " ") == []


def test_chunks(ev):
    got = ev(lambda c: T.chunks(c, 10), "donaudampfschifffahrtsgesellschaft")
    assert "".join(got) == "donaudampfschifffahrtsgesellschaft" and max(map(len, got)) == 10
    assert ev(lambda c: T.chunks(c, 64), " \n ") == []
    assert ev(lambda c: T.chunks(c, 8), "red fox jumps away") == ["red fox", "jumps", "away"]
    assert ev(lambda c: T.chunks(c, 5), "aaaaaaaaaa b") == ["aaaaa", "aaaaa", "b"]
    with pytest.raises(ValueError):
        T.chunks("x", 0)


def test_packing(spark):
    def pack(x, n):
        return spark.createDataFrame([(x,)], "x array<string>").select(T.packed_sentences("x", n).alias("y")).first()["y"]

    assert [len(c) for c in pack(["a" * 23], 10)] == [10, 10, 3]
    assert pack(["aa", "bb", "x" * 11, " ", "cc"], 10) == ["aa bb", "x" * 10, "x", "cc"]


def test_speech(speech):
    nb = "\u00a0"
    assert speech(f"“Well{nb}.{nb}.{nb}. so{nb}.{nb}.{nb}.”")[0] == '"Well ... so ..."'
    assert speech("($4,150 × 3 = $12,450)")[0] == "(4,150 dollars times 3 equals 12,450 dollars)"
    assert speech("lan\u200btern and har\u200dbour")[0] == "lantern and harbour"
    assert speech("© North Quay Press") == ("copyright North Quay Press", {"copyright_expansion": 1})
    said, counts = speech("Har\u00adbour—ask https://quay.net/x-y [7].\na bro-\nken line.")
    assert "https: slash slash quay dot net slash x dash y" in said and said.endswith("a broken line.")
    assert counts == {"soft_hyphen_line_join": 1, "soft_hyphen": 1, "dash": 1, "numeric_citation": 1, "url": 1}
    assert speech("(https://www.x.com/a).")[0] == "(x dot com slash a)."
    assert speech("It cost $5. Wait… now") == ("It cost 5. dollars Wait... now", {"currency_expansion": 1, "ellipsis": 1, "spaced_ellipsis": 1})
    assert speech(None) == ("", {})


def test_headings(ev):
    h = lambda x: ev(S.text_heading, x)
    assert tuple(h("CHAPTER ONE")) == ("Chapter", "Chapter One")
    assert tuple(h("PART II")) == ("Part", "Part II")
    assert tuple(h("Chapter 3: The End")) == ("Chapter", "Chapter 3: The End")
    assert tuple(h("CHAPTER XD THE MIDDLE")) == ("Chapter", "Chapter Xd The Middle")
    assert h("Chapter one explains the model.") is None and h("Chapter") is None and h("") is None and h("chapter one " + "X" * 120) is None
    assert ev(S.semantic_kind, "bodymatter doc-chapter") == "Chapter" and ev(S.semantic_kind, "custom") is None
    assert ev(S.heading_kind, "Book of x") == "Part"


def test_numbers_and_paths(ev):
    assert [ev(S.roman, str(n)) for n in (1, 4, 9, 14, 1999, 4003)] == ["i", "iv", "ix", "xiv", "mcmxcix", "mmmmiii"]
    assert [ev(S.alphabetic, str(n)) for n in (0, 1, 26, 27, 28, 703)] == ["", "a", "z", "aa", "ab", "aaa"]
    path = lambda b, r: ev(S.archive_path, b, r)
    assert path("OEBPS", "../a%20b.xhtml#x") == "a b.xhtml" and path("a", "./b//c?d") == "a/b/c" and path(None, "x%2Fy") == "x/y"
    assert [path("a", r) for r in ("../../x", "%FF", "%2", "/x", "http:x", "", "a\\b", "..")] == [None] * 8
    assert ev(S.percent_decoded, "a+b%C3%A9") == "a+bé" and ev(S.percent_decoded, "%FF") is None and ev(S.percent_decoded, "100%") is None
    assert ev(S.percent_decoded_or_raw, "100%+%41") == "100%+A" and ev(S.percent_decoded_or_raw, "%FF") == "%FF"
    assert ev(S.has_scheme, "mailto:x") and not ev(S.has_scheme, "1a:b")
    assert ev(S.stem, "/x/a.b.txt") == "a.b" and ev(lambda c: S.chapter_filename(S.F.lit(3), c), "book:Chapter One") == "003-chapter-one.txt"


def test_small_text_functions(ev):
    assert ev(T.paragraphs, "\n a\r\nb  c\n\n\n d\re\n") == "a b c\n\nd e"
    assert ev(T.ascii_fold, "Äbéñ") == "Aben" and ev(T.spellings, "hELLO") == ["hELLO", "hello", "Hello"]
    assert ev(T.escape_metadata, "a=b;c#\\d\r\n") == "a\\=b\\;c\\#\\\\d\\n" and ev(T.escape_html, "<a b='&\">") == "&lt;a b=&#39;&amp;&quot;&gt;"
    assert ev(T.terminal_safe, "a\x07b\u202ec\n") == "a�b�c\n"
    assert ev(T.terminated, " item ") == "item." and ev(T.terminated, "done?") == "done?"
    assert ev(T.trim, "\u3000a\x1c\u00a0") == "a\x1c" and ev(T.is_page_number, " 12 ") and not ev(T.is_page_number, "1a")


def test_phonemes(ev):
    marked = "n\u0329 l\u0329 m\u0329 ɹ\u0329 r\u0329"
    assert ev(P.repaired, marked) == "ən əl əm əɹ ər" and ev(P.repairs, marked) == 5 and ev(P.repairs, "ən əl") == 0
    assert ev(P.repaired, "x\u0329n\u0329\u0329") == "x\u0329əən"
    assert ev(P.token_ids, "hɝ") == [0, 50, 85, 0] and ev(P.token_ids, "a" * 511) is None and len(ev(P.token_ids, "a" * 510)) == 512
    assert ev(P.unsupported, "a€b€¥") == ["€", "¥"] and "'€'" in ev(P.problem, "a€") and ev(P.problem, "a") is None and ev(P.supports, "a`")
