"""The queries' questions in SQL for an engine without look-behind, folds or Spark's functions.

Common table expressions build on each other in the order of ``STEPS``; a query names the last that it needs.
"""

from __future__ import annotations

from .functions.phonemes import VOCABULARY
from .functions.structure import CUE_KINDS, MAJOR_KINDS, NUMBER_WORDS
from .functions.text import FOLD_FROM, FOLD_TO
from .operators.issues import KINDS
from .queries import DECORATED, LIMIT, PACK, PIECE, RATE
from .sources.static import VOICES

WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PAUSE = RATE * 120 // 1000


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def inline(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def speech(table: str, key: str, text: str, prefix: str) -> list[tuple[str, str]]:
    """Steps of normalisation as expressions; the last has ``spoken``."""
    url = r"""(?s)^([(\[{"'']*)(https?://.*?)([.,;:!?)\]}"'']*)$"""
    core = rf"regexp_replace(regexp_extract(w, '{url}', 2), '^https?://www\.', '')"
    for sign, name in ((".", "dot"), ("/", "slash"), ("-", "dash"), ("_", "underscore"), ("?", "question mark"), ("&", "and"), ("=", "equals"), ("#", "hash")):
        core = f"replace({core}, '{sign}', ' {name} ')"
    said = f"concat(regexp_extract(w, '{url}', 1), {inline(core)}, regexp_extract(w, '{url}', 3))"
    return [
        (f"{prefix}1", f"select {key}, replace(replace(replace(replace({text}, '-' || chr(13) || chr(10), ''), '-' || chr(10), ''), '-' || chr(13), ''), chr(173), '') as t from {table}"),
        (f"{prefix}2", rf"select {key}, t as t0, regexp_replace(t, '\$([0-9,.]+)', '\1 dollars', 'g') as t from {prefix}1"),
        (f"{prefix}3", rf"select {key}, t as t1, replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x{{a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'), '[—–]', ', ', 'g'), '“', '\"'), '”', '\"') as t from {prefix}2".replace('\\"', '"')),
        (f"{prefix}4", f"select {key}, t1, replace(replace(replace(replace(replace(replace(replace(t, '‘', ''''), '’', ''''), '…', '...'), '$', ' dollars '), '×', ' times '), '=', ' equals '), '©', ' copyright ') as t from {prefix}3"),
        (f"{prefix}5", rf"select {key}, t as t2, regexp_replace(t, '\.{WS}*\.{WS}*\.', '...', 'g') as t from {prefix}4"),
        (f"{prefix}6", rf"select {key}, t as t3, regexp_replace(t, '\[[0-9,\- ]+\]', '', 'g') as t from {prefix}5"),
        (f"{prefix}7", f"select {key}, array_to_string(list_filter(list_transform({tokens('t')}, lambda w: case when regexp_matches(w, '{url}') then {said} else w end), lambda w: w <> ''), ' ') as spoken from {prefix}6"),
    ]


def sentences(x: str) -> str:
    short = r"(?:(?:^|[^\p{L}])(?:(?i:dr|mr|mrs|ms|prof|sr|jr|st|vs|etc)|\p{L}))"
    guarded = x
    for _ in range(2):
        guarded = rf"regexp_replace({guarded}, '({short})\.', '\1' || chr(2), 'g')"
    marked = rf"""regexp_replace({guarded}, '((?:[.!?…]|{{STOP}})["''”’)\]]*)(?:{WS}+|$)', '\1' || chr(1), 'g')""".replace("|{STOP}", "")
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: replace({trim('s')}, chr(2), '.')), lambda s: s <> '')"


def packed(words: str, limit: int) -> str:
    """Greedy packing as a fold over a list of strings: pieces stand between chr(3), the last is still open."""
    last = "regexp_extract(acc, '[^' || chr(3) || ']*$')"
    return f"string_split(list_reduce({words}, lambda acc, w: case when length({last}) + 1 + length(w) <= {limit} then acc || ' ' || w else acc || chr(3) || w end), chr(3))"


_HEADING = (
    rf"length(norm) <= 120 and regexp_matches(norm, '^(?i:chapter|part|book)( |$)') and len(w) >= 2 "
    rf"and regexp_full_match(upper(regexp_replace(w[2], '^[:.\-–—]+|[:.\-–—]+$', '', 'g')), '[0-9]+|[IVXLCDM]+|{'|'.join(NUMBER_WORDS)}') "
    r"and (len(w) <= 2 or not regexp_matches(norm, '\p{Ll}') or ends_with(w[2], ':') or list_contains([':', '-', '–', '—'], w[3]))"
)
_TITLE = r"""case when regexp_matches(norm, '\p{Ll}') then norm else array_to_string(list_transform(w, lambda x: case when regexp_full_match(x, '(?:[^\p{L}]|[IVXLC])*') then x else upper(x[1]) || lower(x[2:]) end), ' ') end"""

_UNITS = speech("items", "doc_id, preorder, ord, id, section_id, cue, start_byte", "said", "u")
STEPS: list[tuple[str, str]] = [
    ("docs", f"select doc_id, {DECORATED} as text from documents"),
    *speech("docs", "doc_id", "text", "n"),
    # lines: the text after every line end; the lengths in bytes of lines and line ends give the offsets
    ("cut", r"select doc_id, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) as parts, text from docs"),
    ("lines0", "select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as k, len(parts) as n from cut"),
    ("lines", f"select doc_id, k, line, strlen(line) as size, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as start_byte, {inline('line')} as norm, {tokens('line')} as w from lines0 qualify not (k = n and line = '')"),
    ("heads", f"select *, {_HEADING} as is_head, case when {_HEADING} then case when lower(w[1]) = 'chapter' then 'Chapter' else 'Part' end end as kind, case when {_HEADING} then {_TITLE} end as title from lines"),
    ("marked", "select *, sum(is_head::int) over win as sec, max(case when kind = 'Part' then k end) over win as part_k, sum((is_head or norm = '')::int) over win as para from heads window win as (partition by doc_id order by k rows between unbounded preceding and current row)"),
    ("parts", "select doc_id, k as part_k, sec as part_sec from marked where kind = 'Part'"),
    ("headed", "select m.doc_id, m.sec as preorder, 'section-' || m.sec as section_id, case when m.kind = 'Chapter' and p.part_sec is not null then 'section-' || p.part_sec else 'book' end as parent_id, m.kind, m.title, m.start_byte, m.start_byte + m.size as stop_byte from marked m left join parts p on m.doc_id = p.doc_id and m.part_k = p.part_k where m.is_head"),
    ("plain", "select doc_id from docs where doc_id not in (select doc_id from headed)"),
    ("sections", "select doc_id, 'book' as section_id, null as parent_id, 0 as preorder, 0 as level, 'Book' as kind, 'd' || doc_id as title, null as start_byte, null as stop_byte from docs union all select doc_id, 'section-1', 'book', 1, 1, 'BodyMatter', 'Body', null, null from plain union all select doc_id, section_id, parent_id, preorder, case when parent_id = 'book' then 1 else 2 end, kind, title, start_byte, stop_byte from headed"),
    ("paras", "select doc_id, sec, para, string_agg(norm, ' ' order by k) as text, min(start_byte) as start_byte, max(start_byte + size) as stop_byte, min(k) as k from marked where not is_head and norm <> '' group by all"),
    ("blocks", "select doc_id, case when doc_id in (select doc_id from plain) then 1 else sec end as preorder, text, start_byte, stop_byte, k from paras"),
    ("placed", "select doc_id, preorder, case when preorder = 0 then 'book' else 'section-' || preorder end as section_id, row_number() over (partition by doc_id, preorder order by k) as block_ord, text, start_byte, stop_byte from blocks"),
    ("items", rf"select doc_id, preorder, 0 as ord, section_id || ':heading' as id, section_id, title as said, null as cue, start_byte from sections where kind not in ('Book', 'BodyMatter') union all select doc_id, preorder, block_ord, section_id || ':block:' || block_ord, section_id, text, 'Paragraph', start_byte from placed where not regexp_full_match({trim('text')}, '[0-9]+')"),
    *_UNITS,
    ("sents", f"select doc_id, preorder, ord, id, section_id, cue, start_byte, {sentences('spoken')} as s from u7 where spoken <> ''"),
    ("units", "select *, row_number() over (partition by doc_id order by preorder, ord, sno) - 1 as unit_ord from (select doc_id, preorder, ord, id, section_id, cue, start_byte, unnest(s) as text, generate_subscripts(s, 1) as sno from sents)"),
    ("asked", f"select *, {packed(tokens('text'), LIMIT)} as pieces from units"),
    ("timed0", "select *, len(pieces) as requests, list_sum(list_transform(pieces, lambda p: greatest(length(p) * 10, 1))) as samples from asked"),
    ("timed", f"select *, coalesce(sum(samples + {PAUSE}) over (partition by doc_id order by unit_ord rows between unbounded preceding and 1 preceding), 0)::bigint as start_sample, max(unit_ord) over (partition by doc_id) as last_ord from timed0"),
    ("bounds", f"select *, (start_sample * 1000) // {RATE} as start_ms, ((start_sample + samples) * 1000)::bigint // {RATE} as end_ms from timed"),
    ("tree", "select doc_id, section_id, section_id as above from sections union all select doc_id, section_id, parent_id from sections where parent_id is not null union all select s.doc_id, s.section_id, 'book' from sections s where s.parent_id not in ('book') and s.parent_id is not null"),
    ("cleaned", r"select doc_id, unit_ord, id || ':sentence:' || sno as unit_id, regexp_replace(text, '[^\p{L}\p{N}''.,;:!?() ]', ' ', 'g') as text from units"),
    ("pieces", f"select doc_id, unit_ord, unnest(c) as piece, generate_subscripts(c, 1) as chunk from (select doc_id, unit_ord, {packed(tokens('text'), 400)} as c from cleaned where trim(text) <> '')"),
    ("told", f"select doc_id, unit_ord, chunk, unnest(s) as sentence, generate_subscripts(s, 1) as within from (select *, {sentences('piece')} as s from pieces)"),
    ("heard", rf"select doc_id, unit_ord, chunk, within, place, regexp_replace(regexp_replace(token, '^[^\p{{L}}\p{{Nd}}'']+', ''), '[^\p{{L}}\p{{Nd}}'']+$', '') as word from (select *, unnest(w) as token, generate_subscripts(w, 1) as place from (select *, {tokens('sentence')} as w from told))"),
    ("tried", f"select *, word = '' or word in ('the', 'Ames', '5', '3', '15') or regexp_full_match(word, '[A-Za-z]+') as known, regexp_full_match(translate(word, '{FOLD_FROM}', '{FOLD_TO}'), '[A-Za-z]+') as mended from heard"),
    ("raised", "select doc_id, 'unknown_g2p_token' as kind, arg_min(word, place) as token, null as unit_id from tried where not known and not mended group by doc_id, unit_ord, chunk, within union all select doc_id, 'empty_narration_unit', null, unit_id from cleaned where trim(text) = ''"),
    ("merged", "select doc_id, kind, coalesce(token, unit_id) as what, count(*) as n from raised group by all"),
    ("spans", "select t.doc_id, t.above as section_id, min(b.start_ms) as start_ms, max(b.end_ms) as end_ms, min(b.unit_ord) as unit_start from tree t join bounds b on t.doc_id = b.doc_id and t.section_id = b.section_id group by all"),
]


def with_steps(last: str, query: str) -> str:
    """``query`` over the steps up to ``last``, without those that it can't reach."""
    import re

    names = [n for n, _ in STEPS]
    steps = dict(STEPS[: names.index(last) + 1])
    wanted, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in steps:
            if name not in wanted and re.search(rf"\b(?:from|join) {name}\b", text):
                wanted.add(name)
                todo.append(steps[name])
    return "with " + ", ".join(f"{n} as materialized ({steps[n]})" for n in steps if n in wanted) + " " + query


def _rules(p: str) -> dict[str, str]:
    """How often each rule acts on a text, counted on what the rule reads: the steps of prefix ``p`` and the text, ``d.t``."""
    many = lambda t, x: rf"len(regexp_extract_all({t}, '{x}'))"
    return {
        "soft_hyphen_line_join": many("d.t", r"-\n"), "soft_hyphen": "length(d.t) - length(replace(d.t, chr(173), ''))", "currency_expansion": many(f"{p}2.t0", r"\$"), "zero_width": many(f"{p}3.t1", r"[\x{200b}\x{200c}\x{200d}\x{feff}]"),
        "non_breaking_space": many(f"{p}3.t1", r"[\x{a0}\x{2007}\x{202f}]"), "dash": many(f"{p}3.t1", "[—–]"), "curly_quote": many(f"{p}3.t1", "[“”]"), "curly_apostrophe": many(f"{p}3.t1", "[‘’]"), "ellipsis": many(f"{p}3.t1", "…"),
        "multiply_expansion": many(f"{p}3.t1", "×"), "equals_expansion": many(f"{p}3.t1", "="), "copyright_expansion": many(f"{p}3.t1", "©"), "spaced_ellipsis": many(f"{p}5.t2", rf"\.{WS}*\.{WS}*\."), "numeric_citation": many(f"{p}6.t3", r"\[[0-9,\- ]+\]"),
        "url": rf"""len(list_filter({tokens(f'{p}6.t')}, lambda w: regexp_matches(w, '^[(\[{{"'']*https?://')))""",
    }


def _counts() -> str:
    """Repairs of each document by rule."""
    steps = " ".join(f"join n{k} on d.doc_id = n{k}.doc_id" for k in (2, 3, 5, 6))
    each = " union all ".join(f"select d.doc_id, '{rule}' as rule, {n} as n from (select doc_id, text as t from docs) d {steps}" for rule, n in _rules("n").items())
    return f"select rule, sum(n)::bigint as repairs, count(*) as documents from ({each}) where n > 0 group by rule"


def _report() -> str:
    """What was scanned, repaired and found in each document."""
    steps = " ".join(f"join u{k} on d.doc_id = u{k}.doc_id and d.id = u{k}.id" for k in (2, 3, 5, 6))
    repairs = f"select d.doc_id, sum({' + '.join(_rules('u').values())})::bigint as n from (select doc_id, id, said as t from items) d {steps} where exists (select 1 from units where units.doc_id = d.doc_id and units.id = d.id) group by d.doc_id"
    return (
        f"select s.doc_id::varchar as book_id, s.n as scanned_units, coalesce(h.n, 0) as scanned_sentences, 0::bigint as automatic_repairs, r.n as text_repairs, coalesce(m.n, 0)::bigint as best_effort_pronunciations, "
        "coalesce(i.blocking, 0)::bigint as unresolved, '{' || coalesce(i.kinds, '') || '}' as issues_by_kind, coalesce(i.blocking, 0) = 0 as complete "
        f"from (select doc_id, count(*) as n from units group by doc_id) s join ({repairs}) r on s.doc_id = r.doc_id left join (select doc_id, count(*) as n from told group by doc_id) h on s.doc_id = h.doc_id "
        "left join (select doc_id, sum((not known and mended)::int) as n from tried group by doc_id) m on s.doc_id = m.doc_id "
        "left join (select doc_id, sum(case when kind = 'unknown_g2p_token' then n else 0 end) as blocking, string_agg('\"' || kind || '\":' || n, ',' order by kind) as kinds from (select doc_id, kind, sum(n)::bigint as n from merged group by all) group by doc_id) i on s.doc_id = i.doc_id"
    )


def _paths() -> str:
    """The base is a/b: each step up takes a folder, a third step up leaves the archive; a sign that isn't two hex digits spoils the text."""
    reference = "repeat('../', (page_id % 4)::int) || path || case when page_id % 3 = 0 then '%20x%C3%A9' when page_id % 7 = 1 then '%zz' else '' end || '?q=1#f'"
    path = "regexp_replace(reference, '[?#].*$', '')"
    broken = lambda x: f"contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')"
    parts = f"list_filter(string_split(replace(replace({path}, '%20', ' '), '%C3%A9', 'é'), '/'), lambda x: x not in ('', '.', '..'))"
    return (
        f"select page_id, case when {broken(path)} or page_id % 4 > 2 then null else array_to_string(list_concat((['a', 'b'])[1:(2 - page_id % 4)::int], {parts}), '/') end as resolved, case when not {broken('reference')} then replace(replace(reference, '%20', ' '), '%C3%A9', 'é') end as decoded "
        f"from (select page_id, {reference} as reference from (select page_id, regexp_replace(url, '^https?://', '') as path from pages))"
    )


def _pages() -> str:
    """Blocks of pages that have a list of links, an advertisement, a heading, paragraphs whose ends may be missing, and a footer."""
    plain = "regexp_replace(regexp_replace({}, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
    text = plain
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    shown = inline(text.format("raw"))
    rows = (
        "select page_id, 1 as part, 0 as k, 'Navigation' as kind, 'book' as section_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as raw from pages union all select page_id, 2, 0, 'Paragraph', 'book', regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) from pages union all "
        "select page_id, 3, generate_subscripts(ps, 1), 'Paragraph', 'section-1', unnest(ps) from (select page_id, string_split(regexp_extract(html, '(?s)</h1>(.*?)(?:</article>|$)', 1), '<p>') as ps from pages) union all "
        "select page_id, 4, 0, 'Paragraph', 'section-1', regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1) from pages"
    )
    return f"select page_id, section_id, row_number() over (partition by page_id, section_id order by part, k)::int as block_ord, kind, text from (select page_id, part, k, kind, section_id, {shown} as text from ({rows})) where text <> ''"


def _roman(n: str) -> str:
    rows = {100: ",c,cc,ccc,cd,d,dc,dcc,dccc,cm", 10: ",x,xx,xxx,xl,l,lx,lxx,lxxx,xc", 1: ",i,ii,iii,iv,v,vi,vii,viii,ix"}
    return f"repeat('m', ({n}) // 1000) || " + " || ".join(f"string_split('{row}', ',')[({n}) // {p} % 10 + 1]" for p, row in rows.items())


def _letters(n: str) -> str:
    two = f"case when ({n}) > 26 then chr(96 + ((({n}) - 27) // 26 % 26 + 1)::int) else '' end || chr(97 + ((({n}) - 1) % 26)::int)"
    return f"case when ({n}) > 702 then chr(96 + ((({n}) - 703) // 676 + 1)::int) else '' end || {two}"


def oracle_sql() -> dict[str, str]:
    ids = "map {" + ", ".join(f"'{k}': {v}" for k, v in VOCABULARY.items()) + "}"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    cue = "case s.kind " + " ".join(f"when '{k}' then '{v}'" for k, v in CUE_KINDS.items()) + " else 'Other' end"
    major = ", ".join(f"'{k}'" for k in MAJOR_KINDS)
    number = "start_number + page_index - start_index"
    spaced = f"list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda l: {inline('l')}), lambda l: true)"
    texts = f"select doc_id, string_agg(part, chr(10) || chr(10) order by preorder, ord) as text from (select doc_id, preorder, 0 as ord, title as part from sections where kind not in ('Book', 'BodyMatter') union all select doc_id, preorder, block_ord, text from placed) group by doc_id"
    asked = "select doc_id, unit_ord, unnest(pieces) as p, generate_subscripts(pieces, 1) as k from asked"
    hit = f"select doc_id, count(*) as requests, sum((rn > 1)::bigint)::bigint as hits from (select doc_id, row_number() over (partition by doc_id, p order by unit_ord, k) as rn from ({asked})) group by doc_id"
    return {
        "narration_totals": with_steps("bounds", "select doc_id, count(*) as units, sum(requests)::bigint as requests, max(end_ms) as duration_ms from bounds group by doc_id"),
        "speech_normalize": with_steps("n7", "select doc_id, spoken from n7"),
        "repair_counts_by_rule": with_steps("n7", _counts()),
        "sentence_split": with_steps("n7", f"select doc_id, (generate_subscripts(s, 1) - 1)::int as sentence_no, unnest(s) as sentence from (select doc_id, {sentences('spoken')} as s from n7)"),
        "conversation_sentences": f"select conv_id, turn, (generate_subscripts(s, 1) - 1)::int as sentence_no, unnest(s) as sentence from (select conv_id, turn, {sentences('text')} as s from conversations)",
        "greedy_chunks": with_steps("docs", f"select doc_id, (generate_subscripts(c, 1) - 1)::int as chunk_no, unnest(c) as chunk from (select doc_id, {packed(tokens('text'), PIECE)} as c from docs)"),
        "pack_sentences": with_steps("n7", _packed_sentences()),
        "whole_text_paragraphs": with_steps("docs", f"select doc_id, replace(replace(regexp_replace(regexp_replace(array_to_string({spaced}, chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n\\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)) as text from docs"),
        "ascii_fold": f"select doc_id, translate(text, '{FOLD_FROM}', '{FOLD_TO}') as folded from documents",
        "txt_sections": with_steps("sections", "select doc_id, section_id, parent_id, preorder::int as preorder, level::int as level, kind, title, start_byte::bigint as start_byte, stop_byte::bigint as stop_byte from sections"),
        "txt_blocks": with_steps("placed", "select doc_id, section_id, block_ord::int as block_ord, text, start_byte::bigint as start_byte, stop_byte::bigint as stop_byte from placed"),
        "section_word_counts": with_steps("placed", f"select doc_id, len({tokens('text')})::bigint as words, length(text)::bigint as characters from ({texts})"),
        "narration_units": with_steps("units", "select doc_id, unit_ord, id || ':sentence:' || sno as unit_id, text from units"),
        "unit_timeline": with_steps("bounds", f"select doc_id, unit_ord, requests::bigint as requests, start_ms, end_ms, (case when unit_ord < last_ord then {PAUSE} else 0 end)::bigint as silence from bounds"),
        "cue_intervals": with_steps("spans", f"select doc_id, id || ':sentence:' || sno as cue_id, 'Sentence' as kind, start_ms, end_ms from bounds where cue is not null union all select doc_id, id, 'Paragraph', min(start_ms), max(end_ms) from bounds where cue is not null group by doc_id, id union all select p.doc_id, 'section:' || p.section_id, {cue}, p.start_ms, p.end_ms from spans p join sections s on p.doc_id = s.doc_id and p.section_id = s.section_id"),
        "page_cues_forward_asof": with_steps("bounds", "select b.doc_id, b.page_ord::bigint as page_ord, 'page:' || (b.page_ord + 1) || ':' || (b.page_ord + 1) as cue_id, c.start_ms, c.section_id from (select p.doc_id, p.page_ord, min(u.unit_ord) as unit_ord from (select doc_id, unnest(range(0, strlen(text)::bigint // 1000 + 1)) as page_ord from docs) p join bounds u on p.doc_id = u.doc_id and u.start_byte >= p.page_ord * 1000 group by all) b join bounds c on b.doc_id = c.doc_id and b.unit_ord = c.unit_ord"),
        "visible_chapters": with_steps("spans", f"select doc_id, row_number() over (partition by doc_id order by start_ms) - 1 as chapter_ord, section_id, title, start_ms, greatest(coalesce(lead(start_ms) over (partition by doc_id order by start_ms), total), start_ms + 1) as end_ms from (select s.doc_id, s.section_id, s.title, p.start_ms, t.total from sections s join spans p on s.doc_id = p.doc_id and s.section_id = p.section_id join (select doc_id, max(end_ms) as total from bounds group by doc_id) t on s.doc_id = t.doc_id where s.kind in ({major}) qualify row_number() over (partition by s.doc_id, p.start_ms order by s.preorder desc) = 1 union all select d.doc_id, 'book', 'd' || d.doc_id, 0, t.total from plain d join (select doc_id, max(end_ms) as total from bounds group by doc_id) t on d.doc_id = t.doc_id)"),
        "chapter_islands": with_steps("units", "select doc_id, row_number() over (partition by doc_id order by min(unit_ord)) as chapter, lpad((row_number() over (partition by doc_id order by min(unit_ord)))::varchar, 3, '0') || '-' || section_id || '.txt' as file_name, sha256(string_agg(text, chr(10) order by unit_ord)) as text_sha256 from (select *, unit_ord - row_number() over (partition by doc_id, section_id order by unit_ord) as island from units) group by doc_id, section_id, island"),
        "cache_hits": with_steps("asked", hit),
        "manifest_counts": with_steps("asked", f"select t.doc_id, len({tokens('t.text')})::bigint as source_words, length(t.text)::bigint as source_characters, u.narrated_words, u.units, u.narrated_characters, h.requests as provider_chunks, h.hits as cache_hits, h.requests - h.hits as generated_chunks from ({texts}) t join (select doc_id, sum(len({tokens('text')}))::bigint as narrated_words, count(*) as units, (sum(length(text)) + count(*) - 1)::bigint as narrated_characters from units group by doc_id) u on t.doc_id = u.doc_id join ({hit}) h on t.doc_id = h.doc_id"),
        "page_labels_backward_asof": f"with r as (select * from (values ('0', 0, '', 'r', 1), ('0', 9, 'A-', 'D', 3), ('1', 0, '', 'D', 1), ('1', 4, 'x', 'a', 1), ('2', 0, 'p', null, 1), ('2', 7, '', 'R', 40), ('3', 0, '', 'A', 20)) t(b, start_index, prefix, style, start_number)), p as (select (doc_id % 5)::varchar as b, doc_id // 5 as page_index from documents) select p.b as book_id, page_index, case when r.b is null then (page_index + 1)::varchar else prefix || case style when 'D' then ({number})::varchar when 'r' then {_roman(number)} when 'R' then upper({_roman(number)}) when 'a' then {_letters(number)} when 'A' then upper({_letters(number)}) else '' end end as label from p asof left join r on p.b = r.b and p.page_index >= r.start_index",
        "outline_assignment": "with p as (select doc_id % 5 as book_id, doc_id // 5 as page from documents), o as (select page_id % 5 as book_id, page_id // 10 as page, page_id % 3 + 1 as level, page_id as item from pages) select p.book_id, p.page, (select o.item from o where o.book_id = p.book_id and o.page <= p.page order by o.page desc, o.level desc, o.item desc limit 1) as item from p",
        "clamped_levels": "with recursive r as (select doc_id % 50 as book_id, doc_id // 50 as item, n_chars % 7 as level from documents), f as (select book_id, item, greatest(1, least(level, 1))::bigint as level from r where item = 0 union all select r.book_id, r.item, greatest(1, least(r.level, f.level + 1))::bigint from f join r on r.book_id = f.book_id and r.item = f.item + 1) select * from f",
        "section_parents": "with r as (select doc_id % 50 as book_id, doc_id // 50 as preorder, n_chars % 5 as level from documents) select r.book_id, r.preorder, (select max(q.preorder) from r q where q.book_id = r.book_id and q.preorder < r.preorder and q.level < r.level) as parent from r",
        "issue_dedup_keep_first": f"with r as (select (doc_id % 20)::varchar as book_id, doc_id // 20 as ord, concat(source, ':', md5(text)) as signature, {kinds}[(n_chars % 7 + 1)::int] as kind, doc_id::varchar as unit_id, greatest(n_chars % 3, 1) as n from documents), g as (select book_id, signature, sum(n)::bigint as occurrences, min(ord) as ord, arg_min(kind, ord) as kind, arg_min(unit_id, ord) as unit_id from r group by all) select book_id, row_number() over (partition by book_id order by ord) - 1 as issue_ord, signature, occurrences, kind, unit_id from g",
        "phoneme_tokens": f"with w as (select w as word, count(*) as n from (select unnest({tokens('text')}) as w from documents) group by w), c as (select word, n, list_filter(string_split(word, ''), lambda x: x <> '') as cs from w) select word, n, case when len(list_filter(cs, lambda x: not list_contains(map_keys({ids}), x))) = 0 and len(cs) <= 510 then '0 ' || array_to_string(list_transform(cs, lambda x: {ids}[x]), ' ') || ' 0' end as ids, array_to_string(list_transform(list_filter(range(1, len(cs) + 1), lambda i: not list_contains(map_keys({ids}), cs[i]) and list_position(cs, cs[i]) = i), lambda i: cs[i]), '') as unsupported from c",
        "unresolved_issues": with_steps("merged", "select kind, sum(n)::bigint as occurrences, count(*) as signatures from merged group by kind"),
        "suggestion_tokens": with_steps("merged", "select what as token, what || '=' as line, count(*) as books from merged where kind = 'unknown_g2p_token' group by what"),
        "preflight_report": with_steps("merged", _report()),
        "archive_paths": _paths(),
        "html_blocks": _pages(),
        "voices": "select * from (values " + ", ".join(f"('{a}', '{b}', {str(a.startswith('b')).lower()})" for a, b in VOICES) + ") t(name, sha256, british)",
    }


def _packed_sentences() -> str:
    """Sentences above the limit become pieces of words between two marks, so that nothing is added to them."""
    last = "regexp_extract(acc, '[^' || chr(3) || ']*$')"
    long = f"chr(3) || array_to_string({packed(tokens('w'), PACK)}, chr(3)) || chr(3)"
    fold = f"list_reduce(list_concat([''], s), lambda acc, w: case when length(w) > {PACK} then acc || {long} when length({last}) + (case when {last} = '' then 0 else 1 end) + length(w) <= {PACK} then acc || (case when {last} = '' then '' else ' ' end) || w else acc || chr(3) || w end)"
    return f"select doc_id, (generate_subscripts(c, 1) - 1)::int as chunk_no, unnest(c) as chunk from (select doc_id, list_filter(string_split({fold}, chr(3)), lambda x: x <> '') as c from (select doc_id, {sentences('spoken')} as s from n7))"
