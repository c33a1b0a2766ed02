"""SQL of the text statistics: every line, token and word as a row or a list."""

from __future__ import annotations

from ..functions.text import BLANK
from .quality import COMMON, LEARNT_CLEAN, LEARNT_WORDS

_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(COMMON)) + "]"
_EDGES = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'"
_CLEAN = r"'[\p{L}\p{Nl}\p{No}]+([''’-][\p{L}\p{Nl}\p{No}]+)*'"
_UNSEEN = r"'[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'"
_TAGS = "'</?[a-zA-Z][^<>]*>', ' ', 'g'"
_BULLET = r"'[-*+•–—]|\[[xX]?\]?|\(?\d{1,3}[.)]|[a-zA-Z]\)'"
_LANG = "lower(substr(trim(lang), 1, 2))"


def _share(part: str, of: str) -> str:
    return f"case when {of} > 0 then {part} / {of} else 0e0 end"


STATISTICS = rf"""with docs as (select doc_id, any_value(text) as text, any_value(lang) as lang from documents where doc_id is not null and text is not null group by doc_id),
    lines as (select doc_id, lang, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as l from docs),
    toks as (select *, list_filter(string_split_regex(line, '{BLANK}+'), lambda x: x <> '') as toks from lines),
    tok as (select doc_id, lang, l, unnest(toks) as tok, unnest(range(len(toks))) as k, len(toks) as n from toks),
    pieces as (select *, case when length(tok) <= 64 then list_transform(list_filter(string_split(regexp_replace(regexp_replace(tok, {_UNSEEN}), {_TAGS}), ' '), lambda x: x <> ''), lambda x: regexp_replace(x, {_EDGES})) end as w from tok),
    known as (select doc_id, lang, l, list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_full_match(x, {_CLEAN})) as clean, len(list_filter(w, lambda x: x <> '')) as n from pieces where w is not null),
    sentences as (select doc_id, {_LANG} as lang, flatten(list(clean)) as clean from known where lang is not null group by doc_id, lang, l having sum(n) >= {LEARNT_WORDS} and sum(len(clean)) >= {LEARNT_CLEAN}e0 * sum(n)),
    langs as (select {_LANG} as lang, count(*) as documents from docs where length(trim(lang)) >= 2 group by 1 having count(*) >= 50 and {_LANG} not in ('en', 'de', 'fr', 'es')),
    learnt as (select lang, word from (select distinct doc_id, lang, unnest(clean) as word from sentences) join langs using (lang) group by lang, word, documents having count(*) >= 0.4e0 * documents),
    common as (select list(word) as words from (select unnest({_LIST}) as word union select word from learnt)),
    counted as (select doc_id, l, k, n, tok, coalesce(len(w), 1) as words, coalesce(list_sum(list_transform(w, lambda x: length(x))), case when w is null then length(tok) else 0 end) as word_chars,
        coalesce(len(list_filter(w, lambda x: regexp_full_match(x, {_CLEAN}))), 0) as clean, coalesce(len(list_filter(w, lambda x: list_contains(common.words, lower(x)))), 0) as common,
        length(regexp_replace(tok, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(tok, '[^\p{{Nd}}]', '', 'g')) as digits, length(tok) as chars,
        contains('.!?…:;"”»''', right(tok, 1)) as ends, w is not null and regexp_full_match(tok, {_BULLET}) as bullet from pieces, common),
    per_line as (select doc_id, l, sum(words) as words, sum(word_chars) as word_chars, sum(clean) as clean, sum(common) as common, sum(letters) as letters, sum(digits) as digits, sum(chars - letters - digits) as symbols,
        bool_or(ends and k = n - 1) and sum(words) > 0 as ended, bool_or(bullet and k = 0) and sum(words) > 0 as bullet from counted group by doc_id, l),
    whole as (select lines.doc_id, length(line) as chars, p.* exclude (doc_id, l), coalesce(words > 0 and common >= 0.18e0 * words and clean >= 0.6e0 * words, false) as prose from lines left join per_line p using (doc_id, l)),
    sums as (select doc_id, sum(chars) as chars, coalesce(sum(words), 0) as words, count(*) as lines, coalesce(sum(word_chars), 0) as word_chars, coalesce(sum(symbols), 0) as symbols, coalesce(sum(digits), 0) as digits, coalesce(sum(letters), 0) as letters,
        count(*) filter (words > 0) as filled, count(*) filter (ended) as ended, count(*) filter (bullet) as bullets, coalesce(sum(common), 0) as common, coalesce(sum(clean), 0) as clean, coalesce(sum(chars) filter (prose), 0) as prose from whole group by doc_id),
    st as (select doc_id, cast(chars as bigint) as chars, cast(words as bigint) as words, lines, {_share("word_chars", "words")} as mean_word_length, {_share("symbols", "(symbols + digits + letters)")} as symbol_ratio, {_share("digits", "(symbols + digits + letters)")} as digit_ratio,
        {_share("ended", "filled")} as ended_line_share, {_share("bullets", "filled")} as bullet_line_share, {_share("common", "words")} as common_word_share, {_share("clean", "words")} as clean_word_share, {_share("prose", "chars")} as prose_share,
        case when words > 0 then {_share("prose", "chars")} >= 0.45e0 end as is_prose from sums)"""
