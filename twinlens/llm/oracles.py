"""SQL for DuckDB that gives the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from twinlens.llm import license_scan, quality_rules

_SPACE = r"'[\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {_SPACE}), lambda x: x <> '')"


def _alnum(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({_LOWER.format(text)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _license() -> str:
    phrases = ", ".join(f"('{k}', {x.split()!r})" for k, x in license_scan.PHRASES)
    templates = ", ".join(f"('{k}', {i}, {license_scan.half_of(len(x.split()))}, {sorted(set(x.split()))!r})" for i, (k, x) in enumerate(license_scan.TEMPLATES))
    return f"""
with w as (select doc_id, {_alnum("text")} as ws from documents),
p as (select * from (values {phrases}) t(label, words)),
places as (select distinct doc_id, i, label from (select doc_id, ws, unnest(range(0, len(ws))) as i from w) x, p where ws[i + 1] = p.words[1] and ws[i + 1 : i + len(p.words)] = p.words),
t as (select *, len(words) as size from (values {templates}) t(label, number, half, words)),
blocks as (select distinct doc_id, half, b, unnest(ws[b + 1 : b + 2 * half]) as word from (select doc_id, ws, half, unnest(range(0, len(ws), half)) as b from w, (select distinct half from t))),
met as (select doc_id, label, number, count(*) / any_value(size)::double as share from blocks join (select label, number, half, size, unnest(words) as word from t) using (word, half)
  group by doc_id, b, label, number having count(*) >= ceil(0.8 * any_value(size) - 1e-9)),
l as (select doc_id, label from places union select doc_id, label from met)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(best, 0))::double as score
from w left join (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id) using (doc_id)
left join (select doc_id, string_agg(distinct label, ',' order by label) as labels from l group by doc_id) using (doc_id)
left join (select doc_id, max(share) as best from met group by doc_id) using (doc_id)"""


_DECONTAMINATION = f"""
with w as (select doc_id, {_alnum("text")} as ws from documents), b as (select item_id, {_alnum("text")} as ws from benchmark),
k as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i + 1 : i + 10], ' ') as key from (select item_id, ws, unnest(range(0, greatest(1, len(ws) - 9))) as i from b where len(ws) > 0)),
d as (select doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') as key from (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) as i from w, (select distinct n from k) where len(ws) >= n)),
h as (select doc_id, i, d.n, item_id from d join k on k.key = d.key and k.n = d.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c using (doc_id) left join t using (doc_id)"""

_SUBSTRINGS = f"""
with w as (select doc_id, {_words("coalesce(text, '')")} as ws from documents),
k as (select doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') as key from (select doc_id, ws, unnest(range(0, len(ws) - 19)) as i from w where len(ws) >= 20)),
f as (select doc_id, i, row_number() over (partition by key order by doc_id, i) as place from k),
c as (select distinct doc_id, unnest(range(i, i + 20)) as p from f where place > 1),
u as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as p from w),
r as (select u.doc_id, count(*) as n_kept, string_agg(word, ' ' order by u.p) as kept from u left join c on c.doc_id = u.doc_id and c.p = u.p where c.p is null group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join r using (doc_id)"""

_NEAR = f"""
with recursive w as (select doc_id, {_words(_LOWER.format("text"))} as ws from documents),
s as (select distinct doc_id, case when len(ws) < 4 then '!' || array_to_string(ws, ' ') else array_to_string(ws[i + 1 : i + 4], ' ') end as key
  from (select doc_id, ws, unnest(range(0, greatest(1, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.key = y.key and x.doc_id <> y.doc_id group by 1, 2) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 80 * (na.n + nb.n - shared)),
r(node, root) as (select doc_id, doc_id from n union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as root from r group by node)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(root, w.doc_id) as component_id, coalesce(root, w.doc_id) = w.doc_id as kept from w left join n using (doc_id) left join c on c.node = w.doc_id"""


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    broken = ["case when base_failed then 'base' end"]
    for name, measure, least, most in quality_rules.RULES:
        broken.append(f"case when {' or '.join(([f'{measure} < {least}'] if least is not None else []) + ([f'{measure} > {most}'] if most is not None else []))} then '{name}' end")
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, text, {_words("text")} as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
k as (select doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') as key from (select doc_id, ws, unnest(range(0, len(ws) - 7)) as i from w where len(ws) >= 8)),
m as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, key) as n from k) where n > 1),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as p from m) group by doc_id),
x as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(list_filter(ws, lambda v: lower(v) in ({stop}))) as n_stop,
  length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) as n_same from w left join c using (doc_id)),
y as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(n_symbols / nullif(n_words, 0)::double, 0) as symbol_ratio, coalesce(n_stop / nullif(n_words, 0)::double, 0) as stop_ratio,
  coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) as dup_line_ratio, coalesce(word_chars / nullif(n_words, 0)::double, 0) as mean_word, coalesce(n_upper / nullif(word_chars, 0)::double, 0) as upper_ratio, coalesce(n_same / nullif(n_words, 0)::double, 0) as same_ratio from x),
z as (select *, array_to_string(list_filter([{", ".join(broken)}], lambda v: v is not null), ',') as failed from y)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' as kept, failed from z"""


SQL = {
    "op3_license_scan": _license(),
    "op4_decontamination": _DECONTAMINATION,
    "op7_substring_dedup": _SUBSTRINGS,
    "op8_near_dedup": _NEAR,
    "op9_quality_rules": _quality(),
}
