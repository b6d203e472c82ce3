"""SQL for the operators that it can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
with item_words as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, least(len(w), 13) as n,
         array_to_string(list_slice(w, i, i + 12), ' ') as words
  from (select item, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from item_words where len(w) > 0)),
doc_words as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
sizes as (select distinct n from windows),
spots as (
  select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as words
  from (select r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from doc_words, sizes)),
hits as (select r, i, s.n, item from spots s join windows using (n, words)),
covered as (
  select r, count(distinct j) as n_hit
  from (select r, unnest(range(i, i + n)) as j from hits) group by r),
found as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
  from hits group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words left join covered using (r) left join found using (r)
"""

#: Code points of an escaped text: one more for each backslash and each control string.
_ESCAPED = """length({x}) + (length({x}) - length(replace({x}, '\\', '')))
    + (length({x}) - length(replace({x}, '<turn', ''))) // 5
    + (length({x}) - length(replace({x}, '</turn', ''))) // 6"""

OP3 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, ''
    order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(17 + {_ESCAPED.format(x='role')} + (length(role) - length(replace(role, chr(10), '')))
    + {_ESCAPED.format(x='text')}) as bigint) as formatted_chars
from turns group by conv_id
"""


def _field(name: str) -> str:
    text = f"cast({name} as varchar)"
    return f"coalesce(cast(strlen({text}) as varchar) || ':' || {text}, '-')"


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint))),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
                            lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _levels(name: str, leaves: str) -> str:
    """Recursive SQL: every node (tree, level, pos, hash) above ``leaves``, and the nodes of its level."""
    return f"""
{name} as (
  select tree, 0 as level, pos, hash, count(*) over (partition by tree) as n from {leaves}
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(hash, '' order by pos)), (n + 2) // 3
  from {name} where n > 1 group by tree, level, pos // 3, n)"""


def _climb(name: str, nodes: str, start: str) -> str:
    """Recursive SQL: every leaf's way up, its claim folded with the others' hashes."""
    return f"""
{name} as (
  select tree, pos, level, n, claim, told, id from (select *, 0 as level from {start})
  union all
  select w.tree, w.pos // 3, w.level + 1, (w.n + 2) // 3,
         sha256(string_agg(case when s.pos = w.pos then w.claim else s.hash end, '' order by s.pos)),
         w.told || coalesce(string_agg(s.hash, '' order by s.pos) filter (where s.pos <> w.pos), ''), w.id
  from {name} w join {nodes} s on s.tree = w.tree and s.level = w.level and s.pos // 3 = w.pos // 3
  where w.n > 1 group by w.tree, w.pos, w.level, w.n, w.claim, w.told, w.id)"""


_FIELDS = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
OP11 = f"""
with recursive rows as (
  select row_number() over () as id, doc_id, coalesce('=' || source, '') as tree,
         sha256({" || ".join([*_FIELDS, _field("text")])}) as hash,
         case when {_CRC} % 2 = 0
              then sha256({" || ".join([*_FIELDS, _field("replace(text, chr(10), '')")])}) end as altered
  from documents),
leaves as (
  select *, coalesce(altered, hash) as claim, count(*) over (partition by tree) as n,
         row_number() over (partition by tree order by doc_id nulls first, hash) - 1 as pos from rows),
{_levels("nodes", "leaves")},
tops as (select tree as source, hash, row_number() over (order by tree) - 1 as pos, '' as tree
         from nodes where n = 1),
{_levels("table_nodes", "tops")},
top as (select hash as root from table_nodes where n = 1),
{_climb("ways", "nodes", "(select tree, pos, n, claim, '' as told, id from leaves)")},
{_climb("table_ways", "table_nodes", "(select '' as tree, t.pos, (select count(*) from tops) as n, w.claim, w.told, w.id"
        " from ways w join tops t on t.source = w.tree where w.n = 1)")}
select l.doc_id, l.hash as leaf, t.hash as subroot, root, sha256(w.told) as proof_sha256,
       w.claim as folded_root, w.claim = root as verified
from leaves l join tops t on t.source = l.tree join table_ways w on w.id = l.id and w.n = 1, top
"""

OP12 = """
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over copies as keep_id, count(*) over copies as group_size,
       row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept,
       sha256(text) as text_sha256
from texts window copies as (partition by text)
"""

OP13 = """
with given as (
  select row_number() over () as r, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same,
         cast(list_inner_product(a.v, b.v) as bigint) as score
  from given a join given b on a.r <> b.r where a.vec_id % 50 = 0),
positives as (
  select anchor, anchor_id, r, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over best as integer) as rank, n.vec_id as negative_id,
       positive_score, n.score as negative_score
from positives p join scores n on n.anchor = p.anchor and not n.same
  and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
window best as (partition by p.anchor, p.r order by n.score desc, n.vec_id)
qualify rank <= 3
"""

OP10 = """
with texts as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (
  select r, doc_id, s, substring(h, 2 * s + 1, 100) as w
  from (select *, unnest(range(0, length(h) // 2 - 49)) as s from texts where doc_id is not null)),
again as (
  select r, s from strings join (select w, min(doc_id) as least from strings group by w) using (w)
  where least < doc_id),
spans as (
  select r, min(s) as a, max(s) + 50 as b
  from (select r, s, sum(new) over (partition by r order by s) as n
        from (select r, s, case when s <= 50 + lag(s) over (partition by r order by s) then 0 else 1 end as new from again))
  group by r, n),
gaps as (
  select r, a, b, lag(b, 1, 0) over (partition by r order by a) as after from spans),
cut as (
  select r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
    string_agg(substring(h, 2 * after + 1, 2 * (a - after)), '' order by a) as before
  from gaps join texts using (r) group by r)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(before, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from texts left join cut using (r)
"""

ORACLES = {
    "op3_chat": OP3,
    "op4_decontamination": OP4,
    "op10_suffix_dedup": OP10,
    "op11_merkle": OP11,
    "op12_exact_dedup": OP12,
    "op13_hard_negatives": OP13,
}
