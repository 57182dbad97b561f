"""SQL that checks queries of this folder; written apart from the operators.

Near duplicates and repeated passages have one right answer, whatever the method, so brute force in SQL can give it: all pairs that share a
shingle, all windows. The other queries depend on labels, spans or scores of their method, or on a trained model.
"""

# Pairs of texts, counted over every shingle they share, and everything reachable over the links.
_NEAR_DUPLICATES = r"""
with recursive texts as (
  select coalesce(text, '') as text, min(doc_id) as id from documents group by all),
words as (
  select id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from texts),
sets as (
  select id, text, case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as s from words),
shingles as (select id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.id as a, b.id as b from shingles a join shingles b
    on a.shingle = b.shingle and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select id, id as root from sets
  union
  select l.b, r.root from reach r join both_ways l on l.a = r.id),
roots as (select id, min(root) as root from reach group by id)
select d.doc_id, len(s.s)::bigint as n_shingles, case when len(s.s) = 0 then d.doc_id else r.root end as component_id,
  len(s.s) = 0 or d.doc_id = r.root as kept
from documents d join sets s on s.text = coalesce(d.text, '') join roots r on r.id = s.id
"""

# Every window of every text, the smallest document it starts in, and the words that later windows cover.
_REPEATED_PASSAGES = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
places as (select doc_id, ws, unnest(range(len(ws) - 49)) as pos from words where len(ws) >= 50),
windows as (select doc_id, pos, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) as h from places),
owners as (select h, min(doc_id) as owner from windows group by h),
covered as (
  select distinct doc_id, unnest(range(pos, pos + 50)) as pos from windows join owners using (h) where doc_id > owner),
each as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from words),
kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.pos) as kept, count(*) as n
  from each e anti join covered c on c.doc_id = e.doc_id and c.pos = e.pos group by e.doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, (len(w.ws) - coalesce(k.n, 0))::bigint as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

# crc32 of the bytes of texts, by a table of 256 entries; letters above ASCII are two bytes.
_CRC = r"""
crc_steps as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as crc_table),
"""

# Words by pattern, misspellings planted by crc32, near words by joins over patterns with one place left open.
_SPELLING = r"""
with recursive """ + _CRC + r"""
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as run from documents where text is not null),
keyed as (select coalesce(doc_id::varchar, '') || ':' || run as key, run from runs where length(run) >= 7),
keys as (select distinct key, run from keyed),
hashed as (
  select key, run, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda ch:
    case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, (unicode(ch) - 64)::bigint] end)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
  from keys, crc_steps),
written as (
  select k.key, case when h % 31 = 0 then left(h.run, (h % length(h.run))::int) || substring(h.run, (h % length(h.run))::int + 2) else h.run end as word
  from keyed k join hashed h using (key)),
words as (select word, count(*) as n from written where length(word) >= 7 group by word having count(*) >= 2),
places as (select word, n, unnest(range(length(word))) as i from words),
opened as (select word, n, left(word, i::int) || '*' || substring(word, i::int + 2) as open, left(word, i::int) || substring(word, i::int + 2) as shut from places),
pairs as (
  select a.word as a, b.word as b, b.n as n from opened a join opened b on a.open = b.open and a.word <> b.word
  union select o.word, w.word, w.n from opened o join words w on o.shut = w.word
  union select w.word, o.word, o.n from opened o join words w on o.shut = w.word),
best as (
  select a, count(*) as n_near, first(b order by n desc, b) as form, max(n) as form_n from pairs group by a),
forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 10 * w.n then b.form end as form,
    case when b.form_n >= 10 * w.n then b.form_n end as form_n
  from words w left join best b on b.a = w.word),
chain as (
  select word, coalesce(form, word) as root, form is null as done from forms
  union all
  select c.word, coalesce(f.form, f.word), f.form is null from chain c join forms f on f.word = c.root where not c.done)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word and c.done
"""

# The cheapest edits of all rows from the last back, for each of four states with their letters and lines; the least of equal cost first.
_REPAIR = r"""
with recursive """ + _CRC + r"""
keys as (
  select distinct conv_id, turn, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (
  select conv_id, turn, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: unicode(ch)::bigint),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as h
  from keys, crc_steps),
damaged as (
  select c.conv_id, c.turn, case when h = 4 then 'user' else coalesce(role, ' ') end as role,
    case h when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
    unnest(case when h = 3 then [1, 2] else [1] end) as copy
  from conversations c join hashed k on c.conv_id is not distinct from k.conv_id and c.turn is not distinct from k.turn
  where h <> 0),
in_order as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from damaged),
marked as (
  select *, left(role, 1) as initial, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as fault from in_order),
steps as (
  select *, coalesce(fault in ('blank', 'duplicate'), false) as gone, case when fault = 'truncated' then 3 else 0 end as cut,
    role || ':' || text || chr(10) as kept, 'user:' || text || chr(10) as to_user, 'assistant:' || text || chr(10) as to_assistant from marked),
best as (
  select conv_id, max(i) as i, {c: 0, t: '', l: ''} as st, {c: 6, t: 'II', l: 'user:' || chr(10) || 'assistant:' || chr(10)} as sy,
    {c: 3, t: 'I', l: 'assistant:' || chr(10)} as us, {c: 0, t: '', l: ''} as asst from steps group by conv_id
  union all
  select conv_id, i - 1,
    list_min([bst, {c: 3 + bus.c, t: 'I' || bus.t, l: 'user:' || chr(10) || bus.l},
      {c: 6 + bas.c, t: 'II' || bas.t, l: 'user:' || chr(10) || 'assistant:' || chr(10) || bas.l}]),
    list_min([bsy, {c: 3 + bus.c, t: 'I' || bus.t, l: 'user:' || chr(10) || bus.l},
      {c: 6 + bas.c, t: 'II' || bas.t, l: 'user:' || chr(10) || 'assistant:' || chr(10) || bas.l}]),
    list_min([bus, {c: 3 + bas.c, t: 'I' || bas.t, l: 'assistant:' || chr(10) || bas.l}]),
    list_min([bas, {c: 3 + bus.c, t: 'I' || bus.t, l: 'user:' || chr(10) || bus.l}])
  from (
    select b.conv_id, b.i,
      list_min([{c: 4 + st.c, t: 'D' || st.t, l: st.l},
        case when not gone then {c: 3 + cut + us.c, t: 'R' || us.t, l: to_user || us.l} end,
        case when not gone and initial = 's' then {c: cut + sy.c, t: 'K' || sy.t, l: kept || sy.l} end,
        case when not gone and initial = 'u' then {c: cut + us.c, t: 'K' || us.t, l: kept || us.l} end]) as bst,
      list_min([{c: 4 + sy.c, t: 'D' || sy.t, l: sy.l},
        case when not gone then {c: 3 + cut + us.c, t: 'R' || us.t, l: to_user || us.l} end,
        case when not gone and initial = 'u' then {c: cut + us.c, t: 'K' || us.t, l: kept || us.l} end]) as bsy,
      list_min([{c: 4 + us.c, t: 'D' || us.t, l: us.l},
        case when not gone then {c: 3 + cut + asst.c, t: 'R' || asst.t, l: to_assistant || asst.l} end,
        case when not gone and initial = 'a' then {c: cut + asst.c, t: 'K' || asst.t, l: kept || asst.l} end]) as bus,
      list_min([{c: 4 + asst.c, t: 'D' || asst.t, l: asst.l},
        case when not gone then {c: 3 + cut + us.c, t: 'R' || us.t, l: to_user || us.l} end,
        case when not gone and initial = 'u' then {c: cut + us.c, t: 'K' || us.t, l: kept || us.l} end]) as bas
    from best b join steps s on s.conv_id is not distinct from b.conv_id and s.i = b.i)),
solved as (select conv_id, st.c as cost, st.t as audit, st.l as lines from best where i = 0),
neighbours as (
  select conv_id, fault, turn, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair, i from marked),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank,
    count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
    count_if(i > 1 and pair not in ('su', 'ua', 'au')) as illegal from neighbours group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(case when coalesce(lines, '') = '' then '' else left(lines, length(lines) - 1) end) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
  left join solved s on s.conv_id is not distinct from o.conv_id
"""

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": _NEAR_DUPLICATES,
    "op5_substring_dedup": _REPEATED_PASSAGES,
    "op11_conversation_repair": _REPAIR,
    "op12_spelling_variants": _SPELLING,
}
