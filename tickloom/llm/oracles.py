"""SQL twins of this subpackage's queries, where SQL can express them."""

_WS = "[\\x20\\x09-\\x0D]+"

LINE_DEDUP = f"""
with line as (
  select doc_id, i, l, ('0x' || substr(md5(l), 1, 7))::bigint as h, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) as w
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)
), rolled as (
  select *, (h * 31 + coalesce(lead(h) over (partition by doc_id order by i), 0)) % 1000003 as r from line
), cut as (
  select *, w >= 13 or coalesce(lead(w) over o >= 13, true) or coalesce(r < lead(r) over o, false) or coalesce(lag(r) over o >= r, false) as e,
    lag(l) over o as p1, case when lag(w) over o < 13 then lag(l, 2) over o end as p2, lead(l) over o as n1, case when lead(w) over o < 13 then lead(l, 2) over o end as n2 from rolled window o as (partition by doc_id order by i)
), numbered as (
  select *, coalesce(sum(e::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as c from cut
), chunk as (
  select doc_id, c, min(i) as s, list(l order by i) as ls, sum(w) as w, list_filter(list([p1, p2] order by i)[1], lambda q: q is not null) as prev,
    list_filter(list([n1, n2] order by i)[-1], lambda q: q is not null) as next from numbered group by doc_id, c
), ranked as (
  select *, row_number() over (partition by ls order by doc_id, c) as k from chunk where w > 0
), grown as (
  select r.doc_id, r.s - len(list_filter(range(1, least(len(r.prev), len(f.prev)) + 1), lambda q: r.prev[1:q] = f.prev[1:q])) as a,
    r.s + len(r.ls) + len(list_filter(range(1, least(len(r.next), len(f.next)) + 1), lambda q: r.next[1:q] = f.next[1:q])) as z
  from ranked r join ranked f on r.ls = f.ls and f.k = 1 where r.k > 1
), gone as (
  select distinct g.doc_id, i from grown g, lateral (select unnest(range(a, z)) as i) where (select count(*) filter (w > 0) >= 2 or max(w) >= 50 from line l where l.doc_id = g.doc_id and l.i >= a and l.i < z)
), kept as (
  select l.doc_id, string_agg(l.l, chr(10) order by l.i) filter (g.i is null) as t, count(g.i) as n from line l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by 1
)
select d.doc_id, coalesce(n, 0)::bigint as n_removed, length(case when d.text is null then null else coalesce(t, '') end)::bigint as kept_chars,
  md5(case when d.text is null then null else coalesce(t, '') end) as kept_md5
from documents d left join kept k on d.doc_id = k.doc_id
"""

#: The same mix from the definition: seats one by one, blocks and words as rows of their own.
MIXING = """
with recursive doc as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5('mix-7/' || coalesce(doc_id::varchar, 'n' || md5(coalesce(text, '')))) as h,
    coalesce('s' || source, 'n') as sk from documents
), src as (
  select sk, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][(row_number() over (order by sk = 'n', sk) - 1) % 3 + 1] as w from doc group by sk
), fill(step, sk, source_size, w, target, stopped) as (
  select 0, sk, source_size, w, 1.5 * sum(source_size) over () * w / sum(w) over (), false from src
  union all
  select step + 1, sk, source_size, w,
    case when stopped or target >= 2.0 * source_size then 2.0 * source_size
      else (1.5 * sum(source_size) over () - sum(case when stopped or target >= 2.0 * source_size then 2.0 * source_size else 0 end) over ()) * w / sum(case when stopped or target >= 2.0 * source_size then 0 else w end) over () end,
    stopped or target >= 2.0 * source_size
  from fill where step < (select count(*) from src)
), target as (
  select sk, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate, greatest(1, ceil(source_size / 1000000.0))::bigint as shards
  from fill where step = (select count(*) from src)
), dealt as (
  select d.*, t.source_size, t.target, t.rate, ('0x' || substr(h, 1, 12))::bigint % shards as shard from doc d join target t using (sk)
), sh as (
  select sk, shard, sum(size)::bigint as w, ceil(sum(size) / 64.0)::bigint as n, any_value(rate) as rate from dealt group by sk, shard having sum(size) > 0
), votes as (
  select sk, sum(n * rate) as v, sum(2 * n)::bigint as most from sh group by sk
), seat as (
  select sk, v / (2 * k + 1) as q, k from (select sk, v, unnest(range(least(most, ceil(v * 1.05)::bigint + 50))) as k from votes)
), got as (
  select sk, count(*)::bigint as seats from (select sk, row_number() over (order by q desc, k, sk) as r from seat) where r <= (select round(sum(v)) from votes) group by sk
), seat2 as (
  select sk, shard, n * rate / (2 * k + 1) as q, k from (select sk, shard, n, rate, unnest(range(least(2 * n, ceil(n * rate * 1.05)::bigint + 50))) as k from sh)
), quota as (
  select sk, shard, count(*) as quota from (select s.sk, shard, seats, row_number() over (partition by s.sk order by q desc, k, shard) as r from seat2 s join got g on s.sk = g.sk) where r <= seats group by sk, shard
), plan as (
  select s.*, coalesce(quota, 0)::bigint as quota, [2147483647, 2147483629, 2147483587, 2147483579][(('0x' || substr(b, 13, 12))::bigint % 4) + 1] % n as pa, ('0x' || substr(b, 1, 12))::bigint % n as pb
  from (select *, md5('mix-7/' || sk || '/' || shard) as b from sh) s left join quota q on s.sk = q.sk and s.shard = q.shard
), block as (
  select sk, shard, (w * j) // n as a, (w * (j + 1)) // n as z, quota // n + case when (pa * j + pb) % n < quota % n then 1 else 0 end as times
  from (select *, unnest(range(n)) as j from plan)
), line as (
  select *, sum(size) over (partition by sk, shard order by h, doc_id, size rows unbounded preceding)::bigint as z from dealt
), taken as (
  select l.doc_id, l.sk, sum((least(l.z, b.z) - greatest(l.z - l.size, b.a)) * times)::bigint as taken
  from line l join block b on l.sk = b.sk and l.shard = b.shard and b.a < l.z and b.z > l.z - l.size group by l.doc_id, l.sk
)
select d.doc_id, d.size, d.source_size, d.target::double as target, coalesce(taken, 0)::bigint as taken from dealt d left join taken t on d.doc_id = t.doc_id and d.sk = t.sk
"""



def _licenses() -> str:
    """Windows and containment by definition, over all shingles of all texts: no prefilter, no bands."""
    from tickloom.llm.license_scan import SHINGLE, TEMPLATES, class_of, shingles_of

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, len(sh), class_of(len(sh)), len(sh[0].split()), x) for k, t in TEMPLATES.items() if (sh := shingles_of(t)) for x in sh]
    values = ", ".join(f"({quote(k)}, {n}, {c}, {size}, {quote(x)})" for k, n, c, size, x in rows)
    return f"""
with tpl(license, n, class, size, shingle) as (values {values}), doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents
), sh as (
  select r, i, {SHINGLE} as size, array_to_string(w[i + 1:i + {SHINGLE}], ' ') as shingle from (select r, w, unnest(range(len(w) - {SHINGLE} + 1)) as i from doc)
), hit as (
  select distinct r, license, n, shingle, unnest(range(greatest(0, ceil((i - 2 * class + 1) / (class / 2.0))::bigint), i // (class // 2) + 1)) as win from sh join tpl using (size, shingle)
), held as (
  select distinct r, license from (select r, license, win from hit group by r, license, win, n having count(*) >= 0.8 * n)
)
select doc_id, count(license)::bigint as n_licenses, coalesce(string_agg(license, ',' order by license), '') as licenses from doc left join held using (r) group by r, doc_id
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)), lambda c, b: {bits}), 4294967295::bigint)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Trees level by level, each leaf's steps as rows, folded one by one. Only A-Z change when a text is tampered with.
MERKLE = f"""
with recursive doc as (
  select row_number() over () as r, doc_id, coalesce('s' || lang, 'n') as g, {_leaf('text')} as h,
    case when {crc32('doc_id::varchar')} % 3 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as claim from documents
), pos as (
  select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i from doc
), lv(g, k, i, h) as (
  select g, 0, i, h from pos
  union all
  select g, k + 1, i // 8, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by g) as c from lv) where c > 1 group by g, k, i // 8
), sub as (
  select g, k as height, h as subroot, row_number() over (order by g) - 1 as i from (select *, count(*) over (partition by g, k) as c from lv) where c = 1
), top(k, i, h) as (
  select 0, i, subroot from sub
  union all
  select k + 1, i // 8, sha256(string_agg(h, '' order by i)) from (select *, count(*) over () as c from top) where c > 1 group by k, i // 8
), near as (
  select g, k, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as z
  from (select g, k, i, h, count(*) over (partition by g, k) as c from lv union all select '', k, i, h, count(*) over (partition by k) from top) where c > 1 window w as (partition by g, k, i // 8 order by i)
), fold(r, g, i, j, height, k, node, seen) as (
  select r, pos.g, pos.i, sub.i, height, 0, coalesce(claim, h), '' from pos join sub using (g)
  union all
  select r, f.g, f.i, j, height, f.k + 1, sha256(a || node || z), seen || a || z from fold f join near n
    on (f.k < height and n.g = f.g and n.k = f.k and n.i = f.i >> (3 * f.k)) or (f.k >= height and n.g = '' and n.k = f.k - height and n.i = j >> (3 * (f.k - height)))
), done as (
  select r, node, sha256(seen) as proof from fold qualify row_number() over (partition by r order by k desc) = 1
)
select doc_id, h as leaf, subroot, (select h from top order by k desc limit 1) as root, proof as proof_sha256, node as folded_root, node = (select h from top order by k desc limit 1) as verified
from pos join sub using (g) join done using (r)
"""

#: Costs to go turn by turn from the last, then edits letter by letter; states 0 nothing yet, 1 after s, 2 after u, 3 after a.
CONVERSATION = f"""
with recursive raw as (
  select conv_id, coalesce('s' || conv_id, 'n') as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as n from conversations
), hurt as (
  select c, turn, case when n = 4 then 'user' else role end as role, case n when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case n when 0 then 0 when 3 then 2 else 1 end)) from raw)
), t as (
  select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) - 1 as i, count(*) over (partition by c) as m, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said from hurt
), f as (
  select *, said = '' as blank, said <> '' and row_number() over (partition by c, role, text order by i) > 1 as dup, left(role, 1) as x, lag(left(role, 1)) over (partition by c order by i) as p from t
), turns as (
  select *, not blank and not dup and right(said, 1) not in ('.', '!', '?') as cut, blank or dup as must from f
), stat as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated,
    count(*) filter (i > 0 and p || x not in ('su', 'ua', 'au')) as illegal from turns group by c
), back(c, i, v0, v1, v2, v3) as (
  select distinct c, m, 0, 4, 2, 0 from turns
  union all
  select c, i, least(w0, 2 + w2, 4 + w3), least(w1, 2 + w2, 4 + w3), least(w2, 2 + w3), least(w3, 2 + w2) from (
    select b.c, t.i,
      least(v0 + 3, case when not must and x = 's' then cut::int + v1 else 1e9::bigint end, case when not must then cut::int + v2 + if(x = 'u', 0, 2) else 1e9::bigint end) as w0,
      least(v1 + 3, case when not must then cut::int + v2 + if(x = 'u', 0, 2) else 1e9::bigint end) as w1,
      least(v2 + 3, case when not must then cut::int + v3 + if(x = 'a', 0, 2) else 1e9::bigint end) as w2,
      least(v3 + 3, case when not must then cut::int + v2 + if(x = 'u', 0, 2) else 1e9::bigint end) as w3
    from back b join turns t on t.c = b.c and t.i = b.i - 1)
), cost as (
  select b.c, b.i, [v0, v1, v2, v3] as v from back b
), walk(c, i, g, k, audit, lines) as (
  select c, 0, 0, 0, '', []::varchar[] from cost where i = 0
  union all
  select c, case when e = 'I' then i else i + 1 end, case e when 'D' then g when 'K' then if(x = 's', 1, if(x = 'u', 2, 3)) else if(g = 2, 3, 2) end, k + 1, audit || e,
    case e when 'D' then lines when 'K' then list_append(lines, role || ':' || text) when 'R' then list_append(lines, if(g = 2, 'assistant:', 'user:') || text) else list_append(lines, if(g = 2, 'assistant:', 'user:')) end
  from (
    select w.*, x, role, text, case when t.i is not null and h.v[g + 1] = 3 + a.v[g + 1] then 'D' when h.v[g + 1] = 2 + h.v[if(g = 2, 3, 2) + 1] then 'I'
      when not must and ((x = 's' and g = 0 and h.v[1] = cut::int + a.v[2]) or (x = 'u' and g <> 2 and h.v[g + 1] = cut::int + a.v[3]) or (x = 'a' and g = 2 and h.v[3] = cut::int + a.v[4])) then 'K' when t.i is not null then 'R' end as e
    from walk w join cost h on h.c = w.c and h.i = w.i left join turns t on t.c = w.c and t.i = w.i left join cost a on a.c = w.c and a.i = w.i + 1
  ) where e is not null
), done as (
  select c, audit, sha256(array_to_string(lines, chr(10))) as sha from walk qualify row_number() over (partition by c order by k desc) = 1
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(v[1], 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id, c from raw) left join stat using (c) left join (select c, v from cost where i = 0) using (c) left join done using (c)
"""

SQL: dict[str, str] = {"op11_conversation_repair": CONVERSATION, "op13_merkle": MERKLE, "op9_license_scan": _licenses(), "op2_line_dedup": LINE_DEDUP, "op5_mixing": MIXING}
