"""The same queries in ANSI SQL, written from the definitions."""

from __future__ import annotations

T = """t as (select 'U' || (user_id % 8) as instrument, event_id, ts as event_time, value::decimal(18,8) as price, json_extract_string(props, '$.k')::decimal(18,8) as size,
  case when event_type in ('purchase', 'signup') then 'BUY' when event_type in ('view', 'error') then 'SELL' else 'UNKNOWN' end as side, (user_id % 3)::int as part from events)"""
B = """lv as (select l_orderkey as k, floor(l_extendedprice / l_quantity)::decimal(18,8) as p, l_quantity::decimal(18,8) as q, l_returnflag = 'A' as bid from lineitem where l_quantity > 0),
b as (select 'C' || (o_custkey % 4) as instrument, o_orderkey as event_id, o_orderdate as event_time,
  coalesce(list({'p': p, 'q': q} order by p desc, q) filter (bid), []) as bids, coalesce(list({'p': p, 'q': q} order by p, q) filter (not bid), []) as asks
  from lv join orders on k = o_orderkey group by all),
last as (select * from (select *, time_bucket(interval '1 day', event_time) as window_start, row_number() over (partition by instrument, time_bucket(interval '1 day', event_time) order by event_time desc, event_id desc) as rn from b) where rn = 1)"""
OBI = """select instrument, window_start, window_start + interval '1 day' as window_end, bv::double as bid_volume, av::double as ask_volume, event_id,
  case when bv + av = 0 then 0 else round((bv - av)::double / (bv + av)::double, 8) end as obi, greatest(least(5, len(bids)), least(5, len(asks)))::int as levels
  from (select *, coalesce(list_sum(list_transform(bids[1:5], lambda x: x.q)), 0)::decimal(28,8) as bv, coalesce(list_sum(list_transform(asks[1:5], lambda x: x.q)), 0)::decimal(28,8) as av from last)"""
MICRO = """select instrument, window_start, window_start + interval '1 day' as window_end, bp::double as best_bid, ap::double as best_ask, bq::double as bid_volume, aq::double as ask_volume, event_id,
  case when bq + aq = 0 then round((bp + ap)::double / 2, 8) else round((bp::decimal(38,8) * aq + ap::decimal(38,8) * bq)::double / (bq + aq)::double, 8) end as micro_price
  from (select *, bids[1].p as bp, bids[1].q as bq, asks[1].p as ap, asks[1].q as aq from last where len(bids) > 0 and len(asks) > 0)"""


def vwap(size: str, where: str = "true", source: str = "t") -> str:
    return f"""select instrument, w as window_start, w + interval '{size}' as window_end, trade_count, v::double as sum_size, round(pv::double, 8) as sum_price_times_size,
  case when v = 0 then round(p::double / trade_count, 8) else round(pv::double / v::double, 8) end as vwap
  from (select instrument, time_bucket(interval '{size}', event_time) as w, count(*) as trade_count, sum(price) as p, sum(size) as v, sum(price::decimal(38,8) * size) as pv from {source} where {where} group by all)"""


def vpin(size: str, source: str = "t") -> str:
    return f"""select instrument, w as window_start, w + interval '{size}' as window_end, round(trail::double / (5 * 500), 8) as vpin, m as buckets_closed, unknown_volume, trade_count from (
  select g.*, (select sum(imb) from imb i where i.instrument = g.instrument and i.k >= g.m - 5 and i.k < g.m) as trail from (
    select instrument, time_bucket(interval '{size}', event_time) as w, (max(hi)::bigint // 500) as m, sum(case when side = 'UNKNOWN' then size else 0 end)::double as unknown_volume, count(*) as trade_count from run group by all) g where m >= 5)"""


def run(source: str = "t") -> str:
    return f"""run as (select *, sum(size) over (partition by instrument order by event_time, event_id) as hi from {source}),
part as (select *, unnest(range((hi - size)::bigint // 500, (hi::bigint - 1) // 500 + 1)) as k from run where size > 0),
imb as (select instrument, k, abs(sum((least(hi, (k + 1) * 500) - greatest(hi - size, k * 500)) * case side when 'BUY' then 1 when 'SELL' then -1 else 0 end)) as imb from part group by all)"""


CHECKED = f"""{T}, c as (select event_id, instrument, case when event_id % 7 = 0 then -price else price end as price, size, event_time, case when event_id % 11 = 0 then '' else 'feed' end as source,
  case when event_id % 13 = 0 then event_time - interval 31 second else event_time end as ingest_time from t),
r as (select *, concat_ws('; ', case when source = '' then 'source is required' end, case when event_time < timestamp '2020-01-01' then 'event_time is before 2020-01-01' end,
  case when event_time > timestamp '2024-01-20' + interval 5 minute then 'event_time is in the future' end, case when event_time > ingest_time + interval 30 second then 'event_time is ahead of ingest_time' end,
  case when price <= 0 then 'price must be positive' end, case when size < 0 then 'size must not be negative' end) as reasons from c)"""
ARRIVED = f"""{T}, a as (select *, (epoch_us(event_time) // 1000000 + (event_id * 37 % 121) * 60) * 1000000 + event_id % 1000000 as seq, time_bucket(interval '1 hour', event_time) as window_start from t),
m as (select *, least({', '.join(f'max(case when part = {p} then event_time end) over (partition by instrument order by seq)' for p in range(3))}) as watermark from a),
l as (select *, coalesce(window_start + interval 1 hour <= watermark, false) as late from m)"""
SIGNAL = f"""{T}, s as (select instrument, event_id, event_time, case when event_id % 3 = 0 then price end as price, case when event_id % 3 = 1 then size end as sig from t),
p as (select *, last_value(price ignore nulls) over (partition by instrument order by event_time, event_id rows unbounded preceding) as last_p from s),
f as (select p.instrument, p.event_id, p.event_time, p.sig::double as signal, p.last_p::double as entry, x.last_p::double as exit, x.event_time as exit_time from p
  join p x on x.instrument = p.instrument and x.event_id = (select y.event_id from p y where y.instrument = p.instrument and y.event_time >= p.event_time + interval 1 hour order by y.event_time, y.event_id limit 1)
  where p.sig is not null and p.last_p is not null)"""
RET = "(exit - entry) / nullif(entry, 0)"
#: Each order's deltas replayed one by one.
DELTA = """d as (select 'U' || (event_id // 5 % 8) as instrument, (event_id // 5)::varchar as order_id, case when event_id // 5 % 2 = 0 then 'BUY' else 'SELL' end as side, round(value, 0) as price, json_extract_string(props, '$.k')::double as quantity,
  case event_type when 'error' then 'DELETE' when 'view' then 'MODIFY' else 'ADD' end as action, event_id as seq from events),
n as (select *, row_number() over (partition by instrument, order_id order by seq) as k from d),
st as (select instrument, order_id, 0::bigint as k, false as live, '' as side, 0::double as price, 0::double as quantity from d group by all
  union all select n.instrument, n.order_id, n.k, case action when 'ADD' then true when 'DELETE' then false else live end, case when action = 'ADD' and not live then n.side else st.side end,
  case when action = 'ADD' and not live then n.price else st.price end, case when (action = 'ADD' and not live) or (action = 'MODIFY' and live) then n.quantity else st.quantity end
  from st join n on n.instrument = st.instrument and n.order_id = st.order_id and n.k = st.k + 1),
o as (select * from st qualify row_number() over (partition by instrument, order_id order by k desc) = 1),
lv as (select instrument, side, price, sum(quantity) as quantity, count(*) as orders from o where live group by all)"""
RAW = """raw as (select (user_id % 3)::int as partition, event_id as "offset", epoch_us(ts) // 1000 as timestamp, case when event_id % 7 = 0 then 'null' else '"' || user_id || '"' end as key, ts, event_id % 10 as kind, event_type, user_id,
  case event_id % 10 when 3 then '{"source":"old","source":"' when 4 then chr(9) || '  {"source":"' else '{"source":"' end || event_type || '","instrument":{"symbol":' || case event_id % 10 when 6 then '7' else '"U' || (user_id % 8) || '"' end || '},"price":1.500}'
  || case event_id % 10 when 5 then ' x' when 7 then '  ' else '' end as value from events),
rl as (select *, case when kind = 0 then '_unknown' when kind in (1, 2, 5) then '_unparsed' else event_type end as source, case when kind in (0, 6) then '_unknown' when kind in (1, 2, 5) then '_unparsed' else 'U' || (user_id % 8) end as instrument,
  '{"topic":"events.trade","partition":' || partition || ',"offset":' || "offset" || ',"timestamp":' || timestamp || ',"key":' || key ||
  case kind when 0 then ',"value":null}' when 1 then ',"valueBase64":"bm90IGpzb24="}' when 2 then ',"valueBase64":"e/99"}' when 5 then ',"valueBase64":"' || to_base64(encode(value)) || '"}' else ',"value":' || value || '}' end as line from raw)"""


def pairs() -> str:
    def side(name: str, where: str) -> str:
        return f"""{name}t as (select * from t where {where}), {run(f'{name}t').replace('run as', f'{name}run as').replace('from run ', f'from {name}run ').replace('part as', f'{name}part as').replace('from part ', f'from {name}part ').replace('imb as (', f'{name}imb as (')},
{name} as (select instrument, 'vwap.1m' as feature_name, window_start, window_end, vwap as value, trade_count as n from ({vwap('1 hour', source=f'{name}t')})
  union all select instrument, 'vpin', window_start, window_end, vpin, trade_count from ({vpin('1 hour').replace('from imb i', f'from {name}imb i').replace('from run ', f'from {name}run ')}))"""

    return f"""with {T}, {side('l', 'true')}, {side('r', "event_id % 50 <> 7 and event_time >= '2024-01-01' and event_time < '2024-01-20'")},
j as (select coalesce(l.feature_name, r.feature_name) as feature_name, l.feature_name is not null as hl, r.feature_name is not null as hr, coalesce(l.value <> r.value, false) as vd, coalesce(l.n <> r.n, false) as nd
  from l full join r on l.instrument = r.instrument and l.feature_name = r.feature_name and l.window_start = r.window_start)
select feature_name, count(*) as pairs, sum(vd::int)::bigint as value_differs, 0::bigint as window_end_differs, sum(nd::int)::bigint as input_count_differs, sum((hl and not hr)::int)::bigint as live_only,
  sum((hr and not hl)::int)::bigint as replay_only, sum((vd or nd or not hl or not hr)::int)::bigint as diverges from j group by 1"""


def agg(expr: str, window: str = "time_bucket(interval '1 day', event_time)", size: str = "1 day", source: str = "t") -> str:
    return f"with {T} select instrument, {window} as window_start, {window} + interval '{size}' as window_end, ({expr})::double as value from {source} group by all"


ACCEPTED = f"""with {ARRIVED}, f as (select instrument, arg_max(watermark, seq) as w from m group by 1), acc as (select l.* from l join f using (instrument) where not late and window_start + interval 1 hour <= w), {run('acc')}
select instrument, 'vwap.1m' as feature_name, window_start, vwap as value, trade_count as input_count from ({vwap('1 hour', source='acc')}) union all select instrument, 'vpin', window_start, vpin, trade_count from ({vpin('1 hour')})"""


#: Books replayed arrival by arrival, what waits as a sorted list.
SYNC = """with recursive d as (select 'S' || (event_id % 6) as instrument, event_id // 6 as seq, event_id as id from events where event_id % 6 <> 2 or event_id // 6 <> 20),
a as (select instrument, seq, case when instrument in ('S3', 'S4') and seq = 30 then id + 10::bigint ** 15 else (id + id * 7919 % 60) * 1000000 + id % 1000000 end::bigint as arrival from d),
b as (select * from a union all select instrument, seq, arrival + 200000000 from a where instrument = 'S5'),
half as (select max(seq) // 2 as seq from b where instrument = 'S4'),
m as (select instrument, arrival, 1 as kind, seq from b union all select distinct instrument, 0, 0, 9 from b where instrument <> 'S0'
  union all select instrument, max(arrival), 0, seq from b where instrument = 'S4' and seq = (select seq from half) and seq <> 30 group by all),
n as (select *, row_number() over (partition by instrument order by arrival, kind, seq) as k from m),
st as (select distinct instrument, 0::bigint as k, 'AWAITING_SNAPSHOT' as state, 0::bigint as expected, []::bigint[] as w, 0::bigint as applied from m
  union all select instrument, k, case when kind = 0 then 'SYNCHRONIZED' when state <> 'AWAITING_SNAPSHOT' and len(nw) > 40 and seq > expected then 'DESYNCED' else state end,
    case when kind = 0 then seq + 1 when state <> 'AWAITING_SNAPSHOT' and seq = expected then seq + 1 + run else expected end,
    case when kind = 0 then [] when state = 'AWAITING_SNAPSHOT' then w when seq = expected then w[run + 1:] else nw end,
    applied + case when kind = 1 and state <> 'AWAITING_SNAPSHOT' and seq = expected then 1 + run else 0 end
  from (select st.instrument, n.k, state, expected, w, applied, kind, seq, case when seq > expected and not list_contains(w, seq) then list_sort(list_append(w, seq)) else w end as nw,
      len(list_filter(w, lambda x, i: x = seq + i)) as run from st join n on n.instrument = st.instrument and n.k = st.k + 1))
select instrument, state, len(w) as waiting, applied, case when state <> 'AWAITING_SNAPSHOT' then expected - 1 end as last_seq from st qualify row_number() over (partition by instrument order by k desc) = 1"""


FEATURES_LONG = f"""{T}, {run()}, {B}, f as (select instrument, 'vwap.1m' as feature_name, window_start, window_end, vwap as value, trade_count as input_count from ({vwap('1 day')}) union all select instrument, 'vpin', window_start, window_end, vpin, trade_count from ({vpin('1 day')})
  union all select instrument, 'obi', window_start, window_end, obi, 1 from ({OBI}) union all select instrument, 'micro_price', window_start, window_end, micro_price, 1 from ({MICRO}))"""
JOBS = (("2024-01-05", "2024-01-06"), ("2024-01-08", "2024-01-08 20:00:00"))
FORWARD = f"with {SIGNAL} select instrument, event_id, signal, entry, exit, exit_time, round({RET}, 9) as forward_return from f"
FORWARD_IC = f"with {SIGNAL}, v as (select instrument, signal, {RET} as ret from f) select instrument, case when count(*) >= 2 and var_pop(signal) > 0 and var_pop(ret) > 0 then round(corr(signal, ret), 7) end as ic, count(*) as n from v where ret is not null group by 1"


SQL: dict[str, str] = {
    "vwap_1m": f"with {T} {vwap('1 minute')}",
    "vwap_1h": f"with {T} {vwap('1 hour')}",
    "vwap_1d": f"with {T} {vwap('1 day')}",
    "vwap_zero_size": f"with {T} {vwap('1 day', 'size = 0')}",
    "obi_daily": f"with {B} {OBI}",
    "micro_price_daily": f"with {B} {MICRO}",
    "vpin": f"with {T}, {run()} {vpin('1 day')}",
    "candles": f"with {T} select instrument, time_bucket(interval '1 hour', event_time) as window_start, time_bucket(interval '1 hour', event_time) + interval '1 hour' as window_end, arg_min(price, (event_time, event_id))::double as open, max(price)::double as high, min(price)::double as low, arg_max(price, (event_time, event_id))::double as close, sum(size)::double as volume, count(*) as trade_count from t group by all",
    "agg_count": agg("count(price)"),
    "agg_sum": agg("sum(price)"),
    "agg_avg": agg("avg(price::double)"),
    "agg_min": agg("min(price)"),
    "agg_max": agg("max(price)"),
    "agg_first": agg("arg_min(price, (event_time, event_id))"),
    "agg_last": agg("arg_max(price, (event_time, event_id))"),
    "agg_stddev": agg("stddev_samp(price::double)"),
    "agg_sliding": f"with {T}, x as (select *, unnest([0, 1]) as i from t) select instrument, w - interval '1 day' * i as window_start, w - interval '1 day' * i + interval '2 days' as window_end, max(price)::double as value from (select *, time_bucket(interval '1 day', event_time) as w from x) group by all",
    "session_windows": f"with {T}, g as (select *, case when event_time >= lag(event_time) over (partition by instrument order by event_time) + interval 20 minute then 1 else 0 end as new from t), n as (select *, sum(new) over (partition by instrument order by event_time, event_id rows unbounded preceding) as k from g) select instrument, min(event_time) as window_start, max(event_time) + interval 20 minute as window_end, count(*) as trade_count from n group by instrument, k",
    "validate_counts": f"with {CHECKED} select reasons, count(*) as n from r group by 1",
    "ingest_answers": f"with {CHECKED} select event_id, case when reasons = '' then 201 else 400 end as status, reasons as message from r",
    "uuid7_time": "select event_id, epoch_us(ts) // 1000 as millis from events",
    "published_topics": f"with {T} select 'features.vwap.1m.v1' as topic, instrument, count(distinct event_time::date) as n, count(*) as inputs from t group by all",
    "dead_letter": f"with {CHECKED} select event_id, reasons as reason, source, timestamp '2024-01-20' as rejected_at from r where reasons <> ''",
    "valid_trades": f"with {CHECKED} select event_id, instrument, price::double as price from r where reasons = ''",
    "fenced": f"with {T} select event_id, time_bucket(interval '1 hour', event_time) as window_start, time_bucket(interval '1 hour', event_time) + interval '1 hour' as window_end from t where instrument = 'U3'",
    "late_split": f"with {ARRIVED} select event_id, instrument, window_start, watermark, late from l",
    "closed_windows": f"with {ARRIVED}, f as (select instrument, arg_max(watermark, seq) as w from m group by 1) select l.instrument, window_start, count(*) as n from l join f using (instrument) where not late and window_start + interval 1 hour <= w group by all",
    "asof_price": f"with {SIGNAL} select event_id, last_p::double as asof_price from p",
    "forward_return": FORWARD,
    "signal_stream": FORWARD,
    "forward_return_ic": FORWARD_IC,
    "signal_stream_ic": FORWARD_IC,
    "live_replay_diff": pairs(),
    "replay_range": f"with {T} select instrument, window_start, vwap, trade_count from ({vwap('1 hour', "event_time >= '2024-01-05' and event_time < '2024-01-06'")})",
    "replay_callback_range": f"with {T} select instrument, count(*) as n, min(event_time) as first_time, max(event_time) as last_time from t where event_time between '2024-01-05' and '2024-01-06' group by 1",
    "l3_levels": f"with recursive {DELTA} select * from lv",
    "l3_bbo": f"with recursive {DELTA} select instrument, max(price) filter (side = 'BUY') as best_bid, min(price) filter (side = 'SELL') as best_ask from lv group by 1",
    "sequence_gaps": "select 'all' as venue, seq, missing from (select event_id as seq, event_id - lag(event_id) over (order by event_id) - 1 as missing from events where event_id % 97 not in (5, 6)) where missing > 0",
    "l3_contiguous": "select 0 as venue, count(*) as applied, max(event_id) as last_seq from events where event_id > 100 and event_id < (select max(event_id) - 3 from events)",
    "feature_range_query": f"with {T} select window_start, window_end, vwap as value, trade_count as input_count from ({vwap('1 hour', "instrument = 'U3'")}) where window_start >= '2024-01-02' and window_end <= '2024-01-10' order by 1 limit 50",
    "latest_snapshot": f"with {B} select instrument, event_id, event_time, len(bids)::int as n_bids, len(asks)::int as n_asks from (select *, row_number() over (partition by instrument order by event_time desc, event_id desc) as r from b) where r = 1",
    "raw_dedup": "select 'events.trade' as topic, (user_id % 3)::int as partition, count(*) as n, max(event_id) as last_offset, count(*) filter (event_id % 7 <> 0) as keys, count(*) filter (event_id % 10 in (1, 2, 5)) as not_json from events group by all",
    "raw_groups": f"""with {RAW}, g as (select 'events.trade' as topic, partition, source, instrument, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, min("offset") as first_offset, max("offset") as last_offset, count(*) as records, sum((source = '_unparsed')::int)::bigint as unparsed from rl group by all)
  select *, printf('events.trade/%s/%s/%d/%02d/%02d/%02d/p%d-%020d-%020d.jsonl.gz', source, instrument, year, month, day, hour, partition, first_offset, last_offset) as object_key from g""",
    "raw_encoding": f"""with {RAW} select "offset", line, source, instrument from rl""",
    "feature_catalog": f"with {FEATURES_LONG} select name, version, aggregation, window_duration, coalesce(count(instrument), 0) as n, count(distinct instrument) as instruments from (values ('micro_price', 'v1', 'MICRO_PRICE', '1 minute'), ('obi', 'v1', 'OBI', '1 minute'), ('vpin', 'v1', 'VPIN', '1 minute'), ('vwap.1m', 'v1', 'VWAP', '1 minute')) c(name, version, aggregation, window_duration) left join f on f.feature_name = c.name group by all",
    "known_instruments": f"with {T} select instrument, count(*) as n, instrument in (select 'U' || n_nationkey from nation where n_nationkey in (1, 3, 5)) as known from t group by 1",
    "sequence_numbers": "select event_id as arrival, 'BTC-USDT' as instrument, row_number() over (order by event_id) as sequence_number, case when event_id % 9 = 0 or event_id % 2 = 0 then 'SELL' else 'BUY' end as side, case when event_id % 9 = 0 then timestamp '1970-01-01' else date_trunc('milliseconds', ts) end as event_time, case when event_id % 9 = 0 then 'symbol does not match stream' else '' end as reason from events",
    "feature_topics": f"with {FEATURES_LONG} select feature_name as name, 'features.' || feature_name || '.v1' as topic, 'features_' || replace(replace(feature_name, '.', '_'), '-', '_') as table_name, count(*) as n from f group by all",
    "feature_tables": f"with {FEATURES_LONG} select feature_name, null::timestamp as window_start, null::double as value, count(*) as n from f where feature_name <> 'micro_price' group by all union all select 'series', window_start, value, input_count from f where feature_name = 'vwap.1m' and instrument = 'U3' and window_start >= '2024-01-02' and window_end <= '2024-01-10'",
    "features_long": f"with {FEATURES_LONG} select instrument, feature_name, window_start, value, input_count from f",
    "sql_passthrough": "select event_type, count(*) as n, max(ts) as last_time from events group by 1",
    "vwap_large": f"with {T}, big as (select * replace (size + 9000000000 as size) from t) select instrument, time_bucket(interval '1 day', event_time) as window_start, round(sum(price::decimal(38,8) * size::decimal(18,8))::double / sum(size)::double, 4) as vwap, sum(size)::double as sum_size, count(*) as trade_count from big group by all",
    "vpin_large": f"""with {T}, big as (select * replace ((size + 9000000000)::decimal(18,8) as size) from t), run as (select *, sum(size) over (partition by instrument order by event_time, event_id) as hi from big),
win as (select instrument, time_bucket(interval '1 day', event_time) as window_start, floor(max(hi))::bigint as m, count(*) as trade_count from run group by all),
k as (select *, unnest(range(m - 5, m)) as k from win),
net as (select k.instrument, window_start, m, trade_count, k, abs(sum((least(hi, (k + 1)::decimal(38,8)) - greatest(hi - size, k::decimal(38,8))) * case side when 'BUY' then 1 when 'SELL' then -1 else 0 end)) as imb
  from k join run on run.instrument = k.instrument and hi > k and hi - size < k + 1 group by all)
select instrument, window_start, round(sum(imb)::double / 5, 8) as vpin, m as buckets_closed, trade_count from net group by all""",
    "feature_values": f"with {T} select instrument, window_start, sum_price_times_size, sum_size, trade_count::double as trade_count from ({vwap('1 day')})",
    "accepted_features": ACCEPTED,
    "exact_stream": ACCEPTED,
    "live_features": ACCEPTED,
    "decoded_events": "select 'good' as what, count(*) filter (event_id % 6 not in (0, 1)) as n, count(*) filter (event_id % 6 > 2) as with_id from events union all select 'bad', count(*) filter (event_id % 6 in (0, 1)), 0 from events",
    "archived_tail": f"with {T} select instrument, window_start, vwap as value, trade_count as input_count from ({vwap('1 day')})",
    "fanned_out": f"with {T}, {run()}, a as (select trade_count as n from ({vwap('1 day')})), p as (select trade_count as n from ({vpin('1 day')})) select 'vwap.1m' as client, count(*) as n, sum(n)::bigint as inputs from a union all select 'all', count(*), sum(n)::bigint from (select * from a union all select * from p) union all select 'refused vpin: gone', 0, 0",
    "replay_jobs": "with " + T + ", " + ", ".join(f"t{k} as (select * from t where event_time >= '{a}' and event_time < '{b}'), " + run(f"t{k}").replace("run as", f"run{k} as").replace("from run ", f"from run{k} ").replace("part as", f"part{k} as").replace("from part ", f"from part{k} ").replace("imb as (", f"imb{k} as (") for k, (a, b) in enumerate(JOBS))
    + " " + " union all ".join(f"select {k} as job, 'COMPLETED' as status, 'vwap.1m' as feature_name, count(*) as n, sum(trade_count)::bigint as inputs from ({vwap('1 hour', source=f't{k}')}) having count(*) > 0 union all select {k}, 'COMPLETED', 'vpin', count(*), sum(trade_count)::bigint from ({vpin('1 hour').replace('from imb i', f'from imb{k} i').replace('from run ', f'from run{k} ')}) having count(*) > 0" for k in range(2)) + " union all select 2, 'start is after end', null, 0, 0",
    "engine_state": f"with {ARRIVED}, f as (select instrument, arg_max(watermark, seq) as w, count(distinct part) as parts from m group by 1) select l.instrument, window_start, count(*) as n, sum(size)::double as volume from l join f using (instrument) where not late and (parts < 3 or window_start + interval 1 hour > w) group by all",
    "revised_vwap": f"with {ARRIVED}, f as (select instrument, arg_max(watermark, seq) as w from m group by 1), o as (select l.* from l join f using (instrument) where window_start + interval 1 hour <= w), n as (select instrument, window_start, count(*) filter (late) as revision from o group by all) select instrument, window_start, window_end, vwap as value, trade_count as input_count, revision from ({vwap('1 hour', source='o')}) join n using (instrument, window_start)",
    "stream_counters": f"with {ARRIVED}, e as ({ACCEPTED}) select count(*) as received, count(*) filter (late) as late, count(*) filter (not late) as accepted, (select count(*) from e) as emitted from l",
    "delivered_stream": f"with {CHECKED}, x as (select case when event_id % 17 = 0 or event_id % 19 = 0 then 'not decodable' else reasons end as reason from r) select case when reason = '' then 'events.trade' else 'events.deadletter' end as topic, reason, count(*) as n from x group by all",
    "recorded_stream": "select 'events.trade' as topic, (user_id % 3)::int as partition, count(*) as n, max(event_id) as last_offset, count(*) filter (event_id % 7 <> 0) as keys, count(*) filter (event_id % 10 not in (0, 1, 2, 5)) as objects from events group by all",
    "late_stream": f"with {ARRIVED} select instrument, window_start, event_id, event_time from l where late",
    "operational_counts": f"with {ARRIVED} select instrument, count(*) as received, count(*) filter (not late) as accepted, count(*) filter (late) as late, count(distinct case when not late then window_start end) as windows, coalesce(sum(size) filter (not late and side = 'UNKNOWN'), 0)::double as unknown_volume from l group by 1",
    "published_events": f"with {CHECKED} select case when reasons = '' then 'events.trade' else 'events.deadletter' end as topic, count(*) as n from r group by 1",
    "feature_files": f"with {T} select window_start, window_end, vwap as value, trade_count as input_count from ({vwap('1 day', "instrument = 'U3'")}) where window_start >= '2024-01-02' and window_end <= '2024-01-10'",
    "rule_counts": f"""with {B}, e as (select *, json_extract_string(props, '$.k')::double as k, case when ts > timestamp '2024-01-20' + interval 5 minute then 'event_time is in the future' end as f from events)
  select 'candle' as kind, concat_ws('; ', f, case when value < k then 'high is below low' end, case when event_id % 3 < 2 then 'window is empty' end, case when k < 50 then 'volume must not be negative' end) as reasons, count(*) as n from e group by all
  union all select 'book', concat_ws('; ', case when event_time < timestamp '2020-01-01' then 'event_time is before 2020-01-01' end, case when len(bids) < 1 then 'bids are empty' end, case when len(asks) < 1 then 'asks are empty' end, case when len(bids) < 1 then 'depth must be positive' end), count(*) from b group by all
  union all select 'delta', concat_ws('; ', f, case when event_id % 10 = 0 then 'order_id is required' end, case when event_type <> 'error' and value <= 100 then 'price must be positive' end, case when k < 50 then 'quantity must not be negative' end), count(*) from e group by all""",
    "book_messages": f"with {T} select event_id as arrival, 'ETH-USD' as instrument, 'book' as kind, row_number() over (order by event_id) as sequence_number, (size > 0)::int as n_bids, 1::int as n_asks, case when size > 0 then price::double end as bid, 2.5::double as ask, 1::int as depth, event_time from t",
    "listed_messages": f"with {T} select event_id as arrival, i::int as item, case i when 0 then 'BTC-USDT' else 'BTC-USDT-SWAP' end as instrument, row_number() over (partition by i order by event_id) as sequence_number, case i when 0 then 'SELL' else 'BUY' end as side, case i when 0 then price::double else 5 end as price, case i when 0 then size::double else 2 end as size, case i when 0 then timestamp '2025-05-11 21:46:40' else timestamp '1970-01-01 00:00:00.001' end as event_time, case i when 0 then event_id::varchar else '1' end as exchange_trade_id, case i when 0 then '' else 'not BASE-QUOTE' end as reason from t, (select unnest([0, 1]) as i)",
    "sync_states": SYNC,
    "sync_stream": SYNC,
}
