"""DuckDB SQL for each named query over the same tables."""

from __future__ import annotations

from ..functions.chance import cumulative
from .queries import FIFTHS, LONG, MIXED, N, SAMPLE, SIZE, SLIDE, STEP, TENTHS
from .specs import family

DAY, HOUR = 86_400_000, 3_600_000

ENTITY = """e0 as (
  select *, (epoch_us(ts) // 1000) as ms, cast(json_extract(props, '$.k') as int) as k from events where event_type in ('view', 'click', 'purchase')
), entity as (
  select case event_type when 'view' then 'A' when 'click' then 'B' else 'C' end as type, event_id as id, ms,
    case event_type when 'view' then user_id when 'click' then event_id % 50 else event_id end as pk,
    case event_type when 'view' then -1 when 'click' then user_id else user_id % 50 end as fk,
    event_id % 10 as sel1, user_id % 10 as sel2, (k % 20)::bigint as long1, round(value * 100)::bigint as long2, k as filter_attr from e0
), a as (select * from entity where type = 'A'), b as (select * from entity where type = 'B'), c as (select * from entity where type = 'C')"""
AUCTIONS = """auction as (
  select o_orderkey as id, o_custkey as seller, substr(o_orderpriority, 1, 1)::bigint as category, round(o_totalprice * 100)::bigint // 8 as reserve,
    (epoch_us(o_orderdate) // 1000) as ms, (epoch_us(o_orderdate) // 1000) + 31536000000 as expires_ms, o_orderkey % 10 = 0 as sell_below_reserve from orders
), bid as (
  select l_orderkey as auction, l_suppkey as bidder, round(l_extendedprice * 100)::bigint as price, (epoch_us(l_shipdate) // 1000) as ms, l_returnflag || l_linestatus || l_partkey as extra from lineitem
), ranked as (
  select auction.*, price, row_number() over (partition by auction.id order by price desc, bid.ms, bidder) as rn from auction join bid on bid.auction = auction.id and bid.ms < expires_ms
), won as (
  select id as auction, price, category, seller, expires_ms from ranked where rn = 1 and (price >= reserve or sell_below_reserve)
)"""
TELEMETRY = """telemetry as (
  select event_id % 4 as subtask, (epoch_us(ts) // 1000) // 86400000 * 86400000 as interval_ms, count(*) as produced, count(*) filter (event_type <> 'error') as consumed from events group by 1, 2
), thr as (
  select *, sum(consumed) over w::bigint as consumed_total, sum(produced - consumed) over w::bigint as backlog from telemetry window w as (partition by subtask order by interval_ms)
)"""


def _specs(name: str, ranges) -> str:
    return f"{name}(qid, lo, hi) as (values {', '.join(map(str, ranges))})"


def _windows(ms: str, size: int, slide: int) -> str:
    return f"unnest(generate_series((({ms}) - {size}) // {slide} * {slide} + {slide}, ({ms}) // {slide} * {slide}, {slide}))"


def _pairs(size: int, slide: int, more: str = "", on: str = "true", tables: str = "a join b on a.pk = b.fk") -> str:
    first, last = f"(greatest(a.ms, b.ms) - {size}) // {slide} * {slide} + {slide}", f"least(a.ms, b.ms) // {slide} * {slide}"
    return f"select a.id as a_id, b.id as b_id, a.pk as a_pk, a.ms as a_ms, b.ms as b_ms, a.long1 as a_long1, b.long1 as b_long1, a.long2 as a_long2, b.long2 as b_long2, b.pk as b_pk{more}, {first} as first_window, {last} as last_window from {tables} and abs(a.ms - b.ms) < {size} and {on} where {first} <= {last}"


def _each(pairs: str, slide: int) -> str:
    return f"select *, unnest(generate_series(first_window, last_window, {slide})) as window_start from ({pairs})"


def _rising(rows: str, keys: str, value: str, order: str, columns: str) -> str:
    return f"select {columns} from (select *, max({value}) over (partition by {keys} order by {order} rows between unbounded preceding and 1 preceding) as peak from ({rows})) where peak is null or {value} > peak"


def _median(rows: str, keys: str, order: str, columns: str) -> str:
    return f"select {columns} from (select *, row_number() over (partition by {keys} order by {order}) as rn, count(*) over (partition by {keys}) as cnt from ({rows})) where rn = cnt // 2 + 1"


def _with(*parts: str) -> str:
    return f"with {', '.join(parts[:-1])} {parts[-1]}"


def _triples(size: int, slide: int, specs: bool = False) -> str:
    pairs = _each(_pairs(size, slide, ", q.qid" if specs else "", tables="a join b on a.pk = b.fk" + ("" if not specs else "")), slide)
    if specs:
        pairs = _each(_pairs(size, slide, ", q.qid", "a.filter_attr between q.lo and q.hi and b.filter_attr between q.lo and q.hi", "q cross join a join b on a.pk = b.fk"), slide)
    timed = f"(select *, window_start + {size - 1} as pair_ms from ({pairs}))"
    first, last = f"(greatest(p.pair_ms, c.ms) - {size}) // {slide} * {slide} + {slide}", f"least(p.pair_ms, c.ms) // {slide} * {slide}"
    more = "join q on q.qid = p.qid and c.filter_attr between q.lo and q.hi" if specs else ""
    return f"select p.* exclude (window_start), c.id as c_id, c.long1 as c_long1, c.long2 as c_long2, unnest(generate_series({first}, {last}, {slide})) as window_start from {timed} p join c on p.b_pk = c.fk and abs(p.pair_ms - c.ms) < {size} and {first} <= {last} {more}"


TUMBLING = _each(_pairs(SIZE, SIZE), SIZE)
MIX = _specs("q", MIXED)
TEN = _specs("q", TENTHS)
BOTH_IN = "a.filter_attr between q.lo and q.hi and b.filter_attr between q.lo and q.hi"
SHARED = _each(_pairs(SIZE, SLIDE, ", q.qid", BOTH_IN, "q cross join a join b on a.pk = b.fk"), SLIDE)
Q1 = _rising(TUMBLING, "a_long1", "a_long2", "window_start, a_id, b_id", "a_long1, window_start, a_id, b_id, a_long2")
Q2 = _median(f"select *, {_windows(f'window_start + {SIZE - 1}', SIZE, SLIDE)} as out_window from ({TUMBLING})", "out_window, b_long1", "b_long2, a_id, b_id, window_start", "out_window, b_long1, a_id, b_id, b_long2")
T1 = _rising(_triples(SIZE, SIZE), "a_long1", "a_long2", "window_start, a_id, b_id, c_id", "a_long1, window_start, a_id, c_id, a_long2")
T2 = _median(_triples(SIZE, SLIDE), "window_start, c_long1", "c_long2, a_id, b_id, c_id, pair_ms", "window_start, c_long1, a_id, c_id, c_long2")
INTERVAL = f"select a.id as a_id, b.id as b_id, a.pk as a_pk, b.long2 as b_long2, greatest(a.ms, b.ms) as late{{more}} from {{tables}} a.pk = b.fk and abs(a.ms - b.ms) <= {SIZE}"
ONE_INTERVAL = INTERVAL.format(more="", tables="a join b on")
MANY_INTERVAL = INTERVAL.format(more=", q.qid", tables=f"q cross join a join b on {BOTH_IN} and")


def _masked(alias: str = "") -> str:
    return "(" + " | ".join(f"case when {alias}filter_attr between {lo} and {hi} then {1 << q} else 0 end" for q, lo, hi in MIXED) + ")::bigint"


def _sliding(rows: str, ms: str, size: int, slide: int, keys: str, out: str) -> str:
    return f"select window_start, {keys}, {out} from (select *, {_windows(ms, size, slide)} as window_start from {rows}) group by window_start, {keys}"


TOP_TEN = f"select window_start, seller, avg(price) as mean from (select *, row_number() over (partition by window_start, seller order by price desc) as rn from (select *, {_windows('expires_ms', LONG, STEP)} as window_start from won)) where rn <= 10 group by 1, 2"
BY_CATEGORY = _sliding("won", "expires_ms", LONG, STEP, "category", "sum(price)::double / count(*) as mean")


def _varint(x: str) -> str:
    """Hex of a non-negative number as zig-zag varint."""
    z = f"(2 * ({x}))"
    parts = [f"case when {z} // {128**i} > 0 or {i} = 0 then lpad(hex((({z} // {128**i}) % 128 + case when {z} // {128 ** (i + 1)} > 0 then 128 else 0 end)::bigint), 2, '0') else '' end" for i in range(8)]
    return "(" + " || ".join(parts) + ")"


SUMS = f"select ms // {SIZE} * {SIZE} as window_start, pk as key, sum(long2)::bigint as total from b group by 1, 2"
ENRICHED = "select id, ms, pk, long2, c_name as name, n_name as nation from a left join (customer join nation on c_nationkey = n_nationkey) on pk = c_custkey"
IN_FIFTH = "case " + " ".join(f"when {{x}} between {lo} and {hi} then {i}" for i, (lo, hi) in enumerate(FIFTHS)) + " end"


def _whole(purpose: str, id_: str = "id", seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:{purpose}:' || {id_}), 1, 8))::bigint"


def _unit(purpose: str, id_: str = "id", seed: int = 42) -> str:
    return f"({_whole(purpose, id_, seed)} / 4294967296.0)"


def _draw(name: str, shares: list[float]) -> str:
    return f"len(list_filter({shares!r}::double[], lambda s: s <= {_unit(name)}))::bigint"


def _even(name: str, n: int) -> str:
    return f"floor({_unit(name)} * {n})::bigint"


def _letters(length: str, purpose: str, id_: str = "id") -> str:
    return f"substr(repeat(translate(md5('42:{purpose}:' || {id_}), '0123456789', 'ghijklmnop'), 4), 1, ({length})::int)"


def _pick(values: list[str], purpose: str) -> str:
    return f"list_extract({values!r}, ({_whole(purpose)} % {len(values)} + 1)::int)"


def _nexmark() -> str:
    from ..sources.generate import FIRST, LAST, AuctionPlan

    p = AuctionPlan()
    price = lambda x: f"round(pow(10.0, {_unit(x)} * 6) * 100)::bigint"
    group = p.group
    on = lambda k, e, name: f"case when type = '{k}' then {e} end as {name}"
    count = lambda lo, n: f"(id // {group} * {n} + least(greatest(id % {group} - {lo} + 1, 0), {n}))"
    span = 2 * p.in_flight * p.gaps_us[0] * group // p.auctions // 1000 + 1
    someone = f"(1000 + greatest(people, 1) - 1 - {_whole('who')} % least(greatest(people, 1), {p.active_people}))"
    four = " || ' ' || ".join(f"lpad(({_whole(f'card{i}')} % 10000)::varchar, 4, '0')" for i in range(4))
    return f"""with g as (
  select event_id as id, case when event_id % {group} < 1 then 'person' when event_id % {group} < 4 then 'auction' else 'bid' end as type, event_id * {p.gaps_us[0]} // 1000 as ms from events
), h as (select *, {count(0, 1)} as people, {count(1, 3)} as auctions from g)
select id as event_id, type, ms, {on('person', '999 + people', 'person_id')}, {on('person', f"{_pick(FIRST, 'first')} || ' ' || {_pick(LAST, 'last')}", 'name')}, {on('person', four, 'card')},
  {on('auction', '999 + auctions', 'auction_id')}, {on('auction', _letters(f"3 + {_whole('itemlen')} % 18", 'item'), 'item')}, {on('auction', price('initial'), 'initial_bid')}, {on('auction', f"{price('initial')} + {price('reserve')}", 'reserve')},
  {on('auction', f"ms + 1 + {_whole('length')} % {span}", 'expires_ms')}, {on('auction', someone, 'seller')}, {on('auction', f"10 + {_whole('category')} % 5", 'category')}, {on('auction', f"{_whole('below')} % 10 = 0", 'sell_below_reserve')},
  {on('bid', f"1000 + greatest(auctions, 1) - 1 - {_whole('auction')} % least(greatest(auctions, 1), {p.in_flight}) + {_whole('auctionlead')} % 11", 'auction')}, {on('bid', f"{someone} + {_whole('bidlead')} % 11", 'bidder')}, {on('bid', price('price'), 'price')}
from h"""


def _entities() -> str:
    late = lambda name, then, n: f"case when id >= 3000 then {_draw(name, then)} else {_even(name, n)} end"
    return f"""with g as (
  select event_id as id, case when event_id >= 3000 then case when event_id % 4 < 1 then 'A' else 'B' end when event_id % 3 < 1 then 'A' when event_id % 3 < 2 then 'B' else 'C' end as type,
    case when event_id >= 3000 then floor(300.0 + (event_id - 3000) * 1000.0::double / 20000) else floor(event_id * 1000.0::double / 10000) end::bigint as ms from events
)
select type, id, ms, 100000000 + case when type = 'C' then id else id % 50 end as pk, case when type in ('B', 'C') then 100000000 + {_whole('fk')} % 50 else -1 end as fk,
  {late('sel1', cumulative('zipf', 10, exponent=1.2, first=3), 10)} as sel1, {_even('sel2', 10)} as sel2, {late('long1', cumulative('binomial', 20, chance=0.3), 20)} as long1,
  {_even('long2', 1000)} as long2, {_even('filter_attr', 100)}::int as filter_attr, {_letters(f"3 + {_whole('textlen')} % 10", 'text')} as text
from g"""


STEPS = f"""job as (select interval_ms, sum(consumed)::double as throughput from thr group by 1), wish as (
  select interval_ms, sum(produced) * case when interval_ms // {DAY} % 10 < 5 then 1 else 2 end as desired from thr group by 1
), want as (
  select interval_ms, max(desired) over (partition by interval_ms // {5 * DAY})::double as desired from wish
), steps as (
  select subtask, interval_ms, throughput, produced - consumed - 18 * produced / 100.0::double as backlog, desired, row_number() over (partition by subtask order by interval_ms) as i from thr join job using (interval_ms) join want using (interval_ms)
)"""
FOLD = f"""with recursive {TELEMETRY}, {STEPS}, fold(subtask, i, interval_ms, rate, discount, desired) as (
  select subtask, 0::bigint, 0::bigint, 0.0::double, 0.1::double, null::double from (select distinct subtask from steps)
  union all
  select subtask, i, interval_ms, case when i > 4 then least(1.0, 0.5 * held + 0.5 * case when backlog <= 0 then missing * (1 - discount) else missing end) else held end,
    case when i <= 4 then discount when backlog > 0 then 0.1 when missing * (1 - discount) <> 0 then least(1.0, discount * 3.0) else discount end, desired
  from (
    select s.subtask, s.i, s.interval_ms, s.backlog, s.desired, f.discount, least(1.0, 1 - s.throughput / s.desired) as missing,
      case when f.desired is not null and f.desired <> s.desired then least(1.0, 1 - case when f.rate = 0 then s.desired else f.desired * (1 - f.rate) end / s.desired) else f.rate end as held
    from fold f join steps s on s.subtask = f.subtask and s.i = f.i + 1
  )
) select subtask, interval_ms, rate from fold where i > 0"""

ORACLES = {
    "pass_through": _with(AUCTIONS, "select * from bid"),
    "filter_bids": "select event_id, (epoch_us(ts) // 1000) as ms, user_id, value, props from events where event_type = 'purchase'",
    "map_long": _with(AUCTIONS, "select auction, floor(price::double * 0.92::double + 0.5::double)::bigint as euros from bid"),
    "map_string": _with(AUCTIONS, "select auction, substr(extra, 1, 10) as extra from bid"),
    "narrow_entities": _with(ENTITY, f"select type = 'A' as is_a, case when type = 'A' then pk else fk end::int as key, filter_attr, {_masked()} as qmask from entity where type <> 'C' and {_masked()} <> 0"),
    "json_extract": "select c_custkey, coalesce(c_name, 'null') || ' ' || coalesce(case when c_custkey % 7 > 0 then c_mktsegment end, 'null') as full_name from customer",
    "entity_wire": _with(ENTITY, "select type, id, ms, pk, fk, sel1, sel2, long1, long2, filter_attr, 'text' || id as text, null::varchar as json from entity"),
    "narrow_wire": _with(ENTITY, "select type = 'A' as is_a, case when type = 'A' then pk else fk end::int as key, filter_attr from entity where type <> 'C'"),
    "auction_wire": _with(AUCTIONS, "select id, reserve, category, seller, expires_ms, sum(price)::bigint as total, max(bid.ms) as last_ms from auction join bid on bid.auction = id group by all"),
    "file_stream": _with(AUCTIONS, f"select auction, ms // {DAY} * {DAY} as day, count(*) as n, sum(price)::bigint as total from bid group by 1, 2"),
    "latency_percentiles": f"select ms // {DAY} * {DAY} as interval_ms, quantile_cont(late, 0.5) as p50, quantile_cont(late, 0.95) as p95, quantile_cont(late, 0.99) as p99 from (select (epoch_us(ts) // 1000) as ms, round(value)::bigint as late from events) group by 1",
    "window_join_q1": _with(ENTITY, Q1),
    "window_join_q2": _with(ENTITY, Q2),
    "window_join_sliding": _with(ENTITY, f"select a_id, b_id, first_window, last_window, ((last_window - first_window) // {SLIDE} + 1)::bigint as n_windows from ({_pairs(SIZE, SLIDE)})"),
    "window_join_narrow": _with(ENTITY, f"select window_start, a_pk::int as a_key, qmask, count(*) as n from ({_each(_pairs(SIZE, SLIDE, f', {_masked("a.")} & {_masked("b.")} as qmask'), SLIDE)}) where qmask <> 0 group by 1, 2, 3"),
    "window_join_joint": _with(ENTITY, f"select 'peak' as which, window_start, a_long1 as key, a_id, b_id, a_long2 as value from ({Q1}) union all select 'median', out_window, b_long1, a_id, b_id, b_long2 from ({Q2})"),
    "three_way_q1": _with(ENTITY, T1),
    "three_way_q2": _with(ENTITY, T2),
    "three_way_joint": _with(ENTITY, f"select 'peak' as which, window_start, a_long1 as key, a_id, c_id, a_long2 as value from ({T1}) union all select 'median', window_start, c_long1, a_id, c_id, c_long2 from ({T2})"),
    "shared_join_mean": _with(ENTITY, MIX, f"select qid, window_start, a_pk, avg(b_long2) as mean from ({SHARED}) group by 1, 2, 3"),
    "shared_join_count": _with(ENTITY, MIX, f"select qid, window_start, a_pk, count(*) as n from ({SHARED}) group by 1, 2, 3"),
    "shared_join_median": _with(ENTITY, MIX, _median(SHARED, "qid, window_start, b_long1", "b_long2, a_id, b_id", "qid, window_start, b_long1, a_id, b_id, b_long2")),
    "shared_join_max": _with(ENTITY, MIX, _rising(SHARED, "qid, a_long1", "a_long2", "window_start, a_id, b_id", "qid, a_long1, window_start, a_id, b_id, a_long2")),
    "shared_three_way_count": _with(ENTITY, MIX, f"select qid, window_start, count(*) as n from ({_triples(SIZE, SIZE, True)}) group by 1, 2"),
    "shared_aggregation_median": _with(ENTITY, TEN, _median(f"select q.qid, a.*, {_windows('ms', SIZE, SLIDE)} as window_start from a join q on filter_attr between lo and hi", "qid, window_start, filter_attr", "long2, id", "qid, window_start, filter_attr, id, long2")),
    "shared_aggregation_mean": _with(ENTITY, TEN, _sliding("a join q on filter_attr between lo and hi", "ms", SIZE, SLIDE, "qid, filter_attr", "sum(long2)::double / count(long2) as mean")),
    "many_queries": _with(ENTITY, "select qid::int as qid, type, count(*) as n, sum(long2)::bigint as total from entity join (select unnest(range(100)) as qid) on filter_attr between qid % 90 and qid % 90 + 9 group by 1, 2"),
    "predicate_table": _with(ENTITY, MIX, "select id, type, string_agg(qid::varchar, ',' order by qid) as qids from entity join q on filter_attr between lo and hi group by 1, 2"),
    "query_activation": _with(ENTITY, MIX, f"select qid, ms // {DAY} * {DAY} as day, count(*) as n from entity join q on filter_attr between lo and hi where ms >= 1704067200000 + qid % 7 * {DAY} and ms < 1704067200000 + (qid % 7 + 3 + qid % 11) * {DAY} group by 1, 2"),
    "spec_queries": _with(
        ENTITY,
        f"""select 0 as qid, window_start, a_long1 as key, a_long2::double as value from ({Q1})
union all select 1, out_window, b_long1, avg(b_long2) from (select *, {_windows(f'window_start + {SIZE - 1}', SIZE, SLIDE)} as out_window from ({_each(_pairs(SIZE, SIZE, on='a.filter_attr between 0 and 59 and b.filter_attr between 20 and 99'), SIZE)})) group by 2, 3
union all select 2, window_start, a_long1, count(*)::double from ({_triples(DAY, DAY)}) group by 2, 3""",
    ),
    "shared_join_100": _with(ENTITY, f"select qid::int as qid, window_start, count(*) as n from ({_each(_pairs(SIZE, SIZE, ', q.qid', 'a.filter_attr between q.qid % 90 and q.qid % 90 + 9 + q.qid % 7 and b.filter_attr between q.qid % 90 and q.qid % 90 + 9 + q.qid % 7', '(select unnest(range(100)) as qid) q cross join a join b on a.pk = b.fk'), SIZE)}) group by 1, 2"),
    "workload_family": _with(ENTITY, _specs("q", [(i, *x.ranges[0]) for i, x in enumerate(family(12, None))]), f"select qid, count(*) as pairs, sum((last_window - first_window) // {HOUR} + 1)::bigint as matches from ({_pairs(60 * HOUR, HOUR, ', q.qid', BOTH_IN, 'q cross join a join b on a.pk = b.fk')}) group by 1"),
    "interval_join_pairs": _with(ENTITY, f"select a_id, b_id from ({ONE_INTERVAL})"),
    "interval_join_mean": _with(ENTITY, MIX, f"select qid, late // {SLIDE} * {SLIDE} as window_start, a_pk, avg(b_long2) as mean from ({MANY_INTERVAL}) group by 1, 2, 3"),
    "interval_join_median": _with(ENTITY, TEN, _median(f"select *, late // {SLIDE} * {SLIDE} as window_start from ({MANY_INTERVAL})", "qid, window_start", "a_pk, a_id, b_id", "qid, window_start, a_pk, a_id, b_id")),
    "winning_bids": _with(AUCTIONS, "select * from won"),
    "nexmark_q4": _with(AUCTIONS, BY_CATEGORY),
    "nexmark_q6": _with(AUCTIONS, TOP_TEN),
    "nexmark_q4_q6_joint": _with(AUCTIONS, f"select 'category' as which, window_start, category as key, mean from ({BY_CATEGORY}) union all select 'seller', window_start, seller, mean from ({TOP_TEN})"),
    "window_join_agg": _with(
        AUCTIONS,
        f"""select out_window, category, sum(s)::double / sum(n) as mean from (
  select *, {_windows(f'window_start + {LONG - 1}', LONG, STEP)} as out_window from (
    select window_start, category, sum(price) as s, count(*) as n from (
      select category, price, unnest(generate_series(f, l, {STEP})) as window_start from (
        select category, price, (greatest(auction.ms, bid.ms) - {LONG}) // {STEP} * {STEP} + {STEP} as f, least(auction.ms, bid.ms) // {STEP} * {STEP} as l from auction join bid on id = bid.auction and abs(auction.ms - bid.ms) < {LONG}
      ) where f <= l) group by 1, 2)) group by 1, 2""",
    ),
    "etl_enrich": _with(ENTITY, ENRICHED),
    "etl_window_sum": _with(ENTITY, f"select *, {_varint('key')} || {_varint('total')} as payload from ({SUMS})"),
    "etl_joint": _with(ENTITY, f"select 'enrich' as which, id as key, ms, concat_ws('/', name, nation) as out from ({ENRICHED}) union all select 'sum', key, window_start, {_varint('key')} || {_varint('total')} from ({SUMS})"),
    "etl_shared": _with(ENTITY, TEN, f"select qid, ms // {SIZE} * {SIZE} as window_start, pk, sum(long1)::bigint as total from b join q on filter_attr between lo and hi group by 1, 2, 3"),
    "etl_spec_filtered": _with(
        ENTITY,
        f"""sums as (
  select 1 as qid, pk as key, {_windows('ms', SIZE, DAY)} as window_start, long1 from b where filter_attr between 30 and 79 union all select 2, pk, ms // {SIZE} * {SIZE}, long1 from b
), totals as (select qid, key, window_start, sum(long1)::bigint as total from sums group by 1, 2, 3)""",
        f"select 0 as qid, e.id as key, e.ms, concat_ws('/', name, nation) as out from ({ENRICHED}) e join a on a.id = e.id where a.filter_attr between 10 and 49 union all select qid, key, window_start, {_varint('key')} || {_varint('total')} from totals",
    ),
    "running_max_sum": _with(ENTITY, f"select qid::int as qid, window_start, peak, sum(peak)::bigint as total from (select ms // {DAY} * {DAY} as window_start, greatest(max(long1) over (partition by pk order by ms, id), 0) as peak from a), (select unnest(range(2)) as qid) group by 1, 2, 3"),
    "window_record_high": _with(
        ENTITY,
        MIX,
        f"""m as (select * from a where {_masked()} <> 0), best as (
  select *, row_number() over (partition by pk, ms // {DAY} order by long1 desc, ms, id) as rn from m
), highs as (
  select *, max(long1) over (partition by pk order by ms // {DAY} rows between unbounded preceding and 1 preceding) as peak from best where rn = 1
)""",
        f"select qid, ms // {DAY} * {DAY} as window_start, long1, sum(long1)::bigint as total from highs join q on filter_attr between lo and hi where long1 > coalesce(peak, 0) and long1 > 0 group by 1, 2, 3",
    ),
    "sliding_panes": _with(ENTITY, _sliding("entity", "ms", 216_000_000, 3_600_000, "sel2", "sum(long2)::bigint as total")),
    "range_selectivity": _with(ENTITY, " union all ".join(f"select {i} as range, {lo}::bigint as lo, {hi}::bigint as hi, count(*) filter (filter_attr between {lo} and {hi}) as selected, count(*) as total from entity" for i, (lo, hi) in enumerate(FIFTHS))),
    "join_match_matrix": _with(
        ENTITY,
        f"x as (select *, {IN_FIFTH.format(x='filter_attr')} as r from a)",
        f"y as (select *, {IN_FIFTH.format(x='filter_attr')} as r from b)",
        f"select least(x.r, y.r) as low, greatest(x.r, y.r) as high, count(*) as matches from x join y on x.pk = y.fk and abs(x.ms - y.ms) <= {SIZE} group by 1, 2",
    ),
    "join_match_matrix_all": _with(
        ENTITY,
        f"x as (select *, {IN_FIFTH.format(x='filter_attr')} as r from a)",
        f"y as (select *, {IN_FIFTH.format(x='filter_attr')} as r from b)",
        f"select least(x.r, y.r) as low, greatest(x.r, y.r) as high, count(*) as matches from x join y on x.pk = y.fk and abs(x.ms - y.ms) <= {SIZE} group by 1, 2",
    ),
    "latency_sketch": f"""with x as (select (epoch_us(ts) // 1000) // {DAY} * {DAY} as interval_ms from events)
      select interval_ms, count(*) as n, true as near50, true as near95, true as near99 from x group by 1""",
    "user_aggregate": _with(ENTITY, "select type, sel2, round(exp(avg(ln(long2)) filter (long2 > 0)), 6) as mean from entity group by 1, 2"),
    "split_sample_stats": _with(
        ENTITY,
        MIX,
        f"r as (select type, case type when 'A' then pk else fk end as key, ms, qid, ms // {10 * DAY} * {10 * DAY} as window_start, row_number() over (partition by type, qid, ms // {10 * DAY} order by ms, id) as place from entity join q on filter_attr between lo and hi where type in ('A', 'B'))",
        f"s as (select * from r where place <= case type when 'A' then {SAMPLE[0]} else {SAMPLE[1]} end)",
        "n as (select qid, window_start, count(*) filter (type = 'A') as sampled_a, count(*) filter (type = 'B') as sampled_b from s group by 1, 2)",
        f"m as (select x.qid, x.window_start, count(*) as matches from s x join s y on x.type = 'A' and y.type = 'B' and x.qid = y.qid and x.window_start = y.window_start and x.key = y.key and abs(x.ms - y.ms) <= {SIZE} group by 1, 2)",
        "select qid, window_start, sampled_a, sampled_b, coalesce(matches, 0) as matches from n left join m using (qid, window_start)",
    ),
    "split_stats": _with(
        ENTITY,
        MIX,
        f"s as (select qid, ms // {10 * DAY} * {10 * DAY} as window_start, count(*) as selected from a join q on filter_attr between lo and hi group by 1, 2)",
        f"m as (select qid, late // {10 * DAY} * {10 * DAY} as window_start, count(*) as matches from ({MANY_INTERVAL}) group by 1, 2)",
        "select qid, window_start, coalesce(selected, 0) as selected, coalesce(matches, 0) as matches from s full join m using (qid, window_start)",
    ),
    "latency_samples": f"select (epoch_us(ts) // 1000) // {DAY} * {DAY} as interval_ms, arg_min(round(value)::bigint, struct_pack(a := (epoch_us(ts) // 1000), b := event_id)) as sample, avg(round(value)::bigint) as mean, max(round(value)::bigint) as worst from events group by 1",
    "throughput": _with(TELEMETRY, "select * from thr"),
    "smoothed_throughput": _with(TELEMETRY, "select interval_ms, sum((consumed_total - was) // 60)::bigint as throughput from (select *, lag(consumed_total, 12, 0) over (partition by subtask order by interval_ms) as was from thr) group by 1"),
    "shed_sample": _with(
        ENTITY,
        TELEMETRY,
        f"r as (select interval_ms, max(backlog) / 100000.0::double + (interval_ms // {DAY} % 5) / 10.0::double as rate, max(backlog) - 40 as backlog from thr group by 1)",
        f"select id, type, ms from entity left join r on r.interval_ms = ms // {DAY} * {DAY} where not case when backlog > 1000 then true when backlog < -1000 then false else {_unit('shed', seed=7)} < coalesce(rate, 0) end",
    ),
    "shed_rate_series": FOLD,
    "gen_nexmark": _nexmark(),
    "gen_entities": _entities(),
}
