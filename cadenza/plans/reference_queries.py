"""Registered queries of the time-series operators, each with the SQL it is held against.

`events` serves as the series: user_id is the recording, event_id the order, ts the time, event_type the marker text. Sensor tables are
used where they carry what an operator decodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, names
from ..operators import events as ev
from ..operators import gaze, joins, masks, series, stats, windows
from ..sources.tables import nan_to_null, table

K, O = ["user_id"], "event_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name; sql is its equivalent."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ev_series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return e.withColumn("t", series.seconds("ts")).withColumn("m", F.col("value") > 50).drop("ts")


E = "e as (select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 as t, value > 50 as m, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events)"
EDGE = E + """, f as (select *, coalesce(i = 0 or i = n - 1 or (i < n - 1 and m <> lag(m) over (partition by user_id order by i)), false) as edge from e),
g as (select *, sum((edge and (i < n - 1 or n = 1))::int) over (partition by user_id order by i) as run from f),
r0 as (select user_id, run, min(i) first, max(n) n, arg_min(m, i) as on_, arg_min(t, i) t_first, arg_max(t, i) t_end from g group by all),
r as (select user_id, run, first, coalesce(lead(first) over w, n - 1) as last, on_, t_first, coalesce(lead(t_first) over w, t_end) as t_last from r0 window w as (partition by user_id order by run))"""


# joins


@query("""
with j as (select o_orderkey, o_orderdate, l_linenumber, l_partkey, date_diff('microsecond', o_orderdate::timestamp, l_shipdate::timestamp) / 86400e6 as off
  from orders left join lineitem on o_orderkey = l_orderkey and l_shipdate is not null where o_orderdate is not null),
k as (select *, rank() over (partition by o_orderkey, o_orderdate order by abs(off) nulls last) as r from j)
select o_orderkey, l_linenumber, l_partkey, round(off, 4) as off from k where r = 1""")
def nearest_date_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_shipdate")
    d = joins.nearest_date_join(o, li, ["key"], "o_orderdate", "l_shipdate", "off")
    return d.select(F.col("key").alias("o_orderkey"), F.col("r_l_linenumber").alias("l_linenumber"), F.col("r_l_partkey").alias("l_partkey"), F.round("off", 4).alias("off"))


@query("""
with j as (select o_orderkey, o_orderdate, l_linenumber, date_diff('microsecond', o_orderdate::timestamp, l_shipdate::timestamp) / 86400e6 as off
  from orders left join (select * from lineitem where l_quantity > 45) on o_orderkey = l_orderkey),
k as (select *, rank() over (partition by o_orderkey, o_orderdate order by abs(off) nulls last) as r from j)
select o_orderkey, l_linenumber, round(off, 4) as off from k where r = 1""")
def nearest_date_unmatched(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    li = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_shipdate")
    d = joins.nearest_date_join(o, li, ["key"], "o_orderdate", "l_shipdate", "off")
    return d.select(F.col("key").alias("o_orderkey"), F.col("r_l_linenumber").alias("l_linenumber"), F.round("off", 4).alias("off"))


@query("""
with a as (select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity > 30), b as (select l_orderkey, l_linenumber, l_suppkey from lineitem where l_quantity <= 30),
k as (select a.l_orderkey, a.l_partkey, b.l_suppkey, a.l_linenumber - b.l_linenumber as off, rank() over (partition by a.l_orderkey, a.l_linenumber order by a.l_linenumber - b.l_linenumber) as r
  from a join b on a.l_orderkey = b.l_orderkey where a.l_linenumber >= b.l_linenumber)
select l_orderkey, l_partkey, l_suppkey, off from k where r = 1""")
def prior_visit_join(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("event", F.concat(F.lit("v"), F.col("l_linenumber"), F.lit("_arm_1")))
    a = li.filter("l_quantity > 30").select("l_orderkey", "event", "l_partkey")
    b = li.filter("l_quantity <= 30").select("l_orderkey", "event", "l_suppkey")
    return joins.prior_visit_join(a, b, ["l_orderkey"], "event", "off").select("l_orderkey", "l_partkey", F.col("r_l_suppkey").alias("l_suppkey"), F.col("off").cast("long").alias("off"))


@query("select distinct c_custkey from customer left join orders on c_custkey = o_custkey where c_acctbal < 0 or o_orderkey is null order by c_custkey")
def flagged_or_missing(spark, sf):
    from .jobs import flagged_subjects

    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    flags = c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").select("c_custkey", (F.col("c_acctbal") < 0).alias("f"))
    return flagged_subjects(c, flags, "c_custkey", "f")


def _purchases(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("no"), F.col("t").alias("a"), (F.col("t") + 3600).alias("b"))


@query(f"with {E}, p as (select user_id, t a, t + 3600 b from e where event_type = 'purchase') select event_id, exists (select 1 from p where p.user_id = e.user_id and e.t between a and b) as inside from e")
def interval_flag_closed(spark, sf):
    e = ev_series(spark, sf)
    return joins.interval_flag(e, _purchases(e), K, "t", "a", "b", "inside", 7200.0).select("event_id", "inside")


@query(f"with {E}, p as (select user_id, event_id no, t a, t + 3600 b from e where event_type = 'purchase') select e.event_id, coalesce(max(p.no), 0) as number from e left join p on p.user_id = e.user_id and e.t >= a and e.t < b group by 1")
def interval_mask_halfopen(spark, sf):
    e = ev_series(spark, sf)
    return joins.interval_number(e, _purchases(e), K, "t", "a", "b", "no", "number", 7200.0).select("event_id", "number")


@query(f"""with {E}, p as (select user_id, event_type kind, t a, t + 3600 b from e where event_type in ('purchase', 'view')) select e.event_id, coalesce(string_agg(distinct p.kind, ',' order by p.kind), '') as kinds
from e left join p on p.user_id = e.user_id and e.t >= a and e.t < b group by 1""")
def interval_labels(spark, sf):
    e = ev_series(spark, sf)
    p = e.filter(F.col("event_type").isin("purchase", "view")).select("user_id", F.col("event_type").alias("kind"), F.col("t").alias("a"), (F.col("t") + 3600).alias("b"))
    return joins.interval_labels(e, p, K, "t", "a", "b", "kind", "kinds", 7200.0).select("event_id", F.array_join("kinds", ",").alias("kinds"))


@query(f"""with {E}, s as (select * from e where event_type <> 'error'), m as (select user_id, t, event_id::varchar v from e where event_type = 'error'),
te as (select user_id, max(t) te from s group by 1), me as (select user_id, max(t) me from m group by 1)
select s.event_id, case when (te <= me and s.t >= me) or (te > me and s.t = te) then null else m.v end as marker
from s asof left join m on s.user_id = m.user_id and s.t >= m.t left join te on te.user_id = s.user_id left join me on me.user_id = s.user_id""")
def asof_marker(spark, sf):
    e = ev_series(spark, sf)
    m = e.filter("event_type = 'error'").select("user_id", F.col("t").alias("mt"), "event_id")
    return joins.asof_marker(e.filter("event_type <> 'error'"), m, K, "event_id", "t", "mt", "event_id", "marker").select("event_id", "marker")


@query(f"""with {E}, l as (select user_id, event_id no, t from e where event_type = 'view'), r as (select user_id, event_id no, t from e where event_type = 'click'),
j as (select r.user_id, r.no, l.no vw, row_number() over (partition by r.no order by abs(l.t - r.t), l.no) k from r left join l on l.user_id = r.user_id),
w as (select *, row_number() over (partition by user_id, vw order by no desc) z from j where k = 1)
select no as click_id, case when z = 1 then vw end as view_id from w""")
def nearest_ts_lww(spark, sf):
    e = ev_series(spark, sf)
    d = joins.nearest_last_writer(e.filter("event_type = 'view'"), e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("no"), "t"), K, "event_id", "t", "no", "t")
    return d.select(F.col("no").alias("click_id"), F.col("event_id").alias("view_id"))


ASSOC = """with o as (select * from device_data where extension in ('.hdf5', '.json', '.mov'))
select d.session_path, d.file_name, (select coalesce(string_agg(distinct o.file_name, ',' order by o.file_name), '') from o where o.session_path = d.session_path and o.subject_id = d.subject_id and o.file_datetime = d.file_datetime
  and o.task = d.task and o.device = d.device{info}) as associated from device_data d"""


def _associated(spark, sf, use_device_info: bool) -> DataFrame:
    from .jobs import associated_files as find

    d = table(spark, sf, "device_data")
    return find(d, d, extensions=(".hdf5", ".json", ".mov"), use_device_info=use_device_info).withColumn("associated", F.array_join("associated", ","))


@query(ASSOC.format(info=""))
def associated_files(spark, sf):
    return _associated(spark, sf, False)


@query(ASSOC.format(info=" and o.device_info = d.device_info"))
def associated_files_by_info(spark, sf):
    return _associated(spark, sf, True)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 25)")
def left_anti_ledger(spark, sf):
    from .jobs import pending

    done = table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query(f"with {E}, p as (select user_id, arg_max(t, event_id) a from e where event_type = 'purchase' group by 1) select event_id, coalesce(t between a and a + 3600, false) as inside from e left join p using (user_id)")
def interval_flag_last(spark, sf):
    e = ev_series(spark, sf)
    return joins.interval_flag(e, _purchases(e), K, "t", "a", "b", "inside", 7200.0, last_by="no").select("event_id", "inside")


@query(f"""with {E}, v as (select user_id, event_id, t, row_number() over (partition by user_id order by event_id) - 1 i from e where event_type = 'view'), c as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 i from e where event_type = 'click'),
z as (select v.user_id, v.t, v.event_id no, c.event_id frame from v join c on c.user_id = v.user_id and c.i = v.i), r as (select user_id, event_id no, t from e where event_type = 'error'),
j as (select r.user_id, r.no, z.no vw, z.frame, row_number() over (partition by r.no order by abs(z.t - r.t), z.no) k from r left join z on z.user_id = r.user_id), w as (select *, row_number() over (partition by user_id, vw order by no desc) x from j where k = 1)
select no as error_id, case when x = 1 then vw end as view_id, case when x = 1 then frame end as frame from w""")
def zip_then_nearest(spark, sf):
    """Frames zipped by position with their times, then each row of the other stream written to the nearest of them."""
    e = ev_series(spark, sf)
    z = series.positional_zip(e.filter("event_type = 'view'").select("user_id", "event_id", "t"), e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("frame")), K, "event_id", "frame")
    d = joins.nearest_last_writer(z, e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("no"), "t"), K, "event_id", "t", "no", "t")
    d = d.join(z.select("user_id", "event_id", F.col("r_frame").alias("frame")), ["user_id", "event_id"], "left")
    return d.select(F.col("no").alias("error_id"), F.col("event_id").alias("view_id"), "frame")


@query("""with o as (select o_custkey, o_orderdate, max(o_orderkey) o_orderkey from orders group by all)
select o_custkey, o_orderdate::date::varchar as day, o_orderkey, arg_max(o_totalprice, orders.o_orderkey) as o_totalprice from orders join o using (o_custkey, o_orderdate, o_orderkey) group by all""")
def last_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    d = joins.last_per_key(o, ["o_custkey", "o_orderdate"], "o_orderkey")
    return d.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")


# masks


@query(f"with {E} select event_id, coalesce(i = 0 or i = n - 1 or (i < n - 1 and m <> lag(m) over (partition by user_id order by i)), false) as is_edge from e")
def bool_edges(spark, sf):
    return masks.mark_edges(ev_series(spark, sf), K, O, "m", True).select("event_id", "is_edge")


@query(f"with {E} select event_id, coalesce(m <> lag(m) over (partition by user_id order by i), false) as is_edge from e")
def bool_edges_noend(spark, sf):
    return masks.mark_edges(ev_series(spark, sf), K, O, "m", False).select("event_id", "is_edge")


@query(f"with {E}, f as (select *, floor(value / 100)::int as b from e) select event_id, coalesce(i = 0 or i = n - 1 or (i < n - 1 and b <> lag(b) over (partition by user_id order by i)), false) as is_edge from f")
def int_edges(spark, sf):
    return masks.mark_edges(ev_series(spark, sf).withColumn("b", F.floor(F.col("value") / 100).cast("int")), K, O, "b", True, True).select("event_id", "is_edge")


@query(f"with {E}, f as (select *, floor(value / 100)::int as b from e) select event_id, coalesce(b <> lag(b) over (partition by user_id order by i), b <> 0) as is_edge from f")
def int_edges_noend(spark, sf):
    return masks.mark_edges(ev_series(spark, sf).withColumn("b", F.floor(F.col("value") / 100).cast("int")), K, O, "b", False, True).select("event_id", "is_edge")


@query(f"with {EDGE} select user_id, row_number() over (partition by user_id order by first) as island, first, last, last - first as samples from r where on_ and last > first")
def islands(spark, sf):
    return masks.islands(ev_series(spark, sf), K, O, "m", "t").select("user_id", F.col("island").cast("long").alias("island"), "first", "last", "samples")


@query(f"with {EDGE}, x as (select *, row_number() over (partition by user_id order by first desc) k from r where on_ and last - first >= 3) select user_id, first, last from x where k = 1")
def last_long_island(spark, sf):
    return masks.last_long_island(ev_series(spark, sf), K, O, "m", "t", 3).select("user_id", "first", "last")


@query(f"with {EDGE} select user_id, round(t_first, 3) as t_first, round(t_last, 3) as t_last from r where on_ and last > first")
def mask_spans(spark, sf):
    return masks.islands(ev_series(spark, sf), K, O, "m", "t").select("user_id", F.round("t_first", 3).alias("t_first"), F.round("t_last", 3).alias("t_last"))


PAINT = """, q as (select user_id, run from r where {cond}), p as (select g.*, q.run is not null as hit, lag(q.run is not null) over w as before, lag(g.run) over w as prev_run
  from g left join q on q.user_id = g.user_id and q.run = g.run window w as (partition by g.user_id order by g.i))"""


@query(f"with {EDGE}{PAINT.format(cond='on_ and t_last - t_first <= 20000')} select event_id, coalesce(m, false) and not (hit or coalesce(before and prev_run <> run, false)) as m from p")
def small_run_filter(spark, sf):
    return gaze.filter_small(ev_series(spark, sf), K, O, "t", "m", 20000.0).select("event_id", "m")


# count windows


@query(f"with {E}, w as (select user_id, i // 5 as win, i % 5 as pos, value from e), a as (select user_id, win, unnest(range(5)) pos from (select distinct user_id, win from w)) select a.user_id, a.win, a.pos, coalesce(w.value, 0) as value from a left join w using (user_id, win, pos)")
def tumbling_windows(spark, sf):
    d = windows.tumbling_windows(ev_series(spark, sf), K, O, "value", 5)
    return d.select("user_id", "win", F.posexplode("values").alias("p", "value")).select("user_id", "win", F.col("p").cast("long").alias("pos"), "value")


@query(f"""with {E}, u as (select distinct user_id, n, case when n < 5 then 5 else n + 2 - n % 2 end padded from e),
a as (select user_id, win, unnest(range(5)) pos from (select user_id, unnest(range((padded - 5) // 2 + 1)) win from u))
select a.user_id, a.win, a.pos, coalesce(e.value, 0) as value from a left join e on e.user_id = a.user_id and e.i = a.win * 2 + a.pos""")
def hopping_windows(spark, sf):
    d = windows.hopping_windows(ev_series(spark, sf), K, O, "value", 5, 2)
    return d.select("user_id", "win", F.posexplode("values").alias("p", "value")).select("user_id", "win", F.col("p").cast("long").alias("pos"), "value")


# series


@query(f"with {E}, d as (select user_id, t, t - lag(t) over (partition by user_id order by event_id) dt from e) select user_id, count(*) as n, round(1e6 / quantile_cont(dt, 0.5), 3) as median_rate, round(1e6 / avg(dt), 3) as mean_rate from d group by 1")
def diff_rate_median(spark, sf):
    r = series.rates(ev_series(spark, sf), K, O, "t")
    return r.select("user_id", "n", F.round(F.col("median_rate") * 1e6, 3).alias("median_rate"), F.round(F.col("mean_rate") * 1e6, 3).alias("mean_rate"))


@query(f"""with {E}, l as (select *, lag(value) over w xp, lead(value) over w xn, lag(t) over w tp, lead(t) over w tn from e window w as (partition by user_id order by event_id)),
d as (select *, t - tp hs, tn - t hd from l)
select event_id, round(1e3 * case when tp is null then (xn - value) / nullif(hd, 0) when tn is null then (value - xp) / nullif(hs, 0)
  else (hs * hs * xn + (hd * hd - hs * hs) * value - hd * hd * xp) / nullif(hs * hd * (hs + hd), 0) end, 4) as slope from d""")
def gradient(spark, sf):
    d = series.with_gradient(ev_series(spark, sf), K, O, "t", {"slope": "value"})
    return d.select("event_id", F.round(F.col("slope") * 1e3, 4).alias("slope"))


@query(f"""with {E} select event_id, round(case when i < 2 then avg(value) over (w rows between 2 preceding and 1 following) when n - 1 - i < 2 then avg(value) over (w rows between 1 preceding and 2 following)
  else avg(value) over (w rows between 2 preceding and 2 following) end, 4) as smoothed from e window w as (partition by user_id order by i)""")
def smooth_partial_ends(spark, sf):
    return series.smooth(ev_series(spark, sf), K, O, "value", 5, "s").select("event_id", F.round("s", 4).alias("smoothed"))


@query(f"""with {E}, d as (select *, (lead(t) over (partition by user_id order by event_id) - t) / 36000 dt from e),
g as (select user_id, avg(dt) mean, count(*) - 1 m from d group by 1 having count(*) > 1 and avg(dt) > 0), g2 as (select *, round_even(1 / mean, 0)::bigint * 4 w from g), g3 as (select *, w + (w % 2 = 0)::int as k, (w + (w % 2 = 0)::int - 1) // 2 h from g2),
c as (select user_id, i, dt from d where dt is not null), x as (select c.user_id, c.i, any_value(g3.mean) mean, sum(o.dt) / any_value(g3.k) ma from c join g3 using (user_id) join c o on o.user_id = c.user_id and o.i between c.i - g3.h and c.i + g3.h group by 1, 2)
select user_id, min(i) filter (abs(1 / mean - 1 / ma) < 1) + 1 as stable from x group by 1""")
def stable_rate_index(spark, sf):
    e = ev_series(spark, sf).withColumn("t", F.col("t") / 36000)
    return series.stable_rate_index(e, K, O, "t", 1.0, 4)


@query(f"""with {E}, d as (select user_id, i, value, t, sum(value / 100) over (partition by user_id order by i) dur from e), o as (select user_id, avg(t - dur) off, arg_min(dur, i) d0 from d group by 1)
select user_id, i as batch, round(dur - value / 100 - d0 + off, 1) as start from d join o using (user_id)""")
def cumsum_offset(spark, sf):
    return series.batch_times(ev_series(spark, sf), K, O, "value", "t", 100.0).select("user_id", "batch", F.round("start", 1).alias("start"))


@query("""with e as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 i, count(*) over (partition by label) n, lag(vec_id) over (partition by label order by vec_id) p,
  (max(vec_id) over (partition by label) - min(vec_id) over (partition by label)) / (count(*) over (partition by label) - 1)::double as mean from embeddings),
x as (select label, i, coalesce(p, vec_id - mean) prev, vec_id, unnest(embedding) v, unnest(range(len(embedding))) j, len(embedding) w from e where n > 1)
select label, i as chunk, j as pos, round(v::double, 5) as value, round(prev + (j + 1) * (vec_id - prev) / w, 5) as t from x""")
def chunk_explode_interp(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("t", F.col("vec_id").cast("double"))
    d = series.chunk_explode(e, ["label"], "vec_id", "t", "embedding")
    return d.select("label", "chunk", F.col("pos").cast("long").alias("pos"), F.round(F.col("value").cast("double"), 5).alias("value"), F.round("t", 5).alias("t"))


BOUNDS = "b as (select user_id, min(t) s, max(t) x from e where event_type = 'view' group by 1)"


@query(f"""with {E}, {BOUNDS}, d as (select e.user_id, i, n, s, x, greatest(0, n - round_even((x - s) / 100000, 0)::bigint) skip from e join b using (user_id))
select user_id, i - skip as k, round(s + coalesce((i - skip) * (x - s) / nullif(n - skip - 1, 0), 0), 3) as t from d where i >= skip""")
def audio_uniform_ts(spark, sf):
    e = ev_series(spark, sf)
    b = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return series.uniform_times(e.drop("t"), K, O, b, 1e-5).select("user_id", "k", F.round("t", 3).alias("t"))


@query(f"with {E}, {BOUNDS} select user_id, i, round(x - n / 48.0::double + coalesce(i * (n / 48.0::double) / nullif(n - 1, 0), 0), 1) as t from e join b using (user_id)")
def audio_endpoint_ts(spark, sf):
    e = ev_series(spark, sf)
    b = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return series.endpoint_times(e.drop("t"), K, O, b, 48.0).select("user_id", "i", F.round("t", 1).alias("t"))


# statistics


@query(f"with {E}, md as (select user_id, median(value) c from e group by 1) select user_id, round(5 * sqrt(median((value - c) * (value - c))), 4) as radius from e join md using (user_id) group by 1 having sqrt(median((value - c) * (value - c))) >= 1e-10")
def detection_radius(spark, sf):
    return stats.detection_radius(ev_series(spark, sf), K, "value", 5.0).filter("radius is not null").select("user_id", F.round("radius", 4).alias("radius"))


@query(f"with {E}, md as (select user_id, median(value) c from e group by 1) select user_id, round(1.4826 * median(abs(value - c)), 4) as mad from e join md using (user_id) group by 1")
def mad_per_group(spark, sf):
    return stats.mad(ev_series(spark, sf), K, "value").select("user_id", F.round("mad", 4).alias("mad"))


@query(f"""with {E}, g as (select user_id, count(*) as n, regr_slope(event_id, t) k, regr_intercept(event_id, t) c from e group by 1) select user_id, n, round(1e6 * k, 4) as slope, round(c / 1e4, 2) as intercept,
  case when n < 3 then 'short' when abs(k - 1) > 1e-3 then 'slope' end as status from g""")
def clock_offset_regression(spark, sf):
    d = stats.clock_offset(ev_series(spark, sf), K, "t", "event_id")
    return d.select("user_id", F.col("n").cast("long").alias("n"), F.round(F.col("slope") * 1e6, 4).alias("slope"), F.round(F.col("intercept") / 1e4, 2).alias("intercept"), "status")


@query("""with c as (select distinct recording_id, sample_idx, Time_LSL, Time_ACQ from realsense where Time_LSL is not null and not isnan(Time_LSL) and Time_ACQ is not null and not isnan(Time_ACQ))
select recording_id, count(*) as n, round(avg(Time_ACQ - Time_LSL), 4) as mean_offset, round(regr_slope(Time_ACQ, Time_LSL), 6) as slope from c group by 1""")
def camera_clock_offset(spark, sf):
    c = nan_to_null(table(spark, sf, "realsense").select("recording_id", "sample_idx", "Time_LSL", "Time_ACQ").dropDuplicates()).dropna()
    m = c.groupBy("recording_id").agg(F.round(F.avg(F.col("Time_ACQ") - F.col("Time_LSL")), 4).alias("mean_offset"))
    d = stats.clock_offset(c, ["recording_id"], "Time_LSL", "Time_ACQ").join(m, "recording_id")
    return d.select("recording_id", F.col("n").cast("long").alias("n"), "mean_offset", F.round("slope", 6).alias("slope"))


# gaze

VEL = E + ", v as (select *, value - lag(value, 1, value) over (partition by user_id order by i) vx, i - n / 2.0 as vy from e)"


def _gaze(spark, sf) -> DataFrame:
    d = masks.with_position(ev_series(spark, sf), K, O)
    w = masks.ordered(K, "i")
    return d.withColumn("vx", F.col("value") - F.lag("value", 1).over(w)).withColumn("vx", F.coalesce("vx", F.lit(0.0))).withColumn("vy", F.col("i") - F.col("n") / 2.0).drop("i", "n")


SACC = VEL.replace("value > 50 as m", "value > 50 as m0") + """, mx as (select user_id, median(vx) m from v group by 1), my as (select user_id, median(vy) m from v group by 1),
rx as (select user_id, case when sqrt(median((vx - m) * (vx - m))) >= 1e-10 then sqrt(median((vx - m) * (vx - m))) when sqrt(avg(vx * vx)) - avg(vx) * avg(vx) >= 1e-10 then sqrt(avg(vx * vx)) - avg(vx) * avg(vx) end * 2 rx from v join mx using (user_id) group by 1),
ry as (select user_id, case when sqrt(median((vy - m) * (vy - m))) >= 1e-10 then sqrt(median((vy - m) * (vy - m))) when sqrt(avg(vy * vy)) - avg(vy) * avg(vy) >= 1e-10 then sqrt(avg(vy * vy)) - avg(vy) * avg(vy) end * 2 ry from v join my using (user_id) group by 1),
v2 as (select v.*, coalesce(pow(vx / rx, 2) + pow(vy / ry, 2) > 1, false) as m from v join rx using (user_id) join ry using (user_id)),
f as (select *, coalesce(i = 0 or i = n - 1 or (i < n - 1 and m <> lag(m) over (partition by user_id order by i)), false) as edge from v2),
g as (select *, sum((edge and (i < n - 1 or n = 1))::int) over (partition by user_id order by i) as run from f),
r0 as (select user_id, run, min(i) first, max(n) n, arg_min(m, i) as on_, arg_min(t, i) t_first, arg_max(t, i) t_end from g group by all),
r as (select user_id, run, first, coalesce(lead(first) over w, n - 1) as last, on_, t_first, coalesce(lead(t_first) over w, t_end) as t_last from r0 window w as (partition by user_id order by run))"""
SACC += PAINT.format(cond="on_ and t_last - t_first >= 5000")


@query(f"with {SACC} select event_id, hit or coalesce(before and prev_run <> run, false) as saccade from p")
def saccade_mask(spark, sf):
    return gaze.detect_saccades(_gaze(spark, sf), K, O, "t", "vx", "vy", 2.0, 5000.0).select("event_id", "saccade")


BLINK = EDGE + """, s as (select user_id, run, value x, value * value / 100 y from g union all
  select user_id, pr, x, y from (select user_id, run, lag(run) over (partition by user_id order by i) pr, value x, value * value / 100 y from g) where pr <> run),
s2 as (select s.* from s join r on r.user_id = s.user_id and r.run = s.run where r.on_),
md as (select user_id, run, median(x) mx, median(y) my from s2 group by all),
dv as (select user_id, run, log10(1.4826 * median(abs(x - mx)) + 1e-7) lx, log10(1.4826 * median(abs(y - my)) + 1e-7) ly from s2 join md using (user_id, run) group by all),
ct as (select user_id, median(lx) cx, median(ly) cy from dv group by 1),
th as (select user_id, cx - 0.5 * 1.4826 * median(abs(lx - cx)) tx, cy - 0.5 * 1.4826 * median(abs(ly - cy)) ty from dv join ct using (user_id) group by user_id, cx, cy),
q as (select user_id, run from dv join th using (user_id) where round(lx - tx, 9) < 0 and round(ly - ty, 9) < 0),
p as (select g.*, q.run is not null as hit, lag(q.run is not null) over w as before, lag(g.run) over w as prev_run from g left join q on q.user_id = g.user_id and q.run = g.run window w as (partition by g.user_id order by g.i))"""


@query(f"with {BLINK} select event_id, hit or coalesce(before and prev_run <> run, false) as blink from p")
def blink_mask(spark, sf):
    d = ev_series(spark, sf).withColumn("y", F.col("value") * F.col("value") / 100)
    return gaze.detect_blinks(d, K, O, "t", "value", "y", "m", 0.5).select("event_id", "blink")


@query()
def gaze_events(spark, sf):
    """The whole detector on the right eye's gaze of the recordings."""
    e = nan_to_null(table(spark, sf, "eyelink").select("recording_id", "sample_idx", "Time_LSL", F.col("R_GazeX").alias("x"), F.col("R_GazeY").alias("y"))).dropDuplicates(["recording_id", "sample_idx"]).filter("Time_LSL is not null")
    e = series.with_gradient(e, ["recording_id"], "sample_idx", "Time_LSL", {"vx": "x", "vy": "y"})
    return gaze.detect_gaze_events(e, ["recording_id"], "sample_idx", "Time_LSL", "x", "y", "vx", "vy").select("recording_id", "sample_idx", "saccade", "fixation", "blink")


@query(f"""with {E}, be as (select *, event_type = 'error' as b, value > 100 as s from e),
bf as (select *, coalesce(i = 0 or i = n - 1 or (i < n - 1 and b <> lag(b) over w), false) eb, coalesce(i = 0 or i = n - 1 or (i < n - 1 and s <> lag(s) over w), false) es from be window w as (partition by user_id order by i)),
bg as (select *, sum((eb and (i < n - 1 or n = 1))::int) over w rb, sum((es and (i < n - 1 or n = 1))::int) over w rs from bf window w as (partition by user_id order by i)),
b0 as (select user_id, rb, min(i) first, max(n) n, arg_min(b, i) on_, arg_min(t, i) t_first, arg_max(t, i) t_end from bg group by all),
b1 as (select user_id, on_, first, coalesce(lead(first) over w, n - 1) last, t_first - 1000 lo, coalesce(lead(t_first) over w, t_end) + 1000 hi from b0 window w as (partition by user_id order by rb)),
s0 as (select user_id, rs, min(i) first, max(n) n, arg_min(s, i) on_ from bg group by all),
s1 as (select user_id, on_, first, coalesce(lead(first) over w, n - 1) last from s0 window w as (partition by user_id order by rs)),
near as (select e.*, exists (select 1 from b1 where b1.on_ and b1.last > b1.first and b1.user_id = e.user_id and e.t between lo and hi) as nr from e),
sj as (select s1.user_id, s1.first, s1.last from s1 where s1.on_ and s1.last > s1.first and exists (select 1 from near where near.user_id = s1.user_id and near.i >= s1.first and near.i < s1.last and near.nr))
select event_id, nr or exists (select 1 from sj where sj.user_id = near.user_id and near.i >= sj.first and near.i < sj.last) as excluded from near""")
def blink_exclusion(spark, sf):
    e = ev_series(spark, sf).select("event_id", "user_id", "t", (F.col("event_type") == "error").alias("b"), (F.col("value") > 100).alias("s"))
    return joins.overlap_expand(e, K, O, "t", "b", "s", 1000.0, "excluded", 604800.0).select("event_id", "excluded")


@query(f"with {E}, b as (select user_id, arg_min(t, i) a, arg_max(t, i) z from e group by 1) select user_id, i, round(a + coalesce(i * (z - a) / nullif(n - 1, 0), 0), 1) as t, round(value, 4) as value from e join b using (user_id)")
def resample_uniform(spark, sf):
    d = gaze.resample_uniform(ev_series(spark, sf), K, O, "t", "value")
    return d.select("user_id", "i", F.round("t", 1).alias("t"), F.round("value", 4).alias("value"))


@query()
def zero_phase_lowpass(spark, sf):
    d = gaze.zero_phase_lowpass(ev_series(spark, sf), K, O, "value")
    return d.select("user_id", "event_id", F.round("value", 4).alias("value"))


# geometry

H = "h as (select vec_id, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y, embedding[3]::double * 1000 x2, embedding[4]::double * 1000 y2 from embeddings)"


def _href(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[(F.col("embedding")[k].cast("double") * 1000).alias(c) for k, c in enumerate(["x", "y", "x2", "y2"])])


@query(f"with {H} select vec_id, round(radians(225e6 + x * x + y * y) / sqrt(225e6 + y * y), 4) as per_degree_x, round(radians(225e6 + x * x + y * y) / sqrt(225e6 + x * x), 4) as per_degree_y from h")
def eye_resolution(spark, sf):
    h = _href(spark, sf)
    rx, ry = geometry.resolution(F.col("x"), F.col("y"))
    return h.select("vec_id", F.round(rx, 4).alias("per_degree_x"), F.round(ry, 4).alias("per_degree_y"))


@query("""with h as (select label, vec_id, vec_id / 1000.0::double t, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y from embeddings),
l as (select *, lag(x) over w xp, lead(x) over w xn, lag(t) over w tp, lead(t) over w tn from h window w as (partition by label order by vec_id)), d as (select *, t - tp hs, tn - t hd from l)
select vec_id, round((case when tp is null then (xn - x) / hd when tn is null then (x - xp) / hs else (hs * hs * xn + (hd * hd - hs * hs) * x - hd * hd * xp) / (hs * hd * (hs + hd)) end) / (radians(225e6 + x * x + y * y) / sqrt(225e6 + y * y)), 4) as vx from d""")
def eye_velocity(spark, sf):
    h = _href(spark, sf).withColumn("t", F.col("vec_id") / 1000.0)
    h = series.with_gradient(h, ["label"], "vec_id", "t", {"g": "x"})
    return h.select("vec_id", F.round(F.col("g") / geometry.resolution(F.col("x"), F.col("y"))[0], 4).alias("vx"))


@query(f"with {H} select vec_id, round(degrees(acos((225e6 + x * x2 + y * y2) / sqrt((225e6 + x * x + y * y) * (225e6 + x2 * x2 + y2 * y2)))), 4) as angle from h")
def rotation_angle(spark, sf):
    return _href(spark, sf).select("vec_id", F.round(geometry.rotation_angle(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), 4).alias("angle"))


@query(f"with {H} select vec_id, round((x - 960) / 960, 6) as nx, round((y - 540) / 960, 6) as ny from h")
def norm_px(spark, sf):
    x, y = geometry.px_to_screen(F.col("x"), F.col("y"), 1920, 1080)
    return _href(spark, sf).select("vec_id", F.round(x, 6).alias("nx"), F.round(y, 6).alias("ny"))


@query("""with h as (select label, vec_id, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y from embeddings), m as (select label, greatest(max(abs(x)), max(abs(y)), 1) m from h group by 1)
select vec_id, round(x / m, 6) as nx, round(y / m, 6) as ny from h join m using (label)""")
def norm_max(spark, sf):
    return geometry.max_abs(_href(spark, sf), ["label"], "x", "y").select("vec_id", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@query(f"with {H} select vec_id, round(x / degrees(atan2(960 * 25.4 / 96.0, 600.0 + y)), 6) as nx from h")
def norm_dva(spark, sf):
    return _href(spark, sf).select("vec_id", F.round(geometry.dva_to_screen(F.col("x"), F.lit(600.0) + F.col("y"), 1920, 1080, 96.0), 6).alias("nx"))


# markers and events

EB = """m as (select user_id, event_id, t, event_type from e), s as (select user_id, t, row_number() over (partition by user_id order by case event_type when 'signup' then 0 else 1 end, event_id) k from m where event_type in ('signup', 'purchase')),
x as (select user_id, t, row_number() over (partition by user_id order by event_id) k from m where event_type = 'error'), b as (select coalesce(s.user_id, x.user_id) user_id, coalesce(s.k, x.k) k, s.t as a, x.t as z from s full join x on s.user_id = x.user_id and s.k = x.k)"""


def _bounds(spark, sf) -> DataFrame:
    return ev.boundaries(ev_series(spark, sf), K, O, "event_type", "t", ["Signup", "Purchase"], ["Error"])


@query(f"with {E}, {EB} select user_id, k, round(a, 3) as start_t, round(z, 3) as end_t from b")
def event_boundaries(spark, sf):
    return _bounds(spark, sf).select("user_id", F.col("k").cast("long").alias("k"), F.round("start", 3).alias("start_t"), F.round("end", 3).alias("end_t"))


@query(f"with {E}, {EB} select user_id, greatest(count(a), count(z)) as pairs, case when count(a) <> count(z) then 'unequal' when bool_or(z < a) then 'order' else 'ok' end as status from b group by 1")
def boundary_validation(spark, sf):
    return ev.boundary_status(_bounds(spark, sf), K)


@query(r"""with m as (select distinct recording_id, marker_idx, regexp_replace(marker_text, '^MSG ', '') x from marker), l as (select *, regexp_extract(lower(x), '^!v target_pos target(_\d+)? (\d+), (\d+) \d+ \d+_([\d.]+)', ['a', 'b', 'c', 'd']) r from m where regexp_matches(lower(x), '^!v target_pos target(_\d+)? (\d+), (\d+) \d+ \d+_([\d.]+)'))
select recording_id, marker_idx, coalesce(try_cast(replace(r.a, '_', '') as int), 0) as target, r.b::int as x, r.c::int as y, try_cast(r.d as double) as time_stm from l""")
def marker_positions(spark, sf):
    m = table(spark, sf, "marker").select("recording_id", "marker_idx", "marker_text").distinct()
    # the tracker's own log has the markers in upper case after MSG
    plain = F.regexp_replace(F.lower(F.regexp_replace("marker_text", "^MSG ", "")), "^!v target_pos", "!V TARGET_POS")
    return ev.marker_positions(m.withColumn("plain", plain), "plain").select("recording_id", "marker_idx", "target", "x", "y", "time_stm")


@query("select event_id, case event_id % 4 - 1 when -1 then 'Release' when 0 then 'Move' when 1 then 'Click' end as state from events")
def mouse_state_map(spark, sf):
    return table(spark, sf, "events").select("event_id", ev.mouse_state(F.col("event_id") % 4 - 1).alias("state"))


@query(f"""with {E}, a as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) trial from e),
b as (select *, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id, trial order by event_id rows between unbounded preceding and 1 preceding), 0) past from a where trial > 0), c as (select * from b where past = 0)
select user_id, trial, round(min(t) filter (event_type = 'signup'), 3) as start_t, round(min(t) filter (event_type = 'purchase'), 3) as end_t, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'view') as circles,
  round(max(t) filter (event_type in ('signup', 'view')), 3) as animation_end, round(sum(t - 1.7e9) filter (event_type = 'click'), 2) as click_sum, arg_max(value::int, event_id) filter (event_type = 'error') as n_targets from c group by 1, 2 having count(*) filter (event_type = 'purchase') > 0""")
def trial_segments(spark, sf):
    e, t = ev_series(spark, sf), F.col("event_type")
    d = ev.trials(e, K, O, "event_type", "t", t == "signup", t == "purchase", t == "click", F.when(t == "error", F.rint("value").cast("int")), t == "view")
    return d.select("user_id", "trial", F.round("start_time", 3).alias("start_t"), F.round("end_time", 3).alias("end_t"), F.size("click_times").cast("long").alias("clicks"), "circles", F.round("animation_end", 3).alias("animation_end"),
        F.when(F.size("click_times") > 0, F.round(F.aggregate("click_times", F.lit(0.0), lambda a, x: a + (x - 1.7e9)), 2)).alias("click_sum"), "n_targets")


@query("select event_id, (props->>'$.k')::int as k from events")
def json_decode(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# catalogue


@query(rf"""with f as (select recording_id, file_name, regexp_extract(file_name, '{names.DATA_FILE}', ['s', 'y', 'mo', 'd', 'h', 'mi', 'se', 'rest', 'ext']) r from device_data),
p as (select *, regexp_extract(r.rest, '^({"|".join(names.TASKS)})_?(.*)$', ['task', 'dev']) q from f)
select recording_id, nullif(r.s, '') as subject, r.y || '-' || r.mo || '-' || r.d || ' ' || r.h || ':' || r.mi || ':' || r.se as at, nullif(q.task, '') as task_name, lower(r.ext) as ext,
  case when lower(q.dev) like '%eyelink%' then 'EyeLink' when lower(q.dev) like '%iphone%' then 'IPhone' when lower(q.dev) like '%flir%' then 'FLIR' when lower(q.dev) like '%intel%' then 'RealSense' when lower(q.dev) like '%yeti%' then 'Yeti'
    when lower(q.dev) like '%mbient%' then 'Mbient' when lower(q.dev) like '%mouse%' then 'Mouse' when lower(q.dev) like '%webcam%' then 'Webcam' end as device_name,
  case when lower(q.dev) like '%intel%' then 'RealSense ' || regexp_extract(q.dev, 'Intel_D455_([123])', 1) when lower(q.dev) like '%mbient%' then case regexp_extract(q.dev, '_(BK|LF|RF|LH|RH)_', 1) when 'BK' then 'Back' when 'LF' then 'Left Foot' when 'RF' then 'Right Foot' when 'LH' then 'Left Hand' when 'RH' then 'Right Hand' end else '' end as device_which
from p""")
def file_name_parse(spark, sf):
    d = names.parse_file_names(table(spark, sf, "device_data").select("recording_id", "file_name"), "file_name")
    return d.select("recording_id", "subject", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "task_name", "ext", "device_name", "device_which")


@query("""select recording_id from device_data where regexp_full_match(split_part(session_path, '/', 3), '(\\d+)_(\\d\\d\\d\\d)[_-](\\d\\d)[_-](\\d\\d).*')
  and make_date(split_part(split_part(session_path, '/', 3), '_', 2)::int, split_part(split_part(session_path, '/', 3), '_', 3)::int, split_part(split_part(session_path, '/', 3), '_', 4)::int) between date '2020-01-01' and date '2022-06-30'
  and device in ('Mbient', 'EyeLink') and subject_id::int >= 100100 and subject_id <> '100117' and extension not in ('.bag', '.avi', '.xdf')""".replace("\\\\", "\\"))
def session_filter(spark, sf):
    from .jobs import SliceOptions, slice_files

    o = SliceOptions(start_date="2020-01-01", end_date="2022-06-30", devices=("Mbient", "EyeLink"))
    d = table(spark, sf, "device_data")
    test = d.filter("subject_id = '100117'").select("subject_id").distinct()
    return slice_files(d, o, test).select("recording_id")


@query("""select session_path || '/' || file_name as src, regexp_extract(session_path, '[^/]+$') || '/' || file_name as dest from device_data where device in ('FLIR', 'RealSense') and extension = '.hdf5'
union all select session_path || '/' || replace(file_name, '.hdf5', '.csv'), regexp_extract(session_path, '[^/]+$') || '/' || replace(file_name, '.hdf5', '.csv') from device_data where device = 'Mouse' and task in ('MOT_obs_1', 'DSC_obs')""")
def slice_union(spark, sf):
    from .jobs import SliceOptions, manifest, slice_files

    d = table(spark, sf, "device_data")
    a = slice_files(d, SliceOptions(devices=("FLIR", "RealSense"), hdf5_only=True, include_test_subjects=True))
    csv = d.filter("device = 'Mouse' and task in ('MOT_obs_1', 'DSC_obs')").withColumn("file_name", names.change_extension(F.col("file_name"), ".csv"))
    return manifest(a.unionByName(csv), "").select("src", "dest")


@query("""select recording_id, coalesce(nullif(regexp_extract(data_version, '(\\d+)\\.(\\d+)', 1), '')::int, 0) as major, coalesce(nullif(regexp_extract(data_version, '(\\d+)\\.(\\d+)', 2), '')::int, 0) as minor,
  case when coalesce(nullif(regexp_extract(data_version, '(\\d+)\\.(\\d+)', 1), '')::int, 0) < 1 then (select string_agg(column_name, ',' order by position_no) from sensor_fields f where f.device = d.device) else column_names end as columns_
from device_data d""".replace("\\\\", "\\"))
def version_backfill(spark, sf):
    from ..operators.corrections import backfill

    d = backfill(table(spark, sf, "device_data"), table(spark, sf, "sensor_fields"))
    return d.select("recording_id", F.col("version.major").alias("major"), F.col("version.minor").alias("minor"), F.col("columns_"))


@query("""with o as (select l_orderkey, list(l_linenumber order by l_linenumber) nos from lineitem group by 1), u as (select l_orderkey, unnest(nos) no from o)
select o_orderkey, o_custkey, no, l_suppkey, l_partkey from u join orders on o_orderkey = u.l_orderkey join lineitem l on l.l_orderkey = u.l_orderkey and l.l_linenumber = u.no where o_orderstatus = 'F'""")
def device_query_unnest(spark, sf):
    li = table(spark, sf, "lineitem")
    u = li.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("nos")).select("l_orderkey", F.explode("nos").alias("no"))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    d = u.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(li.select("l_orderkey", F.col("l_linenumber").alias("no"), "l_suppkey", "l_partkey"), ["l_orderkey", "no"])
    return d.select("o_orderkey", "o_custkey", "no", "l_suppkey", "l_partkey")


@query(f"""with {E}, d as (select user_id, t, t - lag(t) over (partition by user_id order by event_id) dt from e), g as (select user_id, count(*) n, 1 / quantile_cont(dt, 0.5) rate, min(t) a, max(t) b from d group by 1)
select user_id, sensor, round(rate * 1e6, 3) as rate, strftime(make_timestamp(((a - 100) * 1e6)::bigint), '%Y-%m-%d %H:%M:%S') as start_at, strftime(make_timestamp(((b - 100) * 1e6)::bigint), '%Y-%m-%d %H:%M:%S') as end_at, '{{"' || user_id || '-' || sensor || '.hdf5"}}' as files
from g, (values ('left'), ('right')) s(sensor) where n >= 2""")
def log_split_rows(spark, sf):
    from .jobs import split_log

    e = ev_series(spark, sf)
    d = split_log(e, K, O, "t", F.array(F.lit("left"), F.lit("right")), -100.0)
    files = names.array_literal(F.array(F.concat(F.col("user_id"), F.lit("-"), F.col("sensor"), F.lit(".hdf5"))))
    return d.select("user_id", "sensor", F.round(F.col("rate") * 1e6, 3).alias("rate"), "start_at", "end_at", files.alias("files"))


@query("select recording_id, sample_idx, 'R' as eye, R_GazeX as GazeX, R_GazeY as GazeY, R_PupilSize as PupilSize from eyelink union all select recording_id, sample_idx, 'L', L_GazeX, L_GazeY, L_PupilSize from eyelink")
def eye_unpivot(spark, sf):
    from ..operators.devices import split_eyes

    return split_eyes(table(spark, sf, "eyelink"), ["recording_id", "sample_idx"], ["GazeX", "GazeY", "PupilSize"])


def _decoder(name: str, sql: str) -> None:
    def run(spark, sf):
        from ..operators.devices import decode

        return decode(spark, sf, name)

    run.__name__ = f"decode_{name}"
    query(sql)(run)


_decoder("eyelink", "select recording_id, sample_idx, R_GazeX, R_GazeY, R_PupilSize, L_GazeX, L_GazeY, L_PupilSize, Target_PositionX, Target_PositionY, Target_Distance / 10 as Target_Distance, ResolutionX, ResolutionY, Time_EDF / 1000 as Time_EDF, Time_NUC, Time_LSL from eyelink")
_decoder("flir", "select recording_id, sample_idx, FrameNum, Time_FLIR / 1e9 as Time_FLIR, Time_LSL from flir")
_decoder("realsense", "select recording_id, sample_idx, FrameNum, FrameNum_RealSense, Time_RealSense / 1000 as Time_RealSense, Time_ACQ, Time_LSL from realsense")
_decoder("mbient", "select recording_id, sample_idx, Time_Mbient / 1000 as Time_Mbient, nullif(AccelX, 'nan'::double) as AccelX, AccelY, AccelZ, GyroX, GyroY, GyroZ, Time_LSL from mbient")


@query("""with m as (select distinct recording_id, FrameNum_Bag, R, G, B from mean_rgb) select recording_id, FrameNum_Bag, round((R + G + B) / 3, 4) as brightness from m""")
def frame_means(spark, sf):
    m = table(spark, sf, "mean_rgb").select("recording_id", "FrameNum_Bag", "R", "G", "B").distinct()
    return m.select("recording_id", "FrameNum_Bag", F.round(series.mono(F.array("R", "G", "B")), 4).alias("brightness"))


@query("select m.recording_id, m.FrameNum_Bag, r.FrameNum, r.FrameNum_RealSense from (select distinct recording_id, FrameNum_Bag, FrameNum from mean_rgb where FrameNum is not null) m join (select distinct recording_id, FrameNum, FrameNum_RealSense from realsense) r on r.recording_id = m.recording_id and r.FrameNum = m.FrameNum")
def frame_join(spark, sf):
    m = table(spark, sf, "mean_rgb").filter("FrameNum is not null").select("recording_id", "FrameNum_Bag", "FrameNum").distinct()
    return m.join(table(spark, sf, "realsense").select("recording_id", "FrameNum", "FrameNum_RealSense").distinct(), ["recording_id", "FrameNum"]).select("recording_id", "FrameNum_Bag", "FrameNum", "FrameNum_RealSense")


@query("""with m as (select distinct recording_id, marker_idx, marker_text, Time_LSL from marker where Time_LSL is not null and not isnan(Time_LSL)),
t as (select recording_id, Time_LSL a, row_number() over (partition by recording_id order by marker_idx) k from m where lower(marker_text) like 'task_start%'), u as (select recording_id, Time_LSL b, row_number() over (partition by recording_id order by marker_idx) k from m where lower(marker_text) like 'task_end%'),
p as (select t.recording_id, a, b from t join u on t.recording_id = u.recording_id and t.k = u.k where a <= b), e as (select distinct recording_id, sample_idx, Time_LSL from eyelink where Time_LSL is not null and not isnan(Time_LSL))
select recording_id, sample_idx, exists (select 1 from p where p.recording_id = e.recording_id and e.Time_LSL between a and b) as in_task from e""")
def task_flags(spark, sf):
    from ..operators.devices import flagged

    m = nan_to_null(table(spark, sf, "marker").select("recording_id", "marker_idx", "marker_text", "Time_LSL")).distinct().filter("Time_LSL is not null")
    e = nan_to_null(table(spark, sf, "eyelink").select("recording_id", "sample_idx", "Time_LSL")).distinct().filter("Time_LSL is not null")
    d = flagged(e, m.withColumnRenamed("Time_LSL", "mt"), ["recording_id"], "marker_idx", "marker_text", "mt", "Time_LSL", *ev.PREFIXES["task"], "in_task")
    return d.select("recording_id", "sample_idx", "in_task")


@query("""with e as (select distinct on (recording_id, sample_idx) recording_id, sample_idx, Time_EDF, Time_LSL, R_GazeX, ResolutionX from eyelink where Time_LSL is not null and not isnan(Time_LSL)),
l as (select *, lag(R_GazeX) over w xp, lead(R_GazeX) over w xn, lag(Time_LSL) over w tp, lead(Time_LSL) over w tn from e window w as (partition by recording_id order by sample_idx)), d as (select *, Time_LSL - tp hs, tn - Time_LSL hd from l)
select recording_id, sample_idx, round(case when tp is null then (xn - R_GazeX) / nullif(hd, 0) when tn is null then (R_GazeX - xp) / nullif(hs, 0)
  else (hs * hs * xn + (hd * hd - hs * hs) * R_GazeX - hd * hd * xp) / nullif(hs * hd * (hs + hd), 0) end / nullif(ResolutionX, 0), 1) as velocity from d""")
def gaze_velocity(spark, sf):
    e = table(spark, sf, "eyelink").select("recording_id", "sample_idx", "Time_LSL", "R_GazeX", "ResolutionX")
    e = nan_to_null(e).filter("Time_LSL is not null").dropDuplicates(["recording_id", "sample_idx"])
    e = series.with_gradient(e, ["recording_id"], "sample_idx", "Time_LSL", {"g": "R_GazeX"})
    return e.select("recording_id", "sample_idx", F.round(F.try_divide(F.col("g"), F.col("ResolutionX")), 1).alias("velocity"))


def _records_decoder(device: str) -> None:
    def run(spark, sf):
        from ..operators.devices import decode_records

        return decode_records(table(spark, sf, "device_data"), table(spark, sf, "raw_records"), table(spark, sf, "sensor_fields"), device)

    run.__name__ = f"decode_{device.lower()}"
    query()(run)  # the notations of the payloads are beyond SQL; tested on fixtures


for _d in ("Mouse", "IPhone", "Webcam"):
    _records_decoder(_d)


@query("select recording_id, FrameNum_Bag, R as MeanColor_R, G as MeanColor_G, B as MeanColor_B, Time_Bag from (select distinct recording_id, FrameNum_Bag, R, G, B, Time_Bag from mean_rgb)")
def decode_mean_rgb(spark, sf):
    from ..operators.devices import mean_colours

    m = table(spark, sf, "mean_rgb").select("recording_id", "FrameNum_Bag", "R", "G", "B", "Time_Bag").distinct()
    return mean_colours(m, ["recording_id"], "FrameNum_Bag", "Time_Bag")


@query(r"""with f as (select recording_id, regexp_replace(file_name, '_(DSC_obs|MOT_obs_1).*$', '_' || left(task, 3) || '_results.csv') as n from device_data),
p as (select recording_id, n, regexp_extract(n, '^(\d+)_(\d\d\d\d)-(\d\d)-(\d\d)_(\d\d)h-(\d\d)m-(\d\d)s_(DSC|MOT)_(results|outcomes)(?:_v2)?\.csv$', ['s', 'y', 'mo', 'd', 'h', 'mi', 'se', 'task', 'kind']) r from f)
select recording_id, nullif(r.s, '') as subject, case when r.s <> '' then r.y || '-' || r.mo || '-' || r.d || ' ' || r.h || ':' || r.mi || ':' || r.se end as at, case r.task when 'DSC' then 'DSC_obs' when 'MOT' then 'MOT_obs_1' end as task_name, nullif(r.kind, '') as result from p""".replace("\\\\", "\\"))
def csv_file_parse(spark, sf):
    d = table(spark, sf, "device_data").select("recording_id", F.regexp_replace("file_name", F.lit("_(DSC_obs|MOT_obs_1).*$"), F.concat(F.lit("_"), F.substring("task", 1, 3), F.lit("_results.csv"))).alias("n"))
    d = names.parse_csv_names(d, "n")
    return d.select("recording_id", "subject", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "task_name", "result")


@query(r"""select recording_id, regexp_extract(s, '^(\d+)_', 1) as subject, regexp_extract(s, '^(\d+)_', 1) || '_' || replace(substr(s, strpos(s, '_') + 1, 10), '-', '_') as session from (select recording_id, split_part(session_path, '/', 3) s from device_data) where regexp_matches(s, '^\d+_\d\d\d\d[_-]\d\d[_-]\d\d')""".replace("\\\\", "\\"))
def session_names(spark, sf):
    s = F.element_at(F.split("session_path", "/"), 3)
    d = table(spark, sf, "device_data").select("recording_id", s.alias("s")).filter(F.col("s").rlike(names.SESSION))
    return d.select("recording_id", names.session_subject(F.col("s")).alias("subject"), names.make_session_id(names.session_subject(F.col("s")), names.session_date(F.col("s"))).alias("session"))


@query(r"""with m as (select distinct recording_id, marker_idx, coalesce(Time_LSL, Time_EDF / 1000) as t, regexp_replace(marker_text, '^MSG ', '') x from marker),
a as (select *, lower(x) like 'trial_start%' or lower(x) like 'practicetrial_start%' s, lower(x) like 'trial_end%' or lower(x) like 'practicetrial_end%' e from m),
b as (select *, sum(s::int) over (partition by recording_id order by marker_idx) trial from a), c as (select *, coalesce(sum(e::int) over (partition by recording_id, trial order by marker_idx rows between unbounded preceding and 1 preceding), 0) past from b where trial > 0),
l as (select *, regexp_extract(lower(x), '^!v target_pos target(_\d+)? (\d+), (\d+) \d+ \d+_([\d.]+)', ['a', 'b', 'c', 'd']) r from c where past = 0 and regexp_matches(lower(x), '^!v target_pos target(_\d+)? (\d+), (\d+) \d+ \d+_([\d.]+)'))
select recording_id, trial, coalesce(try_cast(replace(r.a, '_', '') as int), 0) as target, marker_idx, t, r.b::int as x, r.c::int as y, try_cast(r.d as double) as time_stm from l""")
def circle_paths(spark, sf):
    m = table(spark, sf, "marker").select("recording_id", "marker_idx", "marker_text", F.coalesce("Time_LSL", F.col("Time_EDF") / 1000).alias("t")).distinct()
    low = F.lower(F.regexp_replace("marker_text", "^MSG ", ""))
    m = m.withColumn("plain", F.regexp_replace(low, "^!v target_pos", "!V TARGET_POS"))
    any_of = lambda ps: low.startswith(ps[0].lower()) | low.startswith(ps[1].lower())
    starts, ends = ev.PREFIXES["trial"]
    return ev.circle_paths(m, ["recording_id"], "marker_idx", "plain", "t", any_of(starts), any_of(ends)).drop("marker_text", "plain")
