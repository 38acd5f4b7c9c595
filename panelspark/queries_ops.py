"""Registered queries: sources, expressions, profiling, splitting, significance tests."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from panelspark import oracle_sql as O
from panelspark.functions.expr import full_name
from panelspark.operators import profile, selection
from panelspark.operators import split as X
from panelspark.operators.joins import keep_members, lookup
from panelspark.queries_core import FEATURE_TABLE_SQL
from panelspark.registry import query
from panelspark.session import ensure_checkpoint_dir
from panelspark.sources import fixtures, ingest
from panelspark.sources.tables import TABLES, read_table, read_tables, scan_view

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scan_view", """
select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty
from lineitem group by l_returnflag, l_linestatus""")
def q_scan_view(spark, root):
    scan_view(spark, root, "lineitem", view="lineitem_scan")
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty "
                     "from lineitem_scan group by l_returnflag, l_linestatus")


LINEITEM_SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                   "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                   "l_linestatus string, l_shipdate timestamp_ntz")


@query("csv_scan_view", """
select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty,
       cast(sum(l_linenumber) as bigint) as sum_line
from lineitem group by l_returnflag, l_linestatus""")
def q_csv_scan_view(spark, root):
    """S1 on header CSV: landed by the sink (S3) in the shared folder, scanned back with an
    explicit schema (no inference pass) and queried through a temp view."""
    from panelspark.sources.tables import write_tables
    base = os.path.join(ensure_checkpoint_dir(spark), "csv_scan_view", uuid.uuid4().hex)
    write_tables({"lineitem": read_table(spark, root, "lineitem")}, base, fmt="csv")
    scan_view(spark, base, "lineitem", fmt="csv", schema=LINEITEM_SCHEMA, view="lineitem_csv")
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty, "
                     "sum(l_linenumber) as sum_line from lineitem_csv group by l_returnflag, l_linestatus")


@query("scan_folder_counts", "\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES))
def q_scan_folder_counts(spark, root):
    tabs = read_tables(spark, root)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in tabs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sink_roundtrip", """
select o_orderstatus, count(*) as n, min(o_totalprice) as min_price, max(o_totalprice) as max_price,
       cast(sum(o_orderkey) as bigint) as sum_key
from orders group by o_orderstatus""")
def q_sink_roundtrip(spark, root):
    """S3: write to the shared checkpoint folder (partitioned Parquet), read back."""
    from panelspark.sources.tables import write_tables
    base = os.path.join(ensure_checkpoint_dir(spark), "sink_roundtrip", uuid.uuid4().hex)
    write_tables({"orders": read_table(spark, root, "orders")}, base, partition_by={"orders": ["o_orderstatus"]})
    back = read_table(spark, base, "orders")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_price"),
                                             F.max("o_totalprice").alias("max_price"), F.sum("o_orderkey").alias("sum_key"))


@query("json_flatten", """
select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events""")
def q_json_flatten(spark, root):
    e = read_table(spark, root, "events")
    arr = F.concat(F.lit("["), F.col("props"), F.lit("]"))
    return ingest.flatten_array(e, arr, ["event_id", "user_id", "event_type"], "array<struct<k:int>>")


@query("union_by_name_seasons", """
select o_orderkey, o_orderstatus, o_totalprice,
       case when year(o_orderdate) = (select max(year(o_orderdate)) from orders) then o_orderpriority end as o_orderpriority,
       cast(year(o_orderdate) as integer) as season_start_year
from orders""")
def q_union_seasons(spark, root):
    """Current period has all columns; earlier periods lack one and carry a stray index."""
    import datetime as dt
    o = read_table(spark, root, "orders")
    years = sorted(r[0] for r in o.select(F.year("o_orderdate")).distinct().collect())  # one value per period
    cur = years[-1]
    frames = {}
    for y in years:
        # a range on the raw column (not year(...)) is pushed into each period's Parquet scan
        lo, hi = (F.lit(dt.datetime(v, 1, 1)).cast("timestamp_ntz") for v in (y, y + 1))
        f = o.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
        if y == cur:
            frames[y] = f.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        else:
            frames[y] = f.select(F.col("o_orderkey").alias("Unnamed: 0"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return ingest.union_seasons(frames)


@query("upsert_keep_last", """
select o_orderkey, o_custkey, o_totalprice, o_orderstatus, line from (
  select *, row_number() over (partition by o_orderkey order by batch desc, line desc nulls last, o_totalprice desc) as rn
  from (select o_orderkey, o_custkey, o_totalprice, o_orderstatus, cast(null as integer) as line, 0 as batch
        from orders where o_orderstatus = 'F'
        union all
        select l_orderkey, cast(null as bigint), l_extendedprice, l_linestatus, l_linenumber, 1 from lineitem) u) x
where rn = 1""")
def q_upsert(spark, root):
    prev = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    new = read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_linestatus").alias("o_orderstatus"), F.col("l_linenumber").alias("line"))
    return ingest.upsert_keep_last(prev, new, ["o_orderkey"], order=["line", "o_totalprice"],
                                   prev_filter=F.col("o_orderstatus") == "F")


@query("season_bounds", """
with c as (select min(cast(strftime(ts, '%y') as integer)) as cur from events where ts is not null)
select cast(s as integer) as season, s = cur as is_current
from (select unnest(generate_series(cur - 4, cur)) as s, cur from c) x""")
def q_season_bounds(spark, root):
    return ingest.season_bounds(read_table(spark, root, "events"), "ts", 4)


CATALOG_SQL = "with ft as (" + FEATURE_TABLE_SQL + """),
c as (select count(columns(*)) from ft),
u as (unpivot c on columns(*) into name col value n_non_null)
select case when col = 'target' then 'target' when col = 'player_position' then 'categorical' else 'numeric' end as type, col, n_non_null
from u where col not in ('kickoff_time', 'player_id', 'playername', 'next_kickoff_time', 'data', 'value', 'selected')"""


@query("column_catalog", CATALOG_SQL)
def q_column_catalog(spark, root):
    """S9 (+A7): (type, col) of the feature table, non-null counts from one pass."""
    from panelspark.plans.panel import feature_columns, feature_table_from
    ft = feature_table_from(spark, root)
    numeric, categorical = feature_columns(ft)
    roles = [("target", "target")] + [("numeric", c) for c in numeric] + [("categorical", c) for c in categorical]
    prof = profile.null_profile(ft, [c for _, c in roles])
    cat = spark.createDataFrame(roles, "type string, col string")
    return cat.join(prof.withColumnRenamed("column", "col"), "col").select("type", "col", "n_non_null")


@query("membership_filter", """
select o_orderkey, o_custkey, o_orderpriority from orders
where o_orderpriority in ('1-URGENT', '2-HIGH')
  and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def q_membership(spark, root):
    o = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_table(spark, root, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    o = keep_members(o, "o_orderpriority", values=["1-URGENT", "2-HIGH"])
    return keep_members(o, "o_custkey", table=c, table_column="c_custkey")


@query("full_name_concat", """
select c.c_custkey, c.c_name || ' ' || s.s_name as full_name
from customer c left join supplier s on c.c_custkey = s.s_suppkey""")
def q_full_name(spark, root):
    c = read_table(spark, root, "customer").select("c_custkey", "c_name")
    s = read_table(spark, root, "supplier").select("s_suppkey", "s_name")
    j = c.join(s, c.c_custkey == s.s_suppkey, "left")
    return j.select("c_custkey", full_name("c_name", "s_name").alias("full_name"))


@query("impute_constant", """
select c.c_custkey, coalesce(s.s_name, 'missing_data') as s_name
from customer c left join supplier s on c.c_custkey = s.s_suppkey""")
def q_impute_constant(spark, root):
    from panelspark.operators.features import impute_constant
    c = read_table(spark, root, "customer").select("c_custkey")
    s = read_table(spark, root, "supplier").select("s_suppkey", "s_name")
    j = c.join(s, c.c_custkey == s.s_suppkey, "left").select("c_custkey", "s_name")
    return impute_constant(j, ["s_name"])


@query("lookup_two_roles", O.with_(O.GAMES) + """
select g.game_id, g.home, g.away, h.r_name as home_name, a.r_name as away_name
from games g left join region h on g.home = h.r_regionkey left join region a on g.away = a.r_regionkey""")
def q_lookup(spark, root):
    g = fixtures.games(spark, root).select("game_id", "home", "away")
    r = read_table(spark, root, "region")
    return lookup(g, r, "r_regionkey", "r_name", {"home": "home_name", "away": "away_name"}, max_dim_rows=10_000)


@query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_quantity from lineitem")
def q_distinct_rows(spark, root):
    return read_table(spark, root, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").distinct()


@query("category_counts", """
select 'l_returnflag' as "column", l_returnflag as value, count(*) as n from lineitem group by l_returnflag
union all
select 'l_linestatus', l_linestatus, count(*) from lineitem group by l_linestatus""")
def q_category_counts(spark, root):
    return profile.category_counts(read_table(spark, root, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("target_by_category", """
select "column", value, round(avg(y), 6) as mean, count(*) as n from (
  select 'l_returnflag' as "column", l_returnflag as value, l_extendedprice as y from lineitem
  union all select 'l_linestatus', l_linestatus, l_extendedprice from lineitem
  union all select 'l_discount', cast(l_discount as varchar), l_extendedprice from lineitem) u
group by "column", value""")
def q_target_by_category(spark, root):
    t = profile.target_by_category(read_table(spark, root, "lineitem"),
                                   ["l_returnflag", "l_linestatus", "l_discount"], "l_extendedprice")
    return t.select("column", "value", F.round("mean", 6).alias("mean"), "n")


BINS_SQL = """q as (select quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from {t} where {c} is not null),
e0 as (select list_sort(list_distinct(q)) as e, q[4] as mid from q),
e1 as (select case when len(e) = 2 and e[1] = mid then [e[1], e[1] + 0.1, e[2]]
                   when len(e) = 2 and e[2] = mid then [e[1], e[2] - 0.1, e[2]] else e end as e from e0),
edges as (select list_transform(e, lambda x, i: case when i = 1 then x - 0.1 when i = len(e) then x + 0.1 else x end) as edges
          from e1)"""


@query("percentile_bins", "with " + BINS_SQL.format(c="l_quantity", t="lineitem") + """
select cast(b as integer) as bin, round(edges[b], 6) as lower, round(edges[b + 1], 6) as upper, count(*) as n from (
  select 1 + len(list_filter(edges[2:len(edges) - 1], lambda v: l_quantity > v)) as b, edges
  from lineitem, edges where l_quantity is not null) x
group by b, edges""")
def q_percentile_bins(spark, root):
    li = read_table(spark, root, "lineitem").select("l_quantity")
    edges = profile.percentile_edges(li, "l_quantity")
    b = profile.assign_bins(li, "l_quantity", edges).filter(F.col("bin").isNotNull())
    e = edges.select("edges").scalar()
    return (b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
             .select("bin", F.round(e[F.col("bin") - 1], 6).alias("lower"), F.round(e[F.col("bin")], 6).alias("upper"), "n"))


@query("target_by_bin", "with " + BINS_SQL.format(c="l_quantity", t="lineitem") + """
select 'l_quantity' as "column", cast(b as integer) as bin, round(edges[b], 6) as lower, round(edges[b + 1], 6) as upper,
       round(avg(l_extendedprice), 6) as mean, count(*) as n from (
  select 1 + len(list_filter(edges[2:len(edges) - 1], lambda v: l_quantity > v)) as b, edges, l_extendedprice
  from lineitem, edges where l_quantity is not null) x
group by b, edges""")
def q_target_by_bin(spark, root):
    t = profile.target_by_bin(read_table(spark, root, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select("column", "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
                    F.round("mean", 6).alias("mean"), "n")


APPEAR_COLS = ["season", "entity_id", "event_type", "minutes", "points", "maybe"]


@query("null_profile", O.with_(O.APPEARANCES) + "\nunion all\n".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as n_null, count({c}) as n_non_null from appearances"
    for c in APPEAR_COLS))
def q_null_profile(spark, root):
    return profile.null_profile(fixtures.appearances(spark, root), APPEAR_COLS)


@query("duplicate_count", """
select cast(sum(n - 1) as bigint) as n_duplicated, count(*) as n_distinct_rows from (
  select count(*) as n from lineitem group by l_returnflag, l_linestatus, l_quantity) x""")
def q_duplicate_count(spark, root):
    return profile.duplicate_count(read_table(spark, root, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query("distinct_profile", O.with_(O.APPEARANCES) + "\nunion all\n".join(
    f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from appearances" for c in APPEAR_COLS))
def q_distinct_profile(spark, root):
    return profile.distinct_profile(fixtures.appearances(spark, root), APPEAR_COLS)


@query("describe_numeric", "\nunion all\n".join(f"""
select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
       min({c}) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
       round(quantile_cont({c}, 0.75), 6) as p75, max({c}) as max from lineitem""" for c in LINE_NUM))
def q_describe(spark, root):
    return profile.describe_numeric(read_table(spark, root, "lineitem"), LINE_NUM)


@query("corr_matrix", "\nunion all\n".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem"
    for a in LINE_NUM for b in LINE_NUM))
def q_corr_matrix(spark, root):
    return profile.corr_matrix(read_table(spark, root, "lineitem"), LINE_NUM)


CORR_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "p_retailprice", "p_size"]


@query("corr_topk", """
select feature, corr from (""" + "\nunion all\n".join(
    f"select '{c}' as feature, round(corr({c}, l_extendedprice), 6) as corr from lineitem join part on l_partkey = p_partkey"
    for c in CORR_FEATURES) + """) x
order by corr desc nulls last, feature limit 20""")
def q_corr_topk(spark, root):
    li = read_table(spark, root, "lineitem")
    p = read_table(spark, root, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return profile.corr_topk(j, CORR_FEATURES, "l_extendedprice", 20)


@query("histogram_density", """
with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_extendedprice is not null),
w as (select lo, case when hi > lo then (hi - lo) / 30 else 1.0 end as width from b),
x as (select cast(l_discount = 0 as varchar) as grp,
             least(cast(floor((l_extendedprice - lo) / width) as integer), 29) as bin, lo, width
      from lineitem, w where l_extendedprice is not null),
c as (select grp, bin, lo, width, count(*) as n from x group by grp, bin, lo, width),
t as (select grp, count(*) as nn from x group by grp)
select c.grp as "group", bin, round(lo + bin * width, 9) as lower, round(lo + (bin + 1) * width, 9) as upper, n,
       round(n / (nn * width), 9) as density
from c join t on c.grp = t.grp""")
def q_histogram(spark, root):
    li = read_table(spark, root, "lineitem")
    return profile.histogram_density(li, "l_extendedprice", 30, group=F.col("l_discount") == 0)


@query("zero_share", O.with_(*O.FIX) + """
select avg(case when total_points = 0 then 1.0 else 0.0 end) as zero_share, count(*) as n,
       cast(sum(cast(was_home as integer)) as bigint) as flag_sum from appearance_log""")
def q_zero_share(spark, root):
    log = fixtures.appearance_log(spark, root)
    return profile.zero_share(log, "total_points", F.col("was_home").cast("int"))


@query("sample_rows", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
where cast(('0x' || substr(md5(concat_ws('|', '44', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
  cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 < 3000""")
def q_sample_rows(spark, root):
    """30 % of the rows by key hash."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return X.sample_rows(read_table(spark, root, "lineitem"), 0.3, key, seed=42).select(*key, "l_quantity")


SPLIT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("hash_split", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when b < 6000 then 'train' when b < 8000 then 'test' else 'val' end as split from (
  select *, cast(('0x' || substr(md5(concat_ws('|', '42', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
         cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 as b
  from lineitem) x""")
def q_hash_split(spark, root):
    li = read_table(spark, root, "lineitem")
    return li.select(*SPLIT_KEY, X.split_column(SPLIT_KEY, 0.6, True, seed=42).alias("split"))


@query("anova_f", "with " + BINS_SQL.format(c="l_quantity", t="lineitem") + """,
g as (
  select 'l_returnflag' as feature, l_returnflag as grp, l_extendedprice as y from lineitem
  union all select 'l_linestatus', l_linestatus, l_extendedprice from lineitem
  union all select 'l_quantity', cast(1 + len(list_filter(edges[2:len(edges) - 1], lambda v: l_quantity > v)) as varchar),
                   l_extendedprice from lineitem, edges where l_quantity is not null),
s as (select feature, grp, count(*) as n, avg(y) as m, var_pop(y) as v from g where grp is not null and y is not null
      group by feature, grp),
t as (select feature, sum(n) as nn, sum(n * m) as tt from s group by feature),
a as (select s.feature, count(*) as k, max(t.nn) as nn, sum(s.n * pow(s.m - t.tt / t.nn, 2)) as ssb, sum(s.n * s.v) as ssw
      from s join t on s.feature = t.feature group by s.feature)
select feature, 'anova' as test,
       round((ssb / (k - 1)) / (ssw / (nn - k)), 4) as f, cast(k - 1 as double) as df1,
       cast(nn - k as double) as df2, cast(nn as bigint) as n from a""")
def q_anova(spark, root):
    li = read_table(spark, root, "lineitem")
    t = selection.anova_categorical(li, ["l_returnflag", "l_linestatus"], "l_extendedprice").unionByName(
        selection.anova_binned(li, ["l_quantity"], "l_extendedprice"))
    return t.select("feature", "test", F.round("f", 4).alias("f"), "df1", "df2", "n")


@query("regression_f", O.with_(*O.FIX) + """,
x as (select cast(pi.element_type as double) as x, cast(pd.total_points as double) as y
      from appearance_log pd left join entity_info pi on pd.element = pi.id and pd.season = pi.season),
c as (select corr(x, y) as r, count(*) as n from x where x is not null and y is not null)
select 'element_type' as feature, 'regression' as test, round(r * r * (n - 2) / (1 - r * r), 4) as f,
       cast(1 as double) as df1, cast(n - 2 as double) as df2, n from c""")
def q_regression_f(spark, root):
    log = fixtures.appearance_log(spark, root).alias("pd")
    info = fixtures.entity_info(spark, root).alias("pi")
    j = log.join(info, (F.col("pd.element") == F.col("pi.id")) & (F.col("pd.season") == F.col("pi.season")), "left")
    d = j.select("pi.element_type", "pd.total_points")
    t = selection.regression_f(d, ["element_type"], "total_points")
    return t.select("feature", "test", F.round("f", 4).alias("f"), "df1", "df2", "n")


# F9-F11 on a target that depends on the quantity: the tests of the kept features, against SQL. F above 100 stands for p < 1e-9
# there: the other features' F values are near 1.
_SELECT_SQL = """with d as (select l_quantity, l_tax, cast(l_quantity > 25 as integer) as bulk,
    case when l_quantity < 17 then 'low' when l_quantity < 34 then 'mid' else 'high' end as band, l_returnflag,
    l_extendedprice + 2000 * l_quantity as y from lineitem), """ + BINS_SQL.format(c="l_quantity", t="d") + ", " + BINS_SQL.format(
    c="l_tax", t="d").replace("q as (", "tq as (", 1).replace("from q)", "from tq)").replace("e0 as", "te0 as").replace("from e0)", "from te0)").replace(
    "e1 as", "te1 as").replace("edges as (", "tedges as (").replace("from e1)", "from te1)") + """,
g as (
  select 'band' as feature, band as grp, y from d
  union all select 'l_returnflag', l_returnflag, y from d
  union all select 'l_quantity', cast(1 + len(list_filter(edges.edges[2:len(edges.edges) - 1], lambda v: l_quantity > v)) as varchar), y from d, edges where l_quantity is not null
  union all select 'l_tax', cast(1 + len(list_filter(tedges.edges[2:len(tedges.edges) - 1], lambda v: l_tax > v)) as varchar), y from d, tedges where l_tax is not null),
s as (select feature, grp, count(*) as n, avg(y) as m, var_pop(y) as v from g where grp is not null and y is not null group by feature, grp),
t as (select feature, sum(n) as nn, sum(n * m) as tt from s group by feature),
a as (select s.feature, count(*) as k, max(t.nn) as nn, sum(s.n * pow(s.m - t.tt / t.nn, 2)) as ssb, sum(s.n * s.v) as ssw
      from s join t on s.feature = t.feature group by s.feature),
c as (select corr(bulk, y) as r, count(*) as n from d where bulk is not null and y is not null),
f as (select feature, 'anova' as test, (ssb / (k - 1)) / (ssw / (nn - k)) as f, cast(k - 1 as double) as df1, cast(nn - k as double) as df2, cast(nn as bigint) as n from a
  union all select 'bulk', 'regression', r * r * (n - 2) / (1 - r * r), 1.0, cast(n - 2 as double), n from c)
select feature, test, round(f, 3) as f, cast(df1 as double) as df1, df2, n from f where f > 100"""


@query("select_features", _SELECT_SQL)
def q_select_features(spark, root):
    """Numeric features by bins or regression, categories by value; the significant ones stay."""
    d = read_table(spark, root, "lineitem").select(
        "l_quantity", "l_tax", (F.col("l_quantity") > 25).cast("int").alias("bulk"), "l_returnflag",
        F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid").otherwise("high").alias("band"),
        (F.col("l_extendedprice") + 2000 * F.col("l_quantity")).alias("y"))
    sig = selection.significance(d, ["l_quantity", "l_tax", "bulk"], ["band", "l_returnflag"], "y")
    return selection.select_features(sig, 1e-9).select("feature", "test", F.round("f", 3).alias("f"), "df1", "df2", "n")
