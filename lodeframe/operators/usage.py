"""Usage statistics, cost, alerts and complexity history over ``events``."""

_LOG = "(select event_id, ts, user_id, event_type as tool, event_type <> 'error' as success, value as ms, 0.01 + value * 0.00001 as cost from events) l"

QUERIES = {
    # Global statistics: counts, conditional sums, success rate.
    "d01_usage_stats": f"select count(*) as calls, cast(sum(case when success then 1 else 0 end) as bigint) as ok, cast(sum(case when success then 0 else 1 end) as bigint) as failed, round(sum(cost), 4) as cost, round(avg(ms), 4) as avg_ms, round(100.0 * sum(case when success then 1 else 0 end) / count(*), 4) as success_rate from {_LOG}",
    "d02_calls_by_tool": f"select tool, count(*) as calls from {_LOG} group by tool",
    "d03_calls_by_operation": f"select tool, success, count(*) as calls from {_LOG} group by tool, success",
    "d04_cost_by_tool": f"select tool, round(coalesce(sum(cost), 0), 4) as cost from {_LOG} group by tool",
    # Thresholds on daily calls and cost and on hourly failures, one row for each alert.
    "d05_threshold_alerts": f"""with d as (select date_trunc('day', ts) as t, count(*) as calls, sum(cost) as cost from {_LOG} group by 1),
      h as (select date_trunc('hour', ts) as t, sum(case when success then 0 else 1 end) as bad, count(*) as n from {_LOG} group by 1)
      select 'daily_calls' as kind, t, cast(calls as double) as v, case when calls >= 340 then 'critical' else 'warning' end as level from d where calls >= 330
      union all select 'daily_cost', t, round(cost, 4), case when cost >= 5 then 'critical' else 'warning' end from d where cost >= 1
      union all select 'hourly_failures', t, cast(bad as double), case when bad >= 50 then 'critical' else 'warning' end from h where bad >= 5
      union all select 'failure_rate', t, round(1.0 * bad / n, 4), case when 1.0 * bad / n >= 0.25 then 'critical' else 'warning' end from h where 1.0 * bad / n >= 0.1""",
    # Cost by operation: a dimension of prices, joined by broadcast, as it is written in the query.
    "d06_operation_cost": """with p as (select 'click' as op, 0.001 as base, 0.0001 as per_file, 0.00001 as per_match union all select 'purchase', 0.01, 0.001, 0.0 union all select 'unknown', 0.01, 0.0, 0.0)
      select e.event_id, round(cast(coalesce(p.base, u.base) as double) + cast(coalesce(p.per_file, u.per_file) as double) * (e.user_id % 10) + cast(coalesce(p.per_match, u.per_match) as double) * floor(e.value), 6) as cost
      from events e left join p on p.op = e.event_type cross join (select * from p where op = 'unknown') u""",
    "a19_recent_logs": f"select event_id, tool, ts from {_LOG} where tool = 'error' and not success order by ts desc, event_id limit 50",
    "f09_recent_usage": f"select event_id, ts, ms from {_LOG} order by ts desc, event_id limit 100",
    "i19_days_window": f"select tool, count(*) as calls from {_LOG} where ts >= (select max(ts) from events) - interval '7' day group by tool",
    "d26_timing_stats": "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as lo, max(value) as hi, count(*) as n from events group by event_type",
    "d08_counts_by_type_and_severity": "select case when grouping(event_type) = 0 then event_type end as kind, case when grouping(sev) = 0 then sev end as severity, count(*) as n from (select event_type, case when value > 75 then 'high' when value > 50 then 'medium' else 'low' end as sev from events) t group by grouping sets ((event_type), (sev))",
    "d13_most_common_severity": "select user_id, sev from (select user_id, sev, row_number() over (partition by user_id order by count(*) desc, sev) as r from (select user_id, case when value > 75 then 'high' when value > 50 then 'medium' else 'low' end as sev from events) t group by user_id, sev) u where r = 1",
    "d14_severity_triple": "select count_if(value > 75) as errors, count_if(value > 50 and value <= 75) as warnings, count_if(value <= 50) as infos from events",
    "d11_by_fixed_severity": "select s.sev, count(e.event_id) as n from (select 'error' as sev union all select 'warning' union all select 'info') s left join (select event_id, case when event_type = 'error' then 'error' when event_type = 'click' then 'info' else 'other' end as sev from events) e on s.sev = e.sev group by s.sev",
    "f01_top_rules": "select event_type as rule, count(*) as n from events group by event_type order by n desc, rule limit 10",
    "f02_top_files": "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10",
    "f11_cap_per_file": "select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by event_id) as r from events) t where r <= 50",
    "e14_previous_tag": "select event_id, user_id, lead(event_id) over (partition by user_id order by ts desc, event_id) as previous_id from events",
    "e15_first_wins": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as r from events) t where r = 1",
    "i20_nested_path": "select event_id, get_json_object(props, '$.k') as k from events",
    "d07_complexity_summary": "select l_returnflag, round(avg(l_quantity), 2) as mean, max(l_quantity) as most, count(*) as n from lineitem group by l_returnflag",
    "c01_run_trends": "select o.o_orderkey, c.c_name, o.o_totalprice, o.o_orderdate from orders o join customer c on o.o_custkey = c.c_custkey where c.c_mktsegment = 'BUILDING' and o.o_orderdate >= timestamp '1995-01-01 00:00:00' and o.o_orderdate < timestamp '1996-01-01 00:00:00'",
    "c31_regressions": "select cur.event_type, round((cur.v - base.v) / base.v, 6) as change from (select event_type, avg(value) as v from events where user_id % 2 = 0 group by event_type) cur join (select event_type, avg(value) as v from events where user_id % 2 = 1 group by event_type) base on cur.event_type = base.event_type",
    "d17_effort_inputs": "select l_suppkey, count(*) as n, count(distinct l_partkey) as files from lineitem group by l_suppkey",
    "d18_top_savings": "select round(sum(s), 4) as savings from (select sum(l_quantity) as s from lineitem group by l_partkey order by s desc limit 20) t",
    "d27_distribution": "select l_shipmode_, count(*) as n from (select case when l_quantity <= 5 then 'low' when l_quantity <= 10 then 'medium' else 'high' end as l_shipmode_ from lineitem) t group by l_shipmode_",
    "d29_priority_histogram": "select sum(case when p = '1-URGENT' then 1 else 0 end) as urgent, sum(case when p = '2-HIGH' then 1 else 0 end) as high, count(*) as n from (select o_orderpriority as p from orders union all select case when event_type = 'error' then '1-URGENT' else '5-LOW' end from events) t",
    "c16_blocked_self_join": "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey where abs(a.p_retailprice - b.p_retailprice) <= 0.2 * greatest(a.p_retailprice, b.p_retailprice)",
    "c26_hierarchy": "select n.n_name as child, r.r_name as parent from nation n join region r on n.n_regionkey = r.r_regionkey",
    "g01_union_bag": "select 'customer' as kind, c_custkey as k from customer union all select 'supplier', s_suppkey from supplier",
    "g03_union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "e13_percent_of_total": "select l_returnflag, round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) over (), 6) as pct from lineitem group by l_returnflag",
    # Ranking scores: savings, complexity, risk and effort of groups of copies, their label and text.
    "i01_ranking_scores": """select l_partkey, round(least(s / 5, 100) * 0.4, 6) as savings, round(greatest(0, 100 - (c - 1) * 16.67) * 0.2, 6) as complexity, round(case when t > 2 then 100 * 0.3 when t > 0 then 100 * 0.7 else 100 end * 0.25, 6) as risk, round(greatest(0, 100 - (n * 5 + f * 10)) * 0.15, 6) as effort
      from (select l_partkey, sum(l_quantity) as s, count(*) as n, count(distinct l_suppkey) as f, cast(max(l_linenumber) as double) as c, cast(count_if(l_returnflag = 'R') as double) as t from lineitem group by l_partkey) g""",
    "i05_priority_label": "select o_orderkey, case when s >= 80 then 'critical' when s >= 60 then 'high' when s >= 40 then 'medium' when s >= 20 then 'low' else 'minimal' end as label from (select o_orderkey, o_totalprice % 100 as s from orders) t",
    "i06_recommendation": "select p_partkey, case when p_size >= 40 then 'high value: extract ' || p_brand when p_size >= 20 then 'medium value' else 'low value' end as advice from part",
    "i07_effort_ratio": "select l_orderkey, l_linenumber, cast(floor(l_extendedprice / greatest(l_quantity * 3, 1)) as bigint) as ratio from lineitem",
    "i08_strategy_suitability": "select p_partkey, least(100, greatest(0, 70 + case when p_size < 10 then 20 else -10 end + case when p_retailprice > 1500 then 15 else 0 end)) as extract_function, least(100, greatest(0, 50 + case when p_size > 30 then 30 else -20 end)) as extract_class from part",
    "i09_smell_severity": "select l_orderkey, l_linenumber, case when l_quantity / 20 >= 2.0 then 'high' when l_quantity / 20 >= 1.5 then 'medium' else 'low' end as severity from lineitem where l_quantity > 20",
    "i10_complexity_level": "select p_partkey, case when p_size <= 5 then 'low' when p_size <= 10 then 'medium' else 'high' end as level from part",
    "i11_breaking_risk": "select p_partkey, score, case when score <= 1 then 'low' when score <= 4 then 'medium' else 'high' end as level from (select p_partkey, least(cast(p_size as int), 20) / 10 + case when p_retailprice > 1500 then 2 else 0 end + case when p_size % 2 = 0 then 1 else 0 end as score from part) t",
    "i13_entity_score": "select p_partkey, greatest(0.0, least(100.0, 100.0 - case when p_size > 40 then 20 when p_size > 25 then 10 else 0 end + case when p_retailprice > 1400 then 5 else 0 end)) as score from part",
    "i15_hybrid_weights": "select l_orderkey, l_linenumber, round(0.4 * l_discount * 10 + 0.6 * l_tax * 10, 6) as two, round(0.2 * l_discount * 10 + 0.5 * l_tax * 10 + 0.3 * l_quantity / 50, 6) as three from lineitem",
    "i17_reduction_pct": "select o_orderkey, greatest(0.0, round(100.0 * (o_totalprice - 1000) / o_totalprice, 4)) as pct from orders",
    "i18_dictionary_gain": "select s_suppkey, case when s_suppkey < 10 then 5 when s_suppkey < 50 then 10 else 15 end as pct from supplier",
    "j05_adaptive_threshold": "select p_partkey, greatest(0.1, round(p_size / 50.0, 4) - 0.2) as threshold from part",
    "d28_seo_score": "select c_nationkey, greatest(0, least(100, round(avg(c_acctbal) / 100 - count_if(c_acctbal < 0) * 5, 4))) as score from customer group by c_nationkey",
    "d37_impact_lines": "select o_orderkey, cast(floor(o_totalprice * 1.2) as bigint) as additions, cast(floor(o_totalprice) as bigint) as deletions from orders",
    "b05_severity_at_least": "select event_id from events where (case event_type when 'error' then 2 when 'purchase' then 1 else 0 end) >= 1",
    "b06_severity_then_limit": "select event_id, value from events where value >= 50 order by value desc, event_id limit 100",
    "a21_new_dimension_keys": "select distinct l.l_suppkey from lineitem l left anti join (select s_suppkey from supplier where s_suppkey % 2 = 0) s on l.l_suppkey = s.s_suppkey",
    "a34_snapshots": "select user_id, count(*) as files, round(sum(value), 4) as size, max(ts) as newest from events group by user_id order by newest desc, user_id",
    "a37_retention": "select event_id from events where ts >= (select max(ts) from events) - interval '10' day",
    "j11_buckets": "select p_brand, p_size, count(*) as n, min(p_partkey) as first_id from part group by p_brand, p_size having count(*) > 1",
}
# A semi or anti join and a JSON path are said in other words by the other engine.
ORACLES = {
    "a21_new_dimension_keys": "select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 2 = 0)",
    "i20_nested_path": "select event_id, json_extract_string(props, '$.k') as k from events",
}
