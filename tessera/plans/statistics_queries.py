"""Queries of the second half of the statistics and of the column algebra, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import inference
from tessera.operators import partials, tables
from tessera.operators.lineage import settled
from tessera.plans.register import query, rounded

_AVG_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_AR = "l_returnflag in ('A', 'R')"


@query("select p_brand, round(avg(pow(x - m, 2)), 4) as m2, round(avg(pow(x - m, 3)), 2) as m3 from (select p_brand, p_retailprice as x, avg(p_retailprice) over (partition by p_brand) as m from part) group by p_brand")
def stat_moment(t):
    rows = t("part")
    mean = rows.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    of = [F.round(inference.moment("p_retailprice", F.col("m"), k), p).alias(f"m{k}") for k, p in ((2, 4), (3, 2))]
    return rows.join(mean, "p_brand").groupBy("p_brand").agg(*of)


@query("select event_type, round(var_pop(value), 5) as var_pop, round(stddev_pop(value), 6) as sd_pop, round(var_samp(value), 5) as var, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / sqrt(count(value)), 6) as sterr from events group by 1")
def stat_spread(t):
    out = t("events").groupBy("event_type").agg(*inference.spread("value"))
    return out.select("event_type", *[F.round(c, 5 if c.startswith("var") else 6).alias(c) for c in out.columns[1:]])


@query("select round(sum(l_quantity), 3) as total, round(sum(l_quantity * l_quantity), 3) as ss, round(sum(l_quantity * l_discount), 3) as summult, round(sum(pow(l_quantity - l_discount, 2)), 3) as sumdiffsquared, round(sum(l_quantity) * sum(l_quantity), 0) as square_of_sums from lineitem")
def stat_sums(t):
    out = t("lineitem").agg(*inference.sums("l_quantity", "l_discount"))
    return out.select(*[F.round(c, 0 if c == "square_of_sums" else 3).alias(c) for c in out.columns])


@query("select event_id, round(sum(cast(value as decimal(18, 4))) over (order by event_id), 4) as cumsum from events")
def stat_cumsum(t):
    rows = t("events").select("event_id", F.col("value").cast("decimal(18,4)").alias("v"))
    out = tables.running(rows, "event_id", "v", "before")
    return out.select("event_id", (F.col("before") + F.col("v")).cast("decimal(38,4)").alias("cumsum"))


@query("select p_brand, round(quantile_cont(p_retailprice, 0.9), 6) as at90, round(100.0 * count(*) filter (where p_retailprice <= 1500) / count(*), 6) as share1500 from part group by 1")
def stat_percentiles(t):
    share = t("part").groupBy("p_brand").agg(inference.percentile_of("p_retailprice", 1500).alias("share1500"))
    return rounded(share.join(partials.quantiles(t("part"), ["p_brand"], "p_retailprice", {"at90": 0.9}), "p_brand"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) as low, round(median(l_extendedprice), 6) as mid, round(quantile_cont(l_extendedprice, 0.999), 6) as high from lineitem group by 1")
def stat_large_quantiles(t):
    return rounded(partials.quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"low": 0.05, "mid": 0.5, "high": 0.999}))


@query("select event_type, count(*) as n, true as distinct_near, true as median_near from events group by 1")
def agg_merged_states(t):
    """States of days, stored and merged, against the exact figures: within 4 % of the distinct users and 2 % of the median's rank."""
    e = t("events")
    daily = settled(partials.states(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id"))
    near = partials.estimates(partials.merged(daily, ["event_type"]), {"mid": 0.5})
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    ranks = e.select("event_type", "value").join(F.broadcast(near.select("event_type", "mid")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("mid")).cast("double")).alias("at"))
    both = near.join(exact, "event_type").join(ranks, "event_type")
    return both.select("event_type", "n", (F.abs(F.col("n_distinct") - F.col("users")) <= 0.04 * F.col("users") + 1).alias("distinct_near"), (F.abs(F.col("at") - 0.5) <= 0.02).alias("median_near"))


@query("select event_id, round(((n - 1.5) * n * pow(value - m, 2) - 0.5 * v * (n - 1)) / ((n - 1) * (n - 2)), 3) as r from (select event_id, value, cast(count(*) over w as double) as n, avg(value) over w as m, var_samp(value) over w as v from events window w as (partition by event_type))")
def stat_obrien(t):
    return rounded(inference.obrien(t("events"), "event_type", "value").select("event_id", "r"), 3)


_TRIM = "select l_orderkey * 10 + l_linenumber as k, l_quantity from lineitem qualify row_number() over (order by l_quantity, l_orderkey * 10 + l_linenumber) "


@query(f"{_TRIM} > cast(floor(0.1 * count(*) over ()) as bigint) and row_number() over (order by l_quantity, l_orderkey * 10 + l_linenumber) <= count(*) over () - cast(floor(0.1 * count(*) over ()) as bigint)")
def stat_trimboth(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity")
    return inference.trim(rows, "l_quantity", "k", 0.1, 0.1)


@query(f"{_TRIM} <= count(*) over () - cast(floor(0.25 * count(*) over ()) as bigint)")
def stat_trim1(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity")
    return inference.trim(rows, "l_quantity", "k", high=0.25)


@query("select round(corr(l_quantity, l_extendedprice), 8) as r, count(*) as n from lineitem")
def stat_pearson(t):
    return rounded(t("lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n")), 8)


@query(f"select round((avg(l_quantity) filter (where l_returnflag = 'R') - avg(l_quantity) filter (where l_returnflag = 'A')) / stddev_pop(l_quantity) * sqrt(avg((l_returnflag = 'A')::int) * avg((l_returnflag = 'R')::int)), 8) as r, count(*) as n from lineitem where {_AR}")
def stat_pointbiserial(t):
    return rounded(inference.point_biserial(t("lineitem"), "l_returnflag", "l_quantity", "A", "R"), 8)


@query("with c as (select l_quantity as x, l_discount as y, count(*) as n from lineitem group by 1, 2), s as (select sum(a.n * b.n * sign((a.x - b.x) * (a.y - b.y))) / 2 as e from c a, c b), n as (select cast(sum(n) as double) as n from c), tx as (select sum(t * (t - 1) / 2) as t from (select sum(n) as t from c group by x)), ty as (select sum(t * (t - 1) / 2) as t from (select sum(n) as t from c group by y)) select round(e / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 8) as tau, cast(n as bigint) as n from s, n, tx, ty")
def stat_kendall(t):
    return rounded(inference.kendall(t("lineitem"), "l_quantity", "l_discount"), 8)


@query("select event_type, round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 6) as t, count(value) - 1 as df from events group by 1")
def stat_ttest_1samp(t):
    return rounded(t("events").groupBy("event_type").agg(*inference.ttest_single("value", 50.0)))


@query("select l_returnflag, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) as t, count(*) - 1 as df from lineitem group by 1")
def stat_ttest_rel(t):
    return rounded(t("lineitem").groupBy("l_returnflag").agg(*inference.ttest_paired("l_discount", "l_tax")))


@query(f"with v as (select l_quantity, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'R') as b from lineitem where {_AR} group by 1), c as (select sum(a) over w as fa, sum(b) over w as fb, sum(a) over () as na, sum(b) over () as nb from v window w as (order by l_quantity)) select round(max(abs(fa / na - fb / nb)), 8) as d, cast(max(na) as bigint) as n0, cast(max(nb) as bigint) as n1 from c")
def stat_ks_2samp(t):
    return rounded(inference.kolmogorov(t("lineitem"), "l_returnflag", "l_quantity", "A", "R"), 8)


@query("select round(1 - sum(pow(t, 3) - t) / (pow(sum(t), 3) - sum(t)), 10) as correction from (select cast(count(*) as double) as t from lineitem group by l_quantity)")
def stat_tiecorrect(t):
    return rounded(inference.tie_correction(t("lineitem"), "l_quantity"), 10)


@query(f"with r as (select l_returnflag as g, {_AVG_RANK.format('l_quantity')} as r from lineitem where {_AR}), s as (select sum(r) filter (where g = 'A') as s, cast(count(*) filter (where g = 'A') as double) as n, cast(count(*) filter (where g = 'R') as double) as m from r) select round((s - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) as z from s")
def stat_ranksums(t):
    return rounded(inference.rank_sums(t("lineitem"), "l_returnflag", "l_quantity", "A", "R"))


@query(f"with d as (select d from (select l_linenumber - l_quantity / 8 as d from lineitem) where d <> 0), r as (select d, {_AVG_RANK.format('abs(d)')} as r from d) select round(least(sum(r) filter (where d > 0), sum(r) filter (where d < 0)), 3) as t, count(*) as n from r")
def stat_wilcoxon(t):
    rows = t("lineitem").select(F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") / 8).alias("y"))
    return rounded(inference.wilcoxon(rows, "x", "y"), 3)


_MEASURES = ("l_quantity / 50", "l_discount * 10", "l_tax * 12.5")


@query("with r as (select " + ", ".join(f"{' + '.join(f'cast({o} < {c} as int)' for o in _MEASURES)} + ({' + '.join(f'cast({o} = {c} as int)' for o in _MEASURES)} + 1) / 2 as r{i}" for i, c in enumerate(_MEASURES)) + " from lineitem), s as (select sum(r0) as a, sum(r1) as b, sum(r2) as c, count(*) as n from r) select round(12 / (cast(n as double) * 12) * (a * a + b * b + c * c) - 12.0 * n, 4) as chisq, n from s")
def stat_friedman(t):
    return rounded(inference.friedman(t("lineitem"), [F.expr(m) for m in _MEASURES]), 4)


@query("select round(avg(x), 6) as tmean, round(var_samp(x), 6) as tvar, min(x) as tmin, max(x) as tmax, round(stddev_samp(x), 6) as tstdev, round(stddev_samp(x) / sqrt(count(x)), 8) as tsem from (select l_quantity as x from lineitem where l_quantity between 10 and 40)")
def stat_trimmed(t):
    out = t("lineitem").agg(*inference.trimmed("l_quantity", 10, 40))
    return out.select(*[F.round(c, 8 if c == "tsem" else 6).alias(c) for c in out.columns])


_NORMAL = "select cast(n as double) as n, m3 / pow(m2, 1.5) as s, m4 / (m2 * m2) as k from (select count(*) as n, avg(pow(x - m, 2)) as m2, avg(pow(x - m, 3)) as m3, avg(pow(x - m, 4)) as m4 from (select value as x, avg(value) over () as m from events))"
_SZ = "select *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 as w2, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as b from m"
_KZ = "select asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) as skew_z, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) as kurtosis_z from (select *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) as a from z)"


@query(f"with m as ({_NORMAL}), z as ({_SZ}), r as ({_KZ}) select round(skew_z, 5) as skew_z, round(kurtosis_z, 5) as kurtosis_z, round(skew_z * skew_z + kurtosis_z * kurtosis_z, 3) as k2, round(exp(-(skew_z * skew_z + kurtosis_z * kurtosis_z) / 2), 8) as p from r")
def stat_normaltest(t):
    out = inference.normality(t("events"), "value")
    return out.select(*[F.round(c, p).alias(c) for c, p in (("skew_z", 5), ("kurtosis_z", 5), ("k2", 3), ("p", 8))])


@query("select event_type, round(avg(value) / stddev_samp(value), 6) as ratio from events group by 1")
def stat_signaltonoise(t):
    return rounded(t("events").groupBy("event_type").agg(inference.signal_to_noise("value").alias("ratio")))


@query("select event_id, case when value between 10 and 60 then value else -1 end as kept, round(value, 1) as one from events")
def stat_threshold(t):
    return t("events").select("event_id", inference.threshold("value", 10, 60, -1.0).alias("kept"), F.round("value", 1).alias("one"))


@query("select s_suppkey, round((s_acctbal - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6) as z from supplier")
def stat_zmap(t):
    return rounded(inference.z_against(t("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", t("part"), "p_retailprice").select("s_suppkey", "z"))


_COV = ["l_quantity", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_pop({a}, {b}), 6) as covariance, round(corr({a}, {b}), 6) as correlation from lineitem" for i, a in enumerate(_COV) for b in _COV[i:]))
def stat_covariance(t):
    return rounded(inference.covariances(t("lineitem"), _COV))


@query("with g as (select event_type, count(*) as n, var_pop(value) as v from events group by 1), e as (select var_pop(value) * count(*) as er, count(*) - 1.0 as dr from events), f as (select sum(n * v) as ef, cast(sum(n) - count(*) as double) as df from g) select round(((er - ef) / (dr - df)) / (ef / df), 5) as f from e, f")
def stat_f_value(t):
    rows = t("events")
    whole = rows.agg((F.var_pop("value") * F.count("*")).alias("er"), (F.count("*") - 1).alias("dr"))
    groups = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.var_pop("value").alias("v")).agg(F.sum(F.col("n") * F.col("v")).alias("ef"), (F.sum("n") - F.count("*")).alias("df"))
    return rounded(whole.join(groups).select(inference.f_nested(F.col("er"), F.col("ef"), F.col("dr"), F.col("df")).alias("f")), 5)


@query("with s as (select l_orderkey, count(distinct l_returnflag) as a, count(distinct l_linenumber) as b from lineitem group by 1) select 'l_returnflag' as factor, bool_or(a > 1) as within from s union all select 'l_linenumber', bool_or(b > 1) from s")
def stat_findwithin(t):
    return inference.within_subject(t("lineitem"), "l_orderkey", ["l_returnflag", "l_linenumber"])


# column algebra ----------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 45 and l_tax < 0.02")
def tab_dm_remap(t):
    return tables.remap(tables.matching(t("lineitem"), "l_quantity > 45 and l_tax < 0.02"), ["l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) as net"])


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'now' else o_orderpriority end as o_orderpriority from orders")
def tab_replace(t):
    return tables.replace(t("orders").select("o_orderkey", "o_orderpriority"), {"1-URGENT": "now"})


@query("select l_orderkey, l_linenumber, round(l_extendedprice, 1) as l_extendedprice, round(l_tax, 1) as l_tax from lineitem")
def tab_roundlist(t):
    return tables.round_floats(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), 1)


@query("with s as (select s_suppkey, row_number() over (order by s_suppkey) as k from supplier), n as (select n_name, row_number() over (order by n_nationkey) as k from nation) select s_suppkey, n_name from s join n using (k)")
def tab_simpleabut(t):
    return tables.zip_columns(t("supplier").select("s_suppkey"), t("nation").select("n_nationkey", "n_name"), "s_suppkey", "n_nationkey").select("s_suppkey", "n_name")


@query("select vec_id, i as place, cast(x as double) as x from (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding) as x from embeddings)")
def tab_flat(t):
    return tables.flat(t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", "x")


@query("select o_orderkey, cast(case when try_cast(v as double) is null then 'string' when try_cast(v as double) = floor(try_cast(v as double)) then 'int' else 'float' end as varchar) as kind from (select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus when o_orderkey % 3 = 1 then cast(o_orderkey as varchar) else cast(o_orderkey as varchar) || '.5' end as v from orders)")
def tab_interpret(t):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    return t("orders").select("o_orderkey", tables.kind_of(v).alias("kind"))


@query("select l_orderkey, l_linenumber from lineitem where not (l_returnflag in ('A', 'N') and l_linestatus in ('F'))")
def tab_delete_elements(t):
    return tables.delete(t("lineitem"), {"l_returnflag": ["A", "N"], "l_linestatus": ["F"]}).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, case when regexp_matches(o_orderpriority, '^(?:[12])') then 'high' when regexp_matches(o_orderpriority, '^(?:5)') then null else o_orderpriority end as o_orderpriority from orders")
def tab_map_attributes(t):
    return tables.map_prefix(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"[12]": "high", "5": None})


@query("select o_orderkey, o_orderstatus, dense_rank() over (order by o_orderstatus) - 1 as code from orders")
def tab_mask(t):
    return tables.codes(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "code")


@query("select o_orderkey, unnest(string_split(o_orderstatus || '---' || o_orderpriority, '---')) as kind, unnest([0, 1]) as place from orders")
def tab_split_merged(t):
    rows = t("orders").select("o_orderkey", F.concat_ws("---", "o_orderstatus", "o_orderpriority").alias("kind"))
    return tables.split_merged(rows, "kind")


@query("select p_partkey, regexp_matches(lower(p_type), '^(?:standard|promo)') as known, p_size between 10 and 20 as ranged, contains(p_type, 'BRASS') as brass from part")
def tab_predicates(t):
    return t("part").select("p_partkey", F.lower("p_type").rlike("^(?:standard|promo)").alias("known"), F.col("p_size").between(10, 20).alias("ranged"), F.contains("p_type", F.lit("BRASS")).alias("brass"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def tab_skip_list(t):
    skip = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.without(t("orders").select("o_orderkey"), skip, ["o_orderkey"])


@query("select a.i as d0, b.i as d1, c.i as d2 from range(0, 4) a(i), range(0, 3) b(i), range(0, 5) c(i)")
def tab_odometer(t):
    return tables.odometer(t("region").sparkSession, [3, 2, 4])


@query("select a.n_name as x0, b.n_name as x1, c.n_name as x2 from nation a, nation b, nation c where a.n_name < b.n_name and b.n_name < c.n_name")
def set_combinations(t):
    return tables.combinations(t("nation"), "n_name", 3)
