"""Queries over the driver's tables, and the SQL that checks them.

Views: A has an order as a cell (sample nation, group region, mitochondrial features three brands); B an event (sample
its type); C a line (sample flag and status). The SQL counts profiles by comparing cells with cutoffs one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import numerics as N
from siftwell.operators import clusters, cutoffs, features, losstest, plotdata, profile, qc, support
from siftwell.plans import benchmark, cutoff_plan, sensitivity
from siftwell.plans.detection import detect
from siftwell.schema import Bounds, Columns, Detection
from siftwell.sources import tables
from siftwell.storage import narrowed

BRANDS = ["Brand#1", "Brand#11", "Brand#12"]
A, B, C = Columns(group="grp"), Columns(), Columns()


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- views ----------------------------------------------------------------------------


def counts_a(spark: SparkSession, sf: str) -> DataFrame:
    """cell_id, feature, count: lines by order and part's brand."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("feature"), F.col("l_quantity").alias("count"), "l_partkey", "p_type")


def cells_a(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_brand").isin(BRANDS).alias("mito"))
    per = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.countDistinct("l_partkey").alias("nFeature_RNA"), F.sum("l_quantity").alias("nCount_RNA"), (F.sum(F.when(F.col("mito"), F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("mitoRatio"))
    place = read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    where = orders.join(place, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell_id"), F.col("n_name").alias("sample"), F.col("r_name").alias("grp"))
    return per.join(where, "cell_id")


def cells_b(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("event_type").alias("sample"), F.least(F.col("value") / 500, F.lit(1.0)).alias("mitoRatio"), F.pmod("user_id", F.lit(100)).cast("long").alias("nFeature_RNA"), F.col("value").alias("nCount_RNA"))


def cells_c(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "lineitem")
    return e.select(F.concat("l_returnflag", "l_linestatus").alias("sample"), F.round(F.col("l_discount") + F.col("l_tax"), 6).alias("mitoRatio"))


SQL_A = """cells as (select l_orderkey as cell_id, n_name as sample, r_name as grp, count(distinct l_partkey)::bigint as nFeature_RNA, sum(l_quantity) as nCount_RNA,
  sum(case when p_brand in ('Brand#1', 'Brand#11', 'Brand#12') then l_quantity else 0 end) / sum(l_quantity) as m
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)"""
SQL_B = "cells as (select event_id as cell_id, event_type as sample, least(value / 500, 1.0) as m, (user_id % 100)::bigint as nFeature_RNA, value as nCount_RNA from events)"
SQL_C = "cells as (select l_returnflag || l_linestatus as sample, round(l_discount + l_tax, 6) as m from lineitem)"


# -- SQL of the detection ---------------------------------------------------------------


def sql_profile(p: Detection) -> str:
    grid = ", ".join(f"({i}, {c!r}::double)" for i, c in enumerate(p.grid))
    return f"""grid(idx, cutoff) as (values {grid}),
size as (select sample, count(*) as n_cells from cells group by 1),
prof as (select size.sample, idx, cutoff, n_cells, (select count(*) from cells where cells.sample = size.sample and m < cutoff) as retained_cells from size, grid),
loss0 as (select sample, idx as interval_index, lag(cutoff) over w as previous_cutoff, cutoff, n_cells, retained_cells, retained_cells::double / n_cells as retention_fraction,
  greatest(lag(retained_cells) over w - retained_cells, 0) as interval_loss from prof window w as (partition by sample order by idx)),
loss as (select *, interval_loss::double / n_cells as interval_loss_fraction, interval_loss >= {p.min_drop_cells} and interval_loss::double / n_cells >= {p.min_drop_fraction!r}::double and retained_cells >= {p.min_cells_after}
  and retention_fraction >= {p.min_retention_after!r}::double as candidate from loss0 where interval_index > 0)"""


def sql_tests(p: Detection) -> str:
    z = {
        "mad_zscore": "(L - med) / case when mad > 0 then mad when iqr > 0 then iqr when sd > 0 then sd else 2.220446049250313e-16 end",
        "zscore": "case when sd > 0 then (L - mean) / sd end",
    }.get(p.loss_test, "null::double")
    score = {"empirical_tail": "L", "zscore": "case when sd > 0 then z when L > mean then 'Infinity'::double else 0 end", "threshold_only": "L", "poisson_tail": "L / greatest(mean, 1e-8)"}.get(p.loss_test, "z")
    tail = {"empirical_tail": "(len(list_filter(bg, lambda x: x >= L)) + 1)::double / (len(bg) + 1)", "threshold_only": "null::double", "poisson_tail": "null::double"}.get(p.loss_test, N.upper_normal_sql("z"))
    flat = f"case when sd > 0 then {tail} when L > mean then {N.TINY!r} else 1 end" if p.loss_test == "zscore" else tail
    base = "med" if p.loss_test == "mad_zscore" else "mean"
    p_value = "null::double" if p.loss_test in ("threshold_only", "poisson_tail") else f"case when L <= 0 then 1.0 else greatest({flat}, {N.TINY!r}) end"
    score = "L" if p.loss_test == "threshold_only" else f"case when L <= 0 then 0 else {score} end"
    return f"""bg0 as (select a.*, a.interval_loss::double as L, (select list(b.interval_loss::double order by b.interval_loss) from loss b where b.sample = a.sample and b.interval_index <> a.interval_index) as bg from loss a),
bg1 as (select *, list_aggregate(bg, 'median') as med, list_aggregate(bg, 'avg') as mean, list_aggregate(bg, 'stddev_samp') as sd, (list_aggregate(bg, 'quantile_cont', 0.75) - list_aggregate(bg, 'quantile_cont', 0.25)) / 1.349 as iqr from bg0),
bg2 as (select *, 1.4826 * list_aggregate(list_transform(bg, lambda x: abs(x - med)), 'median') as mad from bg1),
bg3 as (select *, {z} as z from bg2),
test as (select *, {p_value} as p_value, {score} as loss_score, {base} as baseline_loss from bg3)"""


SQL_ADJUST = {
    "BH": "least(1, min(n * p_value / hi) over (partition by sample order by p_value desc range between unbounded preceding and current row))",
    "BY": "least(1, min(h * n * p_value / hi) over (partition by sample order by p_value desc range between unbounded preceding and current row))",
    "holm": "least(1, max((n - lo + 1) * p_value) over (partition by sample order by p_value, interval_index))",
    "hochberg": "least(1, min((n - lo + 1) * p_value) over (partition by sample order by p_value desc, interval_index desc))",
    "bonferroni": "least(1, n * p_value)",
}


def sql_adjusted(p: Detection) -> str:
    how = SQL_ADJUST.get(p.p_adjust, "p_value")
    ok = "candidate" if p.loss_test == "threshold_only" else f"candidate and coalesce(p_adj <= {p.alpha!r}, false)"
    return f"""ranked as (select *, count(*) over (partition by sample) as n, row_number() over (partition by sample order by p_value, interval_index) as lo,
  count(*) over (partition by sample order by p_value range between unbounded preceding and current row) as hi,
  (select sum(1e0 / k) from range(1, 1 + (select max(interval_index) from test)) t(k)) as h from test),
adj as (select *, {how} as p_adj from ranked),
judged as (select *, {ok} as sig from adj)"""


def sql_quantile8(p: float, source: str = "cells", value: str = "m", key: str = "sample") -> str:
    lo, hi, w = N.type8("n", p)
    return f"""(select {key}, case when w > 0 and x <> y then (1 - w) * x + w * y else x end as q from (select {key}, max(case when r = {lo} then v end) as x, max(case when r = {hi} then v end) as y, max({w}) as w
  from (select {key}, {value} as v, row_number() over (partition by {key} order by {value}) as r, count(*) over (partition by {key}) as n from {source} where {value} is not null) group by 1))"""


def sql_snap(x: str, p: Detection) -> str:
    return f"round(greatest({p.min_cut!r}, least({p.max_cut!r}, round_even({x} / {p.bin_width!r}, 0) * {p.bin_width!r})), 6)"


def sql_summary(p: Detection) -> str:
    med = sql_snap("(select median(c) from (select distinct unnest(list_filter(cs, lambda x: x is not null)) as c))", p)
    pick = {"largest_drop": "drop_c", "first_significant_high": "high", "first_significant_low": "low", "reference_guided": "high", "median_significant": med}[p.selection]
    return f"""back as (select sample, {sql_snap("q", p)} as fallback from {sql_quantile8(p.fallback_quantile)}),
agg as (select sample, max(n_cells) as n_cells, count(*) filter (sig) as k, max(cutoff) filter (sig) as high, min(cutoff) filter (sig) as low, arg_max(cutoff, interval_loss * 1e6 + cutoff) filter (sig) as drop_c,
  list(case when sig then cutoff end) as cs, max(interval_loss) as top, max(interval_loss_fraction) as topf from judged group by 1),
sel as (select agg.*, fallback, case when k > 0 then {pick} else fallback end as selected, coalesce(high, fallback) as recommended from agg left join back using (sample)),
summ as (select sel.*, a.retained_cells as at_selected, a.retained_cells::double / a.n_cells as fraction_selected, b.retained_cells as at_recommended, b.retained_cells::double / b.n_cells as fraction_recommended
  from sel left join prof a on a.sample = sel.sample and abs(a.cutoff - selected) < 1e-7 left join prof b on b.sample = sel.sample and abs(b.cutoff - recommended) < 1e-7)"""


def sql_support(source: str, value: str, fraction: float, key: str | None = None) -> str:
    """global_cutoff, count, required, n of the support rule."""
    part, own = (f"partition by {key}", f"{key}, ") if key else ("", "")
    return f"""(select {own}coalesce(max(c) filter (s >= need), min(c)) as global_cutoff, max(n) as n, max(need) as required_support, coalesce(min(s) filter (s >= need), max(s)) as support_count
  from (select {own}{value} as c, count({value}) over ({part} order by {value} desc range between unbounded preceding and current row) as s, count(*) over ({part}) as n,
  greatest(1, ceil(count(*) over ({part}) * {fraction!r}::double)) as need from {source}){f" group by {key}" if key else ""})"""


def chain(view: str, p: Detection, upto: str) -> str:
    parts = {"profile": [sql_profile], "tests": [sql_profile, sql_tests], "judged": [sql_profile, sql_tests, sql_adjusted], "summary": [sql_profile, sql_tests, sql_adjusted, sql_summary]}[upto]
    return "with " + ",\n".join([view, *(f(p) for f in parts)])


DEFAULT = Detection()
RULES = {"largest_drop": "largest_drop", "first_high": "first_significant_high", "first_low": "first_significant_low", "median": "median_significant"}
MANUAL = Detection(species="mouse", tissue="liver", bin_width=0.02)
R9 = lambda c: F.round(c, 9).alias(c)
R6 = lambda c: F.round(c, 6).alias(c)

Q, O = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


# -- cells and features -------------------------------------------------------------------


@query("cell_metrics", f"with {SQL_A} select cell_id, sample, grp, nFeature_RNA, nCount_RNA, round(m, 9) as mitoRatio from cells")
def cell_metrics(spark, sf):
    return cells_a(spark, sf).select("cell_id", "sample", "grp", "nFeature_RNA", "nCount_RNA", R9("mitoRatio"))


@query("mito_ratio", "select l_orderkey as cell_id, count(*)::bigint as nFeature_RNA, sum(l_quantity) as nCount_RNA, round(100 * sum(case when p_type = 'PROMO' then l_quantity else 0 end) / sum(l_quantity), 6) as percent_mito from lineitem join part on l_partkey = p_partkey group by 1")
def mito_ratio(spark, sf):
    counts = counts_a(spark, sf).select("cell_id", F.col("p_type").alias("feature"), "count")
    mito = counts.select("feature").where("feature = 'PROMO'").distinct()
    return features.cell_metrics(counts, mito, "percent", "percent_mito").select("cell_id", "nFeature_RNA", "nCount_RNA", R6("percent_mito"))


@query("feature_cascade", "with s as (select distinct p_brand as feature, case when regexp_matches(p_brand, '^BRAND#1') then 0 when regexp_matches(upper(p_brand), '^BRAND#1') then 1 end as stage from part) select feature, case stage when 0 then 'feature_names' else 'feature_names_case_insensitive' end as source from s where stage = (select min(stage) from s)")
def feature_cascade(spark, sf):
    return features.mito_features(read(spark, sf, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("symbol")), pattern="^BRAND#1")


@query("feature_metadata", "select distinct p_name as feature, 'feature_metadata:symbol' as source from part where p_type = 'PROMO'")
def feature_metadata(spark, sf):
    return features.mito_features(read(spark, sf, "part").select(F.col("p_name").alias("feature"), F.col("p_type").alias("symbol")), pattern="^PROMO$")


@query("matrix_min_filters", """with c as (select l_orderkey as cell_id, p_brand as feature, l_quantity as count from lineitem join part on l_partkey = p_partkey),
k as (select cell_id from c where count > 0 group by 1 having count(distinct feature) >= 4), l as (select * from c semi join k using (cell_id)),
f as (select feature from l where count > 0 group by 1 having count(distinct cell_id) >= 30)
select feature, count(distinct cell_id)::bigint as cells, sum(count) as total from l semi join f using (feature) group by 1""")
def matrix_min_filters(spark, sf):
    counts = counts_a(spark, sf).select("cell_id", "feature", "count")
    return features.creation_filters(counts, 30, 4).groupBy("feature").agg(F.countDistinct("cell_id").alias("cells"), F.sum("count").alias("total"))


# -- profile and losses ----------------------------------------------------------------------


for _name, _cells, _cols, _view in (("a", cells_a, A, SQL_A), ("b", cells_b, B, SQL_B), ("c", cells_c, C, SQL_C)):
    Q[f"retained_profile_{_name}"] = lambda spark, sf, f=_cells, c=_cols: profile.profile(f(spark, sf), c).select("sample", "cutoff", "n_cells", "retained_cells", R9("retention_fraction"))
    O[f"retained_profile_{_name}"] = chain(_view, DEFAULT, "profile") + " select sample, cutoff, n_cells, retained_cells, round(retained_cells::double / n_cells, 9) as retention_fraction from prof"
    Q[f"interval_loss_{_name}"] = lambda spark, sf, f=_cells, c=_cols: profile.interval_losses(profile.profile(f(spark, sf), c)).select("sample", "interval_index", "previous_cutoff", "cutoff", "retained_cells", "interval_loss", R9("interval_loss_fraction"), "passes_candidate_filters")
    O[f"interval_loss_{_name}"] = chain(_view, DEFAULT, "profile") + " select sample, interval_index, previous_cutoff, cutoff, retained_cells, interval_loss, round(interval_loss_fraction, 9) as interval_loss_fraction, candidate as passes_candidate_filters from loss"

COARSE = Detection(bin_width=0.25, min_cut=0.25)


@query("profile_pivot", f'with {SQL_B} select sample, count(*) as raw_counts, count(*) filter (m < 1) as "1", count(*) filter (m < 0.75) as "0.75", count(*) filter (m < 0.5) as "0.5", count(*) filter (m < 0.25) as "0.25" from cells group by 1')
def profile_pivot(spark, sf):
    return profile.wide_profile(profile.profile(cells_b(spark, sf), B, COARSE), COARSE)


@query("candidate_filters", chain(SQL_C, DEFAULT, "profile") + f" select sample, count(*) filter (interval_loss >= {DEFAULT.min_drop_cells}) as drops, count(*) filter (interval_loss_fraction >= 0.01) as shares, count(*) filter (retained_cells >= 20) as left_over, count(*) filter (candidate) as candidates from loss group by 1")
def candidate_filters(spark, sf):
    rows = profile.interval_losses(profile.profile(cells_c(spark, sf), C))
    named = {"drops": "passes_min_drop_cells", "shares": "passes_min_drop_fraction", "left_over": "passes_min_cells_after", "candidates": "passes_candidate_filters"}
    return rows.groupBy("sample").agg(*(F.count_if(F.col(c)).alias(n) for n, c in named.items()))


def losses_of(f, cols, p):
    return lambda spark, sf: losstest.judged(profile.interval_losses(profile.profile(f(spark, sf), cols, p), p), p)


for _test in ("mad_zscore", "zscore", "empirical_tail", "threshold_only", "poisson_tail"):
    for _name, _cells, _cols, _view in (("b", cells_b, B, SQL_B), ("c", cells_c, C, SQL_C)):
        _p = Detection(loss_test=_test)
        _keep = ["sample", "interval_index", "interval_loss"]
        _extra = [] if _test in ("poisson_tail", "threshold_only") else ["p_value"]
        _cols_of = ["loss_score", "baseline_loss", *_extra]
        Q[f"loss_{_test}_{_name}"] = lambda spark, sf, g=losses_of(_cells, _cols, _p), k=_keep, x=_cols_of: g(spark, sf).select(*k, *(F.round(c, 6 if c != "p_value" else 9).alias(c) for c in x))
        O[f"loss_{_test}_{_name}"] = chain(_view, _p, "tests") + f" select {', '.join(_keep)}, {', '.join(f'round({c}, {6 if c != 'p_value' else 9}) as {c}' for c in _cols_of)} from test"

for _adj in SQL_ADJUST:
    _p = Detection(p_adjust=_adj)
    Q[f"p_adjust_{_adj.lower()}"] = lambda spark, sf, g=losses_of(cells_b, B, _p): g(spark, sf).select("sample", "interval_index", R9("p_adj"), "is_significant")
    O[f"p_adjust_{_adj.lower()}"] = chain(SQL_B, _p, "judged") + " select sample, interval_index, round(p_adj, 9) as p_adj, sig as is_significant from judged"


# closed testing by Simes: an interval's worst set of m intervals is itself with the m - 1 largest others
HOMMEL = """,
ps as (select sample, list(p_value order by p_value, interval_index) as ps from test group by 1),
r as (select test.sample, interval_index, candidate, row_number() over (partition by test.sample order by p_value, interval_index) as r, ps, len(ps) as n from test join ps using (sample)),
sets as (select sample, interval_index, candidate, m, case when r > n - m then ps[n - m + 1:n] else list_prepend(ps[r], ps[n - m + 2:n]) end as q from r, lateral (select unnest(range(1, n + 1)) as m)),
hom as (select sample, interval_index, candidate, least(1, max(list_min(list_transform(q, lambda x, i: m * x / i)))) as p_adj from sets group by 1, 2, 3)
select sample, interval_index, round(p_adj, 9) as p_adj, candidate and p_adj <= 0.05 as is_significant from hom"""


@query("p_adjust_hommel", chain(SQL_C, Detection(p_adjust="hommel"), "tests") + HOMMEL)
def p_adjust_hommel(spark, sf):
    return losses_of(cells_c, C, Detection(p_adjust="hommel"))(spark, sf).select("sample", "interval_index", R9("p_adj"), "is_significant")


@query("p_adjust_none", chain(SQL_B, Detection(p_adjust="none"), "judged") + " select sample, interval_index, round(p_value, 9) as p_adj, sig as is_significant from judged")
def p_adjust_none(spark, sf):
    return losses_of(cells_b, B, Detection(p_adjust="none"))(spark, sf).select("sample", "interval_index", R9("p_adj"), "is_significant")


# the upper tail as one less the sum of all smaller terms
@query("poisson_p_value", chain(SQL_B, Detection(loss_test="poisson_tail"), "tests") + """ select sample, interval_index, round(case when L <= 0 then 1.0 else
  greatest(1 - list_sum(list_transform(range(0, L::bigint), lambda k: exp(k * ln(greatest(mean, 1e-8)) - greatest(mean, 1e-8) - lgamma(k + 1)))), 0) end, 6) as p_value from test""")
def poisson_p_value(spark, sf):
    return losses_of(cells_b, B, Detection(loss_test="poisson_tail"))(spark, sf).select("sample", "interval_index", R6("p_value"))


@query("loss_alias_columns", chain(SQL_A, DEFAULT, "judged") + """ select sample, interval_index, round(p_adj, 9) as p_adjusted, round(p_adj, 9) as p_fdr, 'BH' as p_adjust_method,
  round(interval_loss_fraction, 9) as drop_fraction, interval_loss as delta_prev from judged""")
def loss_alias_columns(spark, sf):
    return losses_of(cells_a, A, DEFAULT)(spark, sf).select("sample", "interval_index", R9("p_adjusted"), R9("p_fdr"), "p_adjust_method", R9("drop_fraction"), "delta_prev")


@query("significant_intervals", chain(SQL_A, DEFAULT, "judged") + " select sample, cutoff, interval_loss, round(p_adj, 9) as p_adj from judged where sig")
def significant_intervals(spark, sf):
    return losses_of(cells_a, A, DEFAULT)(spark, sf).where("is_significant").select("sample", "cutoff", "interval_loss", R9("p_adj"))


# -- cutoffs by sample ---------------------------------------------------------------------------

for _name, _rule in RULES.items():
    _p = Detection(selection=_rule)
    Q[f"cutoff_{_name}"] = lambda spark, sf, p=_p: detect(cells_a(spark, sf), A, p, check=False).summary.select("sample", "selected_cutoff", "significant_interval_count", "fallback_used")
    O[f"cutoff_{_name}"] = chain(SQL_A, _p, "summary") + " select sample, selected as selected_cutoff, k::int as significant_interval_count, k = 0 as fallback_used from summ"


@query("fallback_quantile", f"with {SQL_A} select sample, {sql_snap('q', DEFAULT)} as fallback_cutoff from {sql_quantile8(0.9)}")
def fallback_quantile(spark, sf):
    return cutoffs.fallbacks(narrowed(cells_a(spark, sf), A.sample, A.mito), A, DEFAULT)


@query("quantile_type8", f"with {SQL_B} select sample, round(q, 9) as q from {sql_quantile8(0.37)}")
def quantile_type8(spark, sf):
    return N.quantile8(cells_b(spark, sf), "sample", "mitoRatio", 0.37).select("sample", R9("q"))


SUMMARY_SQL = """ select sample, n_cells, selected as detected_cutoff, selected as selected_cutoff, case when k > 0 then 'significant_largest_drop' else 'quantile_fallback_0.90' end as cutoff_source, k = 0 as fallback_used,
  k::int as significant_interval_count, case when k = 0 then 'low' when k >= 2 and topf >= 0.02 then 'high' when k >= 1 and topf >= 0.01 then 'moderate' else 'low' end as cutoff_confidence,
  high as first_significant_cutoff_high, low as first_significant_cutoff_low, drop_c as largest_drop_cutoff, top as largest_interval_loss, round(topf, 9) as largest_interval_loss_fraction,
  at_selected as retained_cells_at_cutoff, round(fraction_selected, 9) as retention_fraction_at_cutoff, selected >= g.global_cutoff as supports_final_cutoff, recommended >= r.global_cutoff as supports_recommended_final_cutoff"""
for _name, _cells, _cols, _view in (("a", cells_a, A, SQL_A), ("b", cells_b, B, SQL_B)):
    Q[f"sample_summary_{_name}"] = lambda spark, sf, f=_cells, c=_cols: detect(f(spark, sf), c, check=False).summary.select(
        "sample", "n_cells", "detected_cutoff", "selected_cutoff", "cutoff_source", "fallback_used", "significant_interval_count", "cutoff_confidence", "first_significant_cutoff_high", "first_significant_cutoff_low", "largest_drop_cutoff",
        "largest_interval_loss", R9("largest_interval_loss_fraction"), "retained_cells_at_cutoff", R9("retention_fraction_at_cutoff"), "supports_final_cutoff", "supports_recommended_final_cutoff")
    O[f"sample_summary_{_name}"] = chain(_view, DEFAULT, "summary") + SUMMARY_SQL + f" from summ, {sql_support('summ', 'selected', 0.5)} g, {sql_support('summ', 'recommended', 0.5)} r"


@query("recommendation_fields", chain(SQL_A, MANUAL, "summary") + """ select sample, recommended as recommended_cutoff, case when k > 0 then 'reference_guided' else 'fallback' end as recommended_method,
  case when k > 0 then 'reference_guided_first_significant_high' else 'quantile_fallback_0.90' end as recommendation_source, round(selected / 0.05, 9) as reference_ratio,
  case when fraction_recommended < 0.3 or recommended / 0.05 >= 3 then 'review_required' when recommended / 0.05 >= 2 then 'cautious' when k = 0 then 'fallback' else 'standard' end as recommendation_level,
  selected / 0.05 >= 2 as reference_deviation_flag from summ""")
def recommendation_fields(spark, sf):
    return detect(cells_a(spark, sf), A, MANUAL, check=False).summary.select("sample", "recommended_cutoff", "recommended_method", "recommendation_source", R9("reference_ratio"), "recommendation_level", "reference_deviation_flag")


@query("warning_flags", chain(SQL_A, MANUAL, "summary") + """ select sample, coalesce(nullif(concat_ws(';', case when k = 0 then 'fallback_warning' end, case when fraction_selected < 0.3 then 'low_retention_warning' end,
  case when selected / 0.05 >= 3 then 'high_reference_deviation' when selected / 0.05 >= 2 then 'moderate_reference_deviation' end), ''), 'none') as warning_level, k = 0 as has_fallback_warning, coalesce(fraction_selected < 0.3, false) as has_low_retention_warning from summ""")
def warning_flags(spark, sf):
    return detect(cells_a(spark, sf), A, MANUAL, check=False).summary.select("sample", "warning_level", "has_fallback_warning", "has_low_retention_warning")


# -- support and plans ------------------------------------------------------------------------------

SUPPORT = "global_cutoff, support_count::int as support_count, n::int as n_total_samples, required_support::int as required_support, round(support_count / n::double, 9) as support_fraction"


def support_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "global_cutoff", "support_count", "n_total_samples", "required_support", R9("support_fraction"))


@query("support_global", chain(SQL_A, DEFAULT, "summary") + f" select {SUPPORT} from {sql_support('summ', 'selected', 0.5)}")
def support_global(spark, sf):
    return support_columns(detect(cells_a(spark, sf), A, check=False).support)


GROUPED = chain(SQL_A, DEFAULT, "summary") + ", plan as (select s.*, grp from summ s join (select distinct sample, grp from cells) using (sample))"


@query("support_by_group", GROUPED + f" select grp as group_id, {SUPPORT} from {sql_support('plan', 'recommended', 0.3, 'grp')}")
def support_by_group(spark, sf):
    rows = cutoff_plan.build_plan(cells_a(spark, sf), A, check=False).samples
    return support_columns(support.resolved(rows, "sample_cutoff", 0.3, ["group_id"]), "group_id")


PLAN = "sample as sample_id, grp as group_id, recommended as sample_cutoff"


def plan_columns(p: cutoff_plan.Plan) -> DataFrame:
    return p.samples.select("sample_id", "group_id", "sample_cutoff", "applied_cutoff", "final_cutoff", "supports_final_cutoff")


for _s, _sql in (
    ("consensus", f"select {PLAN}, global_cutoff as applied_cutoff, global_cutoff as final_cutoff, recommended >= global_cutoff as supports_final_cutoff from plan, {sql_support('plan', 'recommended', 0.5)}"),
    ("strictest", f"select {PLAN}, c as applied_cutoff, c as final_cutoff, recommended >= c as supports_final_cutoff from plan, (select min(recommended) as c from plan)"),
    ("groupwise", f"select {PLAN}, g.global_cutoff as applied_cutoff, f.c as final_cutoff, recommended >= f.c as supports_final_cutoff from plan join {sql_support('plan', 'recommended', 0.5, 'grp')} g using (grp), (select max(global_cutoff) as c from {sql_support('plan', 'recommended', 0.5, 'grp')}) f"),
):
    Q[f"plan_{_s}"] = lambda spark, sf, s=_s: plan_columns(cutoff_plan.build_plan(cells_a(spark, sf), A, strategy=s, check=False))
    O[f"plan_{_s}"] = f"{GROUPED} {_sql}"


# -- filters and summaries ------------------------------------------------------------------------------

LIMITS = Bounds(min_genes=2, max_genes=6, min_counts=10)
KEEP = "nFeature_RNA between 2 and 6 and nCount_RNA >= 10 and m >= 0 and m <= "


@query("filter_fixed", f"with {SQL_A} select cell_id, sample from cells where {KEEP} 0.2")
def filter_fixed(spark, sf):
    return qc.filter_cells(cells_a(spark, sf), A, LIMITS, 0.2).select("cell_id", "sample")


@query("filter_groupwise", f"{GROUPED} select cell_id, cells.sample from cells join {sql_support('plan', 'recommended', 0.5, 'grp')} g using (grp) where {KEEP} global_cutoff")
def filter_groupwise(spark, sf):
    cells = cells_a(spark, sf)
    plan = cutoff_plan.build_plan(cells, A, strategy="groupwise", check=False)
    return qc.filter_cells(qc.with_cutoffs(cells, A, plan.samples), A, LIMITS, F.col("applied_cutoff")).select("cell_id", "sample")


@query("qc_summary", f"""with {SQL_A}, s as (select 'before' as Stage, * from cells union all select 'after', * from cells where {KEEP} 0.2)
select Stage, count(*) as CellCounts, median(nFeature_RNA)::double as GenesCounts_median, median(nCount_RNA)::double as TranscriptCounts_median, round(median(m), 9) as MitoRatio_median, 0.2 as MitoCutoff, (select count(*) from cells) - count(*) as CellsRemoved, round(count(*) / (select count(*) from cells)::double, 4) as RetentionRate from s group by 1""")
def qc_summary(spark, sf):
    cells = narrowed(cells_a(spark, sf), A.n_feature, A.n_count, A.mito)
    return qc.summary(cells, A, qc.keep(A, LIMITS, F.lit(0.2)), F.lit(0.2)).withColumn("MitoRatio_median", F.round("MitoRatio_median", 9))


@query("split_summary", f"""{GROUPED}, g as {sql_support('plan', 'recommended', 0.5)} select sample, min(grp) as "group", max(global_cutoff) as applied_cutoff, 'consensus' as cutoff_strategy, count(*) as before_cells, count(*) filter ({KEEP} global_cutoff) as after_cells,
  count(*) - count(*) filter ({KEEP} global_cutoff) as cells_removed, round(count(*) filter ({KEEP} global_cutoff) / count(*)::double, 4) as retention_rate from cells, g group by 1""")
def split_summary(spark, sf):
    from siftwell.plans.quality import qc_multi

    return qc_multi(cells_a(spark, sf), A, LIMITS, check=False).tables["split_summary"]


# -- comparison of strategies -------------------------------------------------------------------------------

def sql_scaled(x: str, higher: bool) -> str:
    low, high = f"min({x}) over ()", f"max({x}) over ()"
    return f"case when {low} = {high} then 1 else round(({f'{x} - {low}' if higher else f'{high} - {x}'}) / ({high} - {low}), 4) end"


PANEL = [benchmark.Strategy("fixed_5", max_mito=0.05), benchmark.Strategy("fixed_20", max_mito=0.2), benchmark.Strategy("adaptive_largest_drop", changes={"selection": "largest_drop"}), benchmark.Strategy("adaptive_strictest", cutoff_strategy="strictest"), benchmark.Strategy("adaptive_groupwise", cutoff_strategy="groupwise")]
PANEL_SQL = GROUPED + f""", cuts as (select 0 as ord, 'fixed_5' as strategy, sample, 0.05 as c from plan union all select 1, 'fixed_20', sample, 0.2 from plan
union all select 2, 'adaptive_largest_drop', sample, global_cutoff from plan, {sql_support('plan', 'recommended', 0.5)} union all select 3, 'adaptive_strictest', sample, (select min(recommended) from plan) from plan
union all select 4, 'adaptive_groupwise', sample, global_cutoff from plan join {sql_support('plan', 'recommended', 0.5, 'grp')} g using (grp)),
kept as (select ord, strategy, cells.*, m <= c as k from cells join cuts using (sample)),
rs as (select ord, strategy, sample as level_id, count(*) as before_cells, count(*) filter (k) as after_cells, round(count(*) filter (k) / count(*)::double, 4) as retention_rate from kept group by all),
rg as (select ord, strategy, grp as level_id, count(*) as before_cells, count(*) filter (k) as after_cells, round(count(*) filter (k) / count(*)::double, 4) as retention_rate from kept group by all),
bs as (select a.ord, a.strategy, round(median(m) filter (k), 9) as median_mito_after, count(*) as total_cells_before, count(*) filter (k) as total_cells_after, round(count(*) filter (k) / count(*)::double, 4) as retention_rate,
  (select stddev_samp(retention_rate) / avg(retention_rate) from rs where rs.ord = a.ord) as scv, (select stddev_samp(retention_rate) / avg(retention_rate) from rg where rg.ord = a.ord) as gcv from kept a group by all),
sc as (select *, {sql_scaled("retention_rate", True)} as retention_score, {sql_scaled("median_mito_after", False)} as mito_score, {sql_scaled("scv", False)} as sample_balance_score, {sql_scaled("gcv", False)} as group_balance_score from bs),
so as (select *, round(0.35 * retention_score + 0.25 * mito_score + 0.2 * sample_balance_score + 0.2 * group_balance_score, 4) as overall_score from sc)"""


def panel(spark, sf) -> benchmark.Comparison:
    return benchmark.compare(cells_a(spark, sf), A, PANEL, check=False)


@query("benchmark_summary", PANEL_SQL + " select strategy, total_cells_before, total_cells_after, retention_rate, median_mito_after, round(scv, 9) as sample_retention_cv, round(gcv, 9) as group_retention_cv, round(1 / (1 + scv), 4) as sample_balance from bs")
def benchmark_summary(spark, sf):
    return panel(spark, sf).summary.select("strategy", "total_cells_before", "total_cells_after", "retention_rate", R9("median_mito_after"), R9("sample_retention_cv"), R9("group_retention_cv"), "sample_balance")


@query("benchmark_scores", PANEL_SQL + " select strategy, retention_score, mito_score, sample_balance_score, group_balance_score, overall_score, row_number() over (order by overall_score desc, retention_rate desc, ord)::int as score_rank from so")
def benchmark_scores(spark, sf):
    return panel(spark, sf).scores.select("strategy", "retention_score", "mito_score", "sample_balance_score", "group_balance_score", "overall_score", "score_rank")


@query("benchmark_recommend", PANEL_SQL + " select 'balanced' as scoring_profile, (select strategy from so where strategy like 'adaptive_%' order by overall_score desc, retention_rate desc, ord limit 1) as recommended_adaptive_strategy, (select strategy from so order by overall_score desc, retention_rate desc, ord limit 1) as recommended_strategy")
def benchmark_recommend(spark, sf):
    return panel(spark, sf).recommendation.select("scoring_profile", "recommended_adaptive_strategy", "recommended_strategy")


@query("retention_sample", PANEL_SQL + " select strategy, 'sample' as level_type, level_id, before_cells, after_cells, retention_rate from rs")
def retention_sample(spark, sf):
    return panel(spark, sf).sample_retention


@query("retention_group", PANEL_SQL + " select strategy, 'group' as level_type, level_id, before_cells, after_cells, retention_rate from rg")
def retention_group(spark, sf):
    return panel(spark, sf).group_retention


@query("score_weights", "select * from (values ('balanced', 0.35, 0.25, 0.2, 0.2), ('retention_focused', 0.6, 0.15, 0.15, 0.1), ('stringent_mito', 0.2, 0.55, 0.15, 0.1), ('balance_focused', 0.2, 0.15, 0.35, 0.3)) t(scoring_profile, retention, mito, sample_balance, group_balance)")
def score_weights(spark, sf):
    return benchmark.weights_table(spark, benchmark.profiles()).select("scoring_profile", *(F.round(w, 9).alias(w) for w in benchmark.WEIGHTS))


# -- sensitivity ---------------------------------------------------------------------------------------------

SWEEP = {"bin_width": (0.02,), "alpha": (0.01, 0.05), "min_drop_fraction": (0.005, 0.02), "loss_test": ("mad_zscore", "empirical_tail"), "selection": ("largest_drop", "first_significant_high")}


def sql_sweep() -> str:
    parts, k = [], 0
    for rule in SWEEP["selection"]:
        for test in SWEEP["loss_test"]:
            for m in SWEEP["min_drop_fraction"]:
                for a in SWEEP["alpha"]:
                    k += 1
                    p = Detection(bin_width=0.02, alpha=a, min_drop_fraction=m, loss_test=test, selection=rule)
                    one = chain(SQL_B, p, "summary")
                    parts.append(f"select * from ({one} select sample, 'P{k:03d}' as parameter_id, {a!r}::double as alpha, {m!r}::double as min_drop_fraction, '{test}' as loss_test, '{rule}' as sample_cutoff_method, selected as detected_cutoff, k = 0 as fallback_used, at_selected as retained_cells_at_cutoff, case when k = 0 then 'low' when k >= 2 and topf >= 0.02 then 'high' when k >= 1 and topf >= 0.01 then 'moderate' else 'low' end as cutoff_confidence, g.global_cutoff from summ, {sql_support('summ', 'selected', 0.5)} g)")
    return " union all ".join(parts)


@query("sensitivity_table", sql_sweep())
def sensitivity_table(spark, sf):
    return sensitivity.sweep(cells_b(spark, sf), B, **SWEEP, check=False).table.select("sample", "parameter_id", "alpha", "min_drop_fraction", "loss_test", "sample_cutoff_method", "detected_cutoff", "fallback_used", "retained_cells_at_cutoff", "cutoff_confidence", "global_cutoff")


@query("sensitivity_summary", f"""with t as ({sql_sweep()}) select sample, count(*) as n_parameter_combinations, round(max(b.q), 9) as cutoff_median, round(max(c.q) - max(a.q), 9) as cutoff_iqr, min(detected_cutoff) as cutoff_min, max(detected_cutoff) as cutoff_max, round(avg(fallback_used::int), 9) as fallback_fraction, round(avg((cutoff_confidence = 'low')::int), 9) as low_confidence_fraction
from t join {sql_quantile8(0.25, 't', 'detected_cutoff')} a using (sample) join {sql_quantile8(0.5, 't', 'detected_cutoff')} b using (sample) join {sql_quantile8(0.75, 't', 'detected_cutoff')} c using (sample) group by 1""")
def sensitivity_summary(spark, sf):
    s = sensitivity.sweep(cells_b(spark, sf), B, **SWEEP, check=False).summary
    return s.select("sample", "n_parameter_combinations", R9("cutoff_median"), R9("cutoff_iqr"), "cutoff_min", "cutoff_max", R9("fallback_fraction"), R9("low_confidence_fraction"))


# -- mixing, plot data, constant tables -------------------------------------------------------------------------

MIX = f"with {SQL_A}, c as (select nFeature_RNA as k, grp as l, count(*)::double as n from cells group by all), s as (select *, n / sum(n) over (partition by k) as p from c), e as (select k, sum(n) as size, count(*) as labels, case when count(*) = 1 then 0 else -sum(p * ln(p)) / ln(count(*)) end as h, max(p) as top from s group by 1)"


@query("cluster_entropy", MIX + " select count(*) as cluster_count, round(sum(h * size) / sum(size), 9) as entropy_weighted from e")
def cluster_entropy(spark, sf):
    return clusters.mixing(cells_a(spark, sf), "nFeature_RNA", "grp").select("cluster_count", R9("entropy_weighted"))


@query("dominant_fraction", MIX + " select count(*) as cluster_count, round(sum(top * size) / sum(size), 9) as dominant_fraction from e")
def dominant_fraction(spark, sf):
    return clusters.mixing(cells_a(spark, sf), "nFeature_RNA", "grp").select("cluster_count", R9("dominant_fraction"))


@query("complexity", f"with {SQL_A} select cell_id, round(case when nFeature_RNA > 0 and nCount_RNA > 1 then log10(nFeature_RNA) / log10(nCount_RNA) end, 9) as complexity from cells")
def complexity(spark, sf):
    return plotdata.complexity(cells_a(spark, sf), A).select("cell_id", R9("complexity"))


@query("cutoff_lines", chain(SQL_A, DEFAULT, "summary") + """ select distinct sample, cutoff, cutoff_type from (select sample, selected as cutoff, 'selected_cutoff' as cutoff_type from summ union all select sample, recommended, 'recommended_cutoff' from summ
union all select sample, high, 'first_significant_cutoff_high' from summ union all select sample, drop_c, 'largest_drop_cutoff' from summ) where cutoff is not null""")
def cutoff_lines(spark, sf):
    return plotdata.cutoff_lines(detect(cells_a(spark, sf), A, check=False).summary)


@query("log_fits", f"with {SQL_A} select sample, round(regr_slope(log10(nFeature_RNA), log10(nCount_RNA)), 6) as slope, round(regr_intercept(log10(nFeature_RNA), log10(nCount_RNA)), 6) as intercept, count(*) as cells from cells where nFeature_RNA > 0 and nCount_RNA > 0 group by 1")
def log_fits(spark, sf):
    return plotdata.fits(cells_a(spark, sf), "sample", A).select("sample", R6("slope"), R6("intercept"), "cells")


@query("gene_density", f"with {SQL_A} select sample, floor(log10(nFeature_RNA) * 50)::bigint as bin, count(*) as cells from cells where nFeature_RNA > 0 group by all")
def gene_density(spark, sf):
    return plotdata.density(cells_a(spark, sf), "sample", "nFeature_RNA").drop("low")


@query("reference_lookup", "select * from (values ('mouse', 'global', 0.05)) t(species, tissue, reference_cutoff)")
def reference_lookup(spark, sf):
    return tables.reference_cutoffs(spark, "MOUSE", "liver").select("species", "tissue", "reference_cutoff")


@query("manifest_filter", "select * from (values ('GSE135893', 'main_text'), ('GSE136831', 'independent_validation'), ('GSE157996', 'independent_validation'), ('GSE159354', 'independent_validation')) t(dataset_id, role)")
def manifest_filter(spark, sf):
    return tables.manifest(spark, species=["human"], tissue=["lung"]).select("dataset_id", "role")


# features of the species presets, with what each stage should find
GENES = ["MT-ND1", "mt-Co1", "mt-Nd1", "ATP6", "ND1", "ACTB", "MTOR", "Gapdh", "MT-CYB", "NOTMT-1"]


def genes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in GENES], "feature string")


@query("mito_preset_human", "select unnest(['MT-ND1', 'MT-CYB']) as feature, 'feature_names' as source")
def mito_preset_human(spark, sf):
    return features.mito_features(genes(spark), species="human")


@query("mito_preset_mouse", "select unnest(['mt-Co1', 'mt-Nd1', 'MT-ND1', 'MT-CYB']) as feature, 'feature_names' as source")
def mito_preset_mouse(spark, sf):
    return features.mito_features(genes(spark), species="mouse")


@query("mito_preset_pig", "select unnest(['mt-Co1', 'mt-Nd1', 'MT-ND1', 'MT-CYB', 'ATP6', 'ND1']) as feature, 'feature_names' as source")
def mito_preset_pig(spark, sf):
    return features.mito_features(genes(spark), species="pig")


@query("cutoff_histogram", chain(SQL_A, DEFAULT, "summary") + " select sample, least(floor(selected * 30) + 1, 30)::bigint as bin, count(*) as n from summ where selected is not null group by 1, 2")
def cutoff_histogram(spark, sf):
    return plotdata.cutoff_histogram(detect(cells_a(spark, sf), A, DEFAULT, check=False).summary)


@query("parameter_labels", "select '0.02 | 0.05 | 0.01 | mad_zscore | largest_drop' as label")
def parameter_labels(spark, sf):
    rows = spark.createDataFrame([(0.02, 0.05, 0.01, "mad_zscore", "largest_drop")], "bin_width double, alpha double, min_drop_fraction double, loss_test string, sample_cutoff_method string")
    return plotdata.parameter_labels(rows).select("label")


@query("ordered_strategies", "select l_returnflag as strategy, l_linestatus as cutoff_strategy, total_cells_after, row_number() over (order by total_cells_after, l_returnflag, l_linestatus)::int as position from (select l_returnflag, l_linestatus, count(*) as total_cells_after from lineitem group by 1, 2)")
def ordered_strategies(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("cutoff_strategy")).agg(F.count("*").alias("total_cells_after"))
    return plotdata.ordered_strategies(rows.withColumn("ord", F.concat("strategy", "cutoff_strategy")))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Sample cutoffs of view B."""
    return detect(cells_b(spark, sf), B).summary
