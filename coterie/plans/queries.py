"""Registered queries: every operator over the driver's tables, with its SQL where SQL can say it."""
from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import Future
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie import functions as fn
from coterie.operators import behaviour, calibration, cases, dossier, drift, events, gates, graph, models, neighbourhood
from coterie.operators import quality, rings, screening, uncertainty
from coterie.operators.asof import timed, unpivot_entities
from coterie.plans import oracles as o
from coterie.plans.matrix import FEATURE_SETS, attach_labels, feature_matrix, matrix_profile, project_contract
from coterie.plans.oracles import ENT, TIED, TXN, _q
from coterie.schema import FEATURE_CONTRACT
from coterie.sources import tables
from coterie.sources.adapters import as_transactions, table, tied_transactions, transactions
from coterie.sources.scratch import materialise, scratch_path
from coterie.streaming import jobs
from coterie.streaming.history import HistoryStore, needed_history

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums run in another order in every engine.

    The offset moves exact halves (an average over 32 rows ends in a 5) off the rounding edge.
    """
    return df.select(*[F.round(F.col(c) + F.lit(1e-9), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = (lambda spark, d: tidy(f(spark, d)), sql)
        return f
    return add


def _txn(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d)


def _labels(txn: DataFrame) -> DataFrame:
    return txn.select("order_id", "is_abuse", "ring_id", "abuse_type", "loss_amount")


def _scored(txn: DataFrame) -> DataFrame:
    return txn.withColumn("calibrated_score", F.col("predicted_score")).withColumn(
        "fallback_applied", (F.col("retry_count") == 1) & (F.col("order_id") % 50 == 0)).withColumn(
        "alert", F.col("predicted_score") >= F.lit(0.5))


def _log(txn: DataFrame) -> DataFrame:
    return _scored(txn).withColumn("latency_ms", F.col("amount")).withColumn("action", F.lit("ALLOW")).withColumn(
        "scoring_failed", F.col("order_id") % 997 == 0)


LOG = """
log as (select *, amount as latency_ms, retry_count = 1 and order_id % 50 = 0 as fallback_applied, predicted_score >= 0.5 as alert,
  'ALLOW' as action, order_id % 997 = 0 as scoring_failed from txn)"""

SPLIT = """
cuts as (select list(t order by t, order_id) as ts, count(*) as n from txn),
cut as (select ts[greatest(0, cast(floor(n * 0.7) as bigint) - 1) + 1] as a, ts[greatest(0, cast(floor(n * 0.85) as bigint) - 1) + 1] as b from cuts),
sp as (select txn.*, case when t <= a then 'train' when t <= b then 'validation' else 'test' end as split from txn, cut)"""

# ---- sources, scalar work -----------------------------------------------------------------------


@register("s7_read_parquet", "select o_orderkey as order_id, o_totalprice as amount, o_orderpriority as merchant_category from orders")
def _(spark, d):
    return tables.read_parquet(spark, f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("merchant_category"))


MESSY_SQL = """
messy as (select event_id, case event_id % 9 when 0 then ' NaN ' when 1 then '' when 2 then 'null' when 3 then '0' when 4 then '0.0'
  when 5 then ' ' || event_type when 6 then 'None' when 7 then 'nan' else event_type end as v from events)"""


@register("p1_clean", _q([MESSY_SQL], """select event_id, case when lower(trim(v)) in ('', 'nan', 'none', 'null', '<na>', '0', '0.0') then null
  else trim(v) end as cleaned, case when v in ('', 'nan', 'None') then null else v end as raw from messy"""))
def _(spark, d):
    k = F.col("event_id") % 9
    v = (F.when(k == 0, " NaN ").when(k == 1, "").when(k == 2, "null").when(k == 3, "0").when(k == 4, "0.0")
         .when(k == 5, F.concat(F.lit(" "), "event_type")).when(k == 6, "None").when(k == 7, "nan").otherwise(F.col("event_type")))
    return table(spark, d, "events").select("event_id", v.alias("v")).select(
        "event_id", fn.clean_entity("v").alias("cleaned"), fn.raw_entity("v").alias("raw"))


@register("p2_validate", """select event_id as order_id, list_sort(list_filter([
    case when event_id % 11 = 0 then 'customer_id must be a non-empty string' end,
    case when value < 5 then 'amount must be a non-negative number' end,
    case when event_id % 13 = 0 then 'event_time must be a valid ISO-8601 timestamp' end], lambda x: x is not null))::varchar as errors
  from events where event_id % 11 = 0 or value < 5 or event_id % 13 = 0""")
def _(spark, d):
    ev = table(spark, d, "events").select(
        F.col("event_id").alias("order_id"), F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string")).otherwise("").alias("customer_id"),
        (F.col("value") - 5).alias("amount"), F.when(F.col("event_id") % 13 == 0, "yesterday").otherwise(F.col("ts").cast("string")).alias("event_time"))
    _, bad = screening.validate_transactions(ev)
    return bad.select("order_id", F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("errors"), lambda e: e), ", "), F.lit("]")).alias("errors"))


@register("p3_normalise", """select cast(event_id as varchar) as order_id, cast(user_id as varchar) as customer_id, epoch_us(ts) as t, value as amount,
  'INR' as currency, event_type as merchant_category, 0.0::double as retry_count, '' as device_id from events""")
def _(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
                                          F.concat(F.col("ts").cast("string"), F.lit("+00:00")).alias("event_time"),
                                          F.col("value").alias("amount"), F.col("event_type").alias("merchant_category"))
    return timed(screening.normalise_transactions(ev)).select(
        "order_id", "customer_id", "t", "amount", "currency", "merchant_category", "retry_count", "device_id")


@register("p4_mask", """select event_id, 'id_' || substr(sha256(cast(user_id as varchar)), 1, 10) as masked,
  'ALERT-' || substr(sha256(cast(event_id as varchar)), 1, 16) as alert_id, 'Customer ••' || right(cast(user_id as varchar), 2) as shown from events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", fn.mask_identifier("user_id").alias("masked"),
                                            fn.stable_id("ALERT", "event_id").alias("alert_id"), fn.mask_tail("user_id").alias("shown"))


@register("p5_tiers", _q([TXN, LOG], """select order_id,
  case when predicted_score >= 0.8 then 'CRITICAL_RISK' when predicted_score >= 0.5 then 'HIGH_RISK' when predicted_score >= 0.3 then 'MEDIUM_RISK' else 'LOW_RISK' end as tier,
  case when predicted_score >= 0.9 then 'CRITICAL' when predicted_score >= 0.75 or (predicted_score >= 0.5 and retry_count + 1 >= 2) then 'HIGH'
    when predicted_score >= 0.5 then 'MEDIUM' else 'LOW' end as severity,
  case when fallback_applied then 'FALLBACK' when predicted_score < 0.3 then 'NORMAL' when predicted_score < 0.5 then 'WATCHING' else 'ALERT' end as status
  from log"""))
def _(spark, d):
    return _log(_txn(spark, d)).select(
        "order_id", fn.risk_tier("predicted_score").alias("tier"),
        fn.case_severity("predicted_score", F.lit(1), F.col("retry_count") + 1, F.lit(0)).alias("severity"),
        fn.monitor_status("predicted_score", "fallback_applied").alias("status"))


@register("p9_contract", _q([TXN], "select order_id, amount, 0.0::double as subgraph_new_nodes_1h from txn", ["amount"]))
def _(spark, d):
    return project_contract(_txn(spark, d).select("order_id", "amount"), ["amount", "subgraph_new_nodes_1h"], missing="zero")


@register("p11_explain", _q([TXN, ENT, o.CUST, o.OWN, f"fb as ({o._baseline_body()})", """
cells as (select order_id, unnest([{'feature': 'prior_order_count', 'value': prior_order_count}, {'feature': 'prior_spend', 'value': prior_spend},
  {'feature': 'prior_avg_amount', 'value': prior_avg_amount}, {'feature': 'prior_amount_std', 'value': prior_amount_std},
  {'feature': 'velocity_per_day', 'value': velocity_per_day}, {'feature': 'hours_since_prior', 'value': hours_since_prior},
  {'feature': 'amount', 'value': amount}, {'feature': 'amount_vs_prior_avg', 'value': amount_vs_prior_avg},
  {'feature': 'account_age_days', 'value': account_age_days}, {'feature': 'prior_category_count', 'value': prior_category_count},
  {'feature': 'retry_count', 'value': retry_count}]) as s from fb)"""],
    """select * from (select order_id, row_number() over (partition by order_id order by round(abs(s.value), 6) desc, s.feature) as rank, s.feature as feature,
  s.value as value from cells) where rank <= 6""", ["value"]))
def _(spark, d):
    fb = tidy(behaviour.baseline_features(_txn(spark, d)))
    return screening.explain_top_signals(fb)


@register("p12_feed", _q([TXN, LOG, """
f as (select *, row_number() over (order by t) as ix,
  row_number() over (partition by device_id order by t) > 1 as sd, row_number() over (partition by address_id order by t) > 1 as sa,
  row_number() over (partition by ip_id order by t) > 1 as si, row_number() over (partition by payment_id order by t) > 1 as sp from log)"""],
    """select order_id, strftime(event_time, '%H:%M:%S') as time, 'Customer ••' || right(cast(customer_id as varchar), 2) as customer, amount,
  predicted_score as risk, case when fallback_applied then 'FALLBACK' when predicted_score < 0.3 then 'NORMAL' when predicted_score < 0.5 then 'WATCHING' else 'ALERT' end as status,
  concat_ws(',', case when sd then 'device' end, case when sa then 'address' end, case when si then 'IP' end, case when sp then 'payment' end) as shared,
  case when fallback_applied then 'Scored on the fallback path' when predicted_score >= 0.5 then 'Risk crossed review threshold' when ix = 1 then 'First event, limited history'
    when sd::int + sa::int + si::int + sp::int >= 2 then 'Network connectivity increasing'
    when sd or sa or si or sp then 'Shared ' || case when sd then 'device' when sa then 'address' when si then 'IP' else 'payment' end || ' relationship observed'
    when predicted_score >= 0.3 then 'Elevated score, below review threshold' else 'Scored' end as observation
  from f""", ["amount", "risk"]))
def _(spark, d):
    return screening.feed_rows(_log(_txn(spark, d)))


@register("p15_unpivot", _q([TXN, ENT], "select order_id, etype, value from ent"))
def _(spark, d):
    return unpivot_entities(timed(_txn(spark, d))).select("order_id", "etype", "value")


_P10 = FEATURE_CONTRACT[:37]


@register("p10_manifest", "with m as (" + o.matrix_sql(FEATURE_SETS["combined"]) + "), p as (" + " union all ".join(
    f"select '{c}' as feature, '{'baseline' if k < 19 else 'graph'}' as source, 1 - count({c}) / count(*) as null_share, min({c})::double as least, max({c})::double as greatest from m"
    for k, c in enumerate(_P10)) + ") select feature, source, 'strictly earlier events only' as as_of_rule, true as target_independent, null_share::double as null_share, "
    "round(least, 4) as least, round(greatest, 4) as greatest from p")
def _(spark, d):
    out = matrix_profile(feature_matrix(_txn(spark, d), "combined"), "combined")
    return out.withColumn("least", F.round("least", 4)).withColumn("greatest", F.round("greatest", 4))


# ---- feature families ---------------------------------------------------------------------------

FAMILIES = {
    "fb_baseline": ("baseline", behaviour.baseline_features), "fg_graph": ("graph", neighbourhood.graph_features),
    "ft_temporal": ("temporal", behaviour.temporal_velocity_features),
    "fc_customer_relative": ("customer_relative", behaviour.customer_relative_features),
    "fh_two_hop": ("two_hop", neighbourhood.two_hop_features), "fs_subgraph": ("subgraph", neighbourhood.subgraph_features),
}
for _name, (_family, _f) in FAMILIES.items():
    register(_name, o.family_sql(_family))(lambda spark, d, f=_f: f(_txn(spark, d)))

for _k, (_name, _families) in enumerate([(n, f) for n, f in FEATURE_SETS.items() if n != "baseline"], start=1):
    register(f"fx{_k}_{_name}", o.matrix_sql(_families))(lambda spark, d, n=_name: feature_matrix(_txn(spark, d), n))

# day-granular orders: thousands of ties, every window edge hit exactly


@register("ties_sequence", _q([TIED, """
r as (select a.order_id,
  count_if(b.t > a.t - 86400000000) as n24, count_if(b.t > a.t - 604800000000) as n7, count_if(b.t > a.t - 2592000000000) as n30,
  sum(case when b.t > a.t - 2592000000000 then b.amount end) as spend, count(distinct b.merchant_category) as categories
  from txn a join txn b on a.customer_id = b.customer_id and (b.t < a.t or (b.t = a.t and b.order_id < a.order_id)) group by all)"""],
    """select order_id, cast(coalesce(n24, 0) as double) as customer_order_count_24h, cast(coalesce(n7, 0) as double) as customer_order_count_7d,
  cast(coalesce(n30, 0) as double) as customer_order_count_30d, coalesce(spend, 0) as prior_spend, cast(coalesce(categories, 0) as double) as prior_category_count
  from txn left join r using (order_id)""", ["prior_spend"]))
def _(spark, d):
    base = behaviour.customer_level(tied_transactions(spark, d))
    return base.select("order_id", F.col("n_24h").alias("customer_order_count_24h"), F.col("n_7d").alias("customer_order_count_7d"),
                       F.col("n_30d").alias("customer_order_count_30d"), F.col("spend").alias("prior_spend"),
                       F.col("categories").alias("prior_category_count"))


@register("ties_strict_shared", _q([TIED, ENT, """
r as (select a.order_id, a.etype, count(distinct b.customer_id) as ever,
  count(distinct case when b.t > a.t - 604800000000 and b.customer_id <> a.customer_id then b.customer_id end) as peers
  from ent a join ent b on a.etype = b.etype and a.value = b.value and b.t < a.t group by all)"""],
    """select e.order_id, e.etype, cast(coalesce(ever, 0) as double) as people_ever, cast(coalesce(peers, 0) as double) as peers_7d
  from ent e left join r on r.order_id = e.order_id and r.etype = e.etype"""))
def _(spark, d):
    return behaviour.shared_level(tied_transactions(spark, d), ties="strict")


@register("p16_labels", _q([TXN], "select order_id, is_abuse as y, amount from txn", ["amount"]))
def _(spark, d):
    t = _txn(spark, d)
    return attach_labels(t.select("order_id", "amount"), _labels(t))


# ---- splits and event metrics -------------------------------------------------------------------

@register("t1_split", _q([TXN, SPLIT], "select order_id, split from sp"))
def _(spark, d):
    return events.split_by_time(_txn(spark, d)).select("order_id", "split")


@register("t2_boundaries", _q([TXN], """select case when event_time <= timestamp '2024-01-10' then 'train' when event_time <= timestamp '2024-01-15' then 'validation'
  when event_time <= timestamp '2024-01-20' then 'previous_test' else 'holdout' end as split, count(*) as orders from txn group by all"""))
def _(spark, d):
    day = 86_400_000_000
    t0 = 1_704_067_200_000_000  # 2024-01-01
    return events.split_by_boundaries(_txn(spark, d), t0 + 9 * day, t0 + 14 * day, t0 + 19 * day).groupBy("split").agg(F.count("*").alias("orders"))


@register("t3_windows", _q([TIED, "r as (select *, row_number() over (order by t, order_id) - 1 as ix, count(*) over () as n from txn)"],
    "select order_id, cast(least(ix // (n // 3), 2) + 1 as int) as window_no from r"))
def _(spark, d):
    return events.rolling_windows(tied_transactions(spark, d), 3).select("order_id", "window_no")


CONF = """select count_if(hit and bad) as tp, count_if(hit and not bad) as fp, count_if(not hit and bad) as fn, count_if(not hit and not bad) as tn, count(*) as orders
  from (select predicted_score >= 0.5 as hit, is_abuse = 1 as bad from txn)"""


@register("e1_confusion", _q([TXN, f"c as ({CONF})"], """select *, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1,
  fp / (fp + tn) as false_positive_rate, fn / (fn + tp) as false_negative_rate, tp + fp as alerts from c""",
    ["precision", "recall", "f1", "false_positive_rate", "false_negative_rate"]))
def _(spark, d):
    return events.confusion_metrics(_txn(spark, d))


THRESH = """
th as (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as threshold),
tt as (select threshold, count_if(hit and bad) as tp, count_if(hit and not bad) as fp, count_if(not hit and bad) as fn, count(*) as n,
  coalesce(sum(case when not hit and bad then loss_amount end), 0) as missed
  from (select threshold, predicted_score >= threshold as hit, is_abuse = 1 as bad, loss_amount from txn, th) group by all),
table_ as (select threshold, tp + fp as alerts, (tp + fp) / n as alert_rate, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1,
  missed + fp * 12.0::double as expected_loss, tp, fp, fn from tt)"""


@register("e2_threshold_table", _q([TXN, THRESH], "select * from table_", ["alert_rate", "precision", "recall", "f1", "expected_loss"]))
def _(spark, d):
    return events.threshold_table(_txn(spark, d))


@register("e2b_choose_threshold", _q([TXN, THRESH], "select threshold, expected_loss from table_ order by expected_loss, threshold limit 1", ["expected_loss"]))
def _(spark, d):
    return events.choose_threshold(events.threshold_table(_txn(spark, d)))


LADDER = """
steps as (select predicted_score as s, count(*) as n, sum(is_abuse) as pos from txn group by all),
cum as (select *, sum(n) over w as cn, sum(pos) over w as cp, sum(pos) over () as p, sum(n) over () as tot from steps window w as (order by s desc)),
lad as (select *, coalesce(lag(cp / cn) over (order by s desc), 1.0) as prev_prec from cum)"""


@register("e3_average_precision", _q([TXN, LADDER], "select sum(pos / p * cp / cn) as average_precision from lad", ["average_precision"]))
def _(spark, d):
    return events.average_precision(_txn(spark, d))


@register("e4_pr_auc_trapezoid", _q([TXN, LADDER], "select sum(pos / p * (cp / cn + prev_prec) / 2) as pr_auc_trapezoid from lad", ["pr_auc_trapezoid"]))
def _(spark, d):
    return events.pr_auc_trapezoid(_txn(spark, d))


@register("e5_roc_auc", _q([TXN, LADDER], "select sum((n - pos) * ((cp - pos) + pos / 2)) / (max(p) * (max(tot) - max(p))) as roc_auc from lad", ["roc_auc"]))
def _(spark, d):
    return events.roc_auc(_txn(spark, d))


@register("e6_losses", _q([TXN], """select 'standard' as formula, sum(case when not hit and bad then loss_amount else 0 end) + count_if(hit and not bad) * 12.0::double as expected_loss from (select *, predicted_score >= 0.5 as hit, is_abuse = 1 as bad from txn)
  union all select 'bootstrap', sum(case when not hit and bad then loss_amount else 0 end) + count_if(hit and not bad) * 10.0::double + count_if(hit and bad) * 2.0::double from (select *, predicted_score >= 0.5 as hit, is_abuse = 1 as bad from txn)
  union all select 'friction', sum(case when not hit and bad then amount else 0 end) + sum(case when hit and not bad then amount else 0 end) * 0.05::double from (select *, predicted_score >= 0.5 as hit, is_abuse = 1 as bad from txn)""", ["expected_loss"]))
def _(spark, d):
    t = _txn(spark, d)
    out = None
    for f in ("standard", "bootstrap", "friction"):
        row = events.expected_loss(t, formula=f).withColumn("formula", F.lit(f))
        out = row if out is None else out.unionByName(row)
    return out


@register("e7_error_audit", _q([TXN], """select case when hit and bad then 'TP' when hit then 'FP' when bad then 'FN' else 'TN' end as outcome, count(*) as orders,
  sum(amount) as exposure, sum(case when hit and not bad then amount * 0.05::double else 0 end) as friction
  from (select *, predicted_score >= 0.5 as hit, is_abuse = 1 as bad from txn) group by all""", ["exposure", "friction"]))
def _(spark, d):
    return events.error_audit(_txn(spark, d))


MEMBERS = """
mem as (select ring_id, customer_id, max(predicted_score) as best from txn where is_abuse = 1 and ring_id is not null group by all)"""
# customers linked through shared values among flagged orders, closed by recursion
def _closure(src: str) -> str:
    return f"""
fv as (select distinct customer_id as c, etype, value from ent join {src} using (order_id)),
nb as (select distinct a.c, b.c as d from fv a join fv b on a.etype = b.etype and a.value = b.value),
walk as (select c, c as d from fv union select w.c, nb.d from walk w join nb on nb.c = w.d),
root as (select c, min(d) as r from walk group by c)"""


_GRID = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]"
SENS = f"""
th as (select unnest({_GRID}) as threshold),
fv as (select distinct threshold, ent.customer_id as c, etype, value from th join txn on predicted_score >= threshold join ent using (order_id)),
nb as (select distinct a.threshold, a.c, b.c as d from fv a join fv b on a.threshold = b.threshold and a.etype = b.etype and a.value = b.value),
walk as (select distinct threshold, c, c as d from fv union select w.threshold, w.c, nb.d from walk w join nb on nb.threshold = w.threshold and nb.c = w.d),
root as (select threshold, c, min(d) as r from walk group by all),
nc as (select threshold, count(distinct r) as n from root group by all),
cm as (select threshold, count_if(hit and bad) as tp, count_if(hit and not bad) as fp, count_if(not hit and bad) as fn, sum(case when not hit and bad then loss_amount else 0 end) as missed,
  sum(case when hit and bad and ring_id is not null then loss_amount else 0 end) as captured, sum(case when bad and ring_id is not null then loss_amount else 0 end) as total
  from (select threshold, predicted_score >= threshold as hit, is_abuse = 1 as bad, loss_amount, ring_id from txn, th) group by all),
rc as (select threshold, avg(cast(cov > 0 as double)) as a, avg(cast(cov >= 0.5 as double)) as c from (
  select threshold, ring_id, count(distinct case when predicted_score >= threshold then customer_id end) / count(distinct customer_id) as cov from txn, th
  where is_abuse = 1 and ring_id is not null group by all) group by all)"""


@register("e8_threshold_sensitivity", _q([TXN, ENT, SENS], """select threshold, threshold = 0.5 as is_operating_point, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
  tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1, fp as false_positives, tp as true_positives, missed + fp * 12.0::double as expected_loss, tp + fp as total_alerts,
  (tp + fp) / 30.0::double as daily_alerts, coalesce(n, 0) as consolidated_cases, coalesce(n, 0) / 30.0::double as daily_cases, captured as exposure_captured,
  case when total > 0 then captured / total * 100 else 0 end as exposure_captured_pct, captured / greatest(1, coalesce(n, 0)) as exposure_per_case, a as rule_a_recall, c as rule_c_recall
  from cm join rc using (threshold) left join nc using (threshold)""", ["precision", "recall", "f1", "expected_loss", "daily_alerts", "daily_cases", "exposure_captured",
    "exposure_captured_pct", "exposure_per_case", "rule_a_recall", "rule_c_recall"]).replace("with ", "with recursive ", 1))
def _(spark, d):
    return rings.threshold_sensitivity(_txn(spark, d), days=30.0)


def _two_models(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    other = (((F.col("order_id") * 104_729) % 1013).cast("double") / F.lit(1013.0) * F.lit(0.55)
             + F.when(F.col("is_abuse") == 1, F.lit(0.4)).otherwise(F.lit(0.0)))
    return t, t.withColumn("predicted_score", other)


TXN_B = """
txnb as (select * replace (cast((order_id * 104729) % 1013 as double) / 1013::double * 0.55::double
  + case when is_abuse = 1 then 0.4::double else 0::double end as predicted_score) from txn)"""


ROLLING = """
r as (select order_id, cast(least((row_number() over (order by t, order_id) - 1) // (count(*) over () // 3), 2) + 1 as int) as window_no from txn),
both_ as (select *, 'a' as model, 0.5 as tau from txn union all select *, 'b', 0.6 from txnb),
x as (select both_.*, window_no, predicted_score >= tau as hit from both_ join r using (order_id)),
ladder as (select window_no, model, predicted_score as s, count(*) as n, sum(is_abuse) as pos from x group by all),
ap as (select window_no, model, sum(pos * cp / cn) / sum(pos) as average_precision from
  (select *, sum(n) over w as cn, sum(pos) over w as cp from ladder window w as (partition by window_no, model order by s desc)) group by all),
rg as (select window_no, model, ring_id, count(distinct case when hit then customer_id end) / count(distinct customer_id) as cov from x
  where is_abuse = 1 and ring_id is not null group by all),
rr as (select window_no, model, avg(cast(cov > 0 as double)) as rule_a_recall, avg(cast(cov >= 0.5 as double)) as rule_c_recall from rg group by all),
cc as (select window_no, model, count(*) as orders, count_if(is_abuse = 1) as abuse_events, count_if(hit and is_abuse = 1) as tp,
  count_if(hit and is_abuse = 0) as false_positives from x group by all),
roll as (select window_no, model, orders, abuse_events, average_precision, case when tp + false_positives > 0 then tp / (tp + false_positives) else 0 end as precision, tp / abuse_events as recall,
  2 * tp / (tp + false_positives + abuse_events) as f1, false_positives, rule_a_recall, rule_c_recall
  from cc join ap using (window_no, model) join rr using (window_no, model))"""


@register("e9_rolling_metrics", _q([TXN, TXN_B, ROLLING], "select * from roll", ["average_precision", "precision", "recall", "f1", "rule_a_recall", "rule_c_recall"]))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    return rings.rolling_window_metrics(_both_models(a, b), {"a": 0.5, "b": 0.6})


def _both_models(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("model", F.lit("a")).unionByName(b.withColumn("model", F.lit("b")))


@register("e9_rolling_deltas", _q([TXN, TXN_B, ROLLING], """select a.window_no, b.precision - a.precision as delta_precision, b.false_positives - a.false_positives as delta_fp
  from roll a join roll b using (window_no) where a.model = 'a' and b.model = 'b'""", ["delta_precision"]))
def _(spark, d):
    metrics = rings.rolling_window_metrics(_both_models(*_two_models(_txn(spark, d))), {"a": 0.5, "b": 0.6})
    return rings.rolling_deltas(metrics, "a", "b")


@register("e10_delayed_labels", _q([TXN, "m as (select * from txn where order_id % 3 <> 0)", LADDER.replace("from txn", "from m"), f"c as ({CONF.replace('from txn', 'from m')})",
    """money as (select sum(case when bad then amount else 0 end) as abuse_exposure, sum(case when bad and hit then amount else 0 end) as captured_exposure,
  sum(case when bad and not hit then amount else 0 end) as missed_exposure, sum(case when hit and not bad then amount else 0 end) as fp_friction
  from (select *, predicted_score >= 0.5 as hit, is_abuse = 1 as bad from m)),
rk as (select sum(pos / p * (cp / cn + prev_prec) / 2) as pr_auc, sum((n - pos) * ((cp - pos) + pos / 2)) / (max(p) * (max(tot) - max(p))) as roc_auc from lad)"""],
    """select 'EVALUATED_WITH_LABELS' as evaluation_status, orders as matched_orders, tp, fp, fn, tn, tp / (tp + fp) as precision, tp / (tp + fn) as recall,
  2 * tp / (2 * tp + fp + fn) as f1, pr_auc, roc_auc, fp / (fp + tn) as false_positive_rate, fn / (fn + tp) as false_negative_rate, abuse_exposure, captured_exposure,
  captured_exposure / abuse_exposure * 100 as captured_exposure_pct, missed_exposure, fp_friction from c, money, rk""",
    ["precision", "recall", "f1", "pr_auc", "roc_auc", "false_positive_rate", "false_negative_rate", "abuse_exposure", "captured_exposure", "captured_exposure_pct", "missed_exposure", "fp_friction"]))
def _(spark, d):
    t = _txn(spark, d)
    return events.delayed_label_evaluation(_scored(t).select("order_id", "calibrated_score"), t.filter(F.col("order_id") % 3 != 0).select("order_id", "is_abuse"),
                                           t.select("order_id", "amount"))


def _cohort(name: str, key: str, other: str) -> str:
    return f"""select '{name}' as cohort, count(*) as orders, count_if(fp) as false_positives from g where {key} in
      (select {key} from g group by {key} having count(distinct {other}) > 1)"""


@register("e11_cohorts", _q([TXN, "g as (select *, predicted_score >= 0.5 as fp from txn where is_abuse = 0)", "u as (" + " union all ".join([
    _cohort("shared_address", "address_id", "customer_id"), _cohort("shared_device", "device_id", "customer_id"), _cohort("shared_ip", "ip_id", "customer_id"),
    _cohort("multi_card", "customer_id", "payment_id"), _cohort("shared_card", "payment_id", "customer_id"),
    "select 'all_legitimate', count(*), count_if(fp) from g"]) + ")"],
    "select *, case when orders > 0 then false_positives / orders else 0 end as fp_rate from u", ["fp_rate"]))
def _(spark, d):
    return events.cohort_fp_rates(_txn(spark, d))


@register("e12_model_summary", _q([TXN, TXN_B, """
runs as (select model, run, count_if(hit and is_abuse = 1) / greatest(1, count_if(hit)) as precision, count_if(hit and is_abuse = 1) / greatest(1, count_if(is_abuse = 1)) as recall
  from (select 'a' as model, order_id % 5 as run, predicted_score >= 0.5 as hit, is_abuse from txn union all
        select 'b', order_id % 5, predicted_score >= 0.5, is_abuse from txnb) group by all)"""],
    """select model, count(*) as runs, avg(precision) as precision_mean, coalesce(stddev_samp(precision), 0) as precision_std, min(precision) as precision_min, max(precision) as precision_max,
  avg(recall) as recall_mean, coalesce(stddev_samp(recall), 0) as recall_std, min(recall) as recall_min, max(recall) as recall_max from runs group by all""",
    [f"{m}_{s}" for m in ("precision", "recall") for s in ("mean", "std", "min", "max")]))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    both = a.withColumn("model", F.lit("a")).unionByName(b.withColumn("model", F.lit("b"))).withColumn("run", F.col("order_id") % 5)
    return events.model_summary_over_runs(events.confusion_metrics(both, by=["model", "run"]), ["precision", "recall"])


# ---- rings and queues ---------------------------------------------------------------------------

RING = """
ab as (select *, predicted_score >= 0.5 as hit from txn where is_abuse = 1 and ring_id is not null),
pr as (select ring_id, arg_min(abuse_type, t) as ring_type, count(*) as test_orders, count_if(hit) as flagged_orders, count(distinct customer_id) as test_members,
  count(distinct case when hit then customer_id end) as flagged_members, sum(loss_amount) as exposure, coalesce(sum(case when hit then loss_amount end), 0) as exposure_captured,
  (min(case when hit then t end) - min(t)) / 3.6e9::double as latency_hours from ab group by ring_id),
per_ring as (select ring_id, ring_type, test_orders, flagged_orders, test_members, flagged_members, flagged_members / test_members as coverage,
  flagged_members >= 1 as detected_rule_a, flagged_members / test_members >= 0.2 as detected_rule_b, flagged_members / test_members >= 0.5 as detected_rule_c,
  exposure, exposure_captured, case when exposure > 0 then exposure_captured / exposure * 100 else 0 end as exposure_captured_pct, latency_hours from pr)"""
_RING_D = ["coverage", "exposure", "exposure_captured", "exposure_captured_pct", "latency_hours"]


@register("r1_per_ring", _q([TXN, RING], "select * from per_ring", _RING_D))
def _(spark, d):
    return rings.per_ring(_txn(spark, d))


_SUMMARY = """select 0.5::double as threshold, count(*) as total_test_rings, cast(sum(test_orders) as bigint) as total_test_abuse_orders, sum(exposure) as total_test_exposure,
  count_if(detected_rule_a) as rule_a_detected_count, count_if(detected_rule_b) as rule_b_detected_count, count_if(detected_rule_c) as rule_c_detected_count,
  avg(cast(detected_rule_a as double)) as rule_a_recall, avg(cast(detected_rule_b as double)) as rule_b_recall, avg(cast(detected_rule_c as double)) as rule_c_recall,
  avg(coverage) as mean_member_coverage, median(coverage) as median_member_coverage, coalesce(stddev_samp(coverage), 0) as std_member_coverage,
  min(coverage) as min_member_coverage, max(coverage) as max_member_coverage, sum(exposure_captured) as total_exposure_captured,
  sum(exposure_captured) / sum(exposure) * 100 as exposure_captured_pct, avg(latency_hours) as latency_mean_hours, median(latency_hours) as latency_median_hours,
  min(latency_hours) as latency_min_hours, max(latency_hours) as latency_max_hours,
  case when count(latency_hours) = 1 then 0 else stddev_samp(latency_hours) end as latency_std_hours, count(latency_hours) as latency_count from per_ring"""
_SUMMARY_D = ["total_test_exposure", "rule_a_recall", "rule_b_recall", "rule_c_recall", "mean_member_coverage", "median_member_coverage", "std_member_coverage",
              "min_member_coverage", "max_member_coverage", "total_exposure_captured", "exposure_captured_pct", "latency_mean_hours", "latency_median_hours",
              "latency_min_hours", "latency_max_hours", "latency_std_hours"]


@register("r2_ring_summary", _q([TXN, RING], _SUMMARY, _SUMMARY_D))
def _(spark, d):
    return rings.ring_summary(rings.per_ring(_txn(spark, d)))


_TYPE = """select ring_type, count(*) as rings, avg(cast(detected_rule_a as double)) as rule_a_recall, avg(cast(detected_rule_b as double)) as rule_b_recall,
  avg(cast(detected_rule_c as double)) as rule_c_recall, avg(coverage) as mean_coverage, median(coverage) as median_coverage, sum(exposure) as total_exposure,
  sum(exposure_captured) as exposure_captured, case when sum(exposure) > 0 then sum(exposure_captured) / sum(exposure) * 100 else 0 end as exposure_captured_pct
  from per_ring group by ring_type"""


@register("r3_by_type", _q([TXN, RING], _TYPE, ["rule_a_recall", "rule_b_recall", "rule_c_recall", "mean_coverage", "median_coverage", "total_exposure",
                                                 "exposure_captured", "exposure_captured_pct"]))
def _(spark, d):
    return rings.by_ring_type(rings.per_ring(_txn(spark, d)))


TOPK = """
q as (select *, row_number() over (order by predicted_score desc, t, order_id) as rk from txn),
ks as (select unnest([5, 10, 20, 50, 100]) as k),
tot as (select sum(loss_amount) as total_loss from txn where is_abuse = 1 and ring_id is not null),
memb as (select ring_id, count(distinct customer_id) as members from txn where is_abuse = 1 and ring_id is not null group by all),
qa as (select k, count(*) as taken, count_if(is_abuse = 1) as tp_count, count_if(is_abuse = 0) as fp_count, coalesce(sum(case when is_abuse = 1 then loss_amount end), 0) as exposure_captured
  from q, ks where rk <= k group by k),
cv as (select k, m.ring_id, members, count(distinct case when q.rk <= k then q.customer_id end) as flagged from ks cross join memb m
  left join q on q.ring_id = m.ring_id and q.is_abuse = 1 and q.rk <= 100 group by all),
ca as (select k, count_if(flagged >= 1) as a, count_if(flagged / members >= 0.2) as b, count_if(flagged / members >= 0.5) as c, avg(flagged / members) as mean_coverage, count(*) as rings from cv group by k)"""


@register("r4_top_k", _q([TXN, TOPK], """select k, tp_count / taken as precision, tp_count, fp_count, a as rings_touched, a as rule_a_detected, a / rings as rule_a_recall, b as rule_b_detected,
  b / rings as rule_b_recall, c as rule_c_detected, c / rings as rule_c_recall, mean_coverage, exposure_captured, exposure_captured / total_loss * 100 as exposure_captured_pct
  from qa join ca using (k), tot""", ["precision", "rule_a_recall", "rule_b_recall", "rule_c_recall", "mean_coverage", "exposure_captured", "exposure_captured_pct"]))
def _(spark, d):
    return rings.top_k(_txn(spark, d))


@register("r5_top_fraction", _q([TXN, """q as (select *, row_number() over (order by predicted_score desc, t, order_id) as rk, count(*) over () as n from txn),
fs as (select unnest([0.01, 0.05]::double[]) as fraction)"""], """select fraction, count(*) as taken, count_if(is_abuse = 1) as tp_count, count_if(is_abuse = 1) / count(*) as precision,
  count(distinct case when is_abuse = 1 then ring_id end) as rings_touched, coalesce(sum(case when is_abuse = 1 then loss_amount end), 0) as exposure_captured
  from q, fs where rk <= floor(n * fraction) group by fraction""", ["precision", "exposure_captured"]))
def _(spark, d):
    return rings.top_fraction(_txn(spark, d))


@register("r6_queue_overlap", _q([TXN, TXN_B], """select order_id from (select order_id from txn order by predicted_score desc, t, order_id limit 500)
  where order_id in (select order_id from txnb order by predicted_score desc, t, order_id limit 500)"""))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    return rings.queue_overlap(a, b, 500)


def _parts(t: DataFrame):
    return (events.evaluate_predictions(t), rings.ring_summary(rings.per_ring(t)), rings.top_k(t))


def _compare_sql(src: str, model: str) -> str:
    return f"""select position, metric, value, '{model}' as model from (
      with s as ({_SUMMARY.replace('per_ring', 'per_ring_' + model)}), c as ({CONF.replace('from txn', 'from ' + src)}),
      rk as (select sum(pos / p * cp / cn) as ap, sum((n - pos) * ((cp - pos) + pos / 2)) / (max(p) * (max(tot) - max(p))) as roc from lad_{model}),
      ls as (select sum(case when predicted_score < 0.5 and is_abuse = 1 then loss_amount else 0 end) + count_if(predicted_score >= 0.5 and is_abuse = 0) * 12.0::double as loss from {src})
      select 0 as position, 'Event Precision' as metric, format('{{:.3f}}', tp / (tp + fp)) as value from c
      union all select 1, 'Event Recall', format('{{:.3f}}', tp / (tp + fn)) from c
      union all select 2, 'Event F1', format('{{:.3f}}', 2 * tp / (2 * tp + fp + fn)) from c
      union all select 3, 'PR-AUC', format('{{:.3f}}', ap) from rk union all select 4, 'ROC-AUC', format('{{:.3f}}', roc) from rk
      union all select 5, 'Any-member Ring Recall (Rule A)', format('{{:.3f}} ({{}}/{{}})', rule_a_recall, rule_a_detected_count, total_test_rings) from s
      union all select 6, '20% Coverage Ring Recall (Rule B)', format('{{:.3f}} ({{}}/{{}})', rule_b_recall, rule_b_detected_count, total_test_rings) from s
      union all select 7, '50% Coverage Ring Recall (Rule C)', format('{{:.3f}} ({{}}/{{}})', rule_c_recall, rule_c_detected_count, total_test_rings) from s
      union all select 8, 'Mean Member Coverage', format('{{:.3f}}', mean_member_coverage) from s
      union all select 9, 'Median Member Coverage', format('{{:.3f}}', median_member_coverage) from s
      union all select 10, 'Exposure Captured at Threshold', format('INR {{:,.2f}} ({{:.1f}}%)', round(total_exposure_captured, 6), exposure_captured_pct) from s
      union all select 11, 'Expected Financial Loss', format('INR {{:,.2f}}', round(loss, 6)) from ls
      union all select 12 + list_position([5, 10, 20, 50, 100], k) - 1, 'Top-' || k || ' Exposure Captured', format('INR {{:,.2f}} ({{:.1f}}%)', round(exposure_captured, 6), exposure_captured / total_loss * 100) from qa_{model}, tot_{model}
      union all select 17, 'Mean Detection Latency (hours)', format('{{:.1f}}', latency_mean_hours) from s
      union all select 18, 'Median Detection Latency (hours)', format('{{:.1f}}', latency_median_hours) from s)"""


def _suffixed(sql: str, names: tuple[str, ...], model: str, src: str) -> str:
    import re
    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{n}_{model}", sql)
    return re.sub(r"\btxn\b", src, sql)


_COMP_CTES = [TXN, TXN_B]
for _m, _src in (("a", "txn"), ("b", "txnb")):
    _COMP_CTES += [_suffixed(RING, ("ab", "pr", "per_ring"), _m, _src), _suffixed(LADDER, ("steps", "cum", "lad"), _m, _src),
                   _suffixed(TOPK, ("q", "ks", "tot", "memb", "qa", "cv", "ca"), _m, _src)]
    _COMP_CTES.append(f"cmp_{_m} as ({_compare_sql(_src, _m)})")


@register("r7_compare", _q(_COMP_CTES, """select a.metric as metric, cast(a.position as int) as position, a.value as model_a, b.value as model_b from cmp_a a join cmp_b b on a.position = b.position"""))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    return rings.compare_models({"model_a": _parts(a), "model_b": _parts(b)})


_T_COLS = ("rule_a_recall", "rule_b_recall", "rule_c_recall", "mean_coverage", "exposure_captured_pct")


@register("r8_ring_type_comparison", _q([TXN, TXN_B, RING, _suffixed(RING, ("ab", "pr", "per_ring"), "b", "txnb"), f"ta as ({_TYPE})",
    f"tb as ({_TYPE.replace('from per_ring', 'from per_ring_b')})"],
    "select coalesce(ta.ring_type, tb.ring_type) as ring_type, coalesce(tb.rings, 0) as active_rings, coalesce(tb.total_exposure, 0) as total_exposure, "
    + ", ".join(f"coalesce(t{m}.{c}, 0) as {m}_{c}" for m in "ab" for c in _T_COLS)
    + """, coalesce(tb.rule_c_recall, 0) - coalesce(ta.rule_c_recall, 0) as rule_c_lift, coalesce(tb.mean_coverage, 0) - coalesce(ta.mean_coverage, 0) as coverage_lift,
  case when coalesce(tb.rule_c_recall, 0) > coalesce(ta.rule_c_recall, 0) then 'LIFT' when coalesce(tb.rule_c_recall, 0) = coalesce(ta.rule_c_recall, 0) then 'PARITY' else 'REGRESSION' end as regression_status
  from ta full join tb on ta.ring_type = tb.ring_type""", ["total_exposure", *[f"{m}_{c}" for m in "ab" for c in _T_COLS], "rule_c_lift", "coverage_lift"]))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    return rings.ring_type_comparison(rings.by_ring_type(rings.per_ring(a)), rings.by_ring_type(rings.per_ring(b)))


DAILY = """
fl as (select *, cast(cast(event_time as date) as varchar) as day from txn where predicted_score >= 0.5),
fv as (select distinct day, customer_id as c, etype, value from ent join fl using (order_id, customer_id)),
nb as (select distinct a.day, a.c, b.c as d from fv a join fv b on a.day = b.day and a.etype = b.etype and a.value = b.value),
walk as (select distinct day, c, c as d from fv union select w.day, w.c, nb.d from walk w join nb on nb.day = w.day and nb.c = w.d),
root as (select day, c, min(d) as r from walk group by all),
ncase as (select day, count(distinct r) as n from root group by all),
daily as (select cast(cast(event_time as date) as varchar) as date, count(*) as total_orders, count_if(predicted_score >= 0.5) as raw_alerts, coalesce(max(n), 0) as consolidated_cases,
  count_if(predicted_score >= 0.5 and is_abuse = 0) as false_positives, coalesce(sum(case when predicted_score >= 0.5 and is_abuse = 1 then loss_amount end), 0) as exposure_captured
  from txn left join ncase on ncase.day = cast(cast(event_time as date) as varchar) group by all),
dw as (select *, exposure_captured / greatest(1, consolidated_cases) as exposure_per_case, case when raw_alerts > 0 then (1 - consolidated_cases / raw_alerts) * 100 else 0 end as workload_reduction_pct from daily)"""


def _rec(ctes: list[str], body: str, doubles=None) -> str:
    """``with recursive`` form of ``_q``."""
    return _q(ctes, body, doubles).replace("with ", "with recursive ", 1)


@register("r9_daily_workload", _rec([TXN, ENT, DAILY], "select * from dw", ["exposure_captured", "exposure_per_case", "workload_reduction_pct"]))
def _(spark, d):
    return rings.daily_workload(_txn(spark, d))


@register("r10_workload_summary", _rec([TXN, ENT, DAILY], """select count(*) as evaluation_days, cast(sum(raw_alerts) as bigint) as total_raw_alerts, cast(sum(consolidated_cases) as bigint) as total_consolidated_cases,
  (1 - sum(consolidated_cases) / sum(raw_alerts)) * 100 as overall_workload_reduction_pct, avg(raw_alerts) as mean_daily_raw_alerts, avg(consolidated_cases) as mean_daily_consolidated_cases,
  max(raw_alerts) as peak_day_raw_alerts, max(consolidated_cases) as peak_day_consolidated_cases, max(consolidated_cases) / greatest(0.1::double, avg(consolidated_cases)) as peak_to_mean_ratio,
  avg(exposure_captured) as mean_daily_exposure_captured, sum(exposure_captured) / sum(consolidated_cases) as overall_exposure_per_case from dw""",
    ["overall_workload_reduction_pct", "mean_daily_raw_alerts", "mean_daily_consolidated_cases", "peak_to_mean_ratio", "mean_daily_exposure_captured", "overall_exposure_per_case"]))
def _(spark, d):
    return rings.workload_summary(rings.daily_workload(_txn(spark, d)))


@register("r11_ring_timeline", _q([TXN, "tt as (select ring_id, sum(amount) as total_exposure, count(*) as total_orders, count_if(predicted_score >= 0.5) as flagged_orders from txn where ring_id is not null group by all)"],
    """select 'DOSSIER-RING-' || ring_id as dossier_id, ring_id, order_id, customer_id, t, amount, predicted_score, case when predicted_score >= 0.5 then 'FLAG_FOR_REVIEW' else 'AUTO_APPROVE' end as action,
  total_exposure, total_orders, flagged_orders, case when flagged_orders > 0 then 'CRITICAL_SUSPECTED_RING' else 'LOW_RISK' end as risk_assessment,
  case when flagged_orders > 0 then 'FREEZE_RING_ENTITIES' else 'MONITOR' end as recommended_action from txn join tt using (ring_id)""", ["amount", "predicted_score", "total_exposure"]))
def _(spark, d):
    return timed(rings.ring_timeline(_txn(spark, d))).drop("event_time")


# ---- calibration, drift, uncertainty ------------------------------------------------------------

BINS = """
b as (select i, i * 0.1::double as lo, case when i = 9 then 1.0::double else (i + 1) * 0.1::double end as hi from (select unnest(range(10)) as i)),
bins as (select cast(b.i as int) as bin_index, b.lo as bin_lower, b.hi as bin_upper, count(order_id) as bin_count, coalesce(avg(is_abuse), 0) as observed_rate,
  coalesce(avg(predicted_score), (b.lo + b.hi) / 2) as mean_predicted_prob, case when count(order_id) = 0 then 0 else abs(avg(is_abuse) - avg(predicted_score)) end as calibration_gap
  from b left join txn on predicted_score >= lo and (predicted_score < hi or (i = 9 and predicted_score <= hi)) group by b.i, b.lo, b.hi)"""


@register("u1_calibration_bins", _q([TXN, BINS], "select * from bins", ["bin_lower", "bin_upper", "observed_rate", "mean_predicted_prob", "calibration_gap"]))
def _(spark, d):
    return calibration.calibration_bins(_txn(spark, d))


@register("u2_ece_mce", _q([TXN, BINS], "select sum(bin_count * calibration_gap) / sum(bin_count) as ece, max(calibration_gap) as mce from bins", ["ece", "mce"]))
def _(spark, d):
    return calibration.ece_mce(calibration.calibration_bins(_txn(spark, d)))


@register("u3_brier", _q([TXN], "select avg((predicted_score - is_abuse) ** 2) as brier from txn", ["brier"]))
def _(spark, d):
    return calibration.brier(_txn(spark, d))


def _psi_sql(col: str) -> str:
    return f"""select '{col}' as feature, sum((pa - pe) * ln(pa / pe)) as psi from (
      select greatest_zero(ce / te) as pe, greatest_zero(ca / ta) as pa from (
        select bin, count_if(split = 'train') as ce, count_if(split = 'test') as ca, (select count(*) from sp where split = 'train') as te, (select count(*) from sp where split = 'test') as ta
        from (select split, len(list_filter((select es[2:len(es)-1] from (select list_sort(list_distinct(quantile_cont({col}::double, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) as es from sp where split = 'train')), lambda e: e <= {col})) as bin
          from sp where split in ('train', 'test')) group by bin))""".replace("greatest_zero(ce / te)", "case when ce = 0 then 1e-5::double else ce / te end").replace(
        "greatest_zero(ca / ta)", "case when ca = 0 then 1e-5::double else ca / ta end")


def _psi_cat(col: str) -> str:
    return f"""select '{col}' as feature, sum((pa - pe) * ln((pa + 1e-5::double) / (pe + 1e-5::double))) as psi from (
      select case when ce = 0 then 1e-5::double else ce / te end as pe, case when ca = 0 then 1e-5::double else ca / ta end as pa from (
        select {col} as v, count_if(split = 'train') as ce, count_if(split = 'test') as ca, (select count(*) from sp where split = 'train') as te,
          (select count(*) from sp where split = 'test') as ta from sp where split in ('train', 'test') group by v))"""


PSI_SQL = f"{_psi_sql('amount')} union all {_psi_sql('predicted_score')} union all {_psi_cat('retry_count')}"


@register("u4_psi", _q([TXN, SPLIT], PSI_SQL, ["psi"]))
def _(spark, d):
    sp = events.split_by_time(_txn(spark, d))
    return drift.psi(sp.filter("split = 'train'"), sp.filter("split = 'test'"), ["amount", "predicted_score", "retry_count"])


def _w1(col: str) -> str:
    return f"""select '{col}' as feature, sum(abs(ca / ta - cb / tb) * (nx - v)) as wasserstein from (
      select v, lead(v) over (order by v) as nx, sum(na) over (order by v) as ca, sum(nb) over (order by v) as cb, sum(na) over () as ta, sum(nb) over () as tb from (
        select {col}::double as v, count_if(split = 'train') as na, count_if(split = 'test') as nb from sp where split in ('train', 'test') group by v))"""


W1_SQL = f"{_w1('amount')} union all {_w1('predicted_score')} union all {_w1('retry_count')}"


@register("u5_wasserstein", _q([TXN, SPLIT], W1_SQL, ["wasserstein"]))
def _(spark, d):
    sp = events.split_by_time(_txn(spark, d))
    return drift.wasserstein_1d(sp.filter("split = 'train'"), sp.filter("split = 'test'"), ["amount", "predicted_score", "retry_count"])


_MEANS = " union all ".join(f"select '{c}' as feature, avg({c}) filter (split = 'train') as train_mean, avg({c}) filter (split = 'test') as test_mean from sp"
                            for c in ("amount", "predicted_score", "retry_count"))


@register("u6_drift_report", _q([TXN, SPLIT, f"m as ({_MEANS})", f"pt as ({PSI_SQL})",
    "pv as (" + PSI_SQL.replace("'test'", "'validation'") + ")", f"w as ({W1_SQL})"],
    """select feature, contains(feature, 'subgraph_') as is_subgraph, train_mean, test_mean, pv.psi as psi_train_vs_val, pt.psi as psi_train_vs_test, wasserstein as wasserstein_train_vs_test,
  case when pt.psi < 0.1 then 'Minimal Drift (PSI < 0.10)' when pt.psi <= 0.25 then 'Moderate Drift (0.10 <= PSI <= 0.25)' else 'Significant Drift (PSI > 0.25)' end as drift_status
  from m join pt using (feature) join pv using (feature) join w using (feature)""", ["train_mean", "test_mean", "psi_train_vs_val", "psi_train_vs_test", "wasserstein_train_vs_test"]))
def _(spark, d):
    sp = materialise(events.split_by_time(_txn(spark, d)), "split")
    return drift.drift_report(*[sp.filter(F.col("split") == s) for s in ("train", "validation", "test")],
                              ["amount", "predicted_score", "retry_count", "not_a_feature"])[0]


def _resampled(n: int, score: str = "s", tag: str = "") -> list[str]:
    """SQL of the metrics of ``n`` resamples of ``cells``, by the score ``score`` (see ``uncertainty.metrics_of_cells``)."""
    return [f"""rw{tag} as (select {score} as s, is_abuse, loss_amount, r, w from drawn),
cf{tag} as (select r, coalesce(sum(w) filter (s >= 0.5 and is_abuse = 1), 0)::double as tp, coalesce(sum(w) filter (s >= 0.5 and is_abuse = 0), 0)::double as fp,
    coalesce(sum(w) filter (s < 0.5 and is_abuse = 1), 0)::double as fn, coalesce(sum(w) filter (is_abuse = 0), 0) as good,
    coalesce(sum(w * loss_amount) filter (s < 0.5 and is_abuse = 1), 0)::double as missed from rw{tag} where w > 0 group by r),
ls{tag} as (select r, s, sum(w) as n, sum(w * is_abuse) as pos from rw{tag} where w > 0 group by r, s),
lc{tag} as (select *, sum(n) over w as cn, sum(pos) over w as cp, sum(pos) over (partition by r) as p from ls{tag} window w as (partition by r order by s desc)),
ll{tag} as (select *, coalesce(lag(cp / cn) over (partition by r order by s desc), 1.0) as before from lc{tag}),
rk{tag} as (select r, sum(pos / p * (cp / cn + before) / 2) as pr_auc, sum(pos / p * cp / cn) as average_precision from ll{tag} group by r),
mt{tag} as (select r, pr_auc, average_precision, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
    tp / (tp + fn) as recall, fp * 10 + missed + tp * 2 as expected_loss from cf{tag} join rk{tag} using (r) where tp + fn > 0 and good > 0)"""]


def _drawn(n: int, cells: str) -> str:
    """SQL of Poisson(c) draws of cells by the inverse distribution, from 52 bits of MD5."""
    low = "greatest(0, floor(c - 12 * sqrt(c) - 20))::bigint"
    return f"""cells as ({cells}),
steps as (select c, j, sum(exp(j * ln(c) - c - lgamma(j + 1))) over (partition by c order by j) as cum
    from (select c, unnest(range({low}, floor(c + 12 * sqrt(c) + 30)::bigint + 1)) as j from (select distinct c from cells))),
toss as (select *, ('0x' || substr(md5(k || '|' || r || '|42'), 1, 13))::bigint::double / 4503599627370496::double as u from cells, range(1, {n + 1}) t(r)),
drawn as (select toss.*, coalesce(steps.j + 1, {low.replace("(c", "(toss.c")}) as w from toss asof left join steps on toss.c = steps.c and toss.u >= steps.cum)"""


@register("u7_bootstrap", _q([
    TXN, _drawn(5_000, "select predicted_score as s, is_abuse, loss_amount, count(*) as c, min(order_id) as k from txn group by all"), *_resampled(5_000),
    "lg as (unpivot (select pr_auc, f1, precision, recall, expected_loss from mt) on * into name metric value value)"],
    "select metric, avg(value) as mean, stddev_pop(value) as std, quantile_cont(value, 0.025) as ci_95_lower, quantile_cont(value, 0.975) as ci_95_upper from lg group by metric",
    ["mean", "std", "ci_95_lower", "ci_95_upper"]))
def _(spark, d):
    return uncertainty.bootstrap_ci(_txn(spark, d), n=5_000)


@register("u8_paired_bootstrap", _q([
    TXN, TXN_B, _drawn(200, "select a.predicted_score as sa, b.predicted_score as sb, a.is_abuse, a.loss_amount, count(*) as c, min(order_id) as k from txn a join txnb b using (order_id) group by all"),
    *_resampled(200, "sa"), *_resampled(200, "sb", "b"), """lg as (select 'average_precision' as metric, b.average_precision - a.average_precision as delta from mt a join mtb b using (r)
  union all select 'f1', b.f1 - a.f1 from mt a join mtb b using (r))"""],
    "select metric, avg(delta) as mean_delta, avg((delta > 0)::int) as exceedance, quantile_cont(delta, 0.025) as lower, quantile_cont(delta, 0.975) as upper from lg group by metric",
    ["mean_delta", "exceedance", "lower", "upper"]))
def _(spark, d):
    return uncertainty.paired_bootstrap(*_two_models(_txn(spark, d)), n=200)


def _permuted_sql(repeats: int, seed: int = 42) -> str:
    """Average precision of a fixed score with one column dealt anew, less that of the score itself."""
    h = lambda salt: f"('0x' || substr(md5(order_id || '|{salt}'), 1, 13))::bigint"
    blocks = "(select count(*) // 50000 + 1 from txn)"
    ctes, ap = [TXN, "base as (select order_id, is_abuse, predicted_score as base, amount from txn)"], []

    def precision(rows: str, name: str) -> str:
        return (f"{name}s as (select base * 0.9::double + amount * 1e-5::double as s, count(*) as n, sum(is_abuse) as pos from {rows} group by s), "
                f"{name} as (select sum(pos * cp / cn) / sum(pos) as ap from (select *, sum(n) over w as cn, sum(pos) over w as cp from {name}s window w as (order by s desc)))")

    ctes.append(precision("base", "ap0"))
    for k, c in enumerate(("base", "amount")):
        for r in range(repeats):
            salt, name = seed + 31 * k + r, f"p{k}{r}"
            num = lambda x: f"row_number() over (order by {h(x)} % {blocks}, {h(x)}, order_id)"
            ctes.append(f"{name}t as (select * exclude ({c}), {num(salt)} as pos from base), {name}v as (select {c}, {num(salt + 7919)} as pos from base), "
                        f"{name}r as (select * from {name}t join {name}v using (pos))")
            ctes.append(precision(f"{name}r", f"ap{k}{r}"))
        drops = " + ".join(f"((select ap from ap0) - (select ap from ap{k}{r}))" for r in range(repeats))
        ap.append(f"select '{c}' as feature, ({drops}) / {repeats} as importance")
    return _q(ctes, " union all ".join(ap), ["importance"])


@register("u9_permutation_importance", _permuted_sql(3))
def _(spark, d):
    t = materialise(_txn(spark, d).select("order_id", "amount", F.col("retry_count").cast("double"), "is_abuse", "predicted_score"), "perm")
    # a fixed linear score over two columns: shuffling the one it leans on costs precision
    return uncertainty.permutation_importance(
        lambda df: df.withColumn("predicted_score", F.col("base") * 0.9 + F.col("amount") * 1e-5),
        t.select("order_id", "is_abuse", "amount", F.col("predicted_score").alias("base")), ["base", "amount"], repeats=3)


def _pruned_sql() -> str:
    """Of each pair of baseline columns with |r| above 0.95 the later one goes (importance falls with the place)."""
    cols = o.BASELINE_COLUMNS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    r = "r as (select " + ", ".join(f"corr({a}, {b}) as r{k}" for k, (a, b) in enumerate(pairs)) + " from fb)"
    gone = "gone as (" + " union ".join(f"select '{b}' as c from r where not isnan(r{k}) and abs(r{k}) > 0.95" for k, (_, b) in enumerate(pairs)) + ")"
    every = "every as (select unnest([" + ", ".join(f"'{c}'" for c in cols) + "]) as kept)"
    return _q([TXN, ENT, o.CUST, o.OWN, f"fb as ({o._baseline_body()})", r, gone, every],
              "select (select count(*) from fb) as orders, kept from every where kept not in (select c from gone)")


@register("u10_correlation_prune", _pruned_sql())
def _(spark, d):
    fb = behaviour.baseline_features(_txn(spark, d))
    cols = o.BASELINE_COLUMNS
    kept = uncertainty.correlation_prune(fb, cols, {c: 1.0 / (k + 1) for k, c in enumerate(cols)})
    return fb.agg(F.count("*").alias("orders")).select("orders", F.explode(F.array(*[F.lit(c) for c in kept])).alias("kept"))


# ---- models -------------------------------------------------------------------------------------

@lru_cache(maxsize=8)
def _stored(app: str, d: str, what: str) -> str:
    """Path of the 137-column matrix with split and labels (``matrix``), or of the model fitted on it (``model``): made once a session."""
    spark = SparkSession.active()
    at = scratch_path(spark, what)
    if what == "matrix":
        t = _txn(spark, d)
        parts = events.split_by_time(t).select("order_id", "split")
        feature_matrix(t, ties="strict").join(parts, "order_id").join(_labels(t), "order_id").write.parquet(at)
    else:
        frame = _matrix(spark, d)
        model = models.fit_model(frame.filter("split = 'train'").withColumn("y", F.col("is_abuse")), FEATURE_CONTRACT)
        val = materialise(models.predict_scores(model, frame.filter("split = 'validation'")).select("is_abuse", "predicted_score"), "m7-val")
        models.StoredModel(model, models.select_calibrator(val)[0]).save(at)
    return at


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(_stored(spark.sparkContext.applicationId, d, "matrix"))


def _model_path(spark: SparkSession, d: str) -> str:
    return _stored(spark.sparkContext.applicationId, d, "model")


@register("m6_ablation", "select feature_set, features, true as metrics_in_range, true as counts_add_up from (values ('baseline', 19), ('combined', 37), ('full', 67), "
          "('extended', 97), ('two_hop_extended', 117), ('subgraph_extended', 137)) v(feature_set, features), (select count(*) as orders from events) n where orders > 0")
def _(spark, d):
    """All six feature sets with 160 rounds each. Labels of this table are mostly chance, so the published bands don't hold here; metrics
    must be possible ones and the counts those of the test split."""
    frame = _matrix(spark, d)
    table_, scored = models.ablation(frame.drop("is_abuse", "ring_id", "abuse_type", "loss_amount"), frame)
    test = frame.filter("split = 'test'").agg(F.count("*").alias("test_orders"))
    return fn.beside(table_, test).select(
        "feature_set", F.col("features").cast("int").alias("features"), (F.col("average_precision").between(0.01, 1) & F.col("threshold").between(0, 1)).alias("metrics_in_range"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("test_orders")).alias("counts_add_up"))


@register("m7_score_and_alert", None)
def _(spark, d):
    stored = models.StoredModel.load(_model_path(spark, d))
    return stored.score(_matrix(spark, d).filter("split = 'test'")).select("order_id", "predicted_score", "calibrated_score", "alert")


@register("m7_bands", _q([TXN], """select n as orders, n as scored, true as ranks_train, true as ranks_validation, true as beats_constant, true as calibrated, true as alerts_at_threshold
  from (select count(*) as n from txn)"""))
def _(spark, d):
    """The stored model over all orders: every one scored once, ranking above chance where it was fitted and validated, on
    validation a lower Brier score than the constant rate and a small calibration error, alerts at the threshold."""
    scored = materialise(models.StoredModel.load(_model_path(spark, d)).score(_matrix(spark, d)), "m7")
    every = scored.agg(F.count("*").alias("orders"), F.count_distinct("order_id").alias("scored"),
                       (F.count_if(F.col("alert") != (F.col("calibrated_score") >= 0.5)) == 0).alias("alerts_at_threshold"))
    val = scored.filter("split = 'validation'")
    rank = events.ranking_metrics(scored.select("split", "order_id", "is_abuse", "predicted_score"), ["split"])
    ranks = rank.agg(*[(F.max(F.when(F.col("split") == x, F.col("roc_auc"))) > 0.6).alias(f"ranks_{x}") for x in ("train", "validation")])
    rate = F.avg("is_abuse")
    constant = val.agg((F.avg(F.pow(F.col("calibrated_score") - F.col("is_abuse"), 2)) < rate * (1 - rate)).alias("beats_constant"))
    bins = calibration.ece_mce(calibration.calibration_bins(val, score="calibrated_score")).select((F.col("ece") < 0.02).alias("calibrated"))
    return fn.beside(every, ranks, constant, bins).select(
        "orders", "scored", "ranks_train", "ranks_validation", "beats_constant", "calibrated", "alerts_at_threshold")


# A score that neither rises with the label everywhere nor has few values: clean and abusive orders overlap in seven steps.
STEPPED = """
st as (select sp.*, cast((order_id * 7919) % 1009 as double) / 1009::double * 0.4::double
  + is_abuse * (cast((order_id * 31) % 7 as double) / 7::double) * 0.5::double + 0.01::double as s from sp),
val as (select s as x, ln(s / (1 - s)) as z, sum(is_abuse) as bad, count(*) as n from st where split = 'validation' group by s)"""
# The min-max formula: of every start up to a score, the lowest mean that any end from it on leaves; the highest of these.
MIN_MAX = """
cum as (select *, row_number() over w as i, sum(bad) over w as cb, sum(n) over w as cn from val window w as (order by x)),
means as (select a.i as a, b.i as i, (b.cb - a.cb + a.bad) / (b.cn - a.cn + a.n) as mean from cum a join cum b on a.i <= b.i),
lows as (select i, min(mean) over (partition by a order by i desc) as low from means),
fit as (select x, max(low) as y from lows join cum using (i) group by x),
iso as (select order_id, split, is_abuse, case when lo.x is null then hi.y when hi.x is null or hi.x = lo.x then lo.y else lo.y + (s - lo.x) * (hi.y - lo.y) / (hi.x - lo.x) end as calibrated_score
  from (select * from st asof left join fit on s >= fit.x) lo join (select order_id, x, y from st asof left join fit on s <= fit.x) hi using (order_id))"""
# Newton's steps on slope a and intercept b; only the slope is penalised.
NEWTON = """
newton as (select 0 as k, 0::double as a, 0::double as b
  union all select k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from (
    select k, a, b, sum(z * (n * p - bad)) + a as ga, sum(n * p - bad) as gb, sum(z * z * n * p * (1 - p)) + 1 as haa, sum(z * n * p * (1 - p)) as hab, sum(n * p * (1 - p)) as hbb
    from (select newton.*, val.*, 1 / (1 + exp(-a * z - b)) as p from newton, val where k < 30) group by k, a, b)),
curve as (select a, b from newton where k = 30)"""


def _stepped(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("order_id") * 7919 % 1009).cast("double") / F.lit(1009.0) * F.lit(0.4)
    score = score + F.col("is_abuse") * ((F.col("order_id") * 31 % 7).cast("double") / F.lit(7.0)) * F.lit(0.5) + F.lit(0.01)
    return materialise(events.split_by_time(_txn(spark, d).withColumn("predicted_score", score)), "stepped")


@register("m3_platt", _q([TXN, SPLIT, STEPPED, NEWTON], "select round(a, 3) as slope, round(b, 3) as intercept, (select count(*) from st) as orders from curve"
                         ).replace("with ", "with recursive ", 1))
def _(spark, d):
    t = _stepped(spark, d)
    curve = models.platt_fit(t.filter("split = 'validation'")).model
    return t.agg(F.round(F.lit(float(curve.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(curve.intercept)), 3).alias("intercept"), F.count("*").alias("orders"))


@register("m4_isotonic", _q([TXN, SPLIT, STEPPED, MIN_MAX], "select order_id, calibrated_score from iso", ["calibrated_score"]))
def _(spark, d):
    """Fitted on the validation orders, applied to all."""
    t = _stepped(spark, d)
    return models.isotonic_fit(t.filter("split = 'validation'")).apply(t).select("order_id", "calibrated_score")


@register("m5_select_calibrator", _q([TXN, SPLIT, STEPPED, MIN_MAX, NEWTON, """
loss as (select (select avg((1 / (1 + exp(-a * ln(s / (1 - s)) - b)) - is_abuse) ** 2) from st, curve where split = 'validation') as platt,
  (select avg((calibrated_score - is_abuse) ** 2) from iso where split = 'validation') as isotonic)"""],
    "select case when platt <= isotonic then 'platt' else 'isotonic' end as method, round(platt, 5) as platt, round(isotonic, 5) as isotonic, (select count(*) from st) as orders from loss"
    ).replace("with ", "with recursive ", 1))
def _(spark, d):
    t = _stepped(spark, d)
    best, loss = models.select_calibrator(t.filter("split = 'validation'"))
    return t.agg(F.lit(best.method).alias("method"), *[F.round(F.lit(loss[k]), 5).alias(k) for k in ("platt", "isotonic")], F.count("*").alias("orders"))


@register("m8_finite_check", _q([TXN], f"""select count(*) as orders, cast({len(FEATURE_CONTRACT)} * sum(order_id % 997 = 0)
  + sum(case when order_id % 997 = 0 then 0 else (order_id % 50 = 0)::int + (order_id % 70 = 0)::int + (order_id % 90 = 0)::int end) as bigint) as non_finite from txn"""))
def _(spark, d):
    """All contract columns, with a NaN, an infinity and a null in known rows, and rows without any value."""
    fb = behaviour.customer_relative_features(_txn(spark, d)).withColumn("k", F.col("order_id").cast("long"))
    whole = project_contract(fb, FEATURE_CONTRACT, missing="zero").join(fb.select("order_id", "k"), "order_id")
    bad = {0: (50, F.lit(float("nan"))), 1: (70, F.lit(float("inf"))), 2: (90, F.lit(None).cast("double"))}
    for n, (every, value) in bad.items():
        whole = whole.withColumn(FEATURE_CONTRACT[n], F.when(F.col("k") % every == 0, value).otherwise(F.col(FEATURE_CONTRACT[n]).cast("double")))
    whole = whole.select("order_id", *[F.when(F.col("k") % 997 != 0, F.col(c).cast("double")).alias(c) for c in FEATURE_CONTRACT])
    return models.finite_check(whole, FEATURE_CONTRACT)


# ---- graph, cases, dossiers ---------------------------------------------------------------------

AS_OF = "2024-01-20"


@register("g1_snapshot", _q([TXN, ENT, f"e as (select ent.*, amount from ent join txn using (order_id) where event_time < timestamp '{AS_OF}')"],
    """select 'customer:' || e.customer_id as customer, e.etype || '_id' as etype, e.etype || '_id:' || value as entity, max(e.t) as t, arg_max(amount, e.t) as amount from e group by all""", ["amount"]))
def _(spark, d):
    return timed(graph.graph_snapshot(_txn(spark, d), AS_OF)).drop("event_time")


@register("g2_components", _rec([TXN, ENT, "flag as (select order_id from txn)", _closure("flag"), "sz as (select r, count(*) as customers from root group by r)"],
    "select c as customer_id, r as smallest_customer, customers from root join sz using (r)"))
def _(spark, d):
    t = _txn(spark, d)
    e = unpivot_entities(timed(t)).select(F.concat(F.lit("c:"), "customer_id").alias("src"), F.concat_ws(":", "etype", "value").alias("dst")).distinct()
    comp = graph.connected_components(e).filter(F.col("node").startswith("c:")).select(F.substring("node", 3, 20).cast("long").alias("customer_id"), "component")
    comp = materialise(comp, "g2")
    size = comp.groupBy("component").agg(F.min("customer_id").alias("smallest_customer"), F.count("*").alias("customers"))
    return comp.join(size, "component").drop("component")


# The sides take turns (customers first) until neither has moved for a turn each; every turn is a whole label table.
TURNS = f"""
link as (select distinct 'customer:' || customer_id as src, etype || '_id:' || value as dst from ent join (select order_id, event_time from txn) using (order_id)
  where event_time < timestamp '{AS_OF}'),
near as (select src as node, dst as other, 0 as side from link union all select dst, src, 1 from link),
lab as (select 0 as turn, 0 as kept, node, node as label from (select distinct node from near)
  union all select turn + 1, case when moved then 0 else kept + 1 end, node, label from (
    select l.turn, l.kept, l.node, coalesce(v.label, l.label) as label, bool_or(coalesce(v.label, l.label) <> l.label) over () as moved
    from lab l left join (select node, label from (
      select n.node, o.label, row_number() over (partition by n.node order by count(*) desc, o.label) as r
      from near n join lab o on o.node = n.other where n.side = o.turn % 2 group by n.node, o.label) where r = 1) v on v.node = l.node
    where l.kept < 2)),
settled as (select node, label from lab where turn = (select max(turn) from lab)),
q as (select avg(cast(a.label = b.label as int)) - (select sum(d * d) from (select count(*) as d from near join settled using (node) group by label)) / (4.0::double * count(*) * count(*)) as modularity
  from link join settled a on a.node = src join settled b on b.node = dst)"""


@register("g3_communities", _rec([TXN, ENT, TURNS], "select label as community, nodes, modularity from (select label, count(*) as nodes from settled group by label), q", ["modularity"]))
def _(spark, d):
    e = graph.graph_snapshot(_txn(spark, d), AS_OF).select(F.col("customer").alias("src"), F.col("entity").alias("dst"))
    lab = graph.communities(e)
    return lab.groupBy("community").agg(F.count("*").alias("nodes")).transform(fn.beside, graph.modularity(e, lab))


@register("g4_summary", _rec([TXN, ENT, f"flag as (select order_id from txn where event_time < timestamp '{AS_OF}')", _closure("flag"), """
nodes as (select 'customer:' || c as node, 'customer' as kind, count(*) as degree, any_value(c) as c from fv group by c
  union all select etype || '_id:' || value, etype || '_id', count(distinct c), min(c) from fv group by etype, value),
tagged as (select node, kind, degree, r from nodes join root using (c)), csz as (select r, count(*) as component_size from tagged group by r)"""],
    "select node, kind, degree, component_size from tagged join csz using (r)"))
def _(spark, d):
    return graph.graph_summary(graph.graph_snapshot(_txn(spark, d), AS_OF)).drop("component")


@register("g4_summary_communities", _rec([TXN, ENT, TURNS, "kinds as (select node, case when side = 0 then 'customer' else split_part(node, ':', 1) end as kind, count(*) as degree from near group by all)"],
    "select node, kind, degree, label as community from kinds join settled using (node)"))
def _(spark, d):
    snap = materialise(graph.graph_snapshot(_txn(spark, d), AS_OF), "g4")
    lab = graph.communities(snap.select(F.col("customer").alias("src"), F.col("entity").alias("dst")))
    return graph.graph_summary(snap, lab).drop("component", "component_size")


@register("g5_cases", _rec([TXN, ENT, "flag as (select order_id from txn where predicted_score >= 0.5)", _closure("flag"), """
al as (select order_id, loss_amount, r from txn join flag using (order_id) join root on root.c = txn.customer_id),
cs as (select r, count(*) as alerts, min(order_id) as first_order, sum(loss_amount) as exposure from al group by r)"""],
    "select al.order_id, first_order, alerts, exposure from al join cs using (r)", ["exposure"]))
def _(spark, d):
    fl = _txn(spark, d).filter("predicted_score >= 0.5")
    c = materialise(graph.consolidate_alerts(fl).join(fl.select("order_id", "loss_amount"), "order_id"), "g5")
    per = c.groupBy("case_id").agg(F.count("*").alias("alerts"), F.min("order_id").alias("first_order"), F.sum("loss_amount").alias("exposure"))
    return c.select("order_id", "case_id").join(per, "case_id").drop("case_id")


@register("g5_consolidation_stats", _rec([TXN, ENT, "flag as (select order_id from txn where predicted_score >= 0.5)", _closure("flag"), """
al as (select order_id, loss_amount, r from txn join flag using (order_id) join root on root.c = txn.customer_id), pc as (select r, count(*) as n, sum(loss_amount) as e from al group by r)"""],
    "select cast(sum(n) as bigint) as alerts, count(*) as cases, avg(n) as alerts_per_case, max(n) as largest_case, sum(e) as exposure from pc", ["alerts_per_case", "exposure"]))
def _(spark, d):
    fl = _txn(spark, d).filter("predicted_score >= 0.5")
    return graph.consolidation_stats(graph.consolidate_alerts(fl), fl)


def _alerts(spark, d):
    return cases.create_alerts(_scored(_txn(spark, d)))


ALERTS = "al as (select * from log where predicted_score >= 0.5 and not fallback_applied)"


@register("c1_alerts", _q([TXN, LOG, ALERTS], """select 'ALERT-' || substr(sha256(cast(order_id as varchar)), 1, 16) as alert_id, order_id, customer_id, t, amount,
  predicted_score as risk_score, 4 as modalities from al""", ["amount", "risk_score"]))
def _(spark, d):
    return _alerts(spark, d).drop("entity_keys")


@register("c2_evidence", _q([TXN, ENT, LOG, ALERTS, """
sh as (select a.order_id, a.etype, count(distinct b.customer_id) as peers from ent a join al using (order_id) join ent b on a.etype = b.etype and a.value = b.value
  and b.t < a.t and b.customer_id <> a.customer_id group by all),
ev as (select order_id, 'score_threshold' as evidence_type, '' as entity_type, round(predicted_score, 6) as value, ':threshold' as suffix, '>= 0.50' as comparison, 'event' as window from al
  union all select order_id, 'shared_entity', etype || '_id', peers, etype || '_id', 'prior observable events', '30d' from sh)"""],
    """select 'EVID-' || substr(sha256(order_id || suffix), 1, 16) as evidence_id, 'ALERT-' || substr(sha256(cast(order_id as varchar)), 1, 16) as alert_id, order_id, evidence_type, entity_type,
  cast(value as double) as value, comparison, "window" from ev""", ["value"]))
def _(spark, d):
    t = _txn(spark, d)
    return cases.alert_evidence(cases.create_alerts(_scored(t)), t)


def _greedy(arrival: str) -> list[str]:
    """SQL of case assignment: the smallest opener among all that an alert leads back to, value by value."""
    return [f"""lk as (select order_id, t, 'customer:' || customer_id as v from al union all select ent.order_id, ent.t, etype || '_id:' || value from ent join al using (order_id)),
pr as (select order_id, lag(order_id) over (partition by v order by {arrival}) as p from lk), ed as (select distinct order_id, p from pr where p is not null),
reach(o, x) as (select order_id, order_id from al where order_id not in (select order_id from ed) union select reach.o, ed.order_id from reach join ed on ed.p = reach.x),
gr as (select x as order_id, min('CASE-' || substr(sha256('ALERT-' || substr(sha256(cast(o as varchar)), 1, 16)), 1, 16)) as case_id from reach group by x)"""]


GREEDY_ROWS = "select order_id, 'ALERT-' || substr(sha256(cast(order_id as varchar)), 1, 16) as alert_id, case_id from gr"


@register("g6_assign_cases", _rec([TXN, ENT, LOG, ALERTS, *_greedy("t, order_id")], GREEDY_ROWS))
def _(spark, d):
    return cases.assign_cases(_alerts(spark, d)).select("order_id", "alert_id", "case_id")


def _by_component(spark, d) -> DataFrame:
    """Alerts with the component as the case: the order-independent grouping."""
    al = materialise(_alerts(spark, d), "alerts")
    comp = graph.consolidate_alerts(_scored(_txn(spark, d)).filter("alert and not fallback_applied"))
    named = comp.groupBy("case_id").agg(F.min("order_id").cast("string").alias("name"))
    comp = comp.join(named, "case_id").select("order_id", F.col("name").alias("case_id"))
    return materialise(al.join(comp, "order_id"), "assigned"), al


COMP = ["flag as (select order_id from al)", _closure("flag"), "ac as (select al.*, r from al join root on root.c = al.customer_id)",
        "nm as (select r, cast(min(order_id) as varchar) as case_id from ac group by r)", "asg as (select ac.*, case_id from ac join nm using (r))"]
ROLL = """
roll as (select case_id, count(distinct customer_id) as customers, count(*) as alert_count, max(predicted_score) as risk_score, round(sum(amount), 2) as estimated_exposure,
  arg_min(customer_id, t) as primary_customer, min(t) as created_t, max(t) as updated_t from asg group by case_id),
cs as (select *, 4 as modalities, case when risk_score >= 0.9 then 'CRITICAL' when risk_score >= 0.75 or (risk_score >= 0.5) then 'HIGH' else 'LOW' end as severity from roll)"""


@register("g7_case_rollup", _rec([TXN, ENT, LOG, ALERTS, *_greedy("t, order_id"), "asg as (select al.*, case_id from al join gr using (order_id))", ROLL],
    "select * from cs", ["risk_score", "estimated_exposure"]))
def _(spark, d):
    return cases.case_rollup(cases.assign_cases(_alerts(spark, d)))


@register("g7_component_rollup", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL], "select * from cs", ["risk_score", "estimated_exposure"]))
def _(spark, d):
    return cases.case_rollup(_by_component(spark, d)[0])


GRAPH8 = """
m as (select 'id_' || substr(sha256(case_id), 1, 10) as cid, 'id_' || substr(sha256(cast(customer_id as varchar)), 1, 10) as cu, 'id_' || substr(sha256(cast(order_id as varchar)), 1, 10) as od, order_id from asg),
me as (select cid, cu, etype, 'id_' || substr(sha256(etype || '_id:' || value), 1, 10) as en from m join ent using (order_id)),
ge as (select distinct cid as case_id, cu as source, od as target, 'customer-placed-order' as relationship from m union select cid, cu, en, 'customer-used-' || etype from me),
gn as (select cid as case_id, cu as node, 'customer' as type from m union select cid, od, 'order' from m union select cid, en, etype || '_id' from me)"""


@register("g8_case_graph", _rec([TXN, ENT, LOG, ALERTS, *COMP, GRAPH8], "select * from ge"))
def _(spark, d):
    a, al = _by_component(spark, d)
    return cases.case_graph(a, al)[1]


@register("c7_graph_counts", _rec([TXN, ENT, LOG, ALERTS, *COMP, GRAPH8], """select case_id, nodes, edges, shared_entities from
  (select case_id, count(*) as nodes, count_if(type like '%\\_id' escape '\\') as shared_entities from gn group by case_id) join (select case_id, count(*) as edges from ge group by case_id) using (case_id)"""))
def _(spark, d):
    a, al = _by_component(spark, d)
    return cases.graph_counts(*cases.case_graph(a, al))


def _with_status(c: DataFrame) -> DataFrame:
    k = F.col("primary_customer") % 3
    return c.withColumn("status", F.when(k == 0, "CLOSED").when(k == 1, "IN_REVIEW").otherwise("NEW"))


STATUS = "st as (select *, case primary_customer % 3 when 0 then 'CLOSED' when 1 then 'IN_REVIEW' else 'NEW' end as status from cs)"


@register("c5_case_aggregates", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL, STATUS], """select count_if(status <> 'CLOSED') as open, count_if(severity = 'CRITICAL') as critical,
  round(sum(estimated_exposure), 2) as exposure, round(avg(risk_score), 4) as avg_risk from st"""))
def _(spark, d):
    return cases.case_aggregates(_with_status(cases.case_rollup(_by_component(spark, d)[0])))


@register("c5_case_breakdown", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL, STATUS], """select 'severity' as dimension, severity as name, count(*) as cases from st group by all
  union all select 'status', status, count(*) from st group by all"""))
def _(spark, d):
    return cases.case_breakdown(_with_status(cases.case_rollup(_by_component(spark, d)[0])))


@register("p14_filter_cases", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL, STATUS], "select case_id, status, severity, risk_score from st where severity = 'CRITICAL' and risk_score >= 0.9", ["risk_score"]))
def _(spark, d):
    return cases.filter_cases(_with_status(cases.case_rollup(_by_component(spark, d)[0])), severity="CRITICAL", min_risk=0.9).select(
        "case_id", "status", "severity", "risk_score")


@register("c8_active_case", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL, STATUS], """select case_id, status, risk_score from st where case_id in (select case_id from asg where retry_count = 1)
  order by status = 'CLOSED', risk_score desc, case_id limit 1""", ["risk_score"]))
def _(spark, d):
    a, _ = _by_component(spark, d)
    run = _txn(spark, d).filter("retry_count = 1")
    return cases.pick_active_case(_with_status(cases.case_rollup(a)), a, run).select("case_id", "status", "risk_score")


P13 = """
gc as (select cid, count(distinct case when etype = 'device' then en end) as devices, count(distinct case when etype = 'payment' then en end) as payments from me group by cid),
sx as (select 'id_' || substr(sha256(case_id), 1, 10) as cid, st.* from st),
act as (
  select cid, 1 as priority, 'Escalate to risk operations' as title, 'ESCALATED' as action, format('{} severity at risk {:.2f} over {} alerts', severity, risk_score, alert_count) as detail
    from sx where status = 'IN_REVIEW' and (severity = 'CRITICAL' or (severity = 'HIGH' and risk_score >= 0.9))
  union all select cid, 1, 'Prioritize for exposure review', '', format('Exposure of {:.2f} is at or above 1000', estimated_exposure::double) from sx where estimated_exposure >= 1000
  union all select cid, 2, 'Trace the shared device cluster', '', format('{} customers on {} devices', customers, devices) from sx join gc using (cid) where devices <= 2 and customers >= 3
  union all select cid, 3, 'Correlate payment instruments', '', format('{} payment instruments in the case', payments) from sx join gc using (cid) where payments > 0
  union all select cid, 2, 'Open the review', 'IN_REVIEW', format('Nobody has looked at {} alerts yet', alert_count) from sx where status = 'NEW'
  union all select cid, 3, 'Confirm coordinated abuse', 'CONFIRMED_ABUSE', 'Records the finding' from sx where status = 'IN_REVIEW'
  union all select cid, 3, 'Mark legitimate and release', 'LEGITIMATE', 'Records that nothing was found' from sx where status = 'IN_REVIEW'
  union all select cid, 4, 'Close the case', 'CLOSED', 'Ends the work on it' from sx where status <> 'CLOSED'
  union all select cid, 5, 'Add an analyst note', 'note', 'Keeps what was seen' from sx)"""


@register("p13_next_actions", _rec([TXN, ENT, LOG, ALERTS, *COMP, ROLL, STATUS, GRAPH8, P13],
    "select cid as case_id, cast(row_number() over (partition by cid order by priority, title) - 1 as int) as position, priority, title, action, detail, true as allowed from act"))
def _(spark, d):
    a, al = _by_component(spark, d)
    n, _ = cases.case_graph(a, al)
    c = _with_status(cases.case_rollup(a)).withColumn("case_id", fn.mask_identifier("case_id"))
    per = n.groupBy("case_id").agg(F.count_if(F.col("type") == "device_id").alias("devices"), F.count_if(F.col("type") == "payment_id").alias("payments"))
    out = cases.case_next_actions(c, per)
    return out.select("case_id", F.posexplode("actions").alias("position", "a")).select("case_id", "position", "a.*")


def _requests(spark, d) -> DataFrame:
    """Status requests and notes derived from events: the user is the case, the event type the request."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("timestamp").alias("ts"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        F.when(F.col("event_type") == "view", "IN_REVIEW").when(F.col("event_type") == "error", "ESCALATED").when(F.col("event_type") == "signup", "CONFIRMED_ABUSE")
        .when(F.col("event_type") == "purchase", "LEGITIMATE").otherwise("CLOSED").alias("status"),
        F.col("event_type").alias("actor"), F.col("props").alias("reason"))


@register("c3_status_fold", """with recursive rq as (select cast(user_id as varchar) as case_id, event_id, ts,
    case event_type when 'view' then 'IN_REVIEW' when 'error' then 'ESCALATED' when 'signup' then 'CONFIRMED_ABUSE' when 'purchase' then 'LEGITIMATE' else 'CLOSED' end as status from events),
  num as (select *, row_number() over (partition by case_id order by ts, event_id) as k from rq),
  f as (select case_id, 0::bigint as k, 'NEW' as status, '' as disposition from (select distinct case_id from rq)
    union all select n.case_id, n.k,
      case when n.status in (select unnest(case f.status when 'NEW' then ['IN_REVIEW', 'CLOSED'] when 'IN_REVIEW' then ['ESCALATED', 'CONFIRMED_ABUSE', 'LEGITIMATE', 'CLOSED']
        when 'ESCALATED' then ['CONFIRMED_ABUSE', 'LEGITIMATE', 'CLOSED'] when 'CONFIRMED_ABUSE' then ['CLOSED'] when 'LEGITIMATE' then ['CLOSED'] else [] end)) then n.status else f.status end,
      case when n.status in ('CONFIRMED_ABUSE', 'LEGITIMATE') and f.status in ('IN_REVIEW', 'ESCALATED') then n.status else f.disposition end
    from f join num n on n.case_id = f.case_id and n.k = f.k + 1)
  select case_id, arg_max(status, k) as status, arg_max(disposition, k) as disposition from f group by case_id""")
def _(spark, d):
    rq = _requests(spark, d)
    _, state = cases.case_status_fold(rq, rq.select("case_id"))
    return state.select("case_id", "status", F.coalesce("disposition", F.lit("")).alias("disposition"))


@register("c3_status_history", """with recursive rq as (select cast(user_id as varchar) as case_id, event_id, ts,
    case event_type when 'view' then 'IN_REVIEW' when 'error' then 'ESCALATED' when 'signup' then 'CONFIRMED_ABUSE' when 'purchase' then 'LEGITIMATE' else 'CLOSED' end as status from events),
  num as (select *, row_number() over (partition by case_id order by ts, event_id) as k from rq),
  f as (select case_id, 0::bigint as k, 'NEW' as status, null::varchar as previous, false as applied from (select distinct case_id from rq)
    union all select n.case_id, n.k, case when ok then n.status else f.status end, f.status, ok
    from f join num n on n.case_id = f.case_id and n.k = f.k + 1, lateral (select n.status in (select unnest(case f.status when 'NEW' then ['IN_REVIEW', 'CLOSED'] when 'IN_REVIEW' then ['ESCALATED', 'CONFIRMED_ABUSE', 'LEGITIMATE', 'CLOSED']
        when 'ESCALATED' then ['CONFIRMED_ABUSE', 'LEGITIMATE', 'CLOSED'] when 'CONFIRMED_ABUSE' then ['CLOSED'] when 'LEGITIMATE' then ['CLOSED'] else [] end)) as ok) l)
  select case_id, previous, status as new from f where applied""")
def _(spark, d):
    rq = _requests(spark, d)
    history, _ = cases.case_status_fold(rq, rq.select("case_id"))
    return history.select("case_id", "previous", "new")


@register("c4_notes", """select conv_id as case_id, turn as note_id, replace(text, chr(10), ' ') as note, 'id_' || substr(sha256(role), 1, 10) as actor, 'note_added' as action,
  row_number() over (partition by conv_id order by turn, turn) as note_no from conversations""")
def _(spark, d):
    n = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("note_id"), F.col("turn").alias("ts"),
                                                F.col("text").alias("note"), F.col("role").alias("actor"))
    return cases.append_notes(n).drop("ts")


@register("c6_timeline", """select cast(user_id as varchar) as case_id, lpad(cast(event_id as varchar), 12, '0') as event_id, position from
  (select *, row_number() over (partition by user_id order by ts, event_id) as position from events) where position <= 8""")
def _(spark, d):
    return cases.case_timeline(_requests(spark, d), 8).select("case_id", "event_id", "position")


DOSSIER = """
tg as (select * from txn where predicted_score >= 0.9),
one as (select distinct g.order_id, g.customer_id as me, g.t as tt, e.etype, p.customer_id as peer from tg g join ent e using (order_id) join ent p
  on p.etype = e.etype and p.value = e.value and p.t < g.t and p.t >= g.t - 2592000000000 and p.customer_id <> g.customer_id),
pe as (select distinct order_id, me, tt, peer from one),
far as (select distinct p.order_id, p.me, p.tt, p.peer, x.etype, x.value from pe p join ent x on x.customer_id = p.peer and x.t < p.tt and x.t >= p.tt - 2592000000000
  join ent c on c.order_id = p.order_id and c.etype = x.etype and c.value <> x.value),
two as (select distinct f.order_id, f.me, f.peer, f.etype, f.value, y.customer_id as other from far f join ent y on y.etype = f.etype and y.value = f.value and y.t < f.tt
  and y.t >= f.tt - 2592000000000 and y.customer_id <> f.me and y.customer_id <> f.peer),
mb as (select order_id, customer_id as c from tg union select order_id, peer from pe union select order_id, other from two),
vs as (select e.order_id, e.etype, e.value from tg join ent e using (order_id) union select order_id, etype, value from far),
act as (select m.order_id, count(*) as n30, count_if(x.t >= g.t - 604800000000) as n7, count_if(x.t >= g.t - 86400000000) as n24, count_if(x.t >= g.t - 3600000000) as n1,
  sum(x.amount) as loss, min(x.t) as first_t from mb m join tg g using (order_id) join txn x on x.customer_id = m.c and x.t < g.t and x.t >= g.t - 2592000000000 group by all)"""


@register("g9_dossier", _q([TXN, ENT, DOSSIER], """select order_id, customer_id as target_customer, (select count(*) from mb where mb.order_id = g.order_id) as total_customers,
  (select count(*) from pe where pe.order_id = g.order_id) as one_hop, (select count(distinct other) from two where two.order_id = g.order_id) as two_hop,
  (select count(*) from vs where vs.order_id = g.order_id) as total_entities,
  (select count(*) from one where one.order_id = g.order_id) + (select count(*) from two where two.order_id = g.order_id) as path_count,
  coalesce(n7, 0) as peer_orders_7d, coalesce(n30, 0) as peer_orders_30d, coalesce(n24, 0) / greatest(1.0::double, coalesce(n7, 0) / 7.0::double) as peer_velocity_ratio_24h_vs_7d,
  coalesce(loss, 0) + amount as total_cluster_exposure, coalesce(first_t, t) as first_activity_t, cast(coalesce(n1, 0) as double) as dossier_order_burst_1h
  from tg g left join act using (order_id)""", ["peer_velocity_ratio_24h_vs_7d", "total_cluster_exposure"]))
def _(spark, d):
    t = _txn(spark, d)
    s = dossier.dossiers(t.filter("predicted_score >= 0.9").select("order_id"), t, t).summary
    return s.select("order_id", "target_customer", "total_customers", "one_hop", "two_hop", "total_entities", "path_count", "peer_orders_7d", "peer_orders_30d",
                    "peer_velocity_ratio_24h_vs_7d", "total_cluster_exposure", "first_activity_t", "dossier_order_burst_1h")


# ---- quality and gates --------------------------------------------------------------------------

@register("q1_split_summary", _q([TXN, SPLIT, "rt as (select split, count(*) as returns from sp where merchant_category = 'error' group by all)"],
    """select split, count(*) as orders, count(distinct customer_id) as unique_customers, any_value(returns) as returns, count_if(is_abuse = 1) as abuse_orders, count_if(is_abuse = 1) / count(*) * 100 as abuse_rate_pct,
  sum(case when is_abuse = 1 then loss_amount else 0 end) as abuse_exposure, count(distinct case when is_abuse = 1 then ring_id end) as active_rings from sp join rt using (split) group by split""",
    ["abuse_rate_pct", "abuse_exposure"]))
def _(spark, d):
    t = _txn(spark, d)
    return quality.split_summary(events.split_by_time(t), _labels(t), t.filter("merchant_category = 'error'").select("order_id"))


@register("q2_rings_by_type", _q([TXN, SPLIT, "lv as (select distinct split, ring_id, abuse_type from sp where is_abuse = 1 and ring_id is not null)",
    "rg as (select ring_id, min(abuse_type) as ring_type from txn where ring_id is not null group by all)",
    "ty as (select unnest(['shared_device', 'shared_address', 'behavioral', 'mixed', 'Total']) as ring_type)"],
    """select ring_type, (select count(distinct ring_id) from lv where split = 'train' and (abuse_type = ring_type or ring_type = 'Total')) as train_active,
  (select count(distinct ring_id) from lv where split = 'validation' and (abuse_type = ring_type or ring_type = 'Total')) as validation_active,
  (select count(distinct ring_id) from lv where split = 'test' and (abuse_type = ring_type or ring_type = 'Total')) as test_active,
  (select count(*) from rg where rg.ring_type = ty.ring_type or ty.ring_type = 'Total') as total_rings from ty"""))
def _(spark, d):
    t = _txn(spark, d)
    return quality.rings_by_type(events.split_by_time(t), _labels(t), quality.ring_table(t))


@register("q3_ring_statistics", _q([TXN, "rg as (select ring_id, count(distinct customer_id) as n, (max(t) - min(t)) / 86400e6::double as dur, count_if(is_abuse = 1) as ords from txn where ring_id is not null group by all)",
    "l as (select 'ring_size' as measure, n::double as v from rg union all select 'duration_days', dur from rg union all select 'orders_per_ring', ords::double from rg)"],
    "select measure, count(*) as rings, avg(v) as mean, min(v) as min, max(v) as max, median(v) as median from l group by measure", ["mean", "min", "max", "median"]))
def _(spark, d):
    t = _txn(spark, d)
    return quality.ring_statistics(quality.ring_table(t), _labels(t))


@register("q4_entity_overlap", _q([TXN, ENT, "x as (select ent.*, is_abuse = 1 as bad from ent join txn using (order_id))",
    "v as (select etype, value, bool_or(bad) as bad, bool_or(not bad) as good, count(distinct case when not bad then customer_id end) as lc from x group by all)"],
    """select etype, count_if(bad and good) as overlap_count, count_if(bad and good) / greatest(1, count_if(bad)) * 100 as abuse_values_in_legit_pct,
  count_if(lc > 1) as legit_multi_customer_count from v group by etype""", ["abuse_values_in_legit_pct"]))
def _(spark, d):
    t = _txn(spark, d)
    return quality.entity_overlap(t, _labels(t))


@register("q5_dataset_counts", _q([TXN], """select 'orders' as table_name, count(*) as row_count from txn union all select 'customers', count(*) from customer
  union all select 'rings', count(distinct ring_id) from txn union all select 'labels', count(*) from txn
  union all select 'ring_memberships', (select count(*) from (select distinct ring_id, customer_id from txn where ring_id is not null))
  union all select 'ground_truth', count(distinct customer_id) from txn union all select 'returns', count(*) from txn where order_id % 5 = 0"""))
def _(spark, d):
    t = _txn(spark, d)
    return quality.dataset_counts({
        "orders": t, "customers": table(spark, d, "customer"), "rings": quality.ring_table(t), "labels": t.select("order_id", "is_abuse"),
        "ring_memberships": t.filter("ring_id is not null").select("ring_id", "customer_id").distinct(),
        "ground_truth": t.groupBy("customer_id").agg(F.max("is_abuse")), "returns": t.filter(F.col("order_id").cast("long") % 5 == 0)})


@register("q6_stream_quality", _q([TXN, "h as (select * from txn where event_time < timestamp '2024-01-20')", "b as (select * from txn where event_time >= timestamp '2024-01-20')"],
    """select count(*) as orders, avg(cast(order_id % 11 = 0 or order_id % 13 = 0 as double)) as null_id_rate,
  avg(cast(order_id % 7 <> 0 and device_id not in (select device_id from h) as double)) as unseen_device_rate,
  avg(cast(order_id % 5 <> 0 and ip_id not in (select ip_id from h) as double)) as unseen_ip_rate, avg((order_id % 3 = 0)::int + (order_id % 4 = 0)::int) / 3 as feature_null_rate from b""",
    ["null_id_rate", "unseen_device_rate", "unseen_ip_rate", "feature_null_rate"]))
def _(spark, d):
    """A batch with missing and blank ids, missing and null-like values, and features without a value."""
    t = _txn(spark, d)
    cut = F.col("event_time") < F.lit("2024-01-20").cast("timestamp")
    k = F.col("order_id").cast("long")
    batch = t.filter(~cut).withColumn("k", k)
    features = batch.select("order_id", F.when(k % 3 != 0, 1.0).alias("a"), F.when(k % 4 != 0, 1.0).alias("b"), F.lit(1.0).alias("c"))
    batch = batch.withColumn("device_id", F.when(k % 7 != 0, F.col("device_id"))).withColumn("ip_id", F.when(k % 5 == 0, " nan ").otherwise(F.col("ip_id")))
    batch = batch.withColumn("customer_id", F.when(k % 13 == 0, "").otherwise(F.col("customer_id").cast("string")))
    batch = batch.withColumn("order_id", F.when(k % 11 != 0, F.col("order_id").cast("string")))
    return quality.stream_quality(batch.drop("k"), t.filter(cut), features, ["a", "b", "c"])


_ASIDE = "two_hop_total_peer_orders_7d"


@register("q7_parity", _q([TXN], "select run, feature, count(*) as comparisons, count(*) - case when run = 'with a fault' and feature = '" + _ASIDE + """' then count_if(order_id % 50 = 3) else 0 end as exact_matches,
  case when run = 'with a fault' and feature = '""" + _ASIDE + "' and count_if(order_id % 50 = 3) > 0 then 0.5 else 0 end::double as max_difference from txn, (values ('replay'), ('with a fault')) r(run), (select unnest(["
    + ", ".join(f"'{c}'" for c in FEATURE_CONTRACT) + "]) as feature) f group by run, feature", ["max_difference"]))
def _(spark, d):
    """What a replayed stream wrote against the batch matrix, all contract columns; then with a fault put into one of them."""
    at = scratch_path(spark, "replay")
    stream = jobs.stream_features(_arrive(spark, d, at, range(4), 2), HistoryStore(f"{at}/history", buckets=8), f"{at}/out", f"{at}/cp")
    try:
        batch = _matrix(spark, d)  # made while the stream runs
        stream.awaitTermination()
    finally:
        stream.stop()
    online = materialise(spark.read.parquet(f"{at}/out").drop("batch_id"), "online")
    off = online.withColumn(_ASIDE, F.col(_ASIDE) + F.when(F.col("order_id") % 50 == 3, 0.5).otherwise(0.0))
    out = None
    for run, one in (("replay", online), ("with a fault", off)):
        report = quality.parity_report(quality.parity_cells(batch, one, FEATURE_CONTRACT)).withColumn("run", F.lit(run))
        out = report if out is None else out.unionByName(report)
    return out


_METRICS = """select count(*) as total_processed, 0 as duplicates, count_if(fallback_applied) as fallbacks, count_if(scoring_failed) as failures, count_if(alert) as alerts,
  count_if(alert) / count(*) as alert_rate, avg(latency_ms) as latency_mean, quantile_cont(latency_ms, 0.5) as latency_p50, quantile_cont(latency_ms, 0.9) as latency_p90,
  quantile_cont(latency_ms, 0.95) as latency_p95, quantile_cont(latency_ms, 0.99) as latency_p99 from log"""


@register("l1_service_metrics", _q([TXN, LOG], _METRICS, ["alert_rate", "latency_mean", "latency_p50", "latency_p90", "latency_p95", "latency_p99"]))
def _(spark, d):
    return gates.service_metrics(_log(_txn(spark, d)))


@register("l2_non_enforcement", _q([TXN, LOG, """lv as (select 'as logged' as log, action, false as enforced from log union all select 'with blocks', case when order_id % 1000 = 0 then 'block' else action end, false from log
  union all select 'with enforced blocks', case when order_id % 1000 = 0 then 'BLOCK' else action end, true from log)"""],
    "select log, 'non_enforcement' as gate, count_if(upper(action) = 'BLOCK' and not enforced) = 0 as passed, case when count_if(upper(action) = 'BLOCK' and not enforced) = 0 then 'PASS' else 'FAIL' end as status from lv group by log"))
def _(spark, d):
    log = _log(_txn(spark, d))
    blocked = F.col("order_id").cast("long") % 1000 == 0
    logs = {"as logged": log, "with blocks": log.withColumn("action", F.when(blocked, "block").otherwise(F.col("action"))),
            "with enforced blocks": log.withColumn("action", F.when(blocked, "BLOCK").otherwise(F.col("action"))).withColumn("enforce_decisions", F.lit(True))}
    out = None
    for name, one in logs.items():
        row = gates.gate_non_enforcement(one).withColumn("log", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("log", "gate", "passed", "status")


@register("l6_contract_gate", _q([TXN], """select * from (values ('whole', true, 'PASS'), ('dropped', false, 'FAIL'), ('swapped', false, 'FAIL'), ('added', false, 'FAIL')) v(columns, passed, status),
  (select 'feature_contract' as gate, count(*) as orders from txn) n"""))
def _(spark, d):
    """The contract over matrices with a column less, two in each other's place, and one more."""
    fb = behaviour.baseline_features(_txn(spark, d))
    names = [c for c in fb.columns if c != "order_id"]
    kinds = {"whole": fb, "dropped": fb.drop(names[3]), "swapped": fb.select("order_id", names[1], names[0], *names[2:]), "added": fb.withColumn("extra", F.lit(1.0))}
    n = materialise(fb.agg(F.count("*").alias("orders")), "orders")
    out = None
    for name, one in kinds.items():
        row = gates.gate_contract(one, names).withColumn("columns", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return fn.beside(out.select("columns", "gate", "passed", "status"), n)


_L3 = """select 'error_rates' as gate, (fb = 0 and fl = 0) or fb < 0.005 as passed, case when fb = 0 and fl = 0 then 'PASS' when fb < 0.005 then 'WARN' else 'FAIL' end as status
  from (select count_if(fallback_applied) / count(*) as fb, count_if(scoring_failed) / count(*) as fl from log)"""


@register("l3_error_gate", _q([TXN, LOG], _L3))
def _(spark, d):
    return gates.gate_error_rates(gates.service_metrics(_log(_txn(spark, d))))


CARD = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
_PII_SQL = f"cast(regexp_matches(s, '{CARD}') as int) + cast(contains(lower(s), 'password') or contains(lower(s), 'secret') as int)"


@register("l4_pii", f"select doc_id, {_PII_SQL} as leaks from (select doc_id, text || ' ' || lang || ' ' || source as s from documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.pii_hits(None, ["text", "lang", "source"]).alias("leaks"))


_L5 = """select 'latency' as gate, p95 <= 300 as passed, case when p95 <= 25 and p99 <= 50 then 'PASS' when p95 <= 300 then 'WARN' else 'FAIL' end as status
  from (select quantile_cont(latency_ms, 0.95) as p95, quantile_cont(latency_ms, 0.99) as p99 from log)"""


@register("l5_latency_gate", _q([TXN, LOG], _L5))
def _(spark, d):
    return gates.gate_latency(gates.service_metrics(_log(_txn(spark, d))))


_L4G = f"select 'pii_masking' as gate, sum(leaks) = 0 as passed, case when sum(leaks) = 0 then 'PASS' else 'FAIL' end as status from (select {_PII_SQL} as leaks from (select text || ' ' || lang || ' ' || source as s from documents))"


@register("l6_gate_matrix", _q([TXN, LOG, f"""gt as (select 'feature_contract' as gate, true as passed, 'PASS' as status union all select 'non_enforcement', true, 'PASS'
  union all {_L3} union all {_L4G} union all {_L5})"""],
    "select *, (select case when not bool_and(passed) then 'FAIL' when bool_or(status = 'WARN') then 'WARN' else 'PASS' end from gt) as overall_status from gt"))
def _(spark, d):
    log = _log(_txn(spark, d))
    m = gates.service_metrics(log)
    scored = _matrix(spark, d).drop("split", "is_abuse", "ring_id", "abuse_type", "loss_amount")
    return gates.gate_matrix(gates.gate_contract(scored, FEATURE_CONTRACT), gates.gate_non_enforcement(log), gates.gate_error_rates(m),
                             gates.gate_pii(table(spark, d, "documents"), ["text", "lang", "source"]), gates.gate_latency(m))


DAYS = """
dy as (select cast(cast(event_time as date) as varchar) as date_str, count(*) as total_transactions, count_if(order_id % 9973 = 0) as error_count,
  count_if(retry_count = 1 and order_id % 5003 = 0) as fallback_count, 0 as blocked_transactions, quantile_cont(amount, 0.95) as p95_latency_ms from txn group by all),
dn as (select *, row_number() over (order by date_str) as k from dy),
ds as (select * exclude (k), case when k % 9 = 0 then 'STAGING_REPLAY' else 'REAL_LIVE_PRODUCTION' end as data_source,
  case when k % 14 = 0 then sha256('other') when k % 23 <> 0 then sha256('model') end as model_checksum, sha256('model') as target_checksum,
  case when k % 15 = 0 then 136 else 137 end as feature_count, case when k % 17 = 0 then 1 else 0 end as pii_violations,
  error_count / total_transactions <= 0.001 and fallback_count / total_transactions <= 0.001 and p95_latency_ms <= 300
  and k % 14 <> 0 and k % 23 <> 0 and k % 15 <> 0 and k % 17 <> 0 as passes from dn)"""


def _days(spark, d) -> DataFrame:
    log = _log(_txn(spark, d)).withColumn("scoring_failed", F.col("order_id") % 9973 == 0).withColumn(
        "fallback_applied", (F.col("retry_count") == 1) & (F.col("order_id") % 5003 == 0))
    days = materialise(gates.daily_observations(log), "days")
    # one row per day, so numbering the days is bounded work
    first = F.to_date(F.lit("2024-01-01"))
    k = F.datediff(F.to_date("date_str"), first) + 1
    # days with another model, a feature less, a leak, or without a checksum
    days = days.withColumn("model_checksum", F.when(k % 14 == 0, F.sha2(F.lit("other"), 256)).when(k % 23 != 0, F.sha2(F.lit("model"), 256)))
    days = days.withColumn("feature_count", F.when(k % 15 == 0, 136).otherwise(137)).withColumn("pii_violations", F.when(k % 17 == 0, 1).otherwise(0))
    days = days.withColumn("data_source", F.when(k % 9 == 0, "STAGING_REPLAY").otherwise("REAL_LIVE_PRODUCTION"))
    return gates.daily_threshold_flags(days.withColumn("target_checksum", F.sha2(F.lit("model"), 256)))


@register("l7_daily_flags", _q([TXN, DAYS], "select * from ds", ["p95_latency_ms"]))
def _(spark, d):
    return _days(spark, d)


@register("l8_streak", _q([TXN, DAYS, "rs as (select max(case when not (data_source = 'REAL_LIVE_PRODUCTION' and passes) then date_str end) as r from ds)",
    "x as (select count_if(data_source = 'REAL_LIVE_PRODUCTION') as live, count(*) as n, count_if(data_source = 'REAL_LIVE_PRODUCTION' and not passes) as failed, count_if(r is null or date_str > r) as streak from ds, rs)",
    "y as (select case when live = 0 then 'NOT STARTED — LIVE TRAFFIC NOT ATTACHED' when failed > 0 then 'NO-GO — SHADOW GATE FAILED' when streak >= 7 then 'GO — ELIGIBLE FOR 5% CANARY' else 'IN PROGRESS — LIVE SHADOW OBSERVATION' end as status, * from x)"],
    "select status, case when live = 0 then 0 else streak end as qualifying_days, n as days_inspected, status like 'GO%' as canary_eligible from y"))
def _(spark, d):
    return gates.qualifying_streak(_days(spark, d))


@register("l8_rejected_days", _q([TXN, DAYS], """select date_str, case when data_source <> 'REAL_LIVE_PRODUCTION' then 'source ' || data_source else 'safety thresholds' end as reason
  from ds where not (data_source = 'REAL_LIVE_PRODUCTION' and passes)"""))
def _(spark, d):
    return gates.rejected_days(_days(spark, d))


@register("l9_health_bands", _q([TXN, LOG, """hb as (select cast(cast(event_time as date) as varchar) as date, avg(predicted_score) as mean_score, count_if(alert) / count(*) as alert_rate,
  count_if(alert and is_abuse = 1) / count_if(alert) as lagged_precision, count_if(scoring_failed) / count(*) as failure_rate from log group by all)"""],
    """select *, case when mean_score < 0.06 then 'green' when mean_score <= 0.10 then 'warning' else 'critical' end as mean_score_band,
  case when alert_rate < 0.03 then 'green' when alert_rate <= 0.05 then 'warning' else 'critical' end as alert_rate_band,
  case when lagged_precision >= 0.85 then 'green' when lagged_precision >= 0.75 then 'warning' else 'critical' end as lagged_precision_band,
  case when failure_rate < 0.0001 then 'green' when failure_rate <= 0.001 then 'warning' else 'critical' end as failure_rate_band from hb""", ["mean_score", "alert_rate", "lagged_precision", "failure_rate"]))
def _(spark, d):
    log = _log(_txn(spark, d)).withColumn("date", F.to_date("event_time").cast("string"))
    n = F.count("*").cast("double")
    daily = log.groupBy("date").agg(F.avg("predicted_score").alias("mean_score"), (F.count_if("alert") / n).alias("alert_rate"),
                                    (F.count_if(F.col("alert") & (F.col("is_abuse") == 1)) / F.count_if("alert")).alias("lagged_precision"),
                                    (F.count_if("scoring_failed") / n).alias("failure_rate"))
    return gates.health_bands(daily)


DAY_PSI = """
inner_ as (select es[2:len(es) - 1] as es from (select list_sort(list_distinct(quantile_cont(predicted_score, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) as es from sp where split = 'train')),
placed as (select cast(cast(event_time as date) as varchar) as date, split, len(list_filter(es, lambda e: e <= predicted_score)) as bin from sp, inner_),
bins as (select bin, case when ce = 0 then 1e-5::double else ce / (sum(ce) over ()) end as pe from (select b.bin, count(placed.bin) as ce from (select unnest(range((select len(es) + 1 from inner_))) as bin) b
  left join placed on placed.bin = b.bin and split = 'train' group by b.bin)),
days as (select date, count(*) as n from placed group by date),
shares as (select date, pe, case when count(placed.bin) = 0 then 1e-5::double else count(placed.bin) / any_value(n) end as pa from days cross join bins left join placed using (date, bin) group by date, bin, pe),
dpsi as (select date, sum((pa - pe) * ln(pa / pe)) as psi from shares group by date)"""


@register("l9_case_and_drift_bands", _rec([TXN, ENT, DAILY, SPLIT, DAY_PSI],
    """select date, consolidated_cases::double as case_rate, psi, case when consolidated_cases < 5 then 'green' when consolidated_cases <= 10 then 'warning' else 'critical' end as case_rate_band,
  case when psi < 0.10 then 'green' when psi <= 0.25 then 'warning' else 'critical' end as psi_band from dw join dpsi using (date)""", ["case_rate", "psi"]))
def _(spark, d):
    """Cases of each day and how far its scores moved from those of the training period."""
    t = materialise(events.split_by_time(_txn(spark, d)).withColumn("date", F.to_date("event_time").cast("string")), "l9")
    cases_ = rings.daily_workload(t.drop("date")).select("date", F.col("consolidated_cases").cast("double").alias("case_rate"))
    return gates.health_bands(cases_.join(drift.psi_by(t.filter("split = 'train'"), t, "predicted_score", "date"), "date"))


@register("l10_replay_summary", _q([TXN, LOG], """select min(t) as first_t, max(t) as last_t, count(*) as events, count_if(alert) as alerts, count_if(alert) / count(*) * 100 as alert_rate_pct,
  count_if(fallback_applied) as fallbacks, avg(latency_ms) as latency_mean, quantile_cont(latency_ms, 0.95) as latency_p95, quantile_cont(latency_ms, 0.99) as latency_p99 from log""",
    ["alert_rate_pct", "latency_mean", "latency_p95", "latency_p99"]))
def _(spark, d):
    return gates.replay_summary(_log(_txn(spark, d)))


# ---- sinks: written and read back ---------------------------------------------------------------

@register("s1_csv_tables", _q([TXN], """select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, t, amount, 'INR' as currency, device_id, ip_id,
  address_id, payment_id, merchant_category, retry_count from txn""", ["amount"]))
def _(spark, d):
    rows = _txn(spark, d).select(
        F.col("order_id").cast("string"), F.col("customer_id").cast("string"), "event_time", "amount", F.lit("INR").alias("currency"), "device_id", "ip_id",
        "address_id", "payment_id", "merchant_category", F.lit("ok").alias("status"), "retry_count")
    at = scratch_path(spark, "tables")
    tables.write_tables({"orders": rows}, at, metadata={"source": "events"})
    return timed(tables.read_tables(spark, at, names=["orders"])["orders"]).drop("event_time", "status")


@register("s1_seven_tables", _q([TXN], """select 'customers' as name, count(distinct customer_id) as n, null::double as amount from txn union all select 'orders', count(*), sum(amount) from txn
  union all select 'labels', count(*), sum(loss_amount) from txn union all select 'rings', count(distinct ring_id), null from txn
  union all select 'ring_memberships', (select count(*) from (select distinct ring_id, customer_id from txn where ring_id is not null)), null
  union all select 'ground_truth', count(distinct customer_id), null from txn union all select 'returns', count(*) filter (order_id % 5 = 0), sum(amount) filter (order_id % 5 = 0) from txn""", ["amount"]))
def _(spark, d):
    """All seven tables written as gzip CSV and as parquet, and both read back with their schemas."""
    t = _txn(spark, d).withColumn("order_id", F.col("order_id").cast("string")).withColumn("customer_id", F.col("customer_id").cast("string")).withColumn(
        "ring_id", F.col("ring_id").cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    ringed = t.filter("ring_id is not null")
    made = {
        "customers": t.groupBy("customer_id").agg(F.min("event_time").alias("signup_time")).select(
            "customer_id", "signup_time", F.lit("IN").alias("country"), F.lit("new").alias("segment"), F.lit(0.5).alias("baseline_risk"),
            none("long").alias("household_id"), none("long").alias("workgroup_id")),
        "orders": t.select("order_id", "customer_id", "event_time", "amount", F.lit("INR").alias("currency"), "device_id", "ip_id", "address_id", "payment_id",
                           "merchant_category", F.lit("ok").alias("status"), F.col("retry_count").cast("int").alias("retry_count")),
        "labels": t.select("order_id", (F.col("is_abuse") == 1).alias("is_abuse"), "ring_id", "abuse_type", F.col("loss_amount").cast("double").alias("loss_amount"), F.lit("a,b").alias("reason_codes")),
        "rings": ringed.groupBy("ring_id").agg(F.min("abuse_type").alias("ring_type"), F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"),
                                               F.count_distinct("customer_id").alias("customer_count"), F.lit(1.0).alias("intensity")),
        "ring_memberships": ringed.groupBy("ring_id", "customer_id").agg(F.min("event_time").alias("joined_at"), F.max("event_time").alias("left_at"), F.min("abuse_type").alias("ring_type")),
        "ground_truth": t.groupBy("customer_id").agg(F.min("ring_id").alias("ring_id"), F.min("abuse_type").alias("ring_type"), (F.max("is_abuse") == 1).alias("is_abusive")),
        "returns": t.filter("cast(order_id as long) % 5 = 0").select(F.concat(F.lit("R"), "order_id").alias("return_id"), "order_id", "customer_id", "event_time",
                                                                     F.lit("size, colour").alias("reason"), F.col("amount").alias("refund_amount")),
    }
    at = scratch_path(spark, "tables")
    out = None
    for fmt in ("csv", "parquet"):
        tables.write_tables(made, f"{at}/{fmt}", fmt, metadata={"source": "events"})
    for fmt in ("csv", "parquet"):
        for name, df in tables.read_tables(spark, f"{at}/{fmt}", fmt).items():
            money = next((c for c in ("amount", "loss_amount", "refund_amount") if c in df.columns), None)
            row = df.agg(F.count("*").alias("n"), (F.sum(money) if money else none("double")).alias("amount")).withColumn("name", F.lit(name))
            out = row if out is None else out.unionByName(row)
    # both formats hold the same, so a row that differs would be one too many
    return out.select("name", "n", F.round("amount", 4).alias("amount")).distinct()


@register("s4_write_json", _q([TXN], "select cast(order_id as varchar) as order_id, amount, merchant_category from txn", ["amount"]))
def _(spark, d):
    at = scratch_path(spark, "json")
    tables.write_json(_txn(spark, d).select(F.col("order_id").cast("string").alias("order_id"), "amount", "merchant_category"), at)
    return spark.read.schema("order_id string, amount double, merchant_category string").json(at)


@register("s8_read_transactions", _q([TXN], "select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, amount, device_id, merchant_category from txn", ["amount"]))
def _(spark, d):
    at = scratch_path(spark, "arriving")
    keep = ["order_id", "customer_id", "amount", "device_id", "merchant_category"]
    _txn(spark, d).select(F.col("order_id").cast("string").alias("order_id"), F.col("customer_id").cast("string").alias("customer_id"), *keep[2:]).write.json(f"{at}/in")
    return _drain(tables.read_transactions(spark, f"{at}/in", per_trigger=3).select(*keep), "transactions")


@register("s3_jsonl_log", _q([TXN], "select cast(order_id as varchar) as order_id, predicted_score as calibrated_score, predicted_score >= 0.5 as alert from txn where order_id % 7 <> 0",
                              ["calibrated_score"]))
def _(spark, d):
    # every seventh line is cut in half; the reader drops those
    line = F.to_json(F.struct(F.col("order_id").cast("string").alias("order_id"), F.col("predicted_score").alias("calibrated_score"),
                              (F.col("predicted_score") >= 0.5).alias("alert")))
    at = scratch_path(spark, "log")
    _txn(spark, d).select(F.when(F.col("order_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(at)
    return tables.read_jsonl_log(spark, at).select("order_id", "calibrated_score", "alert")


@register("s5_audit_sink", _q([TXN], "select cast(order_id as varchar) as order_id, count(*) * 2 as lines from txn group by order_id"))
def _(spark, d):
    rows = _txn(spark, d).select(F.col("order_id").cast("string"), F.col("predicted_score").alias("risk_score"))
    at = scratch_path(spark, "audit")
    tables.audit_sink(rows, at)
    tables.audit_sink(rows, at)
    return tables.read_jsonl_log(spark, at).groupBy("order_id").agg(F.count("*").alias("lines"))


@register("s6_eval_artifacts", _q([TXN, TXN_B, RING, _suffixed(RING, ("ab", "pr", "per_ring"), "b", "txnb")],
    "select 'a' as model, ring_id, coverage, exposure_captured from per_ring union all select 'b', ring_id, coverage, exposure_captured from per_ring_b", ["coverage", "exposure_captured"]))
def _(spark, d):
    a, b = _two_models(_txn(spark, d))
    at = scratch_path(spark, "eval")
    tables.write_eval_artifacts({"a": {"per_ring": rings.per_ring(a)}, "b": {"per_ring": rings.per_ring(b)}}, at)
    return tables.read_parquet(spark, f"{at}/per_ring").select("model", "ring_id", "coverage", "exposure_captured")


@register("s9_quality_artifacts", _q([TXN, SPLIT, "lv as (select distinct split, ring_id from sp where is_abuse = 1 and ring_id is not null)",
    "rg as (select ring_id, count(distinct customer_id) as n from txn where ring_id is not null group by all)"],
    """select 'split_summary' as file, split as name, count(*)::double as value from sp group by split
  union all select 'rings_by_type', s, (select count(distinct ring_id) from lv where split = s) from (select unnest(['train', 'validation', 'test']) as s)
  union all select 'ring_statistics', 'ring_size', avg(n) from rg""", ["value"]))
def _(spark, d):
    """The three reports written to a folder and read back: orders per split, active rings (Total row), mean ring size."""
    t = materialise(events.split_by_time(_txn(spark, d)), "s9")
    ring, at = quality.ring_table(t), scratch_path(spark, "quality")
    tables.quality_artifacts(quality.split_summary(t, _labels(t)), quality.rings_by_type(t, _labels(t), ring), quality.ring_statistics(ring, _labels(t)), at)
    csv = spark.read.option("header", True)
    kinds = csv.csv(f"{at}/rings_by_type").filter("ring_type = 'Total'")
    totals = [kinds.select(F.lit("rings_by_type").alias("file"), F.lit(x).alias("name"), F.col(f"{x}_active").cast("double").alias("value")) for x in ("train", "validation", "test")]
    out = csv.csv(f"{at}/split_summary").select(F.lit("split_summary").alias("file"), F.col("split").alias("name"), F.col("orders").cast("double").alias("value"))
    for one in totals:
        out = out.unionByName(one)
    sizes = spark.read.json(f"{at}/ring_statistics").filter("measure = 'ring_size'")
    return out.unionByName(sizes.select(F.lit("ring_statistics").alias("file"), F.col("measure").alias("name"), F.col("mean").alias("value")))


@register("s5_audit_stream", _q([TXN], "select cast(order_id as varchar) as order_id, predicted_score as risk_score from txn", ["risk_score"]))
def _(spark, d):
    """The sink of a stream: every scored order is one line of the log."""
    at = scratch_path(spark, "audit-stream")
    rows = _stream(spark, d).select(F.col("order_id").cast("string"), F.col("predicted_score").alias("risk_score"))
    tables.audit_sink(rows, at, f"{at}-commits").trigger(availableNow=True).start().awaitTermination()
    return tables.read_jsonl_log(spark, at, "order_id string, risk_score double")


# ---- streams over the same files ----------------------------------------------------------------

def _stream(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, d, "events").schema
    # a file stream takes a pattern, so the one file of the table arrives as one batch
    return as_transactions(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into a table, and read it."""
    spark = df.sparkSession
    at = scratch_path(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@register("st1_stream_dedup", _q([TXN], "select distinct order_id, customer_id, amount from txn", ["amount"]))
def _(spark, d):
    once = _stream(spark, d)
    return _drain(jobs.stream_dedup(once.unionByName(once)).select("order_id", "customer_id", "amount"), "dedup")


def _arrive(spark: SparkSession, d: str, at: str, files: range, at_once: int = 1) -> DataFrame:
    """Orders as files of a stream, four in all. Groups of customers that share nothing are two, the second one file behind
    the first, each in three parts by time: half of a file is late against what came before. Files repeat some orders of the one before."""
    t = _txn(spark, d)
    third = F.least(F.floor((F.dayofmonth("event_time") - 1) / 10), F.lit(2))
    file = F.floor(F.col("customer_id").cast("long") / 120) % 2 + third
    for k in files:
        part = t.where((file == k) | ((file == k - 1) & (F.col("order_id") % 20 == 0)))
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", at_once).parquet(f"{at}/in")


def _streamed_features(spark: SparkSession, d: str, name: str) -> DataFrame:
    """What streams write: one over the first two files, and one with a new checkpoint over all four and the same history."""
    at = scratch_path(spark, "stream-features")
    store = HistoryStore(f"{at}/history", buckets=8, compact_every=2)
    for k in (0, 2):
        jobs.stream_features(_arrive(spark, d, at, range(k, k + 2)), store, f"{at}/out", f"{at}/cp{k}", name).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch_id")


@register("st2_stream_features", o.matrix_sql(FEATURE_SETS["extended"]))
def _(spark, d):
    return _streamed_features(spark, d, "extended")


@register("st3_customer_state", _q([TXN, ENT, o.CUST], """select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, n30 as prior_order_count, spend as prior_spend,
  n1 as customer_order_count_1h, n24 as customer_order_count_24h, n7 as customer_order_count_7d, n30 as customer_order_count_30d, cast(categories as double) as prior_category_count
  from cust join cat using (order_id)""", ["prior_spend"]))
def _(spark, d):
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drain(jobs.stream_customer_state(_stream(spark, d)), "state")
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)


@register("st4_stream_alerts", _q([TXN], "select n as orders, n as equal_scores, true as alerts_equal, n as audit_lines from (select count(*) as n from txn)"))
def _(spark, d):
    """What a stream of two arrivals scores with the stored model, against the batch scores of the same model, row by row."""
    at, path = scratch_path(spark, "stream-alerts"), Future()
    stream = jobs.stream_alerts(_arrive(spark, d, at, range(4), 2), path.result, at, history=HistoryStore(f"{at}/history", buckets=8))
    try:
        model = _model_path(spark, d)  # fitted while the stream makes its first features
        path.set_result(model)
        stream.awaitTermination()
    finally:
        path.cancel()  # a batch that still waits for the model ends
        stream.stop()
    batch = models.StoredModel.load(model).score(_matrix(spark, d)).select("order_id", F.col("calibrated_score").alias("b"), F.col("alert").alias("in_batch"))
    audit = tables.read_jsonl_log(spark, f"{at}/audit").select(F.col("order_id").cast("long").alias("order_id"), F.col("calibrated_score").alias("s"))
    alerts = spark.read.parquet(f"{at}/alerts").select("order_id", F.lit(True).alias("in_stream"))
    both = batch.join(audit, "order_id", "left").join(alerts, "order_id", "left")
    same = F.coalesce(F.col("in_stream"), F.lit(False)) == F.col("in_batch")
    return both.agg(F.count_distinct("order_id").alias("orders"), F.count_if(F.abs(F.col("b") - F.col("s")) < 1e-9).alias("equal_scores"),
                    (F.count_if(~same) == 0).alias("alerts_equal"), F.count("s").alias("audit_lines"))


@register("st5_daily_metrics", _q([TXN, LOG], """select cast(cast(event_time as date) as varchar) as date, count(*) as requests, count_if(fallback_applied) as fallbacks,
  count_if(fallback_applied) / count(*) as fallback_rate, count_if(alert) as alerts, quantile_disc(latency_ms, 0.5) as latency_p50,
  quantile_disc(latency_ms, 0.95) as latency_p95, quantile_disc(latency_ms, 0.99) as latency_p99 from log group by all""", ["fallback_rate", "latency_p50", "latency_p95", "latency_p99"]))
def _(spark, d):
    at = scratch_path(spark, "daily")
    daily = jobs.stream_daily_metrics(_log(_stream(spark, d)))
    # the last day is still open when the input ends, so the running table is written, not only closed days
    (daily.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out"))
     .option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(daily.schema).parquet(f"{at}/out")


@register("st6_label_join", _q([TXN], "select order_id, predicted_score as calibrated_score, is_abuse from txn where order_id % 3 <> 0 and order_id % 40 <= 30", ["calibrated_score"]))
def _(spark, d):
    s = _stream(spark, d)
    pred = s.select("order_id", F.col("event_time").alias("prediction_timestamp"), F.col("predicted_score").alias("calibrated_score"))
    # labels come order_id % 40 days later: those after day 30 no longer count
    lab = s.filter(F.col("order_id") % 3 != 0).select(
        "order_id", (F.col("event_time") + F.make_dt_interval(days=(F.col("order_id") % 40).cast("int"))).alias("ground_truth_label_timestamp"), "is_abuse")
    return _drain(jobs.stream_label_join(pred, lab), "labels").select("order_id", "calibrated_score", "is_abuse")


@register("st7_stream_cases", _rec([TXN, ENT, LOG, ALERTS, *_greedy("order_id % 4, t, order_id")], GREEDY_ROWS))
def _(spark, d):
    # four arrivals, each spread over the whole time, so most alerts of the later ones are late; each repeats some of the first
    at = scratch_path(spark, "stream-cases")
    al = materialise(_alerts(spark, d), "alerts")
    for k in range(4):
        al.filter((F.col("order_id") % 4 == k) | ((F.col("order_id") % 20 == 0) & F.lit(k > 0))).write.mode("append").parquet(f"{at}/alerts")
        jobs.stream_cases(spark.readStream.schema(al.schema).parquet(f"{at}/alerts"), at).awaitTermination()
    return spark.read.parquet(f"{at}/cases").select("order_id", "alert_id", "case_id")


@register("st8_history", _q([TXN, ENT, """firsts as (select min_by(order_id, t) as order_id from txn where t <= epoch_us(timestamp '2024-01-20') group by customer_id, merchant_category
  union select min_by(order_id, t) from ent where t <= epoch_us(timestamp '2024-01-20') group by customer_id, etype, value)"""],
    "select order_id, amount from txn where t > epoch_us(timestamp '2024-01-20') or order_id in (select order_id from firsts)", ["amount"]))
def _(spark, d):
    day = 86_400_000_000
    return needed_history(_txn(spark, d), 1_704_067_200_000_000 + 29 * day, horizon_days=10).select("order_id", "amount")
