"""The registered queries as SQL over the same tables, written from the definitions.

The SQL is deliberately another formulation: RANGE frames and self-joins where the library runs
sweeps and spells.
"""
from __future__ import annotations

from coterie.schema import (
    BASELINE_COLUMNS, CUSTOMER_RELATIVE_COLUMNS, ENTITIES, FEATURE_CONTRACT, GRAPH_COLUMNS, SUBGRAPH_COLUMNS,
    TEMPORAL_COLUMNS, TWO_HOP_COLUMNS,
)

H, D = 3_600_000_000, 86_400_000_000
D7, D30 = 7 * D, 30 * D

TXN = """
txn as (
  select event_id as order_id, user_id as customer_id, ts as event_time, epoch_us(ts) as t, value as amount,
    event_type as merchant_category, cast(k % 4 = 0 as int) as retry_count,
    'D' || (user_id // 2 * 3 + k % 3) as device_id, 'IP' || (user_id // 8 * 4 + k % 4) as ip_id,
    'A' || (user_id // 3 * 2 + k % 2) as address_id,
    case when k % 10 = 0 then 'P' || (user_id // 5) else 'Q' || (user_id * 2 + k % 2) end as payment_id,
    case when user_id // 8 % 5 = 0 and k % 3 <> 0 then 1 else 0 end as is_abuse,
    case when user_id // 8 % 5 = 0 and k % 3 <> 0 then 'R' || (user_id // 8) end as ring_id,
    case user_id // 8 % 4 when 0 then 'shared_device' when 1 then 'shared_address' when 2 then 'behavioral' else 'mixed' end as abuse_type,
    case when user_id // 8 % 5 = 0 and k % 3 <> 0 then value * 0.5::double else 0::double end as loss_amount,
    cast((event_id * 7919) % 1009 as double) / 1009::double * 0.6::double
      + case when user_id // 8 % 5 = 0 and k % 3 <> 0 then 0.35::double else 0::double end as predicted_score
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)
)"""

TIED = """
txn as (
  select o_orderkey as order_id, o_custkey % 200 as customer_id, o_orderdate as event_time, epoch_us(o_orderdate) as t,
    o_totalprice as amount, o_orderpriority as merchant_category, 0 as retry_count,
    'D' || (o_custkey % 97) as device_id, 'IP' || (o_orderkey % 31) as ip_id,
    'A' || (o_custkey % 61) as address_id, 'P' || (o_orderkey % 113) as payment_id
  from orders
)"""

ENT = """
ent as (
  select order_id, customer_id, t, 'device' as etype, device_id as value from txn
  union all select order_id, customer_id, t, 'ip', ip_id from txn
  union all select order_id, customer_id, t, 'address', address_id from txn
  union all select order_id, customer_id, t, 'payment', payment_id from txn
)"""


def rounded(sql: str, doubles: list[str]) -> str:
    """Outermost select with the double columns rounded like the query side."""
    ctes, _, body = sql.rpartition("\n--body\n")
    inner = body if not ctes else body
    head = f"with {ctes.strip()}\n" if ctes else ""
    rep = ", ".join(f"round({c} + 1e-9::double, 6) as {c}" for c in doubles)
    return f"{head}select * replace ({rep}) from ({inner}) q" if doubles else f"{head}{inner}"


def _q(ctes: list[str], body: str, doubles: list[str] | None = None) -> str:
    sql = ",\n".join(c.strip() for c in ctes) + "\n--body\n" + body if ctes else body
    return rounded(sql, doubles or [])


def _piv(cols: list[str], src: str) -> str:
    return "select order_id, " + ", ".join(
        f"coalesce(max(case when etype = '{e}' then {c} end), 0) as {e}__{c}" for e in ENTITIES for c in cols
    ) + f" from {src} group by order_id"


# ---- feature families ---------------------------------------------------------------------------

CUST = f"""
cust as (
  select order_id, customer_id, t, amount, retry_count, merchant_category,
    cast(count(*) over (partition by customer_id order by t range between {H - 1} preceding and 1 preceding) as double) as n1,
    cast(count(*) over (partition by customer_id order by t range between {D - 1} preceding and 1 preceding) as double) as n24,
    cast(count(*) over (partition by customer_id order by t range between {D7 - 1} preceding and 1 preceding) as double) as n7,
    cast(count(*) over w30 as double) as n30, coalesce(sum(amount) over w30, 0) as spend, avg(amount) over w30 as mean,
    coalesce(stddev_pop(amount) over w30, 0) as std, max(t) over w30 as last_t,
    case when row_number() over (partition by customer_id, merchant_category order by t) = 1 then 1 else 0 end as new_cat
  from txn
  window w30 as (partition by customer_id order by t range between {D30 - 1} preceding and 1 preceding)
),
cat as (
  select order_id, coalesce(sum(new_cat) over (partition by customer_id order by t rows between unbounded preceding and 1 preceding), 0)
    as categories from cust
)"""

OWN = f"""
own0 as (
  select *, case when row_number() over (partition by customer_id, etype, value order by t) = 1 then 1.0 else 0.0 end as is_new from ent
),
own1 as (
  select order_id, etype, cast(is_new as double) as is_new,
    cast(coalesce(sum(is_new) over (partition by customer_id, etype order by t rows between unbounded preceding and 1 preceding), 0) as double) as used,
    cast(count(*) over (partition by customer_id, etype, value order by t range between {H - 1} preceding and 1 preceding) as double) as own_1h,
    cast(count(*) over (partition by customer_id, etype, value order by t range between {D - 1} preceding and 1 preceding) as double) as own_24h,
    cast(count(*) over (partition by customer_id, etype, value order by t range between {D7 - 1} preceding and 1 preceding) as double) as own_7d
  from own0
),
own as ({_piv(['used', 'is_new', 'own_1h', 'own_24h', 'own_7d'], 'own1')})"""


def _baseline_body() -> str:
    cols = {
        "prior_order_count": "n30", "prior_spend": "cast(spend as double)", "prior_avg_amount": "coalesce(mean, 0)",
        "prior_amount_std": "case when n30 > 1 then std else 0 end", "velocity_per_day": "n30 / 30.0::double",
        "hours_since_prior": "case when last_t is null then 9999.0::double else (t - last_t) / 3.6e9::double end",
        "amount": "amount", "amount_vs_prior_avg": "amount / greatest(coalesce(mean, amount), 1.0::double)",
        "account_age_days": f"greatest(0.0::double, (t - epoch_us(timestamp '2025-01-01')) / {float(D)}::double)",
        "prior_category_count": "cast(categories as double)", "retry_count": "cast(retry_count as double)",
    }
    for e in ENTITIES:
        cols[f"prior_{e}count"] = f"{e}__used"
        cols[f"{e}_is_new"] = f"{e}__is_new"
    return ("select order_id, " + ", ".join(f"{cols[c]} as {c}" for c in BASELINE_COLUMNS)
            + " from cust join cat using (order_id) join own using (order_id)")


def _custrel_body() -> str:
    cols = {
        "customer_order_count_1h": "n1", "customer_order_count_24h": "n24", "customer_order_count_7d": "n7",
        "customer_order_count_30d": "n30", "customer_orders_1h_vs_24h_rate": "n1 / greatest(1.0::double, n24 / 24.0::double)",
        "customer_orders_24h_vs_7d_rate": "n24 / greatest(1.0::double, n7 / 7.0::double)",
        "customer_activity_burst_score": "n24 / greatest(0.1::double, n30 / 30.0::double)",
    }
    vel = {}
    for e in ENTITIES:
        for w in ("1h", "24h", "7d"):
            cols[f"customer_{e}_orders_{w}"] = f"{e}__own_{w}"
        vel[e] = f"{e}__own_24h / greatest(1.0::double, {e}__own_7d / 7.0::double)"
        cols[f"customer_{e}_velocity_ratio"] = vel[e]
        cols[f"customer_{e}_share_of_activity_24h"] = f"{e}__own_24h / greatest(1.0::double, n24)"
    cols["max_customer_entity_orders_1h"] = "greatest(" + ", ".join(f"{e}__own_1h" for e in ENTITIES) + ")"
    cols["max_customer_entity_orders_24h"] = "greatest(" + ", ".join(f"{e}__own_24h" for e in ENTITIES) + ")"
    cols["max_customer_entity_velocity_ratio"] = "greatest(" + ", ".join(vel.values()) + ")"
    return ("select order_id, " + ", ".join(f"{cols[c]} as {c}" for c in CUSTOMER_RELATIVE_COLUMNS)
            + " from cust join own using (order_id)")


SEEN = f"""
seen1 as (
  select order_id, etype,
    cast(count(*) over h as double) as n1, cast(count(*) over d as double) as n24,
    cast(count(distinct customer_id) over h as double) as d1, cast(count(distinct customer_id) over d as double) as d24
  from ent
  window h as (partition by etype, value order by t range between {H - 1} preceding and 1 preceding),
         d as (partition by etype, value order by t range between {D - 1} preceding and 1 preceding)
),
seen as ({_piv(['n1', 'n24', 'd1', 'd24'], 'seen1')})"""


def _temporal_body() -> str:
    cols, burst = {}, {}
    for e in ENTITIES:
        burst[e] = f"{e}__n1 / greatest(1.0::double, {e}__n24 / 24.0::double)"
        cols |= {f"{e}_distinct_customers_1h": f"{e}__d1", f"{e}_distinct_customers_24h": f"{e}__d24",
                 f"{e}_order_count_1h": f"{e}__n1", f"{e}_order_count_24h": f"{e}__n24",
                 f"{e}_new_customers_1h": f"{e}__d1", f"{e}_burst_ratio_1h_24h": burst[e]}

    def g(c: str) -> str:
        return "greatest(" + ", ".join(f"{e}__{c}" for e in ENTITIES) + ")"

    cols |= {"max_entity_distinct_customers_1h": g("d1"), "max_entity_distinct_customers_24h": g("d24"),
             "max_entity_order_count_1h": g("n1"), "max_entity_order_count_24h": g("n24"),
             "max_entity_burst_ratio": "greatest(" + ", ".join(burst.values()) + ")",
             "total_entity_burst_events_1h": "cast(" + " + ".join(f"cast({e}__d1 >= 2 as int)" for e in ENTITIES) + " as double)"}
    return "select order_id, " + ", ".join(f"{cols[c]} as {c}" for c in TEMPORAL_COLUMNS) + " from seen"


EVER = f"""
edge as (select etype, value, customer_id as c, min(t) as t0 from ent group by all),
ever1 as (select o.order_id, o.etype, cast(count(*) as double) as people from ent o join edge p on p.etype = o.etype and p.value = o.value
  and p.t0 < o.t group by all),
ever as ({_piv(['people'], 'ever1')}),
near as (select distinct o.order_id, o.t, o.etype, p.c from ent o join edge p on p.etype = o.etype and p.value = o.value and p.t0 < o.t),
near_n as (select order_id, count(distinct c) as n from near group by all),
comp as (select n.order_id, count(distinct p.value) as n from near n join edge p on p.c = n.c and p.etype = n.etype and p.t0 < n.t group by all),
g30 as (select order_id, cast(count(*) over (partition by customer_id order by t range between {D30 - 1} preceding and 1 preceding) as double) as n30
  from txn)"""


def _graph_body() -> str:
    cols = {"graph_prior_orders": "n30", "graph_velocity": "n30 / 30.0::double",
            "graph_neighbor_count": "cast(coalesce(near_n.n, 0) as double)",
            "graph_component_size_approx": "cast(coalesce(comp.n, 0) + 1 as double)"}
    reused = {e: f"cast(coalesce({e}__people, 0) > 0 as double)" for e in ENTITIES}
    for e in ENTITIES:
        cols |= {f"{e}_shared_accounts": f"coalesce({e}__people, 0)", f"{e}_is_reused": reused[e],
                 f"{e}_customer_degree": f"coalesce({e}__people, 0)"}
    total = "(" + " + ".join(reused.values()) + ")"
    cols |= {"graph_shared_entity_count": total, "graph_shared_ratio": f"{total} / 4.0::double"}
    return ("select order_id, " + ", ".join(f"{cols[c]} as {c}" for c in GRAPH_COLUMNS)
            + " from g30 left join ever using (order_id) left join near_n using (order_id) left join comp using (order_id)")


PEER = f"""
link as (select distinct o.order_id, o.t, o.customer_id as me, o.etype, p.customer_id as peer from ent o join ent p
  on p.etype = o.etype and p.value = o.value and p.t < o.t and p.t > o.t - {D7} and p.customer_id <> o.customer_id),
link30 as (select o.order_id, count(distinct p.customer_id) as n from ent o join ent p
  on p.etype = o.etype and p.value = o.value and p.t < o.t and p.t > o.t - {D30} and p.customer_id <> o.customer_id group by all),
peer as (select order_id, t, me, peer, bit_or(case etype when 'device' then 1 when 'ip' then 2 when 'address' then 4 else 8 end) as mask
  from link group by all),
peer_n as (
  select order_id, count(*) as n, count_if(bit_count(mask) >= 2) as multi, max(bit_count(mask)) as deg,
    bit_or(mask) as types, count_if(mask & 1 > 0) as n_device, count_if(mask & 2 > 0) as n_ip, count_if(mask & 4 > 0) as n_address,
    count_if(mask & 8 > 0) as n_payment,
    max(cast(mask & 3 = 3 as int)) as p3, max(cast(mask & 5 = 5 as int)) as p5, max(cast(mask & 9 = 9 as int)) as p9,
    max(cast(mask & 6 = 6 as int)) as p6, max(cast(mask & 10 = 10 as int)) as p10, max(cast(mask & 12 = 12 as int)) as p12
  from peer group by order_id)"""

REACH = f"""
reach as (select p.order_id, p.t, p.me, p.mask, e.etype, e.value, max(cast(e.t > p.t - {D} as int)) as day
  from peer p join ent e on e.customer_id = p.peer and e.t < p.t and e.t > p.t - {D7} group by all),
touch as (select r.order_id, r.t, r.me, r.etype, r.value, bit_or(mask) as via, max(day) as day, max(cast(o.value = r.value as int)) as is_own
  from reach r left join ent o on o.order_id = r.order_id and o.etype = r.etype group by all)"""

VOL = f"""
vol1 as (select p.order_id, p.peer, count(*) as n7, count_if(x.t > p.t - {D}) as n24 from peer p join txn x
  on x.customer_id = p.peer and x.t < p.t and x.t > p.t - {D7} group by all),
vol as (select order_id, sum(n7) as s7, sum(n24) as s24, max(n7) as m7 from vol1 group by all),
reach_n as (select order_id,
    count(distinct case when etype = 'address' and via & 1 > 0 and is_own = 0 then value end) as a_d,
    count(distinct case when etype = 'device' and via & 4 > 0 and is_own = 0 then value end) as d_a,
    count(distinct case when etype = 'payment' and via & 1 > 0 and is_own = 0 then value end) as p_d,
    count(distinct case when etype = 'payment' and via & 4 > 0 and is_own = 0 then value end) as p_a,
    count(distinct case when etype = 'device' and via & 2 > 0 and is_own = 0 then value end) as d_i,
    count(distinct case when etype = 'address' and via & 2 > 0 and is_own = 0 then value end) as a_i,
    count(distinct case when etype = 'device' and is_own = 0 then value end) as td,
    count(distinct case when etype = 'address' and is_own = 0 then value end) as ta,
    count(distinct case when etype = 'payment' and is_own = 0 then value end) as tp
  from touch group by order_id)"""


def _two_hop_body() -> str:
    def z(c: str) -> str:
        return f"cast(coalesce({c}, 0) as double)"

    cols = {f"two_hop_shared_{e}_customers_7d": z(f"n_{e}") for e in ENTITIES}
    cols |= {
        "two_hop_distinct_connected_customers_7d": z("peer_n.n"), "two_hop_distinct_connected_customers_30d": z("link30.n"),
        "two_hop_connected_addresses_via_device_7d": z("a_d"), "two_hop_connected_devices_via_address_7d": z("d_a"),
        "two_hop_connected_payments_via_device_7d": z("p_d"), "two_hop_connected_payments_via_address_7d": z("p_a"),
        "two_hop_connected_devices_via_ip_7d": z("d_i"), "two_hop_connected_addresses_via_ip_7d": z("a_i"),
        "two_hop_total_peer_devices_7d": z("td"), "two_hop_total_peer_addresses_7d": z("ta"), "two_hop_total_peer_payments_7d": z("tp"),
        "two_hop_peer_cluster_size_7d": f"{z('peer_n.n')} + {z('td')} + {z('ta')} + {z('tp')}",
        "two_hop_total_peer_orders_7d": z("s7"), "two_hop_max_peer_orders_7d": z("m7"),
        "two_hop_peer_velocity_ratio_24h_vs_7d": f"{z('s24')} / greatest(1.0::double, {z('s7')} / 7.0::double)",
        "two_hop_cross_entity_shared_cust_count_7d": z("p3 + p5 + p9 + p6 + p10 + p12"),
    }
    return ("select txn.order_id, " + ", ".join(f"{cols[c]} as {c}" for c in TWO_HOP_COLUMNS)
            + " from txn left join peer_n using (order_id) left join link30 using (order_id)"
              " left join reach_n using (order_id) left join vol using (order_id)")


SUB = f"""
e7 as (
  select distinct h.order_id, h.t, e.customer_id as c, h.value from touch h join ent e
    on e.etype = h.etype and e.value = h.value and e.t < h.t and e.t > h.t - {D7}
  union select o.order_id, o.t, o.customer_id, e.value from txn o join ent e
    on e.customer_id = o.customer_id and e.t < o.t and e.t > o.t - {D7}
),
e24 as (
  select distinct h.order_id, h.t, e.customer_id as c, h.value from touch h join ent e
    on e.etype = h.etype and e.value = h.value and e.t < h.t and e.t > h.t - {D} where h.day = 1
  union select o.order_id, o.t, o.customer_id, e.value from txn o join ent e
    on e.customer_id = o.customer_id and e.t < o.t and e.t > o.t - {D}
),
c7 as (select order_id, t, c from e7 union select order_id, t, customer_id from txn),
c24 as (select order_id, t, c from e24 union select order_id, t, customer_id from txn),
v7 as (select order_id, t, value from e7 union select order_id, t, value from ent),
v24 as (select order_id, t, value from e24 union select order_id, t, value from ent),
born_c as (select customer_id as c, min(t) as t0 from txn group by all),
born_v as (select value, min(t) as t0 from ent group by all),
born_e as (select customer_id as c, value, min(t) as t0 from ent group by all),
sz as (
  select order_id, sum(e24) as e24, sum(e7) as e7, sum(c24) as c24, sum(c7) as c7, sum(v24) as v24, sum(v7) as v7, sum(nn) as nn, sum(ne) as ne, sum(ob) as ob
  from (
    select order_id, 0 as e24, count(*) as e7, 0 as c24, 0 as c7, 0 as v24, 0 as v7, 0 as nn, 0 as ne, 0 as ob from e7 group by all
    union all select order_id, count(*), 0, 0, 0, 0, 0, 0, 0, 0 from e24 group by all
    union all select order_id, 0, 0, count(*), 0, 0, 0, 0, 0, 0 from c24 group by all
    union all select order_id, 0, 0, 0, count(*), 0, 0, 0, 0, 0 from c7 group by all
    union all select order_id, 0, 0, 0, 0, count(*), 0, 0, 0, 0 from v24 group by all
    union all select order_id, 0, 0, 0, 0, 0, count(*), 0, 0, 0 from v7 group by all
    union all select order_id, 0, 0, 0, 0, 0, 0, count(*), 0, 0 from c7 join born_c using (c) where t0 < t and t0 > t - {H} group by all
    union all select order_id, 0, 0, 0, 0, 0, 0, count(*), 0, 0 from v7 join born_v using (value) where t0 < t and t0 > t - {H} group by all
    union all select order_id, 0, 0, 0, 0, 0, 0, 0, count(*), 0 from e7 join born_e using (c, value) where t0 < t and t0 > t - {H} group by all
    union all select c7.order_id, 0, 0, 0, 0, 0, 0, 0, 0, count(*) from c7 join txn x on x.customer_id = c7.c and x.t < c7.t and x.t > c7.t - {H} group by all
  ) group by order_id
)"""


def _subgraph_body() -> str:
    def z(c: str) -> str:
        return f"cast(coalesce({c}, 0) as double)"

    # components among the non-empty sets: sets minus links of a spanning forest, counted case by case
    sets = [("1", "device"), ("2", "ip"), ("4", "address"), ("8", "payment")]
    pairs = {("1", "2"): "p3", ("1", "4"): "p5", ("1", "8"): "p9", ("2", "4"): "p6", ("2", "8"): "p10", ("4", "8"): "p12"}

    def joined(a: str, b: str) -> str:
        direct = pairs[tuple(sorted((a, b), key=int))]
        rest = [s for s, _ in sets if s not in (a, b)]
        key = lambda x, y: pairs[tuple(sorted((x, y), key=int))]
        x, y = rest
        routes = [f"{direct} = 1", f"({key(a, x)} = 1 and {key(x, b)} = 1)", f"({key(a, y)} = 1 and {key(y, b)} = 1)",
                  f"({key(a, x)} = 1 and {key(x, y)} = 1 and {key(y, b)} = 1)", f"({key(a, y)} = 1 and {key(y, x)} = 1 and {key(x, b)} = 1)"]
        return "(" + " or ".join(routes) + ")"

    firsts = []
    for k, (a, _) in enumerate(sets):
        earlier = [joined(b, a) for b, _ in sets[:k]]
        firsts.append(f"cast(types & {a} > 0" + "".join(f" and not {j}" for j in earlier) + " as int)")
    bridge = f"case when coalesce(bit_count(types), 0) <= 1 then 0 else {' + '.join(firsts)} end"
    nodes24, nodes7 = f"({z('c24')} + {z('v24')})", f"({z('c7')} + {z('v7')})"
    cols = {
        "subgraph_node_count_24h": nodes24, "subgraph_customer_count_24h": z("c24"), "subgraph_entity_count_24h": z("v24"),
        "subgraph_edge_count_24h": z("e24"), "subgraph_node_count_7d": nodes7, "subgraph_customer_count_7d": z("c7"),
        "subgraph_entity_count_7d": z("v7"), "subgraph_edge_count_7d": z("e7"),
        "subgraph_edge_density_24h": f"{z('e24')} / (greatest({z('c24')}, 1) * greatest({z('v24')}, 1) + 1e-5::double)",
        "subgraph_edge_density_7d": f"{z('e7')} / (greatest({z('c7')}, 1) * greatest({z('v7')}, 1) + 1e-5::double)",
        "subgraph_avg_entities_per_cust_7d": f"{z('e7')} / greatest({z('c7')}, 1)",
        "subgraph_avg_custs_per_entity_7d": f"{z('e7')} / greatest({z('v7')}, 1)",
        "subgraph_shared_modality_count_7d": z("bit_count(types)"), "subgraph_multi_entity_conspirator_count_7d": z("multi"),
        "subgraph_max_entity_overlap_degree_7d": z("deg"), "subgraph_new_nodes_1h": z("nn"), "subgraph_new_edges_1h": z("ne"),
        "subgraph_growth_ratio_1h_vs_24h": f"{z('nn')} / ({nodes24} / 24.0::double + 1e-5::double)",
        "subgraph_bridge_disjoint_components_7d": f"cast({bridge} as double)", "subgraph_order_burst_velocity_1h": z("ob"),
    }
    return ("select txn.order_id, " + ", ".join(f"{cols[c]} as {c}" for c in SUBGRAPH_COLUMNS)
            + " from txn left join peer_n using (order_id) left join sz using (order_id)")


FAMILY_CTES = {
    "baseline": [CUST, OWN], "graph": [EVER], "temporal": [SEEN], "customer_relative": [CUST, OWN],
    "two_hop": [PEER, REACH, VOL], "subgraph": [PEER, REACH, SUB],
}
FAMILY_BODY = {
    "baseline": (_baseline_body, BASELINE_COLUMNS), "graph": (_graph_body, GRAPH_COLUMNS), "temporal": (_temporal_body, TEMPORAL_COLUMNS),
    "customer_relative": (_custrel_body, CUSTOMER_RELATIVE_COLUMNS), "two_hop": (_two_hop_body, TWO_HOP_COLUMNS),
    "subgraph": (_subgraph_body, SUBGRAPH_COLUMNS),
}


def family_sql(name: str) -> str:
    body, cols = FAMILY_BODY[name]
    return _q([TXN, ENT, *FAMILY_CTES[name]], body(), cols)


def matrix_sql(families: tuple[str, ...]) -> str:
    ctes: list[str] = [TXN, ENT]
    for f in families:
        ctes += [c for c in FAMILY_CTES[f] if c not in ctes]
    ctes += [f"f_{f} as ({FAMILY_BODY[f][0]()})" for f in families]
    cols = [c for c in FEATURE_CONTRACT if any(c in FAMILY_BODY[f][1] for f in families)]
    body = f"select order_id, {', '.join(cols)} from f_{families[0]}" + "".join(f" join f_{f} using (order_id)" for f in families[1:])
    return _q(ctes, body, cols)
