"""Slow reference for the feature families: set definitions evaluated order by order."""
from __future__ import annotations

import math
from itertools import combinations

HOUR, DAY = 3600, 86400
TYPES = ("device", "ip", "address", "payment")
MISSING = {"", "nan", "none", "null", "<na>", "0", "0.0"}


def clean(v):
    s = "" if v is None else str(v).strip()
    return "" if s.lower() in MISSING else s


def raw(v):
    s = "" if v is None else str(v)
    return "" if s in ("", "nan", "None") else s


def model(rows, ties="sequence", history_days=30, epoch=0.0):
    """rows: dicts with order_id, customer_id, t (seconds), amount, category, retry and the four types."""
    rows = sorted(rows, key=lambda r: (r["t"], r["order_id"]))
    for r in rows:
        r["c"] = {e: clean(r[e]) for e in TYPES}
        r["r"] = {e: raw(r[e]) for e in TYPES}
    return {r["order_id"]: one(rows[:k] if ties == "sequence" else [q for q in rows if q["t"] < r["t"]],
                               r, history_days, epoch) for k, r in enumerate(rows)}


def one(prec, i, history_days, epoch):
    out, me, t = {}, i["customer_id"], i["t"]

    def within(w, rs=None):
        return [q for q in (prec if rs is None else rs) if q["t"] > t - w]

    mine = [q for q in prec if q["customer_id"] == me]
    hist = within(history_days * DAY, mine)
    amounts = [q["amount"] for q in hist]
    n = len(amounts)
    mean = sum(amounts) / n if n else 0.0
    out.update(
        prior_order_count=n, prior_spend=sum(amounts), prior_avg_amount=mean,
        prior_amount_std=math.sqrt(sum((a - mean) ** 2 for a in amounts) / n) if n > 1 else 0.0,
        velocity_per_day=n / max(history_days, 1),
        hours_since_prior=(t - max(q["t"] for q in hist)) / 3600 if n else 9999.0, amount=i["amount"],
        amount_vs_prior_avg=i["amount"] / max(mean if n else i["amount"], 1.0),
        account_age_days=max(0.0, (t - epoch) / DAY),
        prior_category_count=len({q["category"] for q in mine}), retry_count=i["retry"])
    for e in TYPES:
        seen = {q["c"][e] for q in mine} - {""}
        out[f"prior_{e}count"] = len(seen)
        out[f"{e}_is_new"] = int(bool(i["c"][e]) and i["c"][e] not in seen)

    ever = {e: {q["customer_id"] for q in prec if i["c"][e] and q["c"][e] == i["c"][e]} for e in TYPES}
    comp = {str(me)}
    for e in TYPES:
        out[f"{e}_shared_accounts"] = out[f"{e}_customer_degree"] = len(ever[e])
        out[f"{e}_is_reused"] = int(bool(ever[e]))
        comp |= {q["c"][e] for q in prec if q["customer_id"] in ever[e]} - {""}
    reused = sum(bool(ever[e]) for e in TYPES)
    out.update(graph_prior_orders=n, graph_velocity=n / max(history_days, 1),
               graph_neighbor_count=len(set().union(*ever.values())), graph_component_size_approx=max(1, len(comp)),
               graph_shared_entity_count=reused, graph_shared_ratio=reused / 4)

    tops = {k: [] for k in ("d1", "d24", "n1", "n24", "b")}
    for e in TYPES:
        day = [q for q in within(DAY) if i["r"][e] and q["r"][e] == i["r"][e]]
        hour = within(HOUR, day)
        d1, d24 = len({q["customer_id"] for q in hour}), len({q["customer_id"] for q in day})
        b = len(hour) / max(1.0, len(day) / 24)
        out.update({f"{e}_distinct_customers_1h": d1, f"{e}_distinct_customers_24h": d24,
                    f"{e}_order_count_1h": len(hour), f"{e}_order_count_24h": len(day),
                    f"{e}_new_customers_1h": d1, f"{e}_burst_ratio_1h_24h": b})
        for k, v in zip(tops, (d1, d24, len(hour), len(day), b)):
            tops[k].append(v)
    out.update(max_entity_distinct_customers_1h=max(tops["d1"]), max_entity_distinct_customers_24h=max(tops["d24"]),
               max_entity_order_count_1h=max(tops["n1"]), max_entity_order_count_24h=max(tops["n24"]),
               max_entity_burst_ratio=max(tops["b"]), total_entity_burst_events_1h=sum(v >= 2 for v in tops["d1"]))

    c = {k: len(within(w, mine)) for k, w in (("1h", HOUR), ("24h", DAY), ("7d", 7 * DAY), ("30d", 30 * DAY))}
    out.update({f"customer_order_count_{k}": v for k, v in c.items()})
    out.update(customer_orders_1h_vs_24h_rate=c["1h"] / max(1.0, c["24h"] / 24),
               customer_orders_24h_vs_7d_rate=c["24h"] / max(1.0, c["7d"] / 7),
               customer_activity_burst_score=c["24h"] / max(0.1, c["30d"] / 30))
    top = {"1h": [], "24h": [], "v": []}
    for e in TYPES:
        same = [q for q in mine if i["r"][e] and q["r"][e] == i["r"][e]]
        k = {w: len(within(s, same)) for w, s in (("1h", HOUR), ("24h", DAY), ("7d", 7 * DAY))}
        v = k["24h"] / max(1.0, k["7d"] / 7)
        out.update({f"customer_{e}_orders_{w}": x for w, x in k.items()})
        out[f"customer_{e}_velocity_ratio"] = v
        out[f"customer_{e}_share_of_activity_24h"] = k["24h"] / max(1.0, c["24h"])
        top["1h"].append(k["1h"]), top["24h"].append(k["24h"]), top["v"].append(v)
    out.update(max_customer_entity_orders_1h=max(top["1h"]), max_customer_entity_orders_24h=max(top["24h"]),
               max_customer_entity_velocity_ratio=max(top["v"]))

    def linked(w):
        return {e: {q["customer_id"] for q in within(w) if i["c"][e] and q["c"][e] == i["c"][e]} - {me} for e in TYPES}

    P = linked(7 * DAY)
    everyone = set().union(*P.values())
    peer_rows = [q for q in within(7 * DAY) if q["customer_id"] in everyone]

    def used(target, people):
        return {q["c"][target] for q in peer_rows if q["customer_id"] in people} - {"", i["c"][target]}

    tot = {e: len(used(e, everyone)) for e in ("device", "address", "payment")}
    per = [sum(q["customer_id"] == p for q in peer_rows) for p in everyone]
    out.update({f"two_hop_shared_{e}_customers_7d": len(P[e]) for e in TYPES})
    out.update(
        two_hop_distinct_connected_customers_7d=len(everyone),
        two_hop_distinct_connected_customers_30d=len(set().union(*linked(30 * DAY).values())),
        two_hop_connected_addresses_via_device_7d=len(used("address", P["device"])),
        two_hop_connected_devices_via_address_7d=len(used("device", P["address"])),
        two_hop_connected_payments_via_device_7d=len(used("payment", P["device"])),
        two_hop_connected_payments_via_address_7d=len(used("payment", P["address"])),
        two_hop_connected_devices_via_ip_7d=len(used("device", P["ip"])),
        two_hop_connected_addresses_via_ip_7d=len(used("address", P["ip"])),
        two_hop_total_peer_devices_7d=tot["device"], two_hop_total_peer_addresses_7d=tot["address"],
        two_hop_total_peer_payments_7d=tot["payment"],
        two_hop_peer_cluster_size_7d=len(everyone) + sum(tot.values()),
        two_hop_total_peer_orders_7d=sum(per), two_hop_max_peer_orders_7d=max(per, default=0),
        two_hop_peer_velocity_ratio_24h_vs_7d=len(within(DAY, peer_rows)) / max(1.0, sum(per) / 7),
        two_hop_cross_entity_shared_cust_count_7d=sum(bool(P[a] & P[b]) for a, b in combinations(TYPES, 2)))

    own_now = {i["c"][e] for e in TYPES} - {""}
    size = {}
    for tag, w in (("24h", DAY), ("7d", 7 * DAY)):
        win = within(w)
        tv = {(e, q["c"][e]) for q in win if q["customer_id"] in everyone for e in TYPES if q["c"][e]}
        E = {(str(q["customer_id"]), q["c"][e]) for q in win for e in TYPES
             if (e, q["c"][e]) in tv and q["customer_id"] != me}
        E |= {(str(me), q["c"][e]) for q in win if q["customer_id"] == me for e in TYPES if q["c"][e]}
        V = {str(me)} | {a for a, _ in E}
        X = own_now | {b for _, b in E}
        size[tag] = (V, X, E)
        out.update({f"subgraph_node_count_{tag}": len(V) + len(X), f"subgraph_customer_count_{tag}": len(V),
                    f"subgraph_entity_count_{tag}": len(X), f"subgraph_edge_count_{tag}": len(E),
                    f"subgraph_edge_density_{tag}": len(E) / (max(1, len(V)) * max(1, len(X)) + 1e-5)})
    V, X, E = size["7d"]
    born_n, born_e = {}, {}
    for q in prec:
        born_n.setdefault(str(q["customer_id"]), q["t"])
        for e in TYPES:
            if q["c"][e]:
                born_n.setdefault(q["c"][e], q["t"])
                born_e.setdefault((str(q["customer_id"]), q["c"][e]), q["t"])
    new_n = sum(born_n.get(x, -1e18) > t - HOUR for x in V | X)
    shared = [sum(p in P[e] for e in TYPES) for p in everyone]
    groups = [set(P[e]) for e in TYPES if P[e]]
    merged = True
    while merged:
        merged = False
        for a, b in combinations(range(len(groups)), 2):
            if groups[a] & groups[b]:
                groups[a] |= groups.pop(b)
                merged = True
                break
    kinds = sum(bool(P[e]) for e in TYPES)
    out.update(
        subgraph_avg_entities_per_cust_7d=len(E) / max(1, len(V)), subgraph_avg_custs_per_entity_7d=len(E) / max(1, len(X)),
        subgraph_shared_modality_count_7d=kinds, subgraph_multi_entity_conspirator_count_7d=sum(s >= 2 for s in shared),
        subgraph_max_entity_overlap_degree_7d=max(shared, default=0), subgraph_new_nodes_1h=new_n,
        subgraph_new_edges_1h=sum(born_e.get(x, -1e18) > t - HOUR for x in E),
        subgraph_growth_ratio_1h_vs_24h=new_n / (out["subgraph_node_count_24h"] / 24 + 1e-5),
        subgraph_bridge_disjoint_components_7d=len(groups) if kinds > 1 else 0,
        subgraph_order_burst_velocity_1h=sum(str(q["customer_id"]) in V for q in within(HOUR)))
    return out
