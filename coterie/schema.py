"""Table schemas, entity types and the ordered feature contract."""
from __future__ import annotations

# The four shared entities, in contract order, with their columns.
ENTITIES = ("device", "ip", "address", "payment")
ENTITY_COLUMNS = {e: f"{e}_id" for e in ENTITIES}
ENTITY_BIT = {e: 1 << i for i, e in enumerate(ENTITIES)}

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


# Table schemas as DDL strings, which readers take as they are.
TABLE_SCHEMAS: dict[str, str] = {
    "customers": (
        "customer_id string, signup_time timestamp, country string, segment string, "
        "baseline_risk double, household_id long, workgroup_id long"
    ),
    "orders": (
        "order_id string, customer_id string, event_time timestamp, amount double, currency string, "
        "device_id string, ip_id string, address_id string, payment_id string, "
        "merchant_category string, status string, retry_count int"
    ),
    "labels": (
        "order_id string, is_abuse boolean, ring_id string, abuse_type string, "
        "loss_amount double, reason_codes string"
    ),
    "rings": (
        "ring_id string, ring_type string, start_time timestamp, end_time timestamp, "
        "customer_count long, intensity double"
    ),
    "ring_memberships": (
        "ring_id string, customer_id string, joined_at timestamp, left_at timestamp, ring_type string"
    ),
    "ground_truth": ("customer_id string, ring_id string, ring_type string, is_abusive boolean"),
    "returns": (
        "return_id string, order_id string, customer_id string, event_time timestamp, "
        "reason string, refund_amount double"
    ),
}

SCORING_LOG = (
    "order_id string, risk_score double, calibrated_score double, alert boolean, threshold double, "
    "model_version string, schema_version string, latency_ms double, fallback_applied boolean, "
    "reason_codes array<string>, timestamp string, correlation_id string, shadow_mode boolean, "
    "enforcement_applied boolean"
)

DELAYED_LABELS = (
    "order_id string, customer_id string, prediction_timestamp timestamp, "
    "ground_truth_label_timestamp timestamp, risk_score double, shadow_decision string, "
    "actual_is_abuse boolean, actual_ring_id string, dispute_reason_code string, financial_loss_amount double"
)

DAILY_OBSERVATION = (
    "date_str string, data_source string, total_transactions long, error_count long, fallback_count long, "
    "blocked_transactions long, p95_latency_ms double, model_checksum string, feature_count int, "
    "incidents_count long, pii_violations long, target_checksum string"
)

TRANSACTION = (
    "order_id string, customer_id string, event_time string, amount double, currency string, "
    "device_id string, ip_id string, address_id string, payment_id string, "
    "merchant_category string, retry_count double"
)


def _per_entity(*patterns: str) -> list[str]:
    return [p.format(e=e) for e in ENTITIES for p in patterns]


BASELINE_COLUMNS = [
    "prior_order_count", "prior_spend", "prior_avg_amount", "prior_amount_std", "velocity_per_day",
    "hours_since_prior", "amount", "amount_vs_prior_avg", "account_age_days", "prior_category_count",
    "retry_count", *_per_entity("prior_{e}count", "{e}_is_new"),
]
GRAPH_COLUMNS = [
    "graph_prior_orders", "graph_velocity",
    *_per_entity("{e}_shared_accounts", "{e}_is_reused", "{e}_customer_degree"),
    "graph_neighbor_count", "graph_component_size_approx", "graph_shared_entity_count", "graph_shared_ratio",
]
TEMPORAL_COLUMNS = [
    *_per_entity(
        "{e}_distinct_customers_1h", "{e}_distinct_customers_24h", "{e}_order_count_1h",
        "{e}_order_count_24h", "{e}_new_customers_1h", "{e}_burst_ratio_1h_24h",
    ),
    "max_entity_distinct_customers_1h", "max_entity_distinct_customers_24h", "max_entity_order_count_1h",
    "max_entity_order_count_24h", "max_entity_burst_ratio", "total_entity_burst_events_1h",
]
CUSTOMER_RELATIVE_COLUMNS = [
    "customer_order_count_1h", "customer_order_count_24h", "customer_order_count_7d",
    "customer_order_count_30d", "customer_orders_1h_vs_24h_rate", "customer_orders_24h_vs_7d_rate",
    "customer_activity_burst_score",
    *_per_entity(
        "customer_{e}_orders_1h", "customer_{e}_orders_24h", "customer_{e}_orders_7d",
        "customer_{e}_velocity_ratio", "customer_{e}_share_of_activity_24h",
    ),
    "max_customer_entity_orders_1h", "max_customer_entity_orders_24h", "max_customer_entity_velocity_ratio",
]
TWO_HOP_COLUMNS = [
    "two_hop_shared_device_customers_7d", "two_hop_shared_address_customers_7d",
    "two_hop_shared_ip_customers_7d", "two_hop_shared_payment_customers_7d",
    "two_hop_distinct_connected_customers_7d", "two_hop_distinct_connected_customers_30d",
    "two_hop_connected_addresses_via_device_7d", "two_hop_connected_devices_via_address_7d",
    "two_hop_connected_payments_via_device_7d", "two_hop_connected_payments_via_address_7d",
    "two_hop_connected_devices_via_ip_7d", "two_hop_connected_addresses_via_ip_7d",
    "two_hop_total_peer_devices_7d", "two_hop_total_peer_addresses_7d", "two_hop_total_peer_payments_7d",
    "two_hop_peer_cluster_size_7d", "two_hop_total_peer_orders_7d", "two_hop_max_peer_orders_7d",
    "two_hop_peer_velocity_ratio_24h_vs_7d", "two_hop_cross_entity_shared_cust_count_7d",
]
SUBGRAPH_COLUMNS = [
    "subgraph_node_count_24h", "subgraph_customer_count_24h", "subgraph_entity_count_24h",
    "subgraph_edge_count_24h", "subgraph_node_count_7d", "subgraph_customer_count_7d",
    "subgraph_entity_count_7d", "subgraph_edge_count_7d", "subgraph_edge_density_24h",
    "subgraph_edge_density_7d", "subgraph_avg_entities_per_cust_7d", "subgraph_avg_custs_per_entity_7d",
    "subgraph_shared_modality_count_7d", "subgraph_multi_entity_conspirator_count_7d",
    "subgraph_max_entity_overlap_degree_7d", "subgraph_new_nodes_1h", "subgraph_new_edges_1h",
    "subgraph_growth_ratio_1h_vs_24h", "subgraph_bridge_disjoint_components_7d",
    "subgraph_order_burst_velocity_1h",
]

# The ablation ladder: each step adds one family to the one before it.
FEATURE_FAMILIES = {
    "baseline": BASELINE_COLUMNS,
    "graph": GRAPH_COLUMNS,
    "temporal": TEMPORAL_COLUMNS,
    "customer_relative": CUSTOMER_RELATIVE_COLUMNS,
    "two_hop": TWO_HOP_COLUMNS,
    "subgraph": SUBGRAPH_COLUMNS,
}
FEATURE_CONTRACT = [c for cols in FEATURE_FAMILIES.values() for c in cols]
