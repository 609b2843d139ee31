"""Column expressions: cleaning, masking, tiers and statuses."""
from .columns import (  # noqa: F401
    clean_entity, case_severity, drift_status, guarded_ratio, health_band, mask_identifier,
    mask_tail, monitor_status, raw_entity, risk_tier, stable_id,
)
from .frames import beside  # noqa: F401
