"""All registered queries, gathered from the workload modules."""

from __future__ import annotations

from pressgauge.workload import (
    gold_queries,
    intake_queries,
    lake_queries,
    record_queries,
    screen_queries,
)

FLAGSHIP = "a2_a3_w5_w6_subject_trend"
_MODULES = (gold_queries, screen_queries, record_queries, intake_queries, lake_queries)


def queries() -> dict:
    out: dict = {}
    for module in _MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLE.items()}
