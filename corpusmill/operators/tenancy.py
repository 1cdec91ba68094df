"""Tenants: the context of a caller, the filter it implies, and filters in general.

A caller's filters are combined with the tenant's by AND; a filter on a tenant key that differs from the context is an
error, so a query can't leave its tenant.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Access levels, from both of the models that documents may carry; the default and what a caller sees by default.
ACCESS_LEVELS = ("public", "internal", "restricted", "confidential", "secret")
DEFAULT_LEVEL = "internal"
DEFAULT_ALLOWED = ("public", "internal")
LEAST_NAME = 3
RANGES = {"gte": "ge", "lte": "le", "gt": "gt", "lt": "lt"}
TENANT_KEYS = ("organization_id", "workspace_id", "collection_id")


@dataclass(frozen=True)
class TenantContext:
    organization_id: str
    workspace_id: str | None = None
    collection_id: str | None = None
    user_id: str | None = None
    access_level: str = DEFAULT_LEVEL
    allowed_access_levels: tuple[str, ...] = field(default=DEFAULT_ALLOWED)

    def __post_init__(self):
        if not self.organization_id or len(self.organization_id) < LEAST_NAME:
            raise ValueError(f"organization_id must have {LEAST_NAME} characters or more")
        if self.access_level not in ACCESS_LEVELS:
            object.__setattr__(self, "access_level", DEFAULT_LEVEL)

    def filters(self) -> dict:
        """The conditions on every row that the caller may see."""
        out: dict = {"organization_id": self.organization_id}
        for key in TENANT_KEYS[1:]:
            if getattr(self, key):
                out[key] = getattr(self, key)
        return out | {"access_level": list(self.allowed_access_levels)}


def condition(filters: dict, ranges: bool = True) -> Column:
    """AND of all conditions: a list means IN, a dict a range (gte, lte, gt, lt), anything else equality; None means null.

    Without ranges (keyword search has none) a range matches nothing.
    """
    parts = []
    for key, want in filters.items():
        own = F.col(key)
        if isinstance(want, dict):
            unknown = set(want) - set(RANGES)
            if unknown:
                raise ValueError(f"unknown range {sorted(unknown)} for {key}")
            tests = {"ge": own >= F.lit(want.get("gte")), "le": own <= F.lit(want.get("lte")), "gt": own > F.lit(want.get("gt")), "lt": own < F.lit(want.get("lt"))}
            parts += [tests[RANGES[k]] for k in want] if ranges else [F.lit(False)]
        elif isinstance(want, list | tuple):
            some = own.isin([w for w in want if w is not None])
            parts.append(some | own.isNull() if None in want else some)
        else:
            parts.append(own.isNull() if want is None else own == F.lit(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def merged_filters(context: TenantContext, filters: dict | None) -> dict:
    """The caller's filters and the tenant's; access levels are intersected."""
    out = context.filters()
    for key, want in (filters or {}).items():
        if key == "access_level":
            asked = list(want) if isinstance(want, list | tuple) else [want]
            out[key] = [x for x in out[key] if x in asked]
        elif key in TENANT_KEYS and key in out and want != out[key]:
            raise PermissionError(f"{key} is {out[key]!r} for this caller")
        else:
            out[key] = want
    return out


def for_tenant(frame: DataFrame, context: TenantContext, filters: dict | None = None, ranges: bool = True) -> DataFrame:
    """The rows that the caller may see and asks for. The condition reaches the scan, and prunes a table partitioned by organization_id."""
    return frame.where(condition(merged_filters(context, filters), ranges))


def stamped(frame: DataFrame, context: TenantContext) -> DataFrame:
    """frame with the tenant's columns, which win over columns of these names."""
    return frame.withColumns({
        "organization_id": F.lit(context.organization_id), "workspace_id": F.lit(context.workspace_id).cast("string"),
        "collection_id": F.lit(context.collection_id).cast("string"), "access_level": F.lit(context.access_level),
    })


def metadata_contains(column: Column, wanted: dict) -> Column:
    """JSON text holds every key with its value."""
    parts = [F.get_json_object(column, f"$.{k}") == F.lit(v if isinstance(v, str) else str(v)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
