"""Candidates -> a new ordered list, in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.operators.lists import CHUNK
from spinlog.operators.numbering import number_rows
from spinlog.operators.resolve import Resolution, resolution_stats, resolve


@dataclass
class BuiltList:
    created: bool
    reason: str | None
    details: dict
    items: DataFrame | None  # position, chunk, uri
    outcome: DataFrame
    stats: dict


def ordered_items(outcome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Resolved URIs in input order, repeats kept, in chunks of `chunk`."""
    resolved = outcome.where(F.col("status") == "resolved").select("input_idx", "uri")
    numbered = number_rows(resolved, [F.col("input_idx").asc(), F.col("uri").asc()], "n")
    return numbered.select(
        (F.col("n") - 1).alias("position"),
        F.floor((F.col("n") - 1) / chunk).alias("chunk"),
        "input_idx",
        "uri",
    )


def build_list(
    name: str, resolution: Resolution, *, description: str = "", public: bool = False, skip_unresolved: bool = True
) -> BuiltList:
    """Refuses when something is unresolved and may not be skipped, or when nothing resolved."""
    stats = resolution_stats(resolution.outcome).first().asDict()
    details = {"name": name, "description": description, "public": public}
    reason = None
    if stats["unresolved"] and not skip_unresolved:
        reason = (
            f"{stats['unresolved']} of {stats['total']} candidates did not resolve, "
            "and unresolved ones may not be skipped; nothing was created"
        )
    elif not stats["resolved"]:
        reason = "none of the candidates resolved"
    items = None if reason else ordered_items(resolution.outcome)
    return BuiltList(reason is None, reason, details, items, resolution.outcome, stats)


def build_from_candidates(
    name: str,
    candidates: DataFrame,
    catalog: DataFrame | None = None,
    *,
    description: str = "",
    public: bool = False,
    skip_unresolved: bool = True,
    **options,
) -> tuple[BuiltList, Resolution]:
    """Resolve, always strict, then build; the resolution is returned for its new cache rows."""
    resolution = resolve(candidates, catalog, strict=True, **options)
    built = build_list(name, resolution, description=description, public=public, skip_unresolved=skip_unresolved)
    return built, resolution
