"""Whether a cut-out can be trusted: reasons against it, from measures of its mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits of the measures
FOREGROUND_LOSS, SUPPORTED_LOSS, HOLES, RESIDUE, RESIDUE_PATCH = 0.02, 0.0008, 0.0004, 0.0012, 0.00025
GREAT_LOSS, GREAT_HOLES, MANY_LOST, MANY_MISSING = 0.008, 0.008, 25, 3
REFINE_RESIDUE, REFINE_PATCH = 0.0008, 0.0002
LEAST_BACKGROUND, GRADIENT_MEDIAN, GRADIENT_P90 = 0.12, 12.0, 38.0
LEAST_FOREGROUND, MOST_FOREGROUND, LEAST_SOLID, MOST_SOFT, MOST_PARTS = 0.015, 0.92, 0.006, 0.82, 160

MEASURES = (
    "removed_foreground", "removed_supported", "interior_holes", "lost_parts", "missing_parts", "residue", "residue_patch",
)


def _listed(**reasons: Column) -> Column:
    """Names of those reasons that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in reasons.items())))


def _m(name: str) -> Column:
    return F.col(name)


def safety_reasons() -> Column:
    """Reasons against a cleaned mask; columns are the MEASURES."""
    supported = (_m("removed_supported") > SUPPORTED_LOSS) | (_m("lost_parts") > 0)
    return _listed(
        cleanup_removed=(_m("removed_foreground") > FOREGROUND_LOSS) & supported,
        supported_loss=_m("removed_supported") > SUPPORTED_LOSS,
        lost_parts=_m("lost_parts") > 0,
        holes=_m("interior_holes") > HOLES,
        missing_parts=_m("missing_parts") > 0,
        residue=(_m("residue") > RESIDUE) | (_m("residue_patch") > RESIDUE_PATCH),
    )


def catastrophic_reasons() -> Column:
    """Those that no later step can make up for; where a mask is cleaned in production these replace the others."""
    return _listed(
        supported_loss=_m("removed_supported") > GREAT_LOSS,
        holes=_m("interior_holes") > GREAT_HOLES,
        lost_parts=_m("lost_parts") >= MANY_LOST,
        missing_parts=_m("missing_parts") >= MANY_MISSING,
    )


def alpha_verdict(foreground: Column, solid: Column, soft: Column, parts: Column) -> Column:
    """'ok', or why a mask cannot be an object's."""
    return (
        F.when(foreground < LEAST_FOREGROUND, "too small").when(foreground > MOST_FOREGROUND, "covers everything")
        .when(solid < LEAST_SOLID, "too few solid pixels").when(soft > MOST_SOFT, "too uncertain").when(parts > MOST_PARTS, "too fragmented").otherwise("ok")
    )


def needs_refinement(status_ok: Column, reasons: Column) -> Column:
    """Whether a finished mask still has a likely flaw; null measures speak for nothing."""
    flaw = (_m("missing_parts") > 0) | (_m("residue") > REFINE_RESIDUE) | (_m("residue_patch") > REFINE_PATCH)
    return ~status_ok | (F.size(reasons) > 0) | F.coalesce(flaw, F.lit(False))


def route_reasons(status_ok: Column, reasons: Column, coverage: Column, gradient_median: Column, gradient_p90: Column) -> Column:
    """Why the quick route is not enough; an empty list lets a photo take it. Each reason counts once, in order."""
    own = _listed(
        status=~status_ok,
        supported_loss=_m("removed_supported") > SUPPORTED_LOSS,
        holes=_m("interior_holes") > HOLES,
        lost_parts=_m("lost_parts") > 0,
        missing_parts=_m("missing_parts") > 0,
        residue=_m("residue") > REFINE_RESIDUE,
        residue_patch=_m("residue_patch") > REFINE_PATCH,
    )
    ground = _listed(little_background=coverage < LEAST_BACKGROUND, textured=(gradient_median > GRADIENT_MEDIAN) | (gradient_p90 > GRADIENT_P90))
    return F.array_distinct(F.concat(own, reasons, ground))


def merged_route(clean_ok: Column, clean_reasons: Column, keep_ok: Column, keep_reasons: Column, fused_ok: Column) -> Column:
    """Which matte a photo with two gets: fused, one of them, or a person's decision.

    Without a clean matte only a keeping one without reasons will do; without a keeping one a person decides; else they are
    fused, and what the fusion says counts. A flawed clean matte is saved by fusion only if parts that it misses are its only flaw.
    """
    only_missing = F.forall(clean_reasons, lambda r: r == "missing_parts")
    return (
        F.when(clean_ok.isNull(), F.when(keep_ok & (F.size(keep_reasons) == 0), "keeping").otherwise("review"))
        .when(keep_ok.isNull(), "review")
        .when(fused_ok & (clean_ok | only_missing), "fused")
        .otherwise("review")
    )
