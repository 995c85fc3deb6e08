"""Regressions of a snapshot against the one before: rules on its changes, each an expression of the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule by id, or by its condition where the id isn't one of RULES. Source says who set it."""

    id: str
    severity: str
    dimension: str = ""
    condition: str = ""
    value: str = ""
    source: str = "hardcoded"


def _nothing() -> Column:
    return F.array().cast("array<string>")


def csp_gained(token: str) -> Column:
    """The first added policy token that contains ``token``."""
    return F.slice(F.filter(F.coalesce("csp_added", _nothing()), lambda x: x.contains(token)), 1, 1)


def dangerous_permissions() -> Column:
    """Names of the dangerous ones among the added permissions."""
    return F.transform(F.filter(F.coalesce("permissions_added", F.expr("cast(array() as array<struct<name:string,dangerous:boolean>>)")), lambda p: p.dangerous), lambda p: p["name"])


def preference_set(name: str, to: str) -> Column:
    """``name: old -> new`` if a preference changed to ``to``."""
    change = F.try_element_at("prefs_changed", F.lit(name))
    text = F.concat(F.lit(name + ": "), F.coalesce(change["old"], F.lit("<nil>")), F.lit(" -> "), change["new"])
    return F.when(change["new"] == to, F.array(text)).otherwise(_nothing())


def grown(what: str) -> Column:
    """The added items if there are more of them than before; a blank item if none is named."""
    more = F.col(f"{what}_new") > F.col(f"{what}_old")
    named = F.coalesce(F.col(f"{what}_added"), _nothing())
    return F.when(more, F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("")))).otherwise(_nothing())


# Ids of the built-in rules. Each gives its evidence; a rule fires if there is any.
RULES = {
    "csp-unsafe-inline-added": lambda: csp_gained("unsafe-inline"),
    "csp-unsafe-eval-added": lambda: csp_gained("unsafe-eval"),
    "dangerous-permission-added": dangerous_permissions,
    "sandbox-flag-removed": lambda: preference_set("sandbox", "false"),
    "contextisolation-disabled": lambda: preference_set("contextIsolation", "false"),
    "nodeintegration-enabled": lambda: preference_set("nodeIntegration", "true"),
    "telemetry-sdk-added": lambda: grown("telemetry"),
    "external-api-endpoint-added": lambda: grown("endpoints"),
    "cert-pinning-removed": lambda: F.when(F.coalesce("cert_pinning_removed", F.lit(False)), F.array(F.lit(""))).otherwise(_nothing()),
}


def evidence_of(rule: Rule) -> Column:
    """Evidence of a rule; rules of an unknown id and condition have none."""
    if rule.id in RULES:
        return RULES[rule.id]()
    if rule.condition == "added_value_contains" and rule.dimension == "security_config" and rule.value:
        return csp_gained(rule.value)
    if rule.condition == "array_length_increased" and rule.dimension == "structural":
        more = (F.size(grown("telemetry")) > 0) | (F.size(grown("endpoints")) > 0)
        return F.when(more, F.array(F.lit(""))).otherwise(_nothing())
    return _nothing()


def merge_rules(defaults: Sequence[Rule], user: Sequence[Rule]) -> list[Rule]:
    """User rules replace defaults of the same id in their place; new ones come behind."""
    own = {r.id: r for r in user}
    known = {r.id for r in defaults}
    return [own.get(r.id, r) for r in defaults] + [r for r in user if r.id not in known]


def classify(changes: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """(id, rule, severity, source, evidence) of every rule that fires.

    ``changes`` has csp_added, permissions_added (name, dangerous), prefs_changed (map of name to old and new),
    telemetry_old, _new and _added, endpoints_old, _new and _added, cert_pinning_removed; all may be null.
    """
    fired = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.source).alias("source"), evidence_of(r).alias("evidence")) for r in rules])
    return changes.select(id_col, F.explode(F.filter(fired, lambda x: F.size(x.evidence) > 0)).alias("r")).select(id_col, "r.*")
