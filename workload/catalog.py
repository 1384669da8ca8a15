"""All registered queries."""

from __future__ import annotations

from workload import assembly, coverage, roundtrip, space, tables, telemetry, verification

REGISTRIES = [verification.REG, telemetry.REG, space.REG, tables.REG, assembly.REG, roundtrip.REG, coverage.REG]


def all_queries() -> dict:
    return {k: v for reg in REGISTRIES for k, v in reg.queries.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for reg in REGISTRIES for k, v in reg.oracles.items()}
