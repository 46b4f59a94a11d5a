"""Registered queries over the driver's tables and the SQL they are checked against."""

from pubmart.verification.case import Registry


def build_registry() -> Registry:
    from pubmart.verification import (
        dashboard_cases,
        derived_cases,
        extract_cases,
        layout_cases,
        reconcile_cases,
        session_cases,
    )

    registry = Registry()
    for cases in (session_cases, dashboard_cases, derived_cases, reconcile_cases, extract_cases, layout_cases):
        cases.register(registry)
    return registry
