"""Table-to-table operators."""

from importlib import import_module

MODULES = ("urls", "bodies", "triage", "extraction", "accounting", "routing", "calibration", "finops", "publishing", "discovery", "social", "sampling", "certification")


def load() -> None:
    """Import every module, so that its operators are registered."""
    for name in MODULES:
        import_module(f"tidemill.operators.{name}")
