"""Units outside of Spark, for readers."""

from __future__ import annotations

#: Microvolts in a unit.
MICROVOLTS = {"V": 1e6, "mV": 1e3, "µV": 1.0, "μV": 1.0, "uV": 1.0, "nV": 1e-3}


def to_microvolts(unit: str) -> float:
    """The factor to microvolts; 1 for what is no voltage."""
    return MICROVOLTS.get((unit or "").strip(), 1.0)
