"""Security-alert triage as Spark jobs: every operator takes and returns DataFrames."""

from alertloom.config import TriageConfig

__all__ = ["TriageConfig"]
