"""The corpus pipeline; its stages are in the training-data subpackage, whose operators they call."""

from quillmark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
