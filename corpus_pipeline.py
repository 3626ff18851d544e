"""The corpus pipeline's stages and run(); see keyloom.llm.stages."""

from keyloom.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
