"""The training-data pipeline, as the driver looks for it; its stages are in the optional subpackage."""

from reelframe.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
