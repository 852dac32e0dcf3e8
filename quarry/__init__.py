"""quarry: a Spark-native engine for the data side of semantic search.

Every public operation takes DataFrames and returns DataFrames; the heavy
work runs as Spark joins, aggregations, windows and Arrow-batched Python
stages. Models (encoders, scorers) are plug-ins.
"""

from quarry.session import get_session, checkpoint_dir  # noqa: F401
from quarry.config import EngineConfig  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "EngineConfig"]
