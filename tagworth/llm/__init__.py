"""Operations of a training-data pipeline over text collections."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
