"""Hi-C contact analytics on Spark DataFrames."""

from .errors import (
    ContactWeaveError,
    GfaFormatError,
    MatrixIndexError,
    NotBalancedError,
    ResolutionError,
)

__all__ = [
    "ContactWeaveError",
    "GfaFormatError",
    "MatrixIndexError",
    "NotBalancedError",
    "ResolutionError",
]
