"""What several operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import bounded, components, dropped, kept, shared_dir

__all__ = ["bounded", "components", "crc32_mod", "dropped", "kept", "shared_dir"]


def crc32_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n, null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
