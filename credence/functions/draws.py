"""Seeded draws that depend on a stream name and a key alone.

Sequential generators would tie a draw to the order of rows. Here each purpose has a stream and each
unit one draw, taken from an md5, so results do not depend on partitioning and SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def digest(stream: str | Column, *key) -> Column:
    """The md5 of ``stream:key:...``; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", *[_text(k) for k in (stream, *key)]).cast("binary"))


def uniform(stream: str | Column, *key) -> Column:
    """A uniform number in [0, 1) with 32 bits."""
    return F.conv(F.substring(digest(stream, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
