"""Hierarchical ids ``idA_idB_idC``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "_"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def id_parts(c) -> Column:
    return F.split(_c(c), SEP)


def id_level(c) -> Column:
    """0 for a top-level id, 1 for ``a_b`` ..."""
    return F.size(id_parts(c)) - 1


def id_prefix(c, level: int) -> Column:
    """The ancestor id at ``level`` (0 = first part)."""
    return F.array_join(F.slice(id_parts(c), 1, level + 1), SEP)


def parent_id(c) -> Column:
    parts = id_parts(c)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEP))


def id_part(c, i: int) -> Column:
    return id_parts(c).getItem(i)


def zfill(c, width: int) -> Column:
    """Python ``str.zfill``: left-pad with zeros, never truncate."""
    s = _c(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def make_id(*parts_and_widths) -> Column:
    """``make_id((col, 4), (col2, 3))`` -> ``zfill(col,4) || '_' || zfill(col2,3)``."""
    return F.concat_ws(SEP, *[zfill(p, w) for p, w in parts_and_widths])
