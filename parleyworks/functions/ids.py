"""Normal forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v "


def norm_id(column: Column | str) -> Column:
    """Lower case, without surrounding blanks; blank values become null."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(out != "", out)
