"""Weekday labels for ``order_dow`` (F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the reference's weekday labels, 0 = Sunday ----------------
DOW_LABELS = {0: "Dom", 1: "Lun", 2: "Mar", 3: "Mer", 4: "Gio", 5: "Ven", 6: "Sab"}
# ---- end of fixed values ------------------------------------------------------


def dow_label(col) -> Column:
    """Label for a 0..6 weekday code; any other value (or NULL) gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    branches = None
    for code, label in DOW_LABELS.items():
        branches = (F.when(c == code, label) if branches is None
                    else branches.when(c == code, label))
    return branches
