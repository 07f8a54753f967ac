"""Key lookups for change batches: semi-join reduction.

A batch of requests is small next to the table it is checked against. The
batch's distinct keys filter the table's key column first (a left semi-join,
broadcast when the key set is small), so only matching keys are shuffled,
never the whole table's key column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_present(target: DataFrame, target_key: str, probe: DataFrame, probe_key: str,
                 alias: str = "_k") -> DataFrame:
    """Distinct ``target_key`` values of ``target`` that also occur as ``probe_key`` in ``probe``."""
    wanted = probe.select(F.col(probe_key).alias(alias)).filter(F.col(alias).isNotNull()).distinct()
    return target.select(F.col(target_key).alias(alias)).join(wanted, alias, "left_semi").distinct()
