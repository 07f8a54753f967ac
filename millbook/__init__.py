"""millbook: ERP analytics (sales, inventory, production, finance, HR) on Spark.

Every operator takes a :class:`millbook.sources.tables.Tables` bundle of
DataFrames and returns a DataFrame built from built-in Spark SQL functions,
so Catalyst prunes, pushes down and plans the whole job.
"""

from millbook.session import build_session, checkpoint_dir_of, ensure_checkpoint_dir
from millbook.sources.tables import Tables, load_tables
from millbook.sources.fixtures import derive_tables

__all__ = [
    "Tables",
    "build_session",
    "checkpoint_dir_of",
    "derive_tables",
    "ensure_checkpoint_dir",
    "load_tables",
]
