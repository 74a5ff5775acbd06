"""lineax — lineage-fitness analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrame(s) plus column names / thresholds and
returns a DataFrame; nothing row-level is pulled to the driver.
"""

from lineax.session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
