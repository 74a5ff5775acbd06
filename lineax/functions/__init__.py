"""Projections and scalar functions (#6–25), all native Spark expressions."""

from lineax.functions.columns import *  # noqa: F401,F403
from lineax.functions.columns import __all__  # noqa: F401
