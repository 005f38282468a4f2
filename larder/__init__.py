"""larder — stock-control analytics on Spark.

Four reports over a multi-store inventory model (item activity ledger,
stock-request pick sheet, item search, period usage summary), each composed
from small DataFrame operators with explicit parameters.
"""

from .sources import Catalog

__all__ = ["Catalog"]
