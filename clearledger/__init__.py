"""Load, clean, mask, query and report on operational tables with Spark.

Every public function takes and returns DataFrames or Columns; nothing here
starts a job unless its docstring says so.
"""

from clearledger.specs import MaskPolicy, TableSpec

__all__ = ["MaskPolicy", "TableSpec"]
