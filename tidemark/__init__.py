"""Point-in-time record analytics on Spark.

The package holds DataFrame operators only: every public function takes and
returns DataFrames or Columns and leaves the physical strategy to Catalyst.
"""

__version__ = "0.1.0"
