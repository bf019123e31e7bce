"""Character-width folding with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms U+FF01..U+FF5E stand 0xFEE0 above their ASCII forms; the rule builds the table.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
# Other spaces and dashes that stand for the plain ones.
_SPACES = "　   \t\r\n"
_DASHES = "‐‑‒–—−"


def narrow(col: Column) -> Column:
    """Full-width ASCII, odd spaces and dashes as plain ASCII, outer blanks trimmed. Null stays null."""
    return F.trim(F.translate(col, _WIDE + _SPACES + _DASHES, _NARROW + " " * len(_SPACES) + "-" * len(_DASHES)))
