"""Code-fact analytics over Spark DataFrames.

Sources turn toolchain output into line or row DataFrames, operators resolve
them into facts keyed by one symbol identity and answer questions about those
facts, plans tie the steps into a collected snapshot and its query surface.
"""

from codefacts.facts import Facts

__all__ = ["Facts"]
