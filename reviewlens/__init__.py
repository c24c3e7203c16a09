"""reviewlens: a PySpark-native engine for labelling and mining review text.

Every operator takes and returns a DataFrame (or a Column for scalar
functions).  The work is declared with the DataFrame / SQL API so that
Catalyst prunes columns, pushes filters into the Parquet scan and keeps the
expressions inside whole-stage code generation.
"""

__all__ = ["config", "session"]
