"""detectframe: detection analytics over event tables and streams, on Spark.

Every operator takes and returns DataFrames (or Boolean Columns), works on many
runs at once (``run_id`` is a key, never a loop) and leaves the physical plan to
Catalyst.
"""
