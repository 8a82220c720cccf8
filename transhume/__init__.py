"""Workspace move planning as Spark DataFrame queries.

The package takes an exported workspace (code assets, tables, jobs, clusters) as DataFrames and
works out what moving it takes.  ``functions`` holds Column expressions, ``operators`` maps
DataFrames to DataFrames, ``sources`` and ``sinks`` read and write, ``plans`` composes whole jobs.
"""
