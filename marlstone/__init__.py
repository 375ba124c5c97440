"""marlstone: entity-catalog analytics on Spark DataFrames.

``functions``  column-level building blocks
``operators``  DataFrame -> DataFrame operators
``sources``    readers, writers and table schemas
``plans``      multi-operator pipelines and scratch storage
``streaming``  Structured Streaming variants
"""
