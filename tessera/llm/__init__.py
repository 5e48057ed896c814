"""Operators of a training-data pipeline, each a Spark job of its own.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
