"""Compute-cluster telemetry analytics as PySpark DataFrame operators.

Every operator is a function from DataFrame to DataFrame.  The session belongs
to the caller; its time zone is expected to be UTC and ANSI mode may stay on.
"""
