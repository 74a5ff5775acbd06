"""Streaming.

The reference has no streaming operators: every input is a finished file and
day binning is a batch projection.  Nothing is built here on purpose; the
batch operators are lazy DataFrame functions, so a user who receives
surveillance records as a stream can call them from ``foreachBatch``.
"""
