"""Exact, replayable accounting of inference workloads as Spark plans."""
