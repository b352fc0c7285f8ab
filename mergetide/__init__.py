"""Divergence analytics over two snapshots of a file collection, written as Spark DataFrame jobs."""
