"""Readers and writers. All paths go through Spark's own readers, so any store that Spark opens will do."""
