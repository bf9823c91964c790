"""Spark jobs for large evaluation tables: arenas, rubric scores, rank statistics, curation and streams."""
