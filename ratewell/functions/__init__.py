"""Column expressions: labels, verdicts, rubric scores, text parsing."""
