"""Judges' verdicts: five tokens, their scores, and what both directions of a comparison say together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The score of each token for the side named A.
SCORES = {"A>>B": 1.0, "A>B": 0.75, "A=B": 0.5, "B>A": 0.25, "B>>A": 0.0}


def score_of(token: Column) -> Column:
    """Null for any other token."""
    return F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])[token]


def winner_of(score: Column) -> Column:
    return F.when(score > 0.5, "a").when(score < 0.5, "b").when(score == 0.5, "tie")


def debiased(forward: Column, reverse: Column) -> Column:
    """The mean of A's score in both directions; the reverse one is seen from B."""
    return (forward + (1 - reverse)) / 2


def consistent(forward: Column, reverse: Column) -> Column:
    """Both directions are ties, or they name the same player."""
    a, b = winner_of(forward), winner_of(reverse)
    return ((a == "tie") & (b == "tie")) | ((a == "a") & (b == "b")) | ((a == "b") & (b == "a"))
