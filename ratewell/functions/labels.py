"""Player labels: "reference", or a mode and a profile as in "agent:m3"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "reference"
#: The pools of a leaderboard, and the endings that a displayed name drops.
POOLS = ("baseline", "agent", "full")
ENDINGS = ("high", "thinking")


def in_pool(label: Column, pool: Column) -> Column:
    """The reference is in every pool; others are in full and in the pool of their mode."""
    return (label == REFERENCE) | (pool == "full") | label.startswith(F.concat(pool, F.lit(":")))


def mode_of(label: Column) -> Column:
    """What stands before the first colon; baseline without one."""
    return F.when(label == REFERENCE, REFERENCE).when(F.instr(label, ":") > 0, F.substring_index(label, ":", 1)).otherwise("baseline")


def profile_of(label: Column) -> Column:
    return F.when(F.instr(label, ":") > 0, F.regexp_replace(label, "(?s)^[^:]*:", "")).otherwise(label)


def display_name(profile: Column) -> Column:
    return F.when(profile == REFERENCE, "Reference").otherwise(F.regexp_replace(profile, f"-({'|'.join(ENDINGS)})$", ""))


def label_in_pool(label: str, pool: str) -> bool:
    """in_pool for a plain label."""
    return label == REFERENCE or pool == "full" or label.startswith(f"{pool}:")
