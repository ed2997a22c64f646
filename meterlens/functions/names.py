"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that file names cannot carry.
UNSAFE = r'[\\/:*?"<>| ]'


def safe_suffix(segment: Column | str) -> Column:
    """Segment name usable in a path."""
    return F.regexp_replace(segment, UNSAFE, "_")
