"""Scores shown to people, and shapes after a turn, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aesthetic(positive: Column, negative: Column) -> Column:
    """0 to 1 from the similarities to a good and a bad description."""
    return 1 / (1 + F.exp(-30 * (positive - negative)))


def tag_confidence(score: Column) -> Column:
    """A tag's score between 1 and 4 as 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - 1) / 3))


def probability(similarity: Column, scale: float, bias: float) -> Column:
    """A similarity as the model's probability."""
    return 1 / (1 + F.exp(-(similarity * scale + bias)))


def shown_size(width: Column, height: Column, turn: Column) -> Column:
    """Struct (w, h) of a picture turned by a multiple of 90 degrees."""
    sideways = F.pmod(F.coalesce(turn, F.lit(0)), F.lit(180)) == 90
    return F.struct(F.when(sideways, height).otherwise(width).alias("w"), F.when(sideways, width).otherwise(height).alias("h"))
