"""One row per point for an interactive map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.functions.text import title_case
from shortlens.operators.filters import gate_labels
from shortlens.operators.ranking import with_occurrences


def map_points(
    df: DataFrame,
    layers: Sequence[str],
    sentence: str = "sentence",
    prob: str = "soft_probability",
    min_prob: float = 0.005,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The point, its title-cased label layers with unsure ones hidden, how often its sentence occurs, and kept columns."""
    titled = df.withColumns({c: title_case(F.col(c)) for c in layers})
    gated = gate_labels(titled, layers, prob, min_prob)
    sized = with_occurrences(gated, sentence, "marker_size")
    return sized.select(*keep, sentence, *layers, "marker_size")
