"""Content processors: what of a page's text is worth reading, by its content type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import col, let, sentences


def main_content(text: str | Column, kind: Column) -> Column:
    """Articles lose a tenth of their sentences at each end, listings keep 20, forums 5; others are whole."""

    def article(s: Column) -> Column:
        n, skip = F.size(s), F.floor(F.size(s) / 10).cast("int")
        return F.when(n > 10, F.array_join(F.slice(s, skip + 1, n - 2 * skip), " ")).otherwise(col(text))

    first = lambda most: let(sentences(text), lambda s: F.when(F.size(s) > most, F.array_join(F.slice(s, 1, most), " ")).otherwise(col(text)))
    return F.when(kind == "article", let(sentences(text), article)).when(kind == "listing", first(20)).when(kind == "forum", first(5)).otherwise(col(text))


def flags(kind: Column) -> Column:
    """Listings ask for a second visit, forums are noisy, documentation is technical."""
    return F.struct((kind == "listing").alias("requires_follow_up"), (kind == "forum").alias("high_noise"), (kind == "documentation").alias("is_technical"))


def hierarchical_windows(text: str | Column, size: int = 4000, overlap: float = 0.25) -> Column:
    """Windows of ``size`` characters that overlap by a share; the last reaches the end."""
    t = col(text)
    step = int(size * (1 - overlap))
    n = F.greatest(F.lit(1), F.ceil((F.length(t) - size) / step).cast("int") + 1)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
