"""How alike two party names are, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_overlap(words_a: Column, words_b: Column) -> Column:
    """Shared words over all words; 0 when either side has none."""
    shared = F.size(F.array_intersect(words_a, words_b))
    every = F.size(F.array_union(words_a, words_b))
    return F.when((F.size(words_a) == 0) | (F.size(words_b) == 0), 0.0).otherwise(shared / every)


def name_similarity(a: Column, b: Column, words_a: Column, words_b: Column, containment: bool) -> Column:
    """1.0 for equal names; with ``containment`` 0.8 when one holds the other; else the word overlap."""
    score = F.when(a == b, 1.0)
    if containment:
        score = score.when(F.contains(a, b) | F.contains(b, a), 0.8)
    return score.otherwise(word_overlap(words_a, words_b))
