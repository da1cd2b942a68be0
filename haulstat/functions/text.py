"""Content words of an observation and how far two observations overlap."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a defect, and the overlap constants.
NOISE = """the a an and or but with without from that this there here which where when are is was
were has have had its it of on in at to for by as no not any some all both one two visible appears
appear shows showing seen photo image frame side across along around near over under than more most
less very rather still""".split()
SAME_DEFECT, SAME_DEFECT_CROSS_ID = 0.42, 0.50
SAME_TWIN = 0.30  # below the merge threshold, so that rates between twins are lower bounds
CONTAINMENT_MIN_WORDS, CONTAINMENT_SHARE = 4, 0.75


def ascii_edges(pattern: str) -> str:
    """``pattern`` with word edges between ASCII word signs and all others, as the statements' engine sees them.

    Java counts accented letters as word signs too, so a word after one has no edge there.
    """
    sign = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<!{sign})(?={sign})|(?<={sign})(?!{sign}))")


def content_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of four letters or more, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), 0)
    noise = F.array(*[F.lit(w) for w in NOISE if len(w) >= 4])
    return F.array_sort(F.array_except(F.array_distinct(words), noise))


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def overlap(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Better of Jaccard and discounted containment, from counts of distinct words."""
    either = size_a + size_b - shared
    smaller = F.least(size_a, size_b)
    jaccard = F.when(either > 0, shared / either).otherwise(F.lit(0.0))
    contained = F.when(smaller >= CONTAINMENT_MIN_WORDS, F.lit(CONTAINMENT_SHARE) * shared / smaller).otherwise(F.lit(0.0))
    return F.greatest(jaccard, contained)


def overlap_of(a: tuple[frozenset, str], b: tuple[frozenset, str]) -> float:
    """``overlap`` of two texts in a task, each its content words and its folded wording; a blank text overlaps with none."""
    if not a[0] or not b[0]:
        return 1.0 if a == b and a[1] else 0.0
    shared, smaller = len(a[0] & b[0]), min(len(a[0]), len(b[0]))
    jaccard = shared / (len(a[0]) + len(b[0]) - shared)
    return max(jaccard, CONTAINMENT_SHARE * shared / smaller) if smaller >= CONTAINMENT_MIN_WORDS else jaccard
