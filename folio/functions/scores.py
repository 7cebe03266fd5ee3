"""Score rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col


def score_gate(score, categories, threshold: float = 0.5) -> Column:
    """R21: 'image' when the categories contain "image" (no threshold check),
    'rejected' when the score is below the threshold, else 'accepted'."""
    cats = F.coalesce(col(categories), F.array().cast("array<string>"))
    return (
        F.when(F.array_contains(cats, "image"), F.lit("image"))
        .when(col(score) < F.lit(threshold), F.lit("rejected"))
        .otherwise(F.lit("accepted"))
    )


def meets_threshold(score, threshold: float = 0.5) -> Column:
    """Score >= threshold, no image bypass."""
    return col(score) >= F.lit(threshold)


def popularity(count, max_count) -> Column:
    """Count / max count in the bucket, 0 when the max is 0."""
    return F.when(col(max_count) > 0, col(count).cast("double") / col(max_count).cast("double")).otherwise(F.lit(0.0))


def size_factor(pop) -> Column:
    """0.5 + 1.5 * popularity (range 0.5 to 2.0)."""
    return F.lit(0.5) + F.lit(1.5) * col(pop)


def best_image(images) -> Column:
    """Slug of the image with the highest relevance (default 0.5); images
    without a slug are skipped; the first wins ties; the score must beat -1."""
    init = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("slug"))

    def step(acc, img):
        s = F.coalesce(img["relevance_score"].cast("double"), F.lit(0.5))
        ok = img["slug"].isNotNull() & (img["slug"] != "") & (s > acc["score"])
        return F.when(ok, F.struct(s.alias("score"), img["slug"].alias("slug"))).otherwise(acc)

    return F.aggregate(F.coalesce(col(images), F.array().cast("array<struct<slug:string,relevance_score:double>>")), init, step)["slug"]
