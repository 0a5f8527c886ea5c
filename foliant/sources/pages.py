"""Pages as a reader of fixed layouts hands them on: text, size and the images placed on them, measured for routing.

Reading the layouts themselves needs a native library, for which the port `reader` stands; what it gives can be recorded
as JSON lines and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import alpha_ratio, garbage_ratio

MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
RECORDED = f"path string, title string, pages array<struct<text:string,width:double,height:double,images:array<array<{MATRIX}>>>>"
FRAMES = "path string, frames array<struct<width:int,height:int>>"


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, page, n_pages, text, width, height, images) of recorded documents, pages from 1. `images` has for each
    image the matrices that place it, the innermost first."""
    rows = spark.read.schema(RECORDED).json(path)
    return rows.select("path", "title", F.size("pages").alias("n_pages"), F.posexplode("pages").alias("at", "p")).select("path", "title", (F.col("at") + 1).alias("page"), "n_pages", "p.*")


def recorded_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, width, height): one row for each frame of recorded images, from 1."""
    rows = spark.read.schema(FRAMES).json(path)
    return rows.select("path", F.posexplode("frames").alias("at", "f")).select("path", (F.col("at") + 1).alias("frame"), "f.width", "f.height")


def _identity() -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))))


def _then(m: Column, n: Column) -> Column:
    """The placement `m` followed by `n`: x' = a x + c y + e, y' = b x + d y + f."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"), (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def bounds(matrices: Column) -> Column:
    """The rectangle (left, bottom, right, top) on the page of a unit square that nested placements transform."""
    m = F.aggregate(matrices, _identity(), _then)

    def around(x: Column) -> Column:
        xs = F.array(x["e"], x["a"] + x["e"], x["c"] + x["e"], x["a"] + x["c"] + x["e"])
        ys = F.array(x["f"], x["b"] + x["f"], x["d"] + x["f"], x["b"] + x["d"] + x["f"])
        return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))

    return F.get(F.transform(F.array(m), around), 0)


def coverage(images: Column, width: Column, height: Column) -> Column:
    """The share of a page that its images cover, each clipped to the page, 1 at most; 0 for a page without area."""
    part = lambda b: F.greatest(F.lit(0.0), F.least(b["right"], width) - F.greatest(b["left"], F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(b["top"], height) - F.greatest(b["bottom"], F.lit(0.0)))
    area = F.aggregate(F.transform(images, bounds), F.lit(0.0), lambda s, b: s + part(b))
    return F.coalesce(F.when(width * height > 0, F.least(F.lit(1.0), area / (width * height))), F.lit(0.0))


def measured(pages: DataFrame) -> DataFrame:
    """Adds n_chars, n_images, image_coverage, garbage_ratio and alpha_ratio, ratios with three digits; a null text is
    empty, null images are none."""
    t, images = F.coalesce("text", F.lit("")), F.coalesce("images", F.array().cast(f"array<array<{MATRIX}>>"))
    return pages.withColumns({
        "n_chars": F.length(F.trim(t)).cast("bigint"), "n_images": F.size(images), "image_coverage": F.round(coverage(images, F.col("width"), F.col("height")), 3),
        "garbage_ratio": F.round(garbage_ratio(t), 3), "alpha_ratio": F.round(alpha_ratio(t), 3),
    })
