"""Image metrics, cleaning, enhancement, features and labels.

Input rows hold (path, file_size, height, width, channels, data). Pixel work runs batch-wise inside
tasks; filters, counts, duplicates and joins are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import pixels as px
from sievework.operators.profile import describe

METRICS = "path string, filename string, width int, height int, channels int, file_size long, aspect_ratio double, resolution long, blur_score double, brightness double, contrast double, image_hash string"
# Size and ratio limits behind the corruption flags.
MIN_FILE_BYTES = 100
# Bytes of pixels that a task hands back at a time.
OUT_BYTES = 16 << 20


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            ok = r.height is not None and not pd.isna(r.height)
            a = px.to_array(r.data, int(r.height), int(r.width), int(r.channels)) if ok else None
            head = (r.path, r.path.rsplit("/", 1)[-1])
            if a is None:
                rows.append((*head, None, None, None, r.file_size, None, None, None, None, None, None))
                continue
            level, spread = px.channel_stats(a)
            rows.append((*head, r.width, r.height, r.channels, r.file_size, r.width / r.height, int(r.width) * int(r.height),
                         px.blur_score(a), level, spread, px.average_hash(a)))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in METRICS.split(", ")]).astype(
            {"width": "Int32", "height": "Int32", "channels": "Int32", "resolution": "Int64"})


def corruption_reasons() -> Column:
    """Reasons a measured image counts as corrupted, empty when it is fine."""
    test = lambda cond, name: F.when(cond, F.lit(name))
    reasons = [
        test(F.col("height").isNull(), "undecodable"),
        test(F.col("resolution") == 0, "invalid_dimensions"),
        test(F.col("file_size") < MIN_FILE_BYTES, "small_file"),
        test((F.col("brightness") < 1) | (F.col("brightness") > 254), "extreme_brightness"),
        test(F.col("contrast") < 0.1, "no_variation"),
        test((F.col("aspect_ratio") > 100) | (F.col("aspect_ratio") < 0.01), "extreme_aspect"),
    ]
    return F.filter(F.array(*reasons), lambda v: v.isNotNull())


def analyze_images(images: DataFrame) -> DataFrame:
    """One row of measures per image with corruption reasons and flag."""
    narrow = images.select("path", "file_size", "height", "width", "channels", "data")
    m = narrow.mapInPandas(_measure, METRICS)
    return m.withColumn("corruption_reasons", corruption_reasons()).withColumn("is_corrupted", F.size("corruption_reasons") > 0)


def rejection(
    min_resolution: int = 32 * 32, max_resolution: int = 4096 * 4096, min_blur: float = 100, min_brightness: float = 10,
    max_brightness: float = 245, min_contrast: float = 10, remove_corrupted: bool = True,
) -> Column:
    """First failing step of an image, null when it passes all of them."""
    first = F.when(F.col("is_corrupted"), "corrupted") if remove_corrupted else F.when(F.lit(False), "")
    return (
        first.when(F.col("resolution") < min_resolution, "low_resolution")
        .when(F.col("resolution") > max_resolution, "high_resolution")
        .when(F.col("blur_score") < min_blur, "blurry")
        .when((F.col("brightness") < min_brightness) | (F.col("brightness") > max_brightness), "brightness_issues")
        .when(F.col("contrast") < min_contrast, "low_contrast")
    )


STEPS = ["corrupted", "low_resolution", "high_resolution", "blurry", "brightness_issues", "low_contrast", "duplicates"]


def judge_images(metrics: DataFrame, remove_duplicates: bool = True, **limits) -> DataFrame:
    """Measures plus `removed_by`; duplicates count among the survivors, first path kept."""
    judged = metrics.withColumn("removed_by", rejection(**limits))
    if not remove_duplicates:
        return judged
    # Copies of one hash collapse map-side; the join side holds one row per hash.
    first = judged.filter("removed_by IS NULL").groupBy("image_hash").agg(F.min("path").alias("_first"))
    return judged.join(first, "image_hash", "left").withColumn(
        "removed_by", F.when(F.col("removed_by").isNull() & (F.col("path") != F.col("_first")), "duplicates").otherwise(F.col("removed_by"))
    ).drop("_first")


def clean_images(metrics: DataFrame, remove_duplicates: bool = True, **limits) -> tuple[DataFrame, DataFrame]:
    """Surviving images and one row of step counters."""
    judged = judge_images(metrics, remove_duplicates, **limits)
    stats = judged.agg(
        F.count("*").alias("initial_count"), *[F.count_if(F.col("removed_by") == s).alias(f"{s}_removed") for s in STEPS],
        F.count_if(F.col("removed_by").isNull()).alias("final_count"))
    return judged.filter("removed_by IS NULL").drop("removed_by"), stats


def image_quality_report(metrics: DataFrame) -> DataFrame:
    """Counts and averages, one row; duplicates are counted before any filter."""
    per_hash = metrics.groupBy("image_hash").agg(
        F.count("*").alias("n"), F.count_if("is_corrupted").alias("bad"),
        *[F.sum(m).alias(m) for m in ("file_size", "blur_score", "brightness", "contrast")],
        *[F.count(m).alias(f"n_{m}") for m in ("blur_score", "brightness", "contrast")])
    avg = lambda m: (F.sum(m) / F.sum(f"n_{m}")).alias(f"avg_{m}")
    return per_hash.agg(
        F.sum("n").alias("total_images"), F.sum("bad").alias("corrupted_images"), (F.sum("file_size") / F.sum("n")).alias("avg_file_size"),
        avg("blur_score"), avg("brightness"), avg("contrast"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_images"))


def shape_summary(metrics: DataFrame) -> DataFrame:
    return describe(metrics, ["resolution", "aspect_ratio"])


ENHANCED = "path string, height int, width int, channels int, data binary, file_size long, adjusted_brightness boolean, enhanced_contrast boolean, sharpened boolean, resized boolean, flattened boolean, failed boolean"


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Enhanced rows in frames of about OUT_BYTES of pixels: results are larger than what came in."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= OUT_BYTES:
            yield _frame(held)
            held, size = [], 0
    if held:
        yield _frame(held)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in ENHANCED.split(", ")]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})


def enhance_images(
    images: DataFrame, brightness: bool = True, contrast: bool = True, sharpen: bool = True, resize: tuple[int, int] | None = None,
    flatten_alpha: bool = True,
) -> DataFrame:
    """Chosen steps in fixed order; rows stay decoded pixels with a flag per applied step."""

    def enhanced(r) -> tuple:
        ok = r.height is not None and not pd.isna(r.height)
        a = px.to_array(r.data, int(r.height), int(r.width), int(r.channels)) if ok else None
        if a is None:
            return (r.path, None, None, None, None, r.file_size, False, False, False, False, False, True)
        alpha = a[:, :, 3:] if a.shape[2] == 4 else None
        rgb = a[:, :, :3]
        if brightness:
            rgb = px.blend(rgb * 0, rgb, px.brightness_factor(px.channel_stats(rgb)[0]))
        if contrast:
            flat = rgb * 0 + round(float(px.gray(rgb).mean()))
            rgb = px.blend(flat, rgb, px.contrast_factor(px.channel_stats(rgb)[1]))
        if sharpen:
            rgb = px.sharpen(rgb)
        merge = flatten_alpha and alpha is not None
        if merge:
            import numpy as np

            rgb = px.flatten_alpha(np.concatenate([rgb, alpha], axis=2))
        if resize:
            rgb = px.letterbox(rgb, resize[1], resize[0])
        out = px.to_bytes(rgb)
        return (r.path, rgb.shape[0], rgb.shape[1], 3, out, len(out), brightness, contrast, sharpen, bool(resize), merge, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _frames(enhanced(r) for r in pdf.itertuples(index=False))

    return images.select("path", "file_size", "height", "width", "channels", "data").mapInPandas(run, ENHANCED)


def enhancement_stats(enhanced: DataFrame) -> DataFrame:
    steps = ["adjusted_brightness", "enhanced_contrast", "sharpened", "resized", "flattened", "failed"]
    return enhanced.agg(F.count("*").alias("total_images"), *[F.count_if(s).alias(s) for s in steps])


def stem(col: str) -> Column:
    name = F.element_at(F.split(F.col(col), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def quality_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean changes, deviation reduction and shares of improved images, matched by file stem."""
    b = before.select(stem("path").alias("k"), *[F.col(m).alias(f"b_{m}") for m in ("brightness", "contrast", "blur_score")])
    a = after.select(stem("path").alias("k"), *[F.col(m).alias(f"a_{m}") for m in ("brightness", "contrast", "blur_score")])
    change = lambda m: (F.avg(f"a_{m}") - F.avg(f"b_{m}"))
    better = lambda m: F.avg((F.col(f"a_{m}") > F.col(f"b_{m}")).cast("double")) * 100
    return b.join(a, "k").agg(
        change("brightness").alias("avg_brightness_change"), change("contrast").alias("avg_contrast_change"), change("blur_score").alias("avg_blur_change"),
        (F.stddev_samp("b_brightness") - F.stddev_samp("a_brightness")).alias("brightness_std_reduction"),
        better("contrast").alias("contrast_improvement"), better("blur_score").alias("sharpness_improvement"))


def image_features(images: DataFrame) -> DataFrame:
    """(path, features): 37 values per decodable image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = px.to_array(r.data, int(r.height), int(r.width), int(r.channels))
                if a is not None:
                    rows.append((r.path, [float(v) for v in px.features(a)]))
            yield pd.DataFrame(rows, columns=["path", "features"])

    return images.filter("height > 0").select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, features array<double>")


def synthetic_quality_label(features: DataFrame) -> DataFrame:
    """Quality class from brightness, contrast and blur of the feature vector."""
    bright, contrast, blur = F.col("features")[36], F.col("features")[6], F.col("features")[35]
    score = (
        F.when((bright > 100) & (bright < 160), 2).when((bright > 80) & (bright < 180), 1).otherwise(0)
        + F.when(contrast > 60, 2).when(contrast > 40, 1).otherwise(0)
        + F.when(blur > 200, 2).when(blur > 100, 1).otherwise(0))
    label = F.when(score >= 5, "High_Quality").when(score >= 3, "Medium_Quality").when(score >= 1, "Low_Quality").otherwise("Poor_Quality")
    return features.withColumn("label", label)


def label_join(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, label): equal names first, else the first label whose name contains the file stem.

    The second step is an equi-join too: label names are cut into their substrings of the stem
    lengths that occur, so no pair is formed that does not match.
    """
    lab = labels.select(F.lower("name").alias("name"), "label", "_row_id")
    img = images.select("path", F.lower(stem("path")).alias("stem"))
    exact = lab.groupBy("name").agg(F.min_by("label", "_row_id").alias("label"), F.lit(True).alias("hit"))
    step1 = img.join(exact, F.col("stem") == F.col("name"), "left").select("path", "stem", "label", "hit")
    rest = step1.filter("hit IS NULL").select("path", "stem")
    # File names are short, so there are few distinct lengths.
    lengths = rest.select(F.length("stem").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    pieces = lab.join(F.broadcast(lengths)).selectExpr("label", "_row_id", "name", "explode(ns) AS n").filter("n > 0 AND n <= length(name)").selectExpr(
        "label", "_row_id", "explode(transform(sequence(1, length(name) - n + 1), i -> substring(name, i, n))) AS piece")
    wanted = rest.select("stem").distinct()
    first = pieces.join(wanted, F.col("piece") == F.col("stem"), "left_semi").groupBy("piece").agg(F.min_by("label", "_row_id").alias("label2"), F.lit(True).alias("hit2"))
    joined = step1.join(first, F.col("stem") == F.col("piece"), "left")
    picked = F.when(F.col("hit"), F.col("label")).when(F.col("hit2"), F.col("label2"))
    blank = picked.isNull() | (picked == "") | (F.lower(picked) == "nan")
    return joined.select("path", F.when(blank, "Unknown").otherwise(picked).alias("label"))


def sample_images(metrics: DataFrame, n: int = 9) -> DataFrame:
    return metrics.select("path").orderBy("path").limit(n)
