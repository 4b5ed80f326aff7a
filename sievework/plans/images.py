"""Whole-folder image jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID
from sievework.operators import images as im
from sievework.operators import metrics, train
from sievework.operators.encode import label_codes, label_encode
from sievework.operators.ordering import ordered_index
from sievework.operators.rules import drop_rare_classes
from sievework.session import cut

MODELS = ["random_forest", "svm", "knn", "logistic_regression"]


@dataclass
class ImageRun:
    metrics: DataFrame
    report: DataFrame
    kept: DataFrame
    stats: DataFrame
    improvement: DataFrame | None


def process_images(images: DataFrame, enhance: bool = False, **limits) -> ImageRun:
    """Measure, report, clean and optionally enhance; measured rows are stored once."""
    measured = cut(im.analyze_images(images))
    kept, stats = im.clean_images(measured, **limits)
    gain = None
    if enhance:
        survivors = images.join(kept.select("path"), "path", "left_semi")
        gain = im.quality_improvement(kept, im.analyze_images(im.enhance_images(survivors)))
    return ImageRun(measured, im.image_quality_report(measured), kept, stats, gain)


def image_models(images: DataFrame, labels: DataFrame | None = None, models: list[str] | None = None, test: float = 0.25, seed: int = 42) -> DataFrame | None:
    """Metrics per model from the 37 features; labels come from the table or from the quality score."""
    feats = cut(im.image_features(images))
    labelled = im.synthetic_quality_label(feats) if labels is None else feats.join(im.label_join(images, labels), "path")
    flat = labelled.select("path", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(37)])
    rows = cut(ordered_index(drop_rare_classes(flat, "label"), [F.col("path")], ROW_ID))
    if rows.count() < 20:
        return None
    names = [f"x{i}" for i in range(37)]
    rows = label_encode(rows, "label", cut(label_codes(rows, "label")))
    data = cut(train.assemble(rows, names, "label"))
    a, b = train.scale_by_train(*train.stratified_split(data, "label", test, seed))
    return train.evaluate_models(a, b, models or MODELS, "classification")


def compare_image_sets(original: DataFrame, cleaned: DataFrame, **kw) -> DataFrame | None:
    a, b = image_models(original, **kw), image_models(cleaned, **kw)
    return metrics.compare_runs(a, b) if a is not None and b is not None else None
