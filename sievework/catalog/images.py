"""Queries over images derived from whole tables.

tiles: every embedding as an 8x8 gray image. texts: every document's bytes as a gray image of 64
columns, the last row padded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.catalog.registry import query, table
from sievework.operators import images as im
from sievework.operators import metrics
from sievework.session import cut

# Variances of 64 integers are multiples of 1/4096, so blur compares as an exact integer.
PIXEL = "CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 0.6) / 1.2 * 255))) AS INT)"
TILES = """px AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 0.6) / 1.2 * 255))) AS INTEGER)) AS p FROM embeddings),
 cells AS (SELECT vec_id, CAST(i AS INTEGER) AS i, p[i + 1] AS v, p[CASE WHEN i // 8 = 0 THEN i + 8 ELSE i - 8 END + 1] + p[CASE WHEN i // 8 = 7 THEN i - 8 ELSE i + 8 END + 1] + p[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + p[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * p[i + 1] AS l FROM px, range(64) t(i)),
 m AS (SELECT vec_id, avg(v) AS brightness, stddev_pop(v) AS contrast, var_pop(l) AS blur FROM cells GROUP BY 1),
 h AS (SELECT vec_id, string_agg(CASE WHEN v > brightness THEN '1' ELSE '0' END, '' ORDER BY i) AS image_hash FROM cells JOIN m USING (vec_id) GROUP BY 1)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.selectExpr(
        "concat('tile/v', vec_id, '.png') AS path", "256L AS file_size", "8 AS height", "8 AS width", "1 AS channels",
        f"unhex(array_join(transform(embedding, x -> lpad(hex({PIXEL}), 2, '0')), '')) AS data")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS b").selectExpr("doc_id", "b", "CAST(ceil(octet_length(b) / 64) AS INT) AS height")
    return d.selectExpr(
        "concat('text/d', doc_id, '.png') AS path", "CAST(octet_length(b) AS LONG) AS file_size", "height", "64 AS width", "1 AS channels",
        "rpad(b, height * 64, X'00') AS data")


def tile_metrics(spark, sf) -> DataFrame:
    return im.analyze_images(tiles(spark, sf))


NAME = "'v' || vec_id || '.png'"


@query("v1_image_properties", "SELECT 'd' || doc_id || '.png' AS filename, 64 AS width, CAST(ceil(octet_length(encode(text)) / 64.0) AS INTEGER) AS height, octet_length(encode(text)) AS file_size, round(64.0 / ceil(octet_length(encode(text)) / 64.0), 6) AS aspect_ratio, CAST(64 * ceil(octet_length(encode(text)) / 64.0) AS BIGINT) AS resolution FROM documents")
def v1(spark, sf):
    return im.analyze_images(texts(spark, sf)).selectExpr("filename", "width", "height", "file_size", "round(aspect_ratio, 6) AS aspect_ratio", "resolution")


@query("v2_blur_score", f"WITH {TILES} SELECT {NAME} AS filename, CAST(round(blur * 4096) AS BIGINT) AS blur_4096 FROM m")
def v2(spark, sf):
    return tile_metrics(spark, sf).selectExpr("filename", "CAST(round(blur_score * 4096) AS LONG) AS blur_4096")


@query("v3_brightness", f"WITH {TILES} SELECT {NAME} AS filename, round(brightness, 4) AS brightness FROM m")
def v3(spark, sf):
    return tile_metrics(spark, sf).selectExpr("filename", "round(brightness, 4) AS brightness")


@query("v4_contrast", f"WITH {TILES} SELECT {NAME} AS filename, round(contrast, 4) AS contrast FROM m")
def v4(spark, sf):
    return tile_metrics(spark, sf).selectExpr("filename", "round(contrast, 4) AS contrast")


@query("v5_corruption_flags", """SELECT 'd' || doc_id || '.png' AS filename, octet_length(encode(text)) < 100 AS small_file, 64.0 / ceil(octet_length(encode(text)) / 64.0) < 0.01 AS extreme_aspect FROM documents""")
def v5(spark, sf):
    m = im.analyze_images(texts(spark, sf))
    return m.selectExpr("filename", "array_contains(corruption_reasons, 'small_file') AS small_file", "array_contains(corruption_reasons, 'extreme_aspect') AS extreme_aspect")


@query("v6_average_hash", f"WITH {TILES} SELECT {NAME} AS filename, image_hash FROM h")
def v6(spark, sf):
    return tile_metrics(spark, sf).select("filename", "image_hash")


@query("v7_analyze_images", f"WITH {TILES} SELECT {NAME} AS filename, 8 AS width, 8 AS height, 64 AS resolution, round(brightness, 4) AS brightness, round(contrast, 4) AS contrast, CAST(round(blur * 4096) AS BIGINT) AS blur_4096, image_hash, false AS is_corrupted FROM m JOIN h USING (vec_id)")
def v7(spark, sf):
    return tile_metrics(spark, sf).selectExpr("filename", "width", "height", "resolution", "round(brightness, 4) AS brightness", "round(contrast, 4) AS contrast", "CAST(round(blur_score * 4096) AS LONG) AS blur_4096", "image_hash", "is_corrupted")


LIMITS = {"min_resolution": 16, "min_blur": 12000, "min_brightness": 124, "max_brightness": 131, "min_contrast": 25}


@query("v8_clean_images", f"""WITH {TILES}, j AS (SELECT vec_id, image_hash, CASE WHEN blur < 12000 THEN 'blurry' WHEN brightness < 124 OR brightness > 131 THEN 'brightness' WHEN contrast < 25 THEN 'contrast' END AS r FROM m JOIN h USING (vec_id)),
 d AS (SELECT count(*) - count(DISTINCT image_hash) AS dup FROM j WHERE r IS NULL)
 SELECT count(*) AS initial_count, 0 AS corrupted_removed, 0 AS low_resolution_removed, 0 AS high_resolution_removed, count(*) FILTER (r = 'blurry') AS blurry_removed, count(*) FILTER (r = 'brightness') AS brightness_issues_removed,
 count(*) FILTER (r = 'contrast') AS low_contrast_removed, (SELECT dup FROM d) AS duplicates_removed, count(*) FILTER (r IS NULL) - (SELECT dup FROM d) AS final_count FROM j""")
def v8(spark, sf):
    return im.clean_images(tile_metrics(spark, sf), **LIMITS)[1]


@query("v9_image_quality_report", f"WITH {TILES} SELECT count(*) AS total_images, 0 AS corrupted_images, 256.0::DOUBLE AS avg_file_size, round(avg(blur), 4) AS avg_blur_score, round(avg(brightness), 4) AS avg_brightness, round(avg(contrast), 4) AS avg_contrast, count(*) - count(DISTINCT image_hash) AS duplicate_images FROM m JOIN h USING (vec_id)")
def v9(spark, sf):
    r = im.image_quality_report(tile_metrics(spark, sf))
    return r.selectExpr("total_images", "corrupted_images", "avg_file_size", "round(avg_blur_score, 4) AS avg_blur_score", "round(avg_brightness, 4) AS avg_brightness", "round(avg_contrast, 4) AS avg_contrast", "duplicate_images")


@query("v10_adjust_brightness", f"""WITH {TILES}, f AS (SELECT vec_id, CASE WHEN brightness < 50 THEN 1.3 WHEN brightness > 200 THEN 0.8 ELSE greatest(0.7, least(1.5, 128 / brightness)) END AS f FROM m)
 SELECT {NAME} AS filename, round(avg(least(255, round_even(v * f, 0))), 2) AS brightness FROM cells JOIN f USING (vec_id) GROUP BY 1""")
def v10(spark, sf):
    e = im.enhance_images(tiles(spark, sf), True, False, False)
    return im.analyze_images(e).selectExpr("filename", "round(brightness, 2) AS brightness")


@query("v11_enhance_contrast")
def v11(spark, sf):
    e = im.enhance_images(tiles(spark, sf), False, True, False)
    return im.analyze_images(e).selectExpr("filename", "contrast")


@query("v12_sharpen")
def v12(spark, sf):
    e = im.enhance_images(texts(spark, sf), False, False, True)
    return im.analyze_images(e).selectExpr("filename", "blur_score")


@query("v13_letterbox_resize", "SELECT 'd' || doc_id || '.png' AS filename, 224 AS width, 224 AS height FROM documents WHERE length(text) > 0")
def v13(spark, sf):
    e = im.enhance_images(texts(spark, sf), False, False, False, (224, 224))
    return im.analyze_images(e).select("filename", "width", "height")


@query("v15_enhance_images", "SELECT count(*) AS total_images, count(*) AS adjusted_brightness, count(*) AS enhanced_contrast, count(*) AS sharpened, count(*) AS resized, 0 AS flattened, 0 AS failed FROM embeddings")
def v15(spark, sf):
    return im.enhancement_stats(im.enhance_images(tiles(spark, sf), True, True, True, (32, 32)))


@query("v16_quality_improvement")
def v16(spark, sf):
    t = tiles(spark, sf)
    return im.quality_improvement(im.analyze_images(t), im.analyze_images(im.enhance_images(t)))


@query("v17_image_features", "SELECT 'text/d' || doc_id || '.png' AS path, 37 AS dims FROM documents WHERE length(text) > 0")
def v17(spark, sf):
    return im.image_features(texts(spark, sf)).selectExpr("path", "size(features) AS dims")


@query("v18_synthetic_quality_label")
def v18(spark, sf):
    return im.synthetic_quality_label(im.image_features(texts(spark, sf))).groupBy("label").agg(F.count("*").alias("n"))


@query("v19_label_join", """WITH lab AS (SELECT 'd' || doc_id AS name, CASE WHEN toxic = 1 THEN '' ELSE 'q' || quality END AS label, doc_id FROM labels),
 img AS (SELECT 'text/d' || doc_id || '.png' AS path, 'd' || doc_id AS stem FROM documents),
 pick AS (SELECT path, coalesce((SELECT arg_min(label, doc_id) FROM lab WHERE name = stem), (SELECT arg_min(label, doc_id) FROM lab WHERE contains(name, stem))) AS label FROM img)
 SELECT path, CASE WHEN label IS NULL OR label = '' THEN 'Unknown' ELSE label END AS label FROM pick""")
def v19(spark, sf):
    lab = table(spark, sf, "labels").selectExpr("concat('D', doc_id) AS name", "IF(toxic = 1, '', concat('q', quality)) AS label", "doc_id AS _row_id")
    imgs = table(spark, sf, "documents").selectExpr("concat('text/d', doc_id, '.png') AS path")
    return im.label_join(imgs, lab)


@query("v21_histogram", f"""WITH {TILES}, r AS (SELECT min(brightness) AS lo, (max(brightness) - min(brightness)) / 30 AS w FROM m), b AS (SELECT CAST(least(29, floor((brightness - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM m, r GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(30) t(i) LEFT JOIN b ON b.bin = i""")
def v21(spark, sf):
    return metrics.histogram(cut(tile_metrics(spark, sf).select("brightness")), "brightness", 30).select("bin", "n")


@query("v22_sample_images", "SELECT path FROM (SELECT 'text/d' || doc_id || '.png' AS path FROM documents) ORDER BY 1 LIMIT 9")
def v22(spark, sf):
    return im.sample_images(texts(spark, sf))
