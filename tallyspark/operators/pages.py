"""Page-level facts: OCR rollup, complexity, engine choice, document kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.values import half_up

# ---- fixed values -----------------------------------------------------------
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
LOW_CONFIDENCE = {"TESSERACT": 60.0, "PADDLEOCR": 0.70}
VISION = "OPENAI_VISION_LLM"
LEVELS = [(40, "SIMPLE"), (60, "MEDIUM"), (80, "HIGH")]
HIGHEST_LEVEL = "VERY_HIGH"
# measured feature: (limit, points beyond it, reason), the first that applies
LINE_COUNT = [(6, 20.0, "complex_table_structure"), (2, 10.0, "simple_table_structure")]
DARK_RATIO = [(0.15, 15.0, "high_text_density"), (0.08, 8.0, "medium_text_density")]
SHARPNESS_BELOW = [(100, 20.0, "possible_handwriting_or_low_quality"), (300, 10.0, "moderate_image_quality")]
REGION_COUNT = [(200, 20.0, "many_distinct_regions"), (80, 10.0, "moderate_regions")]
COLUMN_GAPS = (1, 15.0, 3, "multi_column_layout")
SMALL_PAGE = (800, 600, 10.0, "low_resolution")
UNREADABLE_PAGE = (20.0, "unreadable_page")
MOST_POINTS = 100.0
SA_KEYWORDS = [
    "SHIPPING AUTHORIZATION", "DELIVERY RELEASE", "PLANNING RELEASE", "MATERIAL RELEASE", "STD PACK",
    "SUPPLIER CODE", "DELIVERY DATE", "SHIP DATE",
]
SO_KEYWORDS = [
    "PURCHASE ORDER", "SALES ORDER", "UNIT COST", "UNIT PRICE", "EXT'D COST", "EXTENDED", "BILL TO", "SHIP VIA",
    "FREIGHT TERMS",
]
# -----------------------------------------------------------------------------


def ocr_rollup(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Recognised items to documents: words, mean confidence, the low flag; documents without items have no confidence.

    ``items``: doc_id, page, text, conf. ``documents``: doc_id, engine. Tesseract gives words with a confidence of 0 to
    100, of which those at 0 or below do not count; PaddleOCR gives lines of any number of words, from 0 to 1.
    """
    by_line = F.col("engine") == "PADDLEOCR"
    said = F.trim("text") != ""
    whole = F.when(~by_line, F.col("conf").cast("int"))
    counts = said & (by_line | (whole > 0))
    in_line = F.size(F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != ""))
    per_doc = items.join(documents.select("doc_id", "engine"), "doc_id").groupBy("doc_id").agg(
        F.sum(F.when(counts, F.when(by_line, in_line).otherwise(1)).otherwise(0)).alias("word_count"), F.count_if(counts).alias("_items"),
        F.sum(F.when(counts, F.coalesce(whole.cast("double"), "conf"))).alias("_sum"), F.count_distinct("page").alias("pages"))
    joined = documents.select("doc_id", "engine").join(per_doc, "doc_id", "left")
    confidence = F.when(F.col("_items") > 0, F.col("_sum") / F.col("_items")).otherwise(0.0)
    limit = F.when(by_line, LOW_CONFIDENCE["PADDLEOCR"]).otherwise(LOW_CONFIDENCE["TESSERACT"])
    return joined.select("doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("word_count", F.lit(0)).alias("word_count"),
                         confidence.alias("confidence"), (confidence < limit).alias("low_confidence"))


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts of each document in page order."""
    return pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_pages")).select(
            "doc_id", F.array_join("_pages.text", PAGE_BREAK).alias("text"))


def chosen_attempt(attempts: DataFrame) -> DataFrame:
    """The first attempt that is confident enough, else the last one.

    ``attempts``: doc_id, attempt, engine, confidence.
    """
    limit = F.when(F.col("engine") == "TESSERACT", LOW_CONFIDENCE["TESSERACT"]).otherwise(LOW_CONFIDENCE["PADDLEOCR"])
    low = F.col("confidence") < limit
    row = F.struct("attempt", "engine", "confidence", low.alias("low_confidence"))
    return (attempts.groupBy("doc_id")
            .agg(F.min_by(row, F.when(~low, F.col("attempt"))).alias("good"), F.max_by(row, "attempt").alias("last"))
            .select("doc_id", F.coalesce("good", "last").alias("r")).select("doc_id", "r.*"))


def engine_choice(must_use_llm: Column, score: Column) -> Column:
    return F.when(must_use_llm, VISION).when(F.coalesce(score, F.lit(50.0)) <= 60, "TESSERACT").otherwise(VISION)


def processing_mode(engine: Column, low_confidence: Column, text: Column, score: Column) -> Column:
    unusable = low_confidence | (F.trim(F.coalesce(text, F.lit(""))) == "")
    return (F.when((engine == VISION) | unusable, "DIRECT_LLM")
            .when(F.coalesce(score, F.lit(0.0)) > 40, "OCR_THEN_LLM_WITH_VISION").otherwise("OCR_THEN_LLM"))


def vision_retry_candidates(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("status") == "INVALID") & (F.col("engine") != VISION))


def level(score: Column) -> Column:
    named = F.lit(HIGHEST_LEVEL)
    for limit, name in reversed(LEVELS):
        named = F.when(score <= limit, name).otherwise(named)
    return named


def page_scores(features: DataFrame) -> DataFrame:
    """Score and reason tags of each page from its measured features; null width means unreadable."""
    def graded(steps: list[tuple[float, float, str]], beyond) -> tuple[Column, Column]:
        points, tag = F.lit(0.0), F.lit(None).cast("string")
        for limit, worth, name in reversed(steps):
            points = F.when(beyond(limit), worth).otherwise(points)
            tag = F.when(beyond(limit), name).otherwise(tag)
        return points, tag

    gaps, (few, worth, most, columns) = F.col("gap_regions"), COLUMN_GAPS
    width, height, size_worth, small = SMALL_PAGE
    parts = [
        graded(LINE_COUNT, lambda x: F.col("line_count") > x),
        graded(DARK_RATIO, lambda x: F.col("dark_ratio") > x),
        (F.when(gaps > few, worth * F.least(gaps / most, F.lit(1.0))).otherwise(0.0), F.when(gaps > few, columns)),
        graded(SHARPNESS_BELOW, lambda x: F.col("laplacian_var") < x),
        graded(REGION_COUNT, lambda x: F.col("region_count") > x),
        graded([(width, size_worth, small)], lambda x: (F.col("width") < x) | (F.col("height") < height)),
    ]
    score = F.least(sum((p for p, _ in parts[1:]), parts[0][0]), F.lit(MOST_POINTS))
    readable = F.col("width").isNotNull()
    return features.select(
        "doc_id", "page", F.when(readable, score).otherwise(UNREADABLE_PAGE[0]).alias("score"),
        F.when(readable, F.array_compact(F.array(*[t for _, t in parts])))
        .otherwise(F.array(F.lit(UNREADABLE_PAGE[1]))).alias("reasons"))


def document_complexity(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean page score to one decimal, its level, and the distinct reasons; no pages score 0."""
    means = scores.groupBy("doc_id").agg(F.avg("score").alias("mean"))
    reasons = (scores.select("doc_id", F.explode("reasons").alias("reason"))
               .groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
    mean = F.coalesce("mean", F.lit(0.0))
    return (documents.select("doc_id").join(means, "doc_id", "left").join(reasons, "doc_id", "left")
            .select("doc_id", (half_up(mean * 10) / 10).alias("score"), level(mean).alias("level"),
                    F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")))


def document_kind(text: Column) -> tuple[Column, Column]:
    """(kind, confidence) by keyword counts; a tie is UNKNOWN."""
    upper = F.upper(F.coalesce(text, F.lit("")))

    def hits(words: list[str]) -> Column:
        return sum((upper.contains(w).cast("int") for w in words[1:]), upper.contains(words[0]).cast("int"))

    release = hits(SA_KEYWORDS) + upper.rlike("\\bW[0-9]{1,2}\\b").cast("int")
    order = hits(SO_KEYWORDS)
    return (F.when(release > order, "SA").when(order > release, "SO").otherwise("UNKNOWN"),
            F.when(release == order, 0.0).otherwise(0.4))
