"""Competing texts of one page: their names, parameters and the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.text import or_blank, quality_score, strip_ws, variant_slug


def _values(values: tuple) -> Column:
    return F.array(*(F.lit(v) for v in values))


def param_grid(pages: DataFrame, page_no: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every parameter set of every page, as rows, with its name.

    The grid is a fixed set of constant arrays, so each page is widened in
    place by ``explode``; nothing is joined or shuffled.
    """
    grid = pages.select(*keys, page_no)
    for name, values in (
        ("dpi", K.GRID_DPI),
        ("textline", K.GRID_TEXTLINE),
        ("det_thresh", K.GRID_DETECTION),
        ("box_thresh", K.GRID_BOX),
        ("prep", K.GRID_FILTERS),
    ):
        grid = grid.withColumn(name, F.explode(_values(values)))
    variant = F.concat(
        F.lit("page"), F.col(page_no).cast("string"),
        F.lit("_dpi"), F.col("dpi").cast("string"),
        F.lit("_textline"), F.col("textline").cast("int").cast("string"),
        F.lit("_td"), F.col("det_thresh").cast("string"),
        F.lit("_bt"), F.col("box_thresh").cast("string"),
        F.lit("_prep"), F.col("prep"),
    )
    return grid.withColumn("variant", variant)


def engine_variants(pages: DataFrame, page_no: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every engine setting of every page, with its file-name form."""
    setting = F.explode(_values(K.ENGINE_SETTINGS)).alias("setting")
    return pages.select(*keys, page_no, setting).withColumn("slug", variant_slug(F.col("setting")))


def candidate_parse(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Page number out of a candidate's file name; other files are left out."""
    page = F.regexp_extract(F.col(file_name), K.java_regex(K.PAGE_FILE), 1)
    return df.withColumn("page_no", page.try_cast("int")).where(F.col("page_no").isNotNull())


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Candidates worth keeping: blank recognitions are skipped."""
    return df.where(strip_ws(or_blank(F.col(text))) != "")


def best_candidate(df: DataFrame, group: list[str], variant: str, text: str) -> DataFrame:
    """The best-scored text per group; the first variant wins a tie.

    A best score of -1 or less gives blank text. Each task reduces its
    candidates before the shuffle, so a hot page costs no single task.
    """
    scored = df.select(*group, variant, text, quality_score(F.col(text)).alias("score"))
    best = scored.groupBy(*group).agg(
        F.min_by(
            F.struct(F.col(variant), F.col("score"), F.col(text)),
            F.struct(-F.col("score"), F.col(variant)),
        ).alias("best"),
        F.count("*").alias("n_candidates"),
    )
    won = F.col("best.score") > -1
    return best.select(
        *group,
        "n_candidates",
        F.when(won, F.col(f"best.{variant}").cast("string")).otherwise("").alias("best_variant"),
        F.col("best.score").alias("score"),
        F.when(won, F.col(f"best.{text}")).otherwise("").alias("best_text"),
    )
