"""Registered queries against their SQL on the smallest tables.

The slow iterative ones are left to ``python tests/compare.py`` unless PIXLOOM_ALL is set.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "class_area_stats class_shares_outliers channel_stats masked_channel_stats dominant_class"
    " hsv_profile class_lch white_balance confusion iou_loss tiles augmentation_summary"
    " visit_ordinal visit_gaps cohort_stats validate_visits upsert_visits rename_plan"
    " pick_source quota random_batch dilate erode contour polygon_mask components oriented_boxes"
    " crop_windows smart_crop grow_patch error_rollup throughput recent_throughput"
    " custom_metrics controlled_rollup_batch geometric_drawn steps_reordered crop_first_variant"
    " jitter_and_blur marker_closeup white_region_closed mosaic_components edits_that_meet"
    " dense_round_trip trials_csv reference_whites histogram_of_range mask_lch_circular shuffled_order"
).split()
NAMES = list(entry.queries()) if os.environ.get("PIXLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, entry.queries()[name], sql, SF) is None
