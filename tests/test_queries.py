"""Registered queries against DuckDB.

By default one small folder and a sample of every module; TESSELLA_ALL=1 runs all.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = """agg_average_precision eval_open_images eval_pascal_masks box_flip_rot keypoint_ops filter_groundtruth win_sequential_id
win_batch_shard join_cell_type_rules join_major_function join_point_in_region join_nearest_mask join_radius_self nms remove_close_centers
eval_coco connected_components background_open apply_unmix join_mutual_descriptor scan_voc_xml scan_label_map sink_coco_json hierarchy_expand
score_batches stream_eval stream_new_files""".split()
NAMES = list(QUERIES) if os.environ.get("TESSELLA_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
