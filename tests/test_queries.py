"""Some queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = "ensemble_weighted_max self_consistency_vote best_iou_replace smallest_region row_groups layout_render knn_vote calc_verifier jaccard_top1 parse_llm_json format_confidence candidate_dedup oracle_dedup type_sets align_exact_norm align_multiline refine_address oracle_iban oracle_document_id regex_candidates_date span_attributes feature_vector candidate_windows run_eval recall_chain recall_counts triage cross_check add_absent parse_candidates parse_script_output parse_programs page_training_rows chat_training_rows ocr_words html_cells cells_on_words parse_verdicts merge_pages script_rules hybrid_knn".split()


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(map(normal, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(normal(r[k]) for k in order) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
