"""Spark query vs its DuckDB twin on the smoke tables (fast subset)."""

import os
import sys

import duckdb
import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import rows_of  # noqa: E402

from ledgerlens.plans import ORACLE, QUERIES  # noqa: E402
from ledgerlens.sources.tables import TABLES  # noqa: E402

FAST = ["scan_txn", "numeric_coerce", "step_cutoffs", "step_split", "class_weights_balanced", "scale_params",
        "onehot_unseen", "stratified_split", "row_index", "hmac_tokens", "psi_intersect", "psi_counts",
        "positional_filter", "pr_curve", "best_f1_threshold", "best_f1_threshold_eval", "per_client_metrics",
        "macro_metrics", "rank_to_prob", "grad_sum", "fedavg_round", "dedup_updates", "round_summary",
        "pair_salts", "masked_sum", "topk_features", "mutual_info_binned", "mi_probe", "mutual_info_quantile", "bad_records",
        "positional_filter_files", "psi_semi_filter", "scoreboard", "alpha_search"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_every_sql_twin_runs(con, name):
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert len(cols) == len(set(cols))  # names are unique, so column-name matching is well defined
    res.fetchall()
