import importlib.util
import os

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NO_ORACLE = {"train_lr", "train_rf", "train_gbt", "train_iforest", "train_blend", "train_metrics", "fed_forest", "fed_ensemble", "fed_iforest", "fed_rounds_forest",
             "fedavg_rounds"}


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    df = load_entry().entry(spark)
    assert df.count() > 0 and "split" in df.columns


def test_contract_keys():
    m = load_entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    own = set(q) - set(m.LLM_QUERIES) - set(m.PIPELINE)
    assert own - set(o) == NO_ORACLE


def test_cheap_queries_run_on_smoke_data(spark):
    q = load_entry().queries()
    for name in ["step_split", "psi_intersect", "per_client_metrics", "grad_sum", "masked_sum", "dedup_updates"]:
        assert q[name](spark, SF_SMALL).count() >= 0
