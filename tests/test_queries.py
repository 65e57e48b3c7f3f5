"""Every query with SQL returns the SQL's rows, on the smallest tables; a sample of them here, all in the driver."""

import os

import duckdb
import pandas as pd
import pytest

import cambium.plans.extra_queries
import cambium.plans.flow_queries
import cambium.plans.mechanics_queries
import cambium.plans.series_queries
import cambium.plans.table_queries
import cambium.plans.topology_queries  # noqa: F401
from cambium.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "ag01_relation_summary", "flt01_conjunctive_gate", "hi01_hierarchy_level", "ag18_concentration", "wn01_04_rolling_medians", "wn09_fill_gaps", "wn12_true_runs", "wn19_enclosed_basins",
    "wn24_26_ranks", "jn09_nearest", "jn12_within_range", "jn13_pareto_front", "jn17_matched_candidates", "so03_top_fraction", "vx03_functional_prior", "vx05_channel_balance", "gr08_triangles",
    "gr09_chordless_quads", "hi15_ledger_replay", "hi18_ts13_agreement", "ts01_correlations", "me04_stress", "au05_ledger_audit", "sc05_composite_cost",
    "hi07_contextual_costs", "gr04_components", "gr07_harmonic_fill", "vx15_16_loop_holonomy", "jn16_ge02_interfaces", "ge02_degrees", "ge03_sweep", "ge03_confidence", "gr13_junctions", "ts02_bootstrap",
    "prj04_choose_columns", "sc07_completed_cost", "gr17_label_pieces", "vx08_13_whitened", "sc18_tail_flags",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(df: pd.DataFrame) -> list[tuple]:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{float(v):.9g}" if not isinstance(v, str) else v for v in row))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


def test_all_sql_parses(con):
    for name, sql in ORACLES.items():
        con.execute(f"EXPLAIN {sql}")
        assert name in QUERIES
