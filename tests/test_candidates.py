"""Candidates over a joined catalog: texts are worked out once per distinct text and domain, and only the winner is kept whole."""

import pytest

from plumbline.operators import contract as C
from plumbline.plans.governed import DIMENSIONS, METRICS, catalog
from plumbline.sources.catalog import Catalog

CAT = Catalog(**{**catalog().__dict__, "metrics": [dict(m, domain_id="retail" if m["metric_id"] == "units" else "other" if m["metric_id"] == "revenue" else None) for m in METRICS],
                 "dimensions": DIMENSIONS + [dict(dimension_id="shop", name="Shop Floor", aliases=["shop"], parent="region", grain_rank=1, sql="s_name", domain_id="retail")]})
ASKED = [(1, 1, "units by shop and region", "units"), (1, 2, "units by shop and region", "revenue"), (2, 1, "drop table", "units"), (2, 2, "drop table", "revenue"),
         (3, 1, "revenue by shop floor", "ghost"), (3, 2, "revenue by region", "revenue"), (4, 1, "", "revenue"), (5, 2, None, "units"), (None, 1, "revenue by shop", "revenue")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "case_key int, rank int, nl_query string, metric_id string").repartition(2)


def test_forms_choose_alike(spark, asked):
    contract = C.contract_of(spark, CAT)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    inline, joined = (rows(C.compile_candidates(asked, contract, CAT, "case_key", form=f)) for f in ("inline", "joined"))
    assert inline == joined and {(r[0], r[2]) for r in joined} == {(1, 2), (2, 1), (3, 2), (4, 1), (5, 2), (None, 1)}
    seen = C.compile_requests(asked, contract, CAT, form="joined").select("case_key", "rank", "decision.trace.checks.grain.requested").collect()
    assert {r[1]: sorted(r[2]) for r in seen if r[0] == 1} == {1: ["region", "shop"], 2: ["region"]}


def test_only_the_winner_is_kept_whole(spark, asked):
    best = C.compile_candidates(asked, C.contract_of(spark, CAT), CAT, "case_key", form="joined").select("case_key", "metric_id", "decision.action")
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "LogicalRDD [case_key" in line]
    assert "min_by" not in plan and len(whole) <= 3, (len(whole), plan[:3000])
