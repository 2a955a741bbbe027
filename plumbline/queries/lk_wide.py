"""Linking and deciding over catalogs a hundred and two hundred times the governed one."""

from pyspark.sql import functions as F

from plumbline.operators import contract as C, linking as L, ranking as R
from plumbline.plans.governed import METRICS
from plumbline.queries import query
from plumbline.queries.ct import outcome, sql_outcome
from plumbline.queries.ct_wide import FAILED, WIDE, sql_decisions
from plumbline.queries.lk import score_sql
from plumbline.sources.catalog import METRIC_SCHEMA, Catalog, rows_of


def copies_of(factor) -> Catalog:
    """The catalog beside copies of its metrics that answer to "distractor i ...", and all dimensions of the wide one."""
    home = {m["metric_id"]: m for m in WIDE.metrics}
    out = list(METRICS)
    for i in range(1, factor):
        out += [dict(home[f"{m['metric_id']}_{i}"], metric_name=f"distractor {i} {m['metric_name']}", aliases=[f"distractor {i} {a}" for a in m["aliases"]]) for m in METRICS]
    return Catalog(**{**WIDE.__dict__, "metrics": out})


# One request in thirty asks for a copy, by its name and by a dimension of the same number.
ASKED = """SELECT request_id, CASE WHEN request_id % 30 = 0 THEN concat('distractor ', CAST(k AS STRING), ' ', nl_query, ' by region ', CAST(k AS STRING)) ELSE nl_query END AS nl_query
 FROM (SELECT request_id, nl_query, 1 + request_id % 97 AS k FROM @requests r0) w"""


def linked(t, catalog):
    """Requests with their best metric, empty without one."""
    asked = t.spread(ASKED)
    best = R.best_targets(asked, "request_id", "nl_query", L.field_rows(rows_of(t.spark, catalog.metrics, METRIC_SCHEMA), L.PANEL_WEIGHTS), 1)
    return asked.join(best.select("request_id", "metric_id"), "request_id", "left").withColumn("metric_id", F.coalesce("metric_id", F.lit("")))


def linked_sql(catalog):
    top = score_sql(L.PANEL_WEIGHTS, 5, 1, False, metrics=catalog.metrics, requests=f"({ASKED})")
    return f"""{top}, tp AS MATERIALIZED (SELECT request_id, arg_max(metric_id, (score, metric_id)) AS metric_id FROM sc GROUP BY 1),
 lr AS (SELECT request_id, nl_query, coalesce(metric_id, '') AS metric_id FROM ({ASKED}) a LEFT JOIN tp USING (request_id))"""


HUNDRED, TWO_HUNDRED = copies_of(100), copies_of(200)


@query("lk_catalog_hundred", f"WITH {linked_sql(HUNDRED)} SELECT request_id, metric_id FROM lr")
def _(t):
    return linked(t, HUNDRED).select("request_id", "metric_id")


@query("lk_catalog_decide", f"WITH {linked_sql(TWO_HUNDRED)}, {sql_decisions('SELECT * FROM lr')}, o AS ({sql_outcome(FAILED)}) SELECT * FROM o")
def _(t):
    return outcome(C.compile_requests(linked(t, TWO_HUNDRED), C.contract_of(t.spark, TWO_HUNDRED), TWO_HUNDRED))
