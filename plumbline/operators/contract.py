"""Contract checks: is a candidate plan justified by the governed catalog?

Metric-side evidence is joined and aggregated over catalogs of any size. What a request's dimensions amount to comes
from `dimensions`: as column expressions for a small catalog, so that deciding a request is one broadcast join and a
projection, and through joins for a catalog of any size.
"""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X
from plumbline.operators import dimensions as D, filters as P, scale
from plumbline.operators.dimensions import gather, in_domain
from plumbline.sources.catalog import Catalog

# The check families in the order failures are reported.
FAMILIES = ("field", "caliber", "grain", "coverage", "time", "policy")
# Words that open the grouping part of a request.
MARKERS = ("grouped by ", "group by ", " by ", " per ", " across ", "grouping=")

STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, no_strings())


def set_of(c) -> Column:
    return F.sort_array(F.array_distinct(c))


# --- requests -----------------------------------------------------------------------------------


def after(text, marker) -> Column:
    """Text after the first occurrence of a marker, null when it is absent or nothing follows."""
    tail = F.substring(text, F.locate(marker, text) + len(marker), F.length(text))
    return F.when(text.contains(marker) & (tail != ""), tail)


def grouping_scope(q: Column) -> Column:
    """Part of a normalised request that names dimensions; empty when it names none."""
    by_marker = F.lit(None).cast("string")
    for m in reversed(MARKERS):
        by_marker = F.when(q.contains(m), after(q, m)).otherwise(by_marker)
    head = F.when(q.contains("breakdown for") & ~q.startswith("breakdown for"), F.substring(q, F.lit(1), F.locate("breakdown for", q) - 1))
    whole = F.when(P.contains_any(q, ["monthly", "quarterly", "valid time anchor", "with the valid time"]), q)
    scope = F.coalesce(by_marker, after(q, "按"), head, whole)
    words = F.concat(
        scope, F.when(q.contains("monthly"), " monthly month").otherwise(""), F.when(q.contains("quarterly"), " quarterly quarter").otherwise("")
    )
    return F.coalesce(words, F.lit(""))


def with_scope(df: DataFrame, text="nl_query") -> DataFrame:
    """Add the normalised text `_q` and its grouping part `_scope`, each computed once."""
    scoped = df.withColumn("_q", X.normalize(F.col(text))).withColumn("_scope", grouping_scope(F.col("_q")))
    return scale.fenced(scoped, "_q", "_scope")


def detect_dimensions(scope: Column, catalog: Catalog, domain=None) -> Column:
    """Dimensions of a small catalog named in a grouping part, by grain rank and id."""
    return in_domain(D.found_inline(scope, catalog), domain)


def finest(requested: Column, catalog: Catalog) -> Column:
    """Requested dimensions of a small catalog that are no ancestor of another one, in request order."""
    return D.set_inline(requested, catalog)["_resolved"]


def detect_time(q: Column, profile) -> Column:
    """First profile anchor with a matching alias, else a 20xx year, else the default anchor."""
    found = [F.when(X.contains_any_alias(q, aliases), F.lit(anchor)) for anchor, aliases in (profile.get("time_aliases") or {}).items()]
    year = X.year_of(q)
    return F.coalesce(*found, F.when(year != "", year), F.lit(profile.get("default_time_anchor") or ""))


def policy_cases(q: Column, metric_id, known, answerable, catalog: Catalog) -> list:
    """(condition, struct(policy_id, trigger)) of every reason to refuse; released triggers lose their outer blanks."""
    row = lambda p, t: F.struct(F.lit(p).alias("policy_id"), (t if isinstance(t, Column) else F.lit(t)).alias("trigger"))
    hits = [(~known, row("no_governed_metric", "empty_metric_candidate")), (known & ~F.coalesce(answerable, F.lit(True)), row("unsupported_metric", metric_id))]
    norm = lambda s: " ".join(str(s or "").lower().split())
    for p in catalog.policies:
        pid = p.get("policy_id") or "policy"
        phrases = [norm(a) for a in p.get("ambiguous_queries") or []]
        if phrases:
            hits.append((q.isin(*phrases), row(pid, "ambiguous_query")))
        hits += [(q.contains(norm(t)), row(pid, t)) for t in p.get("refusal_triggers") or []]
        hits += [(q.contains(t), row(pid, t)) for t in P.expand_trigger(p.get("trigger") or "")]
    for r in catalog.profile.get("policy_rules") or []:
        if r.get("contains"):
            hits.append((P.contains_any(q, [norm(t) for t in r["contains"]]), row(r["policy_id"], "contains")))
        if r.get("exact"):
            hits.append((q.isin(*[norm(t) for t in r["exact"]]), row(r["policy_id"], "exact")))
    return hits


# --- metrics ------------------------------------------------------------------------------------


def dependency_evidence(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Numerator and denominator evidence of every metric, and where it was found."""
    own = edges.filter(
        F.col("edge_type").isin("numerator_of", "denominator_of") & (F.coalesce("metric_id", "dst") == F.col("dst")) & (F.coalesce("src", F.lit("")) != "")
    )
    side = lambda kind: F.collect_set(F.when(F.col("edge_type") == kind, F.col("src")))
    found = own.groupBy(F.col("dst").alias("metric_id")).agg(side("numerator_of").alias("_num"), side("denominator_of").alias("_den"))
    m = metrics.join(found, "metric_id", "left")

    formula = F.coalesce("formula", F.lit(""))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ratio = (
        F.coalesce("scoped_ratio", F.lit(False))
        | ~F.coalesce("scoped_ratio_kind", F.lit("")).isin("", "none")
        | F.coalesce("metric_type", F.lit("")).isin("ratio", "rate", "ratio_caliber")
        | formula.contains("/") | has("numerator") | has("denominator")
    )
    want_num, want_den = set_of(or_empty("numerator_nodes")), set_of(or_empty("denominator_nodes"))
    explicit = (F.size(want_num) > 0) | (F.size(want_den) > 0)
    parts = F.split(formula, "/", 2)
    first = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    by_text = lambda c, i: first(X.identifiers(F.col(c)), F.when(formula.contains("/"), X.identifiers(F.get(parts, F.lit(i)))).otherwise(no_strings()))
    num_text, den_text = by_text("numerator", 0), by_text("denominator", 1)
    num_edge, den_edge = set_of(or_empty("_num")), set_of(or_empty("_den"))
    by_formula = (F.size(num_text) > 0) & (F.size(den_text) > 0)
    pick = lambda want, text, edge: F.when(~ratio, no_strings()).when(explicit, F.array_intersect(edge, want)).otherwise(first(text, edge))
    return m.select(
        *metrics.columns,
        ratio.alias("ratio_like"),
        pick(want_num, num_text, num_edge).alias("found_numerator"),
        pick(want_den, den_text, den_edge).alias("found_denominator"),
        F.when(ratio & explicit, want_num).otherwise(no_strings()).alias("required_numerator"),
        F.when(ratio & explicit, want_den).otherwise(no_strings()).alias("required_denominator"),
        F.when(~ratio, "not_required").when(~explicit & by_formula, "metric_formula").otherwise("metric_specific_typed_graph_edges").alias("route_source"),
    )


def caliber_passed() -> Column:
    """Over dependency_evidence: both sides are present and hold what is required."""
    whole = lambda need, have: F.size(F.array_except(need, have)) == 0
    return ~F.col("ratio_like") | (
        (F.size("found_numerator") > 0) & (F.size("found_denominator") > 0)
        & whole("required_numerator", "found_numerator") & whole("required_denominator", "found_denominator")
    )


def metric_fields(stop=tuple(X.SQL_WORDS)) -> Column:
    """Identifiers the three expressions of a metric read."""
    return set_of(F.flatten(F.array(*[X.identifiers(F.col(c), stop) for c in ("formula", "numerator", "denominator")])))


COVERAGE = ["active", "passed", "mode", "required", "missing_bindings", "missing_physical_assets", "missing"]


def coverage_binding(metrics: DataFrame, bindings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every required node of a metric is bound by that metric to a physical asset that exists."""
    assets = coverage.select(F.col("semantic_node_id").alias("physical_node_id")).distinct().withColumn("_real", F.lit(True))
    bound = bindings.join(assets, "physical_node_id", "left").groupBy("metric_id", F.col("dependency_node_id").alias("node")).agg(
        F.collect_set(F.when(F.col("_real").isNull(), F.coalesce("physical_node_id", F.lit("")))).alias("_lost")
    )
    nodes = metrics.select("metric_id", F.explode(F.array_distinct(or_empty("coverage_nodes"))).alias("node"))
    lost = nodes.join(bound, ["metric_id", "node"], "left").groupBy("metric_id").agg(
        F.collect_set(F.when(F.col("_lost").isNull(), F.col("node"))).alias("_unbound"), F.flatten(F.collect_list("_lost")).alias("_unreal")
    )
    required = set_of(or_empty("coverage_nodes"))
    active = F.coalesce("coverage_required", F.lit(False)) | (F.size(required) > 0)
    unbound, unreal = set_of(or_empty("_unbound")), set_of(or_empty("_unreal"))
    ok = (F.size(required) > 0) & (F.size(unbound) == 0) & (F.size(unreal) == 0)
    return metrics.join(lost, "metric_id", "left").select(
        *metrics.columns, active.alias("active"), (~active | ok).alias("passed"),
        F.when(active, "metric_specific_semantic_to_physical_binding").otherwise("not_required_by_metric_contract").alias("mode"),
        required.alias("required"), unbound.alias("missing_bindings"), unreal.alias("missing_physical_assets"),
        set_of(F.array_union(unbound, unreal)).alias("missing"),
    )


def coverage_domain(metrics: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every required node of a metric is covered in the metric's domain; a metric without one sees all rows."""
    nodes = metrics.select("metric_id", F.coalesce("domain_id", F.lit("")).alias("domain_id"), F.explode(F.array_distinct(or_empty("coverage_nodes"))).alias("node"))
    in_domain = coverage.select("domain_id", F.col("semantic_node_id").alias("node"))
    have = in_domain.union(in_domain.select(F.lit("").alias("domain_id"), "node")).distinct().withColumn("_ok", F.lit(True))
    lost = nodes.join(have, ["domain_id", "node"], "left").groupBy("metric_id").agg(F.collect_set(F.when(F.col("_ok").isNull(), F.col("node"))).alias("_lost"))
    required, lost_nodes = set_of(or_empty("coverage_nodes")), set_of(or_empty("_lost"))
    active = F.size(required) > 0
    return metrics.join(lost, "metric_id", "left").select(
        *metrics.columns, active.alias("active"), (~active | (F.size(lost_nodes) == 0)).alias("passed"),
        F.when(active, "released_semantic_to_physical_coverage").otherwise("no_metric_specific_coverage_requirement").alias("mode"),
        required.alias("required"), no_strings().alias("missing_bindings"), no_strings().alias("missing_physical_assets"), lost_nodes.alias("missing"),
    )


def patch_metrics(metrics: DataFrame, patch: DataFrame) -> DataFrame:
    """Override fields of known metrics; a null in the patch keeps the released value."""
    fields = [c for c in patch.columns if c != "metric_id"]
    p = patch.select("metric_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return metrics.join(p, "metric_id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in metrics.columns]
    )


def metric_contract(metrics: DataFrame, edges: DataFrame, bindings=None, coverage=None, stop=tuple(X.SQL_WORDS)) -> DataFrame:
    """One row per metric with all that deciding a request needs to know about it.

    Metric bindings take precedence over domain coverage; without either the coverage column says so.
    """
    m = dependency_evidence(metrics, edges)
    if bindings is not None:
        m = coverage_binding(m, bindings, coverage)
    elif coverage is not None:
        m = coverage_domain(m, coverage)
    else:
        m = m.select(
            "*", F.lit(False).alias("active"), F.lit(True).alias("passed"), F.lit("not_available_in_released_contract").alias("mode"), no_strings().alias("required"),
            no_strings().alias("missing_bindings"), no_strings().alias("missing_physical_assets"), no_strings().alias("missing"),
        )
    return m.select(
        "metric_id",
        F.struct(
            F.lit(True).alias("known"), "answerable", or_empty("allowed_dimensions").alias("allowed"), metric_fields(stop).alias("fields"),
            F.coalesce("temporal_anchor_required", F.lit(False)).alias("temporal"), F.coalesce("domain_id", F.lit("")).alias("domain"),
            F.struct(F.lit(True).alias("active"), caliber_passed().alias("passed"), "ratio_like", "found_numerator", "found_denominator", "required_numerator", "required_denominator", "route_source").alias("caliber"),
            F.struct(*COVERAGE).alias("coverage"),
        ).alias("contract"),
    )


def contract_of(spark, catalog: Catalog) -> DataFrame:
    """metric_contract of a bounded catalog."""
    return metric_contract(
        catalog.metric_rows(spark), catalog.edge_rows(spark),
        catalog.binding_rows(spark) if catalog.bindings else None,
        catalog.coverage_rows(spark) if catalog.coverage or catalog.bindings else None,
        tuple(X.SQL_WORDS + catalog.extra_sql_words),
    )


# --- decisions ----------------------------------------------------------------------------------


def compile_requests(requests: DataFrame, contract: DataFrame, catalog: Catalog, disabled=(), columns_left="coverage_remove", form="auto", keep=()) -> DataFrame:
    """Add `decision`: a witness or a typed refusal for each (nl_query, metric_id) row.

    Optional request columns: `requested` replaces the detected dimensions, `time_binding` the detected anchor,
    `coverage_remove` lists schema columns to take away for that request, `coverage_override` the columns that cover it
    (null: as released), `candidate_metrics` goes into the trace. `form` as in `dimensions`; `keep` adds columns of what
    was joined ("_known", "_allowed", "_unknown", "_above").
    """
    has = set(requests.columns)
    by_schema = bool(catalog.schema_columns)
    have = X.lit_list([s.lower() for s in catalog.schema_columns])
    j = with_scope(requests.join(contract, "metric_id", "left"))
    c = lambda name: F.col(f"contract.{name}")
    j = j.select("*", F.coalesce(c("known"), F.lit(False)).alias("_known"), or_empty(c("allowed")).alias("_allowed"))
    known, allowed = F.col("_known"), F.col("_allowed")
    given = "requested" in has
    if given or D.inline(catalog, form):
        j = D.with_found(j, "_scope", catalog, form)
        # below the lambdas that read it, which are not compiled; given dimensions may need none of it
        j = j if given else scale.fenced(j, "_found")
        detected = in_domain(F.col("_found"), c("domain"))
        j = j.select("*", (F.coalesce(F.col("requested"), detected) if given else detected).alias("_requested"))
        j = D.with_sets(j, "_requested", catalog, form)
    else:
        j = D.with_named(j.select("*", F.coalesce(c("domain"), F.lit("")).alias("_domain")), "_scope", "_domain", catalog)
    q, requested = F.col("_q"), F.col("_requested")
    anchor = detect_time(q, catalog.profile)
    j = j.select("*", (F.coalesce(F.col("time_binding"), anchor) if "time_binding" in has else anchor).alias("_time"))
    resolved, bound = F.col("_resolved"), F.col("_time")

    barred = F.when(F.size(allowed) == 0, no_strings()).otherwise(F.array_except(resolved, allowed))
    required = set_of(F.array_union(or_empty(c("fields")), F.col("_dim_fields")))
    if by_schema:
        left = F.array_except(have, or_empty(columns_left)) if columns_left in has else have
        gone = F.array_except(F.array_union(or_empty(c("fields")), F.col("_dim_fields")), left)
    else:
        gone = no_strings()
    # detected dimensions are known ones
    j = j.select("*", (F.col("_unknown") if given else no_strings()).alias("_strange"), barred.alias("_barred"), gone.alias("_gone"))
    e = lambda name, d: F.coalesce(c(f"coverage.{name}"), d)
    if by_schema:
        covered = [F.lit(True), F.size("_gone") == 0, F.lit("physical_schema_columns"), required, F.sort_array("_gone"), no_strings(), no_strings()]
    else:
        mode = e("mode", F.lit("not_required_by_metric_contract"))
        needs = F.when(mode == "not_available_in_released_contract", required).otherwise(e("required", no_strings()))
        covered = [e("active", F.lit(False)), e("passed", F.lit(True)), mode, needs, e("missing", no_strings()), e("missing_bindings", no_strings()), e("missing_physical_assets", no_strings())]
    if "coverage_override" in has:
        over = F.transform("coverage_override", lambda x: F.lower(x))
        lost, on = F.array_except(required, over), F.col("coverage_override").isNotNull()
        forced = [F.lit(True), F.size(lost) == 0, F.lit("explicit_override"), required, lost, no_strings(), no_strings()]
        covered = [F.when(on, f).otherwise(x) for f, x in zip(forced, covered)]
    covered = covered[:2] + [x.alias(n) for x, n in zip(covered[2:], ["mode", "required", "missing", "missing_bindings", "missing_physical_assets"])]
    available = sorted(catalog.profile.get("available_time_anchors") or [])
    temporal = F.coalesce(c("temporal"), F.lit(False))
    in_window = (bound == "") | bound.isin(*available) if available else F.lit(True)
    cases = policy_cases(q, F.col("metric_id"), known, c("answerable"), catalog)
    any_hit = F.lit(False)
    for cond, _ in cases:
        any_hit = any_hit | cond
    hits = F.array_distinct(gather(cases, "array<struct<policy_id:string,trigger:string>>"))
    no_unknown = F.size("_strange") == 0
    checks = {
        "field": [F.lit(True), known & no_unknown, F.col("metric_id"), F.sort_array(F.array_distinct("_strange")).alias("unknown_dimensions")],
        "caliber": [F.lit(True), F.coalesce(c("caliber.passed"), F.lit(True)), F.coalesce(c("caliber.ratio_like"), F.lit(False)).alias("ratio_like"),
                    F.col("metric_id"), or_empty(c("caliber.found_numerator")).alias("numerator"), or_empty(c("caliber.found_denominator")).alias("denominator"),
                    or_empty(c("caliber.required_numerator")).alias("required_numerator"), or_empty(c("caliber.required_denominator")).alias("required_denominator"),
                    F.coalesce(c("caliber.route_source"), F.lit("not_required")).alias("route_source")],
        "grain": [F.lit(True), no_unknown & (F.size("_barred") == 0), requested.alias("requested"), resolved.alias("resolved_finest"),
                  set_of(F.array_except(requested, resolved)).alias("removed_ancestors"), F.sort_array("_barred").alias("disallowed")],
        "coverage": covered,
        "time": [temporal | F.lit(bool(available)), (~temporal | (bound != "")) & in_window, temporal.alias("required"), bound.alias("detected"), X.lit_list(available).alias("available")],
        "policy": [F.lit(True), ~any_hit, hits.alias("hits")],
    }
    for name in disabled:
        checks[name][0], checks[name][1] = F.lit(False), F.lit(True)
    failing = [(active & ~passed, F.lit(f)) for f, (active, passed, *_) in checks.items()]
    # the list of failures is fenced; the details around it are only computed when somebody reads them
    j = scale.fenced(j.select("*", gather(failing).alias("_failed")), "_failed")
    off = lambda f: F.array_contains("_failed", f)
    detail = F.struct(*[F.struct(active.alias("active"), (~off(f) if f not in disabled else F.lit(True)).alias("passed"), F.lit(f in disabled).alias("disabled_for_ablation"), *more).alias(f) for f, (active, _, *more) in checks.items()])
    ok = F.size("_failed") == 0
    primary = F.get("_failed", F.lit(0))
    certificate = F.when(~ok, F.struct(
        F.col("_failed").alias("failed_constraints"), primary.alias("primary_failure"), (F.array_join("_failed", ",") == "grain").alias("repairable")))
    decision = F.struct(
        F.when(ok, "answer").otherwise("refuse").alias("action"),
        F.when(ok, F.col("metric_id")).otherwise("").alias("pred_metric_id"),
        F.when(ok, resolved).otherwise(no_strings()).alias("pred_dimensions"),
        F.when(ok, "witness_satisfied").otherwise(F.concat(F.lit("constraint_failure:"), primary)).alias("reason"),
        F.struct(
            (or_empty("candidate_metrics") if "candidate_metrics" in has else no_strings()).alias("candidate_metrics"),
            detail.alias("checks"), certificate.alias("certificate"), F.lit(False).alias("used_gold_label"),
        ).alias("trace"),
    )
    return j.select(*requests.columns, *keep, decision.alias("decision"))


def compile_candidates(candidates: DataFrame, contract: DataFrame, catalog: Catalog, key, rank="rank", form="auto") -> DataFrame:
    """Compile every linked candidate of a request and keep the best-ranked one that passes, else the refusal of the first."""
    d = compile_requests(candidates, contract, catalog, form=form)
    best = scale.first_k(d, [key], [F.col("decision.action") != "answer", F.col(rank)], 1, "_first")
    return best.select(key, "metric_id", rank, "decision")


# --- validation of given plans ------------------------------------------------------------------


def validate_plans(plans: DataFrame, contract: DataFrame, catalog: Catalog, triggers, unanswerable, form="auto") -> DataFrame:
    """Typed violations of each plan (action, pred_metric_id, pred_dimensions, parse_status, nl_query), in rule order.

    Released triggers keep their blanks here, unlike in compile_requests.
    """
    asked = plans.withColumn("metric_id", F.col("pred_metric_id")).withColumn("requested", F.col("pred_dimensions"))
    j = compile_requests(asked, contract, catalog, form=form, keep=("_known", "_allowed", "_unknown", "_above"))
    checks, rules = F.col("decision.trace.checks"), ("caliber", "coverage", "time", "policy")
    # what several rules read is computed once and below them; arrays are put together by functions that are compiled
    j = scale.fenced(j.select(
        *plans.columns, "_known", "_allowed", "_unknown", "_above", *[(checks[f]["active"] & ~checks[f]["passed"]).alias(f"_no_{f}") for f in rules],
        checks["coverage"]["missing"].alias("_missing"), checks["time"]["detected"].alias("_detected"),
        P.substring_hits(F.lower(F.trim("nl_query")), triggers).alias("_hits"),
    ), "_hits")
    hit, no_hit = F.size("_hits") > 0, F.size("_hits") == 0
    broken = F.col("parse_status").isin("parse_error", "api_error", "missing")
    refused = F.col("action") == "refuse"
    metric, chosen = F.col("pred_metric_id"), F.col("pred_dimensions")
    known, allowed = F.col("_known"), F.col("_allowed")
    none = F.array().cast("array<struct<type:string,detail:string>>")
    row = lambda kind, detail: F.struct(F.lit(kind).alias("type"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    one = lambda cond, kind, detail: F.when(cond, F.array(row(kind, detail)))
    each = lambda values, kind: F.transform(values, lambda v: row(kind, v))
    strange = lambda d: F.array_contains("_unknown", d)
    barred = F.when(known & (F.size(allowed) > 0), F.array_except(F.filter(chosen, lambda d: ~strange(d)), allowed)).otherwise(no_strings())
    clashes = F.flatten(F.transform(F.sort_array("_above"), lambda x: F.transform(
        F.array_intersect(F.sort_array(x["up"]), chosen), lambda a: row("finest_grain_violation", F.concat(a, F.lit(">"), x["d"])))))
    answer = [
        F.when(metric == "", F.array(row("answer_without_metric", "")))
        .when(~known & (metric != "__parse_error__"), F.array(row("metric_not_in_catalog", metric)))
        .when(metric.isin(*unanswerable) if unanswerable else F.lit(False), F.array(row("unanswerable_metric", metric))),
        each(F.filter(chosen, strange), "dimension_not_in_catalog"),
        each(barred, "dimension_not_allowed"),
        clashes,
        one(hit, "missed_refusal", F.array_join(F.sort_array(F.array_distinct(F.transform("_hits", lambda h: h["trigger"]))), ",")),
        one(known & F.col("_no_caliber"), "caliber_dependency_failure", ""),
        one(known & F.col("_no_coverage"), "physical_coverage_failure", F.array_join("_missing", ",")),
        one(known & F.col("_no_time"), "temporal_anchor_failure", F.col("_detected")),
        one(known & F.col("_no_policy") & no_hit, "missed_refusal", "policy"),
    ]
    found = F.when(broken, F.array(row("output_not_parseable", F.col("parse_status")))).when(
        refused, one(no_hit, "unjustified_refusal", "")
    ).otherwise(F.concat(*[F.coalesce(a, none) for a in answer]))
    return scale.fenced(j.select(*plans.columns, F.coalesce(found, none).alias("violations")), "violations")


def feedback_text(plan: Column, violations: Column, rules: dict) -> Column:
    """Numbered report of the violations with the rule behind each type."""
    rule = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    items = F.transform(violations, lambda v, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), v["type"], F.lit("] rule: "), F.coalesce(F.try_element_at(rule, v["type"]), F.lit("")), F.lit(" — "), v["detail"]))
    return F.when(F.size(violations) > 0, F.concat(F.lit("Plan: "), plan, F.lit("\n"), F.array_join(items, "\n"))).otherwise("")


def conformance(plans: DataFrame, contract: DataFrame, catalog: Catalog, keys=(), form="auto") -> DataFrame:
    """Rates of four violation kinds over answered plans."""
    a = plans.filter((F.col("action") != "refuse") & (F.col("pred_metric_id") != "")).join(
        contract.select(F.col("metric_id").alias("pred_metric_id"), F.col("contract.allowed").alias("_allowed")), "pred_metric_id", "left")
    a = D.with_sets(a, "pred_dimensions", catalog, form)
    chosen = F.col("pred_dimensions")
    known = F.array_except(chosen, "_unknown")
    clash = F.size("_resolved") < F.size(F.array_distinct(chosen))
    flags = {
        "metric_not_in_catalog": F.col("_allowed").isNull(),
        "dimension_not_in_catalog": F.size("_unknown") > 0,
        "dimension_not_allowed": F.col("_allowed").isNotNull() & (F.size(F.array_except(known, F.coalesce("_allowed", known))) > 0),
        "finest_grain_violation": clash,
    }
    n = F.count(F.lit(1))
    out = [n.alias("n")]
    for name, flag in flags.items():
        hit = F.sum(F.when(flag, 1).otherwise(0))
        out += [hit.alias(name), F.round(hit / F.greatest(n, F.lit(1)), 6).alias(f"{name}_rate")]
    return a.groupBy(*keys).agg(*out)


def posthoc_baselines(plans: DataFrame, catalog: Catalog, refusal: Column, form="auto") -> DataFrame:
    """Two derived modes per plan: refuse on policy; additionally refuse on a hierarchy conflict."""
    conflict = F.size("_resolved") < F.size(F.array_distinct("pred_dimensions"))
    e = D.with_sets(plans, "pred_dimensions", catalog, form).withColumnRenamed("mode", "source_mode").withColumn("mode", F.explode(X.lit_list(["semantic_layer_validator", "posthoc_answerability_validator"])))
    blocked = F.when(refusal, F.concat("mode", F.lit("_policy_refusal"))).when(
        (F.col("mode") == "posthoc_answerability_validator") & conflict, F.lit("posthoc_hierarchy_conflict_no_replan"))
    e = e.withColumn("_blocked", blocked)
    keep = F.col("_blocked").isNull()
    return e.select(
        *[c for c in plans.columns if c not in ("mode", "action", "pred_metric_id", "pred_dimensions", "reason")], "mode", "source_mode",
        F.when(keep, F.col("action")).otherwise("refuse").alias("action"), F.when(keep, F.col("pred_metric_id")).otherwise("").alias("pred_metric_id"),
        F.when(keep, F.col("pred_dimensions")).otherwise(no_strings()).alias("pred_dimensions"),
        F.coalesce("_blocked", F.concat("mode", F.lit("_accepted_candidate"))).alias("reason"),
    )


def failure_certificates(scored: DataFrame, preference, reference_mode, key="case_id", limit=None) -> DataFrame:
    """First failing baseline of each case by preference, with the witness it lacks.

    `scored` has one row per case and mode with both the prediction and the gold columns.
    """
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(preference) for x in (m, i)])
    pred, gold = F.col("pred_dimensions"), F.col("expected_dimensions")
    refused = (F.col("action") == "refuse") | (F.col("pred_metric_id") == "")
    expected = F.col("expected_action") == "refuse"
    same = (F.size(F.array_except(pred, gold)) == 0) & (F.size(F.array_except(gold, pred)) == 0)
    right = (F.col("pred_metric_id") == F.col("expected_metric_id")) & same & (refused == expected)
    lacks = F.array_compact(F.array(
        F.when(expected & ~refused, F.lit("policy_refusal_certificate")),
        F.when((F.size(F.array_except(gold, pred)) == 0) & ~same, F.lit("finest_grain_certificate")),
        F.when(F.col("pred_metric_id") != F.col("expected_metric_id"), F.lit("metric_identity_certificate"))))
    missing = F.when(F.size(lacks) > 0, lacks).otherwise(F.array(F.lit("coverage_caliber_certificate")))
    wrong = F.when(F.col("mode").isin(*preference) & ~right, F.try_element_at(rank, F.col("mode")))
    per = scored.groupBy(key).agg(
        F.max(F.when(F.col("mode") == reference_mode, F.struct("action", "pred_metric_id"))).alias("reference"),
        F.min_by(F.struct("mode", missing.alias("missing_witness")), wrong).alias("b"), F.min(wrong).alias("_w"),
    ).filter(F.col("reference").isNotNull() & F.col("_w").isNotNull())
    out = per.select(key, "b.mode", "b.missing_witness", F.col("reference.action").alias("reference_action"), F.col("reference.pred_metric_id").alias("reference_metric_id"))
    return out.orderBy(key).limit(limit) if limit else out
