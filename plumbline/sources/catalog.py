"""Catalog metadata: small, size-checked, kept beside the plan rather than in it."""

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

# Dimensions of a catalog of up to this many become expressions, those of a larger one are joined (see operators.dimensions).
MAX_INLINE = 512


def strings():
    return T.ArrayType(T.StringType())


METRIC_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("metric_id", "metric_name", "formula", "numerator", "denominator", "metric_type", "formula_role",
      "scoped_ratio_kind", "domain_id", "description")]
    + [T.StructField(n, strings()) for n in
       ("aliases", "allowed_dimensions", "coverage_nodes", "numerator_nodes", "denominator_nodes")]
    + [T.StructField(n, T.BooleanType()) for n in
       ("scoped_ratio", "answerable", "coverage_required", "temporal_anchor_required")]
)
DIMENSION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("dimension_id", "name", "parent", "sql", "domain_id")]
    + [T.StructField("aliases", strings()), T.StructField("grain_rank", T.IntegerType())]
)
EDGE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("src", "dst", "edge_type", "metric_id", "domain_id")]
)
POLICY_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("policy_id", "policy_type", "action", "trigger", "domain_id", "metric_id", "public_rule")]
    + [T.StructField(n, strings()) for n in ("refusal_triggers", "ambiguous_queries")]
)
COVERAGE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("coverage_id", "domain_id", "layer", "semantic_node_id")]
)
BINDING_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("binding_id", "domain_id", "metric_id", "dependency_node_id", "physical_node_id", "role")]
)
PROFILE_SCHEMA = (
    "dataset_id string, default_time_anchor string, available_time_anchors array<string>, "
    "time_aliases map<string,array<string>>, "
    "policy_rules array<struct<policy_id:string,contains:array<string>,exact:array<string>>>"
)


@dataclass
class Catalog:
    """Rows of the released catalog files. All but dimensions and policies are joined as tables, of any size."""

    metrics: list = field(default_factory=list)
    dimensions: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    policies: list = field(default_factory=list)
    profile: dict = field(default_factory=dict)
    schema_columns: list = field(default_factory=list)
    coverage: list = field(default_factory=list)
    bindings: list = field(default_factory=list)
    extra_sql_words: list = field(default_factory=list)

    def metric_rows(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, self.metrics, METRIC_SCHEMA)

    def dimension_rows(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, self.dimensions, DIMENSION_SCHEMA)

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, self.edges, EDGE_SCHEMA)

    def coverage_rows(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, self.coverage, COVERAGE_SCHEMA)

    def binding_rows(self, spark: SparkSession) -> DataFrame:
        return rows_of(spark, self.bindings, BINDING_SCHEMA)

    @property
    def ranked_dimensions(self):
        return sorted(self.dimensions, key=lambda d: (d.get("grain_rank") or 0, d["dimension_id"]))

    def closure(self):
        """dimension -> all its ancestors; a cycle ends where it closes."""
        parent = {d["dimension_id"]: d.get("parent") or "" for d in self.dimensions}
        out = {}
        for dim in parent:
            chain, up = [], parent[dim]
            while up and up not in chain:
                chain.append(up)
                up = parent.get(up, "")
            out[dim] = chain
        return out


def rows_of(spark, rows, schema) -> DataFrame:
    """Catalog rows as a local relation: its exact size is known to the planner, so joins with it need no hint."""
    table = pa.table(
        [pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names
    )
    return spark.createDataFrame(table, schema)


def bounded_rows(df: DataFrame, limit=MAX_INLINE) -> list:
    """Rows of a catalog DataFrame as dicts; refuses one that has grown past the bound."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"catalog has more than {limit} rows: use the join forms")
    return [r.asDict(recursive=True) for r in rows]
