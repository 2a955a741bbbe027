"""The governed catalog over the driver's star schema (fixed values) and the rows derived from it."""

from plumbline.sources.catalog import Catalog

DIM_IDS = ["region", "nation", "customer", "year", "quarter", "month", "brand", "part_type", "segment", "priority"]

# Metrics of the star schema.
METRICS = [
    dict(metric_id="revenue", metric_name="Revenue", aliases=["revenue", "net sales", "营收"],
         formula="SUM(l_extendedprice * (1 - l_discount))", numerator="", denominator="", metric_type="additive",
         allowed_dimensions=DIM_IDS, answerable=True, temporal_anchor_required=True, description="Discounted sales."),
    dict(metric_id="units", metric_name="Units", aliases=["units", "units sold", "销量"],
         formula="SUM(l_quantity)", numerator="", denominator="", metric_type="additive",
         allowed_dimensions=DIM_IDS, answerable=True, temporal_anchor_required=False, description="Quantity sold."),
    dict(metric_id="order_count", metric_name="Order Count", aliases=["order count", "orders", "订单数"],
         formula="COUNT(DISTINCT o_orderkey)", numerator="", denominator="", metric_type="additive",
         allowed_dimensions=["region", "nation", "customer", "year", "quarter", "month", "segment", "priority"],
         answerable=True, temporal_anchor_required=False, description="Distinct orders."),
    dict(metric_id="customer_count", metric_name="Customer Count", aliases=["customer count", "buyers", "客户数"],
         formula="COUNT(DISTINCT o_custkey)", numerator="", denominator="", metric_type="additive",
         allowed_dimensions=["region", "nation", "year", "quarter", "month", "segment", "priority"],
         answerable=True, temporal_anchor_required=False, description="Distinct buyers."),
    dict(metric_id="average_order_value", metric_name="Average Order Value", aliases=["average order value", "aov", "客单价"],
         formula="SUM(l_extendedprice * (1 - l_discount)) / NULLIF(COUNT(DISTINCT o_orderkey), 0)", numerator="", denominator="",
         metric_type="ratio", allowed_dimensions=["region", "nation", "customer", "year", "quarter", "month", "segment", "priority"],
         answerable=True, temporal_anchor_required=True, description="Discounted sales per order."),
    dict(metric_id="average_unit_price", metric_name="Average Unit Price", aliases=["average unit price", "price per unit", "均价"],
         formula="SUM(l_extendedprice) / NULLIF(SUM(l_quantity), 0)", numerator="", denominator="", metric_type="ratio",
         allowed_dimensions=[], answerable=True, temporal_anchor_required=False, description="Price per unit."),
    dict(metric_id="return_share", metric_name="Return Share", aliases=["return share", "return rate", "退货率"],
         formula="SUM(l_quantity * is_return) / NULLIF(SUM(l_quantity), 0)", numerator="", denominator="", metric_type="rate",
         allowed_dimensions=["region", "nation", "year", "quarter", "month", "brand", "part_type"],
         answerable=True, temporal_anchor_required=False, description="Share of units returned."),
    dict(metric_id="discount_amount", metric_name="Discount Amount", aliases=["discount amount", "discounts", "折扣额"],
         formula="SUM(l_extendedprice * l_discount)", numerator="", denominator="", metric_type="additive",
         allowed_dimensions=DIM_IDS, answerable=True, temporal_anchor_required=False, description="Money given as discount."),
    dict(metric_id="profit_margin", metric_name="Profit Margin", aliases=["profit margin", "gross margin", "毛利率"],
         formula="", numerator="", denominator="", metric_type="additive", allowed_dimensions=DIM_IDS,
         answerable=False, temporal_anchor_required=False, description="Not governed."),
]

# Dimensions, their parents and their column expressions.
DIMENSIONS = [
    dict(dimension_id="region", name="Region", aliases=["region", "地区"], parent="", grain_rank=1, sql="r_name"),
    dict(dimension_id="nation", name="Country", aliases=["country", "nation", "国家"], parent="region", grain_rank=2, sql="n_name"),
    dict(dimension_id="customer", name="Customer", aliases=["customer", "客户"], parent="nation", grain_rank=3, sql="c_name"),
    dict(dimension_id="year", name="Year", aliases=["year", "yearly", "年份"], parent="", grain_rank=1, sql="date_format(o_orderdate, 'yyyy')"),
    dict(dimension_id="quarter", name="Quarter", aliases=["quarter", "quarterly", "季度"], parent="year", grain_rank=2,
         sql="concat(date_format(o_orderdate, 'yyyy'), '-Q', quarter(o_orderdate))"),
    dict(dimension_id="month", name="Month", aliases=["month", "monthly", "月份"], parent="quarter", grain_rank=3, sql="date_format(o_orderdate, 'yyyy-MM')"),
    dict(dimension_id="brand", name="Brand", aliases=["brand", "品牌"], parent="", grain_rank=1, sql="p_brand"),
    dict(dimension_id="part_type", name="Part Type", aliases=["part type", "类型"], parent="", grain_rank=1, sql="p_type"),
    dict(dimension_id="segment", name="Market Segment", aliases=["market segment", "segment", "细分"], parent="", grain_rank=1, sql="c_mktsegment"),
    dict(dimension_id="priority", name="Priority", aliases=["priority", "优先级"], parent="", grain_rank=1, sql="o_orderpriority"),
]

# Refusal policies. Triggers keep their trailing blank; the compile step strips it.
POLICIES = [
    dict(policy_id="sql_or_ddl", trigger="sql or ddl text", refusal_triggers=["select "], ambiguous_queries=[]),
    dict(policy_id="sensitive", trigger="personal data", refusal_triggers=["phone list"], ambiguous_queries=["show me the numbers"]),
    dict(policy_id="off_domain", trigger="off-domain", refusal_triggers=[], ambiguous_queries=[]),
]

PROFILE = dict(
    default_time_anchor="2000",
    available_time_anchors=[str(y) for y in range(1995, 2002)] + ["last_year"],
    time_aliases={"last_year": ["last year", "去年"], **{str(y): [str(y)] for y in range(1995, 2000)}},
    policy_rules=[dict(policy_id="row_level", contains=["raw rows"], exact=["dump everything"])],
)

# Columns of the joined fact table the contract covers; p_type is deliberately not among them.
SCHEMA_COLUMNS = (
    "l_extendedprice l_discount l_quantity is_return o_orderkey o_custkey o_orderdate o_orderpriority "
    "c_name c_mktsegment n_name r_name p_brand"
).split()

# Names our dimension expressions use that are functions, not columns.
FUNCTION_WORDS = ["date_format", "concat", "quarter"]


def catalog() -> Catalog:
    return Catalog(
        metrics=METRICS, dimensions=DIMENSIONS, policies=POLICIES, profile=PROFILE,
        schema_columns=SCHEMA_COLUMNS, extra_sql_words=FUNCTION_WORDS,
    )
