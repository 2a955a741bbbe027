"""A small public sales catalog with 32 labelled requests (fixed values)."""

ALL = ["ordered_month", "ordered_quarter", "county_name", "store_city", "store_name", "category_name", "vendor_name", "item_desc"]
NO_ITEM = ALL[:7]
NO_STORE = [d for d in ALL if d not in ("store_name", "item_desc")]


def metric(metric_id, name, aliases, formula, description, allowed, answerable=True):
    return dict(metric_id=metric_id, metric_name=name, aliases=aliases, formula=formula, description=description, allowed_dimensions=allowed, answerable=answerable, numerator="", denominator="")


METRICS = [
    metric("sales_dollars", "Sales Dollars", ["sales", "revenue", "total sales", "sales amount"], "SUM(sales_dollars)", "Total public liquor sales dollars.", ALL),
    metric("bottles_sold", "Bottles Sold", ["bottles", "units sold", "volume in bottles"], "SUM(sales_bottles)", "Total bottles sold.", ALL),
    metric("liters_sold", "Liters Sold", ["liters", "volume liters", "sales liters"], "SUM(sales_liters)", "Total liters sold.", ALL),
    metric("invoice_count", "Invoice Count", ["invoices", "orders", "order count", "transactions"], "COUNT(DISTINCT invoice_id)", "Number of distinct public invoice identifiers.", NO_ITEM),
    metric("store_count", "Store Count", ["stores", "retailers", "store coverage"], "COUNT(DISTINCT store_no)", "Number of distinct licensed stores in the selected slice.", NO_STORE),
    metric("item_count", "Item Count", ["items", "products", "sku count", "item coverage"], "COUNT(DISTINCT item_no)", "Number of distinct public item numbers.", NO_STORE),
    metric("average_bottle_price", "Average Bottle Price", ["avg bottle price", "price per bottle", "average unit price"], "SUM(sales_dollars) / NULLIF(SUM(sales_bottles), 0)", "Sales dollars divided by bottles sold.", ALL),
    metric("average_invoice_value", "Average Invoice Value", ["aov", "average order value", "sales per invoice"], "SUM(sales_dollars) / NULLIF(COUNT(DISTINCT invoice_id), 0)", "Sales dollars divided by distinct invoice count.", NO_ITEM),
    metric("profit_margin", "Profit Margin", ["margin", "gross margin", "profit rate"], "", "Unsupported because the public dataset has no cost or profit field.", [], False),
]


def dim(dimension_id, name, aliases, parent, rank, sql):
    return dict(dimension_id=dimension_id, name=name, aliases=aliases, parent=parent, grain_rank=rank, sql=sql)


DIMENSIONS = [
    dim("ordered_month", "Order Month", ["month", "monthly", "ordered month"], "ordered_quarter", 2, "substr(ordered_on, 1, 7)"),
    dim("ordered_quarter", "Order Quarter", ["quarter", "quarterly", "ordered quarter"], "", 1, "strftime('%Y', ordered_on) || '-Q' || ((cast(strftime('%m', ordered_on) as integer) + 2) / 3)"),
    dim("county_name", "County", ["county"], "", 1, "county_name"),
    dim("store_city", "Store City", ["city", "store city"], "county_name", 2, "store_city"),
    dim("store_name", "Store Name", ["store", "retailer", "store name"], "store_city", 3, "store_name"),
    dim("category_name", "Category", ["category", "liquor category"], "", 1, "category_name"),
    dim("vendor_name", "Vendor", ["vendor", "supplier"], "", 1, "vendor_name"),
    dim("item_desc", "Item Description", ["item", "product", "sku", "item description"], "category_name", 2, "im_desc"),
]
PROFILE = dict(
    default_time_anchor="2024", available_time_anchors=["2024"], time_aliases={"2024": ["2024", "current public snapshot"]},
    policy_rules=[
        dict(policy_id="sql_or_ddl", contains=["select ", "drop ", "delete ", "insert ", "update ", "truncate "], exact=[]),
        dict(policy_id="aggregate_only", contains=["invoice id", "raw invoice", "store address", "phone", "customer"], exact=[]),
        dict(policy_id="off_domain", contains=["weather", "tomorrow"], exact=[]),
    ])
COLUMNS = ("invoice_id ordered_on store_no store_name store_address store_city store_zip_code county_fips_code county_name category_code category_name vendor_number vendor_name "
           "item_no im_desc pack bottle_volume_ml sales_bottles sales_dollars sales_liters sales_gallons").split()
BOOSTS = [
    ("item_count", ["product", "products", "item count", "items", "sku count"], 30.0), ("store_count", ["store count", "retailer count", "stores", "retailers"], 8.0),
    ("invoice_count", ["invoice count", "invoices", "order count", "orders", "transactions"], 8.0), ("profit_margin", ["margin", "gross margin", "profit rate"], 5.0),
]
CASES = [
    ("What were total liquor sales dollars?", "sales_dollars", ""), ("Sales dollars by county", "sales_dollars", "county_name"), ("Sales by county and city", "sales_dollars", "store_city"),
    ("Sales by category and item", "sales_dollars", "item_desc"), ("Monthly liquor sales", "sales_dollars", "ordered_month"), ("Quarterly sales dollars by county", "sales_dollars", "county_name ordered_quarter"),
    ("How many bottles were sold?", "bottles_sold", ""), ("Bottles sold by vendor", "bottles_sold", "vendor_name"), ("Bottles by category and item", "bottles_sold", "item_desc"),
    ("Liters sold by county", "liters_sold", "county_name"), ("Volume in liters by county and city", "liters_sold", "store_city"), ("How many invoices are in the public liquor data?", "invoice_count", ""),
    ("Invoice count by month", "invoice_count", "ordered_month"), ("Order count by county and city", "invoice_count", "store_city"), ("How many stores sold liquor?", "store_count", ""),
    ("Store count by county", "store_count", "county_name"), ("Retailer count by city", "store_count", "store_city"), ("How many products appear in the sales data?", "item_count", ""),
    ("Item count by category", "item_count", "category_name"), ("Product count by vendor", "item_count", "vendor_name"), ("Average bottle price by category", "average_bottle_price", "category_name"),
    ("Price per bottle by category and item", "average_bottle_price", "item_desc"), ("Average order value by county", "average_invoice_value", "county_name"), ("AOV by county and city", "average_invoice_value", "store_city"),
    ("Average invoice value by vendor", "average_invoice_value", "vendor_name"), ("Show raw invoice ids", "", ""), ("List store addresses", "", ""), ("DROP TABLE iowa_liquor_sales", "", ""),
    ("What is the weather in Iowa tomorrow?", "", ""), ("Profit margin by category", "", ""), ("Gross margin by vendor", "", ""), ("Customer phone numbers for liquor buyers", "", ""),
]
