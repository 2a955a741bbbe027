"""Scalar functions over whole texts."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.queries import query

J = lambda a, sep=",": F.array_join(a, sep)


@query("fn_normalize", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm FROM documents")
def _(t):
    return t.spread("documents", "doc_id").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm"))


FORMULAS = """SELECT p_partkey, concat('SUM(', p_type, '_amt * ', CASE WHEN p_partkey % 3 = 0 THEN 'Rate' ELSE 'rate_2' END,
 ') / NULLIF(COUNT(DISTINCT "', p_name, '"), 0) + CAST(', p_name, ' AS FLOAT) -- ', CHR(39), p_brand, CHR(39)) AS formula FROM @part"""


@query("fn_identifiers", f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(
 regexp_extract_all(regexp_replace(formula, '''[^'']*''|"[^"]*"', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)),
 lambda x: x NOT IN ({','.join("'" + w + "'" for w in X.SQL_WORDS)})))), ',') AS fields FROM ({FORMULAS}) f""")
def _(t):
    return t.sql(FORMULAS).select("p_partkey", J(X.identifiers(F.col("formula"))).alias("fields"))


@query("fn_contains_alias", """SELECT request_id, regexp_matches(q, '(^|[^a-z0-9_])region([^a-z0-9_]|$)') OR contains(q, '地区') AS has_region,
 regexp_matches(q, '(^|[^a-z0-9_])(select|orders)([^a-z0-9_]|$)') AS has_sql,
 regexp_matches(q, '(^|[^a-z0-9_])' || replace(g_metric, '_', ' ') || '([^a-z0-9_]|$)') AS has_metric
 FROM (SELECT *, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM @requests) r""")
def _(t):
    q = X.normalize(F.col("nl_query"))
    return t.requests.select(
        "request_id",
        X.contains_any_alias(q, ["Region", "地区"]).alias("has_region"),
        X.contains_any_alias(q, ["select", "orders"]).alias("has_sql"),
        X.contains_alias(q, F.replace("g_metric", F.lit("_"), F.lit(" "))).alias("has_metric"),
    )


@query("fn_clean_id", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(concat(' ', p_name, ' # ', p_brand, '!'))), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS id FROM part""")
def _(t):
    return t.part.select("p_partkey", X.clean_id(F.concat_ws("", F.lit(" "), "p_name", F.lit(" # "), "p_brand", F.lit("!"))).alias("id"))


SQLS = """SELECT p_partkey, concat('SELECT  Max("p_size") ', chr(10), ' , cast  (', p_name, ' as int) -- note ', p_brand, chr(10), ' FROM `part`  AS p', CAST(p_partkey % 4 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE '' END) AS q FROM @part"""


@query("fn_norm_sql", f"""SELECT p_partkey, s AS flat, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(s), '"', ''), '`', ''), 'cast\\s*\\(', 'cast(', 'g'),
 '\\s+as\\s+[a-z_][a-z0-9_]*$', ''), '\\s+', ' ', 'g')) AS expr
 FROM (SELECT p_partkey, rtrim(trim(regexp_replace(regexp_replace(q, '--[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')), ';') AS s FROM ({SQLS}) a) b""")
def _(t):
    return t.sql(SQLS).select("p_partkey", X.norm_sql(F.col("q")).alias("flat"), X.norm_expr(F.col("q")).alias("expr"))


@query("fn_mask_digits", """SELECT page_id, regexp_replace(regexp_replace(url, '[0-9]', '*', 'g'), '\\*+', '*', 'g') AS masked FROM pages""")
def _(t):
    return t.pages.select("page_id", X.mask_digits(F.col("url")).alias("masked"))


@query("fn_remove_digits", """SELECT page_id, regexp_replace(url, '[0-9]', '', 'g') AS removed, length(regexp_replace(html, '[0-9]', '', 'g')) AS n FROM pages""")
def _(t):
    return t.pages.select("page_id", X.remove_digits(F.col("url")).alias("removed"), F.length(X.remove_digits(F.col("html"))).cast("bigint").alias("n"))


@query("fn_stable_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS id16, substr(sha1(text), 1, 12) AS id12 FROM documents")
def _(t):
    return t.documents.select("doc_id", X.stable_hash(F.col("text")).alias("id16"), F.substring(F.sha1("text"), 1, 12).alias("id12"))


DIMS = "SELECT request_id, concat(d2, '; ', d1, ', ', d2, ' ;', CASE WHEN tpl = 3 THEN 'zone' ELSE '' END) AS dims FROM @requests r"


@query("fn_norm_dims", f"""SELECT request_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(dims, ',', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS dims
 FROM ({DIMS}) d""")
def _(t):
    return t.sql(DIMS).select("request_id", J(X.norm_dims(F.col("dims")), "|").alias("dims"))


@query("fn_truncate_values", """SELECT doc_id, md5(CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '...(truncated)' ELSE text END) AS clipped,
 CASE WHEN length(text) > 200 AND length(lang) > 250 THEN substr(lang, 1, 250) ELSE lang END AS second,
 md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...(truncated)' ELSE text END) AS in_map FROM documents""")
def _(t):
    vals = X.clip_values(F.array("text", "lang", "source", "lang"))
    return t.documents.select(
        "doc_id", F.md5(F.get(vals, F.lit(0))).alias("clipped"), F.get(vals, F.lit(1)).alias("second"),
        F.md5(X.clip_map(F.create_map(F.lit("text"), "text"))["text"]).alias("in_map"),
    )


SCHEMA_LINES = """SELECT p_partkey, concat('Table: part', chr(10), 'Column name: ', p_name, '; Column type: TEXT; Column value: [', p_brand, ', ', p_type, ']; Description: size ', CAST(p_size AS STRING), chr(10),
 'Column name: x; Column type: INT; Description: none', chr(10), 'description: ', p_type, ' goods ', chr(10), 'end') AS doc FROM @part"""


@query("fn_drop_value_segment", f"""SELECT p_partkey, replace(doc, concat('; Column value: [', p_brand, ', ', p_type, ']'), '') AS doc FROM ({SCHEMA_LINES}) d JOIN part USING (p_partkey)""")
def _(t):
    return t.sql(SCHEMA_LINES).select("p_partkey", X.drop_value_segment(F.col("doc")).alias("doc"))


@query("fn_description_line", f"""SELECT p_partkey, trim(split_part(split_part(doc, chr(10) || 'description:', 2), chr(10), 1)) AS d FROM ({SCHEMA_LINES}) s""")
def _(t):
    return t.sql(SCHEMA_LINES).select("p_partkey", X.description_line(F.col("doc")).alias("d"))


TAGGED = """SELECT request_id, g_metric, d1, concat('<secureCOT> steps ', d1, chr(10), '</secureCOT>', CASE WHEN tpl % 2 = 0 THEN concat('<secure_output> ', CASE WHEN tpl = 4 THEN 'unsafe' ELSE 'safe' END, ' </secure_output>') ELSE '' END,
 chr(10), '```sql SELECT 1 ```', ' and ', '```SQL', chr(10), 'SELECT ', g_metric, chr(10), '```', chr(10), 'Q: old one?', chr(10), '**Q:** [what about ', d2, ']',
 chr(10), '**Safe condition:** ', d1, ' stays hidden.', chr(10), 'specific_column: [', d1, ', ', d2, ']', chr(10)) AS txt, d2, tpl FROM @requests r"""


@query("fn_tag_extract", f"""SELECT request_id, 'steps ' || d1 AS cot, CASE WHEN tpl % 2 = 0 THEN CASE WHEN tpl = 4 THEN 'unsafe' ELSE 'safe' END END AS verdict,
 'SELECT ' || g_metric AS last_sql, 'what about ' || d2 AS question, d1 || ' stays hidden.' AS cond, concat('[', d1, ', ', d2, ']') AS cols, 'None' AS vals FROM ({TAGGED}) x""")
def _(t):
    c = F.col("txt")
    return t.sql(TAGGED).select(
        "request_id", X.tag_text(c, "secureCOT").alias("cot"), X.tag_text(c, "secure_output").alias("verdict"),
        X.last_sql_block(c).alias("last_sql"), X.last_question(c).alias("question"),
        X.labelled_field(c, "safe_condition|safe condition|safety condition", r"[^\n]*?\.").alias("cond"),
        X.labelled_field(c, "specific_column|specific column", r"\[.*?\]").alias("cols"),
        X.labelled_field(c, "specific_values?|specific value", r"\[.*?\]").alias("vals"),
    )


LABELS = """SELECT request_id, concat('think: ', d1, CASE tpl % 6 WHEN 0 THEN ' Label: Safe' WHEN 1 THEN ' verdict： UNSAFE' WHEN 2 THEN ' x: it is not quite safe' WHEN 3 THEN ' x: safe but a risk' WHEN 4 THEN ' none:' ELSE '' END) AS r,
 concat(CASE tpl % 3 WHEN 0 THEN '<secure_output> safe</secure_output>' WHEN 1 THEN '```select 1```' ELSE 'no' END, d1) AS o, tpl FROM @requests r"""


@query("fn_safety_label", f"""SELECT request_id, CASE tpl % 6 WHEN 0 THEN 'safe' WHEN 4 THEN '' WHEN 5 THEN '' ELSE 'unsafe' END AS flag,
 CASE tpl % 3 WHEN 2 THEN 'unsafe' ELSE 'safe' END AS cls FROM ({LABELS}) l""")
def _(t):
    return t.sql(LABELS).select("request_id", X.safety_flag(F.col("r")).alias("flag"), X.safety_class(F.col("o")).alias("cls"))


REPLY_SQL = """SELECT request_id, status, CASE WHEN status = 'parse_error' THEN '' ELSE lower(trim(coalesce(json_extract_string(blk, '$.action'), ''))) END AS action,
 CASE WHEN status = 'parse_error' THEN '' ELSE trim(coalesce(json_extract_string(blk, '$.metric_id'), '')) END AS metric_id,
 CASE WHEN status = 'parse_error' THEN '' ELSE array_to_string(list_filter(list_transform(coalesce(from_json(json_extract(blk, '$.dimensions'), '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> ''), '|') END AS dims
FROM (SELECT request_id, blk, CASE WHEN blk = '' THEN 'parse_error' WHEN blk = body THEN 'ok' ELSE 'ok_first_brace_block' END AS status
 FROM (SELECT *, regexp_extract(body, '\\{[^{}]*\\}') AS blk FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(raw_response, '<think>.*</think>', ''), '```json\\n', ''), '\\n```', '')) AS body FROM @replies r) a) b) c"""


@query("fn_parse_json_reply", REPLY_SQL)
def _(t):
    r = t.replies.select("request_id", X.parse_reply(F.col("raw_response")).alias("p"))
    return r.select("request_id", "p.status", "p.action", "p.metric_id", J("p.dimensions", "|").alias("dims"))


@query("fn_normalize_prediction", f"""SELECT request_id, CASE WHEN status = 'parse_error' OR action = '' THEN 'answer' ELSE action END AS act,
 CASE WHEN status = 'parse_error' THEN '__parse_error__' WHEN action = 'refuse' THEN '' ELSE metric_id END AS pred_metric_id,
 CASE WHEN status = 'parse_error' OR action = 'refuse' THEN '' ELSE dims END AS pred_dims, status AS parse_status FROM ({REPLY_SQL}) x""")
def _(t):
    r = t.replies.select("request_id", X.parse_reply(F.col("raw_response")).alias("p"))
    n = r.select("request_id", X.normalize_prediction(F.col("p.status"), F.col("p.action"), F.col("p.metric_id"), F.col("p.dimensions")).alias("n"))
    return n.select("request_id", F.col("n.action").alias("act"), "n.pred_metric_id", J("n.pred_dimensions", "|").alias("pred_dims"), "n.parse_status")


@query("fn_last_json_object", """SELECT request_id, CASE WHEN request_id % 6 = 3 THEN '' ELSE obj END AS obj FROM @replies r""")
def _(t):
    return t.replies.select("request_id", F.coalesce(X.last_json_object("raw_response"), F.lit("")).alias("obj"))


ARRAYS = """SELECT p_partkey, concat('```json', chr(7), ' Here: [{"id": "', p_name, '", "k": "', p_type, '"}, {"id": "', p_brand, '", "k": "z"}] done') AS r, p_name, p_brand, p_type FROM @part"""


@query("fn_parse_json_array", f"""SELECT p_partkey, p_name || '=' || p_type AS pair FROM ({ARRAYS}) a UNION ALL SELECT p_partkey, p_brand || '=z' FROM ({ARRAYS}) b""")
def _(t):
    e = t.sql(ARRAYS).select("p_partkey", F.explode(X.parse_json_array(F.col("r"), "struct<id:string,k:string>")).alias("e"))
    return e.select("p_partkey", F.concat_ws("=", "e.id", "e.k").alias("pair"))


CALLS = """SELECT p_partkey, concat('plan', chr(10), chr(64), 'schema_retrieval(table="', p_name, '", column="c', CAST(p_size AS STRING), '", description="', p_type, '")', chr(10), 'text ', chr(64), 'no()', chr(10),
 chr(64), 'sql_draft(query="select count(*) from ', p_brand, '")', chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat(chr(64), 'stop()') ELSE concat(chr(64), 'add_schema(table="t", column="u")') END,
 CASE p_partkey % 5 WHEN 1 THEN concat(chr(10), ' ', chr(64), 'sql_execution(query = select max(least(a, 1)) from ', p_brand, ')', chr(10), 'done') WHEN 2 THEN concat(chr(10), chr(64), 'sql_execution(query="select p from (select ', p_brand, chr(10)) ELSE '' END) AS r, p_name, p_brand, p_type, p_size FROM @part"""


@query("fn_tool_call_extract", f"""SELECT p_partkey, 0::BIGINT AS pos, 'schema_retrieval' AS tool, p_name AS tbl, 'c' || p_size AS col, p_type AS descr, '' AS q FROM ({CALLS}) a
 UNION ALL SELECT p_partkey, 1, 'sql_draft', '', '', '', 'select count(*) from ' || p_brand FROM ({CALLS}) b
 UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 3 = 0 THEN 'stop' ELSE 'add_schema' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 't' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'u' END, '', '' FROM ({CALLS}) c
 UNION ALL SELECT p_partkey, 3, 'sql_execution', '', '', '', CASE p_partkey % 5 WHEN 1 THEN 'select max(least(a, 1)) from ' ELSE 'select p from (select ' END || p_brand FROM ({CALLS}) d WHERE p_partkey % 5 IN (1, 2)""")
def _(t):
    e = t.sql(CALLS).select("p_partkey", F.posexplode(X.tool_calls(F.col("r"))).alias("pos", "c"))
    return e.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "c.tool", F.col("c.table").alias("tbl"), F.col("c.column").alias("col"),
                    F.col("c.description").alias("descr"), F.col("c.query").alias("q"))


BROKEN = """SELECT p_partkey, concat(chr(123), chr(39), 'name', chr(39), ': ', chr(39), p_name, chr(39), ', ', chr(39), 'ok', chr(39), ': True, ', chr(39), 'x', chr(39), ': None, ', chr(39), 'n', chr(39), ': ', chr(39), CAST(p_size AS STRING), chr(39), ', ', chr(39), 'sub', chr(39), ': ', chr(123), chr(39), 'k', chr(39), ': ', CAST(p_size AS STRING), ', ', chr(39), 'cut', chr(39), ': ', chr(39), 'unfin') AS r, p_name, p_size FROM @part"""


@query("fn_repair_json", f"""SELECT p_partkey, concat('{{"name": "', p_name, '", "ok": true, "x": null, "n": ', p_size, '}}') AS fixed, p_name AS name, p_size::VARCHAR AS k FROM ({BROKEN}) b""")
def _(t):
    fixed = X.repair_json(F.col("r"))
    return t.sql(BROKEN).select("p_partkey", fixed.alias("fixed"), F.get_json_object(fixed, "$.name").alias("name"), F.get_json_object(fixed, "$.n").alias("k"))


# One kind of damage per row: escaped quotes, a quote inside a value, an exponent in quotes, a stray quote and no list, no braces.
DAMAGED = """SELECT p_partkey, p_name, p_size, p_brand, CASE p_partkey % 5
 WHEN 0 THEN concat(chr(123), chr(92), '"k', chr(92), '": ', chr(92), '"', p_name, chr(92), '", ', chr(92), '"n', chr(92), '": ', CAST(p_size AS STRING), ',', chr(125))
 WHEN 1 THEN concat(chr(123), '"k": "', p_name, '" or "', p_brand, '", "n": ', CAST(p_size AS STRING), chr(125))
 WHEN 2 THEN concat(chr(123), '"k": "', p_name, '", "n": "', CAST(p_size AS STRING), 'e0",', chr(125))
 WHEN 3 THEN concat(chr(123), '"k": "', p_name, '", "l": []", "n": array(1, 2), "m": ', CAST(p_size AS STRING), ', "cut": [', chr(123), '"x": "')
 ELSE concat('the key "k": "', p_name, '" and "n": ', CAST(p_size AS STRING), ' or "n": 0') END AS r FROM @part"""


@query("fn_repair_json_rules", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN p_name || ' or ' || p_brand ELSE p_name END AS k,
 CASE p_partkey % 5 WHEN 3 THEN '[]' WHEN 2 THEN p_size || 'e0' ELSE p_size::VARCHAR END AS n, CASE WHEN p_partkey % 5 = 3 THEN '[]' END AS l, CASE WHEN p_partkey % 5 = 3 THEN p_size::VARCHAR END AS m FROM ({DAMAGED}) b""")
def _(t):
    fixed = t.sql(DAMAGED).select("p_partkey", X.repair_json(F.col("r")).alias("j"))
    member = lambda name: F.regexp_extract(F.col("j"), rf'"{name}": (\[\]|[0-9e]+)', 1)
    return fixed.select("p_partkey", F.get_json_object("j", "$.k").alias("k"), member("n").alias("n"), F.nullif(member("l"), F.lit("")).alias("l"), F.nullif(member("m"), F.lit("")).alias("m"))


@query("fn_word_replace", """SELECT request_id, trim(regexp_replace(regexp_replace(' ' || nl_query || ' ', '(?i)([^a-z0-9_])' || d1 || '([^a-z0-9_])', '\\1$A\\2', 'g'), '(?i)([^a-z0-9_])' || d1 || '([^a-z0-9_])', '\\1$A\\2', 'g')) AS q FROM @requests r""")
def _(t):
    return t.requests.select("request_id", F.trim(X.word_replace(F.col("nl_query"), F.col("d1"), F.lit("$A"))).alias("q"))


@query("fn_year_quarter", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q,
 regexp_extract('on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\\b(20[0-9]{2})\\b', 1) AS y FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", X.month_key(d).alias("m"), X.quarter_key(d).alias("q"),
                           X.year_of(F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"))).alias("y"))


@query("fn_map_aliases", """SELECT event_id, 'k' AS anchor, regexp_extract(props, '"k": ([0-9]+)', 1) AS alias FROM events WHERE regexp_matches(props, '"k": [0-9]+')""")
def _(t):
    e = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("anchor", "alias"))
    return e.filter("anchor = 'k'")


QUOTES = """SELECT p_partkey, concat('select Part Size, "part size", part size max from t where order date = ', CAST(p_size AS STRING)) AS q FROM @part"""


@query("fn_quote_spaced", """SELECT p_partkey, concat('select "part size", "part size", "part size max" from t where "order date" = ', p_size) AS q FROM part""")
def _(t):
    return t.sql(QUOTES).select("p_partkey", X.quote_spaced(F.col("q"), ["part size", "order date", "plain", "part size max"]).alias("q"))
