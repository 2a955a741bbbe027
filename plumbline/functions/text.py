"""Column functions over text: normalising, alias matching, extraction."""

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words that are SQL syntax, not columns, in a metric formula.
SQL_WORDS = ["as", "cast", "count", "date", "distinct", "float", "integer", "nullif", "real", "strftime", "substr", "sum"]
# Aggregate names our own catalog may use on top of the fixed words.
EXTRA_SQL_WORDS = ["avg", "min", "max", "median"]

WORD = "[a-z0-9_]"


def lit_list(values):
    """An array literal of strings; the planner folds the split, which is one call however long the list."""
    return F.split(F.lit("\u0001".join(values)), "\u0001") if values else F.array().cast("array<string>")


def normalize(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def identifiers(c, stop=tuple(SQL_WORDS)) -> Column:
    """Sorted distinct identifiers of an expression without literals and SQL words."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "'[^']*'|\"[^\"]*\"", " ")
    found = F.transform(F.regexp_extract_all(bare, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower)
    return F.sort_array(F.array_except(F.array_distinct(found), lit_list(list(stop))))


def alias_pattern(aliases):
    """One regex that finds any of the aliases: whole words for plain ones, anywhere for the others."""
    aliases = list(dict.fromkeys(a for a in (re.sub(r"\s+", " ", (x or "").lower()).strip() for x in aliases) if a))
    words = [a for a in aliases if re.fullmatch(r"[a-z0-9_ ]+", a)]
    parts = [f"(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"] if words else []
    parts += [re.escape(a) for a in aliases if a not in words]
    return "|".join(parts) or r"(?!)"


def contains_any_alias(text: Column, aliases) -> Column:
    """Any alias by the boundary rule; the pattern runs only where one occurs at all."""
    plain = dict.fromkeys(re.sub(r"\s+", " ", (a or "").lower()).strip() for a in aliases)
    occurs = F.lit(False)
    for a in plain:
        if a:
            occurs = occurs | text.contains(a)
    return occurs & text.rlike(alias_pattern(aliases))


def contains_alias(text: Column, alias: Column) -> Column:
    """Same rule with the alias in a column."""
    plain = alias.rlike("^[a-z0-9_ ]+$")
    bounded = F.rlike(text, F.concat(F.lit(f"(?<!{WORD})"), alias, F.lit(f"(?!{WORD})")))
    return (alias != "") & F.when(plain, bounded).otherwise(F.contains(text, alias))


def clean_id(c) -> Column:
    word = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(word, "_+", "_"), "^_|_$", "")


def norm_sql(c) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "--[^\n]*", " "), r"\s+", " ")
    return F.regexp_replace(F.trim(flat), ";+$", "")


def norm_expr(c) -> Column:
    """A select expression without quotes, blanks before casts and a trailing alias."""
    text = F.translate(F.lower(norm_sql(c)), '"`', "")
    text = F.regexp_replace(text, r"\bcast\s*\(", "cast(")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+as\s+[a-z_][a-z0-9_]*$", ""), r"\s+", " "))


def mask_digits(c) -> Column:
    return F.regexp_replace(c, r"[0-9*]*[0-9][0-9*]*|\*+", "*")


def remove_digits(c) -> Column:
    return F.regexp_replace(c, "[0-9]", "")


def stable_hash(c, n=16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def norm_dims(c) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: x != "")))


def clip(c, n, marker="...(truncated)") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def clip_values(values, limit=200, keep=250, take=3) -> Column:
    """First values of a column; if any is long, each one is clipped."""
    long = F.exists(values, lambda v: F.length(v) > limit)
    return F.slice(F.when(long, F.transform(values, lambda v: clip(v, keep))).otherwise(values), 1, take)


def clip_map(m, n=100) -> Column:
    return F.transform_values(m, lambda _, v: clip(v, n))


def drop_value_segment(c) -> Column:
    return F.regexp_replace(c, r"(?m)^(.*?); Column value:[^\n]*?(; Description:[^\n]*)$", "$1$2")


def description_line(c) -> Column:
    return F.trim(F.regexp_extract(F.trim(c), r"(?m)^description:(.*)$", 1))


def tag_text(c, tag) -> Column:
    """Trimmed text of the first <tag>…</tag>, null if there is none."""
    hits = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.regexp_replace(F.get(hits, F.lit(0)), r"^\s+|\s+$", "")


def last_sql_block(c) -> Column:
    hits = F.regexp_extract_all(c, F.lit("(?si)```sql(.*?)```"), F.lit(1))
    return F.regexp_replace(F.try_element_at(hits, F.lit(-1)), r"^\s+|\s+$", "")


def last_question(c) -> Column:
    """Last text after a Q: prefix, up to the first ? or ., or the text in its brackets."""
    # The accepted question prefixes.
    prefix = r"(?:\*\*Q[:：]\*\*|Q[:：]|\*\*Q:\*|Q\*\*:)"
    text = F.regexp_replace(c, "\r\n?", "\n")
    hits = F.regexp_extract_all(text, F.lit(rf"(?i){prefix}\s*\n?\s*(\[[^\[\]]+?\]|.+?[?.])"), F.lit(1))
    last = F.trim(F.try_element_at(hits, F.lit(-1)))
    inner = F.when(last.rlike(r"^\[.*\]$"), F.trim(F.regexp_replace(last, r"^\[|\]$", ""))).otherwise(last)
    return F.regexp_replace(inner, "^'+|'+$", "")


def labelled_field(c, label_regex, value_regex) -> Column:
    """Value after a label such as `safe_condition:`, plain or in bold; 'None' when absent."""
    rx = rf"(?i)(?:\*\*)?(?:{label_regex}):?(?:\*\*)?:?\s*({value_regex})(?=\s|$)"
    value = F.trim(F.translate(F.regexp_extract(c, rx, 1), "*", ""))
    return F.when(value == "", F.lit("None")).otherwise(value)


def safety_flag(c) -> Column:
    """Label in the text after the last colon; empty when nothing can be read."""
    body = F.lower(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)^.*[:：](.+)$", 1)))
    return (
        F.when(F.contains(body, F.lit("unsafe")) | F.contains(body, F.lit("not safe")), "unsafe")
        .when(body.contains("safe") & (body.contains("not") | body.contains("risk")), "unsafe")
        .when(body.contains("safe"), "safe")
        .otherwise("")
    )


def safety_class(c) -> Column:
    """Text of the answer tag, else safe exactly when a fenced block is present."""
    tagged = F.regexp_extract_all(c, F.lit("(?s)<secure_output>(.*?)(?:</secure_output>|$)"), F.lit(1))
    return F.coalesce(
        F.regexp_replace(F.get(tagged, F.lit(0)), r"^\s+|\s+$", ""),
        F.when(c.rlike("(?s)```.*?```"), "safe").otherwise("unsafe"),
    )


def quote_spaced(c, names) -> Column:
    """Quote the given column names that contain blanks, longest first."""
    for name in sorted({n for n in names if " " in n}, key=lambda n: (-len(n), n)):
        c = F.regexp_replace(c, f'(?i)(?<!"){re.escape(name)}(?!")', f'"{name}"')
    return c


def quoted(surface: Column) -> Column:
    """A pattern that matches the text literally, whatever it holds."""
    return F.regexp_replace(surface, r"([^A-Za-z0-9\s\x{80}-\x{10FFFF}])", r"\\$1")


def word_replace(c, surface: Column, replacement: Column) -> Column:
    """Whole-word, case-insensitive replacement; the surface is taken literally."""
    rx = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), quoted(surface), F.lit(r"(?![A-Za-z0-9_])"))
    return F.regexp_replace(c, rx, F.regexp_replace(replacement, r"([\\$])", r"\\$1"))


def tokens(c) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    cjk = F.regexp_extract_all(low, F.lit("([\u4e00-\u9fff]{2,})"), F.lit(1))
    return F.array_union(latin, cjk)


def bigrams(c, keep_blanks=False) -> Column:
    """Distinct pairs of neighbouring characters; linear in the length of the text."""
    text = F.lower(F.coalesce(c, F.lit("")))
    if not keep_blanks:
        text = F.regexp_replace(text, r"\s+", "")
    # a zero-width match at every position, so pairs overlap
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))


def year_of(c) -> Column:
    return F.regexp_extract(c, r"\b(20\d{2})\b", 1)


def month_key(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_key(ts) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


# --- replies of a model -------------------------------------------------------------------------

REPLY = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("dimensions", T.ArrayType(T.StringType())),
        T.StructField("time_window", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The object that starts at the first brace, as text; null when it does not parse."""
    import json

    decoder = json.JSONDecoder()

    def one(text):
        at = text.find("{") if text else -1
        if at < 0:
            return None
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def last_json_object(texts: pd.Series) -> pd.Series:
    """The last balanced object of a text that parses, as text."""
    import json

    def one(text):
        spans, open_at = [], []
        for m in re.finditer("[{}]", text or ""):
            if m.group() == "{":
                open_at.append(m.start())
            elif open_at:
                spans.append((open_at.pop(), m.end()))
        for start, end in reversed(spans):
            try:
                json.loads(text[start:end])
                return text[start:end]
            except ValueError:
                continue
        return None

    return texts.map(one)


def parse_reply(raw, reason_chars=None) -> Column:
    """A model reply as a struct with a parse status; `reason_chars` cuts the reason if it is given.

    Texts that are one whole object stay inside the engine; only others pay for the Python helper.
    """
    text = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?m)^```(?:json)?\s*|\s*```$", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    block = first_json_object(text)
    status = (
        F.when(raw.isNull(), "api_error")
        .when(block.isNull(), "parse_error")
        .when(block == text, "ok")
        .otherwise("ok_first_brace_block")
    )
    as_text = lambda path: F.coalesce(F.get_json_object(block, path), F.lit(""))
    dims = F.from_json(F.get_json_object(block, "$.dimensions"), "array<string>")
    return F.struct(
        status.alias("status"),
        F.lower(F.trim(as_text("$.action"))).alias("action"),
        F.trim(as_text("$.metric_id")).alias("metric_id"),
        F.filter(F.transform(F.coalesce(dims, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda d: d != "").alias("dimensions"),
        F.trim(as_text("$.time_window")).alias("time_window"),
        (as_text("$.reason") if reason_chars is None else F.substring(as_text("$.reason"), 1, reason_chars)).alias("reason"),
    )


def normalize_prediction(status, action, metric_id, dimensions) -> Column:
    """A refusal clears its fields; a reply that did not parse becomes a sentinel answer."""
    bad = status.isin("api_error", "parse_error")
    refuse = action == "refuse"
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(bad | (action == ""), F.lit("answer")).otherwise(action).alias("action"),
        F.when(bad, F.lit("__parse_error__")).when(refuse, F.lit("")).otherwise(metric_id).alias("pred_metric_id"),
        F.when(bad | refuse, none).otherwise(dimensions).alias("pred_dimensions"),
        status.alias("parse_status"),
    )


def parse_json_array(c, element) -> Column:
    """The array of objects in a reply, after fences and control characters are removed."""
    text = F.regexp_replace(F.trim(c), "^```(?:json)?|```$", "")
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), f"array<{element}>")


TOKEN = re.compile(r"""\s*(?:(?P<open>[{\[])|(?P<close>[}\]])|(?P<mark>[,:])|(?P<quote>\\?["'])|(?P<list>array\([^()]*\))|(?P<word>[^\s,:{}\[\]"']+))""")
NUMBER = re.compile(r"(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
LITERALS = {"None": "null", "True": "true", "False": "false", "null": "null", "true": "true", "false": "false"}
PAIRS = [re.compile(r'"([^"]+)":\s*' + value) for value in (r'"([^"]*)"', r"(\d+\.?\d*)", r"(true|false|null)")]


def json_pairs(text: str) -> str:
    """The simple members found anywhere in a text, as one flat object: of texts that have no structure left."""
    import json

    plain = re.sub(r"\s+", " ", text).replace('\\"', '"').replace("'", '"')
    for word in ("None", "True", "False"):
        plain = plain.replace(word, LITERALS[word])
    out = {}
    for kind, pattern in enumerate(PAIRS):
        for key, value in pattern.findall(plain):
            if kind or NUMBER.fullmatch(value) or value in ("true", "false", "null"):
                value = json.loads(value if NUMBER.fullmatch(value) or kind == 2 else f'"{value}"')
            out.setdefault(key, value)
    return json.dumps(out, ensure_ascii=False)


def quoted_at(text: str, at: int, quote: str, ends: str):
    """(content, position behind it) of a string whose quote opened before `at`; None when the text ends inside it.

    A quote closes the string if what may follow a string follows it. Another double quote inside is left out.
    """
    parts, start = [], at
    for m in re.compile(r"\\.|" + re.escape(quote[-1]), re.S).finditer(text, at):
        if m[0] == quote or m[0] == quote[-1]:
            behind = re.compile(r"\s*").match(text, m.end()).end()
            if behind == len(text) or text[behind] in ends:
                parts.append(text[start : m.start()])
                return "".join(parts), m.end()
            if m[0] == '"' or m[0] == '\\"':
                parts.append(text[start : m.start()])
                start = m.end()
    return None


def json_string(content: str) -> str:
    plain = re.sub(r"\s+", " ", content).replace("\\'", "'")
    plain = re.sub(r'\\(?:u[0-9a-fA-F]{4}|["\\/bfnrt])|[\\"]|[\x00-\x1f]', lambda m: m[0] if len(m[0]) > 1 else "\\" + m[0] if m[0] in '\\"' else " ", plain)
    return f'"{plain}"'


def repaired_json(text: str):
    """A broken object or list as JSON text; see repair_json."""
    import json

    try:
        json.loads(text)
        return text.strip()
    except (ValueError, RecursionError):
        pass
    first = re.search(r"[{\[]", text)
    if not first:
        return json_pairs(text)
    # out holds the pieces of the result; a frame is [closing bracket, where its items start in out, a key waits, a comma came]
    out, frames, at, ended = [], [], first.start(), False

    def item(frame):
        frame[1].append(len(out))
        if len(frame[1]) > 1:
            out.append(", ")

    def place(piece, is_key):
        frame = frames[-1]
        if frame[0] == "}" and not frame[2]:
            item(frame)
            out.append((piece if piece.startswith('"') else json_string(piece)) + ": ")
            frame[2] = True
            return
        if not frame[2]:
            item(frame)
        out.append(piece)
        frame[2] = frame[3] = False

    while not ended and (m := TOKEN.match(text, at)):
        at, kind, token = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "open":
            if frames:
                if frames[-1][0] == "}" and not frames[-1][2]:
                    return json_pairs(text)
                if not frames[-1][2]:
                    item(frames[-1])
                frames[-1][2] = frames[-1][3] = False
            out.append(token)
            frames.append(["}" if token == "{" else "]", [], False, True])
        elif kind == "close":
            if frames[-1][0] != token or frames[-1][2]:
                return json_pairs(text)
            out.append(token)
            frames.pop()
            ended = not frames
        elif kind == "mark":
            frames[-1][3] = True
        else:
            wants_key = frames[-1][0] == "}" and not frames[-1][2]
            if kind == "quote":
                if not frames[-1][3] and not frames[-1][2] and re.compile(r"\s*(?:[,}\]]|$)").match(text, at):
                    continue  # a stray quote behind a value
                found = quoted_at(text, at, token, ":" if wants_key else ",}]")
                if found is None:
                    at = len(text)
                    break
                content, at = found
                if wants_key:
                    place(json_string(content), True)
                elif content == "null" or NUMBER.fullmatch(content) and (frames[-1][0] == "}" and "e" not in content.lower() or "e" in content.lower()):
                    place(content, False)
                else:
                    place(json_string(content), False)
            elif kind == "list":
                place("[]", False)
            elif wants_key:
                place(json_string(token), True)
            else:
                place(LITERALS.get(token) or (token if re.fullmatch("-?" + NUMBER.pattern, token) else json_string(token)), False)
    if frames:
        if frames[-1][2]:
            del out[frames[-1][1].pop() :]
            frames[-1][2] = False
        if out[-1] not in ("}", "]"):
            # the cut may have shortened the last member: back to the comma before it
            for level in range(len(frames) - 1, -1, -1):
                if len(frames[level][1]) > 1:
                    if frames[level][0] == "}":
                        del out[frames[level][1].pop() :]
                        del frames[level + 1 :]
                    break
        out += [frame[0] for frame in reversed(frames)]
    fixed = "".join(out)
    try:
        if json.loads(fixed):
            return fixed
    except RecursionError:
        return fixed  # nested too deep for the reader that checks it
    except ValueError:
        pass
    return json_pairs(text)


@F.pandas_udf(T.StringType())
def scanned_json(texts: pd.Series) -> pd.Series:
    """Broken JSON by the scanner; null where there is nothing to repair."""
    return texts.map(lambda t: None if t is None else repaired_json(t))


def repair_json(c) -> Column:
    """JSON text of a reply's object or list, whatever is broken about it.

    A scanner with a stack reads single, doubled and escaped quotes, Python constants, quoted numbers, `array(...)`, stray
    quotes and commas, and closes what a cut left open, without the member that the cut ended in. A text without structure
    gives the simple members found in it as one flat object. Texts that parse stay as they are, inside the engine.
    """
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^(?:\{.*\}|\[.*\])$")
    return F.when(whole, text).otherwise(scanned_json(F.when(~whole, text)))


# The tools a reply may call.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
CALL = re.compile(rf"(?:\A|[{LINE_ENDS}])[^\S{LINE_ENDS}]*(@(?:schema_retrieval|sql_execution|sql_draft|sql_exploration|add_schema)\(|@stop\(\))")
BRACKET = re.compile(r"[()]")


@F.pandas_udf(T.ArrayType(T.StringType()))
def call_blocks(texts: pd.Series) -> pd.Series:
    """Calls of known tools that begin a line, each up to the bracket that closes it, a cut-off one up to the end of the reply."""

    def blocks(text):
        if text is None:
            return None
        out, at = [], 0
        closes, opened = {}, []
        for m in BRACKET.finditer(text):
            if m[0] == "(":
                opened.append(m.start())
            elif opened:
                closes[opened.pop()] = m.end()
        while m := CALL.search(text, at):
            at = closes.get(text.index("(", m.start(1)), len(text))
            out.append(text[m.start(1) : at].rstrip())
        return out

    return texts.map(blocks)


def tool_calls(c) -> Column:
    """@tool(args) blocks of a reply as an array of structs, in order of appearance; brackets nest to any depth.

    A query without quotes, or whose quote is never closed, goes to the end of its call.
    """
    blocks = F.when(c.contains("@"), call_blocks(F.when(c.contains("@"), c))).when(c.isNotNull(), F.array().cast("array<string>"))

    def arg(block, name):
        return F.regexp_extract(block, rf"{name}\s*[:=]\s*[\"']([^\"']*)[\"']", 1)

    def bare(block):
        rest = F.regexp_extract(block, r"(?s)query\s*[:=]\s*[\"']*(.*)$", 1)
        number = lambda ch: F.length(F.replace(block, F.lit(ch), F.lit("")))
        closed = number("(") == number(")")
        return F.trim(F.when(closed, F.regexp_replace(rest, r"[\"']*\s*\)$", "")).otherwise(rest))

    def call(block):
        long_query = F.regexp_extract(block, r'(?s)query\s*[:=]\s*"""(.*?)"""', 1)
        return F.struct(
            F.regexp_extract(block, r"^@(\w+)", 1).alias("tool"),
            arg(block, "table").alias("table"),
            arg(block, "column").alias("column"),
            arg(block, "description").alias("description"),
            F.when(long_query != "", long_query).when(arg(block, "query") != "", arg(block, "query")).otherwise(bare(block)).alias("query"),
        )

    return F.transform(blocks, call)
