"""Lexical and vector linking of requests to metrics and columns."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import text as X
from plumbline.operators import contract as C, filters as P, scale
from plumbline.sources.catalog import MAX_INLINE, bounded_rows

# Field weights of the rankers.
METRIC_WEIGHTS = [("metric_id", 2.5), ("metric_name", 3.0), ("formula", 1.0), ("description", 1.0), ("aliases", 2.5)]
DIRECT_WEIGHTS = METRIC_WEIGHTS[:2]
LIGHT_WEIGHTS = [("metric_name", 2.0), ("metric_id", 1.0), ("metric_type", 0.8), ("aliases", 2.5)]
PANEL_WEIGHTS = [("metric_name", 3.0), ("metric_id", 0.5), ("aliases", 2.5)]


def field_rows(catalog: DataFrame, weights, key="metric_id", keep=()) -> DataFrame:
    """(key, field text, weight) rows of a catalog, blanks dropped."""
    types = dict(catalog.dtypes)

    def weighted(c, w):
        texts = F.col(c) if types[c].startswith("array") else F.array(F.col(c))
        return F.transform(texts, lambda a: F.struct(a.alias("field"), F.lit(w).alias("weight")))

    each = [weighted(c, w) for c, w in weights]
    rows = catalog.select(key, *keep, F.explode(F.concat(*each)).alias("f"))
    return rows.select(key, *keep, F.lower(F.trim("f.field")).alias("field"), "f.weight").filter("field <> ''")


def text_scores(requests: DataFrame, key, text, fields: DataFrame, target="metric_id", within=(), phrase=5.0, bigram=1.0, blanks=False) -> DataFrame:
    """Weighted overlap of request texts with catalog fields: whole phrase, words, and character pairs over the root of their number.

    The score is a sparse dot product, so words and pairs are joined through an inverted index of the catalog
    and summed; no request meets a field it shares nothing with. `within` are columns both sides must share.
    """
    within = list(within)
    r = requests.select(key, *within, F.lower(F.trim(text)).alias("_q"))
    f = fields.select(target, *within, "field", "weight")
    parts = [F.transform(X.tokens(F.col("field")), lambda x: F.struct(F.concat(F.lit("w:"), x).alias("k"), F.lit(1.0).alias("s")))]
    seen = [F.transform(X.tokens(F.col("_q")), lambda x: F.concat(F.lit("w:"), x))]
    if bigram:
        pairs = X.bigrams(F.col("field"), blanks)
        parts.append(F.transform(pairs, lambda x: F.struct(F.concat(F.lit("b:"), x).alias("k"), (F.lit(bigram) / F.sqrt(F.size(pairs))).alias("s"))))
        seen.append(F.transform(X.bigrams(F.col("_q"), blanks), lambda x: F.concat(F.lit("b:"), x)))
    index = f.select(target, *within, "weight", F.explode(F.concat(*parts)).alias("x")).groupBy(target, *within, F.col("x.k").alias("_k")).agg(F.sum(F.col("weight") * F.col("x.s")).alias("_s"))
    overlap = r.select(key, *within, F.explode(F.concat(*seen)).alias("_k")).join(index, [*within, "_k"]).select(key, target, "_s")
    # a phrase starts with its first two characters, which the request must have
    start = lambda c: F.substring(c, 1, 2)
    heads = F.array_distinct(F.concat(F.regexp_extract_all("_q", F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all("_q", F.lit("(?s)(.)"), F.lit(1))))
    whole = r.withColumn("_k", F.explode(heads)).join(f.withColumn("_k", start("field")), [*within, "_k"]).filter(F.contains("_q", F.col("field"))).select(key, target, (F.col("weight") * phrase).alias("_s"))
    return overlap.unionByName(whole).groupBy(key, target).agg(F.round(F.sum("_s"), 6).alias("score"))


def boosted(scores: DataFrame, requests: DataFrame, key, text, boosts, target="metric_id") -> DataFrame:
    """Add a fixed amount to a target when a request has one of its cue terms."""
    q = F.lower(F.trim(text))
    cues = C.gather([(P.contains_any(q, terms), F.struct(F.lit(m).alias("m"), F.lit(float(x)).alias("x"))) for m, terms, x in boosts], "array<struct<m:string,x:double>>")
    extra = requests.select(key, F.explode(cues).alias("b")).select(key, F.col("b.m").alias(target), F.col("b.x").alias("score"))
    return scores.unionByName(extra).groupBy(key, target).agg(F.round(F.sum("score"), 6).alias("score"))


def rank_topk(scores: DataFrame, key, k, target="metric_id") -> DataFrame:
    """Best targets with a positive score; ties go to the larger id."""
    return scale.first_k(scores.filter("score > 0"), [key], [F.desc("score"), F.desc(target)], k)


def ranked_texts(requests: DataFrame, key, text, fields, k, boosts=(), target="metric_id", **kw) -> DataFrame:
    """(key, target, score, rank) of the k best targets, every target scored that shares something; equal texts once.

    For small catalogs; `ranking.best_targets` gives the same for large ones.
    """
    asked = requests.select(key, F.lower(F.trim(text)).alias("_q")).withColumn("_u", F.md5("_q"))
    texts = asked.filter("_q IS NOT NULL").select("_u", "_q").distinct()
    scores = text_scores(texts, "_u", "_q", fields, target, **kw)
    top = rank_topk(boosted(scores, texts, "_u", "_q", boosts, target) if boosts else scores, "_u", k, target)
    return asked.select(key, "_u").join(top, "_u").drop("_u")


def text_best(texts: DataFrame, key, text, fields, target="metric_id", **kw) -> DataFrame:
    """(key, target): the target with the highest score of each text that has one; ties go to the larger id."""
    scores = text_scores(texts, key, text, fields, target, **kw).filter("score > 0")
    return scores.groupBy(key).agg(F.max_by(target, F.struct("score", target)).alias(target))


def longest_alias(q: Column, phrases) -> Column:
    """Target with the longest whole-word phrase in the text, then the smaller id; empty without one."""
    hit = [(X.contains_any_alias(q, [p]), F.struct(F.lit(-len(p)).alias("n"), F.lit(t).alias("target"))) for t, p in phrases if p.strip()]
    return F.coalesce(F.array_min(C.gather(hit, "array<struct<n:int,target:string>>"))["target"], F.lit(""))


def first_mention(q: Column, phrases) -> Column:
    """Target mentioned first, then by the longer phrase, then the smaller id."""
    hit = [(q.contains(p), F.struct(F.locate(p, q).alias("at"), F.lit(-len(p)).alias("n"), F.lit(t).alias("target"))) for t, p in phrases if p]
    return F.coalesce(F.array_min(C.gather(hit, "array<struct<at:int,n:int,target:string>>"))["target"], F.lit(""))


# --- fuzzy --------------------------------------------------------------------------------------


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits per step."""
    at = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def token_set_ratio(a: set, b: set, need=0.0) -> float:
    """0–100: how far two word sets agree once their common words are set aside; exact from `need` on, below it any less."""
    if not a or not b:
        return 0.0
    both, left, right = sorted(a & b), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not left or not right):
        return 100.0
    base = len(" ".join(both))
    gap = 1 if base else 0
    la, lb = base + gap + len(left), base + gap + len(right)
    total = la + lb
    best = max(100 * (1 - (gap + len(left)) / (base + la)), 100 * (1 - (gap + len(right)) / (base + lb))) if base else 0.0
    if 100 * (1 - abs(len(left) - len(right)) / total) >= max(best, need - 1e-9):
        best = max(best, 100 * (1 - (len(left) + len(right) - 2 * common_length(left, right)) / total))
    return best


#: Texts and aliases of one block.
TEXT_BLOCK, ALIAS_BLOCK = 2048, 4096


def alias_words(s) -> set:
    import re

    return set(re.sub(r"(?ui)\W", " ", s or "").lower().split())


def fuzzy_block(texts, aliases: pd.DataFrame, dimension_floor) -> list:
    """(score, -length, id of the best metric, near dimensions) of each text over one block of aliases (kind, id, alias).

    Aliases that share a word with a text are scored. Of the others those are whose letters, in whatever order, could
    reach the best score so far (a dimension: the floor).
    """
    import re

    kinds, ids = aliases["kind"].tolist(), aliases["id"].tolist()
    words = [alias_words(a) for a in aliases["alias"]]
    sizes = [len(re.sub(r"(?ui)\W", " ", a or "").lower().strip()) for a in aliases["alias"]]
    plain = [" ".join(sorted(w)) for w in words]
    column = {ch: i for i, ch in enumerate(sorted(set("".join(plain))))}
    letters = np.zeros((len(plain), len(column)), np.int32)
    holders = {}
    for i, text in enumerate(plain):
        for ch in text:
            letters[i, column[ch]] += 1
        for w in words[i]:
            holders.setdefault(w, []).append(i)
    lengths = np.array([len(x) for x in plain], float)
    metric = np.array([k == "m" for k in kinds], bool)
    out = []
    for q in texts:
        w = alias_words(q)
        joined = " ".join(sorted(w))
        mine = np.zeros(len(column), np.int32)
        for ch in joined:
            if ch in column:
                mine[column[ch]] += 1
        total = len(joined) + lengths
        bound = 200 * np.minimum(letters, mine).sum(axis=1) / np.where(total > 0, total, 1)
        bound[sorted({i for x in w for i in holders.get(x, ())})] = 200.0  # scored in any case
        best, near = (1.0, 0, ""), set()
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < min(-best[0], dimension_floor) - 1e-9:
                break
            if metric[i]:
                if bound[i] >= -best[0] - 1e-9:
                    best = min(best, (-token_set_ratio(w, words[i], -best[0]), -sizes[i], ids[i]))
            elif ids[i] not in near and bound[i] >= dimension_floor - 1e-9 and token_set_ratio(w, words[i], dimension_floor) >= dimension_floor:
                near.add(ids[i])
        out.append((-best[0], best[1], best[2], sorted(near)))
    return out


def fuzzy_links(texts: DataFrame, text, aliases: DataFrame, metric_floor=60.0, dimension_floor=85.0) -> DataFrame:
    """Best metric and all dimensions per distinct text by word-set similarity, for alias tables of any size.

    `aliases` holds (kind, id, alias), kind 'm' or 'd'. A few aliases go with every batch of texts; of more, blocks of
    texts meet blocks of aliases in tasks of their own, and one row per text and block is merged. Ties of the best metric
    go to the longer alias, then to the smaller id. Without aliases of metrics the score is 0.
    """
    schema = "q string, score double, length long, id string, near array<string>"
    once, table = texts.select(F.col(text).alias("q")).distinct(), aliases.select("kind", "id", "alias").distinct()

    def frame(qs, block):
        found = fuzzy_block(qs, block, dimension_floor)
        return pd.DataFrame([(q, *f) for q, f in zip(qs, found)], columns=["q", "score", "length", "id", "near"])

    few = table.limit(MAX_INLINE + 1).collect()
    if len(few) <= MAX_INLINE:
        block = pd.DataFrame([tuple(r) for r in few], columns=["kind", "id", "alias"])

        def linked(batches):
            for b in batches:
                yield frame(b["q"].tolist(), block)

        parts = once.mapInPandas(linked, schema)
    else:
        n_q, n_a = max(1, -(-once.count() // TEXT_BLOCK)), -(-table.count() // ALIAS_BLOCK)
        deal = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = once.select(deal(["q"], n_q).alias("qb"), every(n_a).alias("ab"), "q")
        right = table.select(every(n_q).alias("qb"), deal(["kind", "id", "alias"], n_a).alias("ab"), "kind", "id", "alias")
        meet = lambda qs, block: frame(qs["q"].tolist(), block)
        parts = left.groupBy("qb", "ab").cogroup(right.groupBy("qb", "ab")).applyInPandas(meet, schema)
    # a block without a metric says -1, so that it loses to any that has one
    best = F.min(F.struct((-F.col("score")).alias("s"), "length", "id"))
    merged = parts.groupBy("q").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("dimensions"))
    score = F.greatest(-F.col("b.s"), F.lit(0.0))
    return merged.select(F.col("q").alias(text), F.when(score >= metric_floor, F.col("b.id")).otherwise("").alias("metric_id"), score.alias("score"), "dimensions")


# --- dimensions ---------------------------------------------------------------------------------


def explicit_dimensions(scope: Column, rules, collapse=()) -> Column:
    """Dimensions whose phrase occurs, in rule order; `collapse` drops others when one is present."""
    found = F.array_distinct(C.gather([(P.contains_any(scope, phrases), F.lit(d)) for d, phrases in rules]))
    for finer, drop in collapse:
        found = F.when(F.array_contains(found, finer), F.array_except(found, X.lit_list(drop))).otherwise(found)
    return found


def cue_scope(q: Column, markers=(" by ", " each ")) -> Column:
    """Text after the first cue; the period words stand for themselves; empty without a cue."""
    out = F.when(q.contains("monthly"), "month").when(q.contains("quarterly"), "quarter").otherwise("")
    for m in reversed(markers):
        out = F.when(q.contains(m), F.coalesce(C.after(q, m), F.lit(""))).otherwise(out)
    return out


def group_cue_dimensions(requests: DataFrame, key, text, columns: DataFrame, limit, allowed: DataFrame = None) -> DataFrame:
    """Best-scored columns of requests that have a grouping cue, kept when the metric allows them."""
    # Words that announce a grouping.
    cues = [" by ", " per ", " each ", " for each ", " for every ", "group", "distribution", "breakdown", "ranked by", "monthly", "yearly"]
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    asked = requests.filter(P.contains_any(padded, cues))
    scores = text_scores(asked, key, text, columns, target="column", bigram=0.0)
    top = rank_topk(scores, key, limit, "column").select(key, "column")
    return top.join(allowed, [key, "column"], "left_semi") if allowed is not None else top


# --- vectors ------------------------------------------------------------------------------------


#: Queries and vectors of a small block, either of the largest, blocks of a side between the two, and distances held at a time.
QUERY_BLOCK, VECTOR_BLOCK, LARGE_BLOCK, DEALT, AT_ONCE = 2048, 2048, 65_536, 12, 1 << 20


def blocks_of(n: int, small: int) -> int:
    """Blocks of one side: small ones up to DEALT, then as many that grow up to the largest, then as many of those as it takes.

    A side goes to every block of the other, so with a fixed number of blocks the rows moved grow as the tables do.
    """
    return max(1, min(-(-n // small), DEALT), -(-n // LARGE_BLOCK))


def nearest_of(q: np.ndarray, qids, v: np.ndarray, names: np.ndarray, k: int):
    """(query, name, distance) of the k nearest vectors of each query, by distance rounded to six places, then name.

    Matrix products tell which vectors may be among them; those are measured exactly.
    """
    if not len(v):
        return [], [], []
    out_q, out_n, out_d, vv, k = [], [], [], (v * v).sum(axis=1), min(k, len(v))
    step = max(1, AT_ONCE // len(v))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        qq = (part * part).sum(axis=1)
        rough = np.maximum(qq[:, None] + vv[None] - 2 * (part @ v.T), 0)
        # distances that round alike, and what the product may be off by
        reach = (np.sqrt(np.partition(rough, k - 1, axis=1)[:, k - 1]) + 2e-6) ** 2 + 1e-11 * (qq + vv.max()) + 1e-12
        for i, near in enumerate(rough <= reach[:, None]):
            cand = np.flatnonzero(near)
            d = np.round(np.sqrt(((v[cand] - part[i]) ** 2).sum(axis=1)), 6)
            best = np.lexsort((names[cand], d))[:k]
            out_q += [qids[at + i]] * len(best)
            out_n.append(names[cand[best]])
            out_d.append(d[best])
    return out_q, np.concatenate(out_n), np.concatenate(out_d)


def vector_topk(vectors: DataFrame, vec_id, embedding, queries: DataFrame, k, query_id="query_id") -> DataFrame:
    """Exact L2 nearest vectors of any number of queries.

    A few queries go to every batch of vectors. More are dealt into blocks, and so are the vectors: each block of
    queries meets each block of vectors in a task of its own, and only k rows per query and block are shuffled on.
    """
    schema = T.StructType([queries.schema[query_id], vectors.schema[vec_id], T.StructField("distance", T.DoubleType())])
    v = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
    q = queries.select(query_id, F.col("vector").alias("q"))
    # vectors travel in the type they have and are measured in doubles
    matrix = lambda column: np.stack(column.to_numpy()).astype("float64")
    frame = lambda found: pd.DataFrame(dict(zip((query_id, vec_id, "distance"), found)))
    asked = q.count()
    if asked <= MAX_INLINE:
        rows = [(r[0], r[1]) for r in q.collect()]
        ids, few = [r[0] for r in rows], np.array([r[1] for r in rows], float)

        def nearest(batches):
            for b in batches:
                if len(b) and ids:
                    yield frame(nearest_of(few, ids, matrix(b["v"]), b["id"].to_numpy(), k))

        return scale.first_k(v.mapInPandas(nearest, schema), [query_id], ["distance", vec_id], k)
    n_q, n_v = blocks_of(asked, QUERY_BLOCK), blocks_of(v.count(), VECTOR_BLOCK)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(deal(query_id, n_q).alias("qb"), every(n_v).alias("vb"), F.col(query_id).alias("qid"), "q")
    right = v.select(every(n_q).alias("qb"), deal("id", n_v).alias("vb"), "id", "v")

    def block(qs, vs):
        if not len(qs) or not len(vs):
            return frame((qs["qid"].iloc[:0], vs["id"].iloc[:0], np.zeros(0)))
        return frame(nearest_of(matrix(qs["q"]), qs["qid"].tolist(), matrix(vs["v"]), vs["id"].to_numpy(), k))

    near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(block, schema)
    return scale.first_k(near, [query_id], ["distance", vec_id], k)


def vector_next_page(vectors: DataFrame, vec_id, embedding, queries: DataFrame, used: DataFrame, most_used, k, query_id="query_id") -> DataFrame:
    """Next k vectors of each query after the ones already returned, at most `most_used` per query."""
    near = vector_topk(vectors, vec_id, embedding, queries, k + most_used, query_id).drop("rank")
    left = near.join(used.select(query_id, vec_id).distinct(), [query_id, vec_id], "left_anti")
    return scale.first_k(left, [query_id], ["distance", vec_id], k)


def page_status(page: DataFrame, used: DataFrame, total: DataFrame, k, query_id="query_id") -> DataFrame:
    """Used, remaining and completion per query after a page; `total` has one row (total)."""
    got = page.groupBy(query_id).agg(F.count(F.lit(1)).alias("got"))
    before = used.groupBy(query_id).agg(F.count(F.lit(1)).alias("before"))
    n = bounded_rows(total, 1)[0]["total"]
    s = got.join(before, query_id, "left").withColumn("used_count", F.col("got") + F.coalesce("before", F.lit(0))).withColumn("remaining", F.lit(n) - F.col("used_count"))
    return s.select(query_id, "used_count", "remaining", ((F.col("got") < k) | (F.col("remaining") <= 0)).alias("is_complete"))
