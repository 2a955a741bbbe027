"""MinHash near-dedup by chosen-path set similarity join.

Documents with the same set of shingles are one class. A class has a sketch of SKETCH minwise tokens. Each of TREES
independent trees branches the classes by selected tokens: a node picks tokens by its own hash, a class goes to the child
of each token it has there. Nodes of at most LEAF classes are compared exhaustively by sketch; what may be similar is
handed, once for however many nodes found it, to an exact comparison of the full sets. Larger nodes branch on: two ways
for the first WIDE levels, then 1 + 1/5 ways on average, which keeps a similar pair together in some child about once.
What is still large after DEPTH levels is a crowd of alike classes: its blocks are compared pair by pair, all of them.

A pair of similarity 0.85 shares none of the 8 tokens of the roots, and so is not met, once in four million times;
nothing is capped or sampled.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import arrow_schema, batch_of, durable, join_groups, text_of, whole_groups
from plumbline.llm.components import components
from plumbline.llm.rolling import NONE, WordPrints, mixed, windows

SKETCH, TREES, LEAF, WIDE, DEPTH = 128, 4, 2048, 4, 8
#: Sketches of similar sets agree in the threshold less this share of places, but for one pair in a million.
DOUBT = 0.15
FACTORS = np.random.default_rng(20).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LAST = np.iinfo(np.int64).max


def shingles(text: str, words: int, prints: WordPrints) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles: A-Z lower-cased, words cut at ASCII white space."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return NONE
    return np.unique(windows(prints.of(ws), min(words, len(ws)))[0])


def class_of(found: np.ndarray) -> int:
    """Names a set of shingles, whole and exact but for 64-bit chance."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)))


def sketch(found: np.ndarray) -> tuple[bytes, bytes]:
    """The minwise tokens of a set in 16 bits each; those of the roots in 32 bits, which unlike sets do not share by chance."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        out = np.minimum(out, (found[at : at + 512, None] * FACTORS).min(axis=0))
    tokens = mixed(out)
    return (tokens >> np.uint64(48)).astype(np.uint16).tobytes(), (tokens[: 2 * TREES] >> np.uint64(32)).astype(np.uint32).tobytes()


def sketched(df: DataFrame, words: int, id_col, text_col, key_col=None) -> DataFrame:
    """Per row: doc_id, n_shingles, cls (null for an empty set), sketch, roots; row_key, if asked for; text_key, the text's hash."""
    ddl = "doc_id long,n_shingles long,cls long,sketch binary,roots binary" + ",row_key long" * bool(key_col) + ",text_key long"
    schema = arrow_schema(ddl)

    def run(batches):
        prints = WordPrints()
        for batch in batches:
            rows = []
            for doc_id, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, words, prints)
                rows.append((doc_id, len(found), class_of(found), *sketch(found), *key) if len(found) else (doc_id, 0, None, None, None, *key))
            yield from batch_of(schema, rows).to_batches()

    return text_of(df, id_col, text_col, key_col).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, ddl)


def child(node, place):
    """The child of `node` for the class's token at a place of its sketch."""
    return F.xxhash64(node, place, F.col("sketch").substr(place * 2 + 1, F.lit(2)))


def small_nodes(classes: DataFrame) -> DataFrame:
    """(node, cls, sketch) for all nodes of all trees that are compared: none has more than 2 * LEAF classes."""
    roots = F.array(*[F.xxhash64(F.lit(i // 2), F.lit(i), F.col("roots").substr(4 * i + 1, 4)) for i in range(2 * TREES)])
    live = classes.select("cls", F.explode(roots).alias("node"))
    found = None
    for depth in range(1, DEPTH + 1):
        live = durable(live)
        sizes = live.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        total = live.count()
        sized = durable(join_groups(live, sizes, ["node"], total))
        leaves = sized.filter(F.col("n") <= LEAF).select("node", "cls")
        found = leaves if found is None else found.unionByName(leaves)
        large = sized.filter(F.col("n") > LEAF).select("node", "cls")
        if large.isEmpty():
            return found.join(classes, "cls").select("node", "cls", "sketch")
        if depth < DEPTH:
            picks = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH)).cast("int") for i in (1, 2)]
            ways = [child(F.col("node"), p) for p in picks]
            if depth >= WIDE:
                ways[1] = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(5)) == 0, ways[1])
            live = large.join(classes, "cls").select("cls", F.explode(F.array_compact(F.array(*ways))).alias("node"))
    # crowds: blocks by hash, every pair of blocks a node
    blocks = large.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (LEAF // 2)).cast("int").alias("k"), F.count(F.lit(1)).alias("n"))
    dealt = join_groups(large, blocks, ["node"], large.count()).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    pairs = dealt.select("cls", "node", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    crowd = pairs.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j"), F.lit("crowd")).alias("node"), "cls")
    return found.unionByName(crowd).join(classes, "cls").select("node", "cls", "sketch")


def roots_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For `size` places joined by links a - b the smallest place each reaches."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def suspects(nodes: DataFrame, least: int) -> DataFrame:
    """(gid, cls): groups of classes that sketches call similar, each group once however many nodes hold it."""
    ddl = "gid long,cls long"
    schema = arrow_schema(ddl)

    def run(batches):
        for table in whole_groups(batches):
            node, cls = table.column(0).to_numpy(), table.column(1).to_numpy()
            tokens = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint16).reshape(-1, SKETCH)
            begin = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
            size = np.diff(np.append(begin, len(node)))
            # every row meets the rows behind it in its node
            behind = np.repeat(begin + size, size) - np.arange(len(node)) - 1
            a_found, b_found = [], []
            cut = np.flatnonzero(np.diff(np.cumsum(behind) // 65_536, prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(node))):
                a = np.repeat(np.arange(lo, hi), behind[lo:hi])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind[lo:hi]) - behind[lo:hi], behind[lo:hi])
                near = (tokens[a] == tokens[b]).sum(axis=1) >= least
                a_found.append(a[near])
                b_found.append(b[near])
            a, b = np.concatenate(a_found), np.concatenate(b_found)
            root = roots_of(len(node), a, b)
            members = np.unique(np.concatenate([a, b]))
            order = members[np.lexsort((cls[members], root[members]))]
            cuts = np.flatnonzero(np.diff(root[order], prepend=-1, append=-1))
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                group = np.unique(cls[order[lo:hi]])
                gid = int(np.uint64(xxhash.xxh3_64_intdigest(group.tobytes())).view(np.int64))
                rows += [(gid, c) for c in group.tolist()]
            yield from batch_of(schema, rows).to_batches()

    found = nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, ddl)
    return found.dropDuplicates(["gid", "cls"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sets the first set that it reaches by links of 100 * intersection >= percent * union.

    Sets that are in the most central set's component need no comparison with each other.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else 1])
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    first, ends = np.cumsum(times) - times, np.cumsum(size)
    holders = owner[order]
    label = np.arange(n)

    def compare(i):
        mine = number[ends[i] - size[i] : ends[i]]
        k = times[mine]
        at = np.repeat(first[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        both = np.bincount(holders[at], minlength=n)
        near = 100 * both >= percent * (size[i] + size - both)
        low = label[near].min()
        label[np.isin(label, label[near])] = low

    shared = np.bincount(owner, weights=times[number], minlength=n) / size
    centre = int(shared.argmax())
    done = np.zeros(n, bool)
    compare(centre)
    done[centre] = True
    while len(todo := np.flatnonzero(~done & (label != label[centre]))):
        compare(todo[0])
        done[todo[0]] = True
    return label


def chosen_texts(df: DataFrame, wanted: DataFrame, members: DataFrame, id_col, text_col) -> DataFrame:
    """(text, cls, gids): for each wanted class the text of its first row, by id and hash of the text.

    Rows meet classes by id and text together, so rows that share an id, or have none, are apart. Of rows that share
    both, those that are over a thousandth of all are reduced to one in the tasks that read them.
    """
    kinds = members.filter(F.col("cls").isNotNull()).groupBy("cls", "key", "text_key").agg(F.count(F.lit(1)).alias("n"))
    keeper = kinds.groupBy("cls").agg(F.min(F.struct("key", "text_key", "n")).alias("k")).select("cls", "k.*")
    chosen = durable(wanted.join(keeper, "cls"))
    texts = text_of(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.xxhash64("text").alias("text_key"), "text")
    on, total = ["key", "text_key"], members.count()
    often = chosen.filter(F.col("n") * 1000 > total)
    found = texts.join(chosen.filter(F.col("n") * 1000 <= total), on).select("text", "cls", "gids")
    if often.isEmpty():
        return found
    once = texts.join(F.broadcast(often.select(*on)), on).groupBy(*on).agg(F.first("text").alias("text"))  # fewer than 1,000 rows
    return found.unionByName(once.join(often, on).select("text", "cls", "gids"))


def exact_links(df: DataFrame, groups: DataFrame, members: DataFrame, words: int, percent: int, id_col, text_col) -> DataFrame:
    """Links (a, b) between classes, confirmed on the full sets: in each group a star per component."""
    wanted = groups.groupBy("cls").agg(F.collect_set("gid").alias("gids"))  # a class is in few groups: those of its trees
    ddl = "gid long,cls long,shingles binary"
    schema = arrow_schema(ddl)

    def sets(batches):
        prints = WordPrints()
        for batch in batches:
            for text, cls, gids in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, words, prints)
                if len(found) and class_of(found) == cls:
                    yield from batch_of(schema, [(gid, cls, found.tobytes()) for gid in gids]).to_batches()

    pair = arrow_schema("a long,b long")

    def solve(batches):
        for table in whole_groups(batches):
            gid, cls = table.column(0).to_numpy(), table.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(gid, prepend=gid[0] - 1, append=gid[-1] - 1))
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                names, at = np.unique(cls[lo:hi], return_index=True)
                if len(names) > 1:
                    label = linked([np.frombuffer(table.column(2)[int(lo + i)].as_py(), np.uint64) for i in at], percent)
                    rows += [(int(names[i]), int(names[r])) for i, r in enumerate(label) if i != r]
            yield from batch_of(pair, rows).to_batches()

    full = chosen_texts(df, wanted, members, id_col, text_col).mapInArrow(sets, ddl)
    return full.repartition("gid").sortWithinPartitions("gid").mapInArrow(solve, "a long,b long").distinct()


def near_dedup(df: DataFrame, words=5, percent=80, id_col="doc_id", text_col="text", key_col=None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets of `words` words; a component's
    id is the smallest doc_id in it. Texts of fewer words are one shingle; a null, empty or blank text has none and is a
    component of its own. Repeated rows are linked to each other; a null id is larger than all others (component_id is
    null where there is no other, and kept false). An empty table gives no rows; other columns are ignored.

    With `key_col` there are also row_key, that column of df, and root, which names the component (null: no words) even
    where rows of several components share an id.
    """
    rows = durable(sketched(df, words, id_col, text_col, key_col).withColumn("key", F.coalesce("doc_id", F.lit(LAST))))
    members = rows.select("doc_id", "n_shingles", "cls", "key", "text_key", *["row_key"] * bool(key_col))
    classes = durable(rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("sketch").alias("sketch"), F.first("roots").alias("roots"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))
    groups = durable(suspects(small_nodes(classes.select("cls", "sketch", "roots")), round((percent / 100 - DOUBT) * SKETCH)))
    links = exact_links(df, groups, members, words, percent, id_col, text_col)
    # only links point from class to class; a class alone, and not copied, is its own component
    rooted = durable(classes.select("cls", "key", "n").join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    total = rooted.agg(F.sum("n")).first()[0] or 0
    whole = rooted.groupBy("root").agg(F.min("key").alias("component_id"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    known = durable(join_groups(rooted.withColumnRenamed("n", "copies"), whole, ["root"], total).select("cls", F.col("copies").alias("n"), "component_id", *["root"] * bool(key_col)))
    members = members.drop("text_key")
    out = join_groups(members.filter(F.col("cls").isNotNull()), known, ["cls"], total, how="left").drop("n")
    # rows without shingles have no class to join by; as nulls they would all meet in one task
    out = out.unionByName(members.filter(F.col("cls").isNull()), allowMissingColumns=True)
    component = F.nullif(F.coalesce("component_id", "key"), F.lit(LAST))
    extra = ["row_key", F.coalesce("root", "cls").alias("root")] if key_col else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *extra).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
