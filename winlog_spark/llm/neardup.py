"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index over Hamming distance, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, documents, member_bits, mix, salt_of, stored, tasks_for, text_hash, with_groups, with_member, without_rows, words

#: A signature has CHUNKS chunks of 4 symbols of 16 bits, a chunk to a long.
CHUNKS, SYMBOLS, SYMBOL_BITS = 8, 4, 16
#: By pigeonhole, signatures that differ in at most this many of the 32 symbols have a chunk with at most one error.
MOST_ERRORS = 2 * CHUNKS - 1
#: Pairs that share a key by chance go if their signatures differ in more symbols; at similarity 0.8 that is one pair in 5 million.
LOOSE_ERRORS = MOST_ERRORS + 4
#: Sets whose sizes are within this ratio are one level in the join on rare shingles.
LEVEL = 1.05
SIMILARITY = 80
#: The bitmap that narrows keys before their exact join has 2**KEY_BITS bits (2 MB).
KEY_BITS = 24
_PARTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none give the empty set."""
    w, at = words(data, off)
    run = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for i in range(k):
        run += mix(w[i : i + len(run)] + np.uint64(int(_PARTS[i % 5]) * (i + 1) % (1 << 64)))
    run = mix(run)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = mix(short * _PARTS[0] + w[i : i + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


_SEEDS = mix(np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x CHUNKS longs; empty sets give zeros."""
    size = np.array([len(s) for s in sets])
    some = np.flatnonzero(size)
    out = np.zeros((len(sets), CHUNKS), np.uint64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        begin = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        for j, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat(flat * seed, begin)
            out[some, j // SYMBOLS] |= (mix(least) >> np.uint64(48)) << np.uint64(SYMBOL_BITS * (j % SYMBOLS))
    return out


def _signed(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """Per row: id, text_hash, n (size of the shingle set), h1 and h2 (hashes of the set), sig (array of CHUNKS longs)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches):
            sets = list(shingle_sets(data, off, k))
            sig = pa.FixedSizeListArray.from_arrays(pa.array(signatures(sets).view(np.int64).ravel()), CHUNKS).cast(pa.list_(pa.int64()))
            h2 = np.array([np.bitwise_xor.reduce(mix(s + _PARTS[1])) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_set_hash(sets)), pa.array(h2), sig], names=["id", "text_hash", "n", "h1", "h2", "sig"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text")).mapInArrow(sign, f"id {kind}, text_hash long, n long, h1 long, h2 long, sig array<long>")


def _set_hash(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.add.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)


def _full_sets(docs: DataFrame, nodes: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """(node, set as sorted longs) of the classes in nodes(node, id). A bounded bitmap sorts out most other rows before their set leaves the task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches):
            sets = list(shingle_sets(data, off, k))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_set_hash(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "set"])

    some = with_member(docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text")), F.col("id"), member_bits(nodes, "id"), "in").where("in").select("text")
    return some.mapInArrow(build, "node long, set array<long>").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _keys(c: int, p: int, s: Column) -> Column:
    """The key of a chunk with the symbol at p left open."""
    hole = ((1 << SYMBOL_BITS) - 1) << (SYMBOL_BITS * p)
    return F.xxhash64(F.lit(c * SYMBOLS + p), s.bitwiseAND(F.lit(~hole if hole < 1 << 63 else (~hole) & ((1 << 63) - 1)).cast("long")))


def _errors(x: Column, y: Column) -> Column:
    """In how many of their symbols two signatures differ."""
    symbol = lambda d, p: (F.shiftrightunsigned(d, SYMBOL_BITS * p).bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)) != 0).cast("int")
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda n, d: n + sum((symbol(d, p) for p in range(1, SYMBOLS)), symbol(d, 0)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Of the pairs (a, b, ...), those whose full sets are similar enough; a may be the same for very many.

    Each pair brings the set of its b; the set of an a comes once for each of its salts, so that a hot a is compared by
    SALTS tasks, none of which holds all its rows, and its set is not moved along with every pair.
    """
    salted = pairs.withColumn("_salt", salt_of("b"))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_y")), "b").coalesce(tasks)
    left = salted.select("a", "_salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("set").alias("_x")), "a").coalesce(tasks)
    both = F.size(F.array_intersect("_x", "_y"))
    near = right.join(left, ["a", "_salt"]).where(100 * both >= percent * (F.size("_x") + F.size("_y") - both))
    return near.select(pairs.columns).coalesce(tasks)


def _central(nodes: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """(node, id, w) of nodes(node, id, n): how near a set is to the sum of all sets it shares shingles with, as the cosine of both but for a common factor.

    Of a group of copies the text they stem from has the greatest: each change puts rare shingles in the place of common ones.
    """
    each = sets.select("node", F.explode("set").alias("shingle"))
    df = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1").coalesce(tasks)
    met = each.join(df, "shingle").groupBy("node").agg(F.sum("df").alias("met"))
    return nodes.join(met.coalesce(tasks), "node", "left").select("node", "id", (F.coalesce("met", F.lit(0)) / F.sqrt("n")).alias("w"))


def _sharing_rare(open_nodes: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of open_nodes(node, c, n) with different c that can be similar enough; n is the size of a node's set.

    Shingles are ordered by how few of these sets have them. Two sets of n and m shingles need t of them in common, so
    they share one among the n - t + 1 rarest of one and the m - t + 1 rarest of the other. As t depends on both sizes,
    a set stands as the smaller one of a pair under its own size level, and as the larger one under each level that it
    can be similar to, with the prefix that this level allows: joined on (shingle, level), few pairs meet that do not
    pass the exact test of both places. A copy whose own changes alone exceed the limit shares none of its prefix.
    """
    each = open_nodes.join(sets, "node").select("node", F.explode("set").alias("shingle")).coalesce(tasks)
    # shingles of one set only come first in its order, but meet no other: their number is enough
    df = checkpointed(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = Window.partitionBy("node")
    some = each.join(df, "shingle").select("node", "shingle", F.row_number().over(own.orderBy("df", "shingle")).alias("_r"), F.count(F.lit(1)).over(own).alias("_n"))
    some = some.join(open_nodes, "node").withColumn("r", F.col("n") - F.col("_n") + F.col("_r"))
    common = lambda n, m: F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)
    level = lambda n: F.floor(F.log(n) / F.log(F.lit(LEVEL)))
    n, r = F.col("n"), F.col("r")
    rare = checkpointed(some.where(r <= n - F.ceil(n * percent / 100.0 - 1e-9) + 1).select("shingle", "node", "c", "n", "r")).coalesce(tasks)
    lower = rare.where(r <= n - common(n, n) + 1).select("shingle", level(n).alias("level"), *[F.col(c).alias(f"a{c}") for c in ("node", "c", "n", "r")])
    upper = rare.withColumn("level", F.explode(F.sequence(level(F.ceil(n * percent / 100.0 - 1e-9)), level(n))))
    least = F.greatest(F.lit(1), F.floor(F.pow(F.lit(LEVEL), F.col("level")) * (1 - 1e-9)))
    upper = upper.where(r <= n - common(n, least) + 1).select("shingle", "level", *[F.col(c).alias(f"b{c}") for c in ("node", "c", "n", "r")])
    an, bn = F.col("an"), F.col("bn")
    ordered = (an < bn) | ((an == bn) & (F.col("anode") < F.col("bnode")))
    early = (F.col("ar") <= an - common(an, bn) + 1) & (F.col("br") <= bn - common(an, bn) + 1)
    met = lower.join(upper, ["shingle", "level"]).where((F.col("ac") != F.col("bc")) & ordered & early)
    return met.select(F.col("anode").alias("a"), F.col("bnode").alias("b"), F.col("ac").alias("ca"), F.col("bc").alias("cb")).coalesce(tasks).distinct()


def _stars(pairs: DataFrame, smaller: bool, tasks: int) -> DataFrame:
    """Links that hang neighbours v of each u on the least of them and u: only those above u, or with smaller (where all are below) all of them and u.

    Neighbours are dealt by a salt; the leasts of the shares, at most SALTS for each u, give the least of all, which goes
    back to the shares. So no u has its neighbours in one task.
    """
    part = pairs.withColumn("_salt", salt_of("v")).withColumn("m", F.min("v").over(Window.partitionBy("u", "_salt")))
    tops = part.select("u", "_salt", "m").distinct().withColumn("least", F.least("u", F.min("m").over(Window.partitionBy("u")))).select("u", "_salt", "least")
    known = part.join(tops.coalesce(tasks), ["u", "_salt"])
    links = known.select(F.col("v").alias("u"), F.col("least").alias("v")) if smaller else known.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    links = links.unionByName(tops.select("u", F.col("least").alias("v"))) if smaller else links
    return links.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame, tasks: int = 8, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id that has a link.

    Alternates hooking the larger neighbours and then the smaller ones of each id to its least neighbour; each round is
    written, until each id hangs on one other that hangs on none. No id's neighbours meet in one task, and no link
    reaches the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()).coalesce(tasks)
    for _ in range(most_rounds):
        roles = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_stars(_stars(both, False, tasks), True, tasks)).coalesce(tasks)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """Per row: id, text_hash, n_shingles, class_id, component_id, kept.

    1. Rows of one shingle set form a class, a node, named by the set's hash.
    2. Each node gives 32 keys: each chunk of its signature with each symbol left open. By pigeonhole, signatures within
       MOST_ERRORS share a key. Members of a key are paired with its hub, the member nearest to the sum of all sets met
       (of the smallest id, if several); in a group of copies that is the text they stem from or one close to it. Pairs beyond LOOSE_ERRORS go, all others
       are confirmed on full sets, and components follow.
    3. Of keys that still hold several components, all members of different components are joined on rare shingles by
       their sizes and confirmed too: no link is lost that would join two components.
    So a key of n members gives n - 1 pairs, and the last join only what shares a rare shingle early enough.

    At similarity 0.8 a pair has no key in common, or more than LOOSE_ERRORS, with a probability of about one in a
    million. Documents without words have the empty set, are linked with nothing and are kept; so are very short ones,
    whose whole word sequence is one shingle, unless it is equal. A null id takes no part in links (component null,
    kept). Rows that repeat an id and its text share class and component; rows of one id with different texts are told
    apart by text_hash. Very long texts are read whole; a task holds about 1 MB of text or one text. An empty table gives no rows; other columns of docs, whatever their names, are not read. Nodes
    are told apart by 64 bits.
    """
    signed = checkpointed(_signed(docs, id, text, k))
    live = signed.where("n > 0 and id is not null")
    rep = checkpointed(live.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig")).withColumn("node", F.col("h1")))
    keys = F.explode(F.array(*[_keys(c, p, F.col("sig")[c]) for c in range(CHUNKS) for p in range(SYMBOLS)])).alias("key")
    shared = rep.select(keys).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = with_member(rep.select("node", keys), F.col("key"), member_bits(shared, "key", KEY_BITS), "in", KEY_BITS).where("in").select("node", "key")
    among = checkpointed(with_groups(entries, ["key"], {"size": ("count", "node")}, salt_of("node"), F.col("size") > 1, "inner"))
    # the nodes met and their shingles are what the rest of the work grows with
    met = stored(among.select("node").distinct().join(rep.select("node", "id", "n"), "node"))
    size = met.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles")).first()
    tasks = max(tasks_for(size.nodes, 10_000), tasks_for(size.shingles or 0, 2_000_000))
    sets = checkpointed(_full_sets(docs, met.select("node", "id"), id, text, k)).coalesce(tasks)
    ranked = among.select("key", "node").coalesce(tasks).join(stored(_central(met, sets, tasks)), "node").select("key", "node", F.struct(-F.col("w"), "id", "node").alias("_first"))
    paired = with_groups(ranked, ["key"], {"hub": ("min", "_first")}, salt_of("node"), None, "inner", tasks)
    # what a next step reads several times is written first: plans that hold each other multiply, and the driver keeps them
    pairs = stored(paired.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).where("a <> b").coalesce(tasks).distinct()).coalesce(tasks)
    x, y = (met.select("node").join(rep, "node").select(F.col("node").alias(i), F.col("n").alias(f"{i}n"), F.col("sig").alias(f"{i}sig")).coalesce(tasks) for i in "ab")
    sized = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    # a hub's signature comes once for each of its salts
    pairs = pairs.withColumn("_salt", salt_of("b"))
    hubs = pairs.select("a", "_salt").distinct().join(x, "a").coalesce(tasks)
    pairs = stored(pairs.join(y, "b").join(hubs, ["a", "_salt"]).where(sized & (_errors(F.col("asig"), F.col("bsig")) <= LOOSE_ERRORS)).select("a", "b")).coalesce(tasks)
    comp = stored(components(confirmed(pairs, sets, percent, tasks), tasks)).coalesce(tasks)
    # keys that still hold several components: their members are compared across components
    placed = among.select("key", "node").coalesce(tasks).join(comp.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = with_groups(placed, ["key"], {"lo": ("min", "c"), "hi": ("max", "c")}, salt_of("node"), F.col("lo") < F.col("hi"), "inner", tasks)
    open_nodes = stored(open_keys.select("node", "c").distinct().join(met.select("node", "n"), "node")).coalesce(tasks)
    more = confirmed(stored(_sharing_rare(open_nodes, sets, percent, tasks)).coalesce(tasks), sets, percent, tasks)
    merged = stored(components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")), tasks)).coalesce(tasks)
    # (node, component) of all linked nodes, old components renamed, and those that only the last join has linked
    linked = comp.withColumnRenamed("component", "c").join(merged.withColumnRenamed("id", "c"), "c", "left").select(F.col("id").alias("node"), F.coalesce("component", "c").alias("c"))
    linked = stored(linked.unionByName(merged.select(F.col("id").alias("node"), F.col("component").alias("c"))).distinct()).coalesce(tasks)
    named = with_groups(linked.join(met.select("node", "id"), "node"), ["c"], {"component_id": ("min", "id")}, salt_of("node"), None, "inner", tasks)
    classes = rep.select("h1", "h2", "node", F.col("id").alias("class_id")).join(stored(named.select("node", "component_id")), "node", "left").select("h1", "h2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    salted = live.select("id", "text_hash", "n", "h1", "h2", salt_of("id", "text_hash").alias("_salt"))
    where = salted.select("h1", "h2", "_salt").distinct().join(classes, ["h1", "h2"])
    done = salted.join(where, ["h1", "h2", "_salt"]).select("id", "text_hash", "n", "class_id", "component_id")
    rest = signed.where("n = 0 or id is null").select("id", "text_hash", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return done.unionByName(rest).select(F.col("id").alias(id), "text_hash", F.col("n").alias("n_shingles"), "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """docs with one document, that of the smallest id, of each group of linked documents; columns as they are.

    Rows go by their own verdict: those of one id with different texts are told apart, and repeats of the row that stays
    all stay. Null ids, null and empty texts stay.
    """
    return without_rows(docs, near_duplicates(docs, id, text, k, percent).where("not kept"), id, text)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
       ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' '))) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
