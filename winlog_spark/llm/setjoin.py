"""Exact n-gram Jaccard join: the universe of shingles is cut into segments, and similar sets agree on some of them by pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, documents, member_bits, mix, salt_of, stored, tasks_for, text_hash, with_groups, with_member
from .neardup import _PARTS, _full_sets, _set_hash, _sharing_rare, components, confirmed, shingle_sets

PERCENT = 80
#: A band's sizes span this much more than the ratio of similar sets, so that a set meets its own band and the next lower one at most.
BAND = 1.2
#: Segments beyond those that the greatest distance needs, so that few sets run short of them.
SPARE = 6
#: A set whose cheapest segments give more candidates than this for each of its shingles is tried by its rare shingles.
CHEAP = 1
#: Bits of a set's sketch for each shingle that its band allows.
SKETCH_BITS = 4
#: The bitmap that narrows segment keys before their exact join has 2**KEY_BITS bits (8 MB).
KEY_BITS = 26
#: A segment's key is written in this many bits, in two parts, as keys make up most of what is written and moved; a collision adds a candidate.
SHORT_KEY = 40
#: A key with more members than this is dealt over several tasks.
HOT = 1_000


def distance(sizes: int, percent: int) -> int:
    """The greatest symmetric difference of two similar sets whose sizes add up to at most this."""
    return sizes * (100 - percent) // (100 + percent)


def band_bounds(percent: int) -> np.ndarray:
    """The least sizes of the bands."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(int(low[-1] * BAND * 100 / percent) + 1)
    return np.array(low)


def band_segments(percent: int) -> np.ndarray:
    """Into how many segments the universe is cut for each band: enough that every set that meets it can ask for distance + 1 of them."""
    most = band_bounds(percent)[1:] - 1
    return np.array([distance(int(m) * 100 // percent + int(m), percent) + 1 + SPARE + int(m) // 32 for m in most])


def _segment_of(tokens: np.ndarray, segments: np.ndarray) -> np.ndarray:
    return ((mix(tokens ^ _PARTS[2]) >> np.uint64(32)) * segments.astype(np.uint64)) >> np.uint64(32)


def _key(total: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Names the subset of a segment whose tokens' hashes add up to total."""
    return mix(total + mix(band.astype(np.uint64) * _PARTS[3] + segment.astype(np.uint64) * _PARTS[4] + np.uint64(1)))


def segment_keys(sets: list[np.ndarray], bands: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """For sets under given bands: where each set's segments begin, all segments' keys, whether they have tokens, and (token hashes, segment of each, totals)."""
    begin = np.concatenate([[0], np.cumsum(segments)]).astype(np.int64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(sets)), size)
    at = begin[of] + _segment_of(flat, segments[of]).astype(np.int64)
    total, n = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], np.int64)
    own = mix(flat ^ _PARTS[1])
    np.add.at(total, at, own)
    np.add.at(n, at, 1)
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], segments)
    return begin, _key(total, np.repeat(bands, segments), place), n > 0, (own, at, total, place)


def sketches(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set as many bits as its size says (a multiple of 64): each tells whether an odd number of its shingles falls there; and where each set's longs begin.

    A shingle that one of two sets has alone turns one bit, so the sketches differ in at most as many bits as the sets
    differ in shingles: a pair whose sketches differ in more is not similar, for certain.
    """
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = begin[of] + (((mix(flat ^ _PARTS[0]) >> np.uint64(32)) * sizes[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), begin // 64


def _lists(values: np.ndarray, keep: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The kept values as one list for each span of begin."""
    ends = np.concatenate([[0], np.cumsum(keep)])[begin].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[keep], kind))


def _keyed(docs: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """Per row and role: id, text_hash, row, n, h1, h2, role, band, need, spare, keys and tops (lower and upper part of the keys of segments with tokens), blank (segments without), sketch.

    Role 0 is the set under its own band, where it meets sets of that band and larger ones; role 1, of sets that can be
    similar to one of the next lower band, is the set under that band, where it meets the sets of that band only. need is
    how many segments must be asked for.
    """
    low, m = band_bounds(percent), band_segments(percent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches):
            sets = list(shingle_sets(data, off, k))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h2 = np.array([np.bitwise_xor.reduce(mix(s + _PARTS[1])) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            band = np.maximum(np.searchsorted(low, n, side="right") - 1, 0)
            down = np.flatnonzero((band > 0) & (-(-n * percent // 100) < low[band]))
            pick = np.concatenate([np.arange(len(sets)), down])
            role = np.concatenate([np.zeros(len(sets), np.int32), np.ones(len(down), np.int32)])
            bands = band[pick] - role
            segments = np.where(n[pick] > 0, m[bands], 0)
            begin, keys, full, rest = segment_keys([sets[i] for i in pick], bands, segments)
            others = np.where(role == 0, n[pick] * 100 // percent, low[band[pick]] - 1)
            bits = np.where(n[pick] > 0, -(-SKETCH_BITS * low[bands + 1] // 64) * 64, 0)
            words, ends = sketches([sets[i] for i in pick], bits)
            need = (n[pick] + others) * (100 - percent) // (100 + percent) + 1
            take = pa.array(pick)
            columns = [rows.column("id").take(take), rows.column("text_hash").take(take), rows.column("row").take(take), pa.array(n[pick]), pa.array(_set_hash(sets)).take(take), pa.array(h2).take(take), pa.array(role), pa.array(bands.astype(np.int32))]
            keys = keys >> np.uint64(64 - SHORT_KEY)
            lower, upper = keys.astype(np.uint32).view(np.int32), (keys >> np.uint64(32)).astype(np.uint8).view(np.int8)
            columns += [pa.array(need.astype(np.int32)), pa.array((segments - need).astype(np.int32)), _lists(lower, full, begin, pa.int32()), _lists(upper, full, begin, pa.int8()), _lists(rest[3].astype(np.int32), ~full, begin, pa.int32()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.select(id).schema[0].dataType.simpleString()
    schema = f"id {kind}, text_hash long, row long, n long, h1 long, h2 long, role int, band int, need int, spare int, keys array<int>, tops array<tinyint>, blank array<int>, sketch array<long>"
    names = [c.strip().split()[0] for c in schema.split(",")]
    return docs.select(F.col(id).alias("id"), text_hash(F.col(text)).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).mapInArrow(build, schema)


def _each_key(sets: DataFrame) -> DataFrame:
    """(node, role, key) of all segments with tokens."""
    part = sets.select("node", "role", "tops", F.posexplode("keys").alias("_p", "_low"))
    top = F.get("tops", F.col("_p")).cast("long").bitwiseAND(F.lit(255))
    return part.select("node", "role", F.shiftleft(top, 32).bitwiseOR(F.col("_low").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("key"))


def _met(probes: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(a, ra, b, rb): probes (key, node, role, c, cs, n, members) with the nodes of index (the same columns) of components of a higher rank, of a size that fits.

    Rank is the size of a component, then its name; so of two sets that of the smaller component looks for the other, and
    a large group is never asked from within. Two sets under a lower band than their own meet in their own. Members of a
    hot key are dealt over tasks, each of which gets a copy of the key's probes.
    """
    k = F.floor(F.col("members") / HOT).cast("int")
    x = probes.select("key", F.col("node").alias("a"), F.col("role").alias("ra"), F.struct("cs", "c").alias("ca"), F.col("n").alias("na"), F.explode(F.sequence(F.lit(0), k)).alias("_s"))
    y = index.select("key", F.col("node").alias("b"), F.col("role").alias("rb"), F.struct("cs", "c").alias("cb"), F.col("n").alias("nb"), F.pmod(F.xxhash64("node"), k + 1).cast("int").alias("_s"))
    return x.join(y, ["key", "_s"]).where((F.col("ca") < F.col("cb")) & (F.col("ra") + F.col("rb") < 2) & _sized("na", "nb", percent)).select("a", "ra", "b", "rb")


def _near_by_sketch(pairs: DataFrame, info: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b): the pairs (a, ra, b, rb) whose sketches do not show that they are too different."""
    salted = pairs.withColumn("_salt", salt_of("b"))
    end = lambda e: info.select(F.col("node").alias(e), F.col("role").alias(f"r{e}"), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"s{e}"))
    right = salted.join(end("b"), ["b", "rb"]).coalesce(tasks)
    left = salted.select("a", "ra", "_salt").distinct().join(end("a"), ["a", "ra"]).coalesce(tasks)
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = F.col("na") + F.col("nb")
    most = both - 2 * F.ceil(both * percent / (100.0 + percent) - 1e-9)
    return right.join(left, ["a", "ra", "_salt"]).where(differ <= most).select("a", "b").distinct()


def _cheapest(items: DataFrame, order: list[Column], most: Column) -> DataFrame:
    return items.withColumn("_rank", F.row_number().over(Window.partitionBy("node", "role").orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def similar_sets(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: id, text_hash, n_shingles, class_id, component_id. Two rows link when 100 * intersection >= percent * union of their shingle sets.

    1. Rows of one shingle set form a class, a node; one row stands for it.
    2. Sizes are cut into bands, and for each band shingles are dealt by hash into segments. Sets that differ in at most
       H shingles agree on all but H segments; one that asks for H + 1 of them meets every similar set. A set meets others
       of its own band there, and smaller ones in the next lower.
    3. What to ask for is a matter of cost, which is known beforehand: keys are counted, and a segment whose subset no
       other set has is free. Where free segments are enough, and for most sets they are, nothing is looked up.
    4. Members of a key are paired with its hub, the one whose keys have the most members, and components follow from
       what is confirmed on full sets. From then on a set looks for sets of larger components only.
    5. Sets that still need more than their free segments take the cheapest. What meets by few members is sifted by
       sketches that never overstate how much two sets differ. Where the segments have many members, these only say which
       sets can be similar at all, and sets of different components meet by their rarest shingles and sizes instead: a
       copy whose own changes exceed the limit meets none. What is left is confirmed on full sets.
    So links that join components are found for certain, by pigeonhole, whatever the similarity of other pairs; a group of
    n copies gives about n pairs, and beyond those only candidates that agree on enough to be near the limit.

    Null, empty and blank texts have the empty set and are linked with nothing; fewer than k words are one shingle. A null
    id takes no part in links (class and component null). Rows that repeat an id and text share class and component; rows
    of one id with different texts are told apart by text_hash. Very long texts are read whole, a task holds about 1 MB
    of text or one text. Equal costs go by key. An empty table gives no rows; other columns of docs, whatever their
    names, are not read. Shingles are told apart by 64 bits and segments by 40; a collision of segments only adds a candidate.
    """
    keyed = checkpointed(_keyed(docs, id, text, k, percent))
    live = keyed.where("role = 0 and n > 0 and id is not null").select("id", "text_hash", "n", "h1", "h2", "row", F.struct("id", "row").alias("_first"))
    named = stored(with_groups(live, ["h1", "h2"], {"rep": ("min", "_first")}, salt_of("row")).select("id", "text_hash", "n", "h1", "h2", "row", F.col("rep.id").alias("class_id"), (F.col("rep.row") != F.col("row")).alias("spent")))
    # rows that another one stands for go: a bounded bitmap shows most others to stay without a join
    spent = named.where("spent").select("row")
    marked = with_member(keyed.where("n > 0 and id is not null").withColumnRenamed("h1", "node"), F.col("row"), member_bits(spent, "row"), "in")
    reps = marked.where("not in").unionByName(marked.where("in").join(spent, "row", "left_anti"))
    each = _each_key(reps)
    shared = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("role") == 0).alias("members")).where("all > 1 and members > 0").select("key", "members"))
    some = with_member(each, F.col("key"), member_bits(shared, "key", KEY_BITS), "in", KEY_BITS).where("in").drop("in")
    entries = checkpointed(some.join(shared, "key"))
    info = stored(reps.select("node", "id", "role", "band", "n", "need", "spare", F.size("blank").alias("blanks"), "sketch"))
    own = info.where("role = 0").select("node", "id", "n")
    rows = entries.count()
    tasks = tasks_for(rows, 500_000)
    # hubs
    weight = entries.where("role = 0").groupBy("node").agg(F.sum("members").alias("w"))
    ranked = entries.coalesce(tasks).join(weight.coalesce(tasks), "node").select("key", "node", "role", F.when(F.col("role") == 0, F.struct(-F.col("w"), "node")).alias("_first"))
    paired = with_groups(ranked, ["key"], {"hub": ("min", "_first")}, salt_of("node", "role"), None, "inner", tasks)
    pairs = paired.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "role").where("a <> b").groupBy("a", "b", "role").agg(F.count(F.lit(1)).alias("common")).coalesce(tasks)
    # similar sets agree on so many segments with tokens; half of that is asked for here, as a key of the pair may have another hub
    pairs = pairs.join(info.select(F.col("node").alias("b"), "role", F.col("n").alias("bn"), (F.col("spare") + 1 - F.col("blanks")).alias("least")), ["b", "role"]).where("2 * common >= least")
    pairs = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("an")), "a").where(_sized("an", "bn", percent))
    pairs = stored(pairs.select("a", "b").distinct()).coalesce(tasks)
    comp = stored(components(_linked(docs, pairs, own, id, text, k, percent), tasks)).coalesce(tasks)
    # from here on only nodes of other, larger components count
    ranked = stored(with_groups(comp, ["component"], {"cs": ("count", "id")}, salt_of("id")).withColumnRenamed("id", "node")).coalesce(tasks)
    rank = lambda df: df.join(ranked, "node", "left").withColumns({"c": F.coalesce("component", "node"), "cs": F.coalesce("cs", F.lit(1))}).drop("component")
    placed = rank(entries.select("node", "role", "key").coalesce(tasks)).withColumn("_rank", F.struct("cs", "c"))
    opened = with_groups(placed, ["key"], {"lo": ("min", "_rank"), "hi": ("max", "_rank"), "members": ("count", "node")}, salt_of("node", "role"), F.col("lo") < F.col("hi"), "inner", tasks)
    opened = with_groups(opened, ["key", "c"], {"same": ("count", "node")}, salt_of("node", "role"), None, "inner", tasks)
    opened = stored(opened.withColumn("cost", F.when(F.col("_rank") < F.col("hi"), F.col("members") - F.col("same")).otherwise(0)).drop("_rank", "lo", "hi", "same"))
    costly = opened.where("cost > 0")
    asked = info.drop("sketch").join(costly.groupBy("node", "role").agg(F.count(F.lit(1)).alias("_k")), ["node", "role"], "left").withColumn("costly", F.coalesce("_k", F.lit(0))).withColumn("want", F.col("costly") + F.col("blanks") - F.col("spare")).where("want > 0")
    asked = stored(rank(asked.drop("_k", "id"))).coalesce(tasks)
    more = pairs.limit(0)
    if not asked.isEmpty():
        few, many = _candidates(docs, opened.coalesce(tasks), asked, info.drop("sketch"), rank, id, text, k, percent, tasks)
        more = _near_by_sketch(stored(few.distinct()), info, percent, tasks)
        more = more if many is None else more.unionByName(many).distinct()
    more = stored(more).coalesce(tasks)
    late = _linked(docs, more, own, id, text, k, percent)
    of = comp.withColumnRenamed("component", "c")
    named_by = lambda end: of.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    late = late.join(named_by("a"), "a", "left").join(named_by("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = stored(components(late, tasks)).coalesce(tasks)
    # (node, component) of all linked nodes: old components by their new names, and nodes that only the last links reach
    linked = of.join(merged.withColumnRenamed("id", "c"), "c", "left").select(F.col("id").alias("node"), F.coalesce("component", "c").alias("c"))
    linked = linked.unionByName(merged.select(F.col("id").alias("node"), F.col("component").alias("c"))).distinct()
    least = with_groups(linked.join(own.select("node", "id"), "node"), ["c"], {"component_id": ("min", "id")}, salt_of("node"), None, "inner", tasks)
    # back to rows, a hot class by its salts
    salted = named.select("id", "text_hash", "n", "h1", "h2", "class_id", salt_of("row").alias("_salt"))
    known = salted.select(F.col("h1").alias("node"), "_salt").distinct().join(least.select("node", "component_id"), "node").withColumnRenamed("node", "h1")
    done = salted.join(known, ["h1", "_salt"], "left").select("id", "text_hash", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    rest = keyed.where("role = 0 and (n = 0 or id is null)").select("id", "text_hash", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return done.unionByName(rest).select(F.col("id").alias(id), "text_hash", F.col("n").alias("n_shingles"), "class_id", "component_id")


def _sized(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _linked(docs: DataFrame, pairs: DataFrame, own: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, checked on the full sets of the nodes they name."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(own, "node"))
    size = nodes.agg(F.sum("n").alias("n")).first().n
    if not size:
        return pairs.limit(0)
    tasks = tasks_for(size, 2_000_000)
    sets = stored(_full_sets(docs, nodes.select("node", "id"), id, text, k)).coalesce(tasks)
    return stored(confirmed(pairs, sets, percent, tasks))


def _candidates(docs: DataFrame, opened: DataFrame, asked: DataFrame, info: DataFrame, rank, id: str, text: str, k: int, percent: int, tasks: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, ra, b, rb): asked sets a with the sets b of larger components that they meet by the segments they take, and the roles in which they meet; and (a, b) of the sets that would meet too many that way."""
    index = opened.join(info.select("node", "role", "n"), ["node", "role"])
    probes = index.where("cost > 0").join(asked.select("node", "role", "want", "costly"), ["node", "role"])
    probes = stored(_cheapest(probes, [F.col("cost"), F.col("key")], F.col("want")))
    price = probes.groupBy("node", "role").agg(F.sum("cost").alias("price"))
    dear = asked.join(price, ["node", "role"], "left").where((F.col("want") > F.col("costly")) | (F.col("price") > CHEAP * F.col("n")))
    dear = stored(dear.select("node", "role", "band", "spare", "blanks")).coalesce(tasks)
    few = _met(probes.join(dear, ["node", "role"], "left_anti"), index, percent)
    if dear.isEmpty():
        return few, None
    # a similar set has one of the taken segments too, unless the dear one has more empty segments than it can spare
    keys = probes.join(dear.select("node", "role"), ["node", "role"], "left_semi").select("key").distinct()
    near = index.join(keys, "key", "left_semi").select("node").unionByName(dear.select("node"))
    near = near.unionByName(info.join(dear.where("blanks > spare").select("band").distinct(), "band").select("node")).distinct()
    near = stored(rank(info.where("role = 0").select("node", "id", "n").join(near, "node")).select("node", "id", "n", "c")).coalesce(tasks)
    sets = stored(_full_sets(docs, near.select("node", "id"), id, text, k)).coalesce(tasks)
    return few, _sharing_rare(near.drop("id"), sets, percent, tasks).select("a", "b")


def op12_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
       ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
