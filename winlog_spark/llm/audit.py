"""What filters do to each other: every order of a set of row filters at once, from counts of failure masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, WORD, checkpointed, documents, salt_of, with_groups

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: few words, many repeated words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row: id, part, mask (bit i set if the row fails filter i of ABCDE), good, toxic.

    E compares whole texts over the whole table: a row fails if a smaller id has the same text. Texts are told apart by
    their SHA-256, which is all that moves; a group of copies is dealt by a salt. Null text counts as empty, a null part
    is the empty string. A row without an id fails E never and makes no other fail it; rows that repeat an id and text do
    not fail by each other. good and toxic hold if any label row of the id says 1; without one, neither. Very long texts
    are counted and hashed where they are read. An empty table gives no rows; other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    fails = text_failures(F.col("_t"))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails.values())), F.lit(0))
    read = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("_t"))
    slim = checkpointed(read.select("id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest")))
    # rows without an id meet no label: they are dealt over other keys of the join
    alone = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_l")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    first = with_groups(slim, ["digest"], {"least": ("min", "id")}, salt_of("id", "part"))
    marked = first.withColumn("_k", alone).join(marks.withColumn("_m", F.lit(0).cast("long")), (F.col("id") == F.col("_l")) & (F.col("_k") == F.col("_m")), "left")
    again = F.when(F.col("id") > F.col("least"), 1 << len(fails)).otherwise(0)
    return marked.select(F.col("id").alias(id), "part", (F.col("mask") + again).alias("mask"), (F.coalesce("_good", F.lit(0)) == 1).alias("good"), (F.coalesce("_toxic", F.lit(0)) == 1).alias("toxic"))


def audit(masks: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step with what the step's filter does there; masks: (part, mask, good, toxic).

    Rows are counted by (part, mask), so that a part has at most 2**len(filters) cells whatever the input, and each cell
    is folded along every order: `aggregate` carries whether a filter has removed the cell, `transform` goes over the
    constant array of orders. The structs of a part's cells, each weighted by its cell's counts, are added element by
    element. shapley is a filter's removed over all orders. No rows in, no rows out.
    """
    orders = list(permutations(range(len(filters))))
    each = F.lit([list(o) for o in orders])
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zero = F.lit(0).cast("long")
    step_type = "array<struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">>"

    def along(cell: Column) -> Column:
        """The cell's structs for all steps of all orders, in the order of `each`."""
        fails = lambda i: F.call_function("shiftright", cell["mask"], i).bitwiseAND(F.lit(1)) == 1
        n, gone = cell["n"], lambda acc: acc["gone"]

        def step(acc: Column, i: Column) -> Column:
            f = fails(i)
            now = f & ~gone(acc)
            only = cell["mask"] == F.call_function("shiftleft", F.lit(1), i)
            values = [F.when(~f & ~gone(acc), n), F.when(now, n), F.when(f & gone(acc), n), F.when(only, n), F.when(now, cell["good"]), F.when(now, cell["toxic"])]
            made = F.struct(*[v.otherwise(zero).alias(name) for v, name in zip(values, FIELDS, strict=True)])
            return F.struct((gone(acc) | f).alias("gone"), F.concat(acc["steps"], F.array(made)).alias("steps"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(step_type).alias("steps"))
        return F.flatten(F.transform(each, lambda order: F.aggregate(order, start, step, lambda acc: acc["steps"])))

    none = F.struct(*[zero.alias(f) for f in FIELDS])
    added = lambda a, b: F.struct(*[(a[f] + b[f]).alias(f) for f in FIELDS])
    total = F.aggregate("cells", F.array_repeat(none, len(orders) * len(filters)), lambda acc, cell: F.zip_with(acc, along(cell), added))
    at = F.flatten(each)
    removed_by = lambda i: F.aggregate(F.zip_with(F.col("steps"), at, lambda s, f: F.when(f == i, s["removed"]).otherwise(zero)), zero, lambda a, x: a + x)
    folded = parts.select("part", total.alias("steps"))
    folded = folded.select("part", "steps", F.transform(F.lit(list(range(len(filters)))), removed_by).alias("_by"))
    rows = folded.select("part", "_by", F.posexplode("steps").alias("_p", "_s"))
    k = len(filters)
    names = F.lit(["".join(filters[i] for i in o) for o in orders])
    return rows.select("part", F.get(names, F.expr(f"_p div {k}").cast("int")).alias("filter_order"), (F.col("_p") % k + 1).cast("int").alias("step"), *[F.col(f"_s.{f}").alias(f) for f in FIELDS], F.get("_by", F.get(at, F.col("_p"))).alias("shapley"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' END,
                    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > least THEN 'E' END) AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o.o AS filter_order, step, o.o[step] AS own, CASE WHEN step = 1 THEN '' ELSE o.o[1:step-1] END AS before FROM o, range(1, 6) r(step)),
m AS (SELECT c.*, s.*, contains(c.fails, s.own) AS hit, s.before <> '' AND regexp_matches(c.fails, '[' || CASE s.before WHEN '' THEN '-' ELSE s.before END || ']') AS gone FROM c, s),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
             CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
