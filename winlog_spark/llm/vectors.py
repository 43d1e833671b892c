"""Product codes of vectors by integer k-means, nearest entries found exactly over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, salt_of, with_groups
from .kdtree import usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Coefficients that are looked at between two eliminations.
STEP = 2


def sequency_order(m: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size m (a power of two) by their number of sign changes."""
    i = np.arange(m)
    parity = np.zeros((m, m), np.int64)
    for b in range(max(1, m.bit_length())):
        parity ^= (i[:, None] >> b & 1) & (i[None, :] >> b & 1)
    return np.argsort((parity[:, 1:] != parity[:, :-1]).sum(axis=1), kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of integers, of a power of two in length, transformed by butterflies of sums and differences; natural order."""
    x = x.copy()
    h, m = 1, x.shape[1]
    while h < m:
        y = x.reshape(len(x), m // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), m)
        h *= 2
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros up to the next power of two."""
    m = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.concatenate([x, np.zeros((len(x), m - x.shape[1]), x.dtype)], axis=1) if m > x.shape[1] else x


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the index of the nearest entry, ties to the lower index, and the squared distance; exact in integers.

    Over transformed rows of length m squared differences add up to m times the squared distance, so a sum over the
    first coefficients in order of sequency is a lower bound. The entry of the least bound over the first of them is
    worked out whole; what exceeds it goes, and so on after every STEP coefficients.
    """
    n, k = len(parts), len(entries)
    m = 1 << max(0, parts.shape[1] - 1).bit_length()
    # the largest sum is m * m * (m * width)**2; beyond 64 bits Python's integers take over
    width = max(int(max(abs(int(parts.max(initial=0))), abs(int(parts.min(initial=0))))), int(max(abs(int(entries.max(initial=0))), abs(int(entries.min(initial=0))))))
    kind = np.int64 if 4 * m**3 * width**2 < 1 << 62 else object
    order = sequency_order(m)
    p, e = (walsh_hadamard(padded(x.astype(kind)))[:, order] for x in (parts, entries))
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    d = p[:, None, :STEP] - e[None, :, :STEP]
    so_far = (d * d).sum(axis=2)
    guess = so_far.astype(np.float64).argmin(axis=1) if kind is object else so_far.argmin(axis=1)
    d = p - e[guess]
    bound = (d * d).sum(axis=1)
    so_far = so_far.ravel()
    for at in range(STEP, m + STEP, STEP):
        live = so_far <= bound[row]
        row, entry, so_far = row[live], entry[live], so_far[live]
        if at < m:
            d = p[row, at : at + STEP] - e[entry, at : at + STEP]
            so_far = so_far + (d * d).sum(axis=1)
    # what is left has a whole sum of at most the guess's; the least counts, of equal ones the first
    best = np.full(n, -1, np.int64)
    least = bound.copy()
    if kind is object:
        for r, s in zip(row.tolist(), so_far.tolist(), strict=True):
            least[r] = min(least[r], s)
    else:
        np.minimum.at(least, row, so_far)
    hit = so_far == least[row]
    best[row[hit][::-1]] = entry[hit][::-1]
    return best, least // m


@dataclass
class Codebooks:
    """entries: for each part a list of entries, each a list of whole numbers."""

    entries: list[list[list[int]]]
    length: int

    @property
    def part_length(self) -> int:
        return -(-self.length // len(self.entries)) if self.entries else 0

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def cut(self, rows: np.ndarray) -> list[np.ndarray]:
        w = self.part_length
        return [rows[:, j * w : (j + 1) * w] for j in range(len(self.entries))]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances."""
        found = [nearest(x, np.array(e, dtype=object).reshape(len(e), x.shape[1]) if x.dtype == object else np.array(e, np.int64).reshape(len(e), x.shape[1])) for x, e in zip(self.cut(rows), self.entries, strict=True)]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _whole(vectors: pa.Array, scale: int, length: int) -> np.ndarray:
    """Rows of floor(scale * x), zeros after their end; Python's integers where 64 bits could not hold what comes of them."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(vectors), length), np.float64)
    at = np.repeat(np.arange(len(vectors)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[at] = flat
    if np.abs(flat).max(initial=0) < 1 << 40:
        return out.astype(np.int64)
    return np.array([[int(x) for x in r] for r in out], dtype=object).reshape(out.shape)


def _kept(vectors: DataFrame, id: str, embedding: str, *more: Column) -> DataFrame:
    return vectors.where(usable(F.col(embedding))).select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), *more)


def learn_codebooks(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all vectors: the parts of the smallest ids' vectors first, then so many rounds of assignment and floor means.

    Each round is one pass; a task hands on sums and counts for each part and entry, and parts * entries rows of sums are
    all that the driver sees. Vectors that are null or hold null or non-finite components take no part. The longest vector
    sets the length, cut into equal parts of the next whole length; shorter ones go on with zeros. An id that occurs
    with several vectors starts one entry, with the least of them; a null id comes last. With fewer ids there are
    fewer entries; without vectors there are none. Sums are exact whatever their size.
    """
    rows = _kept(vectors, id, embedding)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each task its smallest ids, each with its least vector, and the greatest length
        best, longest = {}, -1
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            longest = max(longest, int(size.max(initial=-1)))
            keys = b.column(0).to_pylist()
            rank = sorted(range(len(keys)), key=lambda i, keys=keys: (keys[i] is None, keys[i] or 0))
            seen, some = set(), []
            for i in rank:
                seen.add(keys[i])
                if len(seen) > entries:
                    break
                some.append(i)
            for i in some:
                v = b.column(1)[i].as_py()
                best[keys[i]] = min(best.get(keys[i], v), v)
            best = {x: best[x] for x in sorted(best, key=lambda x: (x is None, x or 0))[:entries]}
        if longest >= 0:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.float64())), pa.array([longest] * len(best), pa.int32())], names=["id", "v", "length"])

    each = rows.mapInArrow(firsts, "id long, v array<double>, length int")
    start = each.groupBy("id").agg(F.min("v").alias("v"), F.max("length").alias("length")).orderBy(F.col("id").asc_nulls_last()).limit(entries)
    longest = each.agg(F.max("length").alias("n"))
    first = start.drop("length").join(longest).orderBy(F.col("id").asc_nulls_last()).collect()
    if not first:
        return Codebooks([], 0)
    books = Codebooks([[] for _ in range(parts)], first[0].n)
    width = books.part_length * parts
    whole = _whole(pa.array([r.v for r in first], pa.list_(pa.float64())), scale, width)
    books.entries = [[[int(x) for x in r] for r in part] for part in books.cut(whole)]
    for _ in range(rounds):
        means = _means(rows, books, scale, width)
        books = Codebooks([[means.get((j, c), e) for c, e in enumerate(part)] for j, part in enumerate(books.entries)], books.length)
    return books


def _means(rows: DataFrame, books: Codebooks, scale: int, width: int) -> dict[tuple[int, int], list[int]]:
    """Floor means of the parts that each entry is nearest to."""
    w = books.part_length

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for b in batches:
            x = _whole(b.column(0), scale, width)
            codes, _ = books.assign(x)
            for j, part in enumerate(books.cut(x)):
                for c in np.unique(codes[:, j]).tolist():
                    own = part[codes[:, j] == c]
                    sums[j, c] = sums.get((j, c), 0) + own.sum(axis=0, dtype=object)
                    counts[j, c] = counts.get((j, c), 0) + len(own)
        keys = [(j, c, i) for j, c in sums for i in range(-1, w)]
        values = [counts[j, c] if i < 0 else int(sums[j, c][i]) for j, c, i in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([str(v) for v in values], pa.string())], names=["part", "entry", "at", "total"])

    partial = rows.select("v").mapInArrow(add_up, "part int, entry int, at int, total string")
    # one row for each number of the codebooks
    total = partial.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {(r.part, r.entry, r["at"]): int(r.total) for r in total}
    return {(j, c): [by[j, c, i] // by[j, c, -1] for i in range(w)] for j, c, at in by if at < 0}


def compress(vectors: DataFrame, books: Codebooks, id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per vector: id, code (array of entry indexes by part), part_errors (squared distances), and the columns of keep.

    Vectors that learn_codebooks leaves out are left out; each repeated row has a row of its own, also without an id.
    """
    rows = _kept(vectors, id, embedding, *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    names = [f"k{i}" for i in range(len(keep))]
    width = books.part_length * len(books.entries)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not books.entries or not len(b):
                continue
            codes, errors = books.assign(_whole(b.column(1), scale, width))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * codes.shape[1]), pa.array(x, kind)) for x, kind in ((codes.astype(np.int32).ravel(), pa.int32()), ([int(e) for e in errors.ravel()] if errors.dtype == object else errors.ravel(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, *[b.column(2 + i) for i in range(len(names))]], names=["id", "code", "part_errors", *names])

    schema = ", ".join(["id long", "code array<int>", "part_errors array<long>", *[f"{n} {kinds[n]}" for n in names]])
    return rows.mapInArrow(encode, schema).select(F.col("id").alias(id), "code", "part_errors", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def decompress(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with `approximation`: the entries that a code names, one after the other, scaled back and cut to the vectors' length."""
    table = F.lit([[[x / scale for x in e] for e in part] for part in books.entries])
    return codes.withColumn("approximation", F.slice(F.flatten(F.zip_with(table, F.col(code), lambda part, c: F.get(part, c))), 1, books.length))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = learn_codebooks(vectors)
    add = lambda a, x: a + x
    rows = checkpointed(compress(vectors, books, keep=("label",)).withColumn("error", F.aggregate("part_errors", F.lit(0).cast("long"), add)))
    rows = rows.select("vec_id", F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "").alias("code"), "error", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")).alias("_label"))
    out = with_groups(rows, ["_label"], {"label_error": ("sum", "error")}, salt_of("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL for vectors of one length that the number of parts divides, distances worked out whole."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT x.rn, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY x.rn, x.part, c.entry),
a{r} AS MATERIALIZED (SELECT rn, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rn, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT x.part, a.entry, x.pos, sum(x.v) AS s, count(*) AS n FROM x JOIN a{r} a ON a.rn = x.rn AND a.part = x.part GROUP BY x.part, a.entry, x.pos),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
        FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, label, embedding FROM embeddings
      WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
l AS (SELECT max(len(embedding)) // {parts} AS w FROM k),
i AS (SELECT rn, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({scale} * embedding[i]::DOUBLE) AS HUGEINT) AS v FROM k, l, range(1, {parts} * w + 1) t(i)),
x AS MATERIALIZED (SELECT * FROM i),
f AS (SELECT rn, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM (SELECT vec_id, arg_min(rn, embedding) AS rn FROM k GROUP BY vec_id) ORDER BY vec_id NULLS LAST LIMIT {entries}),
c0 AS MATERIALIZED (SELECT x.part, f.entry, x.pos, x.v FROM x JOIN f ON f.rn = x.rn),{','.join(steps)},
e AS (SELECT rn, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn)
SELECT k.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN e ON e.rn = k.rn
"""


OP11_SQL = codes_sql()
