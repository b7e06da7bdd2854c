"""Near-duplicates of embeddings by cross-polytope hashing (operator 6).

Vectors with equal labels are linked if their cosine, in double precision, is at least a limit. Each vector is turned by fast
Hadamard rotations with random signs; the axis of its largest coordinate, with its sign, is a vertex of the cross-polytope, and HASHES of
these are a bucket of one of TABLES tables. A vector also probes the PROBES buckets that it missed by least. Two vectors meet
where one of them is at home and the other one is at home or probes.

1. Equal vectors with equal labels form a class; one vector goes on for each, with the smallest vec_id and the number of its equals.
   From here on a class is known by a hash of its label and digests, as a vec_id may stand for several vectors.
2. Classes meet in buckets; buckets without a meeting drop out before any vector is moved.
3. The members of a bucket are dealt to blocks of about BLOCK by a hash, and every pair of blocks is one row with its vectors. All
   cosines of the row are computed at once. A link is counted only in the first table and bucket where its ends meet, which
   a task sees from the vectors alone. What leaves the row are degrees and a spanning forest of its links, not pairs.
4. Degrees are summed and components are formed from the forests.

Candidates miss few links (the recall is measured in the tests), and every reported one is verified.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link with
nothing and are their own component; vectors of different lengths never link; ties go to the smallest vec_id; rows with a null
vec_id link with nothing (null component, kept); rows that repeat a vec_id are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.components import components
from tallyspark.llm.text import mix, signed, table_of
from tallyspark.session import cut

LEAST_COSINE = 0.98
TABLES, HASHES, PROBES = 6, 2, 3
BLOCK = 1024
#: Rows that are turned at once.
ROWS = 2048
#: (first hash, second hash): which best vertex of each a probe takes.
_STEPS = np.array([(1, 0), (0, 1), (1, 1), (2, 0), (0, 2)])


@lru_cache(maxsize=8)
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(size).choice(np.array([-1.0, 1.0]), (TABLES, HASHES, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """For rows of x: their home bucket (0) and probed buckets (1 ..) in every table, as (rows, TABLES, 1 + PROBES)."""
    n, d = x.shape
    size = max(4, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    padded /= np.linalg.norm(padded, axis=1, keepdims=True)
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.int64)
    rows = np.arange(n)[:, None]
    for t in range(TABLES):
        vertex, gap = [], []
        for h in range(HASHES):
            z = padded
            for s in _signs(size)[t, h]:
                z = hadamard(z * s)
            best = np.argpartition(-np.abs(z), 3, axis=1)[:, :3]
            best = best[rows, np.argsort(-np.abs(z[rows, best]), axis=1, kind="stable")]
            height = np.abs(z[rows, best])
            vertex.append(2 * best + (z[rows, best] < 0))
            gap.append(((height[:, :1] - height) / height[:, :1]) ** 2)
        width = 2 * size
        out[:, t, 0] = vertex[0][:, 0] * width + vertex[1][:, 0]
        cost = gap[0][:, _STEPS[:, 0]] + gap[1][:, _STEPS[:, 1]]
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        out[:, t, 1:] = vertex[0][rows, _STEPS[order, 0]] * width + vertex[1][rows, _STEPS[order, 1]]
    return out


def _matrix(column: pa.Array, at: int, to: int, length: int) -> np.ndarray:
    return column.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(to - at, length)


def _digests(x: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of every row."""
    bits = mix((x + 0.0).view(np.uint64))
    place = np.arange(1, x.shape[1] + 1, dtype=np.uint64)
    return np.stack([mix((mix(bits ^ mix(place * np.uint64(k))) * (2 * place + 1)).sum(axis=1, dtype=np.uint64)) for k in (3, 7)], axis=1)


def hashed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, length, d1, d2 (digests), homes (a bucket per table), probes (all tables) of usable rows."""
    names = ["vec_id", "label", "embedding", "length", "d1", "d2", "homes", "probes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy()
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                for k in range(0, len(part), ROWS):
                    rows = batch.take(pa.array(part[k:k + ROWS]))
                    x = _matrix(rows.column("embedding"), 0, rows.num_rows, int(lengths[part[0]]))
                    b, d = buckets(x), _digests(x)
                    yield table_of(names, [None, None, None, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())],
                                   [rows.column("vec_id"), rows.column("label"), rows.column("embedding"), lengths[part[k:k + ROWS]], signed(d[:, 0].copy()), signed(d[:, 1].copy()),
                                    list(b[:, :, 0]), list(b[:, :, 1:].reshape(len(b), -1))])

    label, embedding = (vectors.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    return vectors.mapInArrow(run, f"vec_id long, label {label}, embedding {embedding}, length int, d1 long, d2 long, homes array<long>, probes array<long>")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links among n rows: each row with the least row of its component, by repeated minimums."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            return [(i, int(j)) for i, j in enumerate(least) if i != j]


def _count_links(ids: np.ndarray, block: np.ndarray, weight: np.ndarray, x: np.ndarray, table: int, bucket: int, pair: tuple[int, int],
                 least_cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted degrees of links that are counted here, and a forest of all links between the two blocks."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    one, two = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    cosine = (x[one] @ x[two].T) / np.outer(norm[one], norm[two])
    i, j = np.nonzero(cosine >= least_cosine)
    a, b = one[i], two[j]
    if pair[0] == pair[1]:
        a, b = a[a < b], b[a < b]
    degree = np.zeros(len(ids), dtype=np.int64)
    if not len(a):
        return degree, []
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    reach = buckets(x)
    home = reach[:, :, 0]
    meets_a = np.zeros((len(a), TABLES), dtype=bool)  # b comes to the home of a
    meets_b = np.zeros((len(a), TABLES), dtype=bool)
    for p in range(1 + PROBES):
        meets_a |= reach[b, :, p] == home[a]
        meets_b |= reach[a, :, p] == home[b]
    meets = meets_a | meets_b
    here = meets[:, table] & (np.argmax(meets, axis=1) == table)
    here &= np.where(meets_a[:, table], home[a, table], home[b, table]) == bucket
    np.add.at(degree, a[here], weight[b[here]])
    np.add.at(degree, b[here], weight[a[here]])
    return degree, _forest(len(ids), a, b)


def near_duplicates(vectors: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = (F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite
            & F.exists("embedding", lambda v: v != 0))
    usable = rows.where(F.coalesce(good, F.lit(False)))
    keys = ["label", "length", "d1", "d2"]
    signed_rows = cut(hashed(usable).withColumn("cls", F.xxhash64(*keys)).drop("d1", "d2"))
    classes = cut(signed_rows.groupBy("cls").agg(
        *[F.first(c).alias(c) for c in ("label", "length", "embedding", "homes", "probes")], F.min("vec_id").alias("rep"), F.count("*").alias("equals")))
    place = F.expr("explode(concat(transform(homes, (b, i) -> struct(i AS table, b AS bucket, true AS home)), "
                   "transform(probes, (b, i) -> struct(CAST(i DIV %d AS INT) AS table, b AS bucket, false AS home))))" % PROBES)
    at = ["label", "length", "table", "bucket"]
    placed = classes.select("label", "length", "cls", "equals", place.alias("p")).select("label", "length", "cls", "equals", "p.table", "p.bucket", "p.home")
    # one row per bucket, written before it is joined, so that a bucket with very many members can be split
    sizes = cut(placed.groupBy(*at).agg(F.count("*").alias("members"), F.max("home").alias("lived_in"))
                .where((F.col("members") > 1) & F.col("lived_in")).drop("lived_in"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = (placed.join(sizes, at).withColumn("blocks", blocks)
           .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    pairs = met.select(*at, "cls", "equals", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        *at, "cls", "equals", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    embedded = pairs.join(classes.select("cls", "embedding"), "cls")
    gathered = embedded.groupBy(*at, "low", "high").agg(F.collect_list(F.struct("cls", "block", "equals", "embedding")).alias("members"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, other_out, links_out = [], [], []
            lists, where = batch.column("members"), batch.select(["table", "bucket", "low", "high", "length"]).to_pylist()
            for k, w in enumerate(where):
                inner = lists.slice(k, 1).flatten()
                ids, block, equals = (inner.field(c).to_numpy() for c in ("cls", "block", "equals"))
                if len(ids) < 2:
                    continue
                x = inner.field("embedding").flatten().to_numpy().astype(np.float64).reshape(len(ids), w["length"])
                degree, forest = _count_links(ids, block, equals, x, w["table"], w["bucket"], (w["low"], w["high"]), least_cosine)
                some = np.flatnonzero(degree)
                ids_out += ids[some].tolist() + [int(ids[a]) for a, _ in forest]
                other_out += [None] * len(some) + [int(ids[b]) for _, b in forest]
                links_out += degree[some].tolist() + [0] * len(forest)
            yield table_of(["cls", "other", "links"], [pa.int64()] * 3, [ids_out, other_out, links_out])

    found = cut(gathered.select("table", "bucket", "low", "high", "length", "members").mapInArrow(run, "cls long, other long, links long"))
    degrees = found.groupBy("cls").agg(F.sum("links").alias("links"))
    stars = components(found.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b")))
    linked = cut(classes.select("cls", "rep").join(stars.withColumnRenamed("id", "cls"), "cls").select("cls", "component", "rep"))
    least = linked.join(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("cls", "component_id")
    known = (classes.select("cls", "rep", "equals").join(degrees, "cls", "left").join(least, "cls", "left")
             .select("cls", (F.coalesce("links", F.lit(0)) + F.col("equals") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    done = signed_rows.select("vec_id", "cls").join(known, "cls").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
