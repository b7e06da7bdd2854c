"""Near-duplicates of documents by min-max hashing (operator 10).

A document is the set of its distinct word shingles. Under each random permutation both the smallest and the largest value of
the set are kept, so a signature of 2 P values costs P evaluations per shingle; either end agrees between two sets with the
probability of their similarity. Signatures are cut into bands; documents that share a band are candidates.

1. Equal sets form a class, known by a hash of its size and digests (a doc_id may stand for several texts); one text goes on for it.
2. In each band bucket every class is paired with two of the bucket's own, the one of least hash and the one that shares its
   bands with most others (in a group of edited copies that is the one nearest to the original): at most two pairs a row. They are
   confirmed on full sets and linked components are formed.
3. Buckets that still hold several components are settled in full, each distinct set of members once. Those of up to FEW
   members give their pairs, each once over all buckets. Larger ones are dealt to blocks by a hash; a pair of blocks that holds
   several components is one row with the full sets, and a task counts all intersections of a row at once as a matrix product.
   What leaves the task is a spanning forest of the links between different components, so no large bucket is written out as
   pairs, and no link between components that share a bucket is lost. A bucket of one component, however large, gives nothing.

Bands are chosen so that a pair at the least similarity is missed with a probability under MISS.

Defined results: null and empty texts and those without words have no shingles and link with nothing; texts with fewer words than
a shingle are one shingle of all their words; ties go to the smallest doc_id; rows with a null doc_id link with nothing (null
component, kept); rows that repeat a doc_id are rows of their own, each with the links of its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.components import components
from tallyspark.llm.text import NOT_SPACE, Chunk, each_chunk, mix, signed, table_of, text_array, window_hashes, window_rows, word_hashes
from tallyspark.session import cut, discard, has_rows

PERMUTATIONS = 90
MISS = 1e-6
#: Documents, and shingles, of about which a block holds; columns of a matrix of intersections.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 256, 200_000, 4096
#: Members of a bucket that gives its pairs.
FEW = 8
_RANDOM = np.random.default_rng(41)
_XOR = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    hashes, first = word_hashes(chunk, NOT_SPACE, lower=True)
    counts = np.diff(first)
    rows, at = window_rows(first, k)
    shingles = window_hashes(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = []
        for r in short:
            value = np.uint64(counts[r])
            for h in hashes[first[r]:first[r + 1]]:
                value = mix(np.array([value ^ h]))[0]
            whole.append(value)
        rows, shingles = np.concatenate([rows, short]), np.concatenate([shingles, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.searchsorted(rows[new], np.arange(len(chunk) + 1))


def band_rows(threshold: float) -> int:
    """Most values per band that keep the chance of a miss at the threshold under MISS."""
    for r in range(12, 1, -1):
        if (1 - threshold ** r) ** (2 * PERMUTATIONS // r) < MISS:
            return r
    return 1


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, key (hash of the text), n, d1, d2 (two digests of the set) and bands (empty for sets without shingles)."""
    r = band_rows(threshold)
    bands = 2 * PERMUTATIONS // r

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        sets, first = shingle_sets(chunk, k)
        n = np.diff(first)
        full = np.flatnonzero(n)
        digests = np.zeros((2, len(chunk)), dtype=np.uint64)
        values = np.zeros((len(full), 2 * PERMUTATIONS), dtype=np.uint64)
        if len(full):
            at = first[full]
            digests[0, full] = np.add.reduceat(mix(sets), at)
            digests[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5BD1E995C4CEB9FE)), at)
            for p in range(PERMUTATIONS):
                x = (sets ^ _XOR[p]) * _ODD[p]
                values[:, 2 * p] = np.minimum.reduceat(x, at)
                values[:, 2 * p + 1] = np.maximum.reduceat(x, at)
        keys = np.zeros((len(full), bands), dtype=np.uint64)
        for b in range(bands):
            keys[:, b] = np.uint64(b + 1)
            for c in range(b * r, b * r + r):
                keys[:, b] = mix(keys[:, b] ^ values[:, c])
        per_row = np.where(n > 0, bands, 0)
        offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.ravel())))
        return table_of(["doc_id", "key", "n", "d1", "d2", "bands"], [pa.int64()] * 5 + [None],
                        [chunk.ids, chunk.kept["key"], n, signed(digests[0]), signed(digests[1]), lists])

    return each_chunk(_keyed(docs), kernel, "doc_id long, key long, n long, d1 long, d2 long, bands array<long>", keep=["key"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def _texts(docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """cls, text: one text for each of the classes (cls, doc_id, key); `repeated`: whether a row may occur several times."""
    found = _keyed(docs).join(classes, ["doc_id", "key"])
    if not repeated:
        return found.select("cls", "text")
    return found.groupBy("doc_id", "key").agg(F.first("cls").alias("cls"), F.first("text").alias("text")).select("cls", "text")


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar: 100 * intersection >= percent * union. texts: cls, text."""
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            at = 0
            sizes = text_array(batch.column("text_a"))[1] + text_array(batch.column("text_b"))[1]
            while at < batch.num_rows:
                to = max(int(np.searchsorted(sizes, sizes[at] + (2 << 20), side="right")) - 1, at + 1)
                part = batch.slice(at, to - at)
                sets = []
                for name in ("text_a", "text_b"):
                    data, offsets = text_array(part.column(name))
                    sets.append(shingle_sets(Chunk(part.column("a"), data[offsets[0]:offsets[-1]], offsets - offsets[0]), k))
                (x, fx), (y, fy) = sets
                same = np.array([len(np.intersect1d(x[fx[i]:fx[i + 1]], y[fy[i]:fy[i + 1]], assume_unique=True)) for i in range(part.num_rows)])
                union = np.diff(fx) + np.diff(fy) - same
                good = pa.array((100 * same >= percent * union) & (union > 0))
                yield part.select(["a", "b"]).filter(good)
                at = to

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return decided(docs, k, percent).drop("key")


def decided(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """As near_duplicates, with key, the `xxhash64(text)` of the row."""
    signed_docs = cut(signatures(docs, k, percent / 100).withColumn("cls", F.xxhash64("n", "d1", "d2")).drop("d1", "d2"))
    usable = signed_docs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    least = F.min(F.struct("doc_id", "key")).alias("least")
    classes = cut(usable.groupBy("cls").agg(least, F.first("n").alias("n"), F.first("bands").alias("bands"))
                  .select("cls", "n", "bands", "least.doc_id", "least.key"))
    buckets = classes.select("cls", "n", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    # tables of one row per bucket are written before they are joined, so that a bucket with very many rows can be split
    shared = cut(buckets.join(cut(sizes), "band"))
    repeated = has_rows(usable.groupBy("doc_id", "key").count().where(F.col("count") > 1))
    meeting = classes.select("cls", "doc_id", "key").join(shared.select("cls").distinct(), "cls")
    texts = cut(_texts(docs, meeting, repeated))  # of the classes that share a bucket at all
    company = shared.groupBy("cls").agg(F.sum("rows").alias("company"))
    centres = shared.join(company, "cls").groupBy("band").agg(
        F.min(F.struct("cls", "n")).alias("one"), F.min(F.struct((-F.col("company")).alias("c"), "cls", "n")).alias("two"))
    paired = shared.join(cut(centres), "band").select("cls", "n", F.explode(F.array("one", F.struct("two.cls", "two.n"))).alias("other"))
    first_pairs = cut(paired.where(F.col("cls") != F.col("other.cls")).where(_sizes_allow(F.col("n"), F.col("other.n"), percent))
                      .select(F.greatest("cls", "other.cls").alias("a"), F.least("cls", "other.cls").alias("b")).distinct())
    links = cut(confirmed(first_pairs, texts, k, percent))
    stars = components(links)
    more = cut(_links_between_components(shared, stars, texts, k, percent))
    if has_rows(more):
        stars = components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    discard(shared, first_pairs)
    linked = cut(classes.select("cls", "doc_id").join(stars.withColumnRenamed("id", "cls"), "cls").select("cls", "component", "doc_id"))
    smallest = cut(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    member = (classes.select("cls", "doc_id").join(linked.join(smallest, "component").select("cls", "component_id"), "cls", "left")
              .select("cls", F.coalesce("component_id", "doc_id").alias("component_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    in_class = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    spread = F.when(in_class, F.col("cls")).otherwise(F.xxhash64("doc_id", "key"))  # rows of no class, in all partitions
    return (signed_docs.drop("bands").withColumn("cls", spread).join(cut(member), "cls", "left")
            .select("doc_id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """cls, shingles: the full sets of texts (cls, text)."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        sets, first = shingle_sets(chunk, k)
        return pa.RecordBatch.from_arrays([chunk.ids, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(sets)))], names=["cls", "shingles"])

    return each_chunk(texts, kernel, "cls long, shingles array<long>", id_column="cls")


def _intersections(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets, given as (value, row of its set)."""
    _, column, documents = np.unique(values, return_inverse=True, return_counts=True)
    common = documents > 1
    number = np.cumsum(common) - 1
    use = common[column]
    column, row = number[column[use]], row[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    same = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        matrix = np.zeros((n, COLUMNS), dtype=np.float32)
        matrix[row[a:b], column[a:b] - low] = 1
        same += matrix @ matrix.T
    return same.astype(np.int64)


def _links_between_components(shared: DataFrame, stars: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between classes that share a bucket but no component, as many as it takes to connect these."""
    labelled = shared.join(stars, F.col("cls") == F.col("id"), "left").select("band", "cls", "n", F.coalesce("component", "cls").alias("component"))
    mixed = (labelled.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows"),
                                          F.sum("n").alias("all"), F.bit_xor(F.xxhash64("cls")).alias("members"))
             .where(F.col("least") < F.col("most")))
    distinct = cut(mixed.groupBy("rows", "all", "members").agg(F.min("band").alias("band")))
    open_rows = cut(labelled.join(distinct.drop("members"), "band"))
    few = open_rows.where(F.col("rows") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    near = (x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") > F.col("y.cls")) & (F.col("x.component") != F.col("y.component"))
                   & _sizes_allow(F.col("x.n"), F.col("y.n"), percent))
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    some = confirmed(cut(near), texts, k, percent)
    return some.union(_links_in_blocks(open_rows.where(F.col("rows") > FEW), texts, k, percent))


def block_rows(open_rows: DataFrame) -> DataFrame:
    """band, low, high, cls, component, block: members of the pairs of blocks that hold several components."""
    blocks = F.least(F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("all") / BLOCK_SHINGLES)), F.col("rows")).cast("int")
    numbered = open_rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = numbered.select("band", "cls", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", "cls", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    at = ["band", "low", "high"]
    useful = dealt.groupBy(*at).agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") < F.col("most"))
    return dealt.join(useful.select(*at), at, "left_semi")


def _links_in_blocks(open_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    members = cut(block_rows(open_rows))
    sets = cut(_sets(texts.join(members.select("cls").distinct(), "cls", "left_semi"), k))
    gathered = members.join(sets, "cls").groupBy("band", "low", "high").agg(F.collect_list(F.struct("cls", "component", "block", "shingles")).alias("members"))

    def run(batches):
        for batch in batches:
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            a_out, b_out = [], []
            for i in range(batch.num_rows):
                members = batch.column("members").slice(i, 1).flatten()
                cls, component, block = (members.field(c).to_numpy() for c in ("cls", "component", "block"))
                shingles = members.field("shingles")
                sizes = shingles.value_lengths().to_numpy().astype(np.int64)
                same = _intersections(shingles.flatten().to_numpy(), np.repeat(np.arange(len(cls)), sizes), len(cls))
                linked = 100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)
                linked &= component[:, None] != component[None, :]
                linked &= (block[:, None] == low[i]) & (block[None, :] == high[i])
                for x, y in _forest(component, *np.nonzero(linked)):
                    a_out.append(int(cls[x]))
                    b_out.append(int(cls[y]))
            yield table_of(["a", "b"], [pa.int64(), pa.int64()], [a_out, b_out])

    return gathered.select("low", "high", "members").mapInArrow(run, "a long, b long").distinct()


def _forest(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows, enough to connect the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    chosen = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(int(component[x])), root(int(component[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            chosen.append((x, y))
    return chosen
