"""Embeddings against all pairs, connected components, the pipeline stage by stage, and the registration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import minhash, pieces, queries, substrings, vectors
from tallyspark.llm.components import components
from tests.llm.conftest import prose


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(300 + i, 300 + (i + 1) % 30) for i in range(30)]
    links += [(7, 7), (None, 3)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            label[q] = p
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(label)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cluster_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        base = rng.normal(size=20)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((base + rng.normal(size=20) * rng.choice([0, 0.05, 0.1, 0.15, 0.2])) * rng.choice([1, 3.0]))
    return [(i, [float(np.float32(v)) for v in x], int(rng.integers(0, 2))) for i, x in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 9])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = cluster_rows(1)
    n = len(rows)
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(3)]
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    odd = [(900, None, 1), (901, [0.0] * 20, 1), (902, [None] + [1.0] * 19, 1), (903, [float("nan")] * 20, 1), (904, [float("inf")] * 20, 1),
           (905, rows[0][1], None), (906, rows[0][1], None), (None, rows[0][1], 1), (907, [], 1), (908, [1.0], 1), (909, [2.0], 1), (910, [1e-30, 0.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    result = vectors.near_duplicates(frame).collect()
    assert len(result) == len(rows) + len(odd)
    got = {r["vec_id"]: r for r in result}
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.99 * linked.sum()
    component = np.arange(len(rows))
    for _ in rows:
        component = np.array([min(component[i], *component[linked[i]], component[i]) if linked[i].any() else component[i] for i in range(len(rows))])
    assert np.mean([got[i]["component_id"] == component[i] for i in range(len(rows))]) >= 0.99
    for i in (900, 901, 902, 903, 904, 905, 906, 907, 910):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[908]["n_links"], got[909]["component_id"]) == (1, 908)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_repeat_a_vec_id_are_rows_of_their_own(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda x: [v + 0.01 for v in x]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, a * 2, 0), (4, a, 1), (5, a * 2, 0), (5, a * 2, 0)]
    got = sorted(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 0, 4, True),
                          (5, 2, 4, False), (5, 2, 4, False)])


def test_recall_on_the_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = frame.collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    linked = (x @ x.T >= 0.9) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame, 0.9).collect()}
    assert sum(got.values()) >= 0.9 * linked.sum()


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    single = stages["near_duplicates"](spark, clean, folder)
    groups = minhash.near_duplicates(clean, 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(r["doc_id"] for r in groups.where("doc_id = component_id").collect())
    cut = stages["substrings"](spark, single, folder)
    left = {r["doc_id"]: (r["n_words"] - r["n_removed"], r["n_removed"]) for r in substrings.digests(single).collect()}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in cut.collect():
        words, gone = left[r["doc_id"]]
        assert len((r["text"] or "").split(" ")) == max(words, 1) if gone else r["text"] == before[r["doc_id"]]
    mixed = stages["mixing"](spark, cut, folder)
    assert mixed.columns == docs.columns
    words = "size(regexp_extract_all(coalesce(text, ''), '[^ \\\\t-\\\\r]+', 0))"
    share = mixed.selectExpr(f"sum({words}) n").first()["n"] / cut.selectExpr(f"sum({words}) n").first()["n"]
    assert share == pytest.approx(1.5, abs=0.1)
    assert stages["sentencepiece"](spark, mixed, folder).count() == mixed.count()


def test_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(3, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns, name
        stage(spark, odd, folder).collect()
        assert stage(spark, none, folder).count() == 0


def test_rows_that_share_a_doc_id_are_told_apart(spark, tmp_path):
    copy, clean = prose(5, 90), prose(6, 90)
    part = " ".join(prose(7, 70).split())
    rows = [(1, copy), (2, copy), (2, clean), (3, None), (3, ""), (4, clean + " x " + part), (5, part + " " + prose(8, 60)), (5, prose(9, 60)), (None, copy)]
    names = ["_own", "_text", "_id", "_key", "_gone", "_copies", "_copy", "_hash", "row", "id", "key", "new_text", "copies", "hash", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_duplicates"](spark, docs, None)
    assert left.columns == docs.columns
    assert sorted(left.select("doc_id", "text").collect(), key=repr) == sorted([tuple(r) for r in rows if r != (2, copy)], key=repr)
    cut = stages["substrings"](spark, left, None)
    assert cut.columns == docs.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr)
    want = [(1, copy), (2, clean), (3, None), (3, ""), (4, "x " + part), (5, prose(8, 60)), (5, prose(9, 60)), (None, copy)]
    assert texts == sorted(want, key=repr)
    mixed = stages["mixing"](spark, cut, None)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(want)
    for r in mixed.collect():
        assert (r["doc_id"], r["text"]) in want
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for n in names)
        assert r["n_chars"] == (7 if r["text"] is None or (r["doc_id"], r["text"]) in [tuple(x) for x in rows] else len(r["text"]))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert stages["toxicity"](spark, docs, str(tmp_path)).columns == docs.columns


def test_members_of_a_bucket_meet_in_few_blocks(spark, monkeypatch):
    """Two very long sets in one bucket are dealt to two blocks, not one for every BLOCK_SHINGLES of theirs."""
    rows = [(7, 1, 20_000_000, 1), (7, 2, 20_000_000, 2)]
    open_rows = spark.createDataFrame(rows, "band long, cls long, n long, component long").withColumns({"rows": F.lit(2).cast("long"), "all": F.lit(40_000_000)})
    seen = minhash.block_rows(open_rows).groupBy("cls").count().collect()
    assert all(r["count"] <= 2 for r in seen)


def test_registration():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES and pieces.default_model().endswith("piece_bpe_32k.model")
