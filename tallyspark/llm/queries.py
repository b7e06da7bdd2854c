"""The registered queries of the text operators, and their SQL where it can be stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from tallyspark.llm import extraction, language, licenses, media, minhash, mixing, pieces, ranking, scoring, spelling, substrings, toxicity, vectors


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = language.train(docs, _remainder(3) != 1)
    held = docs.withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    return language.predict(held, model, ["held_out"])


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def op3_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model, counts = scoring.train(docs, F.coalesce(_remainder(7) != 2, F.lit(False)))
    held = docs.withColumn("held_out", F.coalesce(_remainder(7) == 2, F.lit(False)))
    return scoring.score(held, model, counts, ["held_out"])


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), _remainder(5) != 0)
    held = docs.withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))
    return toxicity.score(held, model, ["held_out"])


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, folder))


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(_documents(spark, folder))


def op9_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.store_and_read(_documents(spark, folder))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder), k=3, percent=85)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder))


def op12_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{folder}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_licenses": op2_licenses,
    "op3_scoring": op3_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_embeddings": op6_embeddings,
    "op7_mixing": op7_mixing,
    "op8_substrings": op8_substrings,
    "op9_media": op9_media,
    "op10_minhash": op10_minhash,
    "op11_spelling": op11_spelling,
    "op12_ranking": op12_ranking,
    "op13_extraction": op13_extraction,
    "pipeline": corpus_pipeline.run,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_REACHED = """links2 as (select a as x, b as y from links union all select b, a from links),
reached as (select x as id, x as other from (select distinct x from links2) union select r.id, l.y from reached r join links2 l on l.x = r.other),
component as (select id, min(other) as component_id from reached group by id)"""

#: The others depend on trained models, on hashes of Spark's own, or on formats that SQL cannot write; they are tested against plain forms.
ORACLE: dict[str, str] = {
    "op6_embeddings": f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id > y.vec_id and len(x.e) = len(y.e)
  where list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACHED}
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join component on id = vec_id left join (select x, count(*) as n from links2 group by x) on x = vec_id""",
    "op8_substrings": f"""with w as (select doc_id, {_WORDS} as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as t from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
dup as (select doc_id, i from win join (select t, min(doc_id) as least from win group by t) using (t) where least < doc_id),
gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(i, i + 50)) as p from dup) group by doc_id),
kept as (select doc_id, ws, list_filter(ws, lambda x, p: not coalesce(list_contains(ps, p), false)) as ks from w left join gone using (doc_id))
select doc_id, len(ws) as n_words, len(ws) - len(ks) as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept""",
    "op10_minhash": f"""with recursive w as (select doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 2),
n as (select doc_id, count(*) as n from sh group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id > y.doc_id group by 1, 2),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
{_REACHED}
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join component on id = d.doc_id""",
    "op12_ranking": f"""with d as (select doc_id, {_TERMS} as ws from documents),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
size as (select count(*) as n_docs, sum(len(ws))::hugeint as n_words from d where len(ws) > 0),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ws) as n, unnest(ws) as term from d) where term in (select term from q) group by all),
df as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, size group by term, n_docs),
hit as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::bigint as score
  from q join tf using (term) join df using (term), size group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from hit where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10""",
}
