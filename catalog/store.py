"""Queries of the document store, intake, page and sheet operators."""

from pyspark.sql import functions as F

from catalog.views import sql
from tallyspark.functions import text
from tallyspark.operators import intake, pages, statement_merge, store
from tallyspark.sources import records as r
from tallyspark.session import run_path
from tallyspark.sources import tabular
from tallyspark.sources.keyed import KeyedTable
from tallyspark.sources.records import Records

QUERIES, ORACLE = {}, {}
NAMES = {n: n for n in ("orders", "customer", "events", "documents", "lineitem")}


def ctes(**parts):
    return "with " + ",\n".join(f"{name} as ({body.format(**NAMES)})" for name, body in parts.items()) + "\n"


LATEST = "select * from {t} qualify row_number() over (partition by {k} order by created_at desc, id desc) = 1"


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


def docs(spark, folder):
    return Records(spark, folder).records(r.DOCS, "orders")


@register("terminal_documents", ctes(x=r.DOCS) + """select doc_id, status, created_at from x
  where status in ('VALID', 'INVALID', 'NEEDS_REVIEW', 'COMPLETED', 'FAILED') order by created_at desc, doc_id desc""")
def terminal_documents(spark, folder):
    return store.newest_first(store.terminal_documents(docs(spark, folder))).select("doc_id", "status", "created_at")


@register("documents_in_list", ctes(x=r.DOCS) + """select doc_id, country, source from x
  where upper(trim(coalesce(country, 'INDIA'))) = 'USA' and coalesce(source, 'MANUAL') = 'MANUAL'""")
def documents_in_list(spark, folder):
    return store.in_list(docs(spark, folder), "USA", "MANUAL").select("doc_id", "country", "source")


@register("list_neighbours", ctes(x=r.DOCS) + """select doc_id, lag(doc_id) over w as prev_id, lead(doc_id) over w as next_id
  from x where upper(trim(coalesce(country, 'INDIA'))) <> 'USA' window w as (order by created_at desc, doc_id desc)""")
def list_neighbours(spark, folder):
    return store.neighbours(store.in_list(docs(spark, folder), "INDIA"))


@register("source_chip_counts", ctes(x=r.DOCS) + """select coalesce(s, 'ALL') as source, n from (
  select coalesce(source, 'MANUAL') as s, count(*) as n from x where upper(trim(coalesce(country, 'INDIA'))) = 'USA' group by rollup(1))""".replace(
    "group by rollup(1)", "group by rollup(coalesce(source, 'MANUAL'))"))
def source_chip_counts(spark, folder):
    return store.source_counts(docs(spark, folder), "USA")


@register("connection_outcomes", ctes(x=r.DOCS) + """select source_connector_id, count(*) as total,
  count_if(status not in ('VALID', 'INVALID', 'NEEDS_REVIEW', 'COMPLETED', 'FAILED')) as in_progress,
  count_if(status in ('VALID', 'COMPLETED')) as ready, count_if(status = 'NEEDS_REVIEW') as needs_review,
  count_if(status = 'INVALID') as invalid, count_if(status = 'FAILED') as failed
from x where source_connector_id is not null group by 1""")
def connection_outcomes(spark, folder):
    return store.outcome_counts(docs(spark, folder))


@register("visible_connections", ctes(x=r.CONNECTIONS) + """select connection_id, status, cast(oauth_state_created_at as varchar) as stamp, max_messages
  from x where status not in ('PENDING', 'DISCONNECTED')""")
def visible_connections(spark, folder):
    shown = store.visible_connections(Records(spark, folder).records(r.CONNECTIONS, "customer"))
    return shown.select("connection_id", "status", F.date_format("oauth_state_created_at", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "max_messages")


@register("stale_pending_purged", ctes(x=r.CONNECTIONS) + """select connection_id, status from x where not (status = 'PENDING'
  and (oauth_state_created_at is null or oauth_state_created_at < timestamp '2024-01-01 00:20:00'))""")
def stale_pending_purged(spark, folder):
    rows = Records(spark, folder).records(r.CONNECTIONS, "customer")
    return store.without_stale_pending(rows, F.lit("2024-01-01 00:30:00").cast("timestamp")).select("connection_id", "status")


@register("interrupted_runs_closed", ctes(x=r.RUNS) + """select run_id, case when status = 'RUNNING' then 'FAILED' else status end as status,
  case when status = 'RUNNING' then 'Interrupted by a server restart' else error_message end as error_message,
  case when status = 'RUNNING' then '2024-02-01' else finished_at end as finished_at from x""")
def interrupted_runs_closed(spark, folder):
    runs = Records(spark, folder).records(r.RUNS, "events")
    return store.reaped_runs(runs, F.lit("2024-02-01")).select("run_id", "status", "error_message", "finished_at")


@register("abandoned_documents_failed", ctes(x=r.DOCS) + """select doc_id, case when source = 'CONNECTOR' and status in ('SAVING', 'CONVERTING',
  'PREPROCESSING', 'ANALYZING_COMPLEXITY', 'ROUTING', 'ROUTED', 'OCR_RUNNING', 'EXTRACTING', 'EXTRACTED', 'VALIDATING') then 'FAILED' else status end as status from x""")
def abandoned_documents_failed(spark, folder):
    return store.reaped_documents(docs(spark, folder)).select("doc_id", "status")


def _kept(spark, rows, *keys):
    """Rows as the first version of a stored table."""
    table = KeyedTable(spark, run_path(spark, "kept"), rows.schema, keys)
    table.change(1, rows)
    return table


@register("stale_pending_stored", ORACLE["stale_pending_purged"])
def stale_pending_stored(spark, folder):
    table = _kept(spark, Records(spark, folder).records(r.CONNECTIONS, "customer"), "connection_id")
    store.purge_stale_pending(table, 2, F.lit("2024-01-01 00:30:00").cast("timestamp"))
    return table.read().select("connection_id", "status")


@register("interrupted_runs_stored", ORACLE["interrupted_runs_closed"])
def interrupted_runs_stored(spark, folder):
    table = _kept(spark, Records(spark, folder).records(r.RUNS, "events"), "run_id")
    store.reap_runs(table, 2, F.lit("2024-02-01"))
    return table.read().select("run_id", "status", "error_message", "finished_at")


@register("abandoned_documents_stored", ORACLE["abandoned_documents_failed"])
def abandoned_documents_stored(spark, folder):
    table = _kept(spark, docs(spark, folder), "doc_id")
    store.reap_documents(table, 2)
    return table.read().select("doc_id", "status")


@register("latest_extraction", ctes(x=r.EXTRACTIONS) + "select doc_id, id, created_at, invoice_json from (" + LATEST.format(t="x", k="doc_id") + ")")
def latest_extraction(spark, folder):
    rows = Records(spark, folder).records(r.EXTRACTIONS, "orders")
    return store.latest(rows, ["doc_id"], ["created_at", "id"]).select("doc_id", "id", "created_at", "invoice_json")


@register("current_document_state", ctes(x=r.LOG) + "select document_id, step, status, id from (" + LATEST.format(t="x", k="document_id") + ")")
def current_document_state(spark, folder):
    rows = Records(spark, folder).records(r.LOG, "events")
    return store.latest(rows, ["document_id"], ["created_at", "id"]).select("document_id", "step", "status", "id")


def stored(spark, folder):
    t = Records(spark, folder)
    return (t.records(r.EXTRACTIONS, "orders"), t.records(r.VALIDATIONS, "orders"), t.records(r.OCR_RUNS, "orders"),
            t.records(r.PAGES, "orders"), t.records(r.FINALS, "orders"), t.records(r.CORRECTIONS, "orders"))


STORED = dict(docs=r.DOCS, ex0=r.EXTRACTIONS, va0=r.VALIDATIONS, oc0=r.OCR_RUNS, pg=r.PAGES, fin=r.FINALS, cor=r.CORRECTIONS,
              ex=LATEST.format(t="ex0", k="doc_id"), va=LATEST.format(t="va0", k="doc_id"), oc=LATEST.format(t="oc0", k="doc_id"))


@register("review_assembly", ctes(**STORED) + """select doc_id, docs.status, filename, coalesce(country, 'INDIA') as country,
  coalesce(ocr_engine, engine) as ocr_engine, case when coalesce(page_count, 0) <> 0 then page_count else coalesce(n, 0) end as page_count,
  coalesce(paths, '') as page_paths,
  coalesce(cast(json_extract(case when coalesce(invoice_json, '') = '' then '{}' else invoice_json end, '$.invoice') as varchar), '{}') as invoice,
  coalesce(nullif(confidence_json, ''), '{}') as confidence, coalesce(va.status, 'PENDING') as validation_status,
  coalesce(nullif(rule_checks_json, ''), '[]') as rule_checks, coalesce(nullif(warnings_json, ''), '[]') as warnings,
  coalesce(nullif(errors_json, ''), '[]') as errors
from docs left join ex using (doc_id) left join va using (doc_id) left join oc using (doc_id)
left join (select doc_id, count(*) as n, string_agg(coalesce(nullif(preprocessed_path, ''), original_path), '|' order by page_number) as paths
           from pg group by 1) p using (doc_id)""")
def review_assembly(spark, folder):
    ex, va, oc, pg, _, _ = stored(spark, folder)
    out = store.review(docs(spark, folder), pg, ex, va, oc)
    return out.withColumn("page_paths", F.array_join("page_paths", "|"))


@register("review_submit", ctes(**STORED, new="select * from cor qualify row_number() over (partition by doc_id order by submitted_at desc) = 1") + """
select doc_id, corrected_invoice as invoice, coalesce(nullif(confidence_json, ''), '{}') as confidence, coalesce(va.status, 'PENDING') as validation_status,
  coalesce(cast(json_extract(case when coalesce(invoice_json, '') = '' then '{}' else invoice_json end, '$.metadata') as varchar), '{}') as metadata, submitted_at
from new left join ex using (doc_id) left join va using (doc_id)
union all select * from fin where doc_id not in (select doc_id from new)""")
def review_submit(spark, folder):
    ex, va, _, _, fin, cor = stored(spark, folder)
    return store.submitted(fin, cor, ex, va)


@register("review_submit_stored", ORACLE["review_submit"])
def review_submit_stored(spark, folder):
    ex, va, _, _, fin, cor = stored(spark, folder)
    table = _kept(spark, fin, "doc_id")
    store.submit(table, 2, cor, ex, va)
    return table.read()


@register("export_output", ctes(**STORED) + """select doc_id, coalesce(f.invoice, e.j) as output, case when f.invoice is not null then 'final' else 'extraction' end as origin
from docs left join fin f using (doc_id) left join (select doc_id, coalesce(nullif(invoice_json, ''), '{}') as j from ex) e using (doc_id)
where coalesce(f.invoice, e.j) is not null""")
def export_output(spark, folder):
    ex, _, _, _, fin, _ = stored(spark, folder)
    return store.export_json(docs(spark, folder), fin, ex)


@register("nested_document_scan", ctes(**STORED) + """select doc_id, id, json_extract_string(j, '$.invoice.invoice_number') as invoice_number,
  cast(json_extract(j, '$.invoice.version') as bigint) as version, cast(json_extract(j, '$.metadata.pages') as bigint) as pages
from (select doc_id, id, coalesce(nullif(invoice_json, ''), '{}') as j from ex0)""")
def nested_document_scan(spark, folder):
    schema = "invoice struct<invoice_number: string, version: bigint>, metadata struct<pages: bigint>"
    parsed = F.from_json(store.given(F.col("invoice_json"), "{}"), schema, {"mode": "PERMISSIVE"})
    return stored(spark, folder)[0].withColumn("j", parsed).select(
        "doc_id", "id", "j.invoice.invoice_number", "j.invoice.version", "j.metadata.pages")


@register("extraction_patched", ctes(**STORED, pt="select doc_id, 'new coa' as coa, case when doc_id % 3 = 0 then 'new ledger' end as ledger from docs where doc_id % 6 = 0 or doc_id % 5 = 0") + """
select coalesce(ex.doc_id, pt.doc_id) as doc_id, bank_statement, coalesce(pt.coa, ex.coa) as coa, coalesce(pt.ledger, ex.ledger) as ledger
from ex full join pt on ex.doc_id = pt.doc_id""")
def extraction_patched(spark, folder):
    patch = docs(spark, folder).filter("doc_id % 6 = 0 or doc_id % 5 = 0").select(
        "doc_id", F.lit("new coa").alias("coa"), F.when(F.col("doc_id") % 3 == 0, "new ledger").alias("ledger"))
    return store.patched(stored(spark, folder)[0], patch)


@register("schema_migration", ctes(x=r.DOCS) + """select doc_id, coalesce(source, 'MANUAL') as source, coalesce(country, 'INDIA') as country,
  cast(null as varchar) as doc_type, 0 as skipped_inline from x""")
def schema_migration(spark, folder):
    additions = {"source": ("string", "MANUAL"), "country": ("string", "INDIA"), "doc_type": ("string", None), "skipped_inline": ("int", 0)}
    once = store.migrated(docs(spark, folder), additions)
    return store.migrated(once, additions).select("doc_id", *additions)


@register("repeated_source_refs", ctes(x=r.DOCS) + """select source_connector_id, source_ref, count(*) as n from x where source_ref is not null
  group by 1, 2 having count(*) > 1""")
def repeated_source_refs(spark, folder):
    return store.repeated_source_refs(docs(spark, folder))


@register("ingest_codes", ctes(x=r.DOCS) + """select doc_id, coalesce(source, 'MANUAL') as source,
  case when upper(trim(country)) in ('USA', 'INDIA') then upper(trim(country)) else 'INDIA' end as country from x""")
def ingest_codes(spark, folder):
    return docs(spark, folder).select("doc_id", text.source_code(F.col("source")).alias("source"), text.country_code(F.col("country")).alias("country"))


@register("engine_routing", ctes(x=r.DOCS) + """select doc_id, case when must_use_llm then 'OPENAI_VISION_LLM' when complexity_score <= 60 then 'TESSERACT'
  else 'OPENAI_VISION_LLM' end as engine from x""")
def engine_routing(spark, folder):
    return docs(spark, folder).select("doc_id", pages.engine_choice(F.col("must_use_llm"), F.col("complexity_score")).alias("engine"))


MODES = """m as (select doc_id, x.status, case when must_use_llm or complexity_score > 60 then 'OPENAI_VISION_LLM' else 'TESSERACT' end as engine,
  case when must_use_llm or complexity_score > 60 or doc_id % 8 = 0 or doc_id % 9 = 0 then 'DIRECT_LLM' when complexity_score > 40 then 'OCR_THEN_LLM_WITH_VISION'
       else 'OCR_THEN_LLM' end as mode from x)"""


def moded(spark, folder):
    engine = pages.engine_choice(F.col("must_use_llm"), F.col("complexity_score"))
    body = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise("text")
    return docs(spark, folder).withColumn("engine", engine).withColumn("mode", pages.processing_mode(
        F.col("engine"), F.col("doc_id") % 8 == 0, body, F.col("complexity_score")))


@register("processing_modes", ctes(x=r.DOCS) + "," + MODES + "select doc_id, engine, mode from m")
def processing_modes(spark, folder):
    return moded(spark, folder).select("doc_id", "engine", "mode")


@register("vision_retry_queue", ctes(x=r.DOCS) + "," + MODES + "select doc_id, mode from m where status = 'INVALID' and engine <> 'OPENAI_VISION_LLM'")
def vision_retry_queue(spark, folder):
    return pages.vision_retry_candidates(moded(spark, folder)).select("doc_id", "mode")


@register("ocr_attempt_chosen", ctes(x=r.OCR_RUNS) + """, a as (select *, case engine when 'TESSERACT' then confidence < 60 else confidence < 0.7 end as low_confidence from x)
select doc_id, attempt, engine, confidence, low_confidence from a
qualify row_number() over (partition by doc_id order by case when low_confidence then 1 else 0 end, case when low_confidence then -attempt else attempt end) = 1""")
def ocr_attempt_chosen(spark, folder):
    return pages.chosen_attempt(Records(spark, folder).records(r.OCR_RUNS, "orders"))


@register("document_kinds", ctes(x=r.TYPED_DOCS, h="""select doc_id, """ + " + ".join(f"contains(u, '{w}')::int" for w in pages.SA_KEYWORDS)
          + " + regexp_matches(u, '\\bW[0-9]{{1,2}}\\b')::int as sa, " + " + ".join("contains(u, '" + w.replace("'", "''") + "')::int" for w in pages.SO_KEYWORDS)
          + " as so from (select doc_id, upper(text) as u from x)") + """select doc_id, case when sa > so then 'SA' when so > sa then 'SO' else 'UNKNOWN' end as kind,
  case when sa = so then 0.0::double else 0.4::double end as confidence from h""")
def document_kinds(spark, folder):
    kind, confidence = pages.document_kind(F.col("text"))
    return Records(spark, folder).records(r.TYPED_DOCS, "documents").select("doc_id", kind.alias("kind"), confidence.alias("confidence"))


FEATURE_SQL = """s as (select doc_id, page, case when width is null then 20.0 else least(100.0,
    case when line_count > 6 then 20 when line_count > 2 then 10 else 0 end + case when dark_ratio > 0.15e0 then 15 when dark_ratio > 0.08e0 then 8 else 0 end
    + case when gap_regions > 1 then 15 * least(gap_regions / 3, 1.0e0) else 0 end + case when laplacian_var < 100 then 20 when laplacian_var < 300 then 10 else 0 end
    + case when region_count > 200 then 20 when region_count > 80 then 10 else 0 end + case when width < 800 or height < 600 then 10 else 0 end) end as score,
  case when width is null then ['unreadable_page'] else list_filter([
    case when line_count > 6 then 'complex_table_structure' when line_count > 2 then 'simple_table_structure' end,
    case when dark_ratio > 0.15e0 then 'high_text_density' when dark_ratio > 0.08e0 then 'medium_text_density' end,
    case when gap_regions > 1 then 'multi_column_layout' end,
    case when laplacian_var < 100 then 'possible_handwriting_or_low_quality' when laplacian_var < 300 then 'moderate_image_quality' end,
    case when region_count > 200 then 'many_distinct_regions' when region_count > 80 then 'moderate_regions' end,
    case when width < 800 or height < 600 then 'low_resolution' end], lambda t: t is not null) end as reasons from x)"""


@register("page_complexity", ctes(x=r.FEATURES) + "," + FEATURE_SQL + "select doc_id, page, cast(score as double) as score, array_to_string(reasons, '|') as reasons from s")
def page_complexity(spark, folder):
    scores = pages.page_scores(Records(spark, folder).records(r.FEATURES, "documents"))
    return scores.withColumn("reasons", F.array_join("reasons", "|"))


@register("document_complexity", ctes(x=r.FEATURES) + "," + FEATURE_SQL + """, m as (select doc_id, coalesce(avg(cast(score as double)), 0.0) as mean from documents left join s using (doc_id) group by 1)
select doc_id, floor(mean * 10 + 0.5) / 10 as score, case when mean <= 40 then 'SIMPLE' when mean <= 60 then 'MEDIUM' when mean <= 80 then 'HIGH' else 'VERY_HIGH' end as level,
  coalesce(rs, '') as reasons
from m left join (select doc_id, string_agg(distinct q, '|' order by q) as rs from (select doc_id, unnest(reasons) as q from s) group by 1) using (doc_id)""")
def document_complexity(spark, folder):
    t = Records(spark, folder)
    out = pages.document_complexity(t.raw("documents"), pages.page_scores(t.records(r.FEATURES, "documents")))
    return out.withColumn("reasons", F.array_join("reasons", "|"))


def ocr_items(spark, folder):
    """Even documents: words with a confidence of 0 to 100; odd ones: lines from 0 to 1. Every 17th was not recognised at all."""
    docs = Records(spark, folder).raw("documents").filter("doc_id % 17 <> 0")
    by_line = F.col("doc_id") % 2 == 1
    items = docs.select("doc_id", F.posexplode(F.when(by_line, F.split("text", "\n")).otherwise(F.split("text", " "))).alias("at", "text"))
    conf = (F.col("doc_id") * 31 + F.col("at") * 7) % 101
    return items.select("doc_id", F.floor(F.col("at") / 200).alias("page"), "at", "text", F.when(by_line, conf / 128).otherwise(conf.cast("double")).alias("conf"))


@register("ocr_rollup", r"""with w as (select doc_id, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as pos
  from (select doc_id, string_split(text, case when doc_id % 2 = 1 then chr(10) else ' ' end) as ws from documents where doc_id % 17 <> 0)),
c as (select doc_id, pos // 200 as page, text, (doc_id*31 + pos*7) % 101 as conf,
  trim(text) <> '' and (doc_id % 2 = 1 or (doc_id*31 + pos*7) % 101 > 0) as counts from w),
r as (select doc_id, count(distinct page) as pages, coalesce(sum(case when not counts then 0 when doc_id % 2 = 1 then
    len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) else 1 end), 0)::bigint as word_count,
  coalesce(avg(case when doc_id % 2 = 1 then conf / 128.0 else conf end) filter (counts), 0.0) as confidence from c group by 1)
select d.doc_id, coalesce(pages, 0) as pages, coalesce(word_count, 0) as word_count, coalesce(confidence, 0.0) as confidence,
  coalesce(confidence, 0.0) < case when d.doc_id % 2 = 1 then 0.7 else 60 end as low_confidence
from documents d left join r using (doc_id)""")
def ocr_rollup(spark, folder):
    documents = Records(spark, folder).raw("documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 1, "PADDLEOCR").otherwise("TESSERACT").alias("engine"))
    return pages.ocr_rollup(ocr_items(spark, folder), documents)


@register("document_page_text", """select doc_id, replace(text, chr(10) || chr(10), chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10)) as text from documents""")
def document_page_text(spark, folder):
    parts = Records(spark, folder).raw("documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "text"))
    return pages.document_text(parts)


# ---- intake -----------------------------------------------------------------
REFS_SQL = """l as (select *, message_id || ':' || part_index || ':' || filename as source_ref,
  case when filename like '%.txt' then 'SKIPPED_UNSUPPORTED' when size_bytes > 15728640 then 'SKIPPED_UNSUPPORTED'
    when size_bytes <> 0 and size_bytes < 20480 then 'SKIPPED_INLINE' when is_inline and mime_type like 'image/%' then 'SKIPPED_INLINE' end as skip from refs),
o as (select l.*, d.doc_id, d.status, sum(case when outcome = 'pipeline_failed' then 1 else 0 end) over earlier as broken
  from (select * from l where skip is null) l left join ing d on d.source_connector_id = connection_id and d.source_ref = l.source_ref
  window earlier as (partition by connection_id, l.source_ref order by ord rows between unbounded preceding and 1 preceding)),
o2 as (select *, coalesce(status = 'FAILED' or broken > 0, false) or coalesce(broken > 0, false) as retry from o),
o3 as (select *, max(case when outcome = 'ok' or (outcome = 'download_failed' and retry) then 1 else 0 end) over
  (partition by connection_id, source_ref order by ord rows between unbounded preceding and 1 preceding) as done from o2),
planned as (select connection_id, run_id, ord, message_id, source_ref, doc_id as existing_id,
    case when status <> 'FAILED' or done = 1 then 'SKIPPED_DUPLICATE' when retry then 'RETRY' else 'CREATE' end as action, outcome,
    (outcome = 'pipeline_failed' or (outcome = 'download_failed' and not retry)) as failed from o3
  union all select connection_id, run_id, ord, message_id, source_ref, null, skip, outcome, false from l where skip is not null)"""
REF_TABLES = dict(refs=r.REFS, ing=r.INGESTED)


def refs(spark, folder):
    t = Records(spark, folder)
    return t.records(r.REFS, "events"), t.records(r.INGESTED, "events")


def planned(spark, folder):
    return intake.plan(*refs(spark, folder))


@register("attachment_skip_reasons", ctes(**REF_TABLES) + "," + REFS_SQL + "select connection_id, ord, filename, coalesce(skip, 'FETCH') as reason from l")
def attachment_skip_reasons(spark, folder):
    return refs(spark, folder)[0].select("connection_id", "ord", "filename", F.coalesce(intake.skip_reason(), F.lit("FETCH")).alias("reason"))


@register("attachment_plan", ctes(**REF_TABLES) + "," + REFS_SQL + "select connection_id, ord, source_ref, action, existing_id from planned")
def attachment_plan(spark, folder):
    return planned(spark, folder).select("connection_id", "ord", "source_ref", "action",
                                         F.when(~F.col("action").isin("SKIPPED_UNSUPPORTED", "SKIPPED_INLINE"), F.col("existing_id")).alias("existing_id"))


@register("sync_run_counters", ctes(**REF_TABLES, scanned="select run_id, count(distinct message_id) + 2 as messages_scanned from refs group by 1") + "," + REFS_SQL + """
select *, case when documents_failed > 0 and documents_processed = 0 then 'FAILED' when documents_failed > 0 then 'PARTIAL' else 'COMPLETED' end as status
from (select run_id, messages_scanned, count(distinct message_id) as messages_with_attachments, count(*) as attachments_found,
    count_if(action = 'CREATE' and outcome <> 'download_failed') as documents_created, count_if(action in ('CREATE', 'RETRY') and not failed) as documents_processed,
    count_if(action in ('CREATE', 'RETRY') and failed) as documents_failed, count_if(action = 'SKIPPED_DUPLICATE') as skipped_duplicates,
    count_if(action = 'SKIPPED_UNSUPPORTED') as skipped_unsupported, count_if(action = 'SKIPPED_INLINE') as skipped_inline
  from planned join scanned using (run_id) group by 1, 2)""")
def sync_run_counters(spark, folder):
    scanned = refs(spark, folder)[0].groupBy("run_id").agg((F.count_distinct("message_id") + 2).alias("messages_scanned"))
    return intake.run_counters(planned(spark, folder), scanned)


def runs(spark, folder):
    return Records(spark, folder).records(r.RUNS, "events")


SUMS = ", ".join(f"coalesce(sum({c}), 0) as {c}" for c in intake.COUNTERS)


@register("connection_totals", ctes(x=r.RUNS, c=r.CONNECTIONS) + "select connection_id, count(run_id) as runs, " + SUMS + " from c left join x using (connection_id) group by 1")
def connection_totals(spark, folder):
    return intake.connection_totals(Records(spark, folder).records(r.CONNECTIONS, "customer"), runs(spark, folder))


@register("sync_progress", ctes(x=r.RUNS) + """select run_id, done, greatest(attachments_found, done) as total,
  case when greatest(attachments_found, done) > 0 then cast(floor(done / greatest(attachments_found, done) * 100 + 0.5) as bigint) else 0 end as pct
from (select *, documents_processed + documents_failed + coalesce(skipped_duplicates, 0) + skipped_unsupported + skipped_inline as done from x)""")
def sync_progress(spark, folder):
    return intake.progress(runs(spark, folder).fillna(0, ["skipped_duplicates"]))


@register("run_history", ctes(x=r.RUNS) + """select connection_id, run_id, started_at, position from (
  select *, row_number() over (partition by connection_id order by started_at desc, run_id desc) as position from x) where position <= 20""")
def run_history(spark, folder):
    return intake.run_history(runs(spark, folder)).select("connection_id", "run_id", "started_at", "position")


@register("run_items", ctes(**REF_TABLES) + "," + REFS_SQL + """select run_id, source_ref, action, failed and action in ('CREATE', 'RETRY') as failed,
  row_number() over (partition by run_id order by ord) as position from planned""")
def run_items(spark, folder):
    return intake.run_items(planned(spark, folder)).select("run_id", "source_ref", "action", "failed", "position")


@register("messages_per_sync", ctes(**REF_TABLES, c=r.CONNECTIONS, m="select connection_id, message_id, min(ord) as ord from refs group by 1, 2") + """
select connection_id, message_id, ord, position from (select *, row_number() over (partition by connection_id order by ord) as position from m) join c using (connection_id)
where position <= case when coalesce(max_messages, 0) = 0 then 25 else greatest(1, least(100, max_messages)) end""")
def messages_per_sync(spark, folder):
    listing = refs(spark, folder)[0].groupBy("connection_id", "message_id").agg(F.min("ord").alias("ord"))
    return intake.capped_messages(listing, Records(spark, folder).records(r.CONNECTIONS, "customer"))


@register("upload_admission", """with f as (select page_id, regexp_extract(url, '^[^#?]*') as filename, case page_id % 5 when 0 then 'application/pdf' when 1 then 'text/html'
  when 2 then '' when 3 then null else 'image/webp' end as content_type from (select page_id, url || case page_id % 4 when 0 then '/a.PDF' when 1 then '/b.tiff' when 2 then '/c.txt' else '' end as url
  from pages) x), s as (select *, lower(regexp_extract(filename, '[^/](\\.[^./]+)$', 1)) as sfx, coalesce(content_type, '') as m from f)
select page_id, content_type, ok as accepted, case when not ok then 'VALIDATE' end as stage,
  case when not ok then 'Unsupported file type: ' || coalesce(nullif(m, ''), nullif(sfx, ''), 'unknown') end as error
from (select *, m in ('application/pdf', 'image/webp') or sfx in ('.pdf', '.tiff') as ok from s)""")
def upload_admission(spark, folder):
    tail = F.when(F.col("page_id") % 4 == 0, "/a.PDF").when(F.col("page_id") % 4 == 1, "/b.tiff").when(F.col("page_id") % 4 == 2, "/c.txt").otherwise("")
    mime = (F.when(F.col("page_id") % 5 == 0, "application/pdf").when(F.col("page_id") % 5 == 1, "text/html").when(F.col("page_id") % 5 == 2, "")
            .when(F.col("page_id") % 5 == 3, F.lit(None)).otherwise("image/webp"))
    files = Records(spark, folder).raw("pages").select(
        "page_id", F.regexp_extract(F.concat("url", tail), "^[^#?]*", 0).alias("filename"), mime.alias("content_type"))
    return tabular.admission(files).drop("filename")


# ---- sheets -----------------------------------------------------------------
COA_SHEET = """select c_custkey + 2 as row_no, case when c_custkey % 11 <> 0 then ' A' || cast(c_custkey as string) end as a,
  case when c_custkey % 13 = 0 then '' else c_name || ' ' end as b, case when c_custkey % 17 <> 0 then c_mktsegment end as c,
  case when c_custkey % 2 = 0 then 'Group' when c_custkey % 3 = 0 then '' end as d, 'x' as e from {customer}"""
LEDGER_SHEET = """select o_orderkey + 2 as row_no,
  case o_orderkey % 7 when 0 then 'SALES receipt' when 1 then 'Purchase Payment' when 2 then ' Sales Invoice ' when 3 then 'purchase invoice' when 4 then 'Journal Entry'
    when 5 then 'Refund' end as t, case when o_orderkey % 5 <> 0 then ' INV-' || cast(o_orderkey as string) end as i,
  case o_orderkey % 6 when 0 then '05/06/98' when 1 then '7-Aug-1998' when 2 then cast(cast(o_orderdate as date) as string) when 3 then '30-02-1998' when 4 then '' end as d,
  case o_orderkey % 4 when 0 then 'INR 1,200.50' when 1 then '₹' || cast(o_orderkey as string) when 2 then 'n/a' end as m, cast(null as string) as v, 'Cash' as k from {orders}"""


def coa_sheet(spark, folder):
    return Records(spark, folder).records(COA_SHEET, "customer").toDF("row_no", "Account_Code", "ACCOUNT name", "account-type", "Parent Group", "Other")


COA_CHECK = """j as (select *, concat_ws('; ', case when coalesce(a, '') = '' then 'Account Code is required' end, case when coalesce(b, '') = '' then 'Account Name is required' end,
  case when coalesce(c, '') = '' then 'Account Type is required' end) as bad from s)"""


@register("coa_sheet_rows", ctes(s=COA_SHEET) + "," + COA_CHECK + """select row_no, trim(a) as account_code, trim(b) as account_name, trim(c) as account_type,
  nullif(trim(d), '') as parent_group from j where bad = ''""")
def coa_sheet_rows(spark, folder):
    return tabular.chart_of_accounts(coa_sheet(spark, folder))[0]


@register("coa_sheet_errors", ctes(s=COA_SHEET) + "," + COA_CHECK + "select row_no, 'Row ' || row_no || ': ' || bad as error from j where bad <> ''")
def coa_sheet_errors(spark, folder):
    return tabular.chart_of_accounts(coa_sheet(spark, folder))[1]


def ledger_sheet(spark, folder):
    return Records(spark, folder).records(LEDGER_SHEET, "orders").toDF(
        "row_no", "Transaction Type", "invoice no.", "Invoice Date", "Ledger Amount", "Ledger Voucher", "Bank / Cash Account")


LEDGER_CHECK = """p as (select *, lower(trim(t)) as kind,
  case when d = '05/06/98' then '1998-06-05' when d = '7-Aug-1998' then '1998-08-07' when d = '30-02-1998' then null else nullif(d, '') end as dd,
  try_cast(trim(replace(replace(replace(m, 'INR', ''), '₹', ''), ',', '')) as double) as mm from s),
j as (select *, concat_ws('; ', case when coalesce(kind in ('sales receipt', 'purchase payment', 'sales invoice', 'purchase invoice', 'journal entry'), false) then null
    else 'Transaction Type must be "Sales Receipt" or "Purchase Payment"' end, case when coalesce(d, '') <> '' and dd is null then 'Invoice Date is unparseable' end,
  case when coalesce(m, '') <> '' and mm is null then 'Ledger Amount is not numeric' end) as bad from p)"""


@register("ledger_sheet_rows", ctes(s=LEDGER_SHEET) + "," + LEDGER_CHECK + """select row_no, case when kind in ('sales receipt', 'sales invoice') then 'Sales Receipt' else 'Purchase Payment' end as transaction_type,
  coalesce(trim(i), '') as invoice_no, dd as invoice_date, cast(null as double) as invoice_amount, cast(null as varchar) as ledger_date, v as ledger_voucher, mm as ledger_amount,
  cast(null as varchar) as account_name, k as bank_cash_account from j where bad = ''""")
def ledger_sheet_rows(spark, folder):
    return tabular.ledger(ledger_sheet(spark, folder))[0]


@register("ledger_sheet_errors", ctes(s=LEDGER_SHEET) + "," + LEDGER_CHECK + "select row_no, 'Row ' || row_no || ': ' || bad as error from j where bad <> ''")
def ledger_sheet_errors(spark, folder):
    return tabular.ledger(ledger_sheet(spark, folder))[1]


@register("coa_upload_appended", sql(""", s as (""" + COA_SHEET.format(customer="customer") + """), """ + COA_CHECK + """
select statement_id, coa_idx, account_code, account_name, account_type, parent_group from coa
union all select statement_id, coalesce(last, -1) + row_no - 1, trim(a), trim(b), trim(c), nullif(trim(d), '')
from (select *, row_no % 50 as statement_id from j where bad = '') left join (select statement_id, max(coa_idx) as last from coa group by 1) m using (statement_id)"""))
def coa_upload_appended(spark, folder):
    rows = tabular.chart_of_accounts(coa_sheet(spark, folder))[0].withColumn("statement_id", F.col("row_no") % 50)
    return tabular.appended(Records(spark, folder).coa(), rows, "coa_idx")


# ---- statement batches ------------------------------------------------------
BATCHES = """
select o_custkey as statement_id, o_orderkey as batch, o_orderkey % 10 = 0 as failed, case when o_orderkey % 3 = 0 then 'Bank ' || cast(o_orderkey as string) end as bank_name,
  case when o_orderkey % 3 = 0 then '1997-01-01' end as period_start, case when o_orderkey % 3 = 0 then '1997-12-31' end as period_end,
  case when o_orderkey % 4 <> 0 then o_totalprice end as opening, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 7 as double) / 10 end as opening_conf,
  case when o_orderkey % 6 <> 0 then o_totalprice + 1 end as closing, cast(o_orderkey % 3 as double) / 10 as closing_conf,
  case when o_orderkey % 2 = 0 then cast(o_orderkey % 8 as double) / 10 end as overall_conf, cast(null as double) as txn_conf,
  case when o_orderkey % 5 = 0 then o_totalprice end as debit_total, case when o_orderkey % 7 = 0 then o_totalprice end as credit_total
from {orders}"""
BATCH_TXNS = """select l_orderkey as batch, l_linenumber as ord, l_extendedprice as amount, o_custkey as statement_id,
  case l_partkey % 4 when 0 then cast(cast(l_shipdate as date) as string) when 1 then '03/04/97' when 2 then '5-6-1997' else 'n/a' end as transaction_date
from {lineitem} join {orders} on l_orderkey = o_orderkey"""
MERGED = """ok as (select * from b where not failed), hdr as (select statement_id,
    arg_min(bank_name, batch) filter (not failed and bank_name is not null) as bank_name, arg_min(period_start, batch) filter (not failed and bank_name is not null) as period_start,
    arg_min(period_end, batch) filter (not failed and bank_name is not null) as period_end,
    arg_min(debit_total, batch) filter (not failed and debit_total is not null) as debit_total, arg_min(credit_total, batch) filter (not failed and credit_total is not null) as credit_total,
    coalesce(avg(cast(overall_conf as decimal(38,6))) filter (not failed), 0.0) as overall_conf, 0.0::double as txn_conf, count_if(failed) as n_failed, count(*) as n_batches from b group by 1),
op as (select statement_id, opening, coalesce(opening_conf, 0.0) as opening_conf from ok where opening is not null
  qualify row_number() over (partition by statement_id order by coalesce(opening_conf, 0.0) desc, batch desc) = 1),
cl as (select statement_id, closing, coalesce(closing_conf, 0.0) as closing_conf from ok where closing is not null
  qualify row_number() over (partition by statement_id order by coalesce(closing_conf, 0.0) desc, batch desc) = 1)"""


@register("statement_batch_merge", ctes(b=BATCHES) + "," + MERGED + """select statement_id, bank_name, period_start, period_end, opening, coalesce(opening_conf, 0.0) as opening_conf, closing,
  coalesce(closing_conf, 0.0) as closing_conf, debit_total, credit_total, overall_conf, txn_conf, n_failed, n_batches from hdr left join op using (statement_id) left join cl using (statement_id)""")
def statement_batch_merge(spark, folder):
    return statement_merge.merged_headers(Records(spark, folder).records(BATCHES, "orders"))


@register("statement_failed_batches", ctes(b=BATCHES) + "select statement_id, batch from b where failed")
def statement_failed_batches(spark, folder):
    return statement_merge.failed_batches(Records(spark, folder).records(BATCHES, "orders"))


@register("statement_transactions", ctes(b=BATCHES, t=BATCH_TXNS) + "," + MERGED + """, i as (select t.*, case t.transaction_date when '03/04/97' then '1997-04-03' when '5-6-1997' then '1997-06-05'
  else t.transaction_date end as iso, hdr.period_start, hdr.period_end from t join ok on ok.batch = t.batch join hdr on hdr.statement_id = t.statement_id),
sw as (select *, try_cast(substr(iso, 1, 5) || substr(iso, 9, 2) || '-' || substr(iso, 6, 2) as date) as sd, try_cast(iso as date) as dt from i)
select statement_id, batch, ord, amount, case when dt is not null and period_start is not null and not (dt between period_start::date and period_end::date)
  and sd between period_start::date and period_end::date then cast(sd as varchar) else iso end as transaction_date from sw""")
def statement_transactions(spark, folder):
    t = Records(spark, folder)
    return statement_merge.merged_transactions(t.records(BATCHES, "orders"), t.records(BATCH_TXNS, "lineitem", "orders"))
