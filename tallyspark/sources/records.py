"""Document store and mailbox tables derived from the input tables, in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.operators.store import IN_FLIGHT, TERMINAL
from tallyspark.sources.documents import Documents


def _pick(number: str, names: list[str]) -> str:
    whens = " ".join(f"when {i} then '{name}'" for i, name in enumerate(names))
    return f"case {number} % {len(names)} {whens} end"


DOCS = f"""
select o_orderkey as doc_id, 'file-' || cast(o_orderkey as string) || case when o_orderkey % 3 = 0 then '.PDF' else '.png' end as filename,
  {_pick('o_orderkey', IN_FLIGHT + TERMINAL)} as status,
  case o_orderkey % 4 when 1 then 'MANUAL' when 2 then 'API' when 3 then 'CONNECTOR' end as source,
  case when o_orderkey % 5 = 0 then 'USA' when o_orderkey % 5 = 1 then null when o_orderkey % 25 = 2 then ' usa' else 'INDIA' end as country,
  case when o_orderkey % 4 = 3 then 'c' || cast(o_custkey as string) end as source_connector_id,
  case when o_orderkey % 4 = 3 then 'm' || cast(o_orderkey % 7 as string) || ':0:a.pdf' end as source_ref,
  cast(cast(o_orderdate as date) as string) || 'T10:00:00' as created_at,
  case when o_orderkey % 3 <> 0 then 'TESSERACT' end as ocr_engine,
  case when o_orderkey % 6 <> 0 then cast(o_orderkey % 6 - 1 as bigint) end as page_count,
  cast(o_orderkey * 7 % 101 as double) as complexity_score, o_orderkey % 10 = 0 as must_use_llm
from {{orders}}
"""

_VERSIONED = "{{orders}} cross join (select * from (values (0),(1)) as t(v)) w where o_orderkey % {m} <> 0 and (v = 0 or o_orderkey % 4 = 1)"

EXTRACTIONS = """
select o_orderkey as doc_id, o_orderkey * 2 + v as id, cast(cast(o_orderdate as date) + case when o_orderkey % 9 = 0 then 0 else v end as string) as created_at,
  case when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then null
    else '{{"invoice":{{"invoice_number":"INV-' || cast(o_orderkey as string) || '","version":' || cast(v as string)
      || '}},"metadata":{{"pages":' || cast(o_orderkey % 6 as string) || '}}}}' end as invoice_json,
  case when o_orderkey % 11 <> 0 then '{{"overall":0.' || cast(1 + o_orderkey % 9 as string) || '}}' end as confidence_json,
  'statement ' || cast(v as string) as bank_statement, case when o_orderkey % 2 = 0 then 'coa ' || cast(v as string) end as coa,
  case when o_orderkey % 7 = 0 then 'ledger ' || cast(v as string) end as ledger
from """ + _VERSIONED.format(m=3).replace("{{", "{").replace("}}", "}")

VALIDATIONS = """
select o_orderkey as doc_id, o_orderkey * 2 + v as id, cast(cast(o_orderdate as date) + v as string) as created_at,
  case (o_orderkey + v) % 3 when 0 then 'VALID' when 1 then 'INVALID' else 'NEEDS_REVIEW' end as status,
  case when o_orderkey % 5 <> 0 then '["r' || cast(v as string) || '"]' end as rule_checks_json,
  '[]' as warnings_json, '' as errors_json
from """ + _VERSIONED.format(m=7).replace("{{", "{").replace("}}", "}")

OCR_RUNS = """
select o_orderkey as doc_id, o_orderkey * 2 + v as id, cast(cast(o_orderdate as date) + v as string) as created_at,
  case v when 0 then 'TESSERACT' else 'PADDLEOCR' end as engine,
  case v when 0 then cast(o_orderkey * 13 % 100 as double) else cast(o_orderkey * 17 % 100 as double) / 100 end as confidence, v as attempt
from """ + _VERSIONED.format(m=5).replace("{{", "{").replace("}}", "}")

PAGES = """
select o_orderkey as doc_id, p as page_number, 'orig/' || cast(o_orderkey as string) || '/' || cast(p as string) as original_path,
  case when (o_orderkey + p) % 3 = 0 then null when (o_orderkey + p) % 3 = 1 then '' else 'prep/' || cast(o_orderkey as string) || '/' || cast(p as string) end
    as preprocessed_path
from {orders} cross join (select * from (values (1),(2),(3),(4),(5)) as t(p)) w where p <= o_orderkey % 6
"""

FINALS = """
select o_orderkey as doc_id, '{{"invoice_number":"OLD-' || cast(o_orderkey as string) || '"}}' as invoice, '{{}}' as confidence,
  'PENDING' as validation_status, '{{}}' as metadata, '1997-01-01' as submitted_at
from {orders} where o_orderkey % 8 = 0
"""

CORRECTIONS = """
select o_orderkey as doc_id, '{{"invoice_number":"NEW-' || cast(o_orderkey as string) || '-' || cast(v as string) || '"}}' as corrected_invoice,
  '2000-01-0' || cast(1 + v as string) as submitted_at
from {orders} cross join (select * from (values (0),(1)) as t(v)) w where o_orderkey % 12 < 3 and (v = 0 or o_orderkey % 5 = 0)
"""

CONNECTIONS = """
select 'c' || cast(c_custkey as string) as connection_id,
  case c_custkey % 5 when 0 then 'PENDING' when 1 then 'CONNECTED' when 2 then 'NEEDS_REAUTH' when 3 then 'ERROR' else 'DISCONNECTED' end as status,
  'token' as access_token, 'token' as refresh_token, 'state' as oauth_state,
  case when c_custkey % 3 <> 0 then cast('2024-01-01 00:' || case when c_custkey % 60 < 10 then '0' else '' end || cast(c_custkey % 60 as string) || ':00' as timestamp) end
    as oauth_state_created_at,
  cast(case when c_custkey % 4 <> 0 then c_custkey % 130 end as int) as max_messages
from {customer}
"""

REFS = """
select 'c' || cast(user_id as string) as connection_id, 'run-' || cast(user_id as string) || '-' || cast(cast(ts as date) as string) as run_id,
  event_id * 2 + again as ord, 'm' || cast(cast(floor(event_id / 3) as bigint) as string) as message_id, event_id % 3 as part_index,
  case event_type when 'view' then 'scan.PDF' when 'click' then 'logo.png' when 'signup' then 'notes.txt' when 'error' then 'invoice.jpeg' else 'photo.heic' end
    as filename,
  case event_type when 'view' then 'application/pdf' when 'click' then 'image/png' when 'signup' then 'text/plain' when 'error' then 'image/jpeg'
    else 'image/heic' end as mime_type,
  cast(case when event_id % 71 = 0 then 20000000 when event_id % 37 = 0 then 0 when event_id % 41 = 0 then null else floor(value * 3000) end as bigint)
    as size_bytes,
  event_id % 4 = 0 as is_inline, case when event_id % 29 <> 0 then 'ok' when (event_id + again) % 4 = 0 then 'download_failed' when (event_id + again) % 4 = 1 then 'ok'
    else 'pipeline_failed' end as outcome
from {events} cross join (select * from (values (0),(1)) as t(again)) w where again = 0 or event_id % 50 = 0
"""

INGESTED = """
select event_id as doc_id, 'c' || cast(user_id as string) as source_connector_id,
  'm' || cast(cast(floor(event_id / 3) as bigint) as string) || ':' || cast(event_id % 3 as string) || ':' ||
    case event_type when 'view' then 'scan.PDF' when 'click' then 'logo.png' when 'signup' then 'notes.txt' when 'error' then 'invoice.jpeg' else 'photo.heic' end
    as source_ref,
  case event_id % 33 when 0 then 'FAILED' when 11 then 'VALID' else 'OCR_RUNNING' end as status
from {events} where event_id % 11 = 0
"""

LOG = """
select user_id as document_id, event_type as step, case when event_id % 6 = 0 then 'FAILED' else 'SUCCESS' end as status,
  ts as created_at, event_id as id
from {events}
"""

RUNS = """
select 'run-' || cast(user_id as string) || '-' || cast(cast(ts as date) as string) || '-' || event_type as run_id,
  'c' || cast(user_id as string) as connection_id,
  case when min(event_id) % 9 = 0 then 'RUNNING' when min(event_id) % 9 = 1 then 'FAILED' else 'COMPLETED' end as status,
  cast(cast(ts as date) as string) as started_at, cast(null as string) as error_message, cast(null as string) as finished_at,
  count(*) as messages_scanned, count(*) as messages_with_attachments, sum(event_id % 5) as attachments_found,
  sum(event_id % 2) as documents_created, sum(event_id % 2) as documents_processed, sum(case when event_id % 7 = 0 then 1 else 0 end) as documents_failed,
  cast(null as bigint) as skipped_duplicates, sum(event_id % 3) as skipped_unsupported, min(event_id % 4) as skipped_inline
from {events} group by user_id, cast(ts as date), event_type
"""

TYPED_DOCS = """
select doc_id, text || case doc_id % 5 when 0 then ' std pack W12 Ship Date' when 1 then ' Purchase order unit cost' when 2 then ' Bill to, delivery date'
  when 3 then ' material release' else '' end as text
from {documents}
"""

FEATURES = """
select doc_id, p as page, cast((doc_id * 3 + p) % 12 as bigint) as line_count, cast((doc_id * 7 + p) % 25 as double) / 100 as dark_ratio,
  cast((doc_id + p) % 6 as bigint) as gap_regions, cast((doc_id * 37 + p * 11) % 500 as double) as laplacian_var,
  cast((doc_id * 13 + p) % 300 as bigint) as region_count,
  cast(case when (doc_id + p) % 17 <> 0 then 500 + (doc_id * 31 + p) % 900 end as bigint) as width,
  cast(case when (doc_id + p) % 17 <> 0 then 400 + (doc_id * 19 + p) % 900 end as bigint) as height
from {documents} cross join (select * from (values (1),(2),(3)) as t(p)) w where p <= doc_id % 4
"""


class Records(Documents):
    def records(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in names})
