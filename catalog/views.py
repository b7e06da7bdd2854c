"""SQL text of the derived tables, shared by the oracle queries."""

BASE = """
fx_base as (
  select o_custkey % 50 as statement_id, o_orderkey as ok, o_orderkey % 20 as k, o_custkey as ck,
    case when o_orderkey % 20 = 19 then cast('1998-01-01' as date) + cast((o_orderkey % 200) // 20 as int)
         else cast(o_orderdate as date) end as d,
    case when o_orderkey % 20 = 19 then cast(floor(o_totalprice/50000+0.5) as bigint)*5000000 + 100
         else cast(floor(o_totalprice*100+0.5) as bigint) end as cents,
    o_orderkey % 2 = 0 as is_credit
  from orders),
fx_legs as (select * from (values (0),(1)) as t(leg)),
bank as (
  select statement_id, 2*ok+leg as bank_idx, cast(d as varchar) as transaction_date,
    'NEFT-' || cast(ok as varchar) || '-CUSTOMER ' || cast(ck as varchar) as narration,
    cast(ok as varchar) as reference_number,
    case when not is_credit then cast(amt as double)/100 end as debit,
    case when is_credit then cast(amt as double)/100 end as credit
  from (select b.*, l.leg,
          case when k <> 17 then cents
               when leg = 0 then cents - cast(floor(cents/3) as bigint)
               else cast(floor(cents/3) as bigint) end as amt
        from fx_base b cross join fx_legs l
        where k <> 14 and (leg = 0 or k = 17)) x),
led as (
  select statement_id, 2*ok+leg as led_idx, 'L' || cast(2*ok+leg as varchar) as id,
    case when is_credit <> (k = 15) then 'Sales Receipt' else 'Purchase Payment' end as transaction_type,
    'INV-' || cast(ok as varchar) as invoice_no,
    case when k = 18 and (ok // 20) % 3 = 0 then null else cast(d as varchar) end as invoice_date,
    case when k = 18 and (ok // 20) % 3 = 0 then null else cast(cents as double)/100 end as invoice_amount,
    case when k <> 18 then cast(d + cast(case when k < 13 then ok % 7 else ok % 3 end as int) as varchar)
         end as ledger_date,
    case when k <> 18 then 'V-' || cast(2*ok+leg as varchar) end as ledger_voucher,
    case when k = 18 then null
         when k <> 16 then cast(cents as double)/100
         when leg = 0 then cast(cents - cast(floor(cents/3) as bigint) as double)/100
         else cast(cast(floor(cents/3) as bigint) as double)/100 end as ledger_amount,
    case ok % 9 when 4 then null when 5 then 'Walk-in ' || cast(ck as varchar)
         when 6 then 'CUSTOMER-' || cast(ck as varchar) else 'Customer ' || cast(ck as varchar) end as account_name,
    case (ok // 20) % 5 when 0 then 'NATION_' || cast(statement_id % 25 as varchar) || ' Bank'
         when 1 then 'Cash in Hand' when 2 then 'Unlisted Exchange 77' end as bank_cash_account
  from fx_base b cross join fx_legs l
  where k <> 13 and (leg = 0 or k = 16)),
coa as (
  select c_custkey % 50 as statement_id, 2 * (c_custkey // 50) as coa_idx,
    'C' || cast(c_custkey as varchar) as account_code, 'Customer ' || cast(c_custkey as varchar) as account_name,
    c_mktsegment || ' Debtors' as account_type, cast(null as varchar) as parent_group
  from customer where (c_custkey // 50) % 10 <> 0 and c_custkey % 50 <> 7
  union all
  select s_suppkey % 50, 2 * (s_suppkey // 50) + 1, 'B' || cast(s_suppkey as varchar),
    case when (s_suppkey // 50) % 2 = 0 then 'NATION_' || cast(s_nationkey as varchar) || ' Bank'
         else 'Petty Cash ' || cast(s_suppkey as varchar) end,
    case when (s_suppkey // 50) % 2 = 0 then 'Bank Account' else 'Cash-in-Hand' end, 'Current Assets'
  from supplier where s_suppkey % 3 <> 0),
bk as (
  select statement_id, bank_idx, narration, datediff('day', date '1970-01-01', cast(transaction_date as date)) as day,
    cast(floor(coalesce(credit, debit)*100+0.5) as bigint) as cents,
    case when credit > 0 then 'Sales Receipt' when debit > 0 then 'Purchase Payment' end as direction
  from bank),
lk as (
  select *, coalesce(ledger_date, invoice_date) as anchor_date, coalesce(ledger_amount, invoice_amount) as anchor_amount,
    datediff('day', date '1970-01-01', cast(coalesce(ledger_date, invoice_date) as date)) as day,
    cast(floor(coalesce(ledger_amount, invoice_amount)*100+0.5) as bigint) as cents
  from led)
"""

ASSIGNED = """
pairs as (
  select statement_id, cents, wave, days, led_idx, bank_idx,
    row_number() over (partition by statement_id, cents order by wave, days, led_idx, bank_idx) as rn
  from (select l.statement_id, l.cents, abs(l.day - b.day) as days, l.led_idx, b.bank_idx,
          case when l.transaction_type = b.direction then 0 else 1 end as wave
        from lk l join bk b on l.statement_id = b.statement_id and l.cents = b.cents
        where abs(l.day - b.day) <= 5)
  where 50 + (case when days >= 5 then 0.0 else 40.0*(1 - days/5.0) end) + (case wave when 0 then 10 else 0 end) >= 60),
sim as (
  select statement_id, cents, cast(0 as bigint) as rn, cast([] as bigint[]) as ul, cast([] as bigint[]) as ub,
    cast(null as bigint) as led_idx, cast(null as bigint) as bank_idx, cast(0 as bigint) as days, 0 as wave, false as took
  from (select distinct statement_id, cents from pairs)
  union all
  select s.statement_id, s.cents, p.rn,
    case when list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx) then s.ul else list_append(s.ul, p.led_idx) end,
    case when list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx) then s.ub else list_append(s.ub, p.bank_idx) end,
    p.led_idx, p.bank_idx, p.days, p.wave,
    not (list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx))
  from sim s join pairs p on s.statement_id = p.statement_id and s.cents = p.cents and p.rn = s.rn + 1),
assigned as (
  select statement_id, led_idx, bank_idx, days, wave = 0 as same_direction,
    50 + (case when days >= 5 then 0.0 else 40.0*(1 - days/5.0) end) + (case wave when 0 then 10 else 0 end) as raw_score
  from sim where took)
"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join([BASE, *ctes]) + body


def matched(body: str, *ctes: str) -> str:
    """A query over the outcome of both assignment waves, by a one-pair-at-a-time recursion."""
    return sql(body, ASSIGNED, *ctes, recursive=True)


def assigned_with(least: float, amount: float, date: float, direction: float, silent: int) -> str:
    """Both waves for any weights, one pair at a time; of every `silent`-th bank row neither debit nor credit is known."""
    parts = [f"""
ab as (select statement_id, bank_idx, day, case when bank_idx % {silent} <> 0 then cents end as cents,
  case when bank_idx % {silent} <> 0 then direction end as direction from bk),
al as (select statement_id, led_idx, day, cents, transaction_type from lk where anchor_date is not null and anchor_amount is not null)"""]
    for wave, same, banks, leds in (("a", "is not distinct from", "ab", "al"), ("b", "is distinct from", "ab_left", "al_left")):
        if wave == "b":
            parts.append("""
ab_left as (select * from ab where not exists (select 1 from took_a t where t.statement_id = ab.statement_id and t.bank_idx = ab.bank_idx)),
al_left as (select * from al where not exists (select 1 from took_a t where t.statement_id = al.statement_id and t.led_idx = al.led_idx))""")
        parts.append(f"""
near_{wave} as (select l.statement_id, l.led_idx, b.bank_idx, abs(l.day - b.day) as days, coalesce(l.cents = b.cents, false) as exact,
    max(coalesce(l.cents = b.cents, false)) over (partition by l.statement_id, l.led_idx) as any_exact, b.direction {same} l.transaction_type as fits
  from {leds} l join {banks} b on l.statement_id = b.statement_id and abs(l.day - b.day) <= 5),
pairs_{wave} as (select *, row_number() over (partition by statement_id order by score desc, led_idx, bank_idx) as rn
  from (select *, (case when exact then {amount}e0 else 0e0 end) + (case when days >= 5 then 0e0 else {date}e0 * (1e0 - days / 5e0) end)
        + {direction if wave == "a" else 0}e0 as score from near_{wave} where fits and (exact or not any_exact))
  where score >= {least}),
sim_{wave} as (
  select statement_id, cast(0 as bigint) as rn, cast([] as bigint[]) as ul, cast([] as bigint[]) as ub, cast(null as bigint) as led_idx,
    cast(null as bigint) as bank_idx, cast(0 as bigint) as days, false as exact, cast(0 as double) as score, false as took
  from (select distinct statement_id from pairs_{wave})
  union all
  select s.statement_id, p.rn, case when list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx) then s.ul else list_append(s.ul, p.led_idx) end,
    case when list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx) then s.ub else list_append(s.ub, p.bank_idx) end,
    p.led_idx, p.bank_idx, p.days, p.exact, p.score, not (list_contains(s.ul, p.led_idx) or list_contains(s.ub, p.bank_idx))
  from sim_{wave} s join pairs_{wave} p on s.statement_id = p.statement_id and p.rn = s.rn + 1),
took_{wave} as (select statement_id, led_idx, bank_idx, days, exact, {"true" if wave == "a" else "false"} as same_direction from sim_{wave} where took)""")
    return sql("select * from took_a union all select * from took_b", *parts, recursive=True)


# One target after the other, in index order, against what the earlier ones left over.
SETTLED = """
free_led as (select * from lk where anchor_date is not null and anchor_amount is not null
  and not exists (select 1 from assigned a where a.statement_id = lk.statement_id and a.led_idx = lk.led_idx)),
free_bank as (select * from bk where direction is not null
  and not exists (select 1 from assigned a where a.statement_id = bk.statement_id and a.bank_idx = bk.bank_idx)),
split_targets as (
  select l.statement_id, l.transaction_type as direction, l.led_idx as idx, l.day, l.cents,
    row_number() over (partition by l.statement_id, l.transaction_type order by l.led_idx) as rn,
    list({'i': b.bank_idx, 'd': b.day, 'c': b.cents} order by b.bank_idx) as pool
  from free_led l join free_bank b on l.statement_id = b.statement_id and l.transaction_type = b.direction
    and abs(l.day - b.day) <= 5
  group by l.statement_id, l.transaction_type, l.led_idx, l.day, l.cents),
split_sim as (
  select statement_id, direction, cast(0 as bigint) as rn, cast([] as bigint[]) as used,
    cast(null as bigint) as idx, cast(null as bigint) as day, cast([] as bigint[]) as took,
    cast([] as struct(i bigint, d bigint, c bigint)[]) as near
  from (select distinct statement_id, direction from split_targets)
  union all
  select statement_id, direction, rn, list_concat(used, took), idx, day, took, near
  from (
    select *, case when len(near) < 1 or len(near) > 15 then cast([] as bigint[]) else coalesce(
      flatten(list_transform(near, lambda a: list_transform(
        list_filter(near, lambda b: a.i < b.i and a.c + b.c = cents), lambda b: [a.i, b.i])))[1],
      flatten(list_transform(near, lambda a: flatten(list_transform(
        list_filter(near, lambda b: a.i < b.i), lambda b: list_transform(
          list_filter(near, lambda c: b.i < c.i and a.c + b.c + c.c = cents), lambda c: [a.i, b.i, c.i])))))[1],
      cast([] as bigint[])) end as took
    from (select s.statement_id, s.direction, t.rn, s.used, t.idx, t.day, t.cents,
            list_filter(t.pool, lambda p: not list_contains(s.used, p.i)) as near
          from split_sim s join split_targets t
            on s.statement_id = t.statement_id and s.direction = t.direction and t.rn = s.rn + 1))),
split as (select statement_id, idx as led_idx, took,
    list_sum(list_transform(list_filter(near, lambda p: list_contains(took, p.i)),
      lambda p: case when abs(p.d - day) >= 5 then 0.0 else 40.0*(1 - abs(p.d - day)/5.0) end)) / len(took) as proximity
  from split_sim where len(took) > 0),
pool_led as (select * from free_led l where not exists (
  select 1 from split s where s.statement_id = l.statement_id and s.led_idx = l.led_idx)),
pool_bank as (select * from free_bank b where not exists (
  select 1 from (select statement_id, unnest(took) as bank_idx from split) s
  where s.statement_id = b.statement_id and s.bank_idx = b.bank_idx)),
joint_targets as (
  select b.statement_id, b.direction, b.bank_idx as idx, b.day, b.cents,
    row_number() over (partition by b.statement_id, b.direction order by b.bank_idx) as rn,
    list({'i': l.led_idx, 'd': l.day, 'c': l.cents} order by l.led_idx) as pool
  from pool_bank b join pool_led l on l.statement_id = b.statement_id and l.transaction_type = b.direction
    and abs(l.day - b.day) <= 5
  group by b.statement_id, b.direction, b.bank_idx, b.day, b.cents),
joint_sim as (
  select statement_id, direction, cast(0 as bigint) as rn, cast([] as bigint[]) as used,
    cast(null as bigint) as idx, cast(null as bigint) as day, cast([] as bigint[]) as took,
    cast([] as struct(i bigint, d bigint, c bigint)[]) as near
  from (select distinct statement_id, direction from joint_targets)
  union all
  select statement_id, direction, rn, list_concat(used, took), idx, day, took, near
  from (
    select *, case when len(near) < 1 or len(near) > 15 then cast([] as bigint[]) else coalesce(
      flatten(list_transform(near, lambda a: list_transform(
        list_filter(near, lambda b: a.i < b.i and a.c + b.c = cents), lambda b: [a.i, b.i])))[1],
      flatten(list_transform(near, lambda a: flatten(list_transform(
        list_filter(near, lambda b: a.i < b.i), lambda b: list_transform(
          list_filter(near, lambda c: b.i < c.i and a.c + b.c + c.c = cents), lambda c: [a.i, b.i, c.i])))))[1],
      cast([] as bigint[])) end as took
    from (select s.statement_id, s.direction, t.rn, s.used, t.idx, t.day, t.cents,
            list_filter(t.pool, lambda p: not list_contains(s.used, p.i)) as near
          from joint_sim s join joint_targets t
            on s.statement_id = t.statement_id and s.direction = t.direction and t.rn = s.rn + 1))),
joint as (select statement_id, idx as bank_idx, took,
    list_sum(list_transform(list_filter(near, lambda p: list_contains(took, p.i)),
      lambda p: case when abs(p.d - day) >= 5 then 0.0 else 40.0*(1 - abs(p.d - day)/5.0) end)) / len(took) as proximity
  from joint_sim where len(took) > 0),
combined as (
  select statement_id, led_idx, array_to_string(took, ',') as bank_rows, len(took) as n_bank, 1 as n_led,
    greatest(0.0, least(100.0, 60 + proximity - 5*greatest(0, len(took) - 2))) as score
  from split
  union all
  select statement_id, unnest(took), cast(bank_idx as varchar), 1, len(took),
    greatest(0.0, least(100.0, 60 + proximity - 5*greatest(0, len(took) - 2)))
  from joint)
"""

# Vouchers of the two-way mode.
VOUCHERS = """
two_way as (
  select l.statement_id, l.led_idx, l.id, l.invoice_no, l.invoice_date, l.invoice_amount, l.ledger_voucher,
    l.anchor_amount, l.anchor_date,
    coalesce(cast(a.bank_idx as varchar), c.bank_rows, '') as bank_rows,
    cast(case when a.led_idx is not null then floor(a.raw_score + 0.5)
         when c.led_idx is not null then floor(c.score + 0.5) else 0 end as bigint) as score,
    case when a.led_idx is not null then
           case when a.same_direction and a.raw_score >= 85 then 'Matched' else 'Partially Matched' end
         when c.led_idx is not null then 'Matched (combined)' else 'Unmatched' end as status,
    case when a.led_idx is not null then concat_ws('|', case when a.days >= 5 then 'date_out_of_range' end,
                                                   case when not a.same_direction then 'direction_mismatch' end)
         when c.led_idx is not null then ''
         when l.anchor_date is not null and l.anchor_amount is not null then 'no_candidate' else '' end as failed_criteria,
    case when a.led_idx is not null then concat_ws(' | ', 'Amount matched exactly',
           case when a.days = 0 then 'Date matched exactly' when a.days < 5 then 'Date within tolerance (partial credit)'
                else 'Date outside tolerance window' end,
           case when not a.same_direction then 'Transaction type/direction mismatch' end)
         when c.led_idx is not null then 'Matched via a combined settlement across ' || c.n_bank ||
           ' bank transaction(s) / ' || c.n_led || ' invoice voucher(s)'
         when l.anchor_date is null or l.anchor_amount is null then 'No settlement recorded for this invoice yet'
         else 'No bank transaction found for Amount ' || regexp_replace(cast(l.anchor_amount as varchar), '\\.0$', '')
           || ' around ' || l.anchor_date || ' within the 5-day tolerance window' end as reasons
  from lk l
  left join assigned a on a.statement_id = l.statement_id and a.led_idx = l.led_idx
  left join combined c on c.statement_id = l.statement_id and c.led_idx = l.led_idx),
voucher_bank as (select *, cast(unnest(string_split(bank_rows, ',')) as bigint) as bank_idx
                 from two_way where bank_rows <> ''),
per_bank as (
  select statement_id, bank_idx, list({'o': led_idx, 'n': invoice_no, 'v': ledger_voucher, 's': status, 'p': score,
    'r': reasons} order by led_idx) as vs from voucher_bank group by 1, 2),
results as (
  select b.*, coalesce(p.vs[1].s, 'Unmatched') as status, coalesce(p.vs[1].p, 0) as score, p.vs,
    coalesce(len(p.vs), 0) as n_vouchers,
    case when p.vs[1].s in ('Matched', 'Matched (combined)') then 0 when p.vs[1].s = 'Partially Matched' then 1 else 2 end as rank
  from bank b left join per_bank p on p.statement_id = b.statement_id and p.bank_idx = b.bank_idx),
rollup as (
  select *, case when oc is null then 'Needs Review' when sc > oc then 'Overpaid/Mismatch'
      when oc = sc and sc > 0 then 'Fully Settled' when sc > 0 then 'Partially Settled' else 'Not Settled' end as status
  from (select statement_id, invoice_no, arg_min(invoice_date, led_idx) filter (invoice_date <> '') as invoice_date,
          arg_min(cast(floor(invoice_amount*100+0.5) as bigint), led_idx) filter (invoice_amount is not null) as oc,
          coalesce(sum(cast(floor(anchor_amount*100+0.5) as bigint)) filter (status like 'Matched%'), 0) as sc,
          count(*) as n_vouchers
        from two_way group by 1, 2))
"""


def settled(body: str, *ctes: str) -> str:
    return sql(body, ASSIGNED, SETTLED, *ctes, recursive=True)


def vouchers(body: str, *ctes: str) -> str:
    return settled(body, VOUCHERS, *ctes)

NAME_SIMILARITY = """case when a.plain = '' or c.plain = '' then 0.0::double when a.plain = c.plain or (a.al <> '' and a.al = c.al) then 1.0::double
  when length(a.al) >= 4 and length(c.al) >= 4 and (contains(a.al, c.al) or contains(c.al, a.al)) then 0.95::double
  when a.al <> '' and c.al <> '' then 1.0::double - levenshtein(a.al, c.al) / greatest(length(a.al), length(c.al))
  else 1.0::double - levenshtein(a.plain, c.plain) / greatest(length(a.plain), length(c.plain)) end"""
# b: a narration, c: an account
NARRATION_SCORE = """case when b.plain = '' or c.plain = '' then 0.0::double when contains(b.plain, c.plain) then 1.0::double
  when length(c.al) >= 4 and contains(b.al, c.al) then 0.95::double
  else coalesce(list_max(list_transform(c.ws, lambda w: case when contains(b.plain, w) then 0.85::double else coalesce(list_max(
    list_transform(b.ws, lambda v: 1.0::double - levenshtein(w, v) / greatest(length(w), length(v)))), 0.0::double) end)), 0.0::double) end"""


def forms(column: str) -> str:
    plain = f"lower(trim(coalesce({column}, '')))"
    return (f"{plain} as plain, regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]', '', 'g') as al, "
            f"list_filter(string_split_regex({plain}, '\\s+'), lambda w: length(w) >= 4) as ws")


CHART = "chart as (select *, " + forms("account_name") + """,
  contains(lower(account_type), 'bank') or contains(lower(account_type), 'cash') as till from coa)"""


def best_by_name(name: str, source: str, pool: str) -> str:
    """Best account per (statement_id, name) of ``source``, by name."""
    return f"""{name} as (select statement_id, name, idx, score from (
  select a.statement_id, a.name, c.coa_idx as idx, {NAME_SIMILARITY} as score
  from (select *, {forms('name')} from (select distinct statement_id, name from {source} where name <> '')) a
  join chart c on c.statement_id = a.statement_id and {pool}) where score >= 0.75
  qualify row_number() over (partition by statement_id, name order by score desc, idx) = 1)"""


def best_by_narration(name: str, source: str, pool: str) -> str:
    return f"""{name} as (select statement_id, narration, idx, score from (
  select b.statement_id, b.narration, c.coa_idx as idx, {NARRATION_SCORE} as score
  from (select *, {forms('narration')} from (select distinct statement_id, narration from {source} where narration <> '')) b
  join chart c on c.statement_id = b.statement_id and {pool}) where score >= 0.6
  qualify row_number() over (partition by statement_id, narration order by score desc, idx) = 1)"""


# Vouchers of the three-way mode.
THREE_WAY = ",".join([CHART, """
free3 as (select b.* from pool_bank b where not exists (select 1 from joint j where j.statement_id = b.statement_id and j.bank_idx = b.bank_idx)),
nameless as (select c.statement_id, c.transaction_type as direction, c.led_idx, b.bank_idx, """ + NARRATION_SCORE + """ as score
  from (select *, """ + forms("account_name") + """ from lk where (anchor_date is null or anchor_amount is null) and coalesce(account_name, '') <> '') c
  join (select *, """ + forms("narration") + """ from free3) b on b.statement_id = c.statement_id and b.direction = c.transaction_type),
asked as (select statement_id, direction, led_idx, row_number() over (partition by statement_id, direction order by led_idx) as rn,
    list({'b': bank_idx, 's': score} order by score desc, bank_idx) as pool
  from nameless where score >= 0.6 group by statement_id, direction, led_idx),
name_sim as (
  select statement_id, direction, cast(0 as bigint) as rn, cast([] as bigint[]) as used, cast(null as bigint) as led_idx,
    cast(null as bigint) as bank_idx, cast(null as double) as score
  from (select distinct statement_id, direction from asked)
  union all
  select statement_id, direction, rn, case when p is null then used else list_append(used, p.b) end, led_idx, p.b, p.s
  from (select s.statement_id, s.direction, a.rn, s.used, a.led_idx, list_filter(a.pool, lambda x: not list_contains(s.used, x.b))[1] as p
        from name_sim s join asked a on a.statement_id = s.statement_id and a.direction = s.direction and a.rn = s.rn + 1)),
by_name as (select * from name_sim where bank_idx is not null),
base as (
  select t.statement_id, t.led_idx, t.id, t.invoice_no, l.account_name as name, l.bank_cash_account as till_name,
    case when n.led_idx is not null then cast(n.bank_idx as varchar) else t.bank_rows end as bank_rows,
    case when n.led_idx is not null then cast(floor(n.score * 100 + 0.5) as bigint) else t.score end as score,
    case when n.led_idx is not null then 'Partially Matched' else t.status end as status,
    case when n.led_idx is not null then 'amount_date_unavailable' else t.failed_criteria end as failed_criteria,
    n.score as name_score,
    case when t.bank_rows <> '' then concat_ws(' | ', t.reasons,
           case when l.ledger_date is null and l.ledger_voucher is null and l.ledger_amount is null and not (l.invoice_date is null and l.invoice_amount is null)
             then 'Receipt / Payment Ledger is missing' end,
           case when l.invoice_date is null and l.invoice_amount is null and not (l.ledger_date is null and l.ledger_voucher is null and l.ledger_amount is null)
             then 'Invoice details missing' end)
         when (l.anchor_date is null or l.anchor_amount is null) and coalesce(l.account_name, '') <> ''
           then 'No Invoice or Ledger details provided, and Account Name did not match any bank transaction narration'
         else t.reasons end as reasons
  from two_way t join lk l on l.statement_id = t.statement_id and l.led_idx = t.led_idx
  left join by_name n on n.statement_id = t.statement_id and n.led_idx = t.led_idx),
told as (select base.*, b.narration, case when base.statement_id is not null then 'NATION_' || cast(base.statement_id % 25 as varchar) || ' Bank' end as bank_name
  from base left join bk b on b.statement_id = base.statement_id and b.bank_idx = try_cast(string_split(base.bank_rows, ',')[1] as bigint)),
till_ask as (select statement_id, till_name as name, narration from told where coalesce(till_name, '') <> '')""",
    best_by_name("pn", "told", "true"), best_by_narration("pf", "told", "true"),
    best_by_name("tn", "till_ask", "c.till"), best_by_narration("tf", "till_ask", "c.till"), """
scored as (
  select v.*, coalesce(pn.idx, pf.idx) as party_idx, coalesce(pn.score, pf.score) as party_score,
    case when pn.idx is not null then 'name' when pf.idx is not null then 'fuzzy' end as party_kind,
    coalesce(tn.idx, tf.idx) as till_idx, coalesce(tn.score, tf.score) as till_score,
    case when tn.idx is not null then 'name' when tf.idx is not null then 'fuzzy' end as till_kind,
    case when coalesce(v.name, '') <> '' then (select """ + NARRATION_SCORE + """ from (select """ + forms("v.narration") + """) b, (select """ + forms("v.name") + """) c) end as text_score,
    case when coalesce(v.till_name, '') <> '' then (select """ + NAME_SIMILARITY + """ from (select """ + forms("v.till_name") + """) a, (select """ + forms("v.bank_name") + """) c) end as bank_score
  from told v
  left join pn on pn.statement_id = v.statement_id and pn.name = v.name
  left join pf on pf.statement_id = v.statement_id and pf.narration = v.narration
  left join tn on tn.statement_id = v.statement_id and tn.name = v.till_name
  left join tf on tf.statement_id = v.statement_id and tf.narration = v.narration and coalesce(v.till_name, '') <> ''),
judged as (
  select s.*, p.account_code as p_code, p.account_name as p_name, t.account_code as t_code, t.account_name as t_name,
    party_idx is null and coalesce(text_score, 0) >= 0.6 as by_text, till_idx is null and coalesce(bank_score, 0) >= 0.75 as by_bank
  from scored s left join coa p on p.statement_id = s.statement_id and p.coa_idx = s.party_idx
  left join coa t on t.statement_id = s.statement_id and t.coa_idx = s.till_idx),
final3 as (
  select statement_id, led_idx, id, invoice_no, bank_rows, score,
    (party_idx is not null or by_text) and (coalesce(till_name, '') = '' or till_idx is not null or by_bank) as accounts_ok, status as own_status, failed_criteria,
    concat_ws(' | ',
      case when name_score is not null then case when party_idx is not null then 'Account Matched, Missing Invoice & Ledger | Account Name "' || name ||
          '" confirmed against both the Chart of Accounts and the bank statement narration (~' || cast(floor(name_score*100+0.5) as bigint) || '% similar)'
        else 'Account Name Matched: "' || name || '" found in bank narration (~' || cast(floor(name_score*100+0.5) as bigint) ||
          '% similar) — no Invoice or Ledger amount/date provided to verify further' end else reasons end,
      case when party_kind = 'name' then 'Account Name Matched from COA: ' || p_name || ' (' || p_code || ')'
        when party_kind = 'fuzzy' then 'Account Name Matched via narration fuzzy match against COA: ' || p_name || ' (' || cast(floor(party_score*100+0.5) as bigint) || '% similar)'
        when coalesce(name, '') = '' then 'No account name provided for 3-way validation'
        when by_text then 'Account Name Matched: "' || name || '" found directly in bank narration (~' || cast(floor(text_score*100+0.5) as bigint) || '% similar)'
        when coalesce(narration, '') = '' then 'Account Name "' || name || '" not found in Chart of Accounts (no matched bank transaction to check narration against)'
        else 'Account Name "' || name || '" not found in Chart of Accounts or bank narration' end,
      case when coalesce(till_name, '') = '' then null
        when till_kind = 'name' then 'Bank/Cash Account matched from COA: ' || t_name || ' (' || t_code || ')'
        when till_kind = 'fuzzy' then 'Bank/Cash Account inferred via narration fuzzy match against COA: ' || t_name || ' (' || cast(floor(till_score*100+0.5) as bigint) || '% similar)'
        when by_bank then 'Bank/Cash Account matched to the uploaded statement''s bank: ' || bank_name
        else 'Bank/Cash Account "' || till_name || '" not found in Chart of Accounts or the uploaded statement''s bank' end) as reasons,
    case when party_idx is not null then p_name when by_text then name end as party_account,
    case when party_idx is not null then party_kind when by_text then 'narration' end as party_match,
    case when till_idx is not null then t_name when by_bank then bank_name end as till_account,
    case when till_idx is not null then till_kind when by_bank then 'statement' end as till_match
  from judged),
used3 as (select statement_id, cast(unnest(string_split(bank_rows, ',')) as bigint) as bank_idx from base where bank_rows <> ''),
loose as (select b.* from bk b where not exists (select 1 from used3 u where u.statement_id = b.statement_id and u.bank_idx = b.bank_idx))""",
    best_by_narration("lf", "loose", "not c.till"), """
extra as (select b.statement_id, b.bank_idx, f.score, c.account_name, c.account_code from loose b join lf f on f.statement_id = b.statement_id and f.narration = b.narration
  join coa c on c.statement_id = f.statement_id and c.coa_idx = f.idx),
three_way as (
  select statement_id, led_idx, id, invoice_no, bank_rows, score,
    case when own_status = 'Matched' and not accounts_ok then 'Partially Matched' else own_status end as status,
    failed_criteria, reasons, party_account, party_match, till_account, till_match, accounts_ok from final3
  union all
  select statement_id, null, 'coa-only:' || bank_idx, '', cast(bank_idx as varchar), cast(floor(score*100+0.5) as bigint), 'Partially Matched',
    'amount_date_unavailable|no_ledger_row', 'Account Matched, Missing Invoice & Ledger | Account "' || account_name || '" (' || account_code ||
    ') found in Chart of Accounts and matched to this bank statement narration — no Invoice or Ledger entry exists for it',
    account_name, 'fuzzy', null, null, null from extra)"""])


def three_way(body: str) -> str:
    return vouchers(body, THREE_WAY)
