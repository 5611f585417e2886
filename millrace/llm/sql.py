"""SQL for DuckDB that says the same as a query. Left out where SQL lacks what the operator needs (NFKC, search, packing, models)."""

from __future__ import annotations

BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANK}+|{BLANK}+$', '', 'g')"


_POOLS = rf"""
  pool as (
    select family, key, max(try_cast(replace(nullif(regexp_extract(difficulty, '\d+(?:[.,]\d+)?'), ''), ',', '.') as double)) as number
    from (
      select 'medium' as family, id as key, difficulty from problems where id like 'medium\_%' escape '\' and {_stripped("text")} <> ''
      union all
      select 'omni', {_stripped("problem")}, difficulty from omni_records
      where {_stripped("problem")} <> '' and {_stripped("solution")} <> '' and {_stripped("answer")} <> '')
    group by family, key),
  record as (
    select p.family, p.key, c.band from pool p join category_targets c on p.family = c.family
      and case when c.difficulty_from is null or isnan(c.difficulty_from) then p.number is null
               else p.number >= c.difficulty_from and p.number < c.difficulty_below end),
  asked as (
    select manifest_id, selection_seed, family, band, target_share, coalesce(min_rows, 0) as floor_rows,
           coalesce(case when family = 'medium' then medium_target else omni_target end, 0) as target
    from lock_manifest cross join category_targets)"""

_SAMPLE = rf"""
  ranked as (
    select a.*, r.key, row_number() over (partition by a.manifest_id, a.family, a.band
             order by ('0x' || substr(sha256(a.selection_seed::varchar || ':' || r.key), 1, 13))::bigint / 4503599627370496.0, r.key) as rank
    from asked a join record r on a.family = r.family and a.band = r.band),
  seated as (
    select *, rank <= floor_rows as floor_row, row_number() over (partition by manifest_id, family
             order by rank <= floor_rows desc, (rank - 0.5) / nullif(target_share, 0) nulls last, band, rank) as seat
    from ranked where rank <= greatest(target, floor_rows) and target > 0),
  sample as (select manifest_id, family, band, key, rank, floor_row from seated where seat <= target)"""

PUNCTUAL = "ingested_at <= created_at + interval 1 day"


def _keys(name: str, rows: str) -> str:
    return rf"""
  {name} as (
    select id, case when id like 'medium\_%' escape '\' then 'medium' else 'omni' end as family, min(coalesce(batch_no, 12)) as batch_no
    from problems where id is not null and {rows} group by id)"""


def _levels(name: str, keys: str, earlier: str | None = None) -> str:
    """Thresholds of the keys; those of an earlier run count beside the new rates."""
    more = f" union all select plan, stratum, batch, threshold from {earlier}" if earlier else ""
    return f"""
  {name} as (
    select plan, stratum, batch, max(threshold) over (partition by plan, stratum order by batch) as threshold
    from (
      select plan, stratum, batch, max(threshold) as threshold
      from (
        select m.manifest_id as plan, p.family as stratum, p.batch_no as batch,
               least(1.0, coalesce(case when p.family = 'medium' then m.medium_target else m.omni_target end, 0)::double * least(p.batch_no, 12) / 12.0::double / p.pool) as threshold
        from (select family, batch_no, sum(n) over (partition by family order by batch_no) as pool
              from (select family, batch_no, count(*) as n from {keys} group by family, batch_no)) p cross join lock_manifest m{more})
      group by plan, stratum, batch))"""


def _drawn(name: str, keys: str, levels: str) -> str:
    return f"""
  {name} as (
    select d.manifest_id, d.id, d.family, d.batch_no, min(l.batch) as chosen_at
    from (select m.manifest_id, k.id, k.family, k.batch_no, ('0x' || substr(sha256(m.selection_seed::varchar || ':' || k.id), 1, 13))::bigint / 4503599627370496.0 as u
          from {keys} k cross join lock_manifest m) d
    join {levels} l on d.manifest_id = l.plan and d.family = l.stratum and l.batch >= d.batch_no and l.threshold > d.u
    group by d.manifest_id, d.id, d.family, d.batch_no)"""


SQL = {
    "p2_found": f"""
with {_POOLS},
  available as (select family, band, count(*) as n from record group by family, band)
select a.manifest_id, a.family, a.band from asked a left join available v on a.family = v.family and a.band = v.band
where coalesce(v.n, 0) < greatest(a.floor_rows, floor(a.target_share * a.target + 0.5))""",
    "p2_sample": f"with {_POOLS}, {_SAMPLE} select manifest_id, family, band, key, rank, floor_row from sample",
    "p2_report": f"""
with {_POOLS}, {_SAMPLE},
  available as (select family, band, count(*) as n from record group by family, band),
  chosen as (select manifest_id, family, band, count(*) as n from sample group by all),
  r as (
    select a.manifest_id, a.family, a.band, coalesce(v.n, 0) as available, greatest(a.floor_rows, floor(a.target_share * a.target + 0.5))::bigint as requested,
           coalesce(c.n, 0) as selected, a.target_share
    from asked a left join available v on a.family = v.family and a.band = v.band
    left join chosen c on a.manifest_id = c.manifest_id and a.family = c.family and a.band = c.band)
select *, least(available, requested) as filled, greatest(requested - available, 0) as shortfall,
  coalesce(selected / nullif(sum(selected) over (partition by manifest_id, family), 0)::double, 0) as share from r""",
    "p4_stable_sample": f"""
with {_keys("keys", "true")}, {_levels("level", "keys")}, {_drawn("chosen", "keys", "level")}
select manifest_id, id, family, batch_no, chosen_at from chosen""",
    "p4_thresholds": f"""
with {_keys("early", PUNCTUAL)}, {_levels("kept", "early")}, {_keys("keys", "true")}, {_levels("level", "keys", "kept")}
select plan, stratum, batch, round(threshold, 9) as threshold from level""",
    "p4_late_rows": f"""
with {_keys("early", PUNCTUAL)}, {_levels("kept", "early")}, {_keys("keys", "true")}, {_levels("level", "keys", "kept")},
  {_drawn("was", "early", "kept")}, {_drawn("now", "keys", "level")}
select manifest_id, family, count(w) filter (n is not null) as kept, count(w) filter (n is null) as lost, count(n) filter (w is null) as added
from (select manifest_id, id, family, 1 as w from was) full join (select manifest_id, id, family, 1 as n from now) using (manifest_id, id, family)
group by manifest_id, family""",
    "p6_found": """
select l.container_kind, d.doc_id from documents d cross join pack_limits l
where d.text is not null and octet_length(encode(d.text)) + 1 > l.capacity""",
}
