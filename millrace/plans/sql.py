"""For each query of millrace.plans.queries the SQL that DuckDB runs over the same tables. Absent where SQL lacks what is needed
(parsing code or nested tags, NFKC, exact algebra); those are tested against fixtures instead."""

from __future__ import annotations

SEED = 60906
RESULTS = """results as (
  select * from eval_results where adapter is not null and id is not null
  qualify row_number() over (partition by adapter, id order by result_no desc) = 1)"""
PROB = "prob as (select * from problems where id is not null qualify row_number() over (partition by id order by record_no) = 1)"
ROLL = "roll as (select * from rollouts qualify row_number() over (partition by rollout_id order by ingested_at desc) = 1)"
ORIGIN = """origin as (
  select id, source, difficulty from (
    select id, source, difficulty, 0 as o from prob union all select item_id, source, difficulty, 1 from eval_items)
  qualify row_number() over (partition by id order by o) = 1)"""
METRICS = (
    "tags_exact", "code_blocks_complete", "signature_exact", "python_executable",
    "all_hidden_tests_pass", "backward_target_correct", "final_answer_correct", "full_success",
)
TOPIC = r"coalesce(nullif(trim(split_part(domain[1], '->', 2)), ''), trim(split_part(domain[1], '->', 1)), 'other')"


def bucket(column: str) -> str:
    value = f"try_cast(trim({column}) as double)"
    return f"case when {value} is null then 'unknown' when {value} <= 3 then '1-3' when {value} <= 6 then '3.5-6' when {value} <= 8 then '6.5-8' else '8.5-10' end"


POOL = f"""pool as (
  select id, coalesce(source, 'unknown') as source, coalesce(difficulty, 'unknown') as difficulty, {TOPIC} as topic, {bucket("difficulty")} as bucket
  from prob where text is not null)"""


def uniform(key: str, seed: int | str = SEED) -> str:
    return f"('0x' || substr(sha256('{seed}:' || {key}), 1, 13))::bigint / 4503599627370496.0"


def ascii_hash(column: str) -> str:
    return f"sha256(regexp_replace(lower({column}), '[^a-z0-9_]+', '', 'g'))"


def mcnemar(improved: str, regressed: str) -> str:
    n, m = f"({improved} + {regressed})", f"least({improved}, {regressed})"
    term = f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2))"
    return f"case when {n} = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, {m} + 1), lambda k: {term}))) end"


def wilson(s: str, n: str, sign: str) -> str:
    z, p = "1.959963984540054", f"({s}::double / {n})"
    core = f"({p} + {z} * {z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))) / (1 + {z} * {z} / {n})"
    return f"greatest(0.0, {core})" if sign == "-" else f"least(1.0, {core})"



def long_pairs(left: str, right: str, metrics: tuple[str, ...] = METRICS) -> str:
    return " union all ".join(
        f"select a.id, '{m}' as metric, coalesce(a.{m}, false) as was, coalesce(b.{m}, false) as now from results a join results b on a.id = b.id where a.adapter = '{left}' and b.adapter = '{right}'"
        for m in metrics
    )


COUNTS = """count(*) as n, count(*) filter (was) as was_successes, count(*) filter (now) as now_successes, count(*) filter (not was and now) as improved,
  count(*) filter (was and not now) as regressed, count(*) filter (was = now) as unchanged"""
LABEL_PAIRS = [
    ("stage2", "main_grpo"), ("stage2", "feedback_grpo"), ("stage2", "teacher_judge"),
    ("main_grpo", "feedback_grpo"), ("main_grpo", "teacher_judge"), ("feedback_grpo", "teacher_judge"),
]
ALL_PAIRS = " union all ".join(f"select '{a}' as left_label, '{b}' as right_label, metric, was, now from ({long_pairs(a, b)})" for a, b in LABEL_PAIRS)
RATE = "coalesce(avg(coalesce({0}, false)::int::double), 0)"
RATES = {
    "tags_exact_rate": "tags_exact", "code_block_complete_rate": "code_blocks_complete", "signature_exact_rate": "signature_exact",
    "python_executable_rate": "python_executable", "all_hidden_tests_pass_rate": "all_hidden_tests_pass",
    "backward_target_accuracy": "backward_target_correct", "final_answer_accuracy": "final_answer_correct", "full_success_rate": "full_success",
}
MEANS = {"mean_generation_seconds": "generation_seconds", "mean_prompt_tokens": "prompt_token_count", "mean_completion_tokens": "completion_token_count"}


def test_sum(name: str) -> str:
    return f"coalesce(sum(test_counts.{name}), 0)"


SUMMARY = "select adapter, count(*) as problems, count(*) filter (status = 'error') as errors, " + ", ".join(
    [f"round_even({RATE.format(c)}, 6) as {n}" for n, c in RATES.items()]
    + [
        f"{test_sum(k + '_passed')} as {k}_tests_passed, {test_sum(k + '_total')} as {k}_tests_total, round_even(coalesce({test_sum(k + '_passed')}::double / nullif({test_sum(k + '_total')}, 0), 0), 6) as {k}_test_pass_rate"
        for k in ("unit", "property")
    ]
    + [f"round_even(coalesce(avg({c}), 0), 6) as {n}" for n, c in MEANS.items()]
) + " from results group by adapter"
SUMMARY_NUMBERS = [
    "problems",
    "errors",
    *RATES,
    *(f"{k}_tests_passed" for k in ("unit", "property")),
    *(f"{k}_tests_total" for k in ("unit", "property")),
    *(f"{k}_test_pass_rate" for k in ("unit", "property")),
    *MEANS,
]
UNIT, PROPERTY = ("coalesce(test_counts.{0}_passed::double / nullif(test_counts.{0}_total, 0), 0)".format(k) for k in ("unit", "property"))


def flag(column: str) -> str:
    return f"coalesce({column}, false)::int::double"


GATE = f"(0.25 + 0.75 * {flag('final_answer_correct')})"
REWARD = f"""round_even({flag('tags_exact')} * (0.1 * {flag('tags_exact')} + 0.15 * {flag('signature_exact')} + {GATE} * (0.5 * {flag('python_executable')} + 0.75 * {UNIT} + 0.5 * {PROPERTY})
  + (1.5 * {flag('final_answer_correct')} + 0.75 * {flag('backward_target_correct')})), 6)"""
OWN = f"0.15 * {flag('signature_exact')} + {GATE} * (0.5 * {flag('python_executable')} + 0.75 * {UNIT} + 0.5 * {PROPERTY})"
EDGE = f"0.5 * {GATE} * 0.05 * {flag('python_executable')}"
OUTCOME = f"1.5 * {flag('final_answer_correct')} + 0.75 * {flag('backward_target_correct')}"
MEASURED = """measured as (
  select id, count(*) as rollouts, round(avg(f), 6) as final_rate, round(max(l), 6) as learnability, round(coalesce(stddev_pop(r), 0), 6) as reward_std
  from (select id, {f} as f, {l} as l, {r} as r from eval_results where id is not null) group by id)"""
SPLIT = "coalesce(lower(trim(split)), 'train')"
TAGS = r"""tagged as (
  select rollout_id, problem_id, raw_text, list_concat(f, ['main']) as nodes from (
    select *, (select coalesce(list(x order by i), []) from (select x, min(i) as i from (select unnest(fs) as x, generate_subscripts(fs, 1) as i) group by x)) as f
    from (select *, regexp_extract_all(raw_text, '<a_(f[0-9]+)>', 1) as fs from roll where raw_text is not null)))"""
QUOTA = """sized as (select {strata}, count(*) as n from pool group by {strata}),
  exact as (select *, {exact} as e from (select *, sum(n) over () as total_n from sized)),
  quota as (select *, floor(e)::bigint + (row_number() over (order by round(e - floor(e), 9) desc, {ties}) <= {total} - sum(floor(e)) over ())::int as quota from exact),
  ranked as (select *, row_number() over (partition by {strata} order by {u}, id) as rank from pool)"""


def label(*columns: str) -> str:
    return "'(' || " + " || ', ' || ".join(f"'''' || {c} || ''''" for c in columns) + " || ')'"


L2 = QUOTA.format(
    strata="topic, bucket",
    exact="n * 0.2",
    total="floor(total_n * 0.2 + 0.5)",
    ties=f"sha256('{SEED}:' || {label('topic', 'bucket')}) desc, {label('topic', 'bucket')} desc",
    u=uniform("id"),
)
L3 = QUOTA.format(
    strata="source, difficulty",
    exact="n * least(250, total_n) / total_n::double",
    total="least(250, total_n)",
    ties=label("source", "difficulty"),
    u=uniform("id"),
)
L5 = QUOTA.format(
    strata="source, difficulty",
    exact="n * floor(total_n * 0.1 + 0.5) / total_n",
    total="floor(total_n * 0.1 + 0.5)",
    ties=label("source", "difficulty"),
    u=uniform("id"),
)
ITEMS = "item as (select doc_id as item_id, text from documents where text is not null)"
IDENTIFIERS = r"list_distinct(regexp_extract_all(lower({0}), '[a-z_][a-z0-9_]*|[0-9]+|[\x{{4e00}}-\x{{9fff}}]'))"
LEXICAL = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_]*|[0-9]+'))"
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

SQL = {
    "paired_report": f"""
with {RESULTS}, pairs as ({ALL_PAIRS}),
  counted as (select left_label, right_label, metric, {COUNTS} from pairs group by all),
  tested as (select *, {mcnemar("improved", "regressed")} as p from counted),
  family as (select left_label, right_label, metric, least(1.0, (count(*) over () - row_number() over (order by p, right_label) + 1) * p) as scaled,
    row_number() over (order by p, right_label) as i from tested where metric = 'final_answer_correct' and left_label = 'stage2'),
  held as (select left_label, right_label, metric, max(scaled) over (order by i) as adjusted from family)
select t.left_label, t.right_label, t.metric, n, was_successes, now_successes, improved, regressed, unchanged,
  round(was_successes::double / n, 6) as was_rate, round(now_successes::double / n, 6) as now_rate, round((now_successes - was_successes)::double / n, 6) as difference,
  round(p, 6) as p_value, round({wilson("now_successes", "n", "-")}, 6) as now_low, round({wilson("now_successes", "n", "+")}, 6) as now_high, round(adjusted, 6) as p_adjusted
from tested t left join held h on t.left_label = h.left_label and t.right_label = h.right_label and t.metric = h.metric""",
    "eval_summary": f"with {RESULTS} {SUMMARY}",
    "metric_deltas": f"""
with {RESULTS}, s as ({SUMMARY}), long as ({" union all ".join(f"select adapter, '{c}' as metric, {c}::double as v from s" for c in SUMMARY_NUMBERS)})
select a.adapter, a.metric, round(b.v, 6) as baseline, round(a.v, 6) as candidate, round(round_even(a.v - b.v, 6), 6) as delta
from long a join long b on a.metric = b.metric and b.adapter = 'stage2' where a.adapter <> 'stage2'""",
    "pair_transitions": f"with {RESULTS} select metric, {COUNTS} from ({long_pairs('stage2', 'main_grpo')}) group by metric",
    "strata_rates": f"""
with {RESULTS}, {PROB}, {ORIGIN},
  rows_ as (select r.adapter, coalesce(r.final_answer_correct, false) as ok, case when r.id like 'medium\\_%' escape '\\' then 'medium' else 'omni' end as family,
    coalesce(o.source, 'unknown') as source, coalesce(o.difficulty, 'unknown') as difficulty from results r left join origin o on r.id = o.id),
  long as ({" union all ".join(f"select adapter, ok, '{c}' as stratum, {c} as value from rows_" for c in ("family", "source", "difficulty"))}),
  g as (select stratum, value, adapter, count(*) as n, count(*) filter (ok) as successes from long group by all)
select *, round(successes::double / n, 6) as rate, round({wilson("successes", "n", "-")}, 6) as low, round({wilson("successes", "n", "+")}, 6) as high from g""",
    "wilson_rates": f"""
with {RESULTS}, g as (select adapter, count(*) as n, count(*) filter (full_success) as successes from results group by adapter)
select *, round({wilson("successes", "n", "-")}, 6) as low, round({wilson("successes", "n", "+")}, 6) as high from g""",
    "pass_at_k": """
with per as (select adapter, id, count(*) as n, """
    + ", ".join(
        f"count(*) filter ({c}) as {n}" for n, c in (
            ("f", "final_answer_correct"),
            ("s", "full_success"),
            ("x", "python_executable"),
            ("t", "all_hidden_tests_pass"),
        )
    )
    + """ from eval_results where id is not null group by adapter, id)
select adapter, count(*) as problems, sum(n) as rollouts, """
    + ", ".join(
        f"round(sum({c})::double / sum(n), 6) as {n}_rate, round(avg(({c} > 0)::int), 6) as {n}_pass_at_k" for n, c in (
            ("final", "f"),
            ("success", "s"),
            ("executable", "x"),
            ("tests", "t"),
        )
    )
    + " from per group by adapter",
    "test_count_totals": f"with {RESULTS} select adapter, " + ", ".join(
        f"{test_sum(c)} as {c}" for c in ("unit_passed", "unit_total", "property_passed", "property_total")
    ) + " from results group by adapter",
    "frequency_counts": " union all ".join(
        f"select '{c}' as field, coalesce({c}, 'unknown') as value, count(*) as n from documents group by 2" for c in ("lang", "source", "kind")
    ),
    "merged_summaries": f"""
with {RESULTS}, parts as (select adapter, date_trunc('month', finished_at) as m, count(*) as k, sum(generation_seconds) as w, {RATE.format("full_success")} as s, {RATE.format("python_executable")} as x from results group by 1, 2)
select adapter, sum(k) as num_problems, round(max(w), 6) as wall_time_seconds, round(sum(s * k) / sum(k), 6) as success, round(sum(x * k) / sum(k), 6) as executable from parts group by adapter""",
    "group_ranges": f"""
with {ROLL} select problem_id, count(*) as n, round(min(generation_seconds), 6) as min_seconds, round(max(generation_seconds), 6) as max_seconds,
  round(avg(generation_seconds), 9) as mean_seconds, max(generation_seconds) - min(generation_seconds) > 1e-9 as differs from roll where generation_seconds is not null group by problem_id""",
    "dedup_first": f"select record_no, id, text_key from (select *, {ascii_hash('text')} as text_key from problems where text is not null) qualify row_number() over (partition by text_key order by record_no) = 1",
    "dedup_conflicts": f"""select id, count(*) as rows, count(distinct {ascii_hash("coalesce(text, '')")} || '|' || trim(coalesce(gold_answer, ''))) as versions from problems group by id""",
    "unique_pool": f"""
with v as (select id, min(record_no) as record_no, count(distinct {ascii_hash("coalesce(text, '')")} || '|' || trim(coalesce(gold_answer, ''))) as n from problems group by id)
select record_no, id from v where n = 1""",
    "last_delivery": """select record_no, id, batch_no, source, min(record_no) over (partition by id) as first_record_no from problems where id is not null
qualify row_number() over (partition by id order by record_no desc) = 1""",
    "leak_exclude": f"""
with p as (select *, {SPLIT} as s from problems), known as (select id, text from p where s = 'train')
select record_no, id from p where s <> 'train' and text is not null
  and id not in (select id from known where id is not null union select split_part(id, ':', 1) from known where id is not null)
  and {ascii_hash("text")} not in (select {ascii_hash("text")} from known where text is not null)""",
    "resume_missing": "select item_id as id, source from eval_items where item_id not in (select id from eval_results where status = 'ok' and adapter = 'main_grpo' and id is not null)",
    "repeated_keys": "select id, count(*) as n from problems group by id having count(*) > 1 or id is null or trim(id) = ''",
    "split_overlap": f"""
with p as (select id, {SPLIT} as s from problems), b as (select distinct id from p where s = 'train' and id is not null intersect select id from p where s <> 'train')
select (select count(*) from b) as overlap, (select coalesce(string_agg(id, ',' order by id), '') from (select id from b order by id limit 10)) as examples""",
    "invalid_results": """
with bad as (
  select result_no, 'prompt_token_count' as rule from eval_results where coalesce(prompt_token_count, -1) < 0
  union all select result_no, 'completion_token_count' from eval_results where coalesce(completion_token_count, -1) < 0
  union all select result_no, 'status' from eval_results where status is null
  union all select result_no, 'unit_tests' from eval_results where test_counts.unit_passed > test_counts.unit_total)
select rule, count(*) as rows, count(distinct result_no) as results from bad group by rule""",
    "forbidden_keys": """
with k as (select record_no, concat_ws(',', case when regexp_matches(metadata, '"gold_answer"\\s*:') then 'gold_answer' end, case when regexp_matches(metadata, '"rev"\\s*:') then 'rev' end) as keys from problems where metadata is not null)
select * from k where keys <> ''""",
    "stratified_sample": f"with {PROB}, {POOL}, {L2} select r.id, r.topic, r.bucket from ranked r join quota q on r.topic = q.topic and r.bucket = q.bucket where r.rank <= q.quota",
    "stratified_select": f"with {PROB}, {POOL}, {L3} select r.id, r.source, r.difficulty from ranked r join quota q on r.source = q.source and r.difficulty = q.difficulty where r.rank <= q.quota",
    "stratified_split": f"with {PROB}, {POOL}, {L5} select r.id, case when r.rank <= q.quota then 'validation' else 'train' end as part from ranked r join quota q on r.source = q.source and r.difficulty = q.difficulty",
    "balanced_select": f"""
with {PROB}, {POOL}, r as (select id, source, row_number() over (partition by source order by {uniform("id")}, id) as turn from pool)
select id, source, turn from r order by turn, source, id limit 40""",
    "assign_splits": f"""
with {PROB}, {POOL}, r as (select id, source, row_number() over (partition by source order by {uniform("id")}, id) as k, count(*) over (partition by source) as n from pool)
select id, source, case when k <= floor(n * 0.1 + 0.5) then 'test' when k <= floor(n * 0.1 + 0.5) + floor(n * 0.1 + 0.5) then 'validation' else 'train' end as part from r""",
    "hash_split": f"""
with {PROB}, {POOL}, r as (select id, row_number() over (order by {uniform("id")}, id) as k, count(*) over () as n from pool)
select id, case when k <= floor(n * 0.05 + 0.5) then 'heldout' else 'train' end as part from r""",
    "seeded_page": f"with {PROB}, {POOL} select id from pool order by sha256('42:' || id), id limit 50 offset 10",
    "replay_mix": f"""
with {PROB}, k as (select id, ('0x' || substr(sha256(id), 1, 8))::bigint % 10 as k from prob), c as (select id from k where k < 2),
  o as (select id, case when k < 6 then 'graph' else 'solve' end as task, row_number() over (partition by k < 6 order by sha256('{SEED}:' || id), id) as i from k where k >= 2)
select id || ':repeat' || r as id, 'code' as task from c cross join (select unnest([1, 2]) as r) union all select id, task from o where i <= (select count(*) from c)""",
    "shards": """
with r as (select rollout_id, row_number() over (order by rollout_id) - 1 as index, count(*) over () as n from (select distinct rollout_id from rollouts))
select rollout_id, index, (index % 6)::int as shard from r where index < n - n % 6""",
    "hard_set": f"""
with {PROB}, {MEASURED.format(f=flag("final_answer_correct"), l=f"({flag('python_executable')} + {UNIT} + {PROPERTY} + {flag('backward_target_correct')}) / 4", r=f"{flag('full_success')} + {UNIT}")},
  kept as (select m.*, round(3 * (final_rate > 0 and final_rate < 1)::int + 2 * (1 - final_rate) + 2 * learnability + least(1.0, reward_std), 6) as score, p.id like 'omni\\_math\\_%' escape '\\' as o
    from prob p join measured m on p.id = m.id where rollouts >= 2 and final_rate <= 0.75 and learnability >= 0.1),
  placed as (select *, row_number() over (partition by o order by score desc, final_rate, id) as i from kept)
select id, rollouts, final_rate, learnability, reward_std, score from placed order by case when o and i <= 20 then 0 when not o then 1 else 2 end, score desc, final_rate, id limit 60""",
    "reject_reasons": f"""
with {PROB}, {MEASURED.format(f=flag("final_answer_correct"), l=flag("python_executable"), r=flag("full_success"))}
select case when rollouts is null then 'missing_trajectory' when rollouts < 2 then 'fewer_than_two_rollouts' when final_rate > 0.5 then 'not_hard_enough' when learnability < 0.5 then 'no_process_signal' else 'kept' end as reason, count(*) as n
from prob p left join measured m on p.id = m.id group by 1""",
    "canonical_omni": f"""
with c as (select {STRIP.format("problem")} as p, {STRIP.format("solution")} as s, {STRIP.format("answer")} as a, coalesce(difficulty, '') as d, coalesce(source, 'unknown') as source from omni_records)
select 'omni_math_' || substr(sha256(p), 1, 16) as id, a as gold_answer, sha256(p) as problem_sha256, length(s)::int as solution_length from c where p <> '' and s <> '' and a <> ''
qualify row_number() over (partition by p order by d, source) = 1""",
    "normalised_problems": "select coalesce(split, 'train') as split, count(*) as rows, count(gold_answer) as answered, count(distinct coalesce(id, 'problem-' || record_no)) as ids from problems group by 1",
    "problem_labels": f"""
with {PROB} select id, case when id like 'medium\\_%' escape '\\' then 'medium' else 'omni' end as family, case when id like 'omni\\_math\\_%' escape '\\' then 'omni' else 'medium' end as other_family,
  coalesce(array_to_string(domain[1:3], '/'), '') as domain_key, {TOPIC} as topic, {bucket("difficulty")} as bucket from prob""",
    "rate_buckets": f"""
with {RESULTS}, p as (select id, {RATE.format("final_answer_correct")} as r from results group by id)
select case when r <= 0 then '0' when r <= 0.25 then '(0,.25]' when r <= 0.5 then '(.25,.5]' else '>.5' end as bucket, count(*) as problems from p group by 1""",
    "safe_labels": r"""
with s as (select regexp_replace(regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') as l from problems)
select case when coalesce(l, '') = '' then 'adapter' else l end as label, count(*) as n from s group by 1""",
    "chat_records": f"""
with {PROB}, p as (select * from prob where text is not null and gold_answer is not null),
  b as (select id, trim(gold_answer) <> '' as complete, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || gold_answer || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as t from p)
select id || ':graph' as id, 'graph' as task, 3::int as turns, sha256('<|im_start|>system' || chr(10) || 'Decompose.<|im_end|>' || chr(10) || t) as rendered_sha256, complete from b
union all select id || ':solve', 'solve', 2::int, sha256(t), complete from b""",
    "encoded_features": f"""
with {ROLL}, e as (select rollout_id, completion_token_ids as c, len(completion_token_ids) as n, case when prompt_token_count > 0 then prompt_token_count else 0 end as p from roll where completion_token_ids is not null),
  k as (select *, least(p, 256 - n) as k from e where n > 0 and n < 256)
select rollout_id, (n + k)::int as length, k::int as masked, (list_sum(c) - 100 * k)::bigint as label_sum, (list_sum(c) + k * p - k * (k - 1) // 2)::bigint as id_sum from k""",
    "padded_batches": f"""
with {ROLL}, q as (select rollout_id, len(completion_token_ids) as c, case when prompt_token_count > 0 then prompt_token_count else 0 end as p from roll where completion_token_ids is not null),
  e as (select floor(rollout_id / 16)::bigint as batch, c + least(p, 4096 - c) as n from q where c between 1 and 4095), w as (select batch, n, max(n) over (partition by batch) as m from e)
select batch, max(m)::int as width, min(m)::int as least, sum(m - n)::bigint as padding from w group by batch""",
    "ids_digest": """
with s as (select string_agg(item_id, chr(10) order by item_id) as t, count(*) as rows from eval_items)
select sha256(t) as ids_sha256, rows, 'sorted' as kind from s union all select sha256(t || chr(10)), rows, 'locked' from s""",
    "selection_manifest": f"""
with {PROB}, {POOL} select case when id like 'medium\\_%' escape '\\' then 'medium' else 'omni' end as family, count(*) as rows, count(distinct source) as sources, count(distinct difficulty) as difficulties,
  min(id) as first_id, max(id) as last_id from pool group by 1""",
    "jaccard_top_k": f"""
with {ITEMS}, q as (select item_id as query_id, {IDENTIFIERS.format("text")} as tq from eval_items), i as (select item_id, {IDENTIFIERS.format("text")} as ti from item),
  s as (select query_id, item_id, len(list_intersect(tq, ti)) as common, len(tq) as nq, len(ti) as ni from q cross join i),
  r as (select query_id, item_id, common, case when common = 0 then 0.0 else common::double / (nq + ni - common) end as score from s)
select query_id, item_id, common, round(score, 6) as score, row_number() over (partition by query_id order by r.score desc, item_id)::int as rank from r
qualify row_number() over (partition by query_id order by r.score desc, item_id) <= 3""",
    "idf_top_k": f"""
with {ITEMS}, t as (select item_id, {LEXICAL.format("text")} as ts from item), post as (select item_id, greatest(1.0, sqrt(len(ts))) as norm, unnest(ts) as token from t),
  idf as (select token, ln(((select count(*) from item) + 1.0) / (count(*) + 1)) + 1 as w from post group by token),
  q as (select item_id as query_id, unnest({LEXICAL.format("text")}) as token from eval_items),
  s as (select query_id, p.item_id, sum(w) / first(norm) as score from q join idf using (token) join post p using (token) group by query_id, p.item_id)
select query_id, item_id, round(s.score, 6) as score, row_number() over (partition by query_id order by round(s.score, 9) desc, item_id)::int as rank from s
qualify row_number() over (partition by query_id order by round(s.score, 9) desc, item_id) <= 3""",
    "cosine_top_k": """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null),
  s as (select q.vec_id as query_id, i.vec_id as item_id, list_dot_product(q.v, i.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(i.v, i.v)) as score from e q join e i on q.vec_id % 100 = 0)
select query_id, item_id, round(s.score, 6) as score, row_number() over (partition by query_id order by round(s.score, 9) desc, item_id)::int as rank from s
qualify row_number() over (partition by query_id order by round(s.score, 9) desc, item_id) <= 5""",
    "memory_sizes": """
with m as (select case kind when 'solution' then 'theorem' when 'theorem_note' then 'theorem' when 'worksheet' then 'template' when 'diagnosis' then 'failure' else 'prior' end as memory_type from documents where text is not null)
select t.memory_type, count(m.memory_type) as items from (select unnest(['theorem', 'template', 'prior', 'failure', 'spare']) as memory_type) t left join m on m.memory_type = t.memory_type group by 1""",
    "memory_update": """
with p as (select id, record_no, coalesce(batch_no, 12) as batch_no from problems), a as (select id, record_no, batch_no, 0 as o from p where batch_no <= 6 and id is not null qualify row_number() over (partition by id order by record_no) = 1),
  b as (select id, record_no, batch_no, 1 as o from p where batch_no > 6 and id is not null qualify row_number() over (partition by id order by record_no desc) = 1)
select id, record_no, batch_no from (from a union all from b) qualify row_number() over (partition by id order by o desc) = 1""",
    "first_tags": f"""
with {ROLL} select rollout_id, """
    + ", ".join(
        f"case when strpos(raw_text, '<{t}>') > 0 and strpos(substr(raw_text, strpos(raw_text, '<{t}>')), '</{t}>') > 0 then length(split_part(substr(raw_text, strpos(raw_text, '<{t}>') + {len(t) + 2}), '</{t}>', 1))::int end as {n}"
        for t, n in (("a_f1", "first_length"), ("main", "main_length"))
    )
    + " from roll where raw_text is not null",
    "exact_tags": rf"""
with {ROLL}, {TAGS}, x as (
  select rollout_id, regexp_replace(raw_text, '(</?)main>', '\1a_main>', 'g') as t, flatten(list_transform(nodes, lambda n: ['<a_' || n || '>', '</a_' || n || '>'])) as wanted from tagged),
  y as (select *, regexp_extract_all(t, '</?a_[A-Za-z0-9_]+>') as tags from x)
select rollout_id, tags = wanted and regexp_replace(regexp_replace(t, '(?s)<a_[A-Za-z0-9_]+>.*?</a_[A-Za-z0-9_]+>', '', 'g'), '[\s\p{{Z}}]+', '', 'g') = '' as exact, list_sort(tags) = list_sort(wanted) as once from y""",
    "boxed_answers": rf"""
with {ROLL} select rollout_id, trim(regexp_extract_all(raw_text, '\\boxed\{{([^{{}}]*)\}}', 1)[-1]) as boxed from roll where raw_text like '%boxed{{%'""",
    "consensus": rf"""
with {ROLL}, v as (
  select problem_id, rollout_id, nullif(lower(regexp_replace(regexp_replace(trim(regexp_extract(raw_text, 'boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)), '\\,| ', '', 'g'), '^\$|\$$', '', 'g')), '') as value from roll where raw_text is not null),
  s as (select *, case when value is null then 0 else count(*) over (partition by problem_id, value) / (count(value) over (partition by problem_id))::double end as c from v)
select problem_id, count(*) as rollouts, round(avg(c), 6) as mean_consensus from s group by problem_id""",
    "rewards": f"""
with {RESULTS}, r as (select adapter, {REWARD} as reward, round_even({GATE}, 6) as gate from results)
select adapter, count(*) as n, round(avg(reward), 6) as mean_reward, round(max(reward), 6) as max_reward, round(avg(gate), 6) as mean_gate from r group by adapter""",
    "span_rewards": f"""
with {RESULTS}, r as (
  select 'f1' as node_id, case when {flag("tags_exact")} = 0 then 0 else round_even({OWN} + 0.5 * ({OUTCOME}) + {EDGE}, 6) end as reward from results
  union all select 'main', case when {flag("tags_exact")} = 0 then 0 else round_even({OWN} + {EDGE} + {OUTCOME}, 6) end from results)
select node_id, count(*) as n, round(sum(reward), 4) as total from r group by node_id""",
    "group_advantages": f"""
with {RESULTS}, r as (select id, result_no, {REWARD} as reward from results), s as (select *, avg(reward) over (partition by id) as m, stddev_pop(reward) over (partition by id) as d from r)
select id, result_no, round(case when d < 1e-8 then 0 else (reward - m) / d end, 6) as advantage from s""",
    "span_advantages": f"""
with {RESULTS}, l as ({" union all ".join(f"select id, result_no, '{m}' as node_id, coalesce({m}, false)::int::double as reward from results" for m in ("tags_exact", "signature_exact", "python_executable"))}),
  s as (select *, avg(reward) over w as m, stddev_pop(reward) over w as d, max(reward) over w as top from l window w as (partition by id, node_id))
select id as problem_id, result_no as rollout_id, node_id, round(case when d < 1e-8 then 0 else (reward - m) / d end, 6) as advantage from s where top > 0""",
    "token_advantages": f"with {ROLL} select rollout_id, round(floor(n / 3) * 1.0::double - 0.5 * (n - floor(n / 3)), 6) as advantage_sum from (select rollout_id, len(completion_token_ids) as n from roll where completion_token_ids is not null)",
    "efficiency": f"""
with {ROLL}, p as (select backend, (least(1.0, coalesce(generation_seconds, 0) / 5.0) + least(1.0, coalesce(len(regexp_extract_all(raw_text, '```python')), 0) / 8.0) + least(1.0, case when completion_token_count > 0 then completion_token_count
    else coalesce(len(list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda w: w <> '')), 0) end / 2048.0)) / 3.0 as x from roll)
select backend, count(*) as n, round(avg(x), 6) as mean_penalty from p group by backend""",
    "seeded_uniform": f"select item_id, round({uniform('item_id')}, 9) as u from eval_items",
}
U_TOTAL, U_PASSED, P_TOTAL, P_PASSED = (
    "greatest(coalesce(test_counts.unit_total, 0), 0)", "least(greatest(coalesce(test_counts.unit_passed, 0), 0), greatest(coalesce(test_counts.unit_total, 0), 0))",
    "greatest(coalesce(test_counts.property_total, 0), 0)", "least(greatest(coalesce(test_counts.property_passed, 0), 0), greatest(coalesce(test_counts.property_total, 0), 0))",
)
TESTED = f"""tested as (select *, {U_TOTAL} as ut, {U_PASSED} as up, {P_TOTAL} as pt, {P_PASSED} as pp, {flag("python_executable")} as x, {flag("final_answer_correct")} as f from results)"""
SQL |= {
    "node_scores": f"""
with {RESULTS}, {TESTED}, s as (select adapter, x, coalesce(up::double / nullif(ut, 0), 0) as u, coalesce(pp::double / nullif(pt, 0), 0) as p,
  0.25 + case when ut > 0 then 0.5 else 0 end + case when pt > 0 then 0.25 else 0 end as w from tested)
select adapter, round(avg(x), 6) as execution, round(avg(u), 6) as unit, round(avg(p), 6) as property, round(avg((0.25 * x + 0.5 * u + 0.25 * p) / w), 6) as combined from s group by adapter""",
    "failure_classes": f"""
with {RESULTS} select adapter, case when not coalesce(python_executable, false) then 'execution' when not coalesce(backward_target_correct, false) then 'dependency'
  when not coalesce(final_answer_correct, false) then 'verification' else 'none' end as failure, count(*) as n from results group by 1, 2""",
    "metadata_fields": "select json_extract_string(metadata, '$.subject') as subject, json_extract(metadata, '$.rev')::int as rev, count(*) as n from problems group by 1, 2",
    "token_counts": rf"""
select record_no, len({IDENTIFIERS.format("text")})::int as identifiers, len({LEXICAL.format("text")})::int as lexical from problems where text is not null""",
    "known_ids": """
with c as (select record_no, unnest(list_distinct([id, source, split_part(id, ':', 1), split_part(source, ':', 1)])) as name, row_number() over () as r from problems)
select name, count(*) as n from c where name is not null and trim(name) <> '' group by name having count(*) > 1""",
    "answer_kinds": f"""
with {PROB} select regexp_matches(gold_answer, '[0-9]') and not regexp_matches(lower(gold_answer), 'none|cannot|insufficient|all of the above') as numeric,
  case when id like 'medium\\_%' escape '\\' then 'medium' else 'omni' end as family, count(*) as n from prob where gold_answer is not null group by 1, 2""",
}
_SOURCE = f"""
with {RESULTS}, {PROB}, {ORIGIN}, p as ({long_pairs("stage2", "teacher_judge", ("final_answer_correct", "python_executable"))}),
  c as (select coalesce(o.source, 'unknown') as source, metric, count(*) filter (not was and now) as improved, count(*) filter (was and not now) as regressed from p join origin o on p.id = o.id group by 1, 2),
  t as (select source, metric, improved, regressed, round({mcnemar("improved", "regressed")}, 6) as p_value from c)"""
SQL["mcnemar_by_source"] = f"{_SOURCE} select * from t"
SQL["holm_by_source"] = f"""{_SOURCE}, h as (
  select *, least(1.0, (count(*) over (partition by metric) - row_number() over (partition by metric order by p_value, source) + 1) * p_value) as scaled, row_number() over (partition by metric order by p_value, source) as i from t)
select source, metric, improved, regressed, p_value, round(max(scaled) over (partition by metric order by i), 6) as p_adjusted from h"""
