"""Similarity, analysis queue, quota, progress and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import analysis as an
from paperloom.operators import quota as qu
from paperloom.operators import scoring as sg
from paperloom.plans.scratch import scratch_path
from paperloom.streaming import jobs as st

from .registry import query
from .sqltext import ws

AT = "2024-01-10 12:00:00"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES list as a CTE body."""
    body = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) v({names})"


LIMITS = [(m, d, r, i) for m, d, r, i in qu.MODEL_LIMITS]
GROUPS = [(g, m) for g, ms in qu.MODEL_GROUPS.items() for m in ms]
CHAIN = [(c, k, m) for c, ms in qu.FALLBACK_CHAINS.items() for k, m in enumerate(ms)]


def limits(t):
    return t.spark.createDataFrame(LIMITS, "model_key string, day_limit int, minute_limit int, min_interval_ms int")


def groups(t):
    return t.spark.createDataFrame(GROUPS, "grp string, model_key string")


def usage(t):
    return qu.quota_usage(t.calls, limits(t), F.lit(AT).cast("timestamp_ntz"))


SQL_REFS = """select vec_id as ref_rank, case vec_id when 0 then '8.7' when 1 then '14.1' when 2 then '17.1' when 3 then '4.1' else '20.1' end as ref_id,
    case vec_id when 0 then 'Sub-Clause 8.7: Delay Damages' when 1 then 'Sub-Clause 14.1: Contract Price' when 2 then 'Sub-Clause 17.1: Indemnities'
      when 3 then 'Sub-Clause 4.1: Contractor''s General Obligations' else 'Sub-Clause 20.1: Claims' end as line, embedding::double[] as v from embeddings where vec_id < 5"""
SQL_SCORES = """select c.vec_id as clause_id, r.ref_id, r.ref_rank, r.line, list_cosine_similarity(c.embedding::double[], r.v) as score
    from embeddings c, refs r where c.vec_id >= 5 and c.label <> 3"""
SQL_TOP = "select *, row_number() over (partition by clause_id order by round(score, 9) desc, ref_rank) as rank from scores qualify rank <= 3"

query(
    "jn11_score_references",
    lambda t: an.score_references(t.clause_vectors.where("vector is not null"), t.references).select(
        "clause_id", "ref_id", "ref_rank", F.round("score", 4).alias("score")
    ),
    "select clause_id, ref_id, ref_rank, round(score, 4) as score from scores",
    refs=SQL_REFS,
    scores=SQL_SCORES,
)
query(
    "tk2_top_references",
    lambda t: an.top_references(an.score_references(t.clause_vectors.where("vector is not null"), t.references, 3), 3).select(
        "clause_id", "ref_id", "rank", F.round("score", 4).alias("score")
    ),
    "select clause_id, ref_id, rank, round(score, 4) as score from top",
    refs=SQL_REFS,
    scores=SQL_SCORES,
    top=SQL_TOP,
)
query(
    "tk2_nearest_references",
    lambda t: an.nearest_references(t.clause_vectors, t.references, 3).select("clause_id", "ref_id", "rank", F.round("score", 4).alias("score")),
    "select clause_id, ref_id, rank, round(score, 4) as score from top",
    refs=SQL_REFS,
    scores=SQL_SCORES,
    top=SQL_TOP,
)
query(
    "tk3_fallback_references",
    lambda t: an.fallback_references(t.clause_vectors, t.references).select("clause_id", "ref_id", "ref_rank", F.round("score", 4).alias("score")),
    "select c.vec_id as clause_id, r.ref_id, r.ref_rank, round(1 - r.ref_rank * 0.1, 4)::double as score from embeddings c, refs r where c.vec_id >= 5 and c.label = 3 and r.ref_rank < 3",
    refs=SQL_REFS,
)


def _queue(t):
    top = an.score_references(t.clause_vectors.where("vector is not null"), t.references, 3)
    ranked = an.top_references(top, 3).join(t.references.select("ref_id", "reference", "ref_text"), "ref_id")
    clauses = t.clauses.join(t.analyses.select("clause_id", "risk_level"), "clause_id", "left")
    return an.analysis_queue(clauses, ranked)


SQL_QUEUE = """select c.clause_id, k as piece_no, case when r.block is not null then 'Compare with:' || chr(10) || r.block || chr(10) || chr(10) else '' end || 'Clause:' || chr(10)
         || substr(text, 1 + 2000 * k, 2000) as prompt, length(text) > 2000 as is_long, coalesce(a.risk_level = 'high', false) as needs_recheck
       from (select *, unnest(range(greatest(1, (length(text) + 1999) // 2000))) as k from clauses) c left join analyses a on a.clause_id = c.clause_id
       left join (select clause_id, string_agg('- ' || line, chr(10) order by rank) as block from top group by 1) r on r.clause_id = c.clause_id"""
query(
    "sc26_analysis_queue",
    lambda t: _queue(t).select("clause_id", "piece_no", F.md5("prompt").alias("h"), "is_long", "needs_recheck"),
    "select clause_id, piece_no, md5(prompt) as h, is_long, needs_recheck from queue",
    refs=SQL_REFS,
    scores=SQL_SCORES,
    top=SQL_TOP,
    queue=SQL_QUEUE,
)

# the scorer of short prompts is asked first; the pieces it can't take go to the second
SHORT = 900


def _scored(t):
    docs = t.base("documents").join(t.base("labels"), "doc_id").select("text", (F.col("quality") == 0).alias("risky"))
    model = sg.learn_word_model(docs)
    chain = [sg.Scorer("flash25", sg.short_prompts(SHORT, sg.word_risk), model), sg.Scorer("flash25Lite", sg.word_risk, model)]
    return sg.score_pieces(_queue(t).select("clause_id", "piece_no", "prompt"), chain)


def _score_fn(t):
    answers = an.ingest_answers(sg.worst_answers(_scored(t)), t.answers.limit(0).select("clause_id", "answer"))
    return answers.select("clause_id", "risk_level", "risk_summary", "model")


_MD5_BUCKET = "('0x' || md5(lower(w))[1:3])::int"
query(
    "score_fn",
    _score_fn,
    """select clause_id, level as risk_level, 'mean weight ' || mean as risk_summary, case when length(prompt) <= 900 then 'flash25' else 'flash25Lite' end as model from graded
       qualify row_number() over (partition by clause_id order by case level when 'high' then 0 when 'medium' then 1 else 2 end, piece_no) = 1""",
    refs=SQL_REFS,
    scores=SQL_SCORES,
    top=SQL_TOP,
    queue=SQL_QUEUE,
    learnt=f"""select b, floor(1000 * ln((sum(y) + 1) / (sum(1 - y) + 1)::double))::bigint as weight from (
        select distinct doc_id, (quality = 0)::int as y, {_MD5_BUCKET} as b from (
          select d.doc_id, quality, unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) as w from documents d join labels l on l.doc_id = d.doc_id) x) y group by b""",
    weighed=f"""select clause_id, piece_no, prompt, sum(coalesce(weight, 0))::bigint as total, count(*) as n from (
        select *, {_MD5_BUCKET} as b from (select *, unnest(regexp_extract_all(prompt, '[A-Za-z]{{2,}}')) as w from queue) x) q left join learnt using (b) group by all""",
    graded="select *, case when mean >= 60 then 'high' when mean >= 0 then 'medium' else 'low' end as level from (select *, floor(total / n)::bigint as mean from weighed) x",
)
query(
    "score_fn_failures",
    # a chain of the scorer of short prompts alone: what it can't take stays as a row with its error
    lambda t: sg.score_pieces(
        _queue(t).select("clause_id", "piece_no", "prompt"), [sg.Scorer("flash25", sg.short_prompts(SHORT, lambda _, ps: ["{}"] * len(ps)))]
    ).select("clause_id", "piece_no", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("answer", F.lit("")).alias("answer")),
    """select clause_id, piece_no, case when length(prompt) > 900 then 'flash25: RESOURCE_EXHAUSTED: prompt too long' else '' end as error,
         case when length(prompt) > 900 then '' else '{}' end as answer from queue""",
    refs=SQL_REFS,
    scores=SQL_SCORES,
    top=SQL_TOP,
    queue=SQL_QUEUE,
)
query(
    "sc27_ingest_answers",
    lambda t: an.ingest_answers(
        t.answers.select("clause_id", "answer", "model"), t.answers.select("clause_id", F.when(F.col("clause_id") % 5 != 1, F.col("recheck")).alias("answer"))
    ).withColumn("comparison", F.coalesce("comparison", F.lit(""))),
    """select clause_id, case when lvl = 'high' and clause_id % 5 <> 1 and rl <> 'high' and conf > 0.7 then rl when lvl in ('high', 'medium', 'low', 'info') then lvl
         when regexp_matches(lower(s), '\\bhigh\\b') then 'high' else 'info' end as risk_level,
         case when s = '' then '(분석 없음)' else s end as risk_summary, case when ok and json_type(a, '$.recommendations') = 'VARCHAR' then a->>'$.recommendations' else '' end as recommendations,
         coalesce(case when ok then a->>'$.fidicComparison' end, '') as comparison, case when ok then model else 'gemini-flash-stub' end as model
       from (select clause_id, model, ok, a, case when ok and json_type(a, '$.riskSummary') = 'VARCHAR' then a->>'$.riskSummary' else '' end as s,
           case when ok then a->>'$.riskLevel' end as lvl, recheck->>'$.riskLevel' as rl, (recheck->>'$.confidence')::double as conf
         from (select *, json_valid(answer) as ok, case when json_valid(answer) then answer end as a from answers) x) y""",
)
_ERR = """case event_id % 8 when 0 then 'HTTP 401 from host' when 1 then 'RESOURCE_EXHAUSTED now' when 2 then '503 Service Unavailable' when 3 then 'Quota exceeded, 401'
   when 4 then 'the model is in high demand' when 5 then 'limit: 0' when 6 then props else 'API key not valid' end"""
query(
    "sc28_classify_errors",
    lambda t: an.classify_errors(t.base("events").withColumn("message", F.expr(_ERR))).select("event_id", "error_class"),
    f"""select event_id, case when contains(m, 'API_KEY_INVALID') or contains(m, '401') or contains(m, 'invalid API key') or contains(m, 'API key not valid') then 'key_invalid'
          when contains(m, '429') or contains(m, 'RESOURCE_EXHAUSTED') or contains(m, 'resource_exhausted') or contains(m, 'quota') or contains(m, 'Quota exceeded') or contains(m, 'limit: 0') then 'quota'
          when contains(m, '503') or contains(m, 'Service Unavailable') or contains(m, 'high demand') then 'retryable' else 'other' end as error_class
        from (select event_id, {_ERR} as m from events) x""",
)


def _jn14(t):
    clauses = t.clauses.select("clause_id", "contract_id", tx.content_hash(F.col("text")).alias("content_hash"))
    known = t.analyses.join(clauses, "clause_id").select(
        F.col("clause_id").alias("analysis_id"), "content_hash", "risk_level", F.col("created_at")
    )
    hits, misses = an.reuse_analyses(clauses, known, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"))
    return hits.select("clause_id", "analysis_id", "risk_level").unionByName(
        misses.select("clause_id", F.lit(-1).cast("long").alias("analysis_id"), F.lit("").alias("risk_level"))
    )


query(
    "jn14_reuse_analyses",
    _jn14,
    """select c.clause_id, coalesce(n.analysis_id, -1) as analysis_id, coalesce(n.risk_level, '') as risk_level from ch c left join (
         select c.content_hash, a.clause_id as analysis_id, a.risk_level from analyses a join ch c on c.clause_id = a.clause_id where a.created_at > timestamp '2024-01-02 12:00:00'
         qualify row_number() over (partition by c.content_hash order by a.created_at desc, a.clause_id desc) = 1) n on n.content_hash = c.content_hash""",
    ch=f"select clause_id, sha256({ws('text')}) as content_hash from clauses",
)


def _jn15(t):
    names = F.array(*[F.lit(n) for n, _, _ in qu.TASK_ROUTES])
    tasks = t.base("events").select("event_id", F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")).alias("task_type"))
    routes = t.spark.createDataFrame(qu.TASK_ROUTES, "task_type string, model_key string, chain string")
    chain = t.spark.createDataFrame(CHAIN, "chain string, rank int, model_key string")
    return an.route_model(tasks, routes, chain, usage(t)).select("event_id", "model_key", F.coalesce("chosen_key", F.lit("")).alias("chosen_key"))


SQL_USAGE = f"""select l.model_key, coalesce(c.used, 0) as used, greatest(0, l.day_limit - coalesce(c.used, 0)) as remaining, l.day_limit as "limit" from lim l left join (
    select model_key, count(*) as used from calls where ts >= timestamp '2024-01-10 08:00:00' and ts < timestamp '2024-01-11 08:00:00' group by 1) c on c.model_key = l.model_key"""
SQL_LIM = values(LIMITS, "model_key, day_limit, minute_limit, min_interval_ms")
query(
    "jn15_route_model",
    _jn15,
    """select e.event_id, r.model_key, coalesce(case when u.remaining > 0 then r.model_key else (select arg_min(ch.model_key, ch.rank) from chain ch join us x on x.model_key = ch.model_key
         where ch.chain = r.chain and x.remaining > 0) end, '') as chosen_key
       from events e join (select *, row_number() over (order by ord) - 1 as k from routes) r on r.k = e.event_id % 12 left join us u on u.model_key = r.model_key""",
    lim=SQL_LIM,
    us=SQL_USAGE,
    routes=values([(k, *r) for k, r in enumerate(qu.TASK_ROUTES)], "ord, task_type, model_key, chain"),
    chain=values(CHAIN, "chain, rank, model_key"),
)


def _wn34(t):
    pending = t.clauses.join(t.analyses.select("clause_id"), "clause_id", "left_anti").select("clause_id", "contract_id", "sort_order")
    quota = t.contracts.select("contract_id", (F.col("contract_id") % 20).alias("remaining"))
    return an.plan_analysis_run(pending, quota, 60).select("clause_id", "selected", "run_status")


query(
    "wn34_plan_analysis_run",
    _wn34,
    """select clause_id, sel as selected, case when bool_and(sel) over (partition by contract_id) then 'ready' else 'partial' end as run_status from (
         select clause_id, contract_id, k * 6 <= 60 and k <= contract_id % 20 as sel from (select *, row_number() over (partition by contract_id order by sort_order, clause_id) as k
           from clauses where clause_id not in (select clause_id from analyses)) a) b""",
)

# ------------------------------------------------------------------ quota and progress

query("ag15_quota_usage", usage, 'select model_key, used, remaining, "limit" from us', lim=SQL_LIM, us=SQL_USAGE)
query(
    "ag16_quota_groups",
    lambda t: qu.quota_groups(usage(t), groups(t)).select(
        F.coalesce("grp", F.lit("all")).alias("grp"), F.coalesce("model_key", F.lit("all")).alias("model_key"), "used", "remaining", "limit"
    ),
    """select coalesce(grp, 'all') as grp, coalesce(model_key, 'all') as model_key, sum(used)::bigint as used, case when model_key is not null then sum(remaining)::bigint
         else greatest(0, sum("limit") - sum(used))::bigint end as remaining, sum("limit")::bigint as "limit" from us join grps using (model_key) group by grouping sets ((grp, model_key), (grp), ())""",
    lim=SQL_LIM,
    us=SQL_USAGE,
    grps=values(GROUPS, "grp, model_key"),
)
query(
    "ag17_extra_contracts",
    lambda t: qu.extra_contracts(usage(t)),
    """select greatest(0, floor(least(max(case when model_key = 'flash31Lite' then "limit" - used end) / 80.0, max(case when model_key = 'embedding' then "limit" - used end) / 40.0)))::bigint as extra_contracts from us""",
    lim=SQL_LIM,
    us=SQL_USAGE,
)
query(
    "wn30_rate_violations",
    lambda t: qu.rate_violations(t.calls, limits(t)).withColumn("gap_ms", F.coalesce("gap_ms", F.lit(-1))),
    """select event_id, c.model_key, coalesce(c.gap, -1) as gap_ms, c.rpm, coalesce(c.gap < l.min_interval_ms, false) as too_close, c.rpm > l.minute_limit as too_many from (
         select *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by model_key order by ts, event_id) as gap,
           count(*) over (partition by model_key order by epoch_us(ts) // 1000 range between 60000 preceding and current row) as rpm from calls) c join lim l on l.model_key = c.model_key""",
    lim=SQL_LIM,
)
# the events are minutes apart, so the throttle is run at six hours as well as at its default
SQL_THROTTLE = """select event_id, contract_id, percent from (with recursive o as (select *, epoch_us(ts) // 1000 as ms, row_number() over (partition by contract_id order by ts, event_id) as rn from progress),
    rec as (select contract_id, rn, event_id, percent, ms as lms, percent as lp, true as kept from o where rn = 1
      union all select o.contract_id, o.rn, o.event_id, o.percent, case when o.percent <> r.lp and o.ms - r.lms >= {ms} then o.ms else r.lms end,
        case when o.percent <> r.lp and o.ms - r.lms >= {ms} then o.percent else r.lp end, o.percent <> r.lp and o.ms - r.lms >= {ms}
      from rec r join o on o.contract_id = r.contract_id and o.rn = r.rn + 1)
    select * from rec) x where kept"""
query(
    "wn32_throttle_progress",
    lambda t: qu.throttle_progress(t.progress).select("event_id", "contract_id", "percent"),
    SQL_THROTTLE.format(ms=3000),
)
query(
    "wn32_throttle_progress_six_hours",
    lambda t: qu.throttle_progress(t.progress, 21_600).select("event_id", "contract_id", "percent"),
    SQL_THROTTLE.format(ms=21_600_000),
)
query(
    "wn33_eta",
    # larger tables have stages beyond the five; here they take as long as the fifth
    lambda t: qu.eta(t.progress.withColumn("stage", F.floor(F.col("event_id") / 2000).cast("int") + 1), other_ms=qu.STAGE_MS[5]).select("event_id", "stage", "eta_ms"),
    # whole numbers of 1e-20 ms; what is rounded up has a fraction of 0.5 - 5e-10 or more, as rounding to nine places first gives
    """select p.event_id, cast(p.event_id // 2000 + 1 as int) as stage, case when p.event_id // 2000 + 1 <> 5 and elapsed_ms >= 8000 and overall > 0 and done then 0
         when s is not null then greatest(0, (s + 50000000050000000000::hugeint) // 100000000000000000000::hugeint)::bigint end as eta_ms from progress p left join (with recursive o as (
         select *, row_number() over (partition by contract_id order by ts, event_id) as rn,
           case when least(stage_progress, 99) > 5 and stage_elapsed_ms > 3000
             then stage_elapsed_ms::hugeint * (100 - least(stage_progress, 99)::hugeint) * 100000000000000000000::hugeint // greatest(1, least(stage_progress, 99)::hugeint)
             else (case stage when 1 then 5000 when 2 then 180000 when 3 then 30000 when 4 then 20000 else 60000 end)::hugeint * (100 - least(stage_progress, 99)::hugeint) * 1000000000000000000::hugeint end
           + (case stage when 1 then 230000 when 2 then 50000 when 3 then 20000 else 0 end)::hugeint * 100000000000000000000::hugeint as raw
         from (select * replace (cast(event_id // 2000 + 1 as int) as stage) from progress) p where stage <> 5 and elapsed_ms >= 8000 and overall > 0 and not done),
       rec as (select contract_id, rn, event_id, stage, raw as s from o where rn = 1
         union all select o.contract_id, o.rn, o.event_id, o.stage, case when o.stage = r.stage then (3 * r.s + 7 * o.raw) // 10 else o.raw end
         from rec r join o on o.contract_id = r.contract_id and o.rn = r.rn + 1)
       select * from rec) x on x.event_id = p.event_id""",
)

# ------------------------------------------------------------------ streaming


def _st1(t):
    inbox, sink = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "intake")
    pages = t.base("pages").select("page_id", F.regexp_replace("html", r"[\r\n]", " ").alias("html"))
    body = pages.select(F.expr("case when page_id % 3 = 0 then '%PDF-1.7 ' || html else html end").alias("html"), (F.col("page_id") % 3).alias("k"))
    body.where("k = 0").select("html").repartition(8).write.options(extension="pdf", sep="\u0001", quote="\u0002").csv(f"{inbox}/a")
    body.where("k = 1").select("html").repartition(8).write.options(extension="pdf", sep="\u0001", quote="\u0002").csv(f"{inbox}/b")
    body.where("k = 2").select("html").repartition(8).write.options(extension="htm", sep="\u0001", quote="\u0002").csv(f"{inbox}/c")
    st.intake_stream(t.spark, inbox, sink).awaitTermination()
    done = t.spark.read.parquet(f"{sink}/accepted").unionByName(t.spark.read.parquet(f"{sink}/rejected"))
    return done.groupBy(F.element_at(F.split("name", "[.]"), -1).alias("extension"), F.coalesce("reject_reason", F.lit("")).alias("reject_reason")).agg(F.count("*").alias("files"))


query(
    "st1_intake_stream",
    _st1,
    # eight files of each sort, or one a row
    """select case when k = 2 then 'htm' else 'pdf' end as extension, case k when 0 then '' when 1 then 'magic_pdf' else 'extension' end as reject_reason, least(8, n) as files
       from (select page_id % 3 as k, count(*) as n from pages group by 1) x""",
)


def _ts(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


query(
    "st2_latest_status_stream",
    lambda t: st.run_available(st.latest_status_stream(t.stream("status_events")), "status", "update", ["contract_id"]).select("contract_id", "status"),
    "select contract_id, status from status_events qualify row_number() over (partition by contract_id order by ts desc, seq desc) = 1",
)
query(
    "st3_throttle_stream",
    lambda t: st.run_available(st.throttle_stream(t.stream("progress")), "throttle").select("event_id", "contract_id", "percent"),
    SQL_THROTTLE.format(ms=3000),
)
query(
    "st4_quota_stream",
    lambda t: st.run_available(st.quota_stream(_ts(t.stream("calls"))), "quota", "update", ["model_key", "day_start"]).select(
        "model_key", F.date_format("day_start", "yyyy-MM-dd HH:mm").alias("day_start"), "used"
    ),
    """select model_key, strftime(time_bucket(interval 1 day, ts, timestamp '2000-01-01 08:00:00'), '%Y-%m-%d %H:%M') as day_start, count(*) as used from calls group by 1, 2""",
)
query(
    "st5_rate_stream",
    lambda t: st.run_available(st.rate_stream(_ts(t.stream("calls")), limits(t)), "rate", "update", ["model_key", "window_start"]).select(
        "model_key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "calls", "too_many"
    ),
    """select c.*, coalesce(calls > minute_limit, false) as too_many from (
         select model_key, strftime(time_bucket(interval 10 second, ts) - to_seconds(cast(u.k * 10 as int)), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as calls
         from calls, unnest(range(0, 6)) as u(k) group by 1, 2) c left join lim l on l.model_key = c.model_key""",
    lim=SQL_LIM,
)
query(
    "st5_interval_stream",
    # the static side of the join is the table of limits, the batch twin is that of wn30
    lambda t: st.run_available(st.interval_stream(_ts(t.stream("calls")), limits(t)), "interval").select("event_id", "model_key", F.coalesce("gap_ms", F.lit(-1)).alias("gap_ms"), "too_close"),
    """select event_id, c.model_key, coalesce(gap, -1) as gap_ms, coalesce(gap < min_interval_ms, false) as too_close from (
         select *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by model_key order by ts, event_id) as gap from calls) c left join lim l on l.model_key = c.model_key""",
    lim=SQL_LIM,
)
query(
    "st6_dedup_stream",
    lambda t: st.run_available(
        st.dedup_stream(
            t.stream("clauses").select(tx.content_hash(F.col("text")).alias("content_hash"), F.col("created_at").cast("timestamp").alias("ts"))
        ),
        "dedup",
    ).select("content_hash"),
    f"select distinct sha256({ws('text')}) as content_hash from clauses",
)
