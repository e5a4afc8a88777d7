"""Conversations folded into questions, and call quotas over ``events``."""

from pyspark.sql import functions as F

from hiregrain.checks.registry import check, collapse
from hiregrain.operators import conversation as C
from hiregrain.operators import quota as Q

LINE = f"CASE WHEN length({{c}}) <= 120 THEN {{c}} ELSE substr({{c}}, 1, 119) || '…' END".replace("{c}", collapse("text"))
FIT = "length('Ngữ cảnh trước đó:' || chr(10)) + length(array_to_string(list_slice(l, d + 1, len(l)), chr(10))) + 1 + length('Câu hỏi hiện tại: ' || q) <= 500"


@check(f"""WITH m AS (SELECT conv_id, turn, role, '- ' || CASE role WHEN 'user' THEN 'Tôi' ELSE 'Trợ lý' END || ': ' || {LINE} AS line,
  CASE WHEN length({collapse('text')}) <= 500 THEN {collapse('text')} ELSE substr({collapse('text')}, 1, 499) || '…' END AS q FROM conversations),
w AS (SELECT conv_id, turn, role, q, coalesce(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS l FROM m),
f AS (SELECT *, (SELECT min(d) FROM (SELECT unnest(range(0, 6)) AS d) r WHERE d < len(l) AND {FIT}) AS d FROM w WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN d IS NULL OR length('Câu hỏi hiện tại: ' || q) >= 500 THEN q
  ELSE 'Ngữ cảnh trước đó:' || chr(10) || array_to_string(list_slice(l, d + 1, len(l)), chr(10)) || chr(10) || 'Câu hỏi hiện tại: ' || q END AS query FROM f""")
def conversation_folding(t):
    return C.fold_context(t.conversations.withColumn("summary", C.summarize_text("text")))


@check("""WITH p AS (SELECT l_orderkey, list(p_name ORDER BY p_name, p_partkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderpriority
  WHEN o_orderkey % 4 = 1 THEN CASE WHEN names IS NULL THEN 'none' ELSE 'tìm được job: ' || array_to_string(list_slice(names, 1, 4), ', ') END
  WHEN o_orderkey % 4 = 2 THEN 'CV có skill ' || coalesce(array_to_string(list_slice(names, 1, 8), ', '), '') || '; job hợp: ' || coalesce(array_to_string(list_slice(names, 1, 4), ', '), '')
  ELSE 'CV còn thiếu: ' || coalesce(array_to_string(list_slice(names, 1, 6), ', '), '') END AS summary FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def conversation_summaries(t):
    parts = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))), lambda x: x["p_name"]).alias("names")
    )
    n = F.col("o_orderkey") % 4
    messages = t.orders.join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", F.when(n == 0, "text").when(n == 1, "agent").when(n == 2, "cv_match").otherwise("cv_gap").alias("kind"),
        (F.col("o_orderkey") % 11 == 0).alias("error"), F.col("o_orderpriority").alias("content"), F.lit("none").alias("answer"),
        F.col("names").alias("job_titles"), F.array().cast("array<string>").alias("sql_rows"), F.col("names").alias("skills"), F.col("names").alias("missing_skills"),
    )
    return messages.select("o_orderkey", C.summarize_message().alias("summary"))


def calls_of(t):
    return t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("call_id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"))


# Two calls in any window: the next admitted call follows the last one and is a window after the one before it.
ADMITTED = """calls AS (SELECT user_id AS client, event_id AS call_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
chain AS (SELECT client, i, CAST(NULL AS BIGINT) AS before, ts AS last FROM calls WHERE i = 1
  UNION ALL SELECT c.client, c.i, k.last, c.ts FROM chain k JOIN calls c ON c.client = k.client AND c.i = (
    SELECT min(n.i) FROM calls n WHERE n.client = k.client AND n.i > k.i AND (k.before IS NULL OR n.ts >= k.before + {w}))),
admitted AS (SELECT c.client, c.call_id, c.ts, k.i IS NOT NULL AS admitted FROM calls c LEFT JOIN (SELECT DISTINCT client, i FROM chain) k ON k.client = c.client AND k.i = c.i)"""


HOUR = ADMITTED.replace("{w}", "21600000000")


@check(f"WITH RECURSIVE {HOUR} SELECT client, call_id, admitted FROM admitted")
def quota_sliding(t):
    """At most two calls of a client in any six hours."""
    return Q.sliding_quota(calls_of(t), 2, 21_600).select("client", "call_id", "admitted")


# The true rule call by call: the day's count first, then the client's last two admitted calls.
CAPPED = """log AS (SELECT user_id AS client, event_id AS call_id, epoch_us(ts) AS ts, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS BIGINT) AS wait, CAST(-1 AS BIGINT) AS day, CAST(0 AS BIGINT) AS n,
    CAST(MAP {} AS MAP(BIGINT, BIGINT[])) AS taken
  UNION ALL SELECT i, call_id, wait, day, n + CASE WHEN wait IS NULL THEN 1 ELSE 0 END,
    CASE WHEN wait IS NULL THEN map_concat(taken, MAP([client], [list_append(list_slice(own, -1, -1), ts)])) ELSE taken END
  FROM (SELECT *, CASE WHEN n >= 100 THEN 3600 WHEN len(own) < 2 OR ts - own[1] >= 21600000000 THEN NULL
      ELSE greatest(1, (21600000000 - (ts - own[1]) + 999999) // 1000000) END AS wait
    FROM (SELECT c.i, c.call_id, c.client, c.ts, c.ts // 86400000000 AS day, CASE WHEN c.ts // 86400000000 = s.day THEN s.n ELSE 0 END AS n, s.taken,
        coalesce(s.taken[c.client], CAST([] AS BIGINT[])) AS own FROM step s JOIN log c ON c.i = s.i + 1)))"""


@check(f"WITH RECURSIVE {CAPPED} SELECT call_id, wait IS NULL AS admitted, CAST(wait AS INTEGER) AS wait FROM step WHERE i > 0")
def quota_daily_cap(t):
    """A hundred calls a day in all, and at most two of a client in any six hours."""
    return Q.capped_quota(calls_of(t), 2, 100, 21_600).select("call_id", "admitted", "wait")


@check("""SELECT event_id AS call_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def quota_offered_load(t):
    return Q.offered_load(calls_of(t), 3600).select("call_id", "recent")


@check("""SELECT event_id AS call_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def quota_offered_load_minute(t):
    return Q.offered_load(calls_of(t)).select("call_id", "recent")
