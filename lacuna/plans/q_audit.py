"""Audit-trail queries. The event stream plays the audit events; its id is the sequence number."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import accumulator as AC
from lacuna.operators import audit as A
from lacuna.params import GENESIS_HASH
from lacuna.plans.ctes import cte
from lacuna.plans.lens import Tables, tag
from lacuna.plans.registry import query
from lacuna.plans.stages import scratch, written


def audit_events(spark, d):
    e = Tables(spark, d).events
    none = F.lit(None).cast("string")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"), tag("USR", F.col("user_id")).alias("user_id"),
                    F.lit("EXAMINER").alias("actor_role"), F.upper("event_type").alias("action"), F.lit("Event").alias("entity_type"),
                    F.col("event_id").cast("string").alias("entity_id"), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("status"),
                    none.alias("correlation_id"), none.alias("before_after"), F.col("props").alias("metadata"))


cte("audit_events", "", """SELECT event_id AS seq, ts AS timestamp, 'USR-' || user_id AS user_id, upper(event_type) AS action, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, event_id // 128 AS pos,
 to_json(struct_pack("action" := upper(event_type), actor_role := 'EXAMINER', before_after := '{}', correlation_id := NULL::varchar, entity_id := cast(event_id as varchar), entity_type := 'Event', metadata := coalesce(props, '{}'),
 status := CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END, ts := strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), user_id := 'USR-' || user_id))::varchar AS payload FROM events""")
cte("audit_blocks", "audit_events", "SELECT pos, sha256(string_agg(sha256(payload), '' ORDER BY seq)) AS digest FROM audit_events GROUP BY pos")
_BEFORE = lambda src, same: f"coalesce((SELECT sha256(string_agg(digest, '' ORDER BY p.pos)) FROM {src} p WHERE p.pos < b.pos{same} HAVING count(*) > 0), '')"
cte("audit_groups", "audit_blocks", "SELECT pos // 128 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM audit_blocks GROUP BY 1")
cte("audit_trails", "audit_blocks audit_groups", f"""SELECT x.pos, '/' || x.before || '/' || g.before AS trail FROM
 (SELECT b.pos, {_BEFORE('audit_blocks', ' AND p.pos // 128 = b.pos // 128')} AS before FROM audit_blocks b) x JOIN (SELECT b.pos, {_BEFORE('audit_groups', '')} AS before FROM audit_groups b) g ON g.pos = x.pos // 128""")
cte("audit_anchors", "audit_trails", f"""SELECT pos, CASE WHEN replace(trail, '/', '') = '' THEN '{GENESIS_HASH}' ELSE sha256(rtrim(trail, '/')) END AS anchor FROM audit_trails""")
cte("audit_numbered", "audit_events", "SELECT *, row_number() OVER (PARTITION BY pos ORDER BY seq) AS i FROM audit_events")
cte("audit_chain", "audit_numbered audit_anchors", """SELECT n.pos, i, seq, anchor AS previous_hash, sha256(anchor || payload) AS integrity_hash FROM audit_numbered n JOIN audit_anchors a ON a.pos = n.pos WHERE i = 1
 UNION ALL SELECT n.pos, n.i, n.seq, c.integrity_hash, sha256(c.integrity_hash || n.payload) FROM audit_chain c JOIN audit_numbered n ON n.pos = c.pos AND n.i = c.i + 1""")


@query("audit_chain", "audit_chain", "SELECT seq, previous_hash, integrity_hash FROM audit_chain")
def audit_chain(spark, d):
    return A.chain(audit_events(spark, d)).select("seq", "previous_hash", "integrity_hash")


@query("audit_append", "audit_chain", "SELECT seq, previous_hash, integrity_hash FROM audit_chain WHERE seq > (SELECT (max(seq) * 2) // 3 FROM audit_chain)")
def audit_append(spark, d):
    """The last third of the events arrives later; the chain must be the one that all of them would have had."""
    events = audit_events(spark, d)
    last = F.floor(events.agg(F.max("seq") * 2).scalar() / 3)
    log = written(A.chain(events.where(F.col("seq") <= last)), "audit_log", scratch(spark))
    return A.append(log, events.where(F.col("seq") > last), digests=A.block_digests(log)).select("seq", "previous_hash", "integrity_hash")


@query("audit_verification", "audit_events", "SELECT count(*) AS total_events, 0::BIGINT AS problem_count, count(*) AS verified_count, NULL::BIGINT AS first_broken_seq, NULL::varchar AS first_problem, true AS is_intact FROM audit_events")
def audit_verification(spark, d):
    return A.verify(A.chain(audit_events(spark, d)))


@query("audit_tamper_check", "audit_events", """SELECT count(*) AS total_events, min(seq) FILTER (action = 'ERROR') AS first_broken_seq, count(*) FILTER (seq < (SELECT min(seq) FROM audit_events WHERE action = 'ERROR')) AS verified_count, false AS is_intact FROM audit_events""")
def audit_tamper_check(spark, d):
    """Rewrite the status of every failed event after the fact: the first one must be reported."""
    log = A.chain(audit_events(spark, d)).withColumn("status", F.lit("SUCCESS"))
    return A.verify(log).select("total_events", "first_broken_seq", "verified_count", "is_intact")


@query("audit_search", "audit_events", """SELECT seq, user_id, action, status FROM audit_events WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND action = 'ERROR' AND status = 'FAILURE'""")
def audit_search(spark, d):
    return A.search(audit_events(spark, d), date_from="2024-01-05", date_to="2024-01-20", action="ERROR", status="FAILURE",
                    actor_role="EXAMINER", entity_type="Event").select("seq", "user_id", "action", "status")


_PER_RANGE = 5000
cte("audit_ranked", "audit_events", "SELECT seq, timestamp, action, row_number() OVER (ORDER BY timestamp DESC, seq DESC) AS r, count(*) OVER () AS total FROM audit_events")


def _pages(spark, d, where=None):
    """The log as pages; with ``where``, the rows that it holds for are stored first and the others appended."""
    index, events = A.pages(spark, scratch(spark, "pages")), audit_events(spark, d)
    for rows in [events] if where is None else [events.where(where), events.where(~where)]:
        index.append(rows, _PER_RANGE)
    return index


@query("audit_page", "audit_ranked", "SELECT seq, action, total FROM audit_ranked WHERE r > 100 AND r <= 150")
def audit_page(spark, d):
    index = _pages(spark, d)
    return index.page(50, 100, newest_first=True).select("seq", "action", F.lit(index.total()).alias("total"))


@query("audit_page_deep", "audit_ranked", "SELECT seq, action, r - 1 AS before FROM audit_ranked WHERE r > total * 3 // 4 AND r <= total * 3 // 4 + 50")
def audit_page_deep(spark, d):
    """A page after three quarters of the log; it reads the one or two ranges that it overlaps."""
    index = _pages(spark, d)
    total = index.total()
    return index.page(50, total * 3 // 4, newest_first=True).select("seq", "action", (F.lit(total - 1) - F.col("place")).alias("before"))


@query("audit_page_next", "audit_ranked", "SELECT seq, action FROM audit_ranked WHERE timestamp < TIMESTAMP '2024-01-16' ORDER BY r LIMIT 50")
def audit_page_next(spark, d):
    """The page before a key that is no event's, in a log that was appended to after its first pages were stored."""
    first = F.col("timestamp") < F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return _pages(spark, d, first).page_before([datetime(2024, 1, 16), -1], 50).select("seq", "action")


# --- accumulator -------------------------------------------------------------------------
_SQL_LEVELS = 34  # enough for 2^34 events
cte("mmr0", "audit_events", "SELECT 0 AS level, seq - (SELECT min(seq) FROM audit_events) AS at, sha256('leaf:' || payload) AS digest FROM audit_events")
for _k in range(1, _SQL_LEVELS):
    cte(f"mmr{_k}", f"mmr{_k - 1}", f"SELECT {_k} AS level, l.at // 2 AS at, sha256('node:' || l.digest || r.digest) AS digest FROM mmr{_k - 1} l JOIN mmr{_k - 1} r ON r.at = l.at + 1 WHERE l.at % 2 = 0")
cte("mmr", " ".join(f"mmr{_k}" for _k in range(_SQL_LEVELS)), " UNION ALL ".join(f"SELECT * FROM mmr{_k}" for _k in range(_SQL_LEVELS)))
cte("mmr_sizes", "audit_events", "SELECT (count(*) * 2) // 3 AS n FROM audit_events UNION SELECT count(*) FROM audit_events")
cte("mmr_peaks", "mmr mmr_sizes", f"""SELECT s.n, m.level, m.at, m.digest FROM (SELECT n, unnest(range(0, {_SQL_LEVELS})) AS level FROM mmr_sizes) s JOIN mmr m ON m.level = s.level AND m.at = (s.n >> s.level) - 1
 WHERE (s.n >> s.level) % 2 = 1""")


def _accumulated(spark, d, share: int = 3):
    """Nodes of the whole log: its first two thirds were accumulated earlier, the rest is appended. Both sizes are told."""
    leaves = written(A.leaves(audit_events(spark, d)), "leaves", scratch(spark))
    n = leaves.count()
    old = n * 2 // share
    root = scratch(spark)
    nodes = written(AC.extended(leaves.where(F.col("at") < old)), "nodes_before", root)
    more = written(AC.extended(leaves.where(F.col("at") >= old), nodes), "nodes_after", root)
    return leaves, nodes.unionByName(more), old, n


@query("audit_accumulator", "mmr_peaks", "SELECT n, sha256('root:' || n || ':' || string_agg(digest, '' ORDER BY level DESC)) AS root FROM mmr_peaks GROUP BY n")
def audit_accumulator(spark, d):
    """Roots of the log before and after the last third arrived."""
    _, nodes, old, n = _accumulated(spark, d)
    return AC.root(nodes, old).union(AC.root(nodes, n))


@query("audit_inclusion", "mmr mmr_peaks", f"""SELECT e.at, count(m.digest) AS n_steps, sha256(coalesce(string_agg(m.digest, '' ORDER BY m.level), '')) AS path_digest, true AS is_included FROM
 (SELECT l.at, p.level AS top FROM mmr0 l JOIN (SELECT * FROM mmr_peaks WHERE n = (SELECT max(n) FROM mmr_sizes)) p ON (l.at >> p.level) = p.at) e
 LEFT JOIN (SELECT x.at AS leaf, unnest(range(0, {_SQL_LEVELS})) AS level FROM mmr0 x) k ON k.leaf = e.at AND k.level < e.top LEFT JOIN mmr m ON m.level = k.level AND m.at = xor(e.at >> k.level, 1) GROUP BY e.at""")
def audit_inclusion(spark, d):
    """The proof of every event under the last root: its length, a digest of it, and whether it holds."""
    leaves, nodes, _, n = _accumulated(spark, d)
    proofs = written(AC.all_paths(nodes, n), "proofs", scratch(spark))
    checked = AC.all_included(leaves, proofs, AC.peaks(nodes, n))
    return checked.select("at", F.size("path").cast("long").alias("n_steps"), F.sha2(F.array_join("path", ""), 256).alias("path_digest"), "is_included")


@query("audit_consistency", "mmr mmr_peaks", f"""SELECT o.level, o.at, k.step, m.digest AS sibling FROM (SELECT * FROM mmr_peaks WHERE n = (SELECT min(n) FROM mmr_sizes)) o
 JOIN (SELECT * FROM mmr_peaks WHERE n = (SELECT max(n) FROM mmr_sizes)) p ON p.level > o.level AND (o.at >> (p.level - o.level)) = p.at
 JOIN (SELECT unnest(range(0, {_SQL_LEVELS})) AS step) k ON k.step < p.level - o.level JOIN mmr m ON m.level = o.level + k.step AND m.at = xor(o.at >> k.step, 1)""")
def audit_consistency(spark, d):
    """The proof that the log before is a beginning of the log after."""
    _, nodes, old, n = _accumulated(spark, d)
    return AC.consistency(nodes, old, n)
