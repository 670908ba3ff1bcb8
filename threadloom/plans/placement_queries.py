"""Tiers, scopes, slots and consolidation of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import placement
from threadloom.plans.base import FACTS, facts, query, table

KINDS = ("decision", "constraint", "preference", "pattern", "knowledge")
TIERS = ("workstream", "workspace", "project-current", "decision")
_PLACED = f"""{FACTS}, placed AS (SELECT id, fact, scope_type, is_active, confirmations, age_days, CASE WHEN id % 29 <> 0 AND scope_type = 'project' THEN project END AS project_id,
    ({list(TIERS)})[CAST(id // 20 % 4 + 1 AS INTEGER)] AS tier, CASE WHEN id // 20 % 4 < 2 AND id % 13 <> 0 THEN 'w' || (id // 20 % 5) END AS workspace_id, CASE WHEN id // 20 % 4 = 0 AND id % 17 <> 0 THEN 's' || (id // 20 % 7) END AS workstream_id,
    ({list(KINDS)})[CAST(id // 40 % 5 + 1 AS INTEGER)] AS kind, CASE WHEN id % 6 <> 0 THEN ({list(KINDS)})[CAST(id // 40 % 5 + 1 AS INTEGER)] || '.k' || (id // 20 % 3) END AS subject_key FROM facts)"""


def placed(spark, sf_dir):
    i, block = F.col("id"), F.floor(F.col("id") / 20)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    named = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    kind = pick(KINDS, F.floor(i / 40) % 5)
    return facts(spark, sf_dir).select(
        "id", "fact", "scope_type", "is_active", "confirmations", "age_days", F.when((i % 29 != 0) & (F.col("scope_type") == "project"), F.col("project")).alias("project_id"),
        pick(TIERS, block % 4).alias("tier"), F.when((block % 4 < 2) & (i % 13 != 0), named("w", block % 5)).alias("workspace_id"), F.when((block % 4 == 0) & (i % 17 != 0), named("s", block % 7)).alias("workstream_id"),
        kind.alias("kind"), F.when(i % 6 != 0, F.concat(kind, named(".k", block % 3))).alias("subject_key"),
    )


@query(f"""WITH {_PLACED} SELECT id, CASE WHEN scope_type = 'global' THEN 'global' WHEN project_id IS NULL THEN NULL WHEN tier = 'workstream' THEN 'workstream:' || workstream_id WHEN tier = 'workspace' THEN 'workspace:' || workspace_id ELSE 'project:' || project_id END AS scope FROM placed""")
def flt05_fact_scope(spark, sf_dir):
    cols = [F.col(c) for c in ("scope_type", "project_id", "tier", "workspace_id", "workstream_id")]
    return placed(spark, sf_dir).select("id", placement.fact_scope(*cols).alias("scope"))


@query("""SELECT o_orderkey AS session_id, CASE WHEN s.s_suppkey IS NULL THEN NULL WHEN s.s_acctbal > 0 AND o_orderkey % 3 <> 0 THEN 'workstream:c' || o_custkey ELSE 'global' END AS scope FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_custkey""")
def flt04_session_scope(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"), (F.col("s_acctbal") <= 0).alias("quarantined"), F.col("s_name").alias("project"))
    stream = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").join(s, "o_custkey", "left").select(F.col("o_orderkey").alias("session_id"), placement.session_scope(F.col("project").isNotNull(), F.col("quarantined"), F.col("project"), stream).alias("scope"))


@query("""WITH d AS (SELECT event_id, CAST(2024 AS VARCHAR) || '-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(user_id % 33 AS VARCHAR), 2, '0') AS raw FROM events)
SELECT event_id, try_cast(raw AS DATE) IS NOT NULL AS valid FROM d""")
def flt12_date_check(spark, sf_dir):
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    raw = F.concat_ws("-", F.lit("2024"), part(F.col("event_id") % 14), part(F.col("user_id") % 33))
    return table(spark, sf_dir, "events").select("event_id", (raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(raw, "yyyy-MM-dd").isNotNull()).alias("valid"))


@query(f"""WITH {_PLACED} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE kind END IS NULL AND confirmations < 3 AS first_try, id % 3 = 0 AND confirmations >= 3 AND age_days % 2 = 0 AS parked_again FROM placed WHERE is_active AND ((id % 3 = 0 AND confirmations < 3) OR (id % 3 = 0 AND confirmations >= 3 AND age_days % 2 = 0))""")
def flt17_classification_backlog(spark, sf_dir):
    # No category and attempts left, or parked under another token than the current one.
    unclassified, attempts, token = F.col("id") % 3 == 0, F.col("confirmations"), F.col("age_days") % 2
    first, again = unclassified & (attempts < 3), unclassified & (attempts >= 3) & (token == 0)
    return placed(spark, sf_dir).where(F.col("is_active") & (first | again)).select("id", first.alias("first_try"), again.alias("parked_again"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN ' ' WHEN page_id % 7 = 1 THEN 'unknown' WHEN page_id % 7 = 2 THEN '///' WHEN page_id % 7 = 3 THEN NULL ELSE '/w/' || page_id || '/' END AS path FROM pages)
SELECT page_id, trim(coalesce(path, '')) IN ('', 'unknown') OR trim(path, '/') = '' AS untrusted FROM p""")
def flt19_untrusted_path(spark, sf_dir):
    k = F.col("page_id") % 7
    path = F.when(k == 0, " ").when(k == 1, "unknown").when(k == 2, "///").when(k == 3, F.lit(None)).otherwise(F.concat(F.lit("/w/"), F.col("page_id").cast("string"), F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", placement.untrusted_path(path).alias("untrusted"))


def _pair_sql(c: str) -> str:
    return f"a.{c} IS NOT DISTINCT FROM b.{c}"


@query(f"""WITH {_PLACED}, p AS (SELECT a.id AS a_id, b.id AS b_id, ['DUPLICATE', 'CONTRADICTION', 'EVOLUTION'][CAST(a.id % 3 + 1 AS INTEGER)] AS relation,
CASE WHEN NOT a.is_active OR NOT b.is_active THEN 'inactive participant' WHEN a.scope_type <> b.scope_type THEN 'different scope types'
 WHEN a.scope_type = 'project' AND (a.project_id IS NULL OR b.project_id IS NULL) THEN 'legacy or incomplete project identity'
 WHEN a.scope_type = 'project' AND NOT ({_pair_sql('project_id')} AND {_pair_sql('tier')} AND {_pair_sql('workspace_id')} AND {_pair_sql('workstream_id')}) THEN 'different mutation scope'
 WHEN a.scope_type = 'project' AND a.tier = 'workstream' AND a.workstream_id IS NULL THEN 'missing workstream identity'
 WHEN a.scope_type = 'project' AND a.tier = 'workspace' AND (a.workspace_id IS NULL OR a.workstream_id IS NOT NULL) THEN 'invalid workspace identity'
 WHEN a.scope_type <> 'project' AND (a.workspace_id IS NOT NULL OR b.workspace_id IS NOT NULL OR a.workstream_id IS NOT NULL OR b.workstream_id IS NOT NULL) THEN 'global fact has project identity'
 WHEN a.subject_key <> b.subject_key THEN 'different subjects' WHEN a.id % 3 <> 0 AND (a.subject_key IS NULL OR b.subject_key IS NULL) THEN 'unresolved competing subject' END AS why
FROM placed a JOIN placed b ON b.id = a.id + CASE WHEN a.id % 2 = 0 THEN 80 ELSE 560 END) SELECT a_id, b_id, why FROM p""")
def flt22_why_not_consolidate(spark, sf_dir):
    p = placed(spark, sf_dir)
    a = p.select(*(F.col(c).alias(f"a_{c}") for c in p.columns)).withColumn("b_id", F.col("a_id") + F.when(F.col("a_id") % 2 == 0, 80).otherwise(560))
    b = p.select(*(F.col(c).alias(f"b_{c}") for c in p.columns))
    relation = F.element_at(F.array(F.lit("DUPLICATE"), F.lit("CONTRADICTION"), F.lit("EVOLUTION")), (F.col("a_id") % 3 + 1).cast("int"))
    return a.join(b, "b_id").select("a_id", "b_id", placement.why_not_consolidate("a_", "b_", relation).alias("why"))


@query(f"""WITH {_PLACED}, k AS (SELECT id, kind, lower(trim(CASE id % 5 WHEN 0 THEN ' ' || subject_key WHEN 1 THEN upper(subject_key) WHEN 2 THEN 'state.' || id WHEN 3 THEN kind ELSE kind || '..x' END)) AS key FROM placed)
SELECT id, CASE WHEN regexp_full_match(key, '[a-z][a-z0-9_-]*(\\.[a-z0-9][a-z0-9_-]*)+') AND split_part(key, '.', 1) = CASE kind WHEN 'knowledge' THEN 'state' ELSE kind END THEN key END AS subject_key FROM k""")
def flt23_subject_key(spark, sf_dir):
    k = F.col("id") % 5
    raw = F.when(k == 0, F.concat(F.lit(" "), "subject_key")).when(k == 1, F.upper("subject_key")).when(k == 2, F.concat(F.lit("state."), F.col("id").cast("string"))).when(k == 3, F.col("kind")).otherwise(F.concat("kind", F.lit("..x")))
    return placed(spark, sf_dir).select("id", placement.subject_key(raw, F.col("kind")).alias("subject_key"))


@query(f"""WITH {_PLACED}, held AS (SELECT project_id, subject_key, tier, workspace_id, workstream_id, min(id) AS holder FROM placed WHERE is_active AND subject_key IS NOT NULL AND project_id IS NOT NULL GROUP BY ALL)
SELECT r.id AS request_id, holder FROM placed r LEFT JOIN held h ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM h.{c}' for c in placement.SLOT)}""")
def chr08_slot_lookup(spark, sf_dir):
    p = placed(spark, sf_dir)
    return placement.slot_holders(p.select(F.col("id").alias("request_id"), *placement.SLOT), p)


@query(f"""WITH {FACTS} SELECT id, round(CASE WHEN confirmations > 0 THEN 3 * (1 + log2(confirmations + 1)) ELSE 3 END + CASE WHEN age_days <= 7 THEN 5 WHEN age_days <= 30 THEN 3 WHEN age_days <= 90 THEN 1 ELSE 0 END + CASE WHEN scope_type = 'project' THEN 2 ELSE 0 END, 6) AS score FROM facts WHERE is_active""")
def chr11_rank_score(spark, sf_dir):
    return facts(spark, sf_dir).where("is_active").select("id", F.round(placement.rank_score(F.col("confirmations"), F.col("age_days"), F.col("scope_type")), 6).alias("score"))


@query(f"""WITH {_PLACED}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT p.id, coalesce(project_id, '-') AS project, v FROM placed p JOIN v USING (id) WHERE is_active),
n AS (SELECT a.id, b.id AS nearest, 1 - power(list_distance(a.v, b.v), 2) / 2 AS similarity FROM s a JOIN s b ON a.project = b.project AND a.id <> b.id)
SELECT id, nearest, round(similarity, 6) AS similarity FROM n WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, nearest) = 1""")
def chr12_nearest_in_scope(spark, sf_dir):
    f = placed(spark, sf_dir).where("is_active").select("id", F.coalesce("project_id", F.lit("-")).alias("project"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return placement.nearest_in_scope(f, v, ["project"], 0.1).drop("asked").withColumn("similarity", F.round("similarity", 6))


_VERDICTS = "verdicts AS (SELECT id AS survivor, id + 1 AS other, ['DUPLICATE', 'CONTRADICTION', 'EVOLUTION', 'INDEPENDENT'][CAST(id // 2 % 4 + 1 AS INTEGER)] AS relation FROM facts WHERE id % 2 = 0)"


@query(f"""WITH {FACTS}, {_VERDICTS}, r AS (SELECT other AS id FROM verdicts WHERE relation = 'DUPLICATE' UNION SELECT survivor FROM verdicts WHERE relation IN ('CONTRADICTION', 'EVOLUTION')),
g AS (SELECT v.survivor AS id, f.project AS more FROM verdicts v JOIN facts f ON f.id = v.other WHERE relation = 'DUPLICATE')
SELECT f.id, is_active AND r.id IS NULL AS is_active, confirmations + CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS confirmations, array_to_string(list_sort(list_distinct(list_filter([project, more], lambda x: x IS NOT NULL))), ',') AS sources
FROM facts f LEFT JOIN r USING (id) LEFT JOIN g USING (id)""")
def chr13_consolidate(spark, sf_dir):
    f = facts(spark, sf_dir)
    names = F.array(*map(F.lit, ("DUPLICATE", "CONTRADICTION", "EVOLUTION", "INDEPENDENT")))
    verdicts = f.where("id % 2 = 0").select(F.col("id").alias("survivor"), (F.col("id") + 1).alias("other"), F.element_at(names, (F.floor(F.col("id") / 2) % 4 + 1).cast("int")).alias("relation"))
    return placement.consolidate(f.select("id", "is_active", "confirmations", F.array("project").alias("sources")), verdicts).withColumn("sources", F.array_join("sources", ","))


@query("""WITH b AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'main' WHEN 3 THEN 'trunk' ELSE c_mktsegment END AS branch, CASE WHEN c_custkey % 2 = 0 THEN 'trunk' END AS dflt FROM customer)
SELECT id, CASE WHEN coalesce(trim(branch), '') = '' THEN 'none' WHEN dflt IS NOT NULL AND branch = dflt THEN 'default' WHEN dflt IS NULL AND branch IN ('main', 'master') THEN 'default' ELSE 'branch:' || branch END AS signal FROM b""")
def chr14_branch_signal(spark, sf_dir):
    k = F.col("c_custkey")
    branch = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, " ").when(k % 5 == 2, "main").when(k % 5 == 3, "trunk").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), placement.branch_signal(branch, F.when(k % 2 == 0, "trunk")).alias("signal"))
