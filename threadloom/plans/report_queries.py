"""Reports: coverage, rankings, rollups, profiles, counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators.set_join import ordered_pairs
from threadloom.plans.base import EXCHANGES, FACTS, exchanges, facts, query, table


@query(f"WITH {EXCHANGES} SELECT count(DISTINCT session_id) AS archives, count(*) AS exchanges, min(timestamp) AS first_at, max(timestamp) AS last_at, count(DISTINCT project) AS projects FROM exchanges")
def agg01_index_stats(spark, sf_dir):
    return exchanges(spark, sf_dir).agg(F.count_distinct("session_id").alias("archives"), F.count(F.lit(1)).alias("exchanges"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count_distinct("project").alias("projects"))


@query(f"WITH {EXCHANGES} SELECT project, count(DISTINCT session_id) AS archives FROM exchanges GROUP BY project ORDER BY archives DESC, project LIMIT 10")
def agg01_top_projects(spark, sf_dir):
    return exchanges(spark, sf_dir).groupBy("project").agg(F.count_distinct("session_id").alias("archives")).orderBy(F.desc("archives"), "project").limit(10)


@query(f"""WITH {EXCHANGES} SELECT count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, min(timestamp) AS first_at, max(timestamp) AS last_at,
CAST(sum(CASE WHEN is_sidechain THEN 1 ELSE 0 END) AS BIGINT) AS sidechains FROM exchanges""")
def agg02_coverage(spark, sf_dir):
    return exchanges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("project").alias("projects"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count_if("is_sidechain").alias("sidechains"))


@query("""SELECT CAST(count(CASE WHEN quality = 1 THEN 1 END) AS BIGINT) AS processed, count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS seeded, count(CASE WHEN toxic = 1 THEN 1 END) AS errors FROM labels""")
def agg03_conditional_sums(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("processed"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("seeded"), F.count_if(F.col("toxic") == 1).alias("errors"))


@query(f"WITH {FACTS} SELECT coalesce(category, 'uncategorized') AS category, scope_type, count(*) AS n FROM facts WHERE is_active GROUP BY 1, 2")
def agg04_facts_by_category(spark, sf_dir):
    return facts(spark, sf_dir).where("is_active").groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), "scope_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS} SELECT count(CASE WHEN is_active THEN 1 END) AS active, count(CASE WHEN NOT is_active THEN 1 END) AS inactive FROM facts")
def agg05_active_inactive(spark, sf_dir):
    return facts(spark, sf_dir).agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


@query("""SELECT r_name AS domain, count(*) AS facts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY r_name ORDER BY facts DESC, domain LIMIT 10""")
def agg06_domain_ranking(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    # The three-way star: customers are summed by nation before they meet the two small dimensions.
    per = c.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("domain")).agg(F.sum("k").alias("facts")).orderBy(F.desc("facts"), "domain").limit(10)


@query(f"""WITH {EXCHANGES}, {FACTS}, e AS (SELECT project, count(DISTINCT session_id) AS sessions, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at FROM exchanges GROUP BY project),
f AS (SELECT 'p' || (id % 7) AS project, count(*) AS facts FROM facts WHERE is_active GROUP BY 1)
SELECT e.project, sessions, n, first_at, last_at, coalesce(facts, 0) AS facts FROM e LEFT JOIN f USING (project) ORDER BY n DESC, project LIMIT 10""")
def agg07_project_rollup(spark, sf_dir):
    e = exchanges(spark, sf_dir).groupBy("project").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    f = facts(spark, sf_dir).where("is_active").groupBy(F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("project")).agg(F.count(F.lit(1)).alias("facts"))
    return e.join(f, "project", "left").withColumn("facts", F.coalesce("facts", F.lit(0))).orderBy(F.desc("n"), "project").limit(10)


@query("""SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY month DESC LIMIT 12) ORDER BY month""")
def agg08_monthly_timeline(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("month")).limit(12).orderBy("month")


@query("""SELECT user_id % 5 AS project, event_type AS tool, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id % 5 ORDER BY count(*) DESC, event_type) <= 8""")
def agg11_tool_frequency(spark, sf_dir):
    per = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy((F.col("user_id") % 5).alias("project"), F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "tool"))).where("r <= 8").drop("r")


@query("""SELECT a.l_returnflag AS first_flag, b.l_returnflag AS then_flag, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_shipdate < b.l_shipdate GROUP BY 1, 2""")
def join04_theta_self_join(spark, sf_dir):
    return ordered_pairs(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_shipdate").withColumnsRenamed({"first": "first_flag", "then": "then_flag"})


@query(f"""WITH {EXCHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY timestamp DESC, id DESC) AS k FROM exchanges)
SELECT project, session_id, timestamp, id FROM r WHERE k = 1""")
def agg14_last_session(spark, sf_dir):
    last = exchanges(spark, sf_dir).groupBy("project").agg(F.max(F.struct("timestamp", "id", "session_id")).alias("m"))
    return last.select("project", "m.session_id", "m.timestamp", "m.id")


@query("""SELECT event_type AS metric, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents, min(value) AS least, max(value) AS most, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type""")
def agg15_telemetry(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_cents"), F.min("value").alias("least"), F.max("value").alias("most"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""SELECT r_name AS domain, count(DISTINCT n_nationkey) AS categories, count(DISTINCT s_suppkey) AS facts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name""")
def agg16_taxonomy_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.col("r_name").alias("domain")).agg(F.count_distinct("n_nationkey").alias("categories"), F.count_distinct("s_suppkey").alias("facts"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30""")
def agg17_daily_activity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).orderBy(F.desc("day")).limit(30)


@query(f"""WITH {EXCHANGES} SELECT session_id, project, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at, min_by(user_message, line_start) AS title FROM exchanges GROUP BY session_id, project ORDER BY last_at DESC, session_id LIMIT 20 OFFSET 10""")
def agg18_sessions_page(spark, sf_dir):
    per = exchanges(spark, sf_dir).groupBy("session_id", "project").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.min_by("user_message", "line_start").alias("title"))
    return per.orderBy(F.desc("last_at"), "session_id").offset(10).limit(20)


@query(f"""WITH {EXCHANGES}, {FACTS}, a AS (SELECT 's' || substr(project, 2) AS k, count(*) AS exchanges FROM exchanges GROUP BY 1), b AS (SELECT 's' || substr(project, 4) AS k, count(*) AS facts FROM facts GROUP BY 1)
SELECT coalesce(a.k, b.k) AS project, coalesce(exchanges, 0) AS exchanges, coalesce(facts, 0) AS facts FROM a FULL JOIN b ON a.k = b.k""")
def agg19_project_list(spark, sf_dir):
    a = exchanges(spark, sf_dir).groupBy(F.concat(F.lit("s"), F.substring("project", 2, 9)).alias("project")).agg(F.count(F.lit(1)).alias("exchanges"))
    b = facts(spark, sf_dir).groupBy(F.concat(F.lit("s"), F.substring("project", 4, 9)).alias("project")).agg(F.count(F.lit(1)).alias("facts"))
    return a.join(b, "project", "full").select("project", F.coalesce("exchanges", F.lit(0)).alias("exchanges"), F.coalesce("facts", F.lit(0)).alias("facts"))


@query("""SELECT o_orderpriority AS kind, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY 1""")
def agg20_job_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))


@query("""SELECT o_custkey AS fact_id, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS evidence FROM orders GROUP BY o_custkey""")
def agg24_evidence_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fact_id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("evidence"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def agg26_percentiles(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query("""SELECT conv_id, max(turn) AS last_line FROM conversations GROUP BY conv_id""")
def agg27_archive_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_line"))


@query(f"""WITH {FACTS}, s AS (SELECT id, project, confirmations, round(CASE WHEN confirmations > 0 THEN 3 * (1 + log2(confirmations + 1)) ELSE 3 END + CASE WHEN age_days <= 7 THEN 5 WHEN age_days <= 30 THEN 3 WHEN age_days <= 90 THEN 1 ELSE 0 END + CASE WHEN scope_type = 'project' THEN 2 ELSE 0 END, 6) AS score FROM facts WHERE is_active AND (scope_type = 'global' OR project = 'src4')),
o AS (SELECT *, project = 'src4' AS own, row_number() OVER (PARTITION BY project = 'src4' ORDER BY score DESC, id) AS k FROM s), r AS (SELECT *, own AND k <= 5 AS kept FROM o),
t AS (SELECT *, row_number() OVER (ORDER BY kept DESC, score DESC, id) AS n FROM r) SELECT id, score FROM t WHERE n <= 10""")
def win01_guaranteed_quota(spark, sf_dir):
    """Half of ten places are for the project's best facts, the rest for the best of all others."""
    from threadloom.operators.scope import in_scope

    age = F.when(F.col("age_days") <= 7, 5).when(F.col("age_days") <= 30, 3).when(F.col("age_days") <= 90, 1).otherwise(0)
    count = F.when(F.col("confirmations") > 0, 3 * (1 + F.log2(F.col("confirmations") + 1))).otherwise(3)
    s = facts(spark, sf_dir).where(F.col("is_active") & in_scope("project", "src4")).select("id", (F.col("project") == "src4").alias("own"), F.round(count + age + F.when(F.col("scope_type") == "project", 2).otherwise(0), 6).alias("score"))
    k = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "id"))
    top = s.withColumn("k", k).where("k <= 10")
    return top.orderBy(F.desc(F.col("own") & (F.col("k") <= 5)), F.desc("score"), "id").limit(10).select("id", "score")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS base_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def report_pricing_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("base_cents"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 25 OFFSET 5""")
def top03_offset_page(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_semi").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").offset(5).limit(25)


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1""")
def win08_first_outstanding(spark, sf_dir):
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("m"))
    return first.select("o_custkey", "m.o_orderkey", "m.o_orderpriority")


@query("""SELECT event_id, CAST(least(pow(2, (event_id % 16)), 3600) AS BIGINT) AS backoff_seconds, event_id % 16 >= 14 AS dead FROM events WHERE event_type = 'error'""")
def job03_backoff(spark, sf_dir):
    n = F.col("event_id") % 16
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.least(F.pow(F.lit(2), n), F.lit(3600.0)).cast("long").alias("backoff_seconds"), (n >= 14).alias("dead"))


@query(f"""WITH {EXCHANGES}, c AS (SELECT conv_id AS session_id, turn AS checkpoint FROM conversations WHERE turn % 2 = 1)
SELECT c.session_id, c.checkpoint, max(e.line_end) AS closed_through FROM c LEFT JOIN exchanges e ON e.session_id = c.session_id AND e.line_end <= c.checkpoint AND NOT e.is_sidechain GROUP BY 1, 2""")
def job04_as_of_closure(spark, sf_dir):
    """As-of join by union and a running maximum: one shuffle, no range join."""
    c = table(spark, sf_dir, "conversations").where("turn % 2 = 1").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.lit(True).alias("ask"), F.lit(None).cast("long").alias("end"))
    e = exchanges(spark, sf_dir).where("not is_sidechain").select("session_id", F.col("line_end").alias("at"), F.lit(False).alias("ask"), F.col("line_end").alias("end"))
    w = Window.partitionBy("session_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return c.unionByName(e).withColumn("closed_through", F.max("end").over(w)).where("ask").select("session_id", F.col("at").alias("checkpoint"), "closed_through")


@query(f"""WITH {EXCHANGES} SELECT id, lead(line_start) OVER (PARTITION BY session_id ORDER BY line_start) IS NOT NULL AS settled FROM exchanges WHERE NOT is_sidechain""")
def job05_settled_turns(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("line_start")
    return exchanges(spark, sf_dir).where("not is_sidechain").select("id", F.lead("line_start").over(w).isNotNull().alias("settled"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) AS island FROM o)
SELECT user_id, event_type, min(n) AS first_n, max(n) AS last_n FROM g GROUP BY user_id, event_type, island HAVING count(*) >= 3""")
def job07_contiguous_ranges(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    o = table(spark, sf_dir, "events").select("user_id", "event_type", n.alias("n"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("n"))
    return o.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count(F.lit(1)).alias("k")).where("k >= 3").select("user_id", "event_type", "first_n", "last_n")


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) WHEN count(event_type) = 0 THEN NULL ELSE 'mixed' END AS language FROM events GROUP BY user_id""")
def dat12_language_summary(spark, sf_dir):
    s = F.collect_set("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(s.alias("s")).select("user_id", F.when(F.size("s") == 1, F.element_at("s", 1)).when(F.size("s") > 1, "mixed").alias("language"))
