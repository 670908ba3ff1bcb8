"""The recall gate over the user's turns: tokens, intents, decisions, overlays and what explains them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import continuity, gate, graph, history, injection, lanes
from threadloom.operators import gate_tables as fixed
from threadloom.operators.retrieval import dot
from threadloom.operators.storage import settled
from threadloom.plans.base import FACTS, RELATIONS, facts, query, relations, table
from threadloom.plans.identity_queries import clip_sql

SUFFIXES = ("", " do you remember", " why did it fail", " please migrate it now", " and keep the history", " 클라이언트를 다시 바꿔줘", " (related work)", " what was decided?")
WHOLE = ("Thanks!", "okay, go ahead", "  ", "계속해줘", "no, the other one", "continue", "not that", "looks good so far, thanks", "이어서 하자", "go")
# An overlay: patterns switched off by id, words added and dropped, other limits, and a pattern of its own for high impact.
OFF, OWN_PATTERN = ("memory.en.why", "trace.en.history-plain", "ack.en.1"), "related"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{gate.WHITE}+|{gate.WHITE}+$', '', 'g')"


def _fits(x: str, pattern: str) -> str:
    space = chr(92) + "s"
    return f"regexp_matches({x}, '{pattern.replace(space + ']', gate.IN_CLASS).replace(space, gate.WHITE)}')"


def _tokens(x: str) -> str:
    keep = f"length(t) >= 2 AND NOT list_contains({_list(fixed.STOPWORDS)}, t)"
    stem = f"regexp_replace(t, '{fixed.KOREAN_ENDING}', '')"
    bare = f"list_transform(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_.-]+'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g'))"
    return f"list_distinct(list_filter(list_transform(list_filter({bare}, lambda t: {keep}), lambda t: CASE WHEN regexp_matches(t, '{fixed.KOREAN}') AND length({stem}) >= 2 THEN {stem} ELSE t END), lambda t: {keep}))"


def _intents(own: str, off=(), ack_words=fixed.ACK_WORDS, on_words=fixed.CONTINUE_WORDS) -> dict[str, str]:
    words = f"list_filter(regexp_split_to_array(lower({own}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
    idle = f"(len({words}) > 0 AND len(list_filter({words}, lambda t: NOT list_contains({_list([*ack_words, *on_words, *fixed.FILLER_WORDS])}, t))) = 0)"
    some = lambda lexicon: f"len(list_filter({words}, lambda t: list_contains({_list(lexicon)}, t))) > 0"
    ack = "(" + " OR ".join([*(_fits(own, p) for i, p in fixed.ACKNOWLEDGEMENT if i not in off), f"{idle} AND {some(ack_words)}"]) + ")"
    on = "(" + " OR ".join([*(_fits(own, p) for i, p in fixed.CONTINUATION if i not in off), f"{idle} AND NOT {ack} AND {some(on_words)}"]) + ")"
    return {n: _fits(own, f"(?i)({'|'.join(p for i, p in terms if i not in off)})") for n, terms in gate.BY_TERM.items()} | {"acknowledgement": ack, "continuation": on}


PROMPTS = f"""prompts AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 10 = 8 THEN ({_list(WHOLE)})[CAST(conv_id % {len(WHOLE)} + 1 AS INTEGER)]
    ELSE CASE conv_id % 3 WHEN 1 THEN opening WHEN 2 THEN substr(opening, 1, 200) || ' ' || substr(text, 1, 200) ELSE text END || ({_list(SUFFIXES)})[CAST((conv_id + turn // 2) % {len(SUFFIXES)} + 1 AS INTEGER)] END AS prompt FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opening FROM conversations WHERE role = 'user')),
said AS (SELECT *, {_trim('prompt')} AS own, lag(prompt, 1) OVER w AS before, lag(prompt, 2) OVER w AS earlier, row_number() OVER w AS n FROM prompts WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def prompts(spark, sf_dir):
    """(conv_id, turn, prompt, before, earlier, n): what a user says, with words added so that every table has a say;
    a third of the sessions keep to their opening, a third mix it with what is new."""
    c, k = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("conv_id")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    c = c.withColumn("opening", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    said = F.when(k % 3 == 1, F.col("opening")).when(k % 3 == 2, F.concat(F.substring("opening", 1, 200), F.lit(" "), F.substring("text", 1, 200))).otherwise(F.col("text"))
    p = c.select("conv_id", "turn", F.when((k + F.col("turn")) % 10 == 8, pick(WHOLE, k)).otherwise(F.concat(said, pick(SUFFIXES, k + F.floor(F.col("turn") / 2)))).alias("prompt"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return p.withColumns({"before": F.lag("prompt", 1).over(w), "earlier": F.lag("prompt", 2).over(w), "n": F.row_number().over(w)})


@query(f"WITH {PROMPTS} SELECT conv_id, turn, array_to_string(list_sort({_tokens('prompt')}), ',') AS tokens FROM prompts")
def gat01_prompt_tokens(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(gate.prompt_tokens(F.col("prompt"))), ",").alias("tokens"))


_TOPIC = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"
_PAIRS = f"pairs AS (SELECT *, {_tokens('prompt')} AS a, {_tokens('coalesce(before, chr(32))')} AS b, {_tokens('coalesce(earlier, chr(32))')} AS r FROM said)"


@query(f"WITH {PROMPTS}, {_PAIRS} SELECT conv_id, turn, len(a) AS n_tokens, round({_TOPIC}, 6) AS topic FROM pairs")
def gat02_topic_overlap(spark, sf_dir):
    a, b = gate.prompt_tokens(F.col("prompt")), gate.prompt_tokens(F.coalesce("before", F.lit("")))
    return prompts(spark, sf_dir).select("conv_id", "turn", F.size(a).cast("long").alias("n_tokens"), F.round(history.jaccard(a, b), 6).alias("topic"))


@query(f"WITH {PROMPTS} SELECT conv_id, turn, {', '.join(f'{sql} AS {n}' for n, sql in _intents('own').items())} FROM said")
def gat03_intents(spark, sf_dir):
    return gate.read_prompts(prompts(spark, sf_dir), "prompt").withColumn("i", gate.intents(gate.ReadPrompt("_p"))).select("conv_id", "turn", "i.*")


_TERMS = [(i, f"(?i){p}") for terms in gate.BY_TERM.values() for i, p in reversed(terms)] + [*reversed(fixed.ACKNOWLEDGEMENT), *reversed(fixed.CONTINUATION)]
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN {_fits('own', p)} THEN '{i}' END" for i, p in _TERMS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {PROMPTS} SELECT conv_id, turn, array_to_string({_FIRED}, ',') AS fired FROM said")
def gat04_explain_intents(spark, sf_dir):
    return gate.read_prompts(prompts(spark, sf_dir), "prompt").select("conv_id", "turn", F.array_join(gate.explain(gate.ReadPrompt("_p")), ",").alias("fired"))


def _decisions(off=(), own_pattern: str | None = None, ack_words=fixed.ACK_WORDS, on_words=fixed.CONTINUE_WORDS, ack_most=4, drift=0.12) -> str:
    """The gate's decision in SQL, over ``pairs`` with the state that ``gate_state`` derives."""
    flags = _intents("own", off, ack_words, on_words)
    if own_pattern:
        flags["high_impact"] = f"({flags['high_impact']} OR contains(lower(prompt), '{own_pattern}'))"
    minor = "(" + " OR ".join(_fits("own", p) for i, p in fixed.MINOR_CORRECTION if i not in off) + ")"
    return f"""f AS (SELECT *, {', '.join(f'{sql} AS {n}' for n, sql in flags.items())}, {minor} AS minor, CASE WHEN len(b) > 0 THEN {_TOPIC} END AS overlap FROM pairs),
g AS (SELECT *, acknowledgement OR continuation AS idle, NOT (acknowledgement OR continuation) AND (len(a) >= 5 OR memory OR high_impact) AS substantive,
    list_filter([CASE WHEN memory THEN 'explicit_memory_intent' END, CASE WHEN conv_id % 17 = 3 AND n % 6 = 5 THEN 'incident_signature_match' END, CASE WHEN conv_id % 5 = 0 AND n % 4 = 0 THEN 'project_revision_stale' END, CASE WHEN conv_id % 13 = 1 AND n % 5 = 3 THEN 'resident_revision_stale' END,
        CASE WHEN conv_id % 11 = 2 AND n % 5 = 2 THEN 'hot_evidence_pending' END, CASE WHEN conv_id % 7 = 1 AND n % 3 = 0 THEN 'capsule_generation_changed' END,
        CASE WHEN n = 1 THEN CASE WHEN conv_id % 4 = 0 THEN 'compact_first_prompt' ELSE 'first_substantive_in_epoch' END END], lambda x: x IS NOT NULL) AS news,
    list_filter([CASE WHEN high_impact THEN 'high_impact_intent' END, CASE WHEN n % 9 >= 6 THEN 'safety_refresh' END, CASE WHEN len(a) >= 5 AND overlap < {drift} THEN 'topic_drift' END, CASE WHEN len(a) >= 8 AND len(r) > 0 AND len(list_intersect(a, r)) = 0 THEN 'low_resident_coverage' END], lambda x: x IS NOT NULL) AS signs FROM f),
h AS (SELECT *, CASE WHEN own = '' THEN 'empty_prompt' WHEN len(news) > 0 THEN NULL WHEN idle AND len(a) <= {ack_most} THEN CASE WHEN acknowledgement THEN 'acknowledgement' ELSE 'continuation' END WHEN NOT substantive AND minor AND len(a) <= {ack_most} + 2 THEN 'minor_correction' WHEN len(signs) > 0 THEN NULL
    WHEN NOT substantive AND overlap >= 0.3 THEN 'continuation' WHEN overlap >= 0.35 THEN 'coherent_topic' END AS skip_reason FROM g),
d AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN [] WHEN len(news) > 0 THEN news WHEN len(signs) > 0 THEN signs WHEN n % 3 = 0 THEN ['no_topic_embedding'] ELSE [] END AS triggers FROM h),
decided AS (SELECT conv_id, turn, CASE WHEN skip_reason IS NOT NULL THEN 'skip' WHEN len(triggers) > 0 THEN 'retrieve' ELSE 'ambiguous' END AS action, array_to_string(triggers, ',') AS triggers, skip_reason FROM d)"""


def read(spark, sf_dir):
    """``prompts`` as the matcher has read them, with the tokens of the two prompts before; written once."""
    c = gate.read_prompts(prompts(spark, sf_dir), "prompt")
    w = Window.partitionBy("conv_id").orderBy("turn")
    none = F.array().cast("array<string>")
    return settled(c.withColumns({"_topic": F.coalesce(F.lag("_p_tokens", 1).over(w), none), "_resident": F.coalesce(F.lag("_p_tokens", 2).over(w), none)}))


def gate_state() -> dict:
    """State of a session, made up from conversation and position so that every trigger fires somewhere."""
    k, n = F.col("conv_id"), F.col("n")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "topic": F.col("_topic"), "resident": F.col("_resident"), "has_topic_embedding": n % 3 != 0, "informative": n % 9,
        "last_epoch": F.when(n == 1, -1).otherwise(0), "last_source": F.when(k % 4 == 0, "compact"), "capsule": flag((k % 7 == 1) & (n % 3 == 0)), "revision": flag((k % 5 == 0) & (n % 4 == 0)),
        "incident": (k % 17 == 3) & (n % 6 == 5), "resident_stale": (k % 13 == 1) & (n % 5 == 3), "hot_evidence": (k % 11 == 2) & (n % 5 == 2),
    }


def _decided(spark, sf_dir, **overlay):
    d = gate.decisions(read(spark, sf_dir), gate_state(), **overlay)
    return d.select("conv_id", "turn", "decision.action", F.array_join("decision.triggers", ",").alias("triggers"), "decision.skip_reason")


@query(f"WITH {PROMPTS}, {_PAIRS}, {_decisions()} SELECT * FROM decided")
def gat05_gate_decision(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(f"WITH {PROMPTS}, {_PAIRS}, {_decisions(OFF, OWN_PATTERN, [*fixed.ACK_WORDS, 'looks'], [w for w in fixed.CONTINUE_WORDS if w != 'go'], 3, 0.2)} SELECT * FROM decided")
def gat07_overlay_decision(spark, sf_dir):
    own = F.contains(F.lower("prompt"), F.lit(OWN_PATTERN))
    return _decided(spark, sf_dir, overlay=gate.Overlay(disabled=OFF, add_words={"ack": ("looks",)}, drop_words={"continue": ("go",)}, limits={"ack_max_tokens": 3, "drift_jaccard": 0.2}), user_hits={"high_impact": own})


@query(f"""WITH {PROMPTS}, f AS (SELECT conv_id, turn, own, {', '.join(f'{sql} AS {n}' for n, sql in _intents('own').items())}, len({_tokens('prompt')}) AS n_tokens, {_fits('own', fixed.MINOR_CORRECTION[0][1])} OR {_fits('own', fixed.MINOR_CORRECTION[1][1])} AS minor, {_FIRED} AS fired FROM said)
SELECT conv_id, turn, CASE WHEN own = '' THEN 'skip' WHEN memory THEN 'retrieve' WHEN (acknowledgement OR continuation) AND n_tokens <= 4 THEN 'skip' WHEN minor AND n_tokens <= 6 AND ((acknowledgement OR continuation) OR (n_tokens < 5 AND NOT high_impact)) THEN 'skip' ELSE 'retrieve' END AS action, len(fired) AS n_fired, fired[1] AS first_fired FROM f""")
def dat09_explain_decision(spark, sf_dir):
    # A dry run: no session, so no topic, no residents and no news; what is left hangs on the prompt alone.
    fired = gate.explain(gate.ReadPrompt("_p"))
    return gate.decisions(settled(gate.read_prompts(prompts(spark, sf_dir), "prompt")), {}).select("conv_id", "turn", F.col("decision.action").alias("action"), F.size(fired).cast("long").alias("n_fired"), F.try_element_at(fired, F.lit(1)).alias("first_fired"))


_ELIGIBLE = f"(u <> '' AND NOT (starts_with(u, '<command-name>') OR starts_with(u, 'Caveat:')) AND NOT regexp_matches(u, '{injection.SLASH_COMMAND}'))"


@query(f"""WITH {PROMPTS}, w AS (SELECT conv_id, turn, n, before, CASE conv_id % 9 WHEN 0 THEN '/clear' WHEN 1 THEN '<command-name>' || own WHEN 2 THEN 'why?' WHEN 3 THEN 'go ahead' ELSE own END AS u FROM said)
SELECT conv_id, turn, {_ELIGIBLE} AS eligible, {_ELIGIBLE} AND (turn % 5 = 0 OR CASE WHEN {_fits('u', injection.RATIFICATION)} THEN before IS NOT NULL ELSE NOT {_fits('u', injection.CONTEXT_ONLY)} END) AS anchor FROM w""")
def flt20_context_anchors(spark, sf_dir):
    k, u = F.col("conv_id") % 9, F.col("prompt")
    said = F.when(k == 0, "/clear").when(k == 1, F.concat(F.lit("<command-name>"), gate.trimmed(u))).when(k == 2, "why?").when(k == 3, "go ahead").otherwise(u)
    p = prompts(spark, sf_dir).withColumn("u", said)
    return p.select("conv_id", "turn", injection.context_eligible(F.col("u")).alias("eligible"), injection.candidate_anchor(F.col("u"), F.col("turn") % 5 == 0, F.col("before").isNotNull()).alias("anchor"))


_TURNS = ("use that", "그 방식으로 하자", "from now on run the tests", "why?", "go ahead", "we moved to tabs", "tabs please", "/clear", "I always write long and winding sentences about nothing in particular, as everyone who has ever met me knows", "keep it that way please")
_REFERS = f"({_fits('u', injection.STRONG_REFERENCE)} OR {_fits('u', injection.DEICTIC_ADOPTION)} OR ({_fits('u', injection.KOREAN_DEIXIS)} AND {_fits('u', injection.KOREAN_ADOPTION)}) OR {_fits('u', injection.PERSISTENCE)} OR {_fits('u', injection.GENERIC_CONTEXT)} OR {_fits('u', injection.RATIFICATION)})"
_FEW = f"len(list_filter(regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT list_contains({_list(injection.REFERENT_STOPWORDS)}, t)))"


@query(f"""WITH {PROMPTS}, w AS (SELECT conv_id, turn, {_trim(f"CASE WHEN turn % 3 = 0 THEN ({_list(_TURNS)})[CAST(conv_id % {len(_TURNS)} + 1 AS INTEGER)] WHEN turn % 3 = 1 THEN substr(prompt, 1, 40) ELSE prompt END")} AS u FROM said)
SELECT conv_id, turn, {_ELIGIBLE} AND NOT {_fits('u', injection.PURE_BRIDGE)} AND ({_REFERS} OR ({_FEW} BETWEEN 1 AND 6 AND length(u) <= 80 AND NOT {_fits('u', injection.STANDALONE)})) AS needed FROM w""")
def flt20_referent_need(spark, sf_dir):
    t = F.col("turn") % 3
    said = F.when(t == 0, F.element_at(F.array(*map(F.lit, _TURNS)), (F.col("conv_id") % len(_TURNS) + 1).cast("int"))).when(t == 1, F.substring("prompt", 1, 40)).otherwise(F.col("prompt"))
    return prompts(spark, sf_dir).withColumn("u", said).select("conv_id", "turn", injection.needs_referent(F.col("u")).alias("needed"))


def _sql_dot(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9)"


_BASE = [((i * 29) % 17 - 8) / 50.0 for i in range(64)]
# What a session holds (in its current form or an old one), and what its prompts name.
_NAMED = "list_contains([session + 5, session + 105, session + 205], v.id)"
_GIVEN = f"""{PROMPTS}, {_PAIRS}, {_decisions()}, {FACTS}, {RELATIONS}, v AS (SELECT id, project, scope_type, embedding, fact FROM facts JOIN embeddings ON vec_id = id WHERE is_active),
held AS (SELECT conv_id AS session, v.id, v.id % 3 <> 0 AS current FROM (SELECT conv_id, unnest([conv_id, conv_id + 40, conv_id + 80]) AS id FROM (SELECT DISTINCT conv_id FROM conversations)) c JOIN v ON v.id = c.id),
sure AS (SELECT d.conv_id * 1000 + d.turn AS request_id, d.conv_id AS session, 'src' || (d.conv_id % 20) AS project, contains(d.triggers, 'explicit_memory_intent') AS trace, e.embedding AS q,
    CASE WHEN action <> 'ambiguous' THEN action WHEN coalesce({_sql_dot('e.embedding', 't.embedding')} - {_sql_dot('e.embedding', str(_BASE))} >= 0.08, false) THEN 'skip' ELSE 'retrieve' END AS action
    FROM decided d JOIN embeddings e ON e.vec_id = d.conv_id LEFT JOIN embeddings t ON t.vec_id = d.conv_id + d.turn),
ask AS (SELECT * FROM sure WHERE action = 'retrieve'),
hit AS (SELECT request_id, session, trace, v.id, {_sql_dot('v.embedding', 'q')} AS similarity, {_sql_dot('q', str(_BASE))} AS baseline, CASE WHEN {_NAMED} THEN 2 END AS lexical FROM ask JOIN v ON v.project = ask.project OR v.scope_type = 'global'),
best AS (SELECT *, CASE WHEN lexical IS NULL THEN 'semantic' ELSE 'lexical' END AS lane FROM hit WHERE lexical IS NOT NULL OR similarity - baseline >= 0.045 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY lexical DESC NULLS LAST, similarity DESC, id) <= 5),
ways AS (SELECT source_id AS f, target_id AS t, relation_type, created_at FROM relations UNION ALL SELECT target_id, source_id, relation_type, created_at FROM relations),
near AS (SELECT request_id, session, t AS id, relation_type, CASE relation_type WHEN 'CONTRADICTS' THEN 0 WHEN 'SUPERSEDES' THEN 1 WHEN 'SUPPORTS' THEN 2 ELSE 3 END AS p FROM best JOIN ways ON f = id WHERE trace QUALIFY row_number() OVER (PARTITION BY request_id, t ORDER BY p, created_at, f) = 1),
sees AS (SELECT DISTINCT session, v.id FROM ask JOIN v ON v.project = ask.project OR v.scope_type = 'global'),
rel AS (SELECT request_id, session, id, CASE WHEN relation_type = 'SUPPORTS' THEN 1.0 ELSE 0.7 END AS relevance FROM near n WHERE (session, id) IN (SELECT (session, id) FROM sees) AND (request_id, id) NOT IN (SELECT (request_id, id) FROM best) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, p, id) <= 3),
found AS (SELECT request_id, session, id, lane, similarity AS relevance FROM best UNION ALL SELECT request_id, session, id, 'related', relevance FROM rel),
given AS (SELECT request_id, id, lane, relevance FROM found WHERE (session, id) NOT IN (SELECT (session, id) FROM held) UNION ALL SELECT request_id, held.id, 'correction', 1.0 FROM ask JOIN held ON held.session = ask.session AND NOT current),
placed AS (SELECT request_id, id, lane, round(CAST(relevance AS DOUBLE), 6) AS relevance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE lane WHEN 'correction' THEN 0 WHEN 'lexical' THEN 1 WHEN 'semantic' THEN 2 ELSE 3 END, relevance DESC, id) AS INTEGER) AS place FROM given)"""


def asked(spark, sf_dir):
    """Prompts that get memory: those the gate lets through, and of the ambiguous ones those that leave their topic.
    Decided once and written."""
    k, e = F.col("conv_id"), table(spark, sf_dir, "embeddings")
    probe = F.array(*map(F.lit, _BASE))
    d = gate.decisions(read(spark, sf_dir), gate_state()).where("decision.action <> 'skip'")
    d = d.join(e.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("q")), "conv_id").join(e.select(F.col("vec_id").alias("_at"), F.col("embedding").alias("_t")), F.col("_at") == k + F.col("turn"), "left")
    near = F.round(dot(F.col("_t"), F.col("q")), 9)
    base = F.round(dot(F.col("q"), probe), 9)
    kept = d.where(gate.resolve_ambiguous(F.col("decision.action"), near, base) == "retrieve")
    return settled(kept.select((k * 1000 + F.col("turn")).alias("request_id"), k.alias("session"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("project"), F.array_contains("decision.triggers", "explicit_memory_intent").alias("trace"), "q", base.alias("baseline")))


def injected(spark, sf_dir):
    ask = asked(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    v = facts(spark, sf_dir).where("is_active").select("id", "project", "scope_type").join(e, "id")
    everywhere = F.col("scope_type") == "global"
    # A session sees the global facts and its own project's; it meets each set block by block for its best few.
    sessions = ask.select("session", "project", "q").dropDuplicates(["session"])
    wants = sessions.select(F.col("session").alias("qid"), F.explode(F.array(F.lit("*"), "project")).alias("scope"), "q")
    near = lanes.top_in_scope(wants, v.select("id", F.when(everywhere, "*").otherwise(F.col("project")).alias("scope"), "v"), 5).withColumnRenamed("qid", "session")
    s = F.col("session")
    named = sessions.select("session", F.col("project").alias("_of"), "q", F.explode(F.array(s + 5, s + 105, s + 205)).alias("id")).join(v, "id").where(everywhere | (F.col("project") == F.col("_of"))).select("session", "id", F.round(dot(F.col("v"), F.col("q")), 9).alias("similarity"))
    word = F.when(F.col("id").isin(s + 5, s + 105, s + 205), 2)
    hits = ask.select("request_id", "session", "baseline").join(near.unionByName(named).dropDuplicates(["session", "id"]), "session").select("request_id", "id", "similarity", "baseline", word.alias("lexical_score"))
    # Neighbours that are no active facts are seen by nobody; the others bring their scope, so nothing is joined a prompt.
    links = graph.both_ways(relations(spark, sf_dir)).join(v.select(F.col("id").alias("to"), F.col("project").alias("_of"), "scope_type"), "to")
    visible = lambda rows: rows.where(everywhere | (F.col("_of") == F.col("project")))
    c = F.col("conv_id")
    held = table(spark, sf_dir, "conversations").select(c).distinct().select(c.alias("session"), F.explode(F.array(c, c + 40, c + 80)).alias("id")).join(v.select("id"), "id").select("session", "id", (F.col("id") % 3 != 0).alias("current"))
    return injection.inject(ask.select("request_id", "session", "trace", "project"), hits, links, visible, held)


@query(f"WITH {_GIVEN} SELECT * FROM placed")
def gat13_injection(spark, sf_dir):
    return injected(spark, sf_dir)


@query(f"""WITH {_GIVEN} SELECT request_id, md5(request_id || ':' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY place)) AS receipt, count(*) AS n FROM placed GROUP BY 1""")
def gat13_receipts(spark, sf_dir):
    return injection.receipts(injected(spark, sf_dir))


def _bundle_sql(wrap: bool) -> str:
    """Lines are taken one by one, as ``render_bundle`` folds them."""
    heads, most = ([x[i] for x in injection.SECTIONS.values()] for i in (0, 1))
    quoted = "replace(replace(replace(CAST(to_json(@) AS VARCHAR), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
    whole = f"'{gate.INSTRUCTION}' || chr(10) || '{gate.OPEN}' || chr(10) || {quoted} || chr(10) || '{gate.CLOSE}'" if wrap else "@"
    grown, shown = whole.replace("@", "grown"), whole.replace("@", "arg_max(bundle, i)")
    ascii_ = f"length(regexp_replace({grown}, '[^\\x00-\\x7F]', '', 'g'))"
    large = f"length({grown}) > {continuity.HARD_CHARS}" + (f" OR ceil(({ascii_} * 0.25 + length({grown}) - {ascii_}) * 1.25) > {gate.MOST_TOKENS}" if wrap else "")
    lane = "CASE lane " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(injection.SECTIONS)) + " END"
    return f"""WITH RECURSIVE {_GIVEN}, k AS (SELECT request_id, {lane} AS s, '- ' || {clip_sql("fact")} AS line, row_number() OVER (PARTITION BY request_id, lane ORDER BY place) AS r FROM placed JOIN v USING (id)),
o AS (SELECT *, ({most})[s + 1] AS most, ({_list(heads)})[s + 1] AS head, row_number() OVER (PARTITION BY request_id ORDER BY s, r) AS i FROM k WHERE r <= {max(most) + 1}),
b AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS i, '' AS bundle, CAST(0 AS BIGINT) AS n_lines, -1 AS open, -1 AS closed, false AS truncated FROM o
    UNION ALL SELECT request_id, i, CASE WHEN skip OR over THEN bundle ELSE grown END, CASE WHEN skip OR over THEN n_lines ELSE n_lines + 1 END, CASE WHEN skip OR over THEN open ELSE s END, CASE WHEN NOT skip AND over THEN s ELSE closed END, truncated OR (NOT skip AND over)
    FROM (SELECT *, closed = s AS skip, r > most OR {large} OR (open = s AND length(grown) > {continuity.TARGET_CHARS} AND length(line) > {continuity.LINE_CHARS // 2}) AS over
        FROM (SELECT b.request_id, o.i, b.bundle, b.n_lines, b.open, b.closed, b.truncated, o.s, o.r, o.most, o.line,
            b.bundle || CASE WHEN b.open <> o.s THEN CASE WHEN b.bundle = '' THEN '' ELSE chr(10) || chr(10) END || o.head || chr(10) ELSE chr(10) END || o.line AS grown FROM b JOIN o ON o.request_id = b.request_id AND o.i = b.i + 1)))
SELECT request_id, CASE WHEN arg_max(bundle, i) = '' THEN '' ELSE {shown} END AS bundle, max(n_lines) AS n_lines, bool_or(truncated) AS truncated FROM b GROUP BY 1"""


@query(_bundle_sql(False))
def gat13_bundles(spark, sf_dir):
    return injection.bundles(injected(spark, sf_dir), facts(spark, sf_dir))


@query(_bundle_sql(True))
def gat09_wrapped_bundles(spark, sf_dir):
    return injection.bundles(injected(spark, sf_dir), facts(spark, sf_dir), wrap=True)
