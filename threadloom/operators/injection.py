"""What memory gives a prompt: gate, lanes, margin, one hop, what is new to the session, bundle, receipt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.continuity import clip_line, render_bundle
from threadloom.operators.gate import fits, trimmed
from threadloom.operators.graph import AFFIRMATIVE, OTHER_WEIGHT, both_ways, priority
from threadloom.operators.lanes import clears_margin
from threadloom.operators.storage import settled

# Turns of the machinery, replies that only bridge context, replies that agree if there is something to agree to.
MACHINERY = ("<local-command-stdout>", "<local-command-caveat>", "<command-name>", "Caveat:")
CONTEXT_ONLY = r"(?i)^(thanks?|thank you|done|go|proceed|continue|why|how|고마워요?|감사(합니다|해요)?|해줘|진행해?줘?|계속(해줘)?|왜|어떻게)[?.!~\s]*$"
RATIFICATION = r"(?i)^(go|go ahead|proceed|continue|진행해?줘?|그대로 진행(?:해?줘?)?|계속(?:해?줘?)?)[?.!~\s]*$"
SLASH_COMMAND = r"^/[A-Za-z0-9_:-]+$"


# What refers to something said before, what asks to be kept, what only bridges, what stands by itself; and
# words that say nothing about a topic.
STRONG_REFERENCE = r"(?i)(?:\b(?:the first|first option|initial recommendation|original recommendation|original option|earlier|this way|that way|this style|current style|same approach|this sequence|same sequence)\b|그거|그걸로|그대로|그 방식|이 방식|그 방향|그 스타일|그\s*제안|그\s*선택|아까|처음|첫\s*번째|지금처럼|지금\s*방식|이대로|이렇게|이\s*순서|그\s*순서|같은\s*순서|원안|전자|후자)"
DEICTIC_ADOPTION = r"(?i)\b(?:(?:do|use|choose|pick|adopt|keep)\s+(?:that|it|this)|(?:go|proceed)\s+with\s+(?:that|it|this)|continue(?:\s+with)?\s+(?:that|it|this)|do\s+it\s+that\s+way)\b"
KOREAN_DEIXIS = "(?:그(?:걸|것|대로|렇게|방향|방식|순서|스타일|제안|선택|안)|이(?:걸|것|대로|렇게|방향|방식|순서|스타일|제안|선택|안))"
KOREAN_ADOPTION = "(?:하자|해줘|진행|가자|사용|쓰자|선택|고르|택하|유지|계속)"
PERSISTENCE = r"(?i)(?:\b(?:going forward|from now on|always|next time)\b|앞으로(?:도|는)?|항상|다음부터|다른\s*프로젝트에서도)"
GENERIC_CONTEXT = r"(?i)(?:\b(?:yes|ok|okay|that|it|keep doing)\b|응|좋아|계속)"
PURE_BRIDGE = r"(?i)^(thanks?|thank you|done|why|how|고마워요?|감사(합니다|해요)?|왜|어떻게)[?.!~\s]*$"
STANDALONE = r"(?i)^(?:i\b|we\b|my\b|our\b|the user\b|this project\b|(?:난|나는|전|저는|제가|우리)(?:\s|[,.:!?]|$)|이 프로젝트)"
REFERENT_STOPWORDS = (
    "a an and are as at be by for from has have in is it of on or project projects the this to use used uses using user users we will with current currently decide decided decision prefer "
    "prefers preference response responses system 이 그 저 프로젝트 사용 사용한다 사용하기로 결정 결정했다 현재 사용자"
).split()
SHORT_TOKENS, SHORT_CHARS = 6, 80


def needs_referent(user: Column) -> Column:
    """May a turn need context from further back? What refers, asks to be kept or ratifies does; so does a short turn of a
    few words that names no subject of its own. Bridges and turns that are no context do not."""
    own = trimmed(F.coalesce(user, F.lit("")))
    refers = fits(own, STRONG_REFERENCE) | fits(own, DEICTIC_ADOPTION) | (fits(own, KOREAN_DEIXIS) & fits(own, KOREAN_ADOPTION))
    tokens = F.filter(F.regexp_extract_all(F.lower(own), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(*REFERENT_STOPWORDS))
    short = F.size(tokens).between(1, SHORT_TOKENS) & (F.length(own) <= SHORT_CHARS) & ~fits(own, STANDALONE)
    return context_eligible(user) & ~fits(own, PURE_BRIDGE) & (refers | fits(own, PERSISTENCE) | fits(own, GENERIC_CONTEXT) | fits(own, RATIFICATION) | short)


def context_eligible(user: Column) -> Column:
    """May a turn stand as context? Empty turns, those of the machinery and bare slash commands may not."""
    own = trimmed(F.coalesce(user, F.lit("")))
    machine = F.lit(False)
    for start in MACHINERY:
        machine = machine | own.startswith(start)
    return (own != "") & ~machine & ~own.rlike(SLASH_COMMAND)


def candidate_anchor(user: Column, has_evidence: Column, has_antecedent: Column) -> Column:
    """Can a turn justify an extraction? Trusted evidence always does; a bare agreement needs something before it."""
    own = trimmed(F.coalesce(user, F.lit("")))
    return context_eligible(user) & (has_evidence | F.when(fits(own, RATIFICATION), has_antecedent).otherwise(~fits(own, CONTEXT_ONLY)))


def inject(asked: DataFrame, hits: DataFrame, relations: DataFrame, visible: Callable[[DataFrame], DataFrame], residents: DataFrame, k: int = 5, related: int = 3) -> DataFrame:
    """(request_id, id, lane, relevance, place) of the facts that each prompt gets.

    ``asked``: request_id, session, trace (does the prompt ask for relations?), of prompts that the gate lets retrieve;
    ``hits``: request_id, id, similarity, baseline, lexical_score, of active facts that the session may see; ``visible``
    keeps of rows (session, id, …) those whose session may see the fact; ``residents``: what it holds already (session, id, current).
    ``relations`` may be ``both_ways``; what else its rows and those of ``asked`` tell is there for ``visible``, which sees
    every neighbour before anything is shuffled by prompt, so that what it can tell from a row costs no join.

    Hits that words named or that clear the margin compete, words first; the best k stay. A trace adds up to
    ``related`` neighbours over one edge. What the session holds in its current form is left out; what it holds in an
    old form comes as a correction, whether or not the prompt is about it.
    """
    strong = hits.where(clears_margin(F.col("similarity"), F.col("baseline"), F.col("lexical_score")))
    best = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("lexical_score"), F.desc_nulls_last("similarity"), "id")
    chosen = strong.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("request_id", "id", F.when(F.col("lexical_score").isNotNull(), "lexical").otherwise("semantic").alias("lane"), F.coalesce("similarity", F.lit(1.0)).alias("relevance"))
    chosen = settled(chosen.join(asked, "request_id"))
    weight = F.when(F.col("relation_type").isin(*AFFIRMATIVE), 1.0).otherwise(OTHER_WEIGHT)
    links = relations if "from" in relations.columns else both_ways(relations)
    traced = chosen.where("trace").drop("trace", "lane", "relevance").withColumnRenamed("id", "from")
    near = links.join(traced.select("from").distinct(), "from", "left_semi").withColumnRenamed("to", "id").withColumn("p", priority())
    hop = visible(traced.join(near, "from")).groupBy("request_id", "session", "id").agg(F.min(F.struct("p", "created_at", F.col("from").alias("id"), "relation_type")).alias("e"))
    hop = hop.select("request_id", "session", "id", F.col("e.relation_type").alias("relation_type"), F.col("e.p").alias("p"))
    hop = hop.join(chosen.select("request_id", "id"), ["request_id", "id"], "left_anti").withColumn("relevance", weight)
    first = Window.partitionBy("request_id").orderBy(F.desc("relevance"), "p", "id")
    hop = hop.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= related).select("request_id", "session", "id", F.lit("related").alias("lane"), "relevance")
    found = chosen.select("request_id", "session", "id", "lane", "relevance").unionByName(hop)
    new = found.join(residents.select("session", "id"), ["session", "id"], "left_anti")
    stale = asked.select("request_id", "session").join(residents.where("not current").select("session", "id"), "session").select("request_id", "session", "id", F.lit("correction").alias("lane"), F.lit(1.0).alias("relevance"))
    lane = F.when(F.col("lane") == "correction", 0).when(F.col("lane") == "lexical", 1).when(F.col("lane") == "semantic", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(lane, F.desc("relevance"), "id"))
    return new.unionByName(stale).select("request_id", "id", "lane", F.round("relevance", 6).alias("relevance"), place.alias("place"))


#: What a bundle shows of each lane: heading and most items, in this order.
SECTIONS = {"correction": ("[Corrections]", 3), "lexical": ("[Named]", 5), "semantic": ("[Relevant]", 5), "related": ("[Related]", 3)}


def bundles(injected: DataFrame, facts: DataFrame, wrap: bool = False) -> DataFrame:
    """(request_id, bundle, n_lines, truncated): the text that a prompt is given, within the limits of a context block.

    ``facts`` has id and fact. With ``wrap`` the limits hold for the text in its envelope.
    """
    # A fact is cut to its line before it is moved, once for all prompts that get it.
    items = injected.join(facts.select("id", clip_line(F.coalesce("fact", F.lit(""))).alias("fact")), "id")
    return render_bundle(items, "request_id", "lane", ["place"], "fact", SECTIONS, wrap=wrap)


def receipts(injected: DataFrame) -> DataFrame:
    """(request_id, receipt, n): a prepared receipt of what a prompt was given, the same for the same facts in order.
    A prompt gets few facts, so its list is bounded."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",")
    return injected.groupBy("request_id").agg(F.md5(F.concat_ws(":", F.col("request_id").cast("string"), ids)).alias("receipt"), F.count(F.lit(1)).alias("n"))
