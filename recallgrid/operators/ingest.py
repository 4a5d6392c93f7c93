"""From raw log rows to beliefs and edges: derivation, chains of turns, triples, and the ledgers of what was shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect, extract, text
from ..plans.session import new_folder
from ..sources.model import Store

# Fixed values.
LOCK_PRIOR, GIT_PRIOR = (9.0, 0.5), (1.0, 1.0)


def derive(log: DataFrame) -> DataFrame:
    """The belief of each log row (``log_id``, ``source_kind``, ``raw_text``, ``role``): remembered texts are locks, commit subjects plain facts, all others
    are classified; what isn't to be kept has ``kept`` false."""
    kind = F.col("source_kind")
    remembered, git = kind == "remember", kind == "git"
    is_user = (kind == "transcript") & (F.col("role") == "user")
    found = detect.sentence_class(F.col("raw_text"))
    rows = log.withColumn("_c", found).withColumn("type", F.when(remembered | git, "factual").otherwise(F.col("_c.type")))
    collapsed = F.trim(F.regexp_replace("raw_text", r"\s+", " "))
    alpha = F.when(remembered, LOCK_PRIOR[0]).when(git, GIT_PRIOR[0]).otherwise(text.prior(F.col("type"), is_user, "alpha"))
    beta = F.when(remembered, LOCK_PRIOR[1]).when(git, GIT_PRIOR[1]).otherwise(text.prior(F.col("type"), is_user, "beta"))
    return rows.select(
        "log_id",
        text.belief_id(kind, F.col("raw_text")).alias("id"),
        F.when(git, collapsed).otherwise(F.col("raw_text")).alias("content"),
        F.when(git, text.triple_hash(F.col("raw_text"))).otherwise(F.sha2("raw_text", 256)).alias("content_hash"),
        "type",
        alpha.alias("alpha"),
        beta.alias("beta"),
        F.when(remembered, "user").otherwise("none").alias("lock_level"),
        F.when(remembered, "user_stated").when(is_user, "user_transcript").otherwise("agent_inferred").alias("origin"),
        (remembered | git | F.col("_c.persist")).alias("kept"),
    )


def chain_edges(log: DataFrame, derived: DataFrame) -> DataFrame:
    """DERIVED_FROM edges from each kept row of a session to the kept row before it."""
    kept = log.join(derived.where("kept").select("log_id", "id"), "log_id")
    before = F.lag("id").over(Window.partitionBy("session_id").orderBy("created_at", "log_id"))
    rows = kept.select(F.col("id").alias("src"), before.alias("dst")).where("dst IS NOT NULL AND src <> dst")
    return rows.distinct().withColumns({"type": F.lit("DERIVED_FROM"), "weight": F.lit(1.0)})


def turn_sentences(turns: DataFrame) -> DataFrame:
    """The sentences of turns that aren't noise, numbered: (``conv_id``, ``turn``, ``n``, ``sentence``)."""
    rows = turns.select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))
    s = F.col("sentence")
    return rows.where(~detect.is_transcript_noise(s) & ~detect.is_subfloor(s) & text.noise_kind(s).isNull())


def rebuilt_queries(turns: DataFrame, most: int = 4) -> DataFrame:
    """(``conv_id``, ``query``): a query from the latest ``most`` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.select("conv_id", "turn", "text", F.row_number().over(w).alias("n")).where(F.col("n") <= most)
    said = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return said.select("conv_id", extract.rebuilt_query(F.transform("t", lambda x: x["text"])).alias("query"))


def entity_table(texts: DataFrame) -> DataFrame:
    """(``belief_id``, ``entity_lower``, ``kind``, ``span_start``) of the entities of texts (``id``, ``content``), written to the shared folder, as extraction runs nine patterns over
    each text."""
    folder = new_folder(texts.sparkSession, "entities")
    extract.entity_rows(texts).write.parquet(folder)
    return texts.sparkSession.read.parquet(folder)


def triple_beliefs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beliefs of the phrases of triples (``id`` by their normal form) and the edges between them; each once."""
    t = texts.select(F.explode(extract.triples(F.col("text"))).alias("t")).select("t.*")
    phrase_id = lambda c: F.substring(F.sha2(F.concat(F.lit("triple\0"), F.lower(c)), 256), 1, 16)
    phrases = t.select(F.col("subject").alias("content")).unionByName(t.select(F.col("object").alias("content")))
    beliefs = phrases.groupBy(phrase_id(F.col("content")).alias("id")).agg(F.min("content").alias("content"))
    edges = t.select(phrase_id(F.col("subject")).alias("src"), phrase_id(F.col("object")).alias("dst"), F.col("relation").alias("type"), "anchor").where("src <> dst")
    return beliefs, edges.groupBy("src", "dst", "type").agg(F.min("anchor").alias("anchor_text"))


def seen_split(shown: DataFrame, ring: DataFrame) -> DataFrame:
    """Shown beliefs (``session_id``, ``id``, ``locked``) by whether the ring of their session has them; locks are always new."""
    rows = shown.join(ring.select("session_id", F.col("belief_id").alias("id"), F.lit(True).alias("seen")).distinct(), ["session_id", "id"], "left")
    return rows.select("session_id", "id", (F.coalesce("seen", F.lit(False)) & ~F.col("locked")).alias("seen"))


def ring_state(events: DataFrame, size: int) -> DataFrame:
    """The bounded ring of each session: a belief that comes again moves to its last place; the oldest beyond ``size`` fall out."""
    last = events.groupBy("session_id", "belief_id").agg(F.max("feedback_id").alias("last"))
    w = Window.partitionBy("session_id").orderBy(F.desc("last"))
    return last.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).select("session_id", "belief_id", "last")


def rendered(events: DataFrame) -> DataFrame:
    """What each session has rendered since its epoch began: (``session_id``, ``belief_id``) after the last event that is an ``epoch``."""
    began = events.where("epoch").groupBy("session_id").agg(F.max("event_id").alias("began"))
    rows = events.join(began, "session_id", "left").where(F.col("event_id") >= F.coalesce("began", F.lit(-1)))
    return rows.select("session_id", "belief_id").distinct()


def answered(store: Store, responses: DataFrame) -> DataFrame:
    """Exposures without an answer whose belief stands in a response of the session (``session_id``, ``said``): 1 or 0 for each."""
    waiting = store.injections.where("referenced IS NULL").join(store.active.select(F.col("id").alias("belief_id"), "content"), "belief_id", "left")
    said = waiting.join(responses, "session_id").withColumn("hit", detect.is_referenced(F.coalesce("content", F.lit("")), F.col("said")))
    return said.groupBy("event_id").agg(F.max(F.col("hit").cast("int")).alias("referenced"))


def sentiment_shares(store: Store, prompts: DataFrame) -> DataFrame:
    """What the sentiment of prompts (``session_id``, ``prompt``) gives to the beliefs shown in the session: its valence in equal shares among those that are
    active and not locked, or among all if every one is locked (who then keep theirs)."""
    signal = prompts.select("session_id", detect.sentiment(F.col("prompt")).alias("s")).where("s IS NOT NULL").groupBy("session_id").agg(F.sum("s.valence").alias("valence"))
    shown = store.injections.select("session_id", F.col("belief_id").alias("id")).distinct().join(store.active.select("id", (F.col("lock_level") == "user").alias("locked")), "id")
    w = Window.partitionBy("session_id")
    free = F.count_if(~F.col("locked")).over(w)
    share = F.col("valence") / F.when(free > 0, free).otherwise(F.count("*").over(w))
    return shown.join(signal, "session_id").select("session_id", "id", F.round(share, 6).alias("valence"), (~F.col("locked")).alias("applied"))


def applied_feedback(store: Store) -> DataFrame:
    """Each event of the log with the evidence of its belief before and after it: events count in order, locked beliefs keep theirs, events of none are left out."""
    w = Window.partitionBy("belief_id").orderBy("feedback_id").rowsBetween(Window.unboundedPreceding, 0)
    moves = F.col("lock_level") == "none"
    up, down = F.greatest("valence", F.lit(0.0)), F.greatest(-F.col("valence"), F.lit(0.0))
    rows = store.feedback.where("valence <> 0").join(store.active.select(F.col("id").alias("belief_id"), "alpha", "beta", "lock_level"), "belief_id")
    rows = rows.withColumn("a", F.when(moves, F.sum(up).over(w)).otherwise(0.0)).withColumn("b", F.when(moves, F.sum(down).over(w)).otherwise(0.0))
    a, b = F.col("alpha") + F.col("a"), F.col("beta") + F.col("b")
    return rows.select("feedback_id", "belief_id", F.when(moves, a - up).otherwise(a).alias("prior_alpha"), F.when(moves, b - down).otherwise(b).alias("prior_beta"), a.alias("new_alpha"), b.alias("new_beta"), (~moves).alias("skipped"))


def surfaced_value(posteriors: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """The weighted mean of the means of signals (``key``, ``signal``, ``alpha``, ``beta``); the default where none counts."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("signal") == name, value).otherwise(w)
    mean = F.when(F.col("alpha") + F.col("beta") > 0, F.col("alpha") / (F.col("alpha") + F.col("beta"))).otherwise(0.5)
    g = posteriors.withColumn("w", w).where("w > 0").groupBy("key").agg(F.sum(F.col("w") * mean).alias("s"), F.sum("w").alias("t"))
    return posteriors.select("key").distinct().join(g, "key", "left").select("key", F.round(F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(default), 6).alias("value"))


def blocked_pairs(shingles: DataFrame, most: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of rows that share a shingle (``id``, ``g``) which 2 to ``most`` rows have; rows whose shared shingles are all more frequent are paired by
    those among themselves."""
    df = shingles.groupBy("g").agg(F.count("*").alias("df")).where("df >= 2")
    rows = shingles.join(df, "g")
    under = rows.where(F.col("df") <= most)
    rescued = rows.join(under.select("id"), "id", "left_anti")

    def pairs(x: DataFrame) -> DataFrame:
        return x.select(F.col("id").alias("a"), "g").join(x.select(F.col("id").alias("b"), "g"), "g").where("a < b").select("a", "b")

    # Each row of a rescued shingle would meet all others: they are joined to the least of them and found again as a component.
    lead = rescued.groupBy("g").agg(F.min("id").alias("a"))
    return pairs(under).unionByName(rescued.join(lead, "g").where("id <> a").select("a", F.col("id").alias("b"))).distinct()


def utterance_penalty(texts: DataFrame, odds: DataFrame, weight: float) -> DataFrame:
    """-weight times the mean log-odds of a text's words, where that is positive."""
    words = texts.select("id", F.explode(text.title_tokens(F.col("text"))).alias("word")).join(odds.select("word", "log_odds"), "word")
    g = words.groupBy("id").agg(F.avg("log_odds").alias("m"))
    return texts.select("id").join(g, "id", "left").select("id", F.round(-weight * F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))), 6).alias("penalty"))
