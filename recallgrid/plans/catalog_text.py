"""Queries of the detectors over the conversations and over sentences that show each case, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..functions import text as texts
from ..operators import similarity
from .registry import on_store, on_tables, one_byte, statements

SAYINGS = (
    "cd /srv/app and run it", "git push origin main", "git is a tool that we use daily.", "pytest -q", "⏺ Bash(ls)", "<task-notification> done", "</summary>", "│ cell │", "Building.", "Ready", "Ready when you are.",
    "Yes that is fine with me.", "No", "Polling for status", "Nothing", "Summary:", "Open Questions: ", "$ ls -la", "```python", "- item one", "The steps are:", "* star", "You must use the new parser.", "We require tests",
    "must.go is a file name", "hard rules apply here", "I prefer tabs over spaces", "never use eval", "i like it", "what is the plan", "What is the plan?", "Is it done? Yes it is.", "should we go?\nor not?", "maybe we should try it",
    "I think we might want a cache", "or maybe later", "what if it fails", "not sure whether this holds", "use the new one instead", "don't do that again", "We've been over this already", "I told you: no more of that!", "The limit is the same as before",
    "it is a non-blocking call", "no-op by design", "from now on always ask first", "always", "ensure that the lock is held", "Add tests for the parser", "Never commit secrets to the repo", "why should we always lock?", "I always forget when it rains",
    "perhaps avoid this", "prohibited by policy", "that's wrong", "perfect", "yes thanks", "no", "that's right, but undo that", "it works", "ok, good", "doesn't work", "correct!", "please try again", "looks good to me", "i already told you",
    "The cache is never used without the index", "The cache is always used with the index", "The cache is used with the index", "The cache is sometimes used with the index", "The index isn't used", "timeout = 30", "timeout is 45 and retries: 3", "max_size of 1.5e3",
    "The mode is synchronous", "async mode, read-only", "strict and full-scan", "enabled by default, permissive", "alpha beats beta", "Cache size equals large values of n", "x", "keep this for 30 days", "lock it for the next two weeks", "for the next month only",
    "valid for a year", "remember this", "COMMIT and push it now", "open a PR please", "write the docs", "see #12 and #345", "SUPERSEDES:d17", "DERIVED_FROM:d3 x", "NOPE:d1", "tell me about src/app/main.py", "How does fooBar work", "snake_case_name here", "",
)

SAID = statements("said", "text", SAYINGS) + ", both_ AS (SELECT 'k' || k AS id, text FROM said UNION ALL SELECT 't' || (conv_id * 100 + turn), text FROM conversations)"
WITH = f"WITH {SAID} "


def _sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences above and all turns."""
    from ..sources.model import table

    said = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(SAYINGS)], "id string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return said.unionByName(turns)


def _or(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _starts(column: str, phrases) -> str:
    return _or(*(f"starts_with({column}, {_q(p)})" for p in phrases))


def _has(column: str, phrases) -> str:
    return _or(*(f"contains({column}, {_q(p)})" for p in phrases))


def _match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


PROSE = _match("rtrim(text)", detect.PROSE_END)
SCAFFOLD = f"""CASE WHEN trim(text) = '' THEN false WHEN {_starts("text", detect.SHELL_PREFIXES)} THEN NOT {PROSE}
    ELSE starts_with(text, '{detect.GLYPH}') OR {_starts("text", detect.TAG_PREFIXES)} OR starts_with(ltrim(text), '</') OR (ltrim(text) <> '' AND contains('{detect.BOX_CHARACTERS}', substr(ltrim(text), 1, 1))) END"""


@on_tables(
    WITH
    + f"""SELECT id, {SCAFFOLD} AS scaffolding, CASE WHEN trim(text) = '' THEN false ELSE ({SCAFFOLD}) OR {_match("text", detect.PROGRESS)} OR {_match("text", detect.ACK_BARE)}
    OR replace(text, '’', '''') IN ({", ".join(map(_q, detect.ACK_PHRASES))}) OR ({_match("text", detect.ACK)} AND NOT {PROSE}) END AS noise,
    trim(text) <> '' AND ({_match("ltrim(text)", detect.STRANDED_HEADER)} OR starts_with(ltrim(text), '$ ')) AS stranded,
    trim(text) <> '' AND length(trim(text)) < 80 AND (starts_with(trim(text), '```') OR ends_with(trim(text), ':') OR regexp_matches(trim(text), '^[-*+]\\s')) AS subfloor FROM both_"""
)
def transcript_noise(spark, sf_dir):
    t = F.col("text")
    return _sayings(spark, sf_dir).select("id", detect.is_scaffolding(t).alias("scaffolding"), detect.is_transcript_noise(t).alias("noise"), detect.is_stranded(t).alias("stranded"), detect.is_subfloor(t).alias("subfloor"))


GATE = f"""CASE WHEN starts_with(trim(text), '<task-notification>') THEN 'system-tag:<task-notification>' WHEN starts_with(trim(text), '<system-') THEN 'system-tag:<system-' WHEN starts_with(trim(text), '<tool-result>') THEN 'system-tag:<tool-result>'
    WHEN length(trim(text)) < 12 THEN 'trivial:short' WHEN lower(trim(text)) IN ({", ".join(map(_q, detect.ACKS))}) THEN 'trivial:ack:' || lower(trim(text))
    WHEN len(list_filter(regexp_split_to_array(trim(regexp_replace(trim(text), '[!-/:-@\\[-`{{-~]', '', 'g')), '\\s+'), lambda w: w <> '')) <= 2 THEN 'trivial:token-count' END"""


@on_tables(WITH + f"SELECT id, {GATE} AS skip FROM both_")
def prompt_gate(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.prompt_gate(F.col("text")).alias("skip"))


@on_tables("SELECT url, contains(url, 'INEDIBLE') OR contains(url, 'a') AS inedible FROM (SELECT CASE WHEN page_id % 7 = 0 THEN replace(url, '/', '/INEDIBLE/') ELSE url END AS url FROM pages) q")
def inedible_paths(spark, sf_dir):
    from ..sources.model import table

    url = F.when(F.col("page_id") % 7 == 0, F.replace("url", F.lit("/"), F.lit("/INEDIBLE/"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(url.alias("url")).select("url", (detect.is_inedible(F.col("url")) | F.col("url").contains("a")).alias("inedible"))


@on_tables(WITH + ", p AS (SELECT ['CACHE', 'thion', '', 'plan?'] AS ps) SELECT id FROM both_, p WHERE len(list_filter(ps, lambda x: x <> '' AND contains(lower(text), lower(x)))) = 0")
def session_exclusions(spark, sf_dir):
    patterns = F.array(*(F.lit(p) for p in ("CACHE", "thion", "", "plan?")))
    return _sayings(spark, sf_dir).where(~detect.is_excluded(F.col("text"), patterns)).select("id")


QUESTION = rf"ends_with(s, '?') AND ({_starts('s', detect.QUESTION_PREFIXES)} OR (NOT contains(s, chr(10)) AND NOT regexp_matches(regexp_replace(s, '\?$', ''), '[.!?][''\")\]]*\s')))"
HEDGED = _or(_starts("s", detect.LEADING_HEDGES), _has("s", detect.INNER_HEDGES))
SIGNALS = (
    ("imperative", _or(_match("s", detect.IMPERATIVE), _match("s", detect.CORRECTION_ANCHOR), _match("s", detect.REQUIREMENT_ANCHOR))),
    ("always_never", _match("s", detect.words_pattern(detect.ALWAYS_NEVER))),
    ("negation", _match("s", detect.words_pattern(detect.NEGATIONS, apart=True))),
    ("emphasis", _match("s", detect.words_pattern(detect.EMPHASIS))),
    ("prior_ref", _match("s", detect.words_pattern(detect.PRIOR_REFERENCE))),
    ("declarative", _match("s", detect.DECLARATIVE)),
)
N_SIGNALS = "(" + " + ".join(f"CAST({c} AS INTEGER)" for _, c in SIGNALS) + ")"
LOW = f"(SELECT id, text, trim(lower(text)) AS s FROM both_)"  # noqa: F541
NEEDED = r"regexp_matches(s || ' ', '\b(hard rules|hard rule|constraints|constraint|requirement|mandatory|required|requires|hard cap|require|must)($|\.($|[^a-z0-9])|[^.a-z0-9_])')"


@on_tables(WITH + f"SELECT id, {QUESTION} AS question, {HEDGED} AS hedged FROM {LOW} q")
def questions_and_hedges(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.is_question(F.col("text")).alias("question"), detect.is_hedged(F.col("text")).alias("hedged"))


@on_tables(WITH + f"SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(n)} END' for n, c in SIGNALS)}], lambda x: x IS NOT NULL), ' ') AS signals, {N_SIGNALS} >= 2 AS correction, round(least(1.0, {N_SIGNALS} * 0.3), 6) AS confidence FROM {LOW} q")
def corrections(spark, sf_dir):
    t = F.col("text")
    return _sayings(spark, sf_dir).select("id", F.array_join(detect.correction_signals(t), " ").alias("signals"), detect.is_correction(t).alias("correction"), F.round(detect.correction_confidence(t), 6).alias("confidence"))


KIND = f"CASE WHEN s = '' OR ({QUESTION}) THEN 'factual' WHEN {NEEDED} THEN 'requirement' WHEN {N_SIGNALS} >= 2 THEN 'correction' WHEN {_has('s', texts.PREFERENCE)} THEN 'preference' ELSE 'factual' END"


@on_tables(
    WITH
    + f"""SELECT id, type, s <> '' AND NOT question AND (type <> 'factual' OR NOT hedged) AS persist, greatest(0.5, 0.2 * CASE type WHEN 'preference' THEN 7.0 WHEN 'factual' THEN 3.0 ELSE 9.0 END) AS alpha
    FROM (SELECT id, s, {KIND} AS type, {QUESTION} AS question, {HEDGED} AS hedged FROM {LOW} q) z"""
)
def sentence_classes(spark, sf_dir):
    rows = _sayings(spark, sf_dir).select("id", detect.sentence_class(F.col("text")).alias("c")).select("id", "c.type", "c.persist")
    return rows.withColumn("alpha", texts.prior(F.col("type"), F.lit(False), "alpha"))


VERBS = "(?i)\\b(?:" + "|".join(sorted(detect.DIRECTIVE_VERBS, key=len, reverse=True)) + ")\\b"


@on_tables(
    WITH
    + f"""SELECT id, trim(text) <> '' AND NOT ends_with(trim(text), '?') AND NOT {_match("trim(text)", detect.WH_QUESTION)} AND NOT {_match("trim(text)", detect.NARRATION)}
    AND NOT {_match("trim(text)", detect.HEDGE)} AND NOT {_match("trim(text)", detect.TASK_VERB)} AND {_match("trim(text)", VERBS)} AS directive FROM both_"""
)
def directives(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.is_directive(F.col("text")).alias("directive"))


def _first(patterns, valence: str, only=None) -> str:
    return " ".join(f"WHEN {_match('text', '(?i)' + p)} THEN '{n} {valence}'" for n, p in patterns if only is None or n in only)


SENTIMENT = f"CASE WHEN length(text) = 0 OR length(text) > 200 THEN NULL {_first(detect.NEGATIVE, '-1.5', detect.STRONG_NEGATIVE)} {_first(detect.POSITIVE, '1.5', detect.STRONG_POSITIVE)} {_first(detect.NEGATIVE, '-1.0')} {_first(detect.POSITIVE, '1.0')} END"


@on_tables(WITH + f"SELECT id, split_part(f, ' ', 1) AS pattern, CAST(split_part(f, ' ', 2) AS DOUBLE) AS valence FROM (SELECT id, {SENTIMENT} AS f FROM both_) q WHERE f IS NOT NULL")
def sentiments(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.sentiment(F.col("text")).alias("f")).where("f IS NOT NULL").select("id", "f.pattern", "f.valence")


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
AXIS = "CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in detect.QUANTIFIERS.items()) + " END"
SIGNAL = f"""(SELECT id, len(list_filter(t, lambda w: w IN {_in(detect.NEGATION_TOKENS)})) > 0 OR {_match("text", detect.CONTRACTION)} AS negation, list_transform(list_filter(t, lambda w: w IN {_in(detect.QUANTIFIERS)}), lambda w: {AXIS})[1] AS axis,
    list_distinct(list_filter(t, lambda w: w NOT IN {_in((*detect.STOPWORDS, *detect.NEGATION_TOKENS, *detect.QUANTIFIERS))})) AS residual FROM (SELECT id, text, {TOKENS} AS t FROM both_) q)"""


@on_tables(WITH + f"SELECT id, negation, CAST(axis AS DOUBLE) AS axis, len(residual) AS n FROM {SIGNAL} z")
def relationship_signals(spark, sf_dir):
    rows = _sayings(spark, sf_dir).select("id", detect.signals(F.col("text")).alias("s"))
    return rows.select("id", "s.negation", "s.axis", F.size("s.residual").cast("long").alias("n"))


RELATED = f""", g AS (SELECT * FROM {SIGNAL} z), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.residual, b.residual)) * 1.0 / len(list_distinct(list_concat(a.residual, b.residual))) AS o, a.negation <> b.negation AS n, abs(a.axis - b.axis) / 2 AS q
      FROM g a JOIN g b ON a.id < b.id AND len(list_intersect(a.residual, b.residual)) > 0),
    v AS (SELECT a, b, CASE WHEN (CAST(n AS INTEGER) + coalesce(q, 0)) / 2 > 0 THEN 'contradicts' ELSE 'refines' END AS label, round((CAST(n AS INTEGER) + coalesce(q, 0)) / 2, 3) AS score, round(o, 6) AS overlap FROM p WHERE o >= 0.4)"""


def _related(spark, sf_dir) -> DataFrame:
    rows = _sayings(spark, sf_dir).select("id", detect.signals(F.col("text")).alias("s"))
    return similarity.related(rows, "id", "s", 0.4)


@on_tables(WITH + RELATED + " SELECT * FROM v")
def relationship_audit(spark, sf_dir):
    return _related(spark, sf_dir)


@on_tables(WITH + RELATED + " SELECT b AS src, a AS dst, 'POTENTIALLY_STALE' AS type FROM v WHERE label = 'contradicts' AND score < 0.5")
def stale_edges(spark, sf_dir):
    """Edges from the later to the earlier of two sentences that contradict each other weakly; ids stand for time here."""
    weak = _related(spark, sf_dir).where("label = 'contradicts' AND score < 0.5")
    return weak.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"), F.lit("POTENTIALLY_STALE").alias("type"))


NUMBERS = r"""(SELECT id, lower(k) AS key, CAST(v AS DOUBLE) AS value FROM (SELECT id, unnest(regexp_extract_all(text, '{p}', 1)) AS k, unnest(regexp_extract_all(text, '{p}', 3)) AS v FROM both_) q
    WHERE lower(k) NOT IN ({d}))""".format(p=detect.NUMERIC.replace("'", "''"), d=", ".join(map(_q, detect.NUMERIC_DROP)))


@on_tables(WITH + f"SELECT DISTINCT id, key, value FROM {NUMBERS} n")
def numeric_slots(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", F.explode(detect.numeric_slots(F.col("text"))).alias("s")).select("id", "s.key", "s.value")


@on_tables(WITH + f"SELECT a.id AS a, b.id AS b, a.key AS key, a.value AS value_a, b.value AS value_b FROM (SELECT DISTINCT * FROM {NUMBERS} n) a JOIN (SELECT DISTINCT * FROM {NUMBERS} n) b ON a.key = b.key AND a.id < b.id WHERE abs(a.value - b.value) > 0.01 * greatest(abs(a.value), abs(b.value))")
def slot_conflicts(spark, sf_dir):
    rows = _sayings(spark, sf_dir).select("id", F.explode(detect.numeric_slots(F.col("text"))).alias("s")).select("id", "s.key", "s.value")
    return similarity.numeric_conflicts(rows, rows, 0.01).where("a < b")


GROUPED = [(m, c, sorted(g)[0]) for c, groups in detect.ENUMS.items() for g in groups for m in g]


def _enum_sql() -> str:
    """Each known word where no longer known word around it stands in its place."""
    cases, rest = [], "lower(text)"
    for m, c, g in sorted(GROUPED, key=lambda x: (-len(x[0]), x[0])):
        cases.append(f"CASE WHEN {_match(rest, '(?:^|[^A-Za-z0-9_])' + m + '(?:$|[^A-Za-z0-9_])')} THEN '{c} {g}' END")
        if any(m in other and m != other for other, _, _ in GROUPED) or "-" in m:
            rest = f"replace({rest}, '{m}', ' ')"
    return ", ".join(cases)


@on_tables(WITH + f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([{_enum_sql()}], lambda x: x IS NOT NULL))), ',') AS slots FROM both_")
def enum_slots(spark, sf_dir):
    names = F.transform(detect.enum_slots(F.col("text")), lambda s: F.concat_ws(" ", s["category"], s["group_id"]))
    return _sayings(spark, sf_dir).select("id", F.array_join(F.array_sort(names), ",").alias("slots"))


@on_tables(WITH + f"SELECT id, regexp_extract(trim(text), {_q(detect.SLOT)}, 1) AS subject, regexp_extract(trim(text), {_q(detect.SLOT)}, 3) AS predicate, trim(regexp_extract(trim(text), {_q(detect.SLOT)}, 5)) AS value FROM both_ WHERE {_match('trim(text)', detect.SLOT)}")
def memory_slots(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.slot(F.col("text")).alias("s")).where("s IS NOT NULL").select("id", "s.subject", "s.predicate", "s.value")


SPECS = ("30d", "2w", "3mo", "1y", "forever", "0d", " 6MO ", "12", "40d", "1mo")


@on_tables(
    "WITH "
    + statements("specs", "spec", SPECS)
    + r""", e AS (SELECT DISTINCT ts FROM events), w AS (SELECT spec, ts, TRY_CAST(regexp_extract(lower(trim(spec)), '^(\d+)(d|w|mo|y)$', 1) AS INTEGER) AS n, regexp_extract(lower(trim(spec)), '^(\d+)(d|w|mo|y)$', 2) AS u FROM specs, e)
    SELECT spec, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts + CASE u WHEN 'd' THEN to_days(n) WHEN 'w' THEN to_days(7 * n) WHEN 'mo' THEN to_months(n) ELSE to_months(12 * n) END)) AS BIGINT) AS until FROM w WHERE u <> '' AND n > 0"""
)
def lock_windows(spark, sf_dir):
    """When a lock taken at each event's time would run out, by each form of a duration."""
    from ..sources.model import table

    specs = spark.createDataFrame([(s,) for s in SPECS], "spec string")
    start = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("ts").distinct().crossJoin(F.broadcast(specs))
    rows = rows.select("spec", F.unix_timestamp(start).alias("start"), F.unix_timestamp(detect.lock_until(start, F.col("spec"))).alias("until"))
    return rows.where("until IS NOT NULL")


COUNTS = r"(\d+|" + "|".join(sorted(detect.NUMBER_WORDS, key=len, reverse=True)) + ")"
FOR = rf"(?i)\bfor\s+(?:the\s+)?(?:next\s+)?{COUNTS}\s+(day|week|month|year)s?\b"
NEXT = r"(?i)\bfor\s+the\s+next\s+(day|week|month|year)\b"
UNIT_SQL = "CASE lower({0}) WHEN 'day' THEN 'd' WHEN 'week' THEN 'w' WHEN 'month' THEN 'mo' ELSE 'y' END"
NUMBER_SQL = "CASE lower({0}) " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in detect.NUMBER_WORDS.items()) + " ELSE {0} END"


@on_tables(
    WITH
    + f"""SELECT id, CASE WHEN {_match("text", FOR)} THEN {NUMBER_SQL.format(f"regexp_extract(text, {_q(FOR)}, 1)")} || {UNIT_SQL.format(f"regexp_extract(text, {_q(FOR)}, 2)")}
    ELSE '1' || {UNIT_SQL.format(f"regexp_extract(text, {_q(NEXT)}, 1)")} END AS lasts FROM both_ WHERE {_match("text", FOR)} OR {_match("text", NEXT)}"""
)
def stated_windows(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", detect.stated_window(F.col("text")).alias("lasts")).where("lasts IS NOT NULL")


CATEGORIES = (("git-workflow", False, "commit|push|pull\\s+request|pr|merge"), ("prose-and-docs", False, "write|draft|docs"), ("repo-rules", True, "~none~"), ("testing", False, "test|tests|pytest"))


@on_tables(
    WITH
    + ", c(name, always_on, words) AS (VALUES "
    + ", ".join(f"('{n}', {a}, '{w}')" for n, a, w in CATEGORIES)
    + ") SELECT id, string_agg(name, ' ' ORDER BY name) AS categories FROM both_, c WHERE always_on OR regexp_matches(text, '(?i)\\b(?:' || words || ')\\b') GROUP BY id"
)
def category_match(spark, sf_dir):
    """The categories that prompts call up, by their words or always."""
    rows = spark.createDataFrame(list(CATEGORIES), "name string, always_on boolean, words string")
    hit = F.col("always_on") | F.regexp_like("text", F.concat(F.lit("(?i)" + texts.EDGE + "(?:"), F.col("words"), F.lit(")" + texts.EDGE)))
    pairs = _sayings(spark, sf_dir).join(F.broadcast(rows), hit)  # categories are a handful that the user writes
    return pairs.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("categories"))


GLOBS = ("*/page*", "http*://*.org/*", "*1?")


@on_tables("SELECT url FROM pages WHERE url GLOB '*/page*' OR url GLOB 'http*://*.org/*' OR url GLOB '*1?'")
def category_globs(spark, sf_dir):
    from ..sources.model import table

    out = F.lit(False)
    for g in GLOBS:
        p = "".join({"*": "(?s:.*)", "?": "."}.get(c, "\\" + c if c in ".\\+()[]{}^$|/" else c) for c in g)
        out = out | F.col("url").rlike(f"^{p}$")
    return table(spark, sf_dir, "pages").where(out).select("url")


NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@on_store(
    "turns",
    f"""SELECT a.conv_id, a.turn, CAST(length({NORM.format("a.said")}) >= 8 AND contains({NORM.format("b.text")}, {NORM.format("a.said")}) AS INTEGER) AS referenced
    FROM (SELECT conv_id, turn, substr(text, 1, CASE WHEN turn % 2 = 0 THEN 12 ELSE 5 END) AS said FROM turns) a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def score_references(s):
    """Whether a turn has the opening of the turn before it."""
    first = s.turns.select("conv_id", "turn", F.substring("text", 1, 1000).alias("t")).withColumn("said", F.when(F.col("turn") % 2 == 0, F.substring("t", 1, 12)).otherwise(F.substring("t", 1, 5)))
    after = s.turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return first.join(after, ["conv_id", "turn"]).select("conv_id", "turn", detect.is_referenced(F.col("said"), F.col("response")).cast("int").alias("referenced"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '(?m)^[ \t]*[-*+]\s+', '', 'g')"


@on_tables(WITH + rf"SELECT id, len(list_filter(list_transform(flatten(list_transform(regexp_split_to_array({CLEAN}, '\r\n|\r|\n'), lambda l: string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x)), lambda x: length(x) >= 10)) AS n FROM both_")
def extracted_sentences(spark, sf_dir):
    return _sayings(spark, sf_dir).select("id", F.size(texts.sentences(F.regexp_replace("text", r"(?m)^[ \t]*[-*+]\s+", ""))).cast("long").alias("n"))


@on_tables(WITH + r"SELECT id, regexp_extract(trim(text), '^([A-Z][A-Z_]*):(\S.*)$', 1) AS kind, trim(regexp_extract(trim(text), '^([A-Z][A-Z_]*):(\S.*)$', 2)) AS target FROM both_ WHERE regexp_extract(trim(text), '^([A-Z][A-Z_]*):(\S.*)$', 1) IN ('SUPPORTS', 'CITES', 'CONTRADICTS', 'SUPERSEDES', 'RELATES_TO', 'DERIVED_FROM', 'IMPLEMENTS', 'TESTS', 'TEMPORAL_NEXT', 'RESOLVES')")
def structural_markers(spark, sf_dir):
    from ..operators.graph import VALENCE

    p = r"^([A-Z][A-Z_]*):(\S.*)$"
    rows = _sayings(spark, sf_dir).select("id", F.regexp_extract(F.trim("text"), p, 1).alias("kind"), F.trim(F.regexp_extract(F.trim("text"), p, 2)).alias("target"))
    return rows.where(F.col("kind").isin(*VALENCE))


@on_tables(
    WITH
    + """, b AS (SELECT id, text FROM both_ WHERE text <> '')
    SELECT a.k AS prompt, b.id, round(ln(2.0), 6) AS boost FROM (SELECT k, regexp_extract_all(text, '#\\d+') AS lits FROM said WHERE regexp_matches(text, '#\\d+')) a JOIN b ON len(list_filter(a.lits, lambda l: contains(b.text, l))) > 0"""
)
def literal_boost(spark, sf_dir):
    """Texts that have a #N of a prompt, which adds ln 2 to their score."""
    rows = _sayings(spark, sf_dir).where("text <> ''")
    said = spark.createDataFrame([(k, t) for k, t in enumerate(SAYINGS)], "prompt int, said string")
    marks = said.select("prompt", F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit(r"#\d+"), F.lit(0)))).alias("mark"))
    have = rows.select("id", F.col("text").alias("body"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"#\d+"), F.lit(0)))).alias("own"))
    pairs = have.join(F.broadcast(marks), F.startswith("own", F.col("mark")))  # prompts of one batch
    return pairs.select("prompt", "id").distinct().withColumn("boost", F.round(F.log(F.lit(2.0)), 6))


QUESTION_FORMS = ("what", "why", "how", "which", "who", "tell me", "explain")
MARKED = (r"#\d+\b", r"\b(?:src|tests|docs|benchmarks|scripts)/[A-Za-z0-9_./\-]+", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[a-z][a-z0-9]*[A-Z][A-Za-z0-9]+\b", r"\b(?:POTENTIALLY_STALE|TEMPORAL_NEXT|DERIVED_FROM|CONTRADICTS|IMPLEMENTS|SUPERSEDES|RELATES_TO|SUPPORTS|RESOLVES|CITES|TESTS)\b")
GATED = f"CASE WHEN {_or(*(_match('text', p) for p in MARKED))} THEN 'marker' WHEN length(text) / 4 > 80 THEN 'long' WHEN {_starts('lower(trim(text))', QUESTION_FORMS)} THEN 'question' ELSE 'default' END"


@on_tables(WITH + f"SELECT id, {GATED} AS reason FROM both_")
def expansion_gate(spark, sf_dir):
    """Why a prompt is expanded over the graph (marker, default) or not (long, question)."""
    t = F.col("text")
    marked = F.lit(False)
    for p in MARKED:
        marked = marked | t.rlike(texts.edged(p))
    asks = F.lit(False)
    for p in QUESTION_FORMS:
        asks = asks | F.lower(F.trim(t)).startswith(p)
    return _sayings(spark, sf_dir).select("id", F.when(marked, "marker").when(F.length(t) / 4 > 80, "long").when(asks, "question").otherwise("default").alias("reason"))


@on_tables(WITH + r"SELECT id, array_to_string(list_sort(flatten(list_transform(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))), lambda w: [lower(w), lower(w)]))), ' ') AS more FROM both_")
def capitalised_expansion(spark, sf_dir):
    """The capitalised words of a query in lower case, twice each."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)))
    return _sayings(spark, sf_dir).select("id", F.array_join(F.array_sort(F.flatten(F.transform(words, lambda w: F.array_repeat(F.lower(w), 2)))), " ").alias("more"))


TITLE = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"


@on_store(
    "beliefs",
    f""", t AS (SELECT id, origin, {TITLE.format("substr(content, 1, 80)")} AS t FROM beliefs)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM t a JOIN t b ON a.origin = 'user_stated' AND b.origin = 'user_corrected'
    WHERE len(a.t) > 0 AND len(b.t) > 0 AND round(len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))), 6) >= 0.3""",
)
def title_jaccard(s):
    """Openings of beliefs of two origins whose words are alike."""
    rows = s.beliefs.select("id", "origin", texts.title_tokens(F.substring("content", 1, 80)).alias("t"))
    a, b = (rows.where(F.col("origin") == o).select(F.col("id").alias(n), "t") for o, n in (("user_stated", "a"), ("user_corrected", "b")))
    return similarity.similar_to(a, b, "a", "b", 0.3)


@on_store(
    "beliefs",
    f""", t AS (SELECT id, content_hash, lock_level, type, origin, {TITLE.format("content")} AS t FROM beliefs WHERE valid_to IS NULL), l AS (SELECT * FROM t WHERE lock_level <> 'none'), p AS (SELECT * FROM t WHERE type = 'speculative' AND origin = 'speculative')
    SELECT l.id AS lock_id, p.id FROM l JOIN p ON l.content_hash = p.content_hash OR (len(l.t) > 0 AND len(p.t) > 0 AND round(len(list_intersect(l.t, p.t)) * 1.0 / len(list_distinct(list_concat(l.t, p.t))), 6) >= 0.2)""",
)
def phantom_lock_matches(s):
    from ..operators import ledger

    return ledger.phantom_lock_matches(s, s.active.where("lock_level <> 'none'").select(F.col("id").alias("lock_id"), F.col("content").alias("text")), 0.2)


@on_store(
    "beliefs",
    ", " + one_byte("beliefs", "content") + f""", l AS (SELECT id, translate(content, f, ab.t) AS content, {TITLE.format("content")} AS t FROM beliefs, ab WHERE valid_to IS NULL AND lock_level <> 'none'), n AS (SELECT id, translate(content, f, ab.t) AS content, {TITLE.format("content")} AS t FROM beliefs, ab WHERE type = 'correction')
    SELECT n.id AS text_id, l.id AS lock_id, round(len(list_intersect(l.t, n.t)) * 1.0 / len(list_distinct(list_concat(l.t, n.t))), 6) AS jaccard, round(1 - levenshtein(l.content, n.content) * 1.0 / greatest(length(l.content), length(n.content)), 6) AS ratio
    FROM n JOIN l ON n.id <> l.id WHERE len(l.t) > 0 AND len(n.t) > 0 AND round(len(list_intersect(l.t, n.t)) * 1.0 / len(list_distinct(list_concat(l.t, n.t))), 6) >= 0.12
    AND round(1 - levenshtein(l.content, n.content) * 1.0 / greatest(length(l.content), length(n.content)), 6) >= 0.2""",
)
def near_duplicate_locks(s):
    """Locks that corrections nearly repeat, by words and by edit distance."""
    rows = s.beliefs.select("id", "content", texts.title_tokens(F.col("content")).alias("t"), "type", "lock_level", "valid_to")
    new = rows.where("type = 'correction'").select(F.col("id").alias("text_id"), "t")
    locks = rows.where("valid_to IS NULL AND lock_level <> 'none'").select(F.col("id").alias("lock_id"), "t")
    near = similarity.similar_to(new, locks, "text_id", "lock_id", 0.12).where("text_id <> lock_id")
    both = near.join(rows.select(F.col("id").alias("text_id"), F.col("content").alias("ca")), "text_id").join(rows.select(F.col("id").alias("lock_id"), F.col("content").alias("cb")), "lock_id")
    ratio = F.round(similarity.edit_ratio(F.col("ca"), F.col("cb")), 6)
    return both.select("text_id", "lock_id", "jaccard", ratio.alias("ratio")).where("ratio >= 0.2")


@on_store("turns", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said, max(turn) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns) q WHERE n <= 4 AND trim(text) <> '' GROUP BY 1")
def recent_turns(s):
    """The last four turns of each conversation, joined in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = s.turns.withColumn("n", n).where("n <= 4").where("trim(text) <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("said"), F.max("turn").alias("last"))


@on_store(
    "turns",
    """, r AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns) q WHERE n BETWEEN 2 AND 5 AND trim(text) <> '' GROUP BY 1)
    SELECT conv_id, text || ' ' || text || ' ' || text || coalesce(' ' || said, '') AS query FROM (SELECT conv_id, arg_max(text, turn) AS text FROM turns GROUP BY 1) p LEFT JOIN r USING (conv_id)""",
)
def conversation_query(s):
    """A query of the last turn three times and the four before it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = s.turns.withColumn("n", n).where("n <= 5")
    before = F.array_sort(F.collect_list(F.when((F.col("n") > 1) & (F.trim("text") != ""), F.struct("turn", "text"))))
    g = rows.groupBy("conv_id").agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("t"), before.alias("before"))
    return g.select("conv_id", F.array_join(F.concat(F.array("t", "t", "t"), F.transform("before", lambda x: x["text"])), " ").alias("query"))
