"""Detectors over sentences and prompts as column expressions: noise, hedges, corrections, directives, sentiment, signals, slots.

Patterns are written so that they mean the same in Java's and in RE2's syntax wherever that is possible.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PREFERENCE, REQUIREMENT, edged, title_tokens

# ---- fixed values: words, phrases and patterns -----------------------------------------------------------------------------

SHELL_PREFIXES = ("cd /", "git ", "gh ", "uv run", "pytest", "python ")
GLYPH = "⏺"
TAG_PREFIXES = ("<worktree", "<output-file", "<task-", "<summary>Background", "<summary>Monitor", "<tool-use-id", "<usage", "<event", "<total_tokens", "<system-reminder", "<command-name", "<command-message", "<command-args", "<local-command-stdout", "<local-command-caveat")
BOX_CHARACTERS = "┌┐└┘├┤┬┴┼─│╭╮╰╯╞╡═"
PROGRESS = r"^[A-Z][a-z]+ing\.$"
ACK = r"^(Yes|No|Standing by|Ready|Nothing|Polling)( .{0,40})?\.?$"
ACK_BARE = r"^(Yes|No|Standing by|Ready|Nothing|Polling)\.?$"
PROSE_END = r"""[\w)"']\.$"""
ACK_PHRASES = ("Ready when you are.", "Nothing to report.", "Polling for results.", "No changes needed.", "Nothing further.", "No problem.", "Standing by for your direction.", "Yes that's what I want you to do.")
STRANDED_HEADER = r"^[A-Z][A-Za-z0-9]+([ /][A-Za-z0-9]+){0,3}:\s*$"
SUBFLOOR_LENGTH = 80
SYSTEM_TAGS = ("<task-notification>", "<system-", "<tool-result>")
ACKS = ("yes", "y", "yeah", "yep", "no", "n", "ok", "okay", "continue", "keep going", "go", "next", "b", "a", "more", "done")
MIN_PROMPT = 12
INEDIBLE = "INEDIBLE"

QUESTION_PREFIXES = ("what ", "how ", "why ", "when ", "where ", "can ", "does ", "is there", "should ", "would ", "could ")
LEADING_HEDGES = (
    "maybe ", "maybe,", "perhaps ", "perhaps,", "what if ", "how about ", "what about ", "i wonder ", "i wonder if", "wondering if ", "not sure ", "i guess ", "i suppose ", "or maybe ", "or perhaps ", "or should ", "or we could ", "or we should ", "should we ", "could we ", "shouldn't we ", "shouldnt we ",
)
INNER_HEDGES = ("maybe we ", "maybe there ", "maybe it would ", "we probably need ", "we could probably ", "we might want ", "we should probably ", "not sure if ", "not sure whether ")

IMPERATIVE = r"^(use|add|remove|update|follow|convert|make|do|try|run|keep|leave|report|copy|stop|always|never|we are|calls|5k)\b"
CORRECTION_ANCHOR = r"\b(supersedes|no longer|the previous|instead|actually)\b"
REQUIREMENT_ANCHOR = r"\b(must not|cannot|fails if)\b"
DECLARATIVE = r"(?:is|are|needs to be|should be|must be) (?:the|a|an|\d|only|always)"
ALWAYS_NEVER = ("always", "never", "every time", "every single", "from now on", "permanently", "period")
NEGATIONS = ("do not", "don't", "dont", "not", "no more", "no")
EMPHASIS = ("!", "hate", "ever again", "zero question", "100 times")
PRIOR_REFERENCE = ("we've been", "i told you", "we discussed", "we agreed", "already", "iirc", "we decided")
CORRECTION_SIGNALS, CONFIDENCE_A_SIGNAL = 2, 0.3

DIRECTIVE_VERBS = (
    "never", "always", "must", "must not", "do not", "don't", "should", "should not", "shouldn't", "shall", "ensure", "require", "required", "requires", "avoid", "prefer", "only", "before", "after", "unless", "whenever", "need to", "needs to", "cannot", "can't", "won't", "forbidden", "mandatory", "prohibited",
)
HEDGE = r"(?i)\b(maybe|perhaps|probably|might|i think|i guess|i wonder|not sure|kinda|sort of|sometimes|occasionally|in theory)\b"
NARRATION = r"(?i)\bi\s+(never|always|don't|do not|won't|cannot|can't|must|should)\b(\s+\w+){1,8}\s+(when|while|if|because|since)\b"
WH_QUESTION = r"(?i)^\s*(what|why|how|when|where|who|which|whose|whom)\b"
TASK_VERB = r"(?i)^\s*(refactor|add|implement|write|create|update|fix|make|build|remove|rename|extract|merge|split|move|delete)\b"

POSITIVE = (
    ("ok_good", r"\bok(ay)?[\s,!.]+good\b"),
    ("yes", r"\byes\b"),
    ("yeah", r"\byeah\b"),
    ("perfect", r"\bperfect\b"),
    ("great", r"\bgreat\b"),
    ("nice", r"\bnice\b"),
    ("thanks", r"\bthanks?\b"),
    ("correct", r"\b(?:that'?s|that is|this is|it'?s|it is|you'?re|you are)\s+correct\b|^\s*correct[\s.!]*$"),
    ("right", r"\bthat'?s right\b"),
    ("works", r"\b(it|that) works?\b"),
    ("looks_good", r"\blooks? good\b"),
    ("good_job", r"\bgood (job|work)\b"),
)
NEGATIVE = (
    ("no", r"\bno\b"),
    ("nope", r"\bnope\b"),
    ("wrong", r"\b(that'?s |is )?wrong\b"),
    ("incorrect", r"\bincorrect\b"),
    ("not_what", r"\bnot what i\b"),
    ("fix_it", r"\bfix (it|this|that)\b"),
    ("broken", r"\bbroken\b"),
    ("doesnt_work", r"\bdoes ?n'?t work\b"),
    ("stop", r"\bstop (doing |that)\b"),
    ("i_told_you", r"\bi (already )?told you\b"),
    ("undo", r"\bundo (that|it|this)\b"),
    ("try_again", r"\btry again\b"),
)
STRONG_POSITIVE, STRONG_NEGATIVE = ("perfect", "correct", "right", "good_job"), ("wrong", "incorrect", "i_told_you", "fix_it", "broken")
LONGEST_SENTIMENT, BASE_VALENCE, STRONG_VALENCE, ESCALATED_VALENCE = 200, 1.0, 1.5, 2.0

NEGATION_TOKENS = ("not", "no", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "without", "avoid", "refuse", "prohibit", "prohibited", "disallow", "disallowed", "forbid", "forbidden", "deny", "denied")
CONTRACTION = r"(?i)\b\w+n['’]t\b|\b(?:dont|doesnt|didnt|isnt|arent|wasnt|werent|hasnt|havent|hadnt|shouldnt|wouldnt|couldnt|mustnt|mightnt|wont|cant|shant|aint)\b"
QUANTIFIERS = {"always": 1.0, "every": 1.0, "all": 1.0, "must": 1.0, "usually": 0.6, "often": 0.6, "mostly": 0.6, "frequently": 0.6, "sometimes": 0.0, "occasionally": 0.0, "rarely": -0.6, "seldom": -0.6, "never": -1.0}
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on", "for", "with", "by", "and", "or", "but", "if", "then", "than", "as", "at", "from", "this", "that", "these", "those", "it", "its", "i", "you", "we", "they", "he", "she", "him", "her", "them", "us", "me", "my", "your", "our", "their", "his", "hers", "do", "does", "did", "have", "has", "had", "will", "would", "should", "could", "can", "into", "about", "over", "under", "out", "up", "down", "use", "used", "using", "uses", "any", "some", "t", "s", "don", "won", "doesn", "didn", "isn", "aren", "wasn", "weren", "shouldn", "wouldn", "couldn", "hasn", "haven", "hadn", "cant", "wont", "dont", "isnt",
)

NUMERIC_DROP = "is are was were be of to at on in as by for with the a an this that and or but equals equal".split()
NUMERIC = r"([A-Za-z][A-Za-z0-9_]{0,31})\s*(=|:|\bis\b|\bof\b|\bto\b|\bequals?\b)?\s*([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)\b"
#: What holds wherever ``NUMERIC`` begins: a digit in the word, or a number right after it. Told without backing up, which at each letter of a text without numbers is what costs.
NUMERIC_AHEAD = r"(?=[A-Za-z_]++(?:\d|\s*+(?:=|:|\bis\b|\bof\b|\bto\b|\bequals?\b)?+\s*+[+-]?\d))"
ENUMS = {
    "execution_mode": (("synchronous", "sync"), ("asynchronous", "async")),
    "default_state": (("default-on", "enabled"), ("default-off", "disabled")),
    "storage_mode": (("indexed",), ("scan", "full-scan", "table-scan")),
    "completeness": (("full",), ("incremental",), ("partial",)),
    "strictness": (("strict",), ("lax", "permissive")),
    "necessity": (("required",), ("optional",)),
    "visibility": (("public",), ("private",)),
    "access_mode": (("readonly", "read-only"), ("writable", "read-write")),
    "determinism": (("deterministic",), ("non-deterministic", "nondeterministic", "stochastic")),
}
SLOT = r"(?s)^([A-Za-z][A-Za-z0-9_-]*(\s+[A-Za-z][A-Za-z0-9_-]*)?)\s+([A-Za-z][A-Za-z0-9_-]*)(\s+(.+))?$"
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
UNIT_WORDS = {"day": "d", "week": "w", "month": "mo", "year": "y"}
MIN_REFERENCE = 8


def _any_of(text: Column, phrases: tuple[str, ...], how: str) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | {"in": text.contains(p), "starts": text.startswith(p), "is": text == p}[how]
    return out


def words_pattern(words: tuple[str, ...], apart: bool = False) -> str:
    """Any of the words or phrases, longest first, between word boundaries where they begin or end in a letter or digit; with
    ``apart`` a hyphen before or after is no boundary either."""
    parts = []
    for w in sorted(words, key=len, reverse=True):
        left = r"(?:^|[^\w-])" if apart else r"\b"
        right = r"(?:$|[^\w-])" if apart else r"\b"
        parts.append((left if re.match(r"\w", w[0]) else "") + re.sub(r"([!.?*+()\[\]])", r"\\\1", w) + (right if re.match(r"\w", w[-1]) else ""))
    return "(?:" + "|".join(parts) + ")"


# ---- transcripts and prompts ------------------------------------------------------------------------------------------------


def _is_prose(text: Column) -> Column:
    return F.rtrim(text).rlike(PROSE_END)


def is_scaffolding(text: Column) -> Column:
    """Shell lines (unless they end like prose), tool glyphs, tags and box drawings."""
    head = F.ltrim(text)
    return F.when(F.trim(text) == "", False).when(_any_of(text, SHELL_PREFIXES, "starts"), ~_is_prose(text)).otherwise(
        text.startswith(GLYPH) | _any_of(text, TAG_PREFIXES, "starts") | head.startswith("</") | F.lit(BOX_CHARACTERS).contains(F.substring(head, 1, 1)) & (head != "")
    )


def is_transcript_noise(text: Column) -> Column:
    """Scaffolding, progress words and acknowledgements; an acknowledgement that goes on as prose is kept."""
    folded = F.regexp_replace(text, "’", "'")
    return F.when(F.trim(text) == "", False).otherwise(is_scaffolding(text) | text.rlike(PROGRESS) | text.rlike(ACK_BARE) | _any_of(folded, ACK_PHRASES, "is") | (text.rlike(ACK) & ~_is_prose(text)))


def is_stranded(text: Column) -> Column:
    head = F.ltrim(text)
    return (F.trim(text) != "") & (head.rlike(STRANDED_HEADER) | head.startswith("$ "))


def is_subfloor(text: Column) -> Column:
    """Short code fences, lines that end in a colon, and bullets."""
    s = F.trim(text)
    return (s != "") & (F.length(s) < SUBFLOOR_LENGTH) & (s.startswith("```") | s.endswith(":") | s.rlike(r"^[-*+]\s"))


def is_inedible(path: Column) -> Column:
    """Whether the name of a file or of a folder above it has the marker."""
    return path.contains(INEDIBLE)


def prompt_gate(prompt: Column) -> Column:
    """Why a prompt isn't searched for; null if it is."""
    s = F.trim(prompt)
    low = F.lower(s)
    bare = F.trim(F.regexp_replace(s, r"[!-/:-@\[-`{-~]", ""))
    tag = F.lit(None).cast("string")
    for t in reversed(SYSTEM_TAGS):
        tag = F.when(s.startswith(t), f"system-tag:{t}").otherwise(tag)
    few = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != "")) <= 2
    return F.coalesce(tag, F.when(F.length(s) < MIN_PROMPT, "trivial:short").when(_any_of(low, ACKS, "is"), F.concat(F.lit("trivial:ack:"), low)).when(few, "trivial:token-count"))


def is_excluded(text: Column, patterns: Column) -> Column:
    """Whether the text has any of the patterns, case aside."""
    low = F.lower(text)
    return F.exists(patterns, lambda p: (p != "") & low.contains(F.lower(p)))


# ---- classes of sentences -----------------------------------------------------------------------------------------------------


def is_question(text: Column) -> Column:
    """Ends in a question mark and begins like a question, or is a single sentence on one line."""
    s = F.trim(F.lower(text))
    single = ~s.contains("\n") & ~F.regexp_replace(s, r"\?$", "").rlike(r"[.!?]['\")\]]*\s")
    return s.endswith("?") & (_any_of(s, QUESTION_PREFIXES, "starts") | single)


def is_hedged(text: Column) -> Column:
    s = F.trim(F.lower(text))
    return _any_of(s, LEADING_HEDGES, "starts") | _any_of(s, INNER_HEDGES, "in")


def correction_signals(text: Column) -> Column:
    """The signals of a correction, as an array of their names."""
    s = F.trim(F.lower(text))
    found = (
        ("imperative", s.rlike(edged(IMPERATIVE)) | s.rlike(edged(CORRECTION_ANCHOR)) | s.rlike(edged(REQUIREMENT_ANCHOR))),
        ("always_never", s.rlike(edged(words_pattern(ALWAYS_NEVER)))),
        ("negation", s.rlike(edged(words_pattern(NEGATIONS, apart=True)))),
        ("emphasis", s.rlike(edged(words_pattern(EMPHASIS)))),
        ("prior_ref", s.rlike(edged(words_pattern(PRIOR_REFERENCE)))),
        ("declarative", s.rlike(DECLARATIVE)),
    )
    return F.array_compact(F.array(*(F.when(hit, name) for name, hit in found)))


def is_correction(text: Column) -> Column:
    return F.size(correction_signals(text)) >= CORRECTION_SIGNALS


def correction_confidence(text: Column) -> Column:
    return F.least(F.lit(1.0), F.size(correction_signals(text)) * CONFIDENCE_A_SIGNAL)


def is_directive(text: Column) -> Column:
    """A rule: no question, no narration, no hedge, no task, and a verb that commands."""
    s = F.trim(text)
    verbs = "(?i)" + r"\b(?:" + "|".join(sorted(DIRECTIVE_VERBS, key=len, reverse=True)) + r")\b"
    return (s != "") & ~s.endswith("?") & ~s.rlike(edged(WH_QUESTION)) & ~s.rlike(edged(NARRATION)) & ~s.rlike(edged(HEDGE)) & ~s.rlike(edged(TASK_VERB)) & s.rlike(edged(verbs))


def sentence_class(text: Column) -> Column:
    """requirement, correction, preference or factual, in this order; ``persist`` is false for empty texts, questions and hedges."""
    low = F.trim(F.lower(text))
    stays = (low != "") & ~is_question(text)
    kind = F.when(~stays, "factual").when(low.rlike(edged(REQUIREMENT)), "requirement").when(is_correction(text), "correction").when(_any_of(low, PREFERENCE, "in"), "preference").otherwise("factual")
    return F.struct(kind.alias("type"), (stays & ((kind != "factual") | ~is_hedged(text))).alias("persist"))


def sentiment(text: Column) -> Column:
    """(``valence``, ``pattern``) of a short prompt: strong negatives first, then strong positives, negatives, positives; else null."""

    def first(patterns, only=None):
        out = F.lit(None).cast("string")
        for name, p in reversed([x for x in patterns if only is None or x[0] in only]):
            out = F.when(text.rlike("(?i)" + edged(p)), name).otherwise(out)
        return out

    found = None
    for patterns, only, valence in ((POSITIVE, None, BASE_VALENCE), (NEGATIVE, None, -BASE_VALENCE), (POSITIVE, STRONG_POSITIVE, STRONG_VALENCE), (NEGATIVE, STRONG_NEGATIVE, -STRONG_VALENCE)):
        name = first(patterns, only)
        here = F.when(name.isNotNull(), F.struct(F.lit(valence).alias("valence"), name.alias("pattern")))
        found = here if found is None else F.coalesce(here, found)
    return F.when((F.length(text) > 0) & (F.length(text) <= LONGEST_SENTIMENT), found)


def signals(text: Column) -> Column:
    """Negation, the first quantifier's place between -1 and 1 (null without one), and the words that carry content."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    axis = F.create_map(*(F.lit(x) for pair in QUANTIFIERS.items() for x in pair))
    quantified = F.filter(words, lambda w: w.isin(*QUANTIFIERS))
    dropped = (*STOPWORDS, *NEGATION_TOKENS, *QUANTIFIERS)
    return F.struct(
        (F.exists(words, lambda w: w.isin(*NEGATION_TOKENS)) | F.coalesce(text, F.lit("")).rlike(edged(CONTRACTION))).alias("negation"),
        F.try_element_at(axis, F.get(quantified, 0)).alias("axis"),
        F.filter(title_tokens(text), lambda w: ~w.isin(*dropped)).alias("residual"),
    )


def relation(a: Column, b: Column, overlap_floor: float = 0.4) -> Column:
    """How two sentences (as ``signals``) relate: unrelated below an overlap of their content, contradicts where negation or
    quantifiers disagree, else refines."""
    both, every = F.size(F.array_intersect(a["residual"], b["residual"])), F.size(F.array_union(a["residual"], b["residual"]))
    overlap = F.when(every > 0, both / every).otherwise(0.0)
    n = F.when(a["negation"] != b["negation"], 1.0).otherwise(0.0)
    q = F.coalesce(F.abs(a["axis"] - b["axis"]) / 2, F.lit(0.0))
    score = (n + q) / 2
    label = F.when(overlap < overlap_floor, "unrelated").when(score > 0, "contradicts").otherwise("refines")
    return F.struct(label.alias("label"), F.when(label == "contradicts", F.round(score, 3)).otherwise(0.0).alias("score"), F.round(overlap, 6).alias("overlap"))


# ---- slots, windows, references -------------------------------------------------------------------------------------------------


def numeric_slots(text: Column) -> Column:
    """(``key``, ``value``) of numbers that follow a word, but for words that say nothing."""
    keys, values = (F.regexp_extract_all(text, F.lit(edged(NUMERIC_AHEAD + NUMERIC)), F.lit(k)) for k in (1, 3))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(F.lower(p["k"]).alias("key"), p["v"].cast("double").alias("value")))
    return F.array_distinct(F.filter(pairs, lambda p: ~p["key"].isin(*NUMERIC_DROP)))


def enum_slots(text: Column) -> Column:
    """(``category``, ``group_id``) of known words of state. The longest of overlapping words counts: none begins before a longer one that it overlaps, so that
    one pass from the left, longest first, finds them."""
    members = {m: (c, sorted(g)[0]) for c, groups in ENUMS.items() for g in groups for m in g}
    words = "|".join(sorted(members, key=lambda m: (-len(m), m)))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), F.lit(1)))
    known = F.create_map(*(x for m, (c, g) in members.items() for x in (F.lit(m), F.struct(F.lit(c).alias("category"), F.lit(g).alias("group_id")))))
    return F.array_distinct(F.transform(found, lambda m: F.element_at(known, m)))


def slot(text: Column) -> Column:
    """(``subject``, ``predicate``, ``value``) of a sentence of the form "subject predicate value"; else null."""
    s = F.trim(text)
    made = F.struct(F.regexp_extract(s, SLOT, 1).alias("subject"), F.regexp_extract(s, SLOT, 3).alias("predicate"), F.trim(F.regexp_extract(s, SLOT, 5)).alias("value"))
    return F.when(s.rlike(SLOT), made)


def window_days(spec: Column) -> Column:
    """Days or months of a duration such as 30d, 2w, 3mo, 1y: (``days``, ``months``); null for ``forever`` and for what it can't read."""
    low = F.lower(F.trim(spec))
    n = F.regexp_extract(low, r"^(\d+)(d|w|mo|y)$", 1)
    unit = F.regexp_extract(low, r"^(\d+)(d|w|mo|y)$", 2)
    count = F.try_to_number(n, F.lit("999999")).cast("int")
    made = F.struct(
        F.when(unit == "d", count).when(unit == "w", count * 7).otherwise(0).alias("days"),
        F.when(unit == "mo", count).when(unit == "y", count * 12).otherwise(0).alias("months"),
    )
    return F.when((unit != "") & (count > 0), made)


def lock_until(start: Column, spec: Column) -> Column:
    """The time a lock taken at ``start`` (timestamp) runs out; months end on the last day where the day doesn't exist."""
    w = window_days(spec)
    day = F.date_add(F.add_months(start.cast("date"), w["months"]), w["days"])
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.unix_timestamp(start) - F.unix_timestamp(start.cast("date").cast("timestamp")))


def stated_window(text: Column) -> Column:
    """The duration that a text names ("for the next two weeks"), as 2w; else null."""
    count = r"(\d+|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
    unit = "(" + "|".join(UNIT_WORDS) + ")"
    p = edged(rf"(?i)\bfor\s+(?:the\s+)?(?:next\s+)?{count}\s+{unit}s?\b")
    bare = edged(rf"(?i)\bfor\s+the\s+next\s+{unit}\b")
    numbers = F.create_map(*(F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, str(v))))
    units = F.create_map(*(F.lit(x) for pair in UNIT_WORDS.items() for x in pair))
    n = F.lower(F.regexp_extract(text, p, 1))
    made = F.concat(F.coalesce(F.try_element_at(numbers, n), n), F.try_element_at(units, F.lower(F.regexp_extract(text, p, 2))))
    return F.when(text.rlike(p), made).when(text.rlike(bare), F.concat(F.lit("1"), F.try_element_at(units, F.lower(F.regexp_extract(text, bare, 1)))))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_referenced(belief: Column, response: Column) -> Column:
    """Whether a response holds a belief's text, which has eight characters at least."""
    b = normalised(belief)
    return (F.length(b) >= MIN_REFERENCE) & normalised(response).contains(b)
