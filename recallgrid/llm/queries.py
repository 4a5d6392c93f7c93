"""The queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup_exact, dedup_lines, dedup_near, dedup_substrings, ngram_lm, packing, periodic, sharding, topk, toxicity, turn_repair, video
from ._common import written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))  # made first, so that no text is shuffled
    docs = sharding.shard(_documents(spark, sf_dir).select("doc_id", "text", crc.alias("text_crc32")), 16)
    return docs.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    rows = dedup_exact.exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha")).alias("text_sha256"))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word vocabulary and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a video without loss and read again."""
    rows = video.read(video.store(_documents(spark, sf_dir).select("doc_id", "text")))
    return rows.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", lambda x: F.concat_ws(":", x["first_frame"], x["last_frame"], x["start_us"], x["end_us"], F.round(x["brightness"], 3))), " ").alias("feature"),
    )


def op4_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from the labelled rows that aren't held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held)
    rows = toxicity.score(_documents(spark, sf_dir).select("doc_id", "text"), labels)
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_monotone_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    rows = packing.pack(_documents(spark, sf_dir).select("doc_id", "text"), *PACKING)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The byte-level vocabulary as ranks, its pattern and its special token.
PACKING = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), 1)


def op7_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that stand elsewhere."""
    rows = dedup_substrings.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    kept_text = F.make_valid_utf8(F.col("kept_bytes").cast("string"))  # cuts can fall inside a character
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), kept_text.alias("kept_text"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates at a similarity of 0.85."""
    rows = dedup_near.near_classes(_documents(spark, sf_dir).select("doc_id", "text"), 85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of lines that stand elsewhere before."""
    rows = dedup_lines.line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without any run of two lines or more, or line of over 50 words, that stands elsewhere before."""
    rows = dedup_lines.line_runs(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability; learned from the documents that aren't held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = ngram_lm.train(docs.where(~held), singles=True)
    rows = ngram_lm.score(docs, model)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage by its numbers, its faults and its cheapest repair."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    segments = turn_repair.repair(_damaged(rows))
    reports = turn_repair.conversation_reports(segments).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(reports, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Turns after the damage that the contract states; nulls count as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("damage", F.crc32(key) % 20).where("damage <> 0")
    role = F.when(F.col("damage") == 4, "user").otherwise(role)
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def op12_threshold_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    vectors = written(topk.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "vectors")
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, after every tenth was made periodic from some word on."""
    rows = periodic.collapse_runs(_documents(spark, sf_dir).select("doc_id", _made_periodic().alias("text")))

    def better(best, r):
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast(periodic.RUN), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _made_periodic() -> Column:
    """The text of a tenth of the documents with words from the a-th on replaced by those a whole number of periods before."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def planted(x: Column) -> Column:
        def word(i: Column) -> Column:
            return F.get(x["words"], F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), word), " ")

    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # Each step stands in an array of one element, so that its value is made once.
    worded = F.filter(F.array(words), lambda w: F.size(w) > 0)  # a remainder by no words is an error
    with_n = F.transform(worded, lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n"), (g % F.size(w)).alias("a")))
    with_p = F.transform(with_n, lambda x: F.struct(x["words"].alias("words"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).alias("p")))
    some = F.get(F.transform(with_p, planted), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(some, F.lit(""))).otherwise(F.col("text"))


QUERIES = {
    "op1_minimax_shards": op1_minimax_shards,
    "op2_avi_motion_jpeg": op2_avi_motion_jpeg,
    "op3_chunk_recipes": op3_chunk_recipes,
    "op4_class_kneser_ney": op4_class_kneser_ney,
    "op5_word_bpe": op5_word_bpe,
    "op6_monotone_packing": op6_monotone_packing,
    "op7_suffix_sort": op7_suffix_sort,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_line_chunks": op9_line_chunks,
    "op9_line_runs": op9_line_runs,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_turn_repair": op11_turn_repair,
    "op12_threshold_top": op12_threshold_top,
    "op13_periodic_runs": op13_periodic_runs,
}

def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    rounds = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, [ascii(({text})[i])::BIGINT FOR i IN range(1, len({text}) + 1)]), lambda c, b: {rounds}), 4294967295)"


def _repair_sql() -> str:
    """The cheapest edits as a fold over each conversation's turns: for each grammar state the least text of cost and audit."""

    def more(key: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({key}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({key}, 7) || '{letter}')"

    def role(states: str, initial: str) -> str:
        keeps = ", ".join(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more(k, 'late', 'K')} END" for k in states.split())
        given = ", ".join(f"CASE WHEN NOT gone THEN {more(k, '2 + late', 'R')} END" for k in states.split())
        return keeps if initial == "s" else f"{keeps}, {given}"

    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        h AS (SELECT *, {_crc32_sql('k')} % 20 AS h FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
                     unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {spaces}) AS seen FROM d),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
        g AS (SELECT *, left(role, 1) AS initial, CASE WHEN seen = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM f),
        t AS (SELECT *, fault IS NOT NULL AND fault <> 'truncated' AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM g),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                     count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
        r AS (SELECT conv_id, 0::BIGINT AS i, '000000' AS k0, NULL::VARCHAR AS ks, '000002I' AS ku, '000004II' AS ka FROM n
              UNION ALL
              SELECT conv_id, i, k0, ks, ku2, least(ka1, {more('ku2', '2', 'I')}) FROM (
              SELECT *, least(ku1, {more('k0', '2', 'I')}, {more('ks', '2', 'I')}, {more('ka1', '2', 'I')}) AS ku2 FROM (
              SELECT r.conv_id, t.i, {more('k0', '3', 'D')} AS k0, least({more('ks', '3', 'D')}, {role('k0', 's')}) AS ks, least({more('ku', '3', 'D')}, {role('k0 ks ka', 'u')}) AS ku1, least({more('ka', '3', 'D')}, {role('ku', 'a')}) AS ka1
              FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i + 1))),
        e AS (SELECT r.conv_id, least(k0, ka) AS k FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.i),
        a AS (SELECT conv_id, substr(k, 7) AS audit, unnest(range(1, length(substr(k, 7)) + 1)) AS j FROM e),
        b AS (SELECT conv_id, j, audit[j] AS edit, sum(CASE WHEN audit[j] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM a),
        c AS (SELECT b.conv_id, b.j, b.edit, t.initial, t.role, coalesce(CASE WHEN b.edit <> 'I' THEN t.text END, '') AS text FROM b LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i WHERE b.edit <> 'D'),
        p AS (SELECT *, row_number() OVER w AS pos, first_value(edit = 'K' AND initial = 's') OVER w AS system FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        s AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (pos + CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM p GROUP BY conv_id)
        SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(substr(e.k, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(e.k, 7), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM v.conv_id"""


def _runs_sql() -> str:
    """Runs from all pairs of equal words that a lag of a fourth of the text or less parts."""
    return f"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
        h AS (SELECT doc_id, w, len(w) AS n, {_crc32_sql('k')} AS h FROM t),
        g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
        x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0 THEN [w[1 + CASE WHEN j < a THEN j ELSE a + (j - a) % p END] FOR j IN range(n)] ELSE w END) AS word FROM p),
        m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
        r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
        u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
        best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length * 1.0 / period DESC, start, period) = 1),
        l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
        kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id)
        SELECT d.doc_id, d.n AS n_words, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM h d LEFT JOIN best USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)"""


ORACLE_SQL = {
    "op11_turn_repair": _repair_sql(),
    "op12_threshold_top": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_periodic_runs": _runs_sql(),
    "op3_chunk_recipes": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op8_bbit_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
        x AS (SELECT doc_id, md5(unnest(s)) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON id = doc_id""",
    "op9_line_chunks": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        p AS (SELECT a.doc_id, a.i, a.line || chr(10) || b.line AS two FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE trim(a.line) <> '' OR trim(b.line) <> ''),
        r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY two ORDER BY doc_id, i) > 1),
        g AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r),
        k AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i)
        SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
}
