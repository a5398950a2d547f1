"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from timeweave.functions import bits, metrics, text, time, vectors
from timeweave.queries.base import BLOCKS, FRAMES, SEGMENTS, SPOKEN, VECTORS, VIDEOS, Data, query

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
WORDS_SQL = "len(list_filter(regexp_split_to_array(trim(text, ' \t\n\r\f\v'), '\\s+'), lambda x: x <> ''))"


@query("x1_estimate_tokens", f"WITH {SEGMENTS} SELECT video_id, position, CAST(greatest(1, floor({WORDS_SQL} / 0.75)) AS BIGINT) AS tokens FROM segments")
def x1(spark, folder):
    return Data(spark, folder).segments().select("video_id", "position", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("x2_ends_sentence", f"""WITH {SEGMENTS} SELECT video_id, position, regexp_matches(trim(text, ' \t\n\r\f\v'), '[.!?][''")\\]]*$') AS ends FROM segments""")
def x2(spark, folder):
    return Data(spark, folder).segments().select("video_id", "position", text.ends_sentence(F.col("text")).alias("ends"))


@query(
    "x3_topic_words",
    f"""WITH {SEGMENTS}, found AS (SELECT video_id, position, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9''+#-]{{1,}}')) AS word FROM segments)
    SELECT video_id, position, word, count(*) AS n FROM found WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY ALL""",
)
def x3(spark, folder):
    each = Data(spark, folder).segments().groupBy("video_id", "position").agg(F.collect_list("text").alias("texts"))
    return text.counted(each.select("video_id", "position", F.flatten(F.transform("texts", text.topic_words)).alias("words")), "words")


@query("x4_titlecase", f"WITH {BLOCKS} SELECT frame_id, n, CASE WHEN text[1] = 'ß' THEN 'SS' ELSE upper(text[1]) END || text[2:] AS title FROM blocks WHERE text <> ''")
def x4(spark, folder):
    return Data(spark, folder).blocks().where("text <> ''").select("frame_id", "n", text.capitalise(F.col("text")).alias("title"))


@query("x5_norm", f"WITH {SEGMENTS} SELECT video_id, position, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM segments")
def x5(spark, folder):
    return Data(spark, folder).segments().select("video_id", "position", text.normalise(F.col("text")).alias("norm"))


@query("x6_hamming", f"WITH {FRAMES}, p AS (SELECT *, lag(phash) OVER (PARTITION BY video_id ORDER BY time_s, phash, event_id) AS before FROM frames) SELECT event_id, CAST(bit_count(xor(phash, before)) AS INTEGER) AS distance FROM p WHERE before IS NOT NULL")
def x6(spark, folder):
    from pyspark.sql import Window

    before = F.lag("phash").over(Window.partitionBy("video_id").orderBy("time_s", "phash", "event_id"))
    return Data(spark, folder).frames().withColumn("before", before).where("before is not null").select("event_id", bits.hamming(F.col("phash"), F.col("before")).alias("distance"))


@query(
    "x7_dhash",
    """WITH t AS (SELECT doc_id, unnest(range(length(text) // 72)) AS n, text FROM documents), p AS (SELECT doc_id, n, list_transform(range(72), lambda i: ord(text[n * 72 + i + 1])) AS g FROM t),
    b AS (SELECT doc_id, n, array_to_string(list_transform(range(64), lambda i: CASE WHEN g[i // 8 * 9 + i % 8 + 2] > g[i // 8 * 9 + i % 8 + 1] THEN '1' ELSE '0' END), '') AS bits FROM p)
    SELECT doc_id, n, array_to_string(list_transform(range(16), lambda i: '0123456789abcdef'[8 * (bits[4 * i + 1] = '1')::INTEGER + 4 * (bits[4 * i + 2] = '1')::INTEGER + 2 * (bits[4 * i + 3] = '1')::INTEGER + (bits[4 * i + 4] = '1')::INTEGER + 1]), '') AS phash FROM b""",
)
def x7(spark, folder):
    """Grey values from the characters of each document's text, 72 a picture."""
    whole = lambda c, pattern: F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0))
    own = Data(spark, folder).table("documents").select("doc_id", F.posexplode(whole("text", "(?s).{72}")).alias("n", "part")).withColumn("n", F.col("n").cast("long"))
    pixels = F.transform(whole("part", "(?s)."), F.ascii)
    return own.select("doc_id", "n", bits.hex16(bits.dhash(pixels)).alias("phash"))


@query("x8_phash_hex", f"WITH {FRAMES} SELECT event_id, lpad(lower(to_hex(phash)), 16, '0') AS hex FROM frames")
def x8(spark, folder):
    return Data(spark, folder).frames().select("event_id", bits.hex16(F.col("phash")).alias("hex"))


@query("x9_overlap", f"WITH {VECTORS} SELECT vec_id, CAST(greatest(0.0, least(end_s, 100.0) - greatest(start_s, 50.0)) AS DOUBLE) AS seconds FROM vectors")
def x9(spark, folder):
    return Data(spark, folder).vectors().select("vec_id", time.overlap(F.col("start_s"), F.col("end_s"), F.lit(50.0), F.lit(100.0)).alias("seconds"))


CLOCK = "lpad(CAST({0} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({0} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '{1}' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query("x10_clock", f"WITH {SEGMENTS}, ms AS (SELECT video_id, position, CAST(round(start_s * 1000) AS BIGINT) AS t FROM segments) SELECT video_id, position, {CLOCK.format('t', ',')} AS srt, {CLOCK.format('t', '.')} AS vtt FROM ms")
def x10(spark, folder):
    return Data(spark, folder).segments().select("video_id", "position", time.clock(F.col("start_s"), ",").alias("srt"), time.clock(F.col("start_s"), ".").alias("vtt"))


@query(
    "x11_caption",
    "WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' \t\n\r\f\v')), lambda x: x <> ''), chr(10)) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN '…' ELSE t END AS caption FROM c",
)
def x11(spark, folder):
    return Data(spark, folder).table("documents").select("doc_id", text.caption(F.col("text")).alias("caption"))


@query(
    "x12_safe_filename",
    """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, trim(left(regexp_replace(t, '^[ .]+|[ .]+$', '', 'g'), 80), ' ') AS t FROM a)
    SELECT page_id, CASE WHEN t = '' THEN 'transcript' ELSE t END || '.srt' AS name FROM b""",
)
def x12(spark, folder):
    return Data(spark, folder).table("pages").select("page_id", text.safe_filename(F.col("url"), "srt").alias("name"))


@query("x13_split_sentences")
def x13(spark, folder):
    return Data(spark, folder).table("documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("n", "sentence"))


@query("x14_looks_like_timestamp", "SELECT doc_id, regexp_matches(text, '\\b\\d{1,2}:\\d{2}(:\\d{2})?\\b') OR regexp_matches(text, '(?i)\\bat\\s+\\d+\\s*(seconds?|minutes?|hours?)\\b') AS stamped FROM documents")
def x14(spark, folder):
    return Data(spark, folder).table("documents").select("doc_id", text.looks_like_timestamp(F.col("text")).alias("stamped"))


@query("x17_clean", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def x17(spark, folder):
    return Data(spark, folder).table("documents").select("doc_id", text.collapse(F.col("text")).alias("clean"))


@query(
    "x19_format_stamp",
    f"""WITH {SEGMENTS}, w AS (SELECT video_id, position, CAST(floor(start_s) AS BIGINT) AS t FROM segments)
    SELECT video_id, position, CASE WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || ':' || lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0')
      ELSE lpad(CAST(t // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END AS stamp FROM w""",
)
def x19(spark, folder):
    return Data(spark, folder).segments().select("video_id", "position", time.stamp(F.col("start_s")).alias("stamp"))


@query("x20_parse_stamp", f"WITH {SEGMENTS} SELECT video_id, position, floor(start_s) AS seconds FROM segments")
def x20(spark, folder):
    """Parses what x19 formats."""
    return Data(spark, folder).segments().select("video_id", "position", time.parse_stamp(time.stamp(F.col("start_s"))).alias("seconds"))


@query("x23_storage_key", f"WITH {VIDEOS} SELECT video_id, 'videos/' || left(CAST(video_id AS VARCHAR), 2) || '/' || video_id || '/source.mp4' AS key, 'video/mp4' AS content_type FROM videos")
def x23(spark, folder):
    name = F.concat("title", F.lit(".MP4"))
    return Data(spark, folder).videos().select("video_id", text.storage_key(F.col("video_id"), name).alias("key"), text.content_type(name).alias("content_type"))


@query("x25_axis_box", f"WITH {BLOCKS} SELECT frame_id, CAST(min(x1) AS INTEGER) AS x1, CAST(min(y1) AS INTEGER) AS y1, CAST(max(x1) AS INTEGER) AS x2, CAST(max(y1) AS INTEGER) AS y2 FROM blocks GROUP BY frame_id")
def x25(spark, folder):
    points = Data(spark, folder).blocks().groupBy("frame_id").agg(F.collect_list(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("p"))
    return points.select("frame_id", bits.axis_box(F.col("p")).alias("box")).select("frame_id", "box.*")


@query(
    "x26_metrics",
    """WITH r AS (SELECT conv_id, list(length(text) % 3 = 0 ORDER BY turn) AS rel FROM conversations GROUP BY conv_id),
    h AS (SELECT conv_id, rel, list_filter(list_transform(range(len(rel)), lambda i: CASE WHEN rel[i + 1] THEN i + 1 END), lambda x: x IS NOT NULL) AS hits FROM r),
    m AS (SELECT *, coalesce(list_sum(list_transform(list_filter(hits, lambda x: x <= 5), lambda x: 1.0 / log2(x + 1))), 0.0) AS gain,
      coalesce(list_sum(list_transform(range(least(len(hits), 5)), lambda i: 1.0 / log2(i + 2))), 0.0) AS ideal FROM h)
    SELECT conv_id, CAST(hits[1] AS BIGINT) AS first_rank, CASE WHEN len(list_filter(hits, lambda x: x <= 5)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall,
      len(list_filter(hits, lambda x: x <= 5)) / least(len(rel), 5)::DOUBLE AS precision, coalesce(1.0::DOUBLE / hits[1], 0.0::DOUBLE) AS mrr,
      coalesce(list_sum(list_transform(range(len(hits)), lambda i: (i + 1)::DOUBLE / hits[i + 1])) / len(hits), 0.0::DOUBLE) AS ap,
      CASE WHEN ideal = 0 THEN 0.0::DOUBLE ELSE gain / ideal END AS ndcg FROM m""",
)
def x26(spark, folder):
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 3 == 0).alias("rel")))), lambda x: x["rel"])
    rel = Data(spark, folder).table("conversations").groupBy("conv_id").agg(ranked.alias("rel"))
    r = F.col("rel")
    return rel.select(
        "conv_id", metrics.first_rank(r).alias("first_rank"), metrics.recall(r, 5).alias("recall"), metrics.precision(r, 5).alias("precision"), metrics.reciprocal_rank(r).alias("mrr"),
        metrics.average_precision(r).alias("ap"), metrics.ndcg(r, 5).alias("ndcg"),
    )


@query(
    "x28_unit_cosine",
    f"""WITH {VECTORS}, d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, lead(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY video_id ORDER BY position) AS w FROM vectors)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
      round(list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * w[i + 1])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x)))), 6) AS cosine FROM d""",
)
def x28(spark, folder):
    from pyspark.sql import Window

    after = F.lead("embedding").over(Window.partitionBy("video_id").orderBy("position"))
    rows = Data(spark, folder).vectors().withColumn("after", after)
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.cosine(F.col("embedding"), F.col("after")), 6).alias("cosine"))


@query("x29_trim_or_reject", f"WITH {SPOKEN} SELECT video_id, position, nullif(trim(text, ' \t\n\r\f\v'), '') AS title FROM spoken WHERE trim(text, ' \t\n\r\f\v') <> ''")
def x29(spark, folder):
    title = text.required(F.col("text"))
    return Data(spark, folder).spoken().select("video_id", "position", title.alias("title")).where("title is not null")
