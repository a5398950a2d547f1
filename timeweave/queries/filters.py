"""Filters, joins with time, and summaries over whole tables."""

from pyspark.sql import functions as F

from timeweave.functions import text as X
from timeweave.operators import filters as f
from timeweave.queries.base import BLOCKS, EVENTS, FRAMES, SEGMENTS, SPOKEN, VIDEOS, Data, query

MARKS = "[" + "".join("\\" + c for c in X.CODE_MARKS).replace("'", "''") + "]"
INDEXABLE = f"(length(trim(text, ' \t\n\r\f\v')) >= 3 AND (contains(trim(text, ' \t\n\r\f\v'), ' ') OR length(trim(text, ' \t\n\r\f\v')) <= 24 OR regexp_matches(trim(text, ' \t\n\r\f\v'), '{MARKS}')))"
COLLECTIONS = "collections AS (SELECT CAST(unnest(range(1, 10)) AS BIGINT) AS collection_id)"
#: A query for each customer: a video, a collection, or neither.
SCOPES = """asked AS (
  SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS video_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 12 END AS collection_id FROM customer)"""


def asked(data: Data):
    key = F.col("c_custkey")
    return data.table("customer").select(key.alias("query_id"), F.when(key % 3 == 0, key).alias("video_id"), F.when(key % 2 == 0, key % 12).alias("collection_id"))


def collections(data: Data):
    return data.spark.range(1, 10).withColumnRenamed("id", "collection_id")


@query("f1_filters", f"WITH {SEGMENTS} SELECT video_id, position, start_s FROM segments WHERE video_id IN (1, 2, 3, 5, 8, 13) AND end_s >= 30 AND start_s <= 90")
def f1(spark, folder):
    return f.apply_filters(Data(spark, folder).segments(), video_ids=[1, 2, 3, 5, 8, 13], window=(30.0, 90.0)).select("video_id", "position", "start_s")


@query("f1_empty_scope", f"WITH {SEGMENTS} SELECT video_id, position FROM segments WHERE false")
def f1_empty(spark, folder):
    return f.apply_filters(Data(spark, folder).segments(), video_ids=[]).select("video_id", "position")


@query(
    "f2_resolve_scope",
    f"""WITH {VIDEOS}, {COLLECTIONS}, {SCOPES}, m AS (SELECT collection_id, list(video_id ORDER BY video_id) AS members FROM videos WHERE collection_id IS NOT NULL GROUP BY ALL)
    SELECT query_id, a.video_id IS NOT NULL OR a.collection_id IS NOT NULL AS is_scoped,
      CAST(CASE WHEN a.video_id IS NOT NULL THEN 1 WHEN a.collection_id IS NOT NULL THEN coalesce(len(members), 0) END AS INTEGER) AS n_videos,
      a.collection_id IS NULL OR a.video_id IS NOT NULL OR c.collection_id IS NOT NULL AS is_known
    FROM asked a LEFT JOIN m ON m.collection_id = a.collection_id LEFT JOIN collections c ON c.collection_id = a.collection_id""",
)
def f2(spark, folder):
    data = Data(spark, folder)
    return f.resolve_scope(asked(data), collections(data), data.videos()).select("query_id", "is_scoped", F.when(F.col("video_ids").isNotNull(), F.size("video_ids")).alias("n_videos"), "is_known")


@query(
    "f3_parse_kinds",
    """WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'transcript, ocr' WHEN 1 THEN ',' WHEN 2 THEN ' event ,x' ELSE 'caption' END AS k FROM orders),
    p AS (SELECT o_orderkey, list_filter(list_transform(string_split(k, ','), lambda x: trim(x, ' \t\n\r\f\v')), lambda x: x <> '') AS kinds FROM l)
    SELECT o_orderkey, array_to_string(kinds, '|') AS kinds, array_to_string(list_filter(kinds, lambda x: x NOT IN ('transcript', 'ocr', 'caption', 'event')), '|') AS unknown FROM p""",
)
def f3(spark, folder):
    key = F.col("o_orderkey")
    listed = F.when(key % 4 == 0, "transcript, ocr").when(key % 4 == 1, ",").when(key % 4 == 2, " event ,x").otherwise("caption")
    kinds, unknown = f.parse_kinds(listed)
    return Data(spark, folder).table("orders").select("o_orderkey", F.array_join(kinds, "|").alias("kinds"), F.array_join(unknown, "|").alias("unknown"))


@query("f4_time_window", f"WITH {SEGMENTS} SELECT video_id, position FROM segments WHERE end_s >= 120")
def f4(spark, folder):
    return f.apply_filters(Data(spark, folder).segments(), window=(120.0, None)).select("video_id", "position")


@query("f5_search_transcripts", f"WITH {SEGMENTS}, hits AS (SELECT *, count(*) OVER () AS total FROM segments WHERE text ILIKE '%the_and%') SELECT video_id, position, start_s, total FROM hits ORDER BY video_id, start_s, position LIMIT 200")
def f5(spark, folder):
    rows, total = f.search_transcripts(Data(spark, folder).segments(), "the_and")
    return rows.select("video_id", "position", "start_s").join(total)  # one row


@query("f6_title_filter", f"WITH {VIDEOS} SELECT video_id, title FROM videos WHERE title ILIKE '%src1_-%'")
def f6(spark, folder):
    return f.title_filter(Data(spark, folder).videos(), "SRC1_-").select("video_id", "title")


@query("f7_list_events", f"WITH {EVENTS}, first AS (SELECT * FROM tl WHERE confidence >= 0.5 AND type IN ('click', 'view', 'purchase') ORDER BY start_s, event_id LIMIT 500) SELECT type, count(*) AS n FROM first GROUP BY type")
def f7(spark, folder):
    return f.list_events(Data(spark, folder).events(), ["click", "view", "purchase"], 0.5, 500).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "f8_frames_with_text",
    f"""WITH {BLOCKS}, {FRAMES}, own AS (SELECT event_id, time_s, count(*) OVER () AS total, row_number() OVER (ORDER BY time_s, event_id) AS place FROM frames
      WHERE event_id IN (SELECT frame_id FROM blocks WHERE confidence >= 0.8)) SELECT event_id, time_s, total FROM own WHERE place > 20 AND place <= 70""",
)
def f8(spark, folder):
    """The second page of frames that have text: the semi-join comes before paging."""
    data = Data(spark, folder)
    found = data.frames().join(data.blocks().where("confidence >= 0.8").select(F.col("frame_id").alias("event_id")), "event_id", "left_semi")
    return found.orderBy("time_s", "event_id").offset(20).limit(50).select("event_id", "time_s").join(found.agg(F.count("*").alias("total")))


@query("f9_block_gate", f"WITH {BLOCKS} SELECT frame_id, n FROM blocks WHERE confidence >= 0.60 AND length(trim(text, ' \t\n\r\f\v')) >= 3")
def f9(spark, folder):
    return f.block_gate(Data(spark, folder).blocks()).select("frame_id", "n")


@query("f10_is_indexable", f"WITH {BLOCKS} SELECT frame_id, n, {INDEXABLE} AS indexable FROM blocks")
def f10(spark, folder):
    return Data(spark, folder).blocks().select("frame_id", "n", X.is_indexable(F.col("text")).alias("indexable"))


@query(
    "f11_drop_repeats",
    f"""WITH {SEGMENTS}, norms AS (SELECT video_id, position, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM segments),
    lagged AS (SELECT *, lag(norm) OVER (PARTITION BY video_id ORDER BY position) AS before FROM norms)
    SELECT video_id, position FROM lagged WHERE norm = '' OR before IS NULL OR norm <> before""",
)
def f11(spark, folder):
    return f.drop_repeats(Data(spark, folder).segments()).select("video_id", "position")


@query("f12_searchable", "SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 AND embedding IS NOT NULL")
def f12(spark, folder):
    data = Data(spark, folder)
    chunks = data.vectors().withColumn("level", F.when(F.col("vec_id") % 5 == 0, "parent").otherwise("child"))
    return f.searchable(chunks).select("vec_id")


@query(
    "f13_scorable",
    "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'scorable' WHEN quality = 1 THEN 'negative' ELSE 'unverified' END AS use FROM labels",
)
def f13(spark, folder):
    """Verified questions with spans score, verified ones without are negatives."""
    from timeweave.plans.evaluation import use_of

    asked_ = Data(spark, folder).table("labels").select("doc_id", (F.col("quality") == 1).alias("verified"), F.when(F.col("toxic") == 0, F.array(F.lit(1))).otherwise(F.array()).alias("gold_spans"))
    return asked_.select("doc_id", use_of(F.col("verified"), F.col("gold_spans")).alias("use"))


@query(
    "f14_sampling_gate",
    f"""WITH {VIDEOS}, {SEGMENTS} SELECT s.video_id, s.position FROM segments s JOIN videos v USING (video_id)
    WHERE v.duration_s > 60 AND len(list_filter(string_split(s.text, ' '), lambda x: x <> '')) >= 25 AND s.video_id NOT IN (SELECT doc_id FROM labels)""",
)
def f14(spark, folder):
    from timeweave.plans.evaluation import sampling_gate

    data = Data(spark, folder)
    return sampling_gate(data.segments(), data.videos(), data.table("labels").select(F.col("doc_id").alias("video_id")), "video_id").select("video_id", "position")


@query(
    "f15_frame_texts",
    f"""WITH {BLOCKS}, good AS (SELECT * FROM blocks WHERE confidence >= 0.60 AND length(trim(text, ' \t\n\r\f\v')) >= 3 AND {INDEXABLE}),
    joined AS (SELECT frame_id, string_agg(trim(text, ' \t\n\r\f\v'), chr(10) ORDER BY y1, x1, n) AS text FROM good GROUP BY frame_id) SELECT * FROM joined WHERE length(text) >= 8""",
)
def f15(spark, folder):
    return f.screen_texts(Data(spark, folder).screens())
