"""Temporal joins and summaries over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeweave.operators import aggregates as a
from timeweave.operators import joins as j
from timeweave.operators.joins import as_of
from timeweave.operators.selection import percentiles
from timeweave.operators.topics import build_topics
from timeweave.plans import evaluation as ev
from timeweave.plans.curation import anchors
from timeweave.queries.base import BLOCKS, EVENTS, FRAMES, JOBS, QUESTIONS, SEGMENTS, VECTORS, VIDEOS, Data, query
from timeweave.queries.filters import COLLECTIONS, collections
from timeweave.queries.windows import TOPICS, vector_chunks

#: Each tenth segment begins a stretch of ten, which stands for a parent passage here.
PARENTS = """parents AS (SELECT video_id, position // 10 AS parent_id, min(start_s) AS start_s, max(end_s) AS end_s FROM segments GROUP BY ALL)"""
#: Hits on the events' clock, and frames of eight seconds there.
HITS = EVENTS + ", hits AS (SELECT event_id AS hit_id, video_id, start_s, start_s + 6.0 AS end_s FROM tl WHERE type = 'click')"
SHOTS = ", shots AS (SELECT event_id AS frame_id, video_id, start_s, start_s + 8.0 AS end_s, start_s + 2.0 AS time_s FROM tl WHERE type <> 'click')"


def parents(data):
    return data.segments().groupBy("video_id", F.expr("position div 10").alias("parent_id")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def hits(data):
    return data.events().where("type = 'click'").select(F.col("event_id").alias("hit_id"), "video_id", "start_s", (F.col("start_s") + 6.0).alias("end_s"))


def shots(data):
    return data.events().where("type <> 'click'").select(F.col("event_id").alias("frame_id"), "video_id", "start_s", (F.col("start_s") + 8.0).alias("end_s"), (F.col("start_s") + 2.0).alias("time_s"))


@query(
    "j1_parent_expansion",
    f"""WITH {VIDEOS}, {SEGMENTS}, {PARENTS} SELECT s.video_id, s.position, v.title, p.start_s AS parent_start FROM segments s JOIN videos v USING (video_id)
    LEFT JOIN parents p ON p.video_id = s.video_id AND p.parent_id = CASE WHEN s.position % 4 <> 3 THEN s.position // 10 END""",
)
def j1(spark, folder):
    from timeweave.plans.search import hydrate

    data = Data(spark, folder)
    chunks = data.segments().withColumn("parent_id", F.when(F.col("position") % 4 != 3, F.expr("position div 10")))
    return hydrate(chunks, data.videos(), parents(data).select("video_id", "parent_id", F.col("start_s").alias("parent_start"))).select("video_id", "position", "title", "parent_start")


@query(
    "j2_locate_parent",
    f"""WITH {SEGMENTS}, {PARENTS}, m AS (SELECT video_id, position, (start_s + end_s) / 2 AS at FROM segments), p0 AS (SELECT video_id, min(parent_id) AS p FROM parents GROUP BY ALL)
    SELECT m.video_id, m.position, coalesce(p.parent_id, p0.p) AS parent_id FROM m ASOF LEFT JOIN parents p ON m.video_id = p.video_id AND m.at >= p.start_s JOIN p0 ON p0.video_id = m.video_id""",
)
def j2(spark, folder):
    data = Data(spark, folder)
    rows = data.segments().select("video_id", "position", "start_s", "end_s")
    return as_of(rows, parents(data), (F.col("start_s") + F.col("end_s")) / 2, right_id="parent_id", to="parent").select("video_id", "position", F.col("parent").alias("parent_id"))


@query(
    "j3_parent_at",
    f"""WITH {SEGMENTS}, {PARENTS}, f AS (SELECT event_id, user_id AS video_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 - 5 AS at FROM events), q AS (SELECT * FROM parents WHERE parent_id > 0)
    SELECT f.event_id, p.parent_id FROM f ASOF LEFT JOIN q p ON f.video_id = p.video_id AND f.at >= p.start_s""",
)
def j3(spark, folder):
    """As-of on the start, without a clamp: nothing before the first parent."""
    data = Data(spark, folder)
    frames = data.frames().select("event_id", "video_id", (F.col("time_s") - 5).alias("at"))
    return as_of(frames, parents(data).where("parent_id > 0"), F.col("at"), right_id="parent_id", clamp=False, to="parent").select("event_id", F.col("parent").alias("parent_id"))


@query(
    "j5_best_frame",
    f"""WITH {HITS}{SHOTS}, n AS (SELECT h.hit_id, s.frame_id, s.start_s, s.time_s, (h.start_s + h.end_s) / 2 AS mid, greatest(0.0, least(h.end_s, s.end_s) - greatest(h.start_s, s.start_s)) AS share
      FROM hits h JOIN shots s ON s.video_id = h.video_id AND s.end_s >= h.start_s - 5 AND s.start_s <= h.end_s + 5),
    r AS (SELECT hit_id, frame_id, row_number() OVER (PARTITION BY hit_id ORDER BY share DESC, CASE WHEN share > 0 THEN start_s ELSE abs(time_s - mid) END, start_s, frame_id) AS n FROM n)
    SELECT hit_id, frame_id FROM r WHERE n = 1""",
)
def j5(spark, folder):
    data = Data(spark, folder)
    return j.best_frame(hits(data), shots(data))


@query(
    "j6_nearby_events",
    f"""WITH {HITS}{SHOTS}, r AS (SELECT h.hit_id, s.frame_id AS event_id, row_number() OVER (PARTITION BY h.hit_id ORDER BY s.start_s, s.frame_id) AS place
      FROM hits h JOIN shots s ON s.video_id = h.video_id AND s.end_s >= h.start_s - 5 AND s.start_s <= h.end_s + 5) SELECT hit_id, CAST(place AS INTEGER) AS place, event_id FROM r WHERE place <= 5""",
)
def j6(spark, folder):
    data = Data(spark, folder)
    return j.nearby_events(hits(data), shots(data).withColumnRenamed("frame_id", "event_id"))


@query("j7_enclosing_topic", f"WITH {HITS}{SHOTS} SELECT h.hit_id, arg_min(s.frame_id, (s.start_s, s.frame_id)) AS topic_id FROM hits h JOIN shots s ON s.video_id = h.video_id AND s.start_s <= h.start_s AND s.end_s >= h.start_s GROUP BY h.hit_id")
def j7(spark, folder):
    data = Data(spark, folder)
    return j.enclosing_topic(hits(data), shots(data).withColumnRenamed("frame_id", "topic_id"))


@query("j8_frame_blocks", f"WITH {FRAMES}, {BLOCKS}, t AS (SELECT frame_id, string_agg(text, chr(10) ORDER BY y1, x1, n) AS text FROM blocks GROUP BY ALL) SELECT event_id, text FROM frames LEFT JOIN t ON frame_id = event_id")
def j8(spark, folder):
    data = Data(spark, folder)
    lines = data.screens().select(F.col("frame_id").alias("event_id"), F.array_join("blocks.text", "\n").alias("text"))
    return data.frames().join(lines, "event_id", "left").select("event_id", "text")


@query("j10_collection_scope", f"WITH {VIDEOS}, {SEGMENTS} SELECT video_id, position FROM segments WHERE video_id IN (SELECT video_id FROM videos WHERE collection_id = 3)")
def j10(spark, folder):
    data = Data(spark, folder)
    return data.segments().join(data.videos().where("collection_id = 3"), "video_id", "left_semi").select("video_id", "position")


@query("j11_gold_relevance", f"WITH {QUESTIONS} SELECT g.item_id, s.video_id, s.position FROM gold g JOIN segments s ON s.video_id = g.video_id AND s.start_s <= g.e AND s.end_s >= g.s")
def j11(spark, folder):
    data = Data(spark, folder)
    spans = data.questions().select("item_id", F.inline("gold_spans")).groupBy("item_id", "video_id").agg(F.collect_list(F.struct("s", "e")).alias("gold"))
    met = data.segments().join(spans, "video_id").where(j.touches_gold(F.col("gold"), F.col("start_s"), F.col("end_s")))
    return met.select("item_id", "video_id", "position")


@query("j12_anchor", f"WITH {QUESTIONS} SELECT i.item_id, min(g.s) AS anchor_s FROM items i LEFT JOIN gold g USING (item_id) GROUP BY i.item_id")
def j12(spark, folder):
    data = Data(spark, folder)
    asked = data.questions()
    anchors = asked.select("item_id", F.inline("gold_spans")).groupBy("item_id").agg(F.min("s").alias("anchor_s"))
    return asked.select("item_id").join(anchors, "item_id", "left")


@query("j12_source_chunk", f"WITH {SEGMENTS}, q AS (SELECT item_id, item_id * 1000 + item_id % 4 AS chunk FROM benchmark) SELECT item_id, s.start_s AS anchor_s FROM q LEFT JOIN segments s ON s.video_id * 1000 + s.position = q.chunk")
def j12_source(spark, folder):
    """Anchors of questions by the chunk that each was made of, where it is still there."""
    data = Data(spark, folder)
    asked = data.table("benchmark").select("item_id", (F.col("item_id") * 1000 + F.col("item_id") % 4).alias("source_chunk_id"))
    chunks = data.segments().select((F.col("video_id") * 1000 + F.col("position")).alias("chunk_id"), "start_s")
    return anchors(asked, chunks).select("item_id", "anchor_s")


@query(
    "j13_snap",
    f"""WITH {SEGMENTS}, {PARENTS}, pts AS (SELECT video_id * 1000 + position AS pid, video_id, start_s + 7 AS mid FROM segments),
    held AS (SELECT pid, arg_min(p.parent_id, (p.start_s, p.parent_id)) AS h FROM pts JOIN parents p ON p.video_id = pts.video_id AND p.start_s <= mid AND p.end_s >= mid GROUP BY pid),
    near AS (SELECT pid, arg_min(p.parent_id, (abs(p.start_s - mid), p.start_s)) AS n FROM pts JOIN parents p ON p.video_id = pts.video_id GROUP BY pid)
    SELECT pid, coalesce(h, n) AS parent_id FROM near LEFT JOIN held USING (pid)""",
)
def j13(spark, folder):
    data = Data(spark, folder)
    points = data.segments().select((F.col("video_id") * 1000 + F.col("position")).alias("pid"), "video_id", (F.col("start_s") + 7).alias("start_s"), (F.col("start_s") + 7).alias("end_s"))
    return j.snap(points, parents(data), "pid")


@query(
    "j14_check_gold",
    f"WITH {QUESTIONS}, {PARENTS} SELECT item_id AS question_id, g.video_id, round(s, 1) AS s, round(e, 1) AS e FROM gold g WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.video_id = g.video_id AND round(p.start_s, 1) = round(s, 1) AND round(p.end_s, 1) = round(e, 1))",
)
def j14(spark, folder):
    data = Data(spark, folder)
    asked = data.questions().select(F.col("item_id").alias("question_id"), F.inline("gold_spans"))
    each = asked.groupBy("question_id", "video_id").agg(F.collect_list(F.struct("s", "e")).alias("gold_spans"))
    return ev.unsnapped(each, parents(data))


@query("j15_sampling_join", f"WITH {SEGMENTS}, {PARENTS} SELECT s.video_id, s.position, p.start_s AS parent_start, p.end_s AS parent_end FROM segments s JOIN parents p ON p.video_id = s.video_id AND p.parent_id = s.position // 10")
def j15(spark, folder):
    data = Data(spark, folder)
    own = parents(data).select("video_id", "parent_id", F.col("start_s").alias("parent_start"), F.col("end_s").alias("parent_end"))
    return data.segments().withColumn("parent_id", F.expr("position div 10")).join(own, ["video_id", "parent_id"]).select("video_id", "position", "parent_start", "parent_end")


@query("j17_indexed_count", f"WITH {VIDEOS}, {VECTORS} SELECT count(DISTINCT v.video_id) AS indexed FROM videos v JOIN vectors c ON c.video_id = v.video_id")
def j17(spark, folder):
    data = Data(spark, folder)
    return data.videos().join(data.vectors().select("video_id").distinct(), "video_id").agg(F.countDistinct("video_id").alias("indexed"))


@query("j18_nearest_gold", f"WITH {QUESTIONS} SELECT item_id, arg_min(s, (abs(s - 100), s)) AS nearest FROM gold GROUP BY item_id")
def j18(spark, folder):
    asked = Data(spark, folder).questions().where(F.size("gold_spans") > 0)
    return asked.select("item_id", j.nearest_gold_start(F.col("gold_spans"), F.lit(100.0)).alias("nearest"))


@query("a1_index_stats", "WITH c AS (SELECT vec_id, vec_id // 50 AS video_id, CASE WHEN vec_id % 5 = 0 THEN 'parent' ELSE 'child' END AS level, CASE WHEN vec_id % 5 <> 0 THEN embedding END AS embedding FROM embeddings) SELECT level, count(*) AS chunks, count(embedding) AS embedded, count(DISTINCT video_id) AS videos, level = 'child' AND count(embedding) > 0 AS searchable FROM c GROUP BY level")
def a1(spark, folder):
    child = F.col("vec_id") % 5 != 0
    return a.index_stats(Data(spark, folder).vectors().withColumn("level", F.when(child, "child").otherwise("parent")).withColumn("embedding", F.when(child, F.col("embedding"))))


@query(
    "a2_collection_summary",
    f"""WITH {VIDEOS}, {VECTORS}, {COLLECTIONS}, f AS (SELECT collection_id FROM collections UNION ALL SELECT NULL), i AS (SELECT DISTINCT video_id FROM vectors)
    SELECT f.collection_id, count(v.video_id) AS video_count, round(coalesce(sum(v.duration_s), 0.0), 6) AS duration_s, count(i.video_id) AS indexed_count
    FROM f LEFT JOIN videos v ON v.collection_id IS NOT DISTINCT FROM f.collection_id LEFT JOIN i ON i.video_id = v.video_id GROUP BY f.collection_id""",
)
def a2(spark, folder):
    data = Data(spark, folder)
    return a.collection_summary(collections(data), data.videos(), data.vectors())


@query("a3_transcript_summary", f"WITH {SEGMENTS} SELECT video_id, count(*) AS segments, round(sum(end_s - start_s), 2) AS speech_s, arg_min('model ' || video_id % 3 || '.' || position, position) AS model FROM segments GROUP BY video_id")
def a3(spark, folder):
    model = F.format_string("model %d.%d", F.col("video_id") % 3, "position")
    return a.transcript_summary(Data(spark, folder).segments().withColumn("model", model))


@query("a4_block_metrics", f"WITH {FRAMES}, {BLOCKS} SELECT (SELECT count(*) FROM frames) AS frames, count(DISTINCT frame_id) AS frames_with_text, count(*) AS blocks, coalesce(round(avg(confidence), 3), 0.0) AS confidence FROM blocks")
def a4(spark, folder):
    data = Data(spark, folder)
    return a.block_metrics(data.frames(), data.blocks())


@query("a5_frame_metrics", f"WITH {FRAMES} SELECT video_id, count(*) AS extracted, round(count(*) / greatest(max(time_s) / 60, 1.0), 6) AS per_minute FROM frames GROUP BY video_id")
def a5(spark, folder):
    return a.frame_metrics(Data(spark, folder).frames())


@query(
    "a6_event_metrics",
    f"""WITH RECURSIVE {TOPICS}, {EVENTS}, t AS (SELECT video_id, CAST(greatest(count(*) - 1, 0) AS BIGINT) AS n FROM topics WHERE level = 'coarse' GROUP BY video_id),
    every AS (SELECT video_id, type, count(*) AS n FROM tl GROUP BY ALL UNION ALL SELECT video_id, 'topic_change', n FROM t WHERE n > 0) SELECT video_id, type, n, CAST(sum(n) OVER (PARTITION BY video_id) AS BIGINT) AS total FROM every""",
)
def a6(spark, folder):
    data = Data(spark, folder)
    return a.event_metrics(data.events(), build_topics(vector_chunks(data)).where("level = 'coarse'"))


@query("a7_job_progress", "SELECT l_orderkey AS seq, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE l_discount * 10 END), 6) AS progress FROM lineitem GROUP BY l_orderkey")
def a7(spark, folder):
    """Order lines as stages: returned ones were skipped."""
    stages = Data(spark, folder).table("lineitem").select(F.col("l_orderkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "skipped").otherwise("running").alias("status"), (F.col("l_discount") * 10).alias("progress"))
    return a.job_progress(stages)


@query("a12_percentile", f"WITH {EVENTS} SELECT type, round(quantile_cont(confidence, 0.95), 9) AS p95, round(quantile_cont(confidence, 0.5), 9) AS p50 FROM tl GROUP BY type")
def a12(spark, folder):
    found = percentiles(Data(spark, folder).events(), "type", "confidence", {"p95": 0.95, "p50": 0.5})
    return found.select("type", F.round("p95", 9).alias("p95"), F.round("p50", 9).alias("p50"))


@query("a15_refusal", "WITH s AS (SELECT o_orderstatus <> 'F' AS answerable, o_totalprice / 100000 - 2 AS score FROM orders) SELECT count(*) FILTER (WHERE answerable AND score < -1) AS false_refusals, count(*) FILTER (WHERE NOT answerable AND score >= -1) AS missed_refusals, min(score) FILTER (WHERE answerable) AS worst_positive, max(score) FILTER (WHERE NOT answerable) AS best_negative, list(score ORDER BY score) FILTER (WHERE answerable)[CAST(count(*) FILTER (WHERE answerable) // 2 AS BIGINT) + 1] AS median_positive FROM s")
def a15(spark, folder):
    scores = Data(spark, folder).table("orders").select((F.col("o_orderstatus") != "F").alias("answerable"), (F.col("o_totalprice") / 100000 - 2).alias("score"))
    return ev.refusal(scores, -1.0)


@query(
    "a17_timeline_slots",
    f"""WITH {EVENTS}, d AS (SELECT video_id, max(end_s) AS duration_s FROM tl GROUP BY ALL),
    r AS (SELECT t.video_id, greatest(0, least(239, floor(start_s / duration_s * 240)))::BIGINT AS slot, event_id, start_s,
      coalesce(list_position(['topic_change', 'text_appeared', 'silence', 'scene_change', 'slide_change'], CASE type WHEN 'click' THEN 'silence' WHEN 'view' THEN 'topic_change' ELSE type END) - 1, 5) AS rank FROM tl t JOIN d USING (video_id))
    SELECT video_id, slot, arg_min(event_id, (rank, start_s, event_id)) AS event_id FROM r GROUP BY video_id, slot""",
)
def a17(spark, folder):
    data = Data(spark, folder)
    kind = F.when(F.col("type") == "click", "silence").when(F.col("type") == "view", "topic_change").otherwise(F.col("type"))
    lengths = data.events().groupBy("video_id").agg(F.max("end_s").alias("duration_s"))
    return a.timeline_slots(data.events().withColumn("type", kind), lengths)


@query("a18_library_totals", f"WITH {VIDEOS} SELECT round(sum(duration_s) / 3600, 6) AS hours, count(*) FILTER (WHERE video_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS ready FROM videos")
def a18(spark, folder):
    """Videos of toxic documents are not ready."""
    data = Data(spark, folder)
    held = data.table("labels").where("toxic = 1").select(F.col("doc_id").alias("video_id")).distinct().withColumn("held", F.lit("processing"))
    return a.library_totals(data.videos().join(held, "video_id", "left").withColumn("status", F.coalesce("held", F.lit("ready"))))


@query(
    "a19_chronology",
    """WITH h AS (SELECT l_orderkey % 50 AS query_id, l_partkey % 40 AS video_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_extendedprice AS start_s, l_quantity / 10 AS score,
      row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY start_s, rank) AS place, count(*) OVER (PARTITION BY query_id, video_id) AS total FROM h WHERE score >= 2.0),
    e AS (SELECT *, max(coalesce(score, 0.0)) OVER (PARTITION BY query_id, video_id) AS best, min(rank) OVER (PARTITION BY query_id, video_id) AS fr FROM k WHERE place <= 8)
    SELECT query_id, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, fr, video_id) AS INTEGER) AS track, video_id, CAST(place AS INTEGER) AS place, chunk_id, start_s, total, best FROM e""",
)
def a19(spark, folder):
    """Order lines as ranked hits of fifty concepts."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    lines = Data(spark, folder).table("lineitem").withColumn("query_id", F.col("l_orderkey") % 50)
    found = lines.select("query_id", (F.col("l_partkey") % 40).alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_extendedprice").alias("start_s"), (F.col("l_quantity") / 10).alias("score"), rank.alias("rank"))
    return a.chronology(found)
