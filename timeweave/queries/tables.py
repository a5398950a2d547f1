"""The derived tables themselves."""

from timeweave.queries import base
from timeweave.queries.base import Data, query


@query("src1_videos", f"WITH {base.VIDEOS} SELECT * FROM videos")
def videos(spark, folder):
    return Data(spark, folder).videos()


@query("src1_segments", f"WITH {base.SEGMENTS} SELECT * FROM segments")
def segments(spark, folder):
    return Data(spark, folder).segments()


@query("src1_frames", f"WITH {base.FRAMES} SELECT * FROM frames")
def frames(spark, folder):
    return Data(spark, folder).frames()


@query("src1_blocks", f"WITH {base.BLOCKS} SELECT * FROM blocks")
def blocks(spark, folder):
    return Data(spark, folder).blocks()


@query("src1_spoken", f"WITH {base.SPOKEN} SELECT * FROM spoken")
def spoken(spark, folder):
    return Data(spark, folder).spoken()


@query("src1_timeline_events", f"WITH {base.EVENTS} SELECT * FROM tl")
def events(spark, folder):
    return Data(spark, folder).events()


@query("src1_gold_spans", f"WITH {base.QUESTIONS} SELECT item_id, video_id, s, e FROM gold")
def gold(spark, folder):
    from pyspark.sql import functions as F

    return Data(spark, folder).questions().select("item_id", F.inline("gold_spans")).select("item_id", "video_id", "s", "e")
