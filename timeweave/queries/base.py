"""Registry of the engine's queries, and the SQL of the derived tables that oracles read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeweave.functions import stemmer as st
from timeweave.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Data:
    """The tables of a folder, derived on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return t.read_table(self.spark, self.folder, name)

    def videos(self) -> DataFrame:
        return t.videos(self.table("documents"))

    def segments(self) -> DataFrame:
        return t.segments(self.table("documents"))

    def spoken(self) -> DataFrame:
        return t.spoken(self.table("conversations"))

    def vectors(self) -> DataFrame:
        return t.vectors(self.table("embeddings"))

    def frames(self) -> DataFrame:
        return t.frames(self.table("events"))

    def events(self) -> DataFrame:
        return t.timeline_events(self.table("events"))

    def blocks(self) -> DataFrame:
        return t.blocks(self.table("documents"))

    def screens(self) -> DataFrame:
        return t.screens(self.table("documents"))

    def questions(self) -> DataFrame:
        return t.questions(self.table("documents"), self.table("benchmark"))

    def jobs(self) -> DataFrame:
        return t.jobs(self.table("orders"))


#: Derived tables in SQL, as they stand in a WITH clause.
VIDEOS = """videos AS (
  SELECT doc_id AS video_id, source || '-' || doc_id AS title, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 7 END AS collection_id,
    length(text) / 15.0 AS duration_s FROM documents)"""
PIECES = """split AS (SELECT doc_id AS video_id, string_split(replace(text, chr(10), ' '), '. ') AS parts FROM documents),
listed AS (SELECT video_id, unnest(range(len(parts))) AS position, unnest(parts) AS text FROM split),
pieces AS (
  SELECT video_id, position, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY video_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0
  FROM listed)"""
SEGMENTS = (
    PIECES
    + """,
timed AS (SELECT video_id, position, text, CAST(c0 AS DOUBLE) / 15.0 + 25.0 * floor(position / 9.0) AS start_s FROM pieces),
segments AS (
  SELECT video_id, CAST(position AS BIGINT) AS position, start_s, start_s + CAST(length(text) AS DOUBLE) / 15.0 AS end_s, text FROM timed WHERE trim(text, ' \t\n\r\f\v') <> '')"""
)
SPOKEN = """turns AS (
  SELECT conv_id, turn, role, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 15.0 AS start_s
  FROM conversations),
spoken AS (SELECT conv_id AS video_id, turn AS position, start_s, start_s + CAST(length(text) AS DOUBLE) / 15.0 AS end_s, text, role AS speaker_id FROM turns)"""
VECTORS = """vectors AS (
  SELECT vec_id // 50 AS video_id, vec_id % 50 AS position, 15.0 * (vec_id % 50) AS start_s, 15.0 * (vec_id % 50) + 15.0 AS end_s, embedding, vec_id FROM embeddings)"""
FRAMES = """frames AS (
  SELECT user_id AS video_id, event_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS time_s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS phash FROM events)"""
EVENTS = """tl AS (
  SELECT event_id, user_id AS video_id, event_type AS type, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS start_s,
    (epoch_us(ts) - 1704067200000000) / 3.6e9 + 5.0 AS end_s, least(value / 490, 1.0) AS confidence FROM events)"""
BLOCKS = """words AS (SELECT doc_id AS frame_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents),
numbered AS (SELECT frame_id, unnest(range(len(w))) AS n, unnest(w) AS text FROM words),
blocks AS (
  SELECT frame_id, CAST(n AS INTEGER) AS n, text, 0.5 + CAST(length(text) % 5 AS DOUBLE) / 10.0 AS confidence, CAST(n % 10 AS INTEGER) AS x1, CAST(n // 10 AS INTEGER) AS y1 FROM numbered)"""
QUESTIONS = (
    SEGMENTS
    + """,
items AS (SELECT item_id, text AS item, text AS question FROM benchmark),
held AS (SELECT item_id, doc_id, instr(text, item) - 1 AS at, length(item) AS size FROM documents JOIN items ON contains(text, item)),
gold AS (
  SELECT h.item_id, p.video_id, min(s.start_s) AS s, max(s.end_s) AS e FROM held h JOIN pieces p ON p.video_id = h.doc_id
  JOIN segments s ON s.video_id = p.video_id AND s.position = p.position
  WHERE p.c0 < h.at + h.size AND p.c0 + length(p.text) > h.at GROUP BY ALL)"""
)
#: Stems of the words of ``raw (chunk_id, position, word)`` as ``post (chunk_id, position, term)``.
def _cases(word: str, rules: dict[str, str], region: str, conditions: dict[str, str] | None = None) -> str:
    """A CASE that finds the longest ending of ``word`` and replaces it where it lies in ``region``."""
    cases = []
    for end in sorted(rules, key=len, reverse=True):
        left = f"left({word}, length({word}) - {len(end)})"
        more = f" AND {conditions[end].format(left=left)}" if end in (conditions or {}) else ""
        cases.append(f"WHEN right({word}, {len(end)}) = '{end}' THEN CASE WHEN length({word}) - {len(end)} >= {region}{more} THEN {left} || '{rules[end]}' ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


_SHORT = "regexp_matches({0}, '(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
_SPECIAL = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in st.SPECIAL.items()) + " END"
#: The English stemmer in SQL, over the words of ``raw``: regions as lengths, each step a table.
STEMS = f"""t0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT word AS w FROM raw)),
t1 AS (SELECT w, x, CASE WHEN regexp_matches(x, '^({"|".join(st.EARLY_R1)})') THEN length(regexp_extract(x, '^({"|".join(st.EARLY_R1)})')) WHEN regexp_matches(x, '[aeiouy][^aeiouy]') THEN length(regexp_extract(x, '^.*?[aeiouy][^aeiouy]')) ELSE length(x) END AS r1 FROM t0),
t2 AS (SELECT w, x, r1, CASE WHEN regexp_matches(substr(x, r1 + 1), '[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE length(x) END AS r2 FROM t1),
t3 AS (SELECT w, r1, r2, CASE WHEN right(x, 4) = 'sses' THEN left(x, length(x) - 2) WHEN right(x, 3) IN ('ied', 'ies') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
  WHEN right(x, 2) NOT IN ('us', 'ss') AND regexp_matches(x, '[aeiouy].+s$') THEN left(x, length(x) - 1) ELSE x END AS x FROM t2),
t4 AS (SELECT *, CASE WHEN regexp_matches(x, 'eed(ly)?$') THEN NULL WHEN regexp_matches(x, '[aeiouy].*(ed|edly|ing|ingly)$') AND regexp_matches(regexp_replace(x, '(ingly|edly|ing|ed)$', ''), '[aeiouy]') THEN regexp_replace(x, '(ingly|edly|ing|ed)$', '') END AS cut FROM t3),
t5 AS (SELECT w, r1, r2, x AS plain, CASE WHEN regexp_matches(x, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(x, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(x, 'eed(ly)?$', 'ee') ELSE x END
  WHEN cut IS NULL THEN x WHEN right(cut, 2) IN ('at', 'bl', 'iz') THEN cut || 'e' WHEN right(cut, 2) IN ({", ".join(f"'{d}'" for d in st.DOUBLES)}) THEN left(cut, length(cut) - 1)
  WHEN length(cut) <= r1 AND {_SHORT.format("cut")} THEN cut || 'e' ELSE cut END AS x FROM t4),
t6 AS (SELECT w, r1, r2, plain, regexp_replace(x, '^(.+[^aeiouy])[yY]$', '\\1i') AS x FROM t5),
t7 AS (SELECT w, r1, r2, plain, {_cases("x", st.DERIVED, "r1", {"ogi": "right({left}, 1) = 'l'", "li": f"regexp_matches({{left}}, '[{st.BEFORE_LI}]$')"})} AS x FROM t6),
t8 AS (SELECT w, r1, r2, plain, {_cases("x", st.SHORTENED, "r1", {"ative": "length({left}) >= r2"})} AS x FROM t7),
t9 AS (SELECT w, r1, r2, plain, {_cases("x", dict.fromkeys(st.DROPPED, ""), "r2", {"ion": "right({left}, 1) IN ('s', 't')"})} AS x FROM t8),
t10 AS (SELECT w, plain, CASE WHEN right(x, 1) = 'e' AND (length(x) > r2 OR length(x) > r1 AND NOT {_SHORT.format("left(x, length(x) - 1)")}) THEN left(x, length(x) - 1)
  WHEN right(x, 2) = 'll' AND length(x) > r2 THEN left(x, length(x) - 1) ELSE x END AS x FROM t9),
stems AS (SELECT w AS word, CASE WHEN length(w) <= 2 THEN w ELSE coalesce({_SPECIAL}, CASE WHEN plain IN ({", ".join(f"'{x}'" for x in st.FINISHED)}) THEN plain ELSE replace(x, 'Y', 'y') END) END AS term FROM t10),
post AS (SELECT chunk_id, position, term FROM raw JOIN stems USING (word))"""
JOBS = """jobs AS (
  SELECT o_custkey AS video_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'succeeded' ELSE 'queued' END AS status,
    o_orderdate AS created_at FROM orders)"""
