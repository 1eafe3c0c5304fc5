"""Queries over pages and replies, each beside its SQL. Importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import pages as P
from .bind import Catalog
from .registry import query

_token = H.TOKEN.replace("++", "+").replace("*+", "*").replace("'", "''")


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '{H.ENDS}', '', 'g')"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _decoded(text: str) -> str:
    for name in sorted(H.ENTITIES, key="amp".__eq__):  # amp last, so that nothing is decoded twice
        text = f"replace({text}, '&{name};', '{H.ENTITIES[name].replace(chr(39), chr(39) * 2)}')"
    return text


def _stream(html: str, tags: str) -> str:
    """tok: the tokens; el: every element of some tags, its end found among all closings by counting what lies between."""
    name = r"lower(regexp_extract(value, '^</?([a-zA-Z][^\s/>]*)', 1))"
    return rf""", tok AS MATERIALIZED (SELECT id, pos, value, CASE WHEN NOT regexp_matches(value, '(?s)^<[a-zA-Z/!?].*>$') THEN 'text'
      WHEN NOT regexp_matches(value, '^</?[a-zA-Z]') OR regexp_matches(value, '(?is)^<(script|style)\b.*</(script|style)\s*>$') THEN 'other' WHEN value LIKE '</%' THEN 'close'
      WHEN {name} IN ({_quoted(H.VOID)}) OR value LIKE '%/>' THEN 'void' ELSE 'open' END AS kind, {name} AS tag
      FROM (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM (SELECT page_id AS id, regexp_extract_all({html}, '{_token}') AS v FROM pages))),
    tg AS (SELECT * FROM tok WHERE kind IN ('open', 'close') AND tag IN ({tags})),
    even AS (SELECT o.id, o.tag, o.pos AS low, q.pos AS high FROM tg o JOIN tg q USING (id, tag) JOIN tg x USING (id, tag) WHERE o.kind = 'open' AND q.pos > o.pos AND x.pos BETWEEN o.pos AND q.pos
      GROUP BY ALL HAVING sum(CASE x.kind WHEN 'open' THEN 1 ELSE -1 END) = 0),
    el AS (SELECT o.id, o.value, o.pos AS low, min(high) AS high FROM tg o LEFT JOIN even e ON e.id = o.id AND e.low = o.pos WHERE o.kind = 'open' GROUP BY ALL)"""


query(
    "s08_read_pages",
    _stream("CASE WHEN page_id % 11 <> 0 THEN html END", _quoted(H.DROPPED)) + rf""", t AS (SELECT id, string_agg(s, chr(10) ORDER BY pos) AS text FROM
      (SELECT id, pos, {_stripped(_decoded('value'))} AS s FROM tok WHERE kind = 'text' AND NOT EXISTS (SELECT 1 FROM el WHERE el.id = tok.id AND low < pos AND (high IS NULL OR high > pos))) WHERE s <> '' GROUP BY id)
    SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN md5(CASE WHEN length(text) > 12000 THEN text[1:12000] || chr(10) || '...[обрезано]' ELSE coalesce(text, '') END) END AS digest,
      coalesce(length(text) > 12000, false) AS cut, CASE WHEN page_id % 11 = 0 THEN 'Unsupported content-type: application/pdf' END AS error FROM pages LEFT JOIN t ON id = page_id""",
)(
    lambda c: H.page_texts(c.table("pages").select(F.col("page_id").alias("id"), "html", F.when(F.col("page_id") % 11 != 0, "text/html; charset=utf-8").otherwise("application/pdf").alias("content_type")))
    .select(F.col("id").alias("page_id"), F.md5("text").alias("digest"), F.coalesce(F.length("text") > 12000, F.lit(False)).alias("cut"), "error")
)

#: The pages' own html, its advertisement and its article marked as lyrics.
MARKED = (('<div class="ad">', '<div data-lyrics-container="true"><div>7 Contributors<br>Song Lyrics<br></div>'), ("<article>", '<section data-lyrics-container="true">'), ("</article>", "</section>"))


def _marked(c: Catalog) -> DataFrame:
    html = F.col("html")
    for a, b in MARKED:
        html = F.replace(html, F.lit(a), F.lit(b))
    return c.table("pages").select(F.col("page_id").alias("id"), html.alias("html"))


_html = "html"
for _a, _b in MARKED:
    _html = f"replace({_html}, '{_a}', '{_b}')"
query(
    "s09_lyrics_blocks",
    _stream(_html, "'div', 'section'") + rf""", lc AS (SELECT * FROM el WHERE value LIKE '%data-lyrics-container="true"%'),
    outer_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY low) AS block FROM lc a WHERE NOT EXISTS (SELECT 1 FROM lc b WHERE b.id = a.id AND b.low < a.low AND (b.high IS NULL OR b.high > a.low))),
    bl AS (SELECT tok.id, block, string_agg(CASE tag WHEN 'br' THEN chr(10) ELSE {_decoded('tok.value')} END, chr(10) ORDER BY pos) AS text FROM tok JOIN outer_ o ON o.id = tok.id AND low < pos AND (high IS NULL OR high > pos)
      WHERE kind = 'text' OR tag = 'br' GROUP BY ALL),
    cu AS (SELECT *, text LIKE '%Contributors%' OR text LIKE '%Lyrics' || chr(10) || '%' AS heading, CASE WHEN instr(text, 'Lyrics' || chr(10)) > 0 THEN text[instr(text, 'Lyrics' || chr(10)) + 7:] ELSE text END AS x FROM bl),
    cx AS (SELECT *, CASE WHEN heading THEN {_stripped("CASE WHEN instr(x, 'Read More') > 0 THEN x[instr(x, 'Read More') + 9:] ELSE x END")} ELSE text END AS y FROM cu),
    st AS (SELECT id, min(block) AS first FROM cx WHERE NOT heading OR y <> '' GROUP BY id),
    jo AS (SELECT id, {_stripped("string_agg(CASE WHEN block = first THEN y ELSE text END, chr(10) ORDER BY block)")} AS text FROM cx JOIN st USING (id) WHERE block >= first GROUP BY id)
    SELECT page_id, coalesce(text, '') AS text FROM pages LEFT JOIN jo ON id = page_id""",
)(lambda c: H.lyrics_containers(_marked(c)).withColumnRenamed("id", "page_id"))


def _reply(c: Catalog) -> DataFrame:
    """What a service might answer: prose around a nested object, whose strings hold braces and quotes."""
    inner = F.to_json(F.struct(F.col("url").alias("u"), F.lit('}{ "[').alias("s"), F.struct(F.col("page_id").alias("k"), F.array(F.struct(F.lit(1).alias("x"))).alias("l")).alias("n")))
    prose = F.concat(F.lit("Here (it's) is: "), inner, F.when(F.col("page_id") % 3 == 0, " as asked}.").when(F.col("page_id") % 3 == 1, " as asked.").otherwise(""))
    return c.table("pages").select("page_id", F.when(F.col("page_id") % 7 == 0, inner).when(F.col("page_id") % 7 == 1, F.lit("no { object")).otherwise(prose).alias("reply"))


query("s12_embedded_json", "SELECT page_id, page_id::VARCHAR AS k, url AS u, '}{ \"[' AS s FROM pages WHERE page_id % 7 <> 1 UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages WHERE page_id % 7 = 1")(
    lambda c: _reply(c).withColumn("j", P.embedded_json(F.col("reply"))).select("page_id", F.get_json_object("j", "$.n.k").alias("k"), F.get_json_object("j", "$.u").alias("u"), F.get_json_object("j", "$.s").alias("s"))
)


def _candidates(c: Catalog) -> DataFrame:
    """Lists of candidates in prose: every second item is too short, and some are no objects."""
    item = F.to_json(F.struct(F.lit(" A ").alias("artist"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  lyrics [of] event }"), "event_id", F.lit(" ")))
                              .otherwise(F.lit("short")).alias("lyrics"), F.array(F.struct(F.lit(1).alias("n"))).alias("more")))
    lists = c.table("events").select("user_id", "event_id", item.alias("item")).groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "item"))).alias("items"))
    return lists.select("id", F.concat(F.lit("Found: ["), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit(', "no object", 3] (all).')).alias("reply"))


query("s12_candidates", "SELECT user_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, 'A' AS artist, event_type AS title, 'lyrics [of] event }' || event_id AS lyrics FROM events WHERE event_id % 2 = 0")(
    lambda c: P.candidates(_candidates(c))
)


def _results(c: Catalog) -> DataFrame:
    e = c.table("events").select(F.col("user_id").alias("id"), "event_id", F.struct(F.concat("event_type", F.lit(" "), "event_id").alias("title"), F.concat(F.lit("http://media.example/"), "event_id").alias("href"), F.col("props").alias("body")).alias("r"))
    return e.groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"])).alias("reply"))


query("s11_search_results", "SELECT user_id AS id, pos::INT AS pos, event_type || ' ' || event_id AS title, 'http://media.example/' || event_id AS href, props AS body FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) WHERE pos < 10")(
    lambda c: P.search_results(_results(c))
)
query("s11_lyrics_hits", """SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS pos, title, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM (
  SELECT user_id AS id, event_id AS pos, event_type AS title, repeat('la ', (event_id % 12)::INT) || 'end' AS text FROM events) WHERE length(text) >= 20) WHERE n <= 3""")(
    lambda c: P.lyrics_hits(c.table("events").groupBy(F.col("user_id").alias("id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(
        "event_id", F.col("event_type").alias("title"), F.concat(F.repeat(F.lit("la "), (F.col("event_id") % 12).cast("int")), F.lit("end ")).alias("text")))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))).alias("reply")))
)
