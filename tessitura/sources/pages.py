"""Readable text out of web pages and replies, by Spark's string functions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.stems import bound

#: Elements whose content isn't text, and the entities that are decoded.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_text(html: Column, limit: int = 12_000, marker: str = "…") -> Column:
    """Text lines of a fragment without nested dropped elements, as one expression; html.page_texts() takes whole pages."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    text = F.array_join(lines, "\n")
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def lyrics_blocks(html: Column) -> Column:
    """Marked blocks of a fragment that hold no further block elements, as one expression; html.lyrics_containers() takes whole pages."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<div[^>]*data-lyrics-container="true"[^>]*>(.*?)</div>'), F.lit(1))
    text = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", ""))
    first = F.regexp_replace(F.regexp_replace(F.get(text, F.lit(0)), r"(?s)^.*?Lyrics\n", ""), r"(?s)^.*?Read More", "")
    return F.array_join(F.concat(F.array(first), F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0)))), "\n")


#: Fixed value: the least length of a text that counts as lyrics.
LEAST = 20


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]"), text)


def balanced(text: Column, opening: str = r"[\[{]") -> Column:
    """The text from its first opening bracket to where that is closed, brackets inside strings not counted; null where it never is. One
    pass over the text's pieces: strings, brackets and what lies between."""
    tail = F.regexp_extract(text, f"(?s){opening}.*$", 0)
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[\[{]|[\]}]|[^"\[\]{}]++|"'), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        at = state["at"] + F.length(piece)
        ended = state["end"].isNull() & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.coalesce(state["end"], F.when(ended, at)).alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    return bound(F.aggregate(pieces, start, step)["end"], lambda end: F.when(end.isNotNull(), F.substring(tail, F.lit(1), end)))


def embedded_json(text: Column) -> Column:
    """The first balanced object or list of a text, which is all of it where it is JSON; else the first balanced object; else null. As a
    string."""
    return F.coalesce(bound(balanced(text), _valid), bound(balanced(text, r"\{"), _valid))


def candidates(replies: DataFrame, least: int = LEAST) -> DataFrame:
    """replies: id, reply: text with a JSON list in it. id, pos, artist, title, lyrics of the items that are objects with lyrics of at least
    `least` characters, blanks off; names that are missing are Unknown."""
    json = bound(balanced(F.col("reply")), _valid)
    items = replies.select("id", F.posexplode(F.from_json(F.when(F.trim(json).startswith("["), json), "array<string>")).alias("n", "item")).filter(F.col("item").startswith("{"))
    field = lambda x: F.trim(F.coalesce(F.get_json_object("item", f"$.{x}"), F.lit("")))
    rows = items.select("id", "n", *(field(x).alias(x) for x in ("artist", "title", "lyrics"))).filter(F.length("lyrics") >= least)
    known = lambda x: F.when(F.col(x) != "", F.col(x)).otherwise("Unknown").alias(x)
    order = W.Window.partitionBy("id").orderBy("n")
    return rows.select("id", (F.row_number().over(order) - 1).alias("pos"), known("artist"), known("title"), "lyrics")


def syllable_array(value: Column) -> Column:
    """A JSON column of syllable timings as an array of structs."""
    return F.from_json(value, "array<struct<syllable:string,start:double,end:double>>")


def vector_array(value: Column) -> Column:
    return F.from_json(value, "array<double>")


def search_results(replies: DataFrame, limit: int = 10) -> DataFrame:
    """replies: id, reply (JSON list of title, href, body). The first `limit` results of each."""
    parsed = replies.select("id", F.posexplode(F.from_json("reply", "array<struct<title:string,href:string,body:string>>")).alias("pos", "r"))
    return parsed.filter(F.col("pos") < limit).select("id", "pos", "r.*")


def lyrics_hits(replies: DataFrame, limit: int = 3, least: int = LEAST) -> DataFrame:
    """replies: id, reply (JSON list of title, text). The first `limit` hits whose text has at least `least` characters, blanks off."""
    rows = replies.select("id", F.posexplode(F.from_json("reply", "array<struct<title:string,text:string>>")).alias("n", "r"))
    long = rows.select("id", "n", "r.title", F.trim("r.text").alias("text")).filter(F.length("text") >= least)
    ranked = long.withColumn("pos", F.row_number().over(W.Window.partitionBy("id").orderBy("n")) - 1)
    return ranked.filter(F.col("pos") < limit).select("id", "pos", "title", "text")


def library_csv(spark, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', schema="artist string, title string, URL string").filter(F.coalesce(F.trim("URL"), F.lit("")) != "")


def object_listing(spark, path: str) -> DataFrame:
    """Names and sizes of the mp3 files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mp3").option("recursiveFileLookup", "true").load(path).select("path", "length").orderBy("path")


def _json_or_nothing(spark, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON document, or one in each line; no rows where there is no such file."""
    try:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def centroids_json(spark, path: str) -> DataFrame:
    """position, centroid of a document {"centroids": [[...], ...]}; a missing one has none."""
    doc = _json_or_nothing(spark, path, "centroids array<array<double>>")
    return doc.select(F.posexplode("centroids").alias("position", "centroid"))


def stats_json(spark, path: str) -> DataFrame:
    """pos, mean, std of a document {"mean": [...], "std": [...]}; a std below 1e-8 is 1; a missing document has none."""
    doc = _json_or_nothing(spark, path, "mean array<double>, std array<double>")
    rows = doc.select(F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "s"))
    return rows.select("pos", "s.mean", F.when(F.col("s.std") < 1e-8, 1.0).otherwise(F.col("s.std")).alias("std"))


def catalog_json(spark, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """clusters and tags of one JSON document, or of a document in each line; both empty where there is no such file."""
    doc = _json_or_nothing(spark, path, "clusters array<struct<id:long,name:string>>, tags array<struct<id:long,name:string,cluster_id:long>>", lines)
    return doc.select(F.explode("clusters").alias("c")).select("c.*"), doc.select(F.explode("tags").alias("t")).select("t.*")
