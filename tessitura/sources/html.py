"""HTML as a stream of tokens: tags and texts as rows in order, elements as ranges of them.

A tag's depth is a running sum of its openings less its closings in the page, a closing without an opening not counted. An
element reaches from its opening to the next closing at the same depth, or to the page's end without one; an element without content
(br, img) is no range. Windows over one page's rows do all of this, so that a page of any length costs in proportion. What lies
inside chosen elements follows from a running sum over the ends of their ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: What follows a tag's first letter: a quoted attribute may hold >. Nothing is tried twice.
_REST = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
#: Comments, elements whose content isn't markup, tags, texts (with each < that begins no tag), and a tag that never ends.
TOKEN = rf"(?s)<!--.*?-->|(?i:<script\b{_REST}.*?</script\s*>|<style\b{_REST}.*?</style\s*>)|<[a-zA-Z/!?]{_REST}|(?:[^<]++|<[^a-zA-Z/!?<])++|<[^<]*+"
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose content isn't text of a page.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript")
#: Entities by name.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°", "times": "×", "euro": "€", "pound": "£", "sect": "§",
    "agrave": "à", "aacute": "á", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é", "iacute": "í", "ntilde": "ñ", "oacute": "ó", "ouml": "ö", "uacute": "ú", "uuml": "ü", "szlig": "ß",
    "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
}
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
#: Blanks at the ends of a text, those beyond ASCII too.
ENDS = r"^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$"


def decoded(text: Column) -> Column:
    """Entities by name, as decimal and as hexadecimal numbers; others and numbers beyond Unicode stay as they are."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def one(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece) - 2)
        number = F.when(name.rlike("^#[0-9]"), F.substring(name, F.lit(2), F.length(name)).try_cast("bigint")).otherwise(F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).try_cast("bigint"))
        sound = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(~(piece.startswith("&") & piece.endswith(";") & (F.length(piece) > 2)), piece).when(name.startswith("#"), F.coalesce(sign, piece)).otherwise(F.coalesce(F.try_element_at(names, name), piece))

    plain = ~F.contains(text, F.lit("&"))
    return F.when(plain, text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one), ""))


def tokens(pages: DataFrame) -> DataFrame:
    """pages: id (unique), html. id, pos, kind (open, close, void, text, other), tag (lower case, null for texts), value."""
    rows = pages.select("id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "value"))
    name = F.lower(F.regexp_extract("value", r"^</?([a-zA-Z][^\s/>]*)", 1))
    is_tag = F.col("value").rlike(r"^</?[a-zA-Z]")
    raw = F.col("value").rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$")
    kind = (
        F.when(~F.col("value").rlike("(?s)^<[a-zA-Z/!?].*>$"), "text").when(~is_tag | raw, "other").when(F.col("value").startswith("</"), "close")
        .when(name.isin(*VOID) | F.col("value").endswith("/>"), "void").otherwise("open")
    )
    return rows.select("id", "pos", kind.alias("kind"), F.when(is_tag, name).alias("tag"), "value")


def elements(rows: DataFrame) -> DataFrame:
    """rows: of tokens(). id, tag, value (of the opening), start, end (positions; null where it never closes)."""
    by_tag = W.Window.partitionBy("id", "tag").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    tags = rows.filter(F.col("kind").isin("open", "close")).withColumn("sum", F.sum(step).over(by_tag))
    depth = F.col("sum") - F.least(F.lit(0), F.min("sum").over(by_tag))
    tags = tags.withColumn("depth", depth).withColumn("level", F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.coalesce(F.lag("depth").over(by_tag), F.lit(0))))
    # At one depth openings and closings take turns.
    same = W.Window.partitionBy("id", "tag", "level").orderBy("pos")
    return tags.filter("level > 0").withColumn("end", F.lead("pos").over(same)).filter("kind = 'open'").select("id", "tag", "value", F.col("pos").alias("start"), "end")


def inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with depth: how many of the ranges (id, start, end) hold the row; block: how many outermost ones have begun so far."""
    ends = ranges.select("id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")))).alias("e")).select("id", "e.pos", "e.step").filter("pos IS NOT NULL")
    steps = ends.groupBy("id", "pos").agg(F.sum("step").alias("step"))
    order = W.Window.partitionBy("id").orderBy("pos")
    both = rows.join(steps, ["id", "pos"], "left").withColumn("depth", F.sum(F.coalesce("step", F.lit(0))).over(order))
    begins = (F.col("depth") > 0) & (F.coalesce(F.lag("depth").over(order), F.lit(0)) == 0)
    return both.withColumn("begins", begins.cast("int")).withColumn("block", F.sum("begins").over(order)).drop("step", "begins")


def page_texts(pages: DataFrame, limit: int = 12_000, marker: str = "\n...[обрезано]") -> DataFrame:
    """pages: id, html, content_type. id, text: the texts outside DROPPED elements, blank ends off, joined by line feeds, cut to `limit` characters with
    a marker; null, and an error, where the content isn't HTML."""
    type_ = F.lower(F.coalesce("content_type", F.lit("")))
    sound = type_.contains("text/html") | type_.contains("application/xhtml")
    known = pages.select("id", "html", sound.alias("sound"), F.when(~sound, F.concat(F.lit("Unsupported content-type: "), F.when(type_ != "", type_).otherwise("unknown"))).alias("error"))
    rows = tokens(known.filter("sound").select("id", "html"))
    left = inside(rows, elements(rows).filter(F.col("tag").isin(*DROPPED))).filter("depth = 0 AND kind = 'text'")
    stripped = left.select("id", "pos", F.regexp_replace(decoded(F.col("value")), ENDS, "").alias("text")).filter("text <> ''")
    joined = stripped.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cut = F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit(marker))).otherwise(F.col("text"))
    return known.join(joined, "id", "left").select("id", F.when(F.col("sound"), F.coalesce(cut, F.lit(""))).alias("text"), "error")


def lyrics_containers(pages: DataFrame) -> DataFrame:
    """pages: id, html. id, text: the outermost elements marked as lyrics, whatever they hold; br is a line feed, and line feeds stand between
    texts. The first block that isn't empty loses what leads up to its heading and its description."""
    rows = tokens(pages)
    marked = elements(rows).filter(F.col("value").rlike(r"""(?i)\sdata-lyrics-container\s*=\s*["']?true\b"""))
    held = inside(rows, marked).filter("depth > 0 AND (kind = 'text' OR tag = 'br')")
    text = F.when(F.col("tag") == "br", "\n").otherwise(decoded(F.col("value")))
    blocks = held.select("id", "block", "pos", text.alias("text")).groupBy("id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    behind = lambda t, mark: F.when(F.contains(t, F.lit(mark)), F.substring(t, F.instr(t, mark) + len(mark), F.length(t))).otherwise(t)
    heading = F.contains("text", F.lit("Contributors")) | F.contains("text", F.lit("Lyrics\n"))
    cut = blocks.withColumn("cut", F.when(heading, F.regexp_replace(behind(behind(F.col("text"), "Lyrics\n"), "Read More"), ENDS, "")).otherwise(F.col("text")))
    # Blocks are cut until one of them leaves something; from the next one on they stay as they are.
    first = F.min(F.when(~heading | (F.col("cut") != ""), F.col("block"))).over(W.Window.partitionBy("id"))
    kept = cut.withColumn("first", first).withColumn("part", F.when(F.col("block") <= F.col("first"), F.col("cut")).otherwise(F.col("text"))).filter("block >= first")
    joined = kept.groupBy("id").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "\n"), ENDS, "").alias("text"))
    return pages.select("id").join(joined, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))
