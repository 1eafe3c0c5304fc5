"""Sheets, alignment, mood and tag queries. Importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X

from ..operators import alignment as A
from ..operators import lyrics as L
from ..operators import search as S
from ..operators import timing as T
from ..operators import updates as U
from ..operators import vectors as V
from ..sources import pages as P
from ..sources.shared import shared_dir, written
from ..streaming import progress as Z
from .bind import BIND, Catalog
from .registry import CENTROIDS, NEAR, SQL, _queries, query

# --- sheets ----------------------------------------------------------------------------------------------------------------


def sheets(c: Catalog) -> DataFrame:
    """The documents as lyrics sheets: a header before every third line, repeats behind some lines, references at the end."""
    label = lambda i: F.element_at(F.array(F.lit("Verse"), F.lit("Chorus"), F.lit("Bridge")), F.pmod(F.floor(i / 3).cast("int"), F.lit(3)) + 1)
    times = F.when(F.col("doc_id") % 3 == 0, " x2").otherwise("")
    header = lambda i: F.when(i % 3 == 0, F.concat(F.lit("["), label(i), times, F.lit("]\n"))).otherwise("")
    repeat = lambda i: F.when(i % 5 == 1, " (2x)").when(i % 7 == 2, " ×3").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(header(i), x, repeat(i)))
    return c.table("documents").select(F.col("doc_id").alias("id"), F.concat(F.array_join(lines, "\n"), F.lit("\n[Chorus]\n\n[Coda]\n[Verse 3x]\nrepeat chorus (\nla )\n  la\n")).alias("text"))


SHEET = """, sheet AS (SELECT doc_id AS id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE WHEN (i - 1) % 3 = 0 THEN '[' || ['Verse', 'Chorus', 'Bridge'][((i - 1) // 3) % 3 + 1] || CASE WHEN doc_id % 3 = 0 THEN ' x2' ELSE '' END || ']' || chr(10) ELSE '' END || x
  || CASE WHEN (i - 1) % 5 = 1 THEN ' (2x)' WHEN (i - 1) % 7 = 2 THEN ' ×3' ELSE '' END), chr(10))
  || replace('~[Chorus]~~[Coda]~[Verse 3x]~repeat chorus (~la )~  la~', '~', chr(10)) AS text FROM documents)"""
_C = r"(?:[xх×]\s*(\d+)|(\d+)\s*[xх×]|(\d+)\s*раз[аовы]*|(\d+)\s*times?)"
H_, C_, BR_, BA_ = r"^\s*\[\s*([^\[\]\n]+?)\s*\]\s*$", "(?i)" + _C, r"(?i)\s*[\(\[]\s*" + _C + r"\s*[\)\]]\s*$", r"\s+(?:×\s*(\d+)|(\d+)\s*×)\s*$"
_N = "coalesce(greatest(1, list_max(list_transform(list_filter({all}, lambda x: x <> ''), lambda x: x::INT))), 1)"
_all = lambda t, p, n: " || ".join(f"regexp_extract_all({t}, '{p}', {k})" for k in range(1, n + 1))
SECTIONS = rf"""{SHEET}, ln AS (SELECT id, pos, line, CASE WHEN regexp_matches(line, '{H_}') THEN regexp_extract(line, '{H_}', 1) END AS header
    FROM (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM sheet))),
  lsec AS (SELECT *, count(header) OVER (PARTITION BY id ORDER BY pos) AS section FROM ln),
  sec AS (SELECT id, section, max(header) AS header, regexp_replace(coalesce(string_agg(CASE WHEN header IS NULL THEN line END, chr(10) ORDER BY pos), ''), '^\s+|\s+$', '', 'g') AS body FROM lsec GROUP BY id, section),
  lab AS (SELECT id, section, body, nullif(lower(regexp_replace(regexp_replace(regexp_replace(header, '{C_}', '', 'g'), '\s+', ' ', 'g'), '^[ :;,-]+|[ :;,-]+$', '', 'g')), '') AS label, {_N.format(all=_all("header", C_, 4))} AS cnt FROM sec)"""
BODIES = SECTIONS + """, bod AS (SELECT id, section, label, cnt, CASE WHEN body <> '' THEN body WHEN label IS NOT NULL THEN
  last_value(CASE WHEN body <> '' THEN body END IGNORE NULLS) OVER (PARTITION BY id, label ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS body FROM lab)"""
_base = rf"CASE WHEN regexp_matches(l, '{BR_}') THEN regexp_replace(regexp_replace(l, '{BR_}', ''), '\s+$', '') WHEN regexp_matches(l, '{BA_}') THEN regexp_replace(regexp_replace(l, '{BA_}', ''), '\s+$', '') ELSE l END"
_times = f"CASE WHEN regexp_matches(l, '{BR_}') THEN {_N.format(all=_all('l', BR_, 4))} WHEN regexp_matches(l, '{BA_}') THEN {_N.format(all=_all('l', BA_, 2))} ELSE 1 END"
_gone = f"(regexp_matches(l, '{BR_}') OR regexp_matches(l, '{BA_}')) AND trim({_base}) = ''"
EXPANDED = BODIES + f""", blo AS (SELECT id, section, cnt, array_to_string(flatten(list_transform(string_split(body, chr(10)), lambda l: CASE WHEN {_gone} THEN []::VARCHAR[] ELSE list_resize([{_base}], ({_times})::INT, {_base}) END)), chr(10)) AS block FROM bod WHERE body IS NOT NULL),
  exp AS (SELECT id, string_agg(array_to_string(list_resize([block], cnt::INT, block), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY section) AS text FROM blo WHERE trim(block) <> '' GROUP BY id)"""

query("w13_section_ids", SECTIONS + " SELECT id, section, count(*) AS lines, count(header) AS headers, min(pos) - 1 AS first_line FROM lsec GROUP BY ALL")(
    lambda c: L.section_ids(sheets(c)).groupBy("id", "section").agg(F.count("*").alias("lines"), F.count("header").alias("headers"), F.min("pos").cast("long").alias("first_line"))
)
query("w14_last_body_by_label", BODIES + " SELECT id, section, coalesce(label, '') AS label, cnt AS times, md5(body) AS body FROM bod WHERE body IS NOT NULL AND (body <> '' OR label IS NOT NULL)")(
    lambda c: L.last_body_by_label(L.sections(sheets(c))).select("id", "section", F.coalesce("label", F.lit("")).alias("label"), F.col("count").alias("times"), F.md5("body").alias("body"))
)
query("x19_expand_repeats", EXPANDED + " SELECT s.id, md5(coalesce(e.text, '')) AS digest, length(coalesce(e.text, '')) AS chars FROM sheet s LEFT JOIN exp e USING (id)")(
    lambda c: L.expand_repeats(sheets(c)).select("id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))
)
query("x20_needs_rewrite", SHEET + r" SELECT id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(?:repeat|повтор[\p{L}\p{N}_]*|снова)\s+(?:chorus|verse|bridge|припев|куплет|бридж)') AS needed FROM sheet")(
    lambda c: sheets(c).select("id", X.needs_rewrite(F.col("text")).alias("needed"))
)
_clean = r"regexp_replace(regexp_replace(text, '(?s)\[.*?\]\n?', '', 'g'), '^\s+|\s+$', '', 'g')"
for _p, _b in ((r"\n+([ \t]*[,.;:!?)\]…—–])", r"\1"), (r"\n+([ \t]+[^\s])", r" \1"), (r"([(\[])[ \t]*\n+", r"\1")):
    _clean = f"regexp_replace({_clean}, '{_p}', '{_b}', 'g')"
_clean = rf"regexp_replace({_clean}, '\n{{3,}}', chr(10) || chr(10), 'g')"
query("x18_clean_lyrics", SHEET + f" SELECT id, md5({_clean}) AS digest FROM sheet")(lambda c: sheets(c).select("id", F.md5(X.clean_lyrics(F.col("text"))).alias("digest")))
_ws = lambda t: rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
_tr = lambda t: rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_ch = lambda w, n: f"list_transform(range(0, len({w}), {n}), lambda k: array_to_string({w}[k + 1:k + {n}], ' '))"
query("x22_search_fragments", rf""", f0 AS (SELECT doc_id AS id, text, {_ws("text")} AS ws, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda p: {_tr("p")}), lambda p: p <> '') AS cut FROM documents),
  f1 AS (SELECT *, list_filter(CASE WHEN len(cut) > 0 THEN cut ELSE {_ch("ws", 10)} END, lambda p: len({_ws("p")}) >= 5) AS lng FROM f0),
  f2 AS (SELECT *, CASE WHEN len(lng) > 0 THEN lng ELSE cut END AS s0, greatest(8, least(12, len(ws) // 3)) AS size FROM f1),
  f3 AS (SELECT *, CASE WHEN len(s0) > 0 AND len(s0) < 3 AND len(ws) >= 15 THEN {_ch("ws", "size")} ELSE s0 END AS sme FROM f2),
  f4 AS (SELECT *, list_transform(sme, lambda p: array_to_string({_ws("p")}[1:12], ' ')) AS short FROM f3)
  SELECT id, len(f)::BIGINT AS n, md5(array_to_string(f, '|')) AS digest FROM (SELECT id, CASE WHEN len(sme) = 0 OR (len(cut) = 0 AND len(ws) < 3) THEN CASE WHEN {_tr("text")} <> '' THEN [{_tr("text")}] ELSE []::VARCHAR[] END
    WHEN len(sme) <= 3 THEN short ELSE [short[1], short[round_even((len(sme) - 1) / 2, 0)::INT + 1], short[len(sme)]] END AS f FROM f4)""")(
    lambda c: L.search_fragments(c.table("documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.size("fragments").cast("long").alias("n"), F.md5(F.array_join("fragments", "|")).alias("digest"))
)
_skip = r"list_filter(regexp_split_to_array(l, '\s+'), lambda w: regexp_matches(w, '[\p{L}'']'))"
query("x35_lyric_words", rf"SELECT doc_id, len(flatten(ls))::BIGINT AS words, len(list_filter(ls, lambda x: len(x) > 0))::BIGINT AS firsts, md5(array_to_string(list_transform(ls, lambda x: array_to_string(x, ' ')), chr(10))) IS NOT NULL AS ok, md5(array_to_string(flatten(ls), ' ')) AS digest FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: {_skip}) AS ls FROM documents)")(
    lambda c: c.table("documents").select("doc_id", A.lyric_words(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("words"), F.size(F.filter("w", lambda x: x["first"])).cast("long").alias("firsts"),
        F.md5(F.array_join(F.transform("w", lambda x: F.concat(F.when(x["first"], "\n").otherwise(" "), x["word"])), "")).isNotNull().alias("ok"), F.md5(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("digest")
    )
)

# --- line breaks -----------------------------------------------------------------------------------------------------------


def beats(c: Catalog) -> DataFrame:
    """A beat every half second on every second track."""
    ends = c.syllables().filter("track_id % 2 = 0").groupBy("track_id").agg(F.max("end").alias("last"))
    return ends.select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") * 2).cast("int"))).alias("k")).select("track_id", (F.col("k") * 0.5).alias("t"))


BEATS = """, beats AS (SELECT track_id, unnest(range(0, floor(last * 2)::BIGINT + 1)) * 0.5::DOUBLE AS t FROM (SELECT track_id, max("end") AS last FROM syllables WHERE track_id % 2 = 0 GROUP BY 1)),
  bars AS (SELECT track_id, list(t ORDER BY t) AS bars FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS k FROM beats) WHERE k % 4 = 0 GROUP BY 1),
  tim AS MATERIALIZED (SELECT *, start - lag("end") OVER (PARTITION BY track_id ORDER BY n) AS gap, row_number() OVER (PARTITION BY track_id ORDER BY n) - 1 AS i FROM syllables),
  barwalk AS (SELECT track_id, n, i, 1::BIGINT AS bar, false AS opens FROM tim JOIN bars USING (track_id) WHERE i = 0
    UNION ALL SELECT t.track_id, t.n, t.i, w.bar + CASE WHEN starts_with(t.syllable, ' ') AND coalesce(t.start >= b.bars[w.bar + 1] - 0.3, false) THEN 1 ELSE 0 END, starts_with(t.syllable, ' ') AND coalesce(t.start >= b.bars[w.bar + 1] - 0.3, false)
    FROM barwalk w JOIN tim t ON t.track_id = w.track_id AND t.i = w.i + 1 JOIN bars b ON b.track_id = w.track_id)"""
GAPWALK = """, th AS (SELECT track_id, greatest(CASE WHEN count(*) FILTER (gap > 0.4) >= 5 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, quantile_cont(gap, 0.75) * 2.5) AS threshold, count(*) FILTER (gap > 0.4) AS wide, count(*) AS rows FROM tim GROUP BY 1),
  gapwalk AS (SELECT track_id, n, i, length(syllable) AS chars, false AS opens FROM tim WHERE i = 0
    UNION ALL SELECT track_id, n, i, CASE WHEN o THEN len ELSE chars + len END, o FROM (SELECT t.track_id, t.n, t.i, w.chars, length(t.syllable) AS len, starts_with(t.syllable, ' ') AND (t.gap > h.threshold OR w.chars > 50) AS o
      FROM gapwalk w JOIN tim t ON t.track_id = w.track_id AND t.i = w.i + 1 JOIN th h ON h.track_id = t.track_id))"""
RECURSIVE = BIND.replace("WITH tracks", "WITH RECURSIVE tracks", 1)
query("j19_bars_to_words")(lambda c: L.bars_to_words(c.syllables(), beats(c)).select("track_id", F.explode(F.col("breaks").cast("array<bigint>")).alias("n")))
SQL["j19_bars_to_words"] = RECURSIVE + BEATS + " SELECT track_id, i AS n FROM barwalk WHERE opens"
query("x23_x24_line_breaks")(lambda c: L.line_breaks(c.syllables(), beats(c)).select("track_id", "n", "opens", F.col("marked").alias("syllable")))
SQL["x23_x24_line_breaks"] = RECURSIVE + BEATS + GAPWALK + """ SELECT track_id, n, o AS opens, CASE WHEN NOT o THEN syllable WHEN starts_with(syllable, ' ') THEN chr(10) || syllable[2:] ELSE chr(10) || syllable END AS syllable
  FROM (SELECT t.track_id, t.n, t.syllable, CASE WHEN h.rows < 2 THEN false WHEN h.wide < 5 AND (SELECT count(*) FROM beats b WHERE b.track_id = t.track_id) >= 4 THEN coalesce(b.opens, false) ELSE coalesce(g.opens, false) END AS o
  FROM tim t JOIN th h USING (track_id) LEFT JOIN barwalk b USING (track_id, i) LEFT JOIN gapwalk g USING (track_id, i))"""

# --- alignment -------------------------------------------------------------------------------------------------------------


def spans(c: Catalog) -> DataFrame:
    """The events of a track as spans of one frame, four to a word; their frames as rms_frames has them."""
    k = F.get_json_object("props", "$.k").cast("long")
    order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.when(F.col("k") % 10 == 0, 30).when(F.col("k") % 10 == 5, 12).otherwise(0)
    e = c.table("events").select("user_id", "event_id", "ts", k.alias("k"), "event_type").withColumn("n", F.row_number().over(order) - 1).withColumn("base", 5 * F.col("n") + F.sum(pause).over(order))
    return e.select(F.col("user_id").alias("track_id"), F.floor(F.col("n") / 4).alias("word"), (F.col("n") % 4).alias("j"), F.col("base").alias("start_n"), (F.col("base") + 1).alias("end_n"), F.col("event_type").alias("text"))


def words(c: Catalog) -> DataFrame:
    return A.word_spans(spans(c))


def firsts(c: Catalog) -> DataFrame:
    return words(c).filter("word % 3 = 0").select("track_id", "word")


def onsets(c: Catalog) -> DataFrame:
    return spans(c).filter("word = 0 AND j = 2").select("track_id", (F.col("start_n") + 4).alias("onset_n"))


def adjusted(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The words, their shifted starts, trimmed ends and extended ends. Words, frames and trims are used several times: written."""
    w, f = written(words(c)), written(c.rms_frames())
    trims = written(A.word_end_trim(w, f))
    return w, A.line_start_shift(w, f, w.filter("word % 3 = 0")), trims, A.word_end_extend(w, f, trims)


def _islands(areas: str) -> str:
    return f"""(SELECT track_id, word, min(n) AS first_n, max(n) AS last_n, count(*) AS length FROM (SELECT *, n - row_number() OVER (PARTITION BY track_id, word ORDER BY n) AS run
      FROM (SELECT a.track_id, a.word, f.n, f.rms < a.floor AS silent FROM {areas} a JOIN fr f ON f.track_id = a.track_id AND f.n >= a.lo AND f.n < a.hi) WHERE silent) GROUP BY track_id, word, run)"""


def _until(areas: str) -> str:
    return f"""(SELECT a.track_id, a.word, max(f.n) + 1 AS until FROM {areas} a JOIN fr f ON f.track_id = a.track_id AND f.n >= a.lo AND f.n < a.hi AND f.rms >= a.floor
      LEFT JOIN (SELECT r.track_id, r.word, min(first_n) AS stop FROM {_islands(areas)} r JOIN {areas} x ON x.track_id = r.track_id AND x.word = r.word WHERE length >= x.least GROUP BY ALL) s ON s.track_id = a.track_id AND s.word = a.word
      WHERE stop IS NULL OR f.n < stop GROUP BY ALL)"""


def _loud(areas: str) -> str:
    return f"(SELECT a.*, level FROM {areas} a JOIN (SELECT a.track_id, a.word, max(rms) AS level FROM {areas} a JOIN fr f ON f.track_id = a.track_id AND f.n >= a.lo AND f.n < a.hi GROUP BY ALL HAVING max(rms) >= 1e-6) USING (track_id, word))"


SPANS = """, fr AS MATERIALIZED (SELECT * FROM rms_frames), sp AS MATERIALIZED (SELECT track_id, rn // 4 AS word, rn % 4 AS j, base AS start_n, base + 1 AS end_n, event_type AS text
    FROM (SELECT en.*, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) - 1 AS rn FROM en) JOIN (SELECT event_id, event_type FROM events) USING (event_id)),
  gp AS (SELECT *, start_n - lag(end_n) OVER (PARTITION BY track_id, word ORDER BY j) AS gap, count(*) OVER (PARTITION BY track_id, word) AS size FROM sp),
  m0 AS (SELECT track_id, median(gap) AS median FROM gp WHERE j >= 2 GROUP BY 1), m1 AS (SELECT track_id, median(gap) AS median FROM gp WHERE j >= 2 AND j < size - 1 GROUP BY 1),
  wd AS MATERIALIZED (SELECT *, lead(start_n) OVER (PARTITION BY track_id ORDER BY word) AS next_start FROM (SELECT track_id, word, count(*) AS size, min(start_n) AS start_n, max(end_n) AS end_n,
    min(start_n) FILTER (j = 1) AS second, min(end_n) FILTER (j = 0) AS first_end, max(end_n) FILTER (j = size - 2) AS before, max(start_n) FILTER (j = size - 1) AS last_start FROM gp GROUP BY 1, 2)),
  te AS (SELECT track_id, max(n) + 1 AS track_end FROM fr GROUP BY 1),
  o3 AS (SELECT w.*, second - first_end AS gap, greatest(median, 1) AS ref, start_n AS lo, coalesce(next_start - 1, track_end) AS hi FROM wd w JOIN m0 USING (track_id) JOIN te USING (track_id) WHERE word % 3 = 0 AND size >= 2 AND second - first_end > 2 * median),
  a3 AS MATERIALIZED (SELECT * REPLACE (second AS hi), level / 5 AS floor, greatest(2, round(2 * ref)) AS least, gap / ref >= 7 AS extreme FROM """ + _loud("o3") + """),
  r3 AS (SELECT r.track_id, r.word, min(last_n) AS first_stop, max(last_n) FILTER (last_n < second - 1) AS last_stop FROM """ + _islands("a3") + """ r JOIN a3 USING (track_id, word) WHERE length >= least GROUP BY ALL),
  q03 AS MATERIALIZED (SELECT track_id, word, start_n, new_start FROM (SELECT *, CASE WHEN extreme THEN coalesce(CASE WHEN second - start_n >= least + 1 THEN last_stop + 1 END, second) WHEN first_stop < second - 1 AND second - start_n >= 2 THEN first_stop + 1 END AS new_start
    FROM a3 LEFT JOIN r3 USING (track_id, word)) WHERE new_start > start_n + 1),
  o4 AS (SELECT w.*, greatest(median, 1) AS ref, start_n AS lo, end_n AS hi FROM wd w JOIN m1 USING (track_id) WHERE size >= 2 AND last_start - before > 2 * greatest(median, 1) AND end_n - before >= 2),
  a4 AS MATERIALIZED (SELECT * REPLACE (before AS lo), level / 10 AS floor, greatest(2, round(2 * ref)) AS least FROM """ + _loud("o4") + """),
  q04 AS MATERIALIZED (SELECT track_id, word, end_n, until AS new_end FROM a4 JOIN """ + _until("a4") + """ USING (track_id, word) WHERE until < end_n - 1 AND until > before + 1),
  o5 AS (SELECT w.*, least(track_end, coalesce(next_start - 1, track_end)) AS cap, start_n AS lo, end_n AS hi FROM wd w JOIN te USING (track_id) WHERE NOT EXISTS (SELECT 1 FROM q04 WHERE q04.track_id = w.track_id AND q04.word = w.word)),
  p5 AS (SELECT * FROM o5 WHERE cap - end_n >= 2), a5 AS MATERIALIZED (SELECT * REPLACE (end_n AS lo, cap AS hi), level / 10 AS floor, 2 AS least FROM """ + _loud("p5") + """),
  q05 AS MATERIALIZED (SELECT track_id, word, end_n, until AS new_end FROM a5 JOIN """ + _until("a5") + """ USING (track_id, word) WHERE until > end_n + 1),
  u05 AS (SELECT track_id, word, coalesce(a.new_end, b.new_end) AS new_end FROM q04 a FULL JOIN q05 b USING (track_id, word)),
  tm AS (SELECT track_id, word, lo, CASE WHEN hi <= lo THEN lo + 0.05 ELSE hi END AS hi, prefix FROM (SELECT track_id, word, coalesce(new_start, w.start_n) * 0.02::DOUBLE AS lo, coalesce(new_end, w.end_n) * 0.02::DOUBLE AS hi,
    CASE WHEN row_number() OVER (PARTITION BY track_id ORDER BY word) = 1 THEN '' WHEN word % 3 = 0 THEN chr(10) ELSE ' ' END AS prefix FROM wd w LEFT JOIN (SELECT track_id, word, new_start FROM q03) USING (track_id, word) LEFT JOIN u05 USING (track_id, word))),
  q06 AS (SELECT track_id, word, j, CASE WHEN upto = len THEN prefix || text ELSE text END AS text, round(lo + (hi - lo) * (upto - len) / total, 3) AS start, round(lo + (hi - lo) * upto / total, 3) AS "end" FROM
    (SELECT *, greatest(length(trim(text)), 1) AS len, sum(greatest(length(trim(text)), 1)) OVER (PARTITION BY track_id, word ORDER BY j) AS upto, sum(greatest(length(trim(text)), 1)) OVER (PARTITION BY track_id, word) AS total FROM sp) JOIN tm USING (track_id, word))
"""


def timed(c: Catalog) -> DataFrame:
    w, starts, trims, extensions = adjusted(c)
    return A.syllable_timings(w, spans(c).select("track_id", "word", "j", "text"), w.filter("word % 3 = 0"), starts, A.merge_adjustments(trims, extensions))


query("q03_line_start_shift", SPANS + "SELECT * FROM q03")(lambda c: A.line_start_shift(words(c), c.rms_frames(), firsts(c)))
query("q04_word_end_trim", SPANS + "SELECT * FROM q04")(lambda c: A.word_end_trim(words(c), c.rms_frames()))
query("q05_word_end_extend", SPANS + "SELECT * FROM q05")(lambda c: adjusted(c)[3])
query("u05_merge_adjustments", SPANS + "SELECT * FROM u05")(lambda c: A.merge_adjustments(*adjusted(c)[2:]))
query("w16_prefix_of_word", SPANS + "SELECT track_id, word, prefix FROM tm")(
    lambda c: words(c).select("track_id", "word", A.word_prefix(F.row_number().over(W.Window.partitionBy("track_id").orderBy("word")) == 1, F.col("word") % 3 == 0).alias("prefix"))
)
query("q06_syllable_timings", SPANS + "SELECT * FROM q06")(timed)
query("a18_alignment_stats", SPANS + "SELECT track_id, count(*) AS words, count(*) FILTER (parts > 1) AS split FROM (SELECT track_id, word, count(*) AS parts FROM q06 GROUP BY ALL) GROUP BY 1")(lambda c: A.alignment_stats(timed(c)))
query("q02_refine_onset", SPANS + """, ons AS (SELECT track_id, start_n + 4 AS onset_n FROM sp WHERE word = 0 AND j = 2),
  lv AS (SELECT track_id, median(rms) AS median, max(rms) AS most FROM ons JOIN fr USING (track_id) WHERE n >= onset_n AND n < onset_n + 25 GROUP BY 1 HAVING max(rms) >= 1e-5 AND median(rms) >= 1e-6),
  bk AS (SELECT track_id, n, rms < median / 10 AS silent, lead(rms < median / 10) OVER (PARTITION BY track_id ORDER BY n) AS then_ FROM ons JOIN lv USING (track_id) JOIN fr USING (track_id) WHERE n < onset_n AND n >= onset_n - 60)
  SELECT track_id, onset_n, CASE WHEN onset_n - spot <= 50 THEN spot ELSE onset_n END AS refined_n FROM ons LEFT JOIN (SELECT track_id, max(n) + 2 AS spot FROM bk WHERE silent AND then_ GROUP BY 1) USING (track_id)""")(
    lambda c: A.refine_onset(c.rms_frames(), onsets(c))
)
query("a19_reduction", """, pk AS (SELECT track_id, n, rms > max(rms) OVER (PARTITION BY track_id) * pow(10, -0.5::DOUBLE) AS voiced FROM rms_frames),
  kp AS (SELECT track_id, count(*) AS original, CASE WHEN count(*) FILTER (voiced) * 0.02 >= 1 THEN count(*) FILTER (voiced) ELSE max(n) - min(n) + 1 END AS kept FROM pk GROUP BY 1)
  SELECT track_id, original, kept, round((1 - kept / original) * 100, 1) AS reduction_pct FROM kp""")(lambda c: A.reduction(T.voiced_intervals(c.rms_frames(), 10.0), c.rms_frames()))  # fmt: skip
query("x33_frame_rms", "SELECT vec_id, i AS frame, round(sqrt(list_sum(list_transform(e[4 * i + 1:4 * i + 16], lambda x: x * x)) / 16), 6) AS rms FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 13)) AS i FROM embeddings)")(
    lambda c: c.table("embeddings").select("vec_id", F.posexplode(A.frame_rms(F.transform("embedding", lambda x: x.cast("double")), 16, 4)).alias("frame", "rms")).select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"))
)
LENGTHS = "(SELECT track_id, n AS word, 1 + k % 3 AS length, sum(1 + k % 3) OVER (PARTITION BY track_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY track_id) AS total FROM syl)"
query("x34_group_by_lengths", f"SELECT track_id, word, n FROM (SELECT track_id, word, unnest(range((upto - length)::BIGINT, upto::BIGINT)) AS n FROM {LENGTHS} WHERE upto <= total)")(
    lambda c: A.group_by_lengths(c.syllables().select("track_id", F.col("n").cast("long").alias("n")), _lengths(c)).select("track_id", "word", "n")
)


def _lengths(c: Catalog) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return c.table("events").select(F.col("user_id").alias("track_id"), n.alias("word"), (1 + k % 3).alias("length"))


# --- searches --------------------------------------------------------------------------------------------------------------

HIT_TIER = "popularity_category IN ('eternal_hit', 'current_hit', 'artist_best')"
query("j09_ranked_fetch", f"SELECT query_id, track_id, rank, title FROM {NEAR.format(kind='audio', on='true', k=10)} JOIN tracks USING (track_id)")(
    lambda c: S.ranked_fetch(V.nearest(_queries(c, "audio"), c.vectors("audio"), 10).select("query_id", "track_id", F.col("rank").cast("long").alias("rank")), c.tracks("track_id", "title").select("track_id", "title"))
)
query("t11_mood_search", f""", pl AS (SELECT DISTINCT session_id, rec_cluster_id FROM play_history JOIN tracks USING (track_id) WHERE rec_cluster_id IS NOT NULL),
  mr AS (SELECT n.query_id, n.track_id, n.score, t.artist, t.title, CASE WHEN {HIT_TIER} THEN 0 WHEN p.session_id IS NOT NULL THEN 1 ELSE 2 END AS tier
    FROM {NEAR.format(kind="lyrics", on="true", k=50)} n JOIN tracks t USING (track_id) LEFT JOIN pl p ON p.session_id = n.query_id AND p.rec_cluster_id = t.rec_cluster_id),
  mk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, track_id) AS rank FROM mr),
  mc AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM mk WHERE rank <= 15)
  SELECT query_id, track_id, tier, round(score, 6) AS score, rank, total, artist, title FROM mc WHERE rank > 5""")(
    lambda c: S.mood_search(_queries(c, "lyrics").withColumn("session_id", F.col("query_id")), c.vectors("lyrics"), c.tracks(), c.play_history(), 10, 5).withColumn("score", F.round("score", 6))
)
_mean = lambda rows, key: f"(SELECT {key}, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS q FROM (SELECT {key}, list(x ORDER BY pos) AS v FROM (SELECT {key}, pos, avg(x) AS x FROM (SELECT {key}, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM {rows}) GROUP BY ALL) GROUP BY 1))"
_side = lambda c, keys, t: f"(SELECT {keys}, track_id, {c} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {c} DESC, track_id) AS rk FROM {t}) WHERE rk <= 15)"
_fuse = lambda keys, t: f"(SELECT {keys}, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, track_id) AS rk FROM (SELECT {keys}, track_id, round(coalesce(a, 0::DOUBLE) * 0.7::DOUBLE + coalesce(l, 0::DOUBLE) * (1 - 0.7::DOUBLE), 9) AS score FROM {_side('a', keys, t)} FULL JOIN {_side('l', keys, t)} USING ({keys}, track_id))) WHERE rk <= 15)"
query("q10_recommend_by_tag", f""", bo AS (SELECT a.track_id, a.cluster_id, a.vector AS av, l.vector AS lv FROM audio_vectors a JOIN lyrics_vectors l USING (track_id)),
  co AS MATERIALIZED (SELECT bo.*, artist, popularity_category FROM bo JOIN tracks USING (track_id) WHERE status = 'ready'),
  rq AS (SELECT session_id, tag_id, cluster_id FROM (SELECT DISTINCT user_id AS session_id, user_id % 20 AS tag_id FROM events) JOIN mood_tags USING (tag_id)),
  pv AS (SELECT session_id, bo.* FROM play_history JOIN bo USING (track_id)),
  ow AS MATERIALIZED (SELECT session_id, a.q AS qa, l.q AS ql FROM {_mean("(SELECT session_id, av AS vector FROM pv)", "session_id")} a JOIN {_mean("(SELECT session_id, lv AS vector FROM pv)", "session_id")} l USING (session_id)),
  cl AS MATERIALIZED (SELECT cluster_id, a.q AS qa, l.q AS ql FROM {_mean("(SELECT cluster_id, av AS vector FROM bo)", "cluster_id")} a JOIN {_mean("(SELECT cluster_id, lv AS vector FROM bo)", "cluster_id")} l USING (cluster_id)),
  ps AS MATERIALIZED (SELECT session_id, tag_id, track_id, round(list_dot_product(av, qa), 9) AS a, round(list_dot_product(lv, ql), 9) AS l FROM rq JOIN ow USING (session_id) JOIN co USING (cluster_id)
    WHERE NOT EXISTS (SELECT 1 FROM play_history h WHERE h.session_id = rq.session_id AND h.track_id = co.track_id)),
  ot AS (SELECT * FROM rq WHERE session_id NOT IN (SELECT session_id FROM ow)),
  ge AS MATERIALIZED (SELECT cl.cluster_id, track_id, round(list_dot_product(av, qa), 9) AS a, round(list_dot_product(lv, ql), 9) AS l FROM co, cl WHERE cl.cluster_id IN (SELECT cluster_id FROM ot)),
  ht AS (SELECT * FROM {_fuse("session_id, tag_id", "ps")} UNION ALL SELECT session_id, tag_id, track_id, score FROM ot JOIN {_fuse("cluster_id", "ge")} USING (cluster_id)),
  kn AS (SELECT ht.*, artist, CASE WHEN {HIT_TIER} AND score >= 0.5 THEN 0 ELSE 1 END AS f FROM ht JOIN co USING (track_id)),
  an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tag_id, artist ORDER BY f, score DESC, track_id) AS rk FROM kn) WHERE rk = 1)
  SELECT session_id, tag_id, track_id, artist, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tag_id ORDER BY f, score DESC, track_id) AS rank FROM an) WHERE rank <= 5""")(
    lambda c: S.recommend_by_tag(
        c.table("events").select(F.col("user_id").alias("session_id"), (F.col("user_id") % 20).alias("tag_id")).distinct(), c.mood_tags(), c.tracks("track_id", "artist", "status", "popularity_category"), c.vectors("audio"), c.vectors("lyrics"), c.play_history(), 5
    ).withColumn("score", F.round("score", 6))
)


#: Line items of a task of the cascade.
LINES = 1 << 18


def _cascade(c: Catalog) -> DataFrame:
    # Requests and stages are dealt alike, by the request, over tasks that follow the line items: the joins move nothing more.
    tasks = max(1, -(-c.table("lineitem").count() // LINES))
    orders = c.table("orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", F.expr("repeat('la ', CAST(o_orderkey % 9 AS INT))")).alias("text"))
    return S.cascade(orders.repartition(tasks, "id"), _stage(c, 0, tasks), _stage(c, 1, tasks)).withColumn("candidate_id", F.coalesce("candidate_id", F.lit(-1)))


def _stage(c: Catalog, parity: int, tasks: int) -> DataFrame:
    """Decisions about orders by their largest line item of one parity."""
    rows = c.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity").filter(F.col("l_partkey") % 2 == parity).repartition(tasks, "l_orderkey")
    best = rows.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", "l_partkey")).alias("candidate_id"), F.max("l_quantity").alias("q"))
    return best.select(F.col("l_orderkey").alias("request_id"), "candidate_id", F.when(F.col("q") > 40, "high").when(F.col("q") > 20, "medium").otherwise("reject").alias("decision"))


_st = lambda p: f"(SELECT l_orderkey AS id, max_by(l_partkey, (l_quantity, l_partkey)) AS candidate_id, CASE WHEN max(l_quantity) > 40 THEN 'high' WHEN max(l_quantity) > 20 THEN 'medium' ELSE 'reject' END AS confidence FROM lineitem WHERE l_partkey % 2 = {p} GROUP BY 1)"
query("q08_search_cascade", f"""SELECT id, coalesce(CASE WHEN a.confidence <> 'reject' THEN a.candidate_id WHEN b.confidence <> 'reject' THEN b.candidate_id END, -1) AS candidate_id,
  CASE WHEN a.confidence <> 'reject' THEN a.confidence WHEN b.confidence <> 'reject' THEN b.confidence WHEN length(trim(t)) >= 20 THEN 'low' ELSE 'none' END AS confidence,
  CASE WHEN a.confidence <> 'reject' THEN 'stage_1' WHEN b.confidence <> 'reject' THEN 'stage_2' WHEN length(trim(t)) >= 20 THEN 'asr_fallback' ELSE 'not_found' END AS source
  FROM (SELECT o_orderkey AS id, o_orderpriority || ' ' || repeat('la ', (o_orderkey % 9)::INT) AS t FROM orders) LEFT JOIN {_st(0)} a USING (id) LEFT JOIN {_st(1)} b USING (id)""")(
    _cascade
)
query("w08_first_variant", "SELECT p_partkey, array_to_string(list_filter(ns, lambda x, i: trim(x) <> '' AND list_position(ks, lower(trim(x))) = i), '|') AS names FROM (SELECT *, list_transform(ns, lambda x: lower(trim(x))) AS ks FROM (SELECT p_partkey, [p_name, upper(p_name), ' ' || p_brand || ' ', '', p_type, p_brand] AS ns FROM part))")(
    lambda c: c.table("part").select("p_partkey", F.array_join(S.first_variants(F.array(F.col("p_name"), F.upper("p_name"), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit(""), F.col("p_type"), F.col("p_brand"))), "|").alias("names"))
)
CHUNK = "(SELECT doc_id AS id, unnest(range(0, ceil(n / 256)::BIGINT)) AS chunk FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents))"
query("x29_chunk_means", f"""SELECT d.doc_id AS id, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM documents d LEFT JOIN (SELECT id, max(n) AS n, sum(x) AS total FROM (SELECT id, pos, avg(x) AS x, count(*) AS n FROM
  (SELECT id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM {CHUNK} JOIN embeddings ON vec_id = (id + 7 * chunk) % 100) GROUP BY ALL) GROUP BY 1) m ON m.id = d.doc_id""")(
    lambda c: _chunk_means(c).select("id", F.col("n").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
)


def _chunk_means(c: Catalog) -> DataFrame:
    texts = c.table("documents").select(F.col("doc_id").alias("id"), "text")
    vectors = c.table("embeddings").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return S.chunk_means(texts, S.chunks(texts).withColumn("k", (F.col("id") + 7 * F.col("chunk")) % 100).join(vectors, "k").select("id", "chunk", "vector"), 64)


query("s05_model_stats", "SELECT track_id, round(list_sum(list_transform(vector, lambda x, i: (x - m[i]) / s[i])), 4) AS total FROM audio_vectors, (SELECT list(round(mean, 6) ORDER BY pos) AS m, list(CASE WHEN round(std, 6) < 1e-8 THEN 1 ELSE round(std, 6) END ORDER BY pos) AS s FROM (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM audio_vectors) GROUP BY 1))")(
    lambda c: _normalized_by_stats(c)
)


def _normalized_by_stats(c: Catalog) -> DataFrame:
    """The fitted means and deviations as a JSON side table of one row per position, read back and applied."""
    rows = c.vectors("audio").select("track_id", F.posexplode("vector").alias("pos", "x"))
    fit = rows.groupBy("pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))
    side = fit.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s")).select(F.to_json(F.struct(F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))).alias("value"))
    stats = S.model_stats(side)
    done = rows.join(F.broadcast(stats), "pos").withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))
    return done.groupBy("track_id").agg(F.round(F.sum("z"), 4).alias("total"))


# --- sources ---------------------------------------------------------------------------------------------------------------


def _library(c: Catalog) -> DataFrame:
    path = shared_dir(c.spark)
    url = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("http://media.example/"), "p_partkey"))
    c.table("part").select(F.col("p_brand").alias("artist"), F.concat(F.lit('a "quoted", '), "p_name").alias("title"), url.alias("URL")).write.csv(path, header=True, escape='"')
    return P.library_csv(c.spark, path)


def _centroids(c: Catalog) -> DataFrame:
    """The clusters' joined centroids as a side document, written, read back and used to assign; nothing is assigned without the document."""
    path = shared_dir(c.spark)
    one = c.vectors("audio").select("cluster_id", F.posexplode("vector").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.round(F.avg("x"), 6).alias("x"))
    rows = one.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("cluster_id", F.transform("v", lambda x: x["x"]).alias("v"))
    rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster_id", "v"))).alias("c")).select(F.col("c.v").alias("centroids")).write.json(path)
    read = P.centroids_json(c.spark, path)
    missing = P.centroids_json(c.spark, path + "-none")
    scored = c.vectors("audio").select("track_id", "vector").join(F.broadcast(read.unionByName(missing)))  # as many as a catalog has clusters
    dot = F.round(F.aggregate(F.zip_with("vector", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
    return scored.groupBy("track_id").agg(F.max_by("position", F.struct(dot, -F.col("position"))).cast("long").alias("nearest"))


query("s05_centroids", """, m AS (SELECT cluster_id, list(x ORDER BY pos) AS v FROM (SELECT cluster_id, pos, round(avg(x), 6) AS x FROM (SELECT cluster_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM audio_vectors) GROUP BY ALL) GROUP BY 1),
  n AS (SELECT row_number() OVER (ORDER BY cluster_id) - 1 AS position, v FROM m)
  SELECT track_id, arg_max(position, (round(list_dot_product(vector, v), 6), -position)) AS nearest FROM audio_vectors, n GROUP BY 1""")(_centroids)


def _catalog(c: Catalog) -> DataFrame:
    path = shared_dir(c.spark)
    own = c.mood_tags().groupBy("cluster_id").agg(F.collect_list(F.struct(F.col("tag_id").alias("id"), "name", "cluster_id")).alias("tags"))
    own.select(F.array(F.struct(F.col("cluster_id").alias("id"), F.concat(F.lit("cluster "), "cluster_id").alias("name"))).alias("clusters"), "tags").write.json(path)
    clusters, tags = (a.unionByName(b) for a, b in zip(P.catalog_json(c.spark, path, lines=True), P.catalog_json(c.spark, path + "-none"), strict=True))
    return tags.withColumnRenamed("name", "tag").join(clusters.withColumnRenamed("id", "cluster_id"), "cluster_id")


query("s06_library_csv", """SELECT p_brand AS artist, 'a "quoted", ' || p_name AS title, 'http://media.example/' || p_partkey AS "URL" FROM part WHERE p_partkey % 3 <> 0""")(_library)
query("s04_catalog_json", "SELECT tag_id AS id, name AS tag, cluster_id, 'cluster ' || cluster_id AS name FROM mood_tags")(_catalog)
def _topics(c: Catalog) -> DataFrame:
    """Events as messages of the four topics: some broken, some without a field that they must have; counted by topic and error."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = c.table("events").select(F.col("event_id").alias("id"), "user_id", "event_type", k.alias("k"))
    key = F.when(F.col("k") % 5 != 0, F.concat(F.lit("up/"), "k"))
    bodies = {
        "jobs": F.struct(F.col("user_id").alias("job_id"), key.alias("mp3_key")), "progress": F.struct(F.col("user_id").alias("job_id"), F.when(F.col("k") % 3 != 0, F.col("event_type")).alias("status"), F.col("k").alias("progress")),
        "rec.index": F.struct(F.col("k").alias("track_id"), key.alias("mp3_key"), F.lit("la").alias("lyrics")), "rec.indexed": F.struct(F.when(F.col("k") % 7 != 0, F.col("user_id")).alias("track_id"), F.col("k").alias("rec_cluster_id")),
    }
    out = None
    for topic, body in bodies.items():
        m = e.select("id", F.when(F.col("id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(body)).alias("value"))
        rows = Z.read_topic(m, topic)
        first = rows.columns[1]
        one = rows.groupBy(F.lit(topic).alias("topic"), F.coalesce("rejected", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.coalesce(F.sum(first), F.lit(0)).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


_t = lambda topic, first, bad: f"SELECT '{topic}' AS topic, CASE WHEN event_id % 11 = 0 THEN 'broken' WHEN {bad} THEN 'missing' ELSE '' END AS error, count(*) AS n, coalesce(sum(CASE WHEN event_id % 11 <> 0 THEN {first} END), 0)::BIGINT AS ids FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY ALL"
query("s07_topics", " UNION ALL ".join([_t("jobs", "user_id", "k % 5 = 0"), _t("progress", "user_id", "k % 3 = 0"), _t("rec.index", "k", "k % 5 = 0"), _t("rec.indexed", "CASE WHEN k % 7 <> 0 THEN user_id END", "k % 7 = 0")]))(_topics)
query("f17_validated", "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'status' WHEN o_orderkey % 4 = 0 THEN 'total' ELSE '' END AS error FROM orders")(
    lambda c: U.validated(
        c.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.concat("o_totalprice", F.lit("x"))).otherwise(F.col("o_totalprice").cast("string")).alias("total")), {"total": "double"}, {"status": ("O", "P")}
    ).select("o_orderkey", F.coalesce("error", F.lit("")).alias("error"))
)
SQL["x27_merge_json"] = BIND + "SELECT event_id, 'a=' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END || ',b=' || user_id || CASE WHEN event_id % 2 = 0 THEN ',c=1' ELSE '' END AS merged FROM events"


@query("x27_merge_json")
def _merged(c: Catalog) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.col("user_id").cast("string"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("1"))).otherwise(F.expr("CAST(map() AS map<string, string>)"))
    merged = F.array_sort(F.transform(F.map_entries(X.merge_json(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return c.table("events").select("event_id", F.array_join(merged, ",").alias("merged"))
