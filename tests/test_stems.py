"""Stems against published examples, and sound codes against words that sound alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import stems
from tessitura.operators import textmatch as M

#: Words and stems, as published with the English stemmer.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consolidate consolid consolidated consolid consolidating consolid consolingly consol consols consol consonant conson consort consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir constable constabl constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
running run loved love hopping hop hoping hope flies fli dies die relational relat conditional condit happy happi cry cri by by say say hopeful hope goodness good adoption adopt
replacement replac controlling control cease ceas gas gas this this kiwis kiwi gaps gap skies sky dying die news news proceed proceed generously generous communism communism
agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size falling fall hissing hiss fizzed fizz filing file
sensational sensat digitizer digit operator oper feudalism feudal decisiveness decis callousness callous formality formal sensitivity sensit electrical electr
triplicate triplic formalize formal analogousness analog effective effect probate probat rate rate roll roll yes yes youth youth boy's boy cats' cat skill skill""".split()

#: Words and stems, as published with the Russian stemmer.
RUSSIAN = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн важнейшие важн важничал важнича
важно важн важного важн важное важн важной важн важном важн важности важност важность важност важны важн важные важн важным важн важных важн
падать пада падают пада падая пад пай па пал пал палат палат палата палат палате палат палату палат палаты палат палец палец палка палк палку палк пальто пальт
памятник памятник памятника памятник память памя пара пар парень парен парижский парижск парк парк парке парк""".split()


def applied(spark, f, words):
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    return {r["w"]: r["s"] for r in frame.select("w", f(F.col("w")).alias("s")).collect()}


def test_english_stems(spark):
    got = applied(spark, stems.english_stem, ENGLISH[::2])
    want = dict(zip(ENGLISH[::2], ENGLISH[1::2], strict=True))
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_russian_stems(spark):
    got = applied(spark, stems.russian_stem, RUSSIAN[::2])
    want = dict(zip(RUSSIAN[::2], RUSSIAN[1::2], strict=True))
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_sounds(spark):
    same = [("night", "knight"), ("write", "right"), ("phone", "fone"), ("which", "wich"), ("xylo", "silo"), ("bass", "base"), ("judge", "juj"), ("gnome", "nome"), ("thumb", "thum")]
    want = {"thumb": "0M", "knight": "NT", "school": "SKL", "nation": "NXN", "church": "XRX", "science": "SNS", "catch": "KX", "bridge": "BRJ", "sign": "SN", "who": "W", "yellow": "YL", "ahead": "AHT", "accept": "AKSPT", "box": "BKS", "café": "", "": "", "don't": ""}
    got = applied(spark, stems.metaphone, [*want, *(w for p in same for w in p)])
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}
    assert [p for p in same if got[p[0]] != got[p[1]]] == []


def test_stems_and_sounds_are_used_by_the_match(spark):
    docs = spark.createDataFrame([(1, "running knights loved nights today again here there"), (2, "runs nite loving knight today again here there"), (3, "zebra quilt jumbo fax today again here there")], "id long, text string")
    rows = {(r["id"], r["word"]): (r["lemma"], r["phonetic"]) for r in M.word_rows(docs, language="en").collect()}
    assert rows[1, "running"][0] == rows[2, "runs"][0] == "run" and rows[1, "nights"][1] == "NTS"
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "request_id long, candidate_id long")
    score = lambda **k: {r["candidate_id"]: r["score"] for r in M.match_words(pairs, docs, docs, **k).collect()}
    assert score(language="en")[2] >= score()[2] > score()[3]
