"""Stems and sound codes of words, as rule machines of Spark expressions. Apply them to distinct words.

english_stem() is the English (Porter2) stemmer, russian_stem() the Russian one, both of the Snowball family; metaphone() is the
classic sound code of English. Each rule table is tried from its longest suffix on; the first suffix that fits decides, whether or not its
condition holds. A step's value is bound once, so that expressions stay as long as the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _table(w: Column, rules: list[tuple[str, str, Callable[[Column, int], Column] | None]]) -> Column:
    """rules: suffix, what replaces it, a condition on the word and the suffix's length."""
    branches = []
    for suffix, by, holds in sorted(rules, key=lambda r: -len(r[0])):
        changed = F.concat(_less(w, len(suffix)), F.lit(by))
        branches.append((w.endswith(suffix), changed if holds is None else F.when(holds(w, len(suffix)), changed).otherwise(w)))
    return reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(branches), w)


#: English words with stems of their own, and words that end after step 1a.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOPPED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes of steps 2 to 4, and what replaces them.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
SHORT = r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_VOWEL = "[aeiouy]"


def _regions(w: Column) -> tuple[Column, Column]:
    """Where R1 and R2 begin."""
    pattern = r"^[^aeiouy]*[aeiouy]+[^aeiouy]"
    special = F.regexp_extract(w, "^(?:gener|commun|arsen)", 0)

    def behind(x: Column) -> Column:
        found = F.length(F.regexp_extract(x, pattern, 0))
        return F.when(found > 0, found).otherwise(F.length(x))

    r1 = F.when(special != "", F.length(special)).otherwise(behind(w))
    return r1, r1 + behind(F.substring(w, r1 + 1, F.length(w)))


def _english(word: Column) -> Column:
    word = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")

    def steps(s: Column) -> Column:
        r1, r2 = (lambda w, n: F.length(w) - n >= s["r1"]), (lambda w, n: F.length(w) - n >= s["r2"])
        before = lambda letters: (lambda w, n: r1(w, n) & F.substring(w, F.length(w) - n, F.lit(1)).isin(*letters))

        def step1a(w: Column) -> Column:
            short = lambda w, n: F.length(w) - n > 1
            ie = lambda x: F.when(short(w, 3), F.concat(_less(w, 3), F.lit("i"))).otherwise(F.concat(_less(w, 3), F.lit("ie")))
            return (
                F.when(w.endswith("sses"), _less(w, 2)).when(w.endswith("ied") | w.endswith("ies"), ie(w)).when(w.endswith("us") | w.endswith("ss"), w)
                .when(w.rlike(f"{_VOWEL}.+s$"), _less(w, 1)).otherwise(w)
            )

        def step1b(w: Column) -> Column:
            suffix = F.regexp_extract(w, "(?:eedly|eed|ingly|edly|ing|ed)$", 0)
            stem = F.substring(w, F.lit(1), F.length(w) - F.length(suffix))

            def ending(x: Column) -> Column:
                doubled = x.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
                short = (s["r1"] >= F.length(x)) & x.rlike(SHORT)
                return F.when(x.rlike("(?:at|bl|iz)$") | (~doubled & short), F.concat(x, F.lit("e"))).when(doubled, _less(x, 1)).otherwise(x)

            eed = F.when(F.length(stem) >= s["r1"], F.concat(stem, F.lit("ee"))).otherwise(w)
            return F.when(suffix == "", w).when(suffix.startswith("eed"), eed).when(stem.rlike(_VOWEL), bound(stem, ending)).otherwise(w)

        step2 = lambda w: _table(w, [(a, b, r1) for a, b in STEP2.items()] + [("ogi", "og", before("l")), ("li", "", before("cdeghkmnrt"))])
        step3 = lambda w: _table(w, [(a, b, r1) for a, b in STEP3.items()] + [("ative", "", lambda w, n: r1(w, n) & r2(w, n))])
        ion = lambda w, n: r2(w, n) & F.substring(w, F.length(w) - n, F.lit(1)).isin("s", "t")
        step4 = lambda w: _table(w, [(a, "", r2) for a in STEP4] + [("ion", "", ion)])
        final_e = lambda w, n: r2(w, n) | (r1(w, n) & ~_less(w, 1).rlike(SHORT))
        final_l = lambda w, n: r2(w, n) & w.endswith("ll")
        step5 = lambda w: _table(w, [("e", "", final_e), ("l", "", final_l)])
        rest = (step1b, lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"), step2, step3, step4, step5)
        first = bound(F.regexp_replace(s["w"], "(?:'s'|'s|')$", ""), step1a)
        return bound(first, lambda w: F.lower(F.when(w.isin(*STOPPED), w).otherwise(reduce(bound, rest, w))))

    def start(w: Column) -> Column:
        r1, r2 = _regions(w)
        return F.struct(w.alias("w"), r1.alias("r1"), r2.alias("r2"))

    return bound(bound(word, start), steps)


def english_stem(word: Column) -> Column:
    """word: in lower case."""
    own = F.create_map(*(F.lit(x) for pair in EXCEPTIONS.items() for x in pair))
    plain = F.translate(word, "’‘", "''")
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(F.try_element_at(own, plain), _english(plain)))


#: Russian endings; in those of the first kind а or я stands before, within the word's region.
_A = "(?<=[ая])"
GERUND = f"(?:{_A}(?:вшись|вши|в)|ившись|ивши|ив|ывшись|ывши|ыв)$"
REFLEXIVE = "(?:ся|сь)$"
ADJECTIVE = "(?:ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)$"
PARTICIPLE = f"(?:{_A}(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$"
VERB = (
    f"(?:{_A}(?:ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)"
    "|ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)$"
)
NOUN = "(?:иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)$"


def russian_stem(word: Column) -> Column:
    """word: in lower case; ё counts as е."""
    plain = F.translate(word, "ё", "е")

    def behind(x: Column, pattern: str) -> Column:
        return F.regexp_extract(x, pattern, 1)

    def steps(s: Column) -> Column:
        """s: what stands before the region, the region, and how long R2 is."""

        def ending(x: Column) -> Column:
            adjective = bound(F.regexp_replace(x, ADJECTIVE, ""), lambda y: F.regexp_replace(y, PARTICIPLE, ""))
            return F.when(x.rlike(ADJECTIVE), adjective).when(x.rlike(VERB), F.regexp_replace(x, VERB, "")).otherwise(F.regexp_replace(x, NOUN, ""))

        rv = s["rv"]
        one = F.when(rv.rlike(GERUND), F.regexp_replace(rv, GERUND, "")).otherwise(bound(F.regexp_replace(rv, REFLEXIVE, ""), ending))

        def further(x: Column) -> Column:
            x = F.regexp_replace(x, "и$", "")
            in_r2 = lambda y, n: F.length(s["head"]) + F.length(y) - n >= s["r2"]
            three = lambda y: F.when(y.endswith("ость") & in_r2(y, 4), _less(y, 4)).when(y.endswith("ост") & in_r2(y, 3), _less(y, 3)).otherwise(y)
            four = lambda y: F.when(y.rlike("нн$"), _less(y, 1)).when(y.rlike("ейше?$"), F.regexp_replace(F.regexp_replace(y, "ейше?$", ""), "нн$", "н")).otherwise(F.regexp_replace(y, "ь$", ""))
            return bound(bound(x, three), four)

        return F.concat(s["head"], bound(one, further))

    def start(w: Column) -> Column:
        head = F.regexp_extract(w, "^[^аеиоуыэюя]*[аеиоуыэюя]", 0)
        region = "^[^аеиоуыэюя]*[аеиоуыэюя]+[^аеиоуыэюя](.*)$"
        r2 = behind(behind(w, region), region)
        # Without a second region nothing is in it.
        return F.struct(head.alias("head"), F.substring(w, F.length(head) + 1, F.length(w)).alias("rv"), F.when(r2 != "", F.length(w) - F.length(r2)).otherwise(F.length(w) + 1).alias("r2"))

    return F.when(plain.rlike("[аеиоуыэюя]"), bound(bound(plain, start), steps)).otherwise(plain)


def stem(word: Column, language: str | None) -> Column:
    """By language (en, ru); a word of another one is its own stem."""
    return {"en": english_stem, "ru": russian_stem}.get(language or "", lambda w: w)(word)


#: Letters whose code doesn't depend on their neighbours.
CODES = {"f": "F", "j": "J", "l": "L", "m": "M", "n": "N", "q": "K", "r": "R", "v": "F", "x": "KS", "z": "S"}


def metaphone(word: Column) -> Column:
    """Upper-case code of a word of letters a to z; others give an empty one. Doubled letters but c count once; 0 is the sound of th."""

    def code(w: Column) -> Column:
        def at(i: Column) -> Column:
            c, before, after = F.substring(w, i, F.lit(1)), F.when(i > 1, F.substring(w, i - 1, F.lit(1))).otherwise(""), F.substring(w, i + 1, F.length(w))
            vowel = lambda x: x.rlike("^[aeiou]")
            last = after == ""
            to = F.when(c.isin("a", "e", "i", "o", "u"), F.when(i == 1, F.upper(c)).otherwise(""))
            to = to.when(c == "b", F.when(last & (before == "m"), "").otherwise("B"))
            to = to.when(
                c == "c",
                F.when(after.startswith("ia") | (after.startswith("h") & (before != "s")), "X").when(after.rlike("^[iey]"), F.when(before == "s", "").otherwise("S")).otherwise("K"),
            )
            to = to.when(c == "d", F.when(after.rlike("^g[eiy]"), "J").otherwise("T"))
            to = to.when(
                c == "g",
                F.when(after.rlike("^h[^aeiou]") | after.rlike("^n(?:ed)?$") | ((before == "d") & after.rlike("^[eiy]")), "").when(after.rlike("^[eiy]"), "J").otherwise("K"),
            )
            to = to.when(c == "h", F.when(vowel(after) & ~before.isin("c", "s", "p", "t", "g"), "H").otherwise(""))
            to = to.when(c == "k", F.when(before == "c", "").otherwise("K"))
            to = to.when(c == "p", F.when(after.startswith("h"), "F").otherwise("P"))
            to = to.when(c == "s", F.when(after.startswith("h") | after.rlike("^i[ao]"), "X").otherwise("S"))
            to = to.when(c == "t", F.when(after.rlike("^i[ao]"), "X").when(after.startswith("h"), "0").when(after.startswith("ch"), "").otherwise("T"))
            to = to.when(c.isin("w", "y"), F.when(vowel(after), F.upper(c)).otherwise(""))
            for letter, sign in CODES.items():
                to = to.when(c == letter, sign)
            return to.otherwise("")

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), at), "")

    once = F.regexp_replace(F.lower(word), r"([abd-z])\1+", "$1")
    begun = F.regexp_replace(F.regexp_replace(F.regexp_replace(once, "^(?:[kgp]n|wr|ae)", "#$0"), "^#.", ""), "^wh", "w")
    begun = F.regexp_replace(begun, "^x", "s")
    return F.when(F.lower(word).rlike("^[a-z]+$"), bound(begun, code)).otherwise("")
