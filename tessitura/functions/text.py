"""Text functions over string columns, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowels and signs that a skeleton leaves out.
LATIN_VOWELS = "aeiouy"
CYRILLIC_VOWELS = "аеёиоуыэюяьъй"
FOLD = ("áàâäãåçéèêëíìîïñóòôöõúùûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys")


def clean_for_match(text: Column) -> Column:
    """Lower case; bracketed parts, short parts in parentheses, digits by themselves and punctuation but apostrophes go; one space
    between words."""
    out = F.lower(text)
    for pattern, by in ((r"\[[^\]]*\]", " "), (r"\([^)]{1,30}\)", " "), (r"(?<![\p{L}\p{N}_])\p{N}+(?![\p{L}\p{N}_])", " "), (r"[^\p{L}\p{N}_'\s]", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def skeleton(word: Column) -> Column:
    """Letters without vowels, accents folded."""
    letters = F.regexp_replace(F.translate(F.lower(word), *FOLD), r"[^\p{L}]", "")
    return F.translate(letters, LATIN_VOWELS + CYRILLIC_VOWELS, "")


#: Letters that sound alike, by their class; vowels, h and w have none.
SOUNDS = ("bfpvcgjkqsxzdtlmnr", "111122222222334556")


def phonetic_key(word: Column) -> Column:
    """The first letter and the classes of the others, one for each run; accents folded. Other scripts: empty."""
    letters = F.regexp_replace(F.translate(F.lower(word), *FOLD), r"[^\p{L}]", "")
    classes = F.regexp_replace(F.translate(F.substring(letters, F.lit(2), F.length(letters)), *SOUNDS), "[a-z]", "")
    return F.when(letters.rlike("^[a-z]+$"), F.concat(F.substring(letters, 1, 1), F.regexp_replace(classes, r"(\d)\1+", "$1"))).otherwise("")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; fewer tokens: none."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def length_penalty(candidate: Column, asked: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(F.log(candidate / asked)))


def composite(f1: Column, phonetic: Column, ngram: Column, anchor: Column, hint: Column, length: Column) -> Column:
    raw = 0.55 * f1 + 0.15 * phonetic + 0.10 * ngram + 0.20 * anchor + 0.30 * hint - 0.10 * length
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def decision(top: Column, gap: Column, chosen: Column) -> Column:
    """gap: null without a rival; chosen: whether a decisions table names this pair."""
    clear = gap.isNull() | (gap >= 0.05) | F.coalesce(chosen, F.lit(False))
    return F.when((top >= 0.65) & clear, "high").when(top >= 0.45, "medium").otherwise("reject")


#: An instruction to repeat a part that no rule has written out, in two languages.
INSTRUCTION = r"(?iu)(?<![\p{L}\p{N}_])(?:repeat|повтор[\p{L}\p{N}_]*|снова)\s+(?:chorus|verse|bridge|припев|куплет|бридж)"


def clean_lyrics(text: Column) -> Column:
    """Bracketed parts go, also across lines, and blanks around the text; a line that begins with closing punctuation or with blanks,
    or follows an opening bracket, joins the one before; two line feeds at most."""
    out = F.regexp_replace(text, r"(?s)\[.*?\]\n?", "")
    steps = ((r"^\s+|\s+$", ""), (r"\n+(?=[ \t]*[,.;:!?)\]…—–])", ""), (r"\n+(?=[ \t]+\S)", " "), (r"([(\[])[ \t]*\n+", "$1"), (r"\n{3,}", "\n\n"))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


def needs_rewrite(text: Column) -> Column:
    return text.rlike(INSTRUCTION)


def quoted_phrase_too_long(q: Column, words: int = 3) -> Column:
    return F.exists(F.regexp_extract_all(q, F.lit(r'"([^"]*)"'), F.lit(1)), lambda p: F.size(tokenize(p)) > words)


def merge_json(old: Column, new: Column) -> Column:
    """Maps; the new one's values win. A null old one counts as empty."""
    kept = F.map_filter(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def scaled_timeout(duration: Column, base: float) -> Column:
    return base * F.greatest(F.coalesce(duration, F.lit(180)) / 180.0, F.lit(0.5))


def db_to_linear(db: Column, peak: Column) -> Column:
    return peak * F.pow(F.lit(10.0), -db / 20)


def linear_to_db(x: Column) -> Column:
    return 20 * F.log10(x + 1e-10)
