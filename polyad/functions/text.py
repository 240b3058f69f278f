"""Scalar functions as Spark expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before a name, in the spelling of normalised text.
ROLE_TITLES = (
    r"senador[ae]?s?|diputad[oa]s?|ministr[oa]s?|subsecretari[oa]s?|"
    r"alcald[ea]s?a?|concejal[ae]?s?|gobernador[ae]?s?|intendent[ae]s?|seremis?|"
    r"president[ae]s?|vicepresident[ae]s?|canciller(?:es)?|contralor[ae]?s?|fiscal(?:es)?|"
    r"candidat[oa]s?|excandidat[oa]s?|general(?:es)?|don|dona|"
    r"el|la|los|las"
)
ROLE_PREFIX = rf"(?i)^(?:(?:ex[\s-]?)?(?:ex\s+)?(?:{ROLE_TITLES})\s+)+"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with a canonical decomposition that starts with another letter, and those letters."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        rest = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if len(rest) == 1 and rest != c:
            pairs.append((c, rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize(c: Column) -> Column:
    """Lower case, no accents, no punctuation, trimmed; spaces inside stay as they are."""
    a, b = _folding()
    bare = F.regexp_replace(F.translate(F.lower(c), a, b), r"\p{Mn}", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", ""), r"^\s+|\s+$", "")


def strip_role(c: Column) -> Column:
    """A normalised name without the titles before it."""
    return F.trim(F.regexp_replace(c, ROLE_PREFIX, ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def last_token(c: Column) -> Column:
    return F.try_element_at(tokens(c), F.lit(-1))


def try_date(c: Column) -> Column:
    """A date from text that starts with year, month and day; null for anything else."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))


def half_year(year: Column, date: Column) -> Column:
    """``YYYY-H1`` or ``YYYY-H2``; an unknown date falls in the second half, an unknown year gives null."""
    return F.concat(year.cast("int").cast("string"), F.lit("-H"), F.when(F.month(date) <= 6, "1").otherwise("2"))


def period(date: Column, granularity: str = "year", year: Column | None = None) -> Column:
    """The period of a date: ``half`` or ``year``."""
    if granularity == "half":
        return half_year(year if year is not None else F.year(date), date)
    if granularity == "year":
        return F.year(date).cast("string")
    raise ValueError(f"no such granularity: {granularity}")


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def sign(polarity: Column) -> Column:
    """+1, -1, or 0 for anything but positive and negative."""
    return F.when(polarity == "positive", 1).when(polarity == "negative", -1).otherwise(0)


def md5_rank(c: Column) -> Column:
    """A portable random order: the first 12 hex digits of the MD5, in order as text."""
    return F.substring(F.md5(c), 1, 12)


def hash_fraction(c: Column) -> Column:
    """A portable uniform fraction in [0, 1) in steps of 1/100000."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(100_000)) / F.lit(100_000.0)


def alternation(names: list[str]) -> str:
    """One group that matches any of the names, the first listed first; no word bounds."""
    return "(" + "|".join(re.escape(n) for n in names) + ")"


def bounded_alternation(names: list[str]) -> str:
    return r"(?<![\p{L}\p{N}_])" + alternation(names) + r"(?![\p{L}\p{N}_])"


def python_strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def find(body: Column, text: Column) -> Column:
    """Zero-based place of the first occurrence, -1 if there is none."""
    return F.instr(body, text) - 1


def char_span(body: Column, text: Column) -> Column:
    """(start, end) of the first occurrence, null if there is none."""
    at = find(body, text)
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(text)).alias("end")))


def word_chunks(c: Column, words: Column, max_words: int = 300, overlap: int = 30) -> Column:
    """(chunk, offset) per window of words; a text of at most ``max_words`` words comes unchanged.

    ``words`` must be a column of tokens made before, or else each window splits the text anew.
    """
    step = max_words - overlap
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(max_words)), " ").alias("chunk"), i.alias("word_offset")))
    return F.when(F.size(words) <= max_words, F.array(F.struct(c.alias("chunk"), F.lit(0).alias("word_offset")))).otherwise(cut)


def strip_fence(c: Column) -> Column:
    """JSON text without a Markdown fence around it."""
    text = python_strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"\n```$", "")
    return F.when(text.startswith("```"), inner).otherwise(text)


def clean_text(c: Column, boilerplate: list[str] | None = None) -> Column:
    """Without the given passages, and with runs of white space as one space."""
    for b in boilerplate or []:
        c = F.replace(c, F.lit(b), F.lit(""))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Spellings of polarities.
POLARITY_FORMS = {"positive": ("positive", "positivo", "positiva", "+1", "1", "+"), "negative": ("negative", "negativo", "negativa", "-1", "-"), "neutral": ("neutral", "neutro", "neutra", "0")}


def canonical_polarity(c: Column) -> Column:
    """The polarity a spelling stands for, null for any other."""
    text, out = F.lower(F.trim(c)), F.lit(None).cast("string")
    for name, forms in POLARITY_FORMS.items():
        out = F.when(text.isin(*forms), name).otherwise(out)
    return out


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    """F-score; 0 where it isn't defined."""
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def selection_score(f05: Column, distractor_fp: Column, recall: Column, fp_penalty: float, recall_penalty: float, recall_floor: float = 0.80) -> Column:
    """F0.5 less penalties for false positives on distractors and for recall under its floor."""
    return f05 - fp_penalty * distractor_fp - recall_penalty * F.greatest(F.lit(0.0), F.lit(recall_floor) - recall)
