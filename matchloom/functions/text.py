"""Text to features, as Columns that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import settings
from matchloom.functions import vocab as V
from matchloom.functions.wordsearch import words_in

# Character classes and case folding cover all of Unicode.
_FOLD = "(?iuU)"
_EXACT = "(?U)"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_digit(c: Column) -> Column:
    return F.rlike(c, F.lit(_EXACT + r"\d"))


def strip(c: Column) -> Column:
    """Trims every kind of whitespace, which ``trim`` does not."""
    return F.regexp_replace(c, _EXACT + r"^\s+|\s+$", "")


def split_list(c: Column, separators: str = ",") -> Column:
    """A separated string as a list of trimmed, non-empty items; NULL gives an empty list."""
    parts = F.transform(F.split(c, separators), strip)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(text), 1, 10))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(blank_if_null(text), F.lit(V.TOKEN_PATTERN), F.lit(0))
    return F.transform(found, F.lower)


def _folded(text: Column) -> Column:
    """Lower case, with the four letters that only fold to ASCII letters folded too."""
    body = blank_if_null(text)
    return F.lower(F.when(F.rlike(body, F.lit("[ſKıİ]")), F.translate(body, "ſKıİ", "skii")).otherwise(body))


def _mentions(low: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def skills_in(text: Column, skills: list[str] = V.SKILLS) -> Column:
    """Vocabulary entries found anywhere in the text, inside words too."""
    return _let(F.lower(blank_if_null(text)), lambda low: F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in skills
    ])))


def skills_or_text(listed: Column, text: Column) -> Column:
    """The declared skills, lower-cased; without any, those the text mentions."""
    declared = F.array_distinct(F.transform(listed, lambda s: F.lower(strip(s))))
    return F.when(F.size(listed) > 0, declared).otherwise(skills_in(text))


def years_of_experience(text: Column) -> Column:
    """The first phrase, in order of how specific it is, that gives 1 to 59 years.

    Texts without a digit, or without what all phrases share, are not searched phrase by phrase.
    """
    body = blank_if_null(text)
    found = F.array(*[F.regexp_extract(body, _FOLD + p, 1) for p in V.YOE_PATTERNS])
    numbers = F.transform(found, lambda s: s.try_cast("int"))
    years = F.transform(numbers, lambda n: F.when(n >= 1900, settings.reference_year - n).otherwise(n))
    first = F.get(F.filter(years, lambda y: (y > 0) & (y < 60)), F.lit(0)).cast("double")
    return F.when(has_digit(body) & F.rlike(body, F.lit(_FOLD + V.YOE_SHARED)), first)


def title_words(text: Column) -> Column:
    """The words of seniority and the tier-one employers in the text: one search for ``seniority`` and ``company_tier``."""
    levels = [w for words in V.SENIORITY_WORDS.values() for w in words]
    return words_in(_folded(text), [*levels, *V.MID_WORDS, *V.TIER_ONE_EMPLOYERS])


def domain_words(text: Column) -> Column:
    """The words of all domains in the text, in one search."""
    return words_in(F.lower(blank_if_null(text)), [w for words in V.DOMAIN_WORDS.values() for w in words])


def _listed(found: Column, words: list[str]) -> Column:
    return F.arrays_overlap(found, _strings(words))


def seniority(text: Column, found: Column | None = None) -> Column:
    """The highest level whose titles occur; a level's regex runs only where its words do.

    ``found`` are the text's ``title_words`` where they are known.
    """
    body = blank_if_null(text)

    def choose(source: Column, has) -> Column:
        level = None
        for code, patterns in V.SENIORITY_PATTERNS:
            pattern = F.lit(_FOLD + "|".join(f"(?:{p})" for p in patterns))
            hit = has(source, V.SENIORITY_WORDS[code]) & F.rlike(body, pattern)
            level = F.when(hit, code) if level is None else level.when(hit, code)
        return level.when(has(source, V.MID_WORDS), V.MID).otherwise(V.UNKNOWN)

    return _let(_folded(body), lambda low: choose(low, _mentions)) if found is None else choose(found, _listed)


def coarse_seniority(text: Column) -> Column:
    """A posting's level by plain substrings; anything else is mid-level."""
    def choose(low: Column) -> Column:
        level = None
        for code, words in V.COARSE_SENIORITY_WORDS:
            hit = _mentions(low, words)
            level = F.when(hit, code) if level is None else level.when(hit, code)
        return level.otherwise(V.MID)

    return _let(F.lower(blank_if_null(text)), choose)


def domain(text: Column, found: Column | None = None) -> Column:
    """The domain with most of its words present; ties go to the earlier domain.

    ``found`` are the text's ``domain_words`` where they are known.
    """
    has = _mentions if found is None else _listed

    def hits(source: Column) -> Column:
        counts = []
        for place, (name, words) in enumerate(V.DOMAIN_WORDS.items()):
            n = sum((has(source, [w]).cast("int") for w in words), F.lit(0))
            counts.append(F.struct(n.alias("hits"), F.lit(-place).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*counts))

    best = _let(F.lower(blank_if_null(text)), hits) if found is None else hits(found)
    return _let(best, lambda b: F.when(b["hits"] > 0, b["name"]).otherwise(V.GENERAL_DOMAIN))


def company_tier(text: Column, found: Column | None = None) -> Column:
    """1 where a tier-one employer is named as an employer, not just mentioned; ``found`` as for ``seniority``."""
    names = "(?:" + "|".join(V.TIER_ONE_EMPLOYERS) + ")"
    pattern = "|".join(f"(?:{p.format(c=names)})" for p in V.EMPLOYER_CONTEXTS)
    known = V.TIER_ONE_EMPLOYERS
    named = _let(_folded(text), lambda low: _mentions(low, known)) if found is None else _listed(found, known)
    return (named & F.rlike(blank_if_null(text), F.lit(_FOLD + pattern))).cast("int")


def tenure_signal(years: Column) -> Column:
    depth = F.least(F.lit(1.0), F.log(years + 1.0) / F.log(F.lit(21.0)))
    return F.when(years > 0, depth).otherwise(0.0)


def role_mentions(text: Column) -> Column:
    found = F.regexp_count(blank_if_null(text), F.lit(_FOLD + V.ROLE_MENTION_PATTERN))
    return F.least(F.lit(V.MAX_ROLE_MENTIONS), found)


def gender_proxy(text: Column) -> Column:
    """Audit only: the first listed given name in the opening characters, or 'unknown'."""
    opening = F.substring(blank_if_null(text), 1, V.NAME_WINDOW)
    names = F.transform(F.regexp_extract_all(opening, F.lit(_EXACT + V.FIRST_NAME_PATTERN), F.lit(1)), F.lower)
    known = F.filter(names, lambda n: n.isin(V.MALE_NAMES + V.FEMALE_NAMES))
    return _let(F.get(known, F.lit(0)), lambda first: (
        F.when(first.isin(V.MALE_NAMES), "m").when(first.isNotNull(), "f").otherwise("unknown")
    ))


def country(text: Column, needles: list[tuple[str, str]]) -> Column:
    def choose(low: Column) -> Column:
        code = None
        for needle, value in needles:
            hit = F.contains(low, F.lit(needle))
            code = F.when(hit, value) if code is None else code.when(hit, value)
        return code.otherwise(V.OTHER_COUNTRY)

    return _let(F.lower(blank_if_null(text)), choose)


def preview(text: Column, chars: int = 140) -> Column:
    """Whitespace collapsed, cut to a length with an ellipsis."""
    flat = strip(F.regexp_replace(blank_if_null(text), _EXACT + r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("…"))
    return F.when(F.length(flat) <= chars, flat).otherwise(cut)


def first_words(text: Column, n: int = 20) -> Column:
    words = F.split(strip(blank_if_null(text)), _EXACT + r"\s+")
    more = F.when(F.size(words) > n, " …").otherwise("")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), more)
