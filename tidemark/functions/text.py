"""Text predicates and scalars.  Patterns are column literals with (?U), so word
characters are Unicode ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that retrieval ignores.
STOPWORDS = (
    "a an and are as at be by can could did do does for from has have how i in is "
    "it its me my of on or our please s should t that the this to us was we were "
    "what when where which who why will with would you your"
).split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0)


def terms(text: Column) -> Column:
    """Lower-cased words without stopwords; repeats are kept."""
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def token_count(text: Column) -> Column:
    """Words and punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")).cast("long")


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def grounded(value: Column, text: Column) -> Column:
    """The value appears in the text, whatever case, spaces and punctuation."""
    return (F.length(squash(value)) > 0) & F.contains(squash(text), squash(value))


def phrase_pattern(phrase: Column) -> Column:
    """Whole-phrase pattern with flexible white space; null for a blank phrase."""
    parts = F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != "")
    quoted = F.transform(parts, lambda w: F.regexp_replace(w, r"([^\w\s])", r"\\$1"))
    body = F.array_join(quoted, r"\s+")
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"(?iU)(?<!\w)"), body, F.lit(r"(?!\w)")))


def mentions(text: Column, phrase: Column) -> Column:
    return F.coalesce(F.rlike(text, phrase_pattern(phrase)), F.lit(False))


def names(text: Column, entity: Column) -> Column:
    """The entity as a whole word; a hyphen counts as part of a word."""
    quoted = F.regexp_replace(F.lower(entity), r"([^\w\s])", r"\\$1")
    return F.rlike(F.lower(text), F.concat(F.lit(r"(?U)(?<![\w-])"), quoted, F.lit(r"(?![\w-])")))


def slot_key(entity: Column, attribute: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r'["\\]', ""))), r"\s+", "-")

    return F.concat(norm(entity), F.lit("/"), F.translate(norm(attribute), "-", "_"))


def names_slot(text: Column, slot: Column) -> Column:
    """The slot's entity is named and every word of its attribute begins a word."""
    entity, attribute = F.element_at(F.split(slot, "/"), 1), F.element_at(F.split(slot, "/"), 2)
    have = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    want = F.regexp_extract_all(F.lower(attribute), F.lit("[a-z0-9]+"), 0)
    all_begin = F.forall(want, lambda a: F.exists(have, lambda w: F.startswith(w, a)))
    return F.when(F.contains(slot, F.lit("/")), names(text, entity) & all_begin).otherwise(False)
