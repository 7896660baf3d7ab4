"""What a line of a book is: predicates over its text, and over font and place where they count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

#: Words that open a letter, close one, or end a heading too early.
SALUTATIONS = ("dear", "my dear", "dearest", "to the", "sir", "madam")
CLOSINGS = ("yours truly", "yours faithfully", "yours sincerely", "sincerely", "faithfully yours", "your friend", "affectionately")
DANGLING = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\\p{L}]", ""))


def capital_share(c: Column) -> Column:
    """Capital letters among all letters; 0 without any."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, "[^\\p{Lu}]", "")), letters(c)), F.lit(0.0))


def all_caps(c: Column) -> Column:
    return (letters(c) >= 2) & (capital_share(c) == 1.0)


def dangling(c: Column) -> Column:
    """A heading that stops at a word which needs another."""
    return F.lower(F.element_at(F.concat(F.array(F.lit("")), T.words(c)), -1)).isin(*DANGLING)


def dialogue(c: Column) -> Column:
    return F.trim(c).rlike("^[\"“‘]")


def short_dialogue(c: Column, most: int = 60) -> Column:
    return dialogue(c) & (F.length(c) <= most) & F.trim(c).rlike("[\"”’]$")


def attribution(c: Column) -> Column:
    """A fragment such as 'he said.' after a quotation."""
    return F.lower(F.trim(c)).rlike("^(he|she|they|i|we|[a-z]+) (said|asked|cried|replied|answered|whispered|shouted)\\b[^.!?]*[.,!?]?$")


def salutation(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(" + "|".join(SALUTATIONS) + ")\\b.*[,:]$") & (F.length(c) <= 60)


def sign_off(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(" + "|".join(CLOSINGS) + "),?$")


def signature(c: Column) -> Column:
    return F.trim(c).rlike("^[A-Z][\\p{L}.]*( [A-Z][\\p{L}.]*){0,3}$")


def continues(line: Column, before: Column) -> Column:
    """Whether a line goes on with the sentence of the one before."""
    return before.isNotNull() & ~T.ends_sentence(before) & (line.rlike("^\\p{Ll}") | before.rlike("[,;:–—-]\\s*$"))


def heading_words(c: Column, most: int = 12) -> Column:
    """Short enough for a heading, without the mark of a sentence in it."""
    return (F.length(c) <= 80) & (F.size(T.words(c)).between(1, most)) & ~F.trim(c).rlike("[.!?;,]$")


def structural_heading(c: Column) -> Column:
    return heading_words(c) & T.chapter_label(c).isNotNull()


def display_title(c: Column, font: Column, body: Column, isolated: Column) -> Column:
    """A title by its looks: set large and by itself, or large in capitals."""
    return heading_words(c) & (((font >= 1.15 * body) & isolated) | ((font >= 1.3 * body) & all_caps(c)))


def isolated(above: Column, below: Column, threshold: Column) -> Column:
    return F.coalesce((above > threshold) & (below > threshold), F.lit(False))


def contents_line(c: Column) -> Column:
    return F.trim(c).rlike("^(?i)(table of )?contents$") | c.rlike("\\.{3,}\\s*[0-9]{1,4}$")


def author_line(c: Column) -> Column:
    return F.trim(c).rlike("^(?i)by\\s+\\p{L}") & (F.size(T.words(c)) <= 6)


def dedication(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(for|to|dedicated to|in memory of) ") & (F.length(c) <= 80) & ~T.ends_sentence(c)


def prose(c: Column) -> Column:
    return (F.size(T.words(c)) >= 6) & c.rlike("\\p{Ll}") & (capital_share(c) < 0.5)
