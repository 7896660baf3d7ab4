"""Scalar text rules as Column expressions: they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the rules understand it.
BLANK = "[\\s\\x0B\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Number words.
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred")
#: Words that stay small within a title.
MINOR = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "so", "the", "to", "up", "yet")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def words(c: Column) -> Column:
    """The tokens between white space; an empty text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words, soft hyphens not counting as characters."""
    return F.size(words(F.replace(c, F.lit("\u00ad"), F.lit(""))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), f"{BLANK}+", "-"), "[^a-z0-9-]", "")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def match_key(c: Column) -> Column:
    """Letters and numbers of any script, case and quotes folded, single blanks."""
    folded = F.translate(F.lower(c), "‘’“”", "''\"\"")
    return squeezed(F.regexp_replace(folded, "[^\\p{L}\\p{N}]+", " "))


def without_nul(c: Column) -> Column:
    return F.translate(c, "\u0000", "")


def ends_sentence(c: Column) -> Column:
    return c.rlike("[.!?…][\"'’”)\\]]*\\s*$")


def joined_wrap(a: Column, b: Column) -> Column:
    """Two lines of one paragraph: a hyphen at the break goes before a small letter and within a word in capitals, stays
    before a capitalised part, and lines without one are joined by a blank."""
    stem = F.regexp_replace(a, "-\\s*$", "")
    broken = a.rlike("\\p{L}-\\s*$")
    capitals = a.rlike("(^|\\s)[A-Z]+-\\s*$") & b.rlike("^[A-Z]{2,}")
    return (
        F.when(broken & (b.rlike("^\\p{Ll}") | capitals), F.concat(stem, b)).when(broken & b.rlike("^\\p{Lu}"), F.concat(F.rtrim(a), b))
        .when((a == "") | (b == ""), F.concat(a, b)).otherwise(F.concat(F.rtrim(a), F.lit(" "), F.ltrim(b)))
    )


def letter_spaced(c: Column) -> Column:
    """Whether at least three tokens, and three fifths of all, are single characters."""
    tokens = words(c)
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return (single >= 3) & (single >= 0.6 * F.size(tokens))


def unspaced(c: Column) -> Column:
    """Letter-spaced text with runs of single characters fused, a blank kept between digits and others."""
    one = "(?<![^\\s])"
    apart = f"(?<={one}[^\\s\\d])\\s(?=[^\\s\\d](?![^\\s]))|(?<={one}\\d)\\s(?=\\d(?![^\\s]))"
    return F.when(letter_spaced(c), F.regexp_replace(c, apart, "")).otherwise(c)


def repaired(c: Column) -> Column:
    """Extracted text made plain: no NUL, soft hyphens or private-use signs, ligatures as letters, word breaks rejoined."""
    plain = F.regexp_replace(without_nul(c), "[\u00ad\ue000-\uf8ff]", "")
    for glyph, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        plain = F.replace(plain, F.lit(glyph), F.lit(letters))
    return squeezed(F.regexp_replace(plain, "(\\p{Ll})-\\s+(\\p{Ll})", "$1$2"))


def roman(c: Column) -> Column:
    """A standalone roman numeral of one to four letters, upper-cased without its point; else null."""
    bare = F.upper(F.regexp_replace(trimmed(c), "\\.$", ""))
    return F.when(bare.rlike("^(?=[IVXLC]{1,4}$)C{0,3}(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), bare)


def roman_value(c: Column) -> Column:
    """The number of a roman numeral: a smaller sign before a larger one counts against it."""
    value = lambda s: F.when(s == "I", 1).when(s == "V", 5).when(s == "X", 10).when(s == "L", 50).when(s == "C", 100).otherwise(0)
    signs = F.transform(F.split(c, ""), value)
    pairs = F.arrays_zip(signs.alias("a"), F.concat(F.slice(signs, 2, F.greatest(F.size(signs) - 1, F.lit(0))), F.array(F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0), lambda t, p: t + F.when(p["a"] < p["b"], -p["a"]).otherwise(p["a"]))


def spelled_value(c: Column) -> Column:
    """One to 199 in words, the parts between hyphens and blanks added; null if a part is no number word."""
    known = F.create_map(*[F.lit(x) for i, w in enumerate(UNITS) for x in (w, i + 1)], *[F.lit(x) for i, w in enumerate(TENS) for x in (w, 10 * (i + 2))])
    parts = F.transform(F.split(F.lower(trimmed(c)), "[\\s-]+"), lambda w: F.try_element_at(known, w))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.when(total.between(1, 199), total)


def ordinal_value(c: Column) -> Column:
    """A label's number from digits, a roman numeral or words."""
    bare = trimmed(c)
    return F.when(bare.rlike("^[0-9]{1,4}$"), bare.try_cast("int")).when(roman(bare).isNotNull(), roman_value(roman(bare))).otherwise(spelled_value(bare))


def chapter_label(c: Column) -> Column:
    """struct(kind, number, subtitle) of a line like 'Chapter 5 - The Fox'; null if it is none."""
    p = "(?i)^(chapter|part|volume|book)\\s+([0-9]{1,3}|[ivxlc]{1,4}|[a-z]+(?:-[a-z]+)?)\\b\\s*[.:—–-]*\\s*(.*)$"
    bare = squeezed(c)
    number = F.regexp_extract(bare, p, 2)
    made = F.struct(F.lower(F.regexp_extract(bare, p, 1)).alias("kind"), ordinal_value(number).alias("number"), F.regexp_extract(bare, p, 3).alias("subtitle"))
    return F.when(bare.rlike(p) & ordinal_value(number).isNotNull(), made)


def numeral_style(c: Column) -> Column:
    """arabic, roman or null for a chapter heading's number."""
    n = F.regexp_extract(squeezed(c), "(?i)^chapter\\s+(\\S+)", 1)
    return F.when(n.rlike("^[0-9]+"), "arabic").when(roman(n).isNotNull(), "roman")


def title_cased(c: Column) -> Column:
    """Text in capitals in title case: minor words small but first, roman numerals in capitals; other text as it is."""
    parts = F.transform(F.split(c, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*MINOR), F.lower(w)).when(roman(w).isNotNull() & (F.length(w) > 1), w).otherwise(F.initcap(F.lower(w))))
    return F.when(c.rlike("[A-Z]") & ~c.rlike("[a-z]"), F.array_join(parts, " ")).otherwise(c)


def book_cased(c: Column) -> Column:
    """Words as in a book's title: minor ones small but first and last, roman numerals in capitals, others with one capital;
    the parts of a word with hyphens each by themselves."""
    ws = words(c)
    last = F.size(ws) - 1

    def cased(w: Column, major: Column) -> Column:
        return F.when(~major & F.lower(w).isin(*MINOR), F.lower(w)).when(w.rlike("(?i)^[ivxlcdm]+$"), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))

    edge = lambda i: (i == 0) | (i == last)
    hyphened = lambda w, i: F.array_join(F.transform(F.split(w, "-"), lambda part, k: cased(part, (k == 0) | edge(i))), "-")
    return F.array_join(F.transform(ws, lambda w, i: F.when(F.contains(w, F.lit("-")), hyphened(w, i)).otherwise(cased(w, edge(i)))), " ")


def inferred_title(c: Column) -> Column:
    """A title found in a text: in title case, also where it is all in capitals."""
    bare = trimmed(c)
    shouted = bare.rlike("[A-Z]") & ~bare.rlike("[a-z]") & (F.length(F.regexp_replace(bare, "[^A-Za-z]", "")) >= 4)
    return book_cased(F.when(shouted, F.lower(bare)).otherwise(bare))


def page_number_line(c: Column) -> Column:
    return trimmed(c).rlike("^[-–—]?\\s*([0-9]{1,4}|[ivxlcIVXLC]{1,4})\\s*[-–—]?$")


def scene_break(c: Column) -> Column:
    """Two to five equal private-use ornaments, or stars."""
    bare = F.regexp_replace(c, f"{BLANK}+", "")
    return bare.rlike("^[\ue000-\uf8ff*]{2,5}$") & (F.size(F.array_distinct(F.split(bare, ""))) == 1)


def html_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def html_attribute(c: Column) -> Column:
    return F.replace(html_text(c), F.lit('"'), F.lit("&quot;"))


def upper_median(c: Column) -> Column:
    """Of an array: the element at half its length, rounded down, once sorted; 0 if it is empty."""
    return F.coalesce(F.get(F.sort_array(c), F.floor(F.size(c) / 2).cast("int")), F.lit(0))


def font_size(transform: Column) -> Column:
    return F.round(F.greatest(F.abs(transform[0]), F.abs(transform[3])), 2)


def affine(a: Column, b: Column) -> Column:
    """Product of two affine transforms of six numbers."""
    return F.array(
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]
    )


def fuzzy_title(a: Column, b: Column) -> Column:
    """Titles alike but for small slips: edit distance 4 at most, lengths 4 apart at most, 0.88 of the longer one equal."""
    x, y = title_key(a), title_key(b)
    longer, d = F.greatest(F.length(x), F.length(y)), F.levenshtein(x, y)
    return (x == y) | ((d <= 4) & (F.abs(F.length(x) - F.length(y)) <= 4) & (1 - d / longer >= 0.88))
