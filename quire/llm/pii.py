"""Personal data: patterns propose spans, validators confirm them, words close before them adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table

#: Code points before a span in which its context words count, what one adds, and the least score of an added kind.
NEAR, LIFT, LEAST = 40, 0.3, 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern (Java), a text without which it can't occur, score, context words, base or added."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    base: bool = True


#: (?:(?<![class])|\G) lets a match start only where a run of the class starts or where the last match ended. Within one
#: run any later start would match just as far, so leftmost matches are the same, but a long run is tried once, not at each
#: of its characters. Possessive groups (++) match the same as here nothing after them could take back what they hold, and
#: Java loops over them without recursion, however long the run.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "(?i)mail|contact|write|address"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, r"(?i)\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "(?i)card|visa|credit|payment|master"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)phone|\btel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", 0.7, "(?i)iban|account|bank|konto", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)\bssn\b|social|security", False),
    Kind("key", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[A-Za-z0-9]{24}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_])", "", 0.9, "(?i)key|token|secret", False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])", "", 0.3, r"(?i)token|secret|passw|\bpwd\b|api.?key|\bauth|bearer|credential|private.?key", False),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = lambda i: F.substr(digits, -i, F.lit(1))
    worth = lambda i: F.when(i % 2 == 0, F.translate(at(i), "0123456789", "0246813579")).otherwise(at(i)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, are 1 modulo 97."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed match of a kind is valid."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(text, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(10, 15)
    if kind == "secret":  # a word or a number is none; what is drawn at random has many different characters
        return (F.size(F.array_distinct(F.split(text, ""))) >= 8) & text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    if kind == "iban":
        return mod97(F.replace(text, F.lit(" "), F.lit("")))
    return F.lit(True)


SPANS = "array<struct<start:long,at:int,end:long,kind:string,score:double>>"
PARTS = "array<struct<before:int,near:string,found:string>>"


def parts_of(kind: Kind, text: Column, matches: Column) -> Column:
    """For each match the length of what is between it and the one before it, the end of that, and the match itself.

    The pieces between matches come from split() by the same pattern, so lengths of pieces and matches add up to positions.
    """
    pieces = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    part = lambda piece, found: F.struct(F.length(piece).alias("before"), F.right(piece, F.lit(NEAR)).alias("near"), found.alias("found"))
    return F.when(F.size(matches) > 0, F.zip_with(pieces, matches, part)).otherwise(F.array()).cast(PARTS)


def spans_of(kind: Kind, at: int, parts: Column) -> Column:
    """array<struct<start,at,end,kind,score>> of the valid matches, in code points, end exclusive.

    Positions are running sums. An array grows by being copied, so n matches are added up in blocks of about the root of n:
    first how much each block takes, then where each begins, then the matches within each.
    """
    n = F.size(parts)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.slice(parts, i * width + 1, width))
    takes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["before"] + F.length(x["found"])))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    begins = F.aggregate(takes, F.struct(zero.alias("upto"), none.alias("out")), lambda a, t: F.struct((a["upto"] + t).alias("upto"), F.concat(a["out"], F.array(a["upto"])).alias("out")), lambda a: a["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["upto"] + x["before"]
        end = start + F.length(x["found"])
        score = F.round(F.lit(kind.score) + F.when(x["near"].rlike(kind.context), LIFT).otherwise(0.0), 3)
        one = F.array(F.struct(start.alias("start"), F.lit(at).alias("at"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")))
        good = confirmed(kind.name, x["found"]) if kind.base else confirmed(kind.name, x["found"]) & (score >= LEAST)
        return F.struct(end.alias("upto"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).cast(SPANS).alias("out"))

    within = lambda block, begin: F.aggregate(block, F.struct(begin.alias("upto"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    return F.when(n > 0, F.flatten(F.zip_with(blocks, begins, within))).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS) -> DataFrame:
    """(doc_id, text, spans): one row per input row; spans is array<struct<start,at,end,kind,score>>, by start, then kind.

    Matches are leftmost and do not overlap within a kind; those that a validator refuses are dropped and not tried again.
    Base kinds stay whatever their score; added kinds need LEAST. Null text is empty and has no spans, ids may be null or
    repeated, an empty table gives no rows, and extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    proposed = [F.when(F.col("text").contains(k.hint), F.regexp_extract_all("text", F.lit(k.pattern), 0)).otherwise(none).alias(f"m{i}") for i, k in enumerate(kinds)]
    rows = rows.select("doc_id", "text", *proposed)
    parts = rows.select("doc_id", "text", *[parts_of(k, F.col("text"), F.col(f"m{i}")).alias(f"p{i}") for i, k in enumerate(kinds)])
    found = parts.select("doc_id", "text", *[spans_of(k, i, F.col(f"p{i}")).alias(f"s{i}") for i, k in enumerate(kinds)])
    return found.select("doc_id", "text", F.array_sort(F.concat(*[f"s{i}" for i in range(len(kinds))])).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS) -> DataFrame:
    """(doc_id, text), one row per input row: every span replaced by its kind in capitals and brackets.

    Of overlapping spans the first one counts. Null texts become empty, ids may be null or repeated, extra columns are
    ignored. Empty table: no rows.
    """
    found = find_pii(docs, id_col, text_col, kinds)

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substr(F.col("text"), acc["upto"] + 1, s["start"] - acc["upto"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        clear = s["start"] >= acc["upto"]
        return F.struct(F.when(clear, s["end"]).otherwise(acc["upto"]).alias("upto"), F.when(clear, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out"))
    return found.select("doc_id", F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["upto"] + 1))).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(said(of_base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
