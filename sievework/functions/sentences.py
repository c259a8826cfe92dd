"""Splitting texts into sentences, claims, units, chunks and anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Where texts are cut before they are split: no text is expected to hold it.
CUT = "\u0001"
#: All characters of the Unicode property White_Space, which (?U)\s matches.
WHITE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def split_at(text: Column, pattern: str, insert: str = CUT) -> Column:
    """The non-empty parts of a text between matches; `insert` keeps groups of the match."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, insert), CUT), lambda s: s != "")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """Trimmed non-empty parts at sentence ends and line ends, in order."""
    return F.filter(F.transform(split_at(text, r"(?U)(?<=[.!?])\s+|\n+"), stripped), lambda s: s != "")


def _units(text: Column, at: str, edge: str, least: int, longest: int, again: str, prefix: str | None = None) -> Column:
    trim = lambda s: F.btrim(s, F.lit(edge))
    first = F.transform(split_at(text, at), trim)
    if prefix:
        first = F.transform(first, lambda s: F.regexp_replace(s, prefix, ""))
    kept = F.filter(first, lambda s: F.length(s) >= least)
    parts = F.transform(kept, lambda s: F.when(F.length(s) > longest, F.filter(F.transform(split_at(s, again), trim), lambda p: F.length(p) >= least)).otherwise(F.array(s)))
    return F.flatten(parts)


def sentence_units(text: Column) -> Column:
    """Sentences of at least 35 characters; those over 650 are split at labels and semicolons."""
    return _units(text, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(])|\n+", " ;,:-", 35, 650, r"(?U);\s+|\s+(?=Condition:|Value:|Significance:)")


def list_lines(text: Column) -> Column:
    """Numbered list markers as line ends; a decimal's digits are no marker."""
    return F.regexp_replace(text, r"(?U)(?:^|(?<=[.:;]))\s*(?<!\d\.)\d{1,3}\.\s+", "\n")


def split_units(text: Column) -> Column:
    """Units of at least 32 characters, without '(n)' before them; those over 720 are split again."""
    again = r"(?U);\s+|\s+(?=(?:Condition|Control|Compared|Value|Significance|Boundary):)"
    return _units(text, r"(?U)(?<=[.!?])\s+|\n+", " ;,:", 32, 720, again, prefix=r"^\(?\d{1,2}\)\s*")


def ensured_sentence(text: Column) -> Column:
    value = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" ;,:"))
    return F.when((value != "") & ~value.rlike(r"[.!?]$"), F.concat(value, F.lit("."))).otherwise(value)


def trimmed_at_boundary(text: Column, most: int) -> Column:
    """At most about `most` characters, cut after a sentence or clause, else at a word."""
    whole = F.btrim(text, F.lit(" ;,:.-"))
    head = F.substring(whole, 1, most + 1)

    def end(mark: str) -> Column:
        return F.when(F.instr(head, mark) > 0, F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1).otherwise(-1)

    clause = F.greatest(end(". "), end("; "), end(", "))
    space = end(" ")
    cut = F.when(clause >= int(most * 0.6), F.substring(head, F.lit(1), clause + 1)).when(space > 0, F.substring(head, F.lit(1), space)).otherwise(F.substring(head, 1, most))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.rtrim(cut, F.lit(" ;,:.-")), F.lit(".")))


def evidence_chunks(text: Column, most: int = 2200, packed: int = 1800) -> Column:
    """(id, text) chunks at headings, bullets and numbered lines; long ones are repacked by sentences."""
    parts = F.filter(F.transform(split_at(text, r"(?U)\n(?=##\s|[-*]\s|\d+[.)]\s)"), stripped), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, sentence: Column) -> Column:
        joined = F.trim(F.concat_ws(" ", acc["open"], sentence))
        full = (acc["open"] != "") & (F.length(joined) > packed)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, sentence).otherwise(joined).alias("open"))

    def repacked(part: Column) -> Column:
        cut = split_at(part, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(\[])")
        return F.aggregate(cut, empty, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))

    whole = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(repacked(p))))
    return F.transform(whole, lambda t, i: F.struct(F.format_string("E%03d", i + 1).alias("id"), t.alias("text")))


#: A sentence end before a capital, digit or bracket.
_ANCHOR = re.compile(r"[.!?](?=\s+[A-Z0-9(\[])")
_PARAGRAPH = re.compile(r"\n\s*\n")


def anchor_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end (in code points) of each sentence, paragraph by paragraph."""
    bounds = [0, *[x for m in _PARAGRAPH.finditer(text) for x in m.span()], len(text)]
    for low, high in zip(bounds[::2], bounds[1::2], strict=True):
        cuts = [low, *[m.end() for m in _ANCHOR.finditer(text, low, high)], high]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = text[start:end]
            if body := part.strip():
                begin = start + len(part) - len(part.lstrip())
                yield begin, begin + len(body)


@udtf(returnType=T.StructType([T.StructField("anchor_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("anchor_text", T.StringType())]))
class Anchors:
    """Sentence anchors S001, S002, ... with their places in the text."""

    def eval(self, text: str):  # noqa: ANN201
        for i, (start, end) in enumerate(anchor_spans(text or ""), 1):
            yield f"S{i:03d}", start, end, text[start:end]


def sentence_key(text: Column) -> Column:
    """A sentence for comparing: plain quotes and dashes, one space, lower case, no final marks."""
    plain = F.translate(text, "‘’“”–—−", "''\"\"---")
    lowered = F.lower(stripped(F.regexp_replace(plain, r"(?U)\s+", " ")))
    return stripped(F.regexp_replace(lowered, r"[.!?]+$", ""))


def deduplicated(rows: DataFrame, row_id: str, text: str, least: int = 24) -> DataFrame:
    """(id, text, removed): each text without sentences that it has before; those shorter than `least` stay.

    Sentences are numbered by paragraph and place, the first of each key is
    kept by a window over (row, key), and texts are put together again in order.
    """
    paragraphs = rows.select(row_id, F.posexplode(split_at(F.col(text), r"(?U)\n\s*\n")).alias("p", "part"))
    cut = paragraphs.select(row_id, "p", F.posexplode(F.filter(F.transform(split_at(F.col("part"), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(\[])"), stripped), lambda s: s != "")).alias("s", "sentence"))
    keyed = cut.withColumn("key", sentence_key(F.col("sentence")))
    nth = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(row_id, "key").orderBy("p", "s")))
    drop = (F.col("nth") > 1) & (F.length("key") >= least)
    place = F.struct("p", "s", "sentence")
    kept = lambda c: F.array_sort(F.collect_list(F.when(c, place)))
    by_part = nth.groupBy(row_id, "p").agg(F.array_join(F.transform(kept(~drop), lambda x: x["sentence"]), " ").alias("part"), F.transform(kept(drop), lambda x: x["sentence"]).alias("gone"))
    parts = F.array_sort(F.collect_list(F.struct("p", "part", "gone")))
    whole = by_part.groupBy(row_id).agg(parts.alias("x"))
    return whole.select(row_id, F.array_join(F.filter(F.transform("x", lambda y: y["part"]), lambda s: s != ""), "\n\n").alias("text"), F.flatten(F.transform("x", lambda y: y["gone"])).alias("removed"))


# What a question demands in so many words.
CONSTRAINTS = (
    r"(?i)\bone\s+(?:experiment|intervention|major change|comparator|control|readout)\b[^.?!]*",
    r"(?i)\bnot a campaign\b",
    r"(?i)\bfixed\s+(?:device stack|stack|composition|architecture|protocol)\b[^.?!]*",
    r"(?i)\bmatched\s+(?:controls?|conditions?|degradation progress|initial states?)\b[^.?!]*",
    r"(?i)\bwithout\s+(?:changing|altering|assuming)\b[^.?!]*",
    r"(?i)\bmust\s+(?:remain|be held|be fixed)\b[^.?!]*",
)


def constraints(text: Column, patterns: tuple[str, ...] = CONSTRAINTS) -> Column:
    """All matches of each pattern in turn, trimmed, the first of each spelling without regard to case."""
    each = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))
    found = F.filter(F.transform(each, lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" ;,."))), lambda x: x != "")
    return F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
