"""Column functions over text: answer normalisation, templates, list rendering, subsequences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the public normalisation of extractive-QA answers
PUNCTUATION = r"\p{Punct}"  # the 32 ASCII punctuation marks
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
# fixed values: the public ROUGE tokenisation
ROUGE_SEPARATORS = "[^a-z0-9]+"
#: Rows of a batch that become Python objects at once.
COMPARED = 256


def normalize_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), BLANKS, " "))


def words(text: Column) -> Column:
    """Non-empty pieces between single spaces of normalised text."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def rouge_text(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces."""
    return F.regexp_replace(F.lower(text), ROUGE_SEPARATORS, " ")


def ngram_count(text: Column, n: int) -> Column:
    return F.greatest(F.size(words(text)) - (n - 1), F.lit(0))


def _tokens(text: str | None) -> list[str] | None:
    """As `words`."""
    return None if text is None else [t for t in text.split(" ") if t]


def _grams(text: str | None, n: int) -> Counter:
    tokens = _tokens(text) or ()
    return Counter(tokens if n == 1 else zip(*(tokens[k:] for k in range(n))))


def _compared(left: pa.Array, right: pa.Array) -> Iterator[tuple]:
    """Rows of two columns as Python objects, a few at a time, so that a worker holds little more than the batch."""
    for start in range(0, len(left), COMPARED):
        yield from zip(left.slice(start, COMPARED).to_pylist(), right.slice(start, COMPARED).to_pylist(), strict=True)


def bag_overlaps(left: Column | str, right: Column | str, n: int = 1) -> Column:
    """Multiset intersection of the n-grams of one text with those of each of several; texts as `words` takes them.

    Built-in array functions are set-based; numbering the repeats with them is
    quadratic in the text length and measured three times slower. Workers get
    texts and split them row by row: arrays of n-grams are several times larger.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def overlaps(left: pa.Array, right: pa.Array) -> pa.Array:
        counted = ((_grams(a, n), many) for a, many in _compared(left, right))
        return pa.array([[(c & _grams(b, n)).total() for b in many] for c, many in counted], pa.list_(pa.int32()))

    return overlaps(left, right)


def _lcs(left, right) -> int:
    """Longest common subsequence length, one bit per token of `left`."""
    where: dict[str, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def lcs_lengths(left: pa.Array, right: pa.Array) -> pa.Array:
    """LCS length of the words of one text against those of each of several texts.

    The recurrence is sequential in both directions, so built-in functions can
    only express it with a copy of a whole row per token pair.
    """
    return pa.array([[_lcs(a, _tokens(b)) for b in many] for a, many in ((_tokens(a), many) for a, many in _compared(left, right))], pa.list_(pa.int32()))


def fill_braces(template: str, **columns: Column) -> Column:
    """Fill `{name}` fields; doubled braces are literal. Split once on the driver, one concat per row."""
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field not in columns:
                raise ValueError(f"template field {field!r} has no value")
            pieces.append(columns[field])
    return F.concat(*pieces)


def fill_double_braces(template: str, **columns: Column) -> Column:
    """Fill `{{ name }}` fields; unknown names render empty and one trailing newline is dropped."""
    if template.endswith("\n"):
        template = template[:-1]
    pieces: list[Column] = []
    for i, part in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", template)):
        if i % 2 == 0:
            if part:
                pieces.append(F.lit(part))
        elif part in columns:
            pieces.append(columns[part])
    return F.concat(*pieces)


def quote_python(text: Column) -> Column:
    """A string as a Python list would print it."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    escaped = F.replace(F.replace(escaped, F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single_quoted = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single_quoted)


def render_list(values: Column) -> Column:
    """`['a', 'b']`, the way a list appears inside a rendered prompt."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, quote_python), ", "), F.lit("]"))
