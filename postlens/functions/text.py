"""Text cleaning as native column expressions.

The entity decoder is the only Python in this package's row path; everything else compiles into
the scan stage.
"""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Typographic characters and their plain forms.
PLAIN_PUNCTUATION = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "-",
    "…": "...",
}

# Text injected by posting platforms, and a word each span must contain. The word is
# looked for first, so that the lazy pattern never runs over text that cannot match it.
BOILERPLATE = [
    (r"This job is with .*?myGwork.*?Please do not contact the recruiter directly\.?", "mygwork"),
]

# Every character the source semantics count as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# A run that is not already one plain space, so that most of a text is left untouched.
_WIDE_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def plain_punctuation(c: Column) -> Column:
    for fancy, plain in PLAIN_PUNCTUATION.items():
        c = F.replace(c, F.lit(fancy), F.lit(plain))
    return c


def drop_boilerplate(c: Column, spans: Sequence[tuple[str, str]] = tuple(BOILERPLATE)) -> Column:
    """Replace each platform span with one space. `spans` holds (pattern, required word) pairs."""
    for pattern, word in spans:
        c = F.when(F.lower(c).contains(word.lower()),
                   F.regexp_replace(c, "(?iusd)" + pattern, " ")).otherwise(c)
    return c


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """Decode HTML entities. Rows without '&' send only a null to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]++>", " ")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WIDE_SPACE, " "))


def strip_ends(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def with_clean_text(df: DataFrame, source: str, out: str,
                    spans: Sequence[tuple[str, str]] = tuple(BOILERPLATE)) -> DataFrame:
    """Add `out`: punctuation, platform spans, entities, tags, white space, in that order.

    Null gives ''. Steps that read their input more than once get it from a projection of its own,
    so no step repeats the ones before it.
    """
    return (
        df.withColumn("_plain", plain_punctuation(or_empty(F.col(source))))
        .withColumn("_plain", drop_boilerplate(F.col("_plain"), spans))
        .withColumn(out, collapse_spaces(strip_tags(decode_entities(F.col("_plain")))))
        .drop("_plain")
    )


def looks_truncated(c: Column) -> Column:
    """True where a raw description seems cut off; null, empty and all-blank text are false."""
    body = F.rtrim(or_empty(c), F.lit(SPACES))
    cut_mark = body.endswith("…") | body.endswith("...")
    stops = F.right(body, F.lit(1)).isin(".", "!", "?", '"')
    return cut_mark | ((F.length(or_empty(c)) > 400) & (body != "") & ~stops)


def search_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", or_empty(title), or_empty(description))


def fold_case(c: Column) -> Column:
    """Lower case in which the three extra case partners of i and s become the plain letters."""
    c = F.lower(F.replace(c, F.lit("İ"), F.lit("i")))
    return F.replace(F.replace(c, F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i"))
