"""Fill-in-the-middle transformation by Spark SQL functions only.

A text's units (a word with the white space before it, or white space at the end) make an array; parts of a keyed digest of
the document's id give two cuts and the form; slices of the array are joined in the form's order around sentinels. The
text can be rebuilt from the output and its form, since no text that holds a sentinel is changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import output_names, row_of, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_OWN = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units of the text), form, prefix_chars, middle_chars (code points; null if plain) and output.

    share per cent of the texts are cut, and of these spm_share per cent get the form spm (suffix, prefix, middle), the others
    psm (prefix, suffix, middle); the rest are plain: the text itself. An empty or null text, and one that holds a sentinel, is
    plain. Draws depend on seed and id alone, so rows that repeat an id get the same draws, each for its own text; a null id counts as
    an empty string. A table without rows gives none. Columns of docs that are called like an output get `_carried` at their end.
    Rows never meet, so nothing is shuffled; all functions run on the JVM.
    """
    text = text_or_empty(text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(row_of(docs), text.alias("text"), F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)).alias("units"), digest.alias("digest"))
    one, two = (F.pmod(_draw(F.col("digest"), k), (F.size("units") + 1).cast("long")).cast("int") for k in (1, 2))
    plain = (F.col("text") == "") | (_draw(F.col("digest"), 3) % 100 >= share)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 4) % 100 < spm_share, "spm").otherwise("psm")
    cut = rows.select("row", "text", "units", F.size("units").cast("long").alias("n"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))

    def part(begin: Column, end: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))

    parts = cut.select("row", "text", "n", "form", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b")).alias("middle"), part(F.col("b"), F.size("units")).alias("suffix"))
    marked = {k: F.concat(F.lit(mark), F.col(k)) for k, mark in (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE))}
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(marked["prefix"], marked["suffix"], marked["middle"])).otherwise(F.concat(marked["suffix"], marked["prefix"], marked["middle"]))
    fields = [F.col("row")[c].alias(to) for c, to in zip(docs.columns, output_names(docs.columns, _OWN))]
    return parts.select(*fields, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made of: its parts are what stands between the sentinels."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
