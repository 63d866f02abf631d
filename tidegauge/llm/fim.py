"""Fill-in-the-middle transformation in DataFrame functions alone.

A text is an array of units: a word with the white space before it, or the white space at the text's end.
Two cuts, drawn from a hash of the seed and doc_id, divide the units into prefix, middle and suffix, which
are put in order behind sentinels: psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Texts that
hold a sentinel stay plain, so that splitting an output at its sentinels restores the text exactly.

A row depends on nothing but itself: no shuffle, and neither hot keys nor lost executors matter. A text
must fit one row.

Cases: a null or empty text is empty, has no unit and stays plain; a null doc_id counts as the empty string in
the hash; repeated rows give repeated results; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text and the sentinels before prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 for a document, from the hex digits of a hash."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    `percent` of the texts are transformed, `percent_spm` of those with the suffix first."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    units = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("u"))
    n = F.size("u").cast("long")
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (h3 % 100 >= percent)
    drawn = units.select("doc_id", "text", "u", n.alias("n"), F.when(plain, "plain").when(h4 % 100 < percent_spm, "spm").otherwise("psm").alias("form"), (h1 % (n + 1)).cast("int").alias("a"), (h2 % (n + 1)).cast("int").alias("b"))
    cut = drawn.select("doc_id", "text", "u", "n", "form", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, length), ""))
    parts = cut.select(
        "doc_id", "text", "n", "form", joined(F.lit(1), F.col("a")).alias("p"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), joined(F.col("b") + 1, F.size("u") - F.col("b")).alias("s")
    )
    first, last, end = F.concat(F.lit(PREFIX), "p"), F.concat(F.lit(SUFFIX), "s"), F.concat(F.lit(MIDDLE), "m")
    output = F.when(F.col("form") == "psm", F.concat(first, last, end)).when(F.col("form") == "spm", F.concat(last, first, end)).otherwise(F.col("text"))
    return parts.select("doc_id", "text", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output, found from its sentinels."""
    parts = F.split(output, SENTINEL, -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
