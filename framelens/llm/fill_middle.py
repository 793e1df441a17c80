"""Fill-in-the-middle training texts, in DataFrame functions only.

A text is cut into units, each a word with the white space before it (or the white space at the end), so that the
units joined give the text. The first four 8-digit groups of the SHA-256 of `seed:id` decide: the first two where
the text is cut, the third whether it stays plain, the fourth which arrangement it gets:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

The arrangement can be read back: no part holds a sentinel, and as a sentinel begins with `<` and holds no other
`<`, none can begin in a part and end behind it. `restored` finds the three sentinels and puts the parts in order.

All work is on one row: no shuffle, nothing is collected. A text is held as its units while it is arranged.

Defined cases: a null or empty text is plain and has no units; a text that holds a sentinel is plain; a null id is
hashed as an empty number; rows that repeat an id are cut at the same draws; a text without white space is one
unit; other columns of the table aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED, RATE, SPM = 42, 50, 80


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits that follow from the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """id, n (units), form, prefix, middle, suffix (null where plain) and output for each row. rate: percent of texts that are
    arranged; spm: percent of those that get the suffix first."""
    h = draws("_id", seed)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    plain = (F.col("_text") == "") | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)).alias("_units"))
    a, b = (x % (F.size("_units") + 1) for x in h[:2])
    rows = rows.select("*", F.size("_units").alias("_n"), F.least(a, b).cast("int").alias("_from"), F.greatest(a, b).cast("int").alias("_to"))
    between = lambda start, end: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, end - start), ""))
    parts = {"prefix": between(F.lit(0), F.col("_from")), "middle": between(F.col("_from"), F.col("_to")), "suffix": between(F.col("_to"), F.col("_n"))}
    rows = rows.select("_id", "_text", "_n", "form", *[c.alias(n) for n, c in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    back = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", psm).otherwise(back)
    return rows.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of, by the places of its sentinels; null where they aren't those of the form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = {"psm": (PREFIX, SUFFIX, MIDDLE, (1, 3, 2)), "spm": (SUFFIX, PREFIX, MIDDLE, (2, 3, 1))}
    out = F.when(form == "plain", output)
    for name, (x, y, z, places) in order.items():
        marks = F.concat_ws("", F.regexp_extract_all(output, F.lit(f"{PREFIX}|{SUFFIX}|{MIDDLE}"), F.lit(0))) == x + y + z
        out = out.when((form == name) & marks & output.startswith(x), F.concat(*[F.get(parts, F.lit(i)) for i in places]))
    return out


def fim_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, the lengths of prefix and middle in code points, and the digests of the output and of the text read back from it."""
    out = fill_in_middle(docs, id_col, text_col)
    sha = lambda c: F.sha2(c, 256)
    return out.select(
        id_col, "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
