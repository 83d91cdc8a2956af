"""Fill-in-the-middle transformation by escaped marker injection.

A delimiter is escaped out of the text, put after every unit by one regexp_replace, and counted: that is the number of units n. Two of
the n + 1 borders are drawn by a hash of the document's id; substring_index by the delimiter's rank takes out what lies before, between and
after them, from which delimiters are deleted and escapes undone. All of it is column expressions: no shuffle, no Python.

A unit is a word with the white space before it, or white space at the end of the text, so that units make up the text. Escapes put two
visible characters in place of one, which leaves units as they are. Null and empty texts have no unit and stay plain, as the empty
text; texts that hold a marker stay plain too, so that every output can be taken apart again. A null doc_id draws like an empty one.
Repeated rows get the same result; an empty table gives an empty one; a long text is one row like any other. Other columns are kept,
but for those with the names of the results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Units of the contract.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
DELIMITER, ESCAPE = "\x1e", "\x1b"
RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def escaped(text: Column) -> Column:
    """Text without DELIMITER, from which `unescaped` gives the text back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(text: Column) -> Column:
    """The text of a part with delimiters after its units."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def parts(marked: Column, n: Column, first: Column, last: Column) -> tuple[Column, Column, Column]:
    """What stands before unit `first`, from there to `last`, and after it, by the ranks of delimiters."""
    of = lambda text, count: F.call_function("substring_index", text, F.lit(DELIMITER), count.cast("int"))
    return unescaped(of(marked, first)), unescaped(of(of(marked, last), first - last)), unescaped(of(marked, last - n - 1))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    p, s, m = map(F.lit, MARKERS)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    p, s, m = MARKERS
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All columns of docs (doc_id, text, ...), and n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    `rate`: per cent of documents to transform; `spm`: per cent of these that begin with the suffix.
    """
    docs = docs.drop(*RESULTS)
    keep = docs.columns
    body, drawn, marked, first, last, prefix, middle, suffix = (unused(docs, f"_{x}") for x in ("body", "drawn", "marked", "first", "last", "prefix", "middle", "suffix"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.withColumns({body: F.coalesce(F.col("text"), F.lit("")), drawn: F.transform(F.array(*[F.substring(digest, 8 * i + 1, 8) for i in range(4)]), lambda h: F.conv(h, 16, 10).cast("long"))})
    rows = rows.withColumn(marked, F.regexp_replace(escaped(F.col(body)), UNIT, f"$0{DELIMITER}"))
    rows = rows.withColumn("n", (F.octet_length(marked) - F.octet_length(F.replace(F.col(marked), F.lit(DELIMITER), F.lit("")))).cast("long"))
    h, n = F.col(drawn), F.col("n")
    plain = (F.col(body) == "") | (h[2] % 100 >= rate)
    for marker in MARKERS:
        plain |= F.contains(F.col(body), F.lit(marker))
    rows = rows.withColumns({"form": F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"), first: F.least(h[0] % (n + 1), h[1] % (n + 1)), last: F.greatest(h[0] % (n + 1), h[1] % (n + 1))})
    cut = parts(F.col(marked), n, F.col(first), F.col(last))
    rows = rows.withColumns({name: F.when(F.col("form") != "plain", part) for name, part in zip((prefix, middle, suffix), cut)})
    made = assembled(F.col("form"), F.col(prefix), F.col(middle), F.col(suffix), F.col(body))
    return rows.select(*keep, "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), made.alias("output"))
