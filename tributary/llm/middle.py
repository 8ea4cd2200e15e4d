"""Fill-in-middle transformation by relational units.

1. Every text gets a request: its number of units (runs of letters, other characters one by one), its form and the two
   numbers of units where prefix and middle end. Requests are a small table without texts.
2. Texts are dealt by document. Their units are exploded with their ordinals, and a window sums their lengths, so that
   each ordinal has its place in characters.
3. Requests are joined to the units by ordinal; an aggregate brings both places of a document together, and substrings
   of its text make the output.

Documents are known by id and a hash of the text: rows that agree in both are one document to the window, which counts
how often each unit is there and divides by it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the transformation.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SHARE, SPM_SHARE = 90, 20

FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draw(doc_id: str, k: int) -> Column:
    """The k-th (from 1) group of eight hex digits of the hash of the id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def keyed(docs: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """(__doc, other kept columns as __0, __1, ..., __id, __key, __text): documents by id and a hash of text and missing id.

    A null text is empty. Without other kept columns all uses of the texts read one and the same exchange.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text, F.col("doc_id").isNull())
    return docs.select(F.col("doc_id").alias("__doc"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("__id"), key.alias("__key"), text.alias("__text"))


def requests(docs: DataFrame) -> DataFrame:
    """(__id, __key, n, form, first, second): one row per document; the cuts are null where the form is plain."""
    n = F.length(F.regexp_replace("__text", "[A-Za-z]+", "a")).cast("bigint")
    plain = (F.col("n") == 0) | F.col("__text").rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}") | (draw("__doc", 3) % 100 >= SHARE)
    form = F.when(plain, "plain").when(draw("__doc", 4) % 100 < SPM_SHARE, "spm").otherwise("psm")
    one, two = (F.when(F.col("form") != "plain", draw("__doc", k) % (F.col("n") + 1)) for k in (1, 2))
    made = keyed(docs).withColumn("n", n).withColumn("form", form)
    return made.select("__id", "__key", "n", "form", F.least(one, two).alias("first"), F.greatest(one, two).alias("second")).distinct()


def transform(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n, form, prefix_chars, middle_chars and output, one row for each row of ``docs``.

    A null or empty text is plain and stays empty, as does every text that holds a mark. A null id draws as an empty
    number does. Rows that agree in id and text get the same output, and an empty table gives an empty result. A kept
    column whose name is that of a result, in whatever case, gives way to it. Texts of any length are cut whole.
    """
    spark = docs.sparkSession
    keep = common.without(keep, FIELDS)
    others = [c for c in keep if c != "doc_id"]
    place_of = {"doc_id": "__doc"} | {c: f"__{i}" for i, c in enumerate(others)}
    wanted = common.materialized(requests(docs))
    document = ["__id", "__key"]
    # the same exchange of texts feeds the units and the substrings
    texts = keyed(docs, others).repartition(*document)
    found = F.regexp_extract_all("__text", F.lit(UNIT), F.lit(0))
    last = F.greatest(*[draw("__doc", k) % (F.size("__found") + 1) for k in (1, 2)]).cast("int")
    # units behind the last cut have no part in a sum; an outer explode keeps Spark from splitting texts once more to filter
    units = texts.select(*document, "__doc", F.when(draw("__doc", 3) % 100 < SHARE, found).alias("__found"))
    units = units.select(*document, F.posexplode_outer(F.slice("__found", F.lit(1), last)).alias("__at", "__unit"))
    sums = Window.partitionBy(*document).orderBy("__at")
    units = units.select(*document, (F.col("__at") + 1).alias("__at"), F.length("__unit").alias("__chars"))
    units = units.select(*document, "__at", F.sum("__chars").over(sums).alias("__sum"), F.count("*").over(sums).alias("__rows"))
    place = F.expr("__sum * __at div __rows")
    cuts = wanted.where("form <> 'plain'").select(*document, "first", "second")
    met = units.join(cuts, document).where("__at in (first, second)")
    places = met.groupBy(*document).agg(F.max(F.when(F.expr("__at = first"), place)).alias("__a"), F.max(F.when(F.expr("__at = second"), place)).alias("__b"))
    offsets = wanted.join(places, document, "left")
    a, b, t = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0)), F.col("__text")
    prefix, middle, suffix = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a), F.substr(t, b + 1)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    out = texts.join(offsets.hint("shuffle_hash"), document)
    return out.select(*[F.col(place_of[c]).alias(c) for c in keep], "n", "form", F.when(cut, a).cast("bigint").alias("prefix_chars"), F.when(cut, b - a).cast("bigint").alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made of: no text that is cut holds a mark, so the marks split it into its parts."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text restored from it."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
