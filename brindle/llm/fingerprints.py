"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame operations only.

Every shingle hash in the lowest ``1 / scale`` of the 64-bit range is kept, so a
sketch grows with its document and two sketches hold the same shingles for the
same texts, whatever their lengths. Sketches merge by union, and counting common
members estimates both resemblance and the containment of a short document in a
very long one. So that short texts have enough in their sketch, too, the ``LEAST``
smallest hashes are kept whatever the threshold; that rule also holds under union, and
a text with fewer shingles has all of them in its sketch.

What two sketches tell comes from them alone: each says up to which hash it is whole
(all of it, if it has fewer than ``LEAST`` members; else up to the threshold, or its last
member if that is above), and both are compared up to the lower of the two.

A shingle's hash is xxhash64 over the xxhash64 of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SCALE = 8
#: Members of a sketch at least, where the text has as many shingles.
LEAST = 32


def _limit(scale: int) -> int:
    return -(2**63) + 2**64 // scale


def _kept(hashes: Column, scale: int) -> Column:
    own = F.sort_array(F.array_distinct(hashes))
    low = F.size(F.filter(own, lambda h: h < F.lit(_limit(scale))))
    return F.slice(own, 1, F.greatest(low, F.lit(LEAST)))


def _hashes(word_hashes: Column, shingle: int) -> Column:
    """One hash per shingle; a text with fewer words is one shingle, one without words has none."""
    n = F.size(word_hashes)
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(shingle)]))
    few = F.array(F.xxhash64(word_hashes))
    return F.when(n >= shingle, many).when(n > 0, few).otherwise(F.array().cast("array<long>"))


def sketch(df: DataFrame, text: Column, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of ``text`` as array<long>, ascending. Null, empty and blank texts: the empty array.

    Letters are compared in lower case. A shingle that a text repeats counts once, so
    there are no ties; repeated rows have equal sketches; other columns stay, ``name``
    is replaced. Each step is a projection of its own, so that no array is computed
    twice.
    """
    w, h, s = f"__{name}_words", f"__{name}_hashes", f"__{name}_shingles"
    return (
        df.withColumn(w, F.split(F.lower(F.coalesce(text, F.lit(""))), common.SPACES))
        .withColumn(h, F.transform(F.filter(w, lambda x: x != F.lit("")), lambda x: F.xxhash64(x)))
        .withColumn(s, _hashes(F.col(h), shingle))
        .withColumn(name, _kept(F.col(s), scale))
        .drop(w, h, s)
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of what two sketched texts hold together."""
    return _kept(F.array_union(a, b), scale)


def _whole_up_to(a: Column, scale: int) -> Column:
    """The largest hash up to which a sketch has all of its text."""
    return F.when(F.size(a) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_limit(scale) - 1), F.element_at(a, -1)))


def _alike(a: Column, b: Column, scale: int) -> Column:
    """both, either, own: how many members the sketches have in common, together, and ``a`` alone, up to where both are whole."""
    both = F.struct(a.alias("a"), b.alias("b"), F.least(_whole_up_to(a, scale), _whole_up_to(b, scale)).alias("t"))
    # One array of one struct, so that nothing is computed again for each member.
    cut = F.transform(F.array(both), lambda s: F.struct(F.filter(s["a"], lambda h: h <= s["t"]).alias("a"), F.filter(s["b"], lambda h: h <= s["t"]).alias("b")))
    counted = F.transform(cut, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("both"), F.size(s["a"]).alias("own"), F.size(s["b"]).alias("other")))
    return F.transform(counted, lambda s: F.struct(s["both"].alias("both"), (s["own"] + s["other"] - s["both"]).alias("either"), s["own"].alias("own")))[0]


def resemblance(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Common shingles over all shingles, estimated; exact where both sketches are whole; 1 for two empty sketches, 0 for one."""
    x = _alike(a, b, scale)
    return F.when(x["either"] == 0, F.lit(1.0)).otherwise(x["both"] / x["either"])


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The share of ``a``'s shingles that ``b`` holds too, estimated; 1 if ``a`` is empty.

    Null, for no estimate, if ``a`` has no member up to where both are whole.
    """
    x = _alike(a, b, scale)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(x["own"] > 0, x["both"] / x["own"])


def as_text(a: Column) -> Column:
    """16 lowercase hex digits per member, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


#: Rows of a bucket of ``with_next``, at most about so many where ids are spread evenly within a 64th of the rows.
BUCKET = 2_000


def with_next(docs: DataFrame, cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``next_<col>`` for each of ``cols``: the values of the next row by ascending id, after the last the first.

    Null ids come first; rows with equal ids are in an order that follows from ``cols``. Repeated rows
    follow each other; a single row follows itself; no rows give none. Other columns
    stay. Rows go to buckets that follow the id order, as many as the rows need, and
    are sorted within them, one shuffle; only each bucket's first row is looked up
    from the bucket before it.
    """
    plain = [c for c in cols if docs.schema[c].dataType.typeName() != "array"]
    b = docs.withColumn("__b", common.id_buckets(docs, id_col, max(16, -(-docs.select(id_col).count() // (64 * BUCKET))), F.xxhash64(*plain)))
    order = [F.col(id_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in plain]]
    w = Window.partitionBy("__b").orderBy(*order)
    value = F.struct(*cols)
    inner = b.select("*", F.lead(value).over(w).alias("__next"))
    firsts = b.groupBy("__b").agg(F.min_by(value, F.struct(F.coalesce(id_col, F.lit(-(2**63))), *plain)).alias("__first"))
    firsts = common.stage(firsts, "bucket-firsts")
    round_ = Window.orderBy("__b")
    numbers = firsts.select("__b").distinct().select("__b", F.lead("__b").over(round_).alias("__to"), F.min("__b").over(Window.partitionBy()).alias("__low"))
    links = numbers.select(F.col("__b").alias("__from"), F.coalesce("__to", "__low").alias("__to"))
    after = links.join(firsts, F.col("__to") == F.col("__b")).select("__from", "__first")
    out = inner.join(after, (F.col("__b") == F.col("__from")) & F.col("__next").isNull(), "left")
    nxt = F.coalesce("__next", "__first")
    return out.select(*docs.columns, *[nxt[c].alias(f"next_{c}") for c in cols])


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited of every document.

    Null texts count as empty; texts without words have the empty fingerprint, and
    two of them are 1 alike. Null ids come first, equal ones in an order that follows from text; no
    documents give no rows; other columns are ignored.
    """
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = sketch(docs, F.col("text"), "own")
    pairs = with_next(docs, ["text", "own"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = pairs.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    pairs = sketch(pairs, F.col("edited"), "changed")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("kept_in_edited"),
    )
