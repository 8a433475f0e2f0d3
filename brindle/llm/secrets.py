"""Secret scans with multipart credential linking, in DataFrame operations only.

Regular expressions find parts in each text: sure secrets (the base kinds), and
weak parts: names of accounts, unnamed random-looking strings, endpoints. A weak part alone is noise, so it is reported only when its complement
lies in the same scope, ``SCOPE`` code points around it: a random string beside an
access key, an account name or an endpoint; an account name or an endpoint beside
a secret or a random string.

What lies within an endpoint, a path or a file name is no part of its own, so a
link's address never stands for a credential. An endpoint is an address of four
numbers, or a scheme with what follows; a scheme's characters begin where no other
of them stands before (``1http://`` begins at the 1), so no text is tried twice. A random string has small letters,
capitals and digits in such short runs as words and product codes don't have.

That interval join is done by sorting: per document the parts are put in order
of position, and running maxima of ends (and, in reverse order, minima of
starts) tell the nearest part of each role on either side. Work is linear in the
parts; no pairs are made.

Code point offsets come from the texts between matches: a match starts where the
lengths of all earlier pieces and matches end, a running sum over the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCOPE = 200
#: kind: (order, cheap test that must hold, expression, group measured, its least length, role)
KINDS = {
    "assign": (0, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    "access": (1, r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20, "name"),
    "hex": (2, r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24, "secret"),
    "account": (3, r"(?i)(?:key_?id|client_?id|account|user|login)[a-z_]{0,5}[\"']?\x20*[:=]", r"""(?i)(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 1, "weak name"),
    "opaque": (4, r"[A-Za-z0-9+_=-]{16}", r"(?<![A-Za-z0-9+_=/\\.%&?#@-])[A-Za-z0-9+_=-]{16,}+(?![/\\@]|[.:][A-Za-z0-9])", 0, 16, "weak secret"),
    "endpoint": (5, r"://|[0-9]\.[0-9]", r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""", 0, 1, "endpoint"),
}
BASE = ("assign", "access", "hex")


def _random(match: Column) -> Column:
    """Whether a string has two small letters, capitals and digits at least, in runs of two on average at most."""
    letters = F.regexp_replace(match, F.lit("[^A-Za-z0-9]"), F.lit(""))
    runs = F.regexp_count(match, F.lit("[a-z]+|[A-Z]+|[0-9]+"))
    mixed = [F.regexp_count(match, F.lit(c)) >= 2 for c in ("[a-z]", "[A-Z]", "[0-9]")]
    return mixed[0] & mixed[1] & mixed[2] & (runs * 2 >= F.char_length(letters))


def _pieces(text: Column, kind: str) -> Column:
    """Per match of a kind: its order, its number, the length of the piece before it, its length, whether it counts."""
    order, test, regex, group, least, _ = KINDS[kind]
    right = {"opaque": _random}.get(kind, lambda m: F.lit(True))
    r = F.lit(regex)
    match = F.regexp_extract_all(text, r, F.lit(0))
    measured = F.regexp_extract_all(text, r, F.lit(group)) if group else match
    found = F.transform(
        F.arrays_zip(match.alias("m"), measured.alias("g"), F.split(text, regex, -1).alias("p")),
        lambda x, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("n"),
            F.char_length(x["p"]).alias("gap"),
            F.coalesce(F.char_length(x["m"]), F.lit(0)).alias("len"),
            F.coalesce((F.char_length(x["g"]) >= least) & right(x["m"]), F.lit(False)).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,len:int,ok:boolean>>")
    return F.when(F.regexp_like(text, F.lit(test)), found).otherwise(none)


def _is_mark() -> Column:
    """Whether a span's text is to be replaced."""
    return (F.col("kind") >= 0) & (F.col("kind") != KINDS["endpoint"][0])


def _is(role: str) -> Column:
    return F.col("kind").isin([v[0] for v in KINDS.values() if v[5] in role.split("|")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns and found: array<struct<start, kind (order in KINDS), end, base>> by start, then kind.

    Offsets are code points, ends exclusive. One row comes back for each input
    row, repeated ids or rows included; a null or empty text has no spans.
    Base spans are those of the three base kinds; the others are linked ones and
    never overlap a base span. Texts of any length are searched whole. Columns
    that aren't asked for are ignored, so their names can't clash.
    """
    found = F.transform("found", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "base")]))
    return _scan(docs, text_col, F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(c) for c in keep])).select("row.*", found.alias("found"))


def _scan(docs: DataFrame, text_col: str, whole: Column, before: bool = False) -> DataFrame:
    """row and found: ``whole`` and the spans of each row, with ``before`` also where the spans ahead of each end that aren't endpoints."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row of kind -1 stands for the document itself, so that one without parts stays.
    own = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok")))
    parts = docs.select(F.monotonically_increasing_id().alias("uid"), whole.alias("row"), F.concat(own, *[_pieces(text, k) for k in KINDS]).alias("parts"))
    parts = parts.select("uid", "row", F.explode("parts").alias("p")).select("uid", F.when(F.col("p.kind") < 0, F.col("row")).alias("row"), "p.*")
    parts = parts.repartition("uid")
    upto = Window.partitionBy("uid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    parts = parts.select("uid", "row", "kind", "ok", (end - F.col("len")).cast("int").alias("start"), end.cast("int").alias("end"))
    parts = parts.where("ok or kind < 0")
    left = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy("uid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def beside(parts: DataFrame, roles: dict[str, Column]) -> DataFrame:
        ends = {f"{k}_end": F.max(F.when(c, F.col("end"))).over(left) for k, c in roles.items()}
        starts = {f"{k}_start": F.min(F.when(c, F.col("start"))).over(right) for k, c in roles.items()}
        return parts.select("*", *[c.alias(k) for k, c in ends.items()]).select("*", *[c.alias(k) for k, c in starts.items()])

    def near(k: str, scope: int) -> Column:
        return F.coalesce(F.col(f"{k}_end") > F.col("start") - scope, F.lit(False)) | F.coalesce(F.col(f"{k}_start") < F.col("end") + scope, F.lit(False))

    base, weak = _is("secret|name"), _is("weak secret|weak name")
    parts = beside(parts, {"base": base, "address": _is("endpoint")})
    hidden = (weak & near("address", 0)) | ((weak | _is("endpoint")) & near("base", 0))
    parts = parts.where(~hidden).drop("base_end", "base_start", "address_end", "address_start")
    parts = beside(parts, {"secret": _is("secret|weak secret"), "part": _is("name|weak name|endpoint")})
    linked = (_is("weak secret") & near("part", SCOPE)) | (_is("weak name|endpoint") & near("secret", SCOPE))
    parts = parts.where(base | linked | (F.col("kind") < 0))
    span = ["start", "kind", "end", base.alias("base")]
    if before:
        ahead = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.coalesce(F.max(F.when(_is_mark(), F.col("end"))).over(ahead), F.lit(0)))
        span.append(F.col("before"))
    return (
        parts.groupBy("uid")
        .agg(F.max_by("row", F.col("row").isNotNull()).alias("row"), F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct(*span)))).alias("found"))
        .select("row", "found")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points in a block of a text that is cut by position.
BLOCK = 1024


def _blocks(text: Column) -> Column:
    """A text's blocks of ``BLOCK`` code points in order, so that no position is counted from the text's start again."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` or the text's end."""
    first = F.floor(start / BLOCK).cast("int")
    stop = F.least(F.size(blocks), F.floor(F.greatest(end - 1, start) / BLOCK).cast("int") + 1)
    own = F.array_join(F.slice(blocks, first + 1, F.greatest(stop - first, F.lit(0))), "")
    return F.substring(own, start - first * BLOCK + 1, end - start)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret and each name that goes with one replaced by ``mark``; endpoints stay.

    Texts without spans stay as they are, null ones null. Overlapping spans are
    replaced together. ``chars_col``, where there is one, is set to the new length
    where the text changed. Repeated rows and ids each stay, as do all columns,
    whatever their names; no rows give none.
    """
    found = _scan(docs, text_col, F.struct(*[F.col(c) for c in docs.columns]), before=True)
    text, spans = F.col("row")[text_col], F.filter("found", lambda s: s["kind"] != KINDS["endpoint"][0])
    # Before each span lies what is between the furthest end ahead of it and its start; a span that begins ahead of that end goes with the one before.
    kept = F.filter(spans, lambda s: s["start"] >= s["before"])
    last = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    merged = F.transform(
        F.array(F.struct(_blocks(text).alias("blocks"), kept.alias("spans"), last.alias("last"))),
        lambda x: F.concat(
            F.array_join(F.transform(x["spans"], lambda s: _between(x["blocks"], s["before"], s["start"])), mark), F.lit(mark), _between(x["blocks"], x["last"], F.lit(2**31 - 1))
        ),
    )[0]
    changed = found.select("row", F.when(F.size(spans) > 0, merged).alias("changed"))
    picked = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == text_col:
            own = F.coalesce("changed", own)
        elif c == chars_col:
            own = F.coalesce(F.char_length("changed"), own).cast(docs.schema[c].dataType)
        picked.append(own.alias(c))
    return changed.select(*picked)


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every document.

    Null and empty texts have none; repeated rows and ids stay; no documents give
    no rows; other columns are ignored.
    """
    found = scan(common.documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS[kind][0])).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
