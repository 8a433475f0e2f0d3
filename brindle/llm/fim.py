"""Fill-in-middle: a text's lines dealt to prefix, middle and suffix, and put in an order from which the middle can be learnt.

The tokenizers library's ``Split`` pre-tokenizer cuts a text into isolated matches
of a pattern and tells where each ends, in code points; nothing is trained. The
ends, with zero before them, are the places where a text may be cut: there are n + 1
of them for n units. Two hashes of the document's id pick two places, and the text
between them in order is the middle:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text as it is, where it is empty, holds a mark already, or isn't chosen

``restore`` rebuilds the text from output and form alone. All choices follow from
the id, so a lost task gives the same rows again, and no row needs another: there
is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordpool import steps

#: Lines with their ends; the last may have none.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of text in one step of a task.
STEP = 4_000_000


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated")


def ends(text: str, pattern: str = LINES) -> np.ndarray:
    """Where the units of ``text`` end, in code points, with 0 before them."""
    pieces = _splitter(pattern).pre_tokenize_str(text)
    return np.fromiter((0, *(end for _, (_, end) in pieces)), np.int64, len(pieces) + 1)


def _distinct(marks: tuple[str, str, str]) -> None:
    """ValueError unless each mark can be told wherever texts without marks stand around it: none is in another, or begins as one ends."""
    whole = all(marks) and len(set(marks)) == 3 and not any(a != b and a in b for a in marks for b in marks)
    if not whole or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
        raise ValueError("marks must be three strings, none within another or beginning as one ends")


def draws(id_col: Column, seed: int = 7) -> list[Column]:
    """Four unsigned numbers of 32 bits from a row's id: the first groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame,
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    pattern: str = LINES,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n long, form, prefix_chars and middle_chars long, output: one row for each row of ``docs``.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of those in the
    second order. ``n`` counts a text's units. Null texts count as empty; those,
    texts that hold a mark, and those not chosen are plain, with null for the
    lengths. A null id draws as an empty one; rows that share an id draw alike.
    Very long texts are cut in memory that follows their own length. An empty
    table gives no rows; other columns are ignored.
    """
    _distinct(marks)
    kind = docs.schema[id_col].dataType.simpleString()
    before, behind, between = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for at, to in steps(pc.utf8_length(texts).to_pylist(), STEP):
                part = batch.slice(at, to - at)
                forms, n, lengths, out = [], [], [], []
                h = np.stack([part.column(f"h{k}").to_numpy() for k in range(4)], axis=1)
                for text, (h1, h2, h3, h4) in zip(texts[at:to].to_pylist(), h.tolist(), strict=True):
                    places = ends(text, pattern)
                    n.append(len(places) - 1)
                    if not text or h3 % 100 >= rate or any(m in text for m in marks):
                        forms.append("plain")
                        lengths.append((None, None))
                        out.append(text)
                        continue
                    a, b = sorted((h1 % len(places), h2 % len(places)))
                    a, b = int(places[a]), int(places[b])
                    head, middle, tail = text[:a], text[a:b], text[b:]
                    forms.append("spm" if h4 % 100 < spm else "psm")
                    lengths.append((a, b - a))
                    first = behind + tail + before + head if forms[-1] == "spm" else before + head + behind + tail
                    out.append(first + between + middle)
                cols = [part.column("id"), pa.array(n, pa.int64()), pa.array(forms), *[pa.array(x, pa.int64()) for x in zip(*lengths, strict=True)], pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))])
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``transform`` made ``output`` of, from that and its form alone; null for a null."""
    _distinct(marks)
    before, behind, between = marks

    def parts(first: str, second: str) -> list[Column]:
        body = F.split_part(output, F.lit(first), F.lit(2))
        rest = F.split_part(output, F.lit(second), F.lit(2))
        return [F.split_part(body, F.lit(second), F.lit(1)), F.split_part(rest, F.lit(between), F.lit(1)), F.split_part(rest, F.lit(between), F.lit(2))]

    head, tail, middle = parts(before, behind)
    tail2, head2, middle2 = parts(behind, before)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(head2, middle2, tail2))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, lengths and digests of the output and of the text rebuilt from it, of every document.

    Null and empty texts are plain with n = 0; repeated rows and ids stay; a null
    id draws as an empty one; no documents give no rows; other columns are ignored.
    """
    rows = transform(common.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, lines, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn
), placed AS (
  SELECT doc_id, text, lines, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:n], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
