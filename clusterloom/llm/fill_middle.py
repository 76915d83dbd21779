"""Fill-in-the-middle: documents cut at two line boundaries and put together anew.

Masks are Python integers with a bit for each byte of the UTF-8 text:
`bytes.translate` marks a class of bytes, shifts and boolean operations turn
marks into boundaries, `bit_count` counts them, and a ranked bit is found by
halving the mask over and over, so that no line is ever an object of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import trim

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: One digit a byte: 1 where the byte ends a line, and where it begins a code point.
NEWLINE = bytes(0x31 if b == 0x0A else 0x30 for b in range(256))
LEADING = bytes(0x30 if b & 0xC0 == 0x80 else 0x31 for b in range(256))
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def mask(text: bytes, marks: bytes) -> int:
    """Bit i is set where byte i has the mark."""
    return int(text[::-1].translate(marks), 2) if text else 0


def line_starts(text: bytes) -> int:
    """Mask of the first byte of each line: byte 0, and what follows a newline, within the text."""
    return (mask(text, NEWLINE) << 1 | 1) & ((1 << len(text)) - 1)


def ranked_bit(bits: int, rank: int) -> int:
    """Position of the set bit with so many set bits below it; there must be one."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def cut_points(text: bytes, units: tuple[int, int]) -> tuple[int, int, int]:
    """(lines, first byte after as many lines as the smaller, and as the larger of units modulo lines + 1)."""
    starts = line_starts(text)
    n = starts.bit_count()
    first, last = sorted(u % (n + 1) for u in units)
    at = [ranked_bit(starts, k) if k < n else len(text) for k in (first, last)]
    return n, at[0], at[1]


def transform(text: bytes | None, h: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    text = text or b""
    n, a, b = cut_points(text, h[:2])
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    chars = mask(text[:b], LEADING)
    before = (chars & ((1 << a) - 1)).bit_count()
    if h[3] % 100 < spm_rate:
        return n, "spm", before, chars.bit_count() - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, chars.bit_count() - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes | None, form: str) -> bytes:
    """The text that was put together as output."""
    output = output or b""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, other) if form == "psm" else (other, one)
    return prefix + middle + suffix


def _transformer(rate: int, spm_rate: int):
    @F.pandas_udf(MADE)
    def run(texts: pd.Series, hashes: pd.DataFrame) -> pd.DataFrame:
        units = hashes.to_numpy(np.int64).tolist()
        rows = [transform(t, tuple(h), rate, spm_rate) for t, h in zip(texts, units, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out["output"] = [x.decode("utf-8", "replace") for x in out["output"]]
        trim()
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def restored(output: Column, form: Column) -> Column:
    """The text, as binary, from output and form."""

    @F.pandas_udf("binary")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output.cast("binary"), form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(row, made) of each row of docs: its columns, and a struct (n, form, prefix_chars, middle_chars, output).

    Lines end after a newline or with the text. Cuts and form hang on the hash
    of seed and id alone, so reruns agree; rate of 100 documents are
    transformed, spm_rate of 100 of these with the suffix first. Texts that are
    null, empty or hold a sentinel stay plain, with null in both counts; a
    null id hashes like an empty one. Repeated rows give a row each, an empty
    table none; whole texts are cut, however long, and other columns may have
    any names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = F.struct(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)))
    text = F.col("row").getField(text_col).cast("binary")
    return docs.select(F.struct(*docs.columns).alias("row")).withColumn("made", _transformer(rate, spm_rate)(text, hashes))


def fill_digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: hashes of the output and of the text restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "row.doc_id",
        "made.n",
        "made.form",
        "made.prefix_chars",
        "made.middle_chars",
        sha(F.col("made.output")).alias("output_sha256"),
        sha(restored(F.col("made.output"), F.col("made.form"))).alias("restored_sha256"),
    )
