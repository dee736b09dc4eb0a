"""Terms: fixed-width byte windows, canonical DNA windows, packed k-mers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that one generated row may hold; longer sequences are cut into overlapping chunks.
CHUNK = 1 << 20


def num_terms(length: Column, k: int) -> Column:
    return F.greatest(length.cast("bigint") - (k - 1), F.lit(0).cast("bigint"))


def _cut(segments: DataFrame, own: list[str], k: int) -> DataFrame:
    """Windows' 1-based places `_i` beside these columns, of `_n` windows; segments shorter than k have none.

    The places are generated, never the windows, so a row of a long sequence isn't copied for each of them.
    """
    n = F.octet_length("seq").cast("bigint") - (k - 1)
    zero, step = F.lit(0).cast("bigint"), F.lit(CHUNK).cast("bigint")
    # sequence() would count down from 1 to less than 1
    chunks = segments.where(n > 0).select(*own, n.alias("_n"), F.explode(F.sequence(zero, n - 1, step)).alias("_from"))
    return chunks.select(*own, "_n", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + CHUNK, F.col("_n")))).alias("_i"))


def windows(segments: DataFrame, k: int) -> DataFrame:
    """Segments' columns but seq, with pos (from 0) and term: every window of k bytes."""
    own = [c for c in segments.columns if c != "seq"]
    return _cut(segments, [*own, "seq"], k).select(*own, (F.col("_i") - 1).alias("pos"), F.expr(f"substring(seq, cast(_i as int), {k})").alias("term"))


def forward(seq: Column) -> Column:
    """Bytes other than A, C, G and T are zero bytes."""
    return F.regexp_replace(F.decode(seq, "ISO-8859-1"), "[^ACGT]", "\0")


def canonical_windows(segments: DataFrame, k: int) -> DataFrame:
    """As windows(), with canonical terms, flipped, and whether they are valid.

    The smaller of a window and its reverse complement by the first k div 2 bytes; a tie keeps the window.
    Both strands are made once for a sequence. A window with another byte than ACGT has zero bytes there and isn't valid.
    """
    own = [c for c in segments.columns if c != "seq"]
    f = forward(F.col("seq"))
    both = segments.select(*own, "seq", F.encode(f, "ISO-8859-1").alias("_f"), F.encode(F.reverse(F.translate(f, "ACGT", "TGCA")), "ISO-8859-1").alias("_r"))
    cut = _cut(both, [*own, "_f", "_r"], k)
    half = k // 2
    at, back = "cast(_i as int)", "cast(_n - _i + 1 as int)"
    flip = F.expr(f"substring(_f, {at}, {half}) > substring(_r, {back}, {half})")
    term = F.when(flip, F.expr(f"substring(_r, {back}, {k})")).otherwise(F.expr(f"substring(_f, {at}, {k})"))
    out = cut.select(*own, (F.col("_i") - 1).alias("pos"), term.alias("term"), flip.alias("flipped"))
    return out.withColumn("valid", ~F.contains("term", F.lit(b"\0")))


def terms(segments: DataFrame, k: int, canonicalize: bool) -> DataFrame:
    """The terms an index is built from: invalid canonical ones keep their zero bytes and count."""
    return canonical_windows(segments, k).drop("flipped", "valid") if canonicalize else windows(segments, k)


_BASES = np.frombuffer(b"ACGT", np.uint8)


def unpack_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """(n, bytes) packed k-mers, two bits a base and the last base lowest in byte 0, as (n, k) letters."""
    need = -(-k // 4)
    raw = data[:, :need][:, ::-1]
    codes = np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=2).reshape(len(data), -1)
    return _BASES[codes[:, 4 * need - k :]]


def pack_kmers(letters: np.ndarray) -> np.ndarray:
    """The inverse of unpack_kmers() for letters of A, C, G, T."""
    n, k = letters.shape
    code = np.zeros(256, np.uint8)
    code[_BASES] = np.arange(4)
    padded = np.concatenate([np.zeros((n, -k % 4), np.uint8), code[letters]], axis=1).reshape(n, -1, 4)
    return (padded[..., 0] << 6 | padded[..., 1] << 4 | padded[..., 2] << 2 | padded[..., 3])[:, ::-1].copy()


def _stacked(s: pd.Series, width: int, run) -> pd.Series:
    """run() over the values, each of `width` bytes, as one array; nulls stay."""
    some = s.notna().to_numpy()
    out = np.full(len(s), None, object)
    if some.any():
        raw = b"".join(map(bytes, s[some]))
        out[some] = [x.tobytes() for x in run(np.frombuffer(raw, np.uint8).reshape(-1, width))]
    return pd.Series(out, dtype=object)


def packed(term: Column, k: int) -> Column:
    """A column of k-mers, packed."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _stacked(s, k, pack_kmers)

    return run(term)


def unpacked(column: Column, k: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return _stacked(s, -(-k // 4), lambda x: unpack_kmers(x, k))

    return run(column)


def base_name(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def pad_index(n: Column) -> Column:
    return F.when(F.length(n.cast("string")) >= 6, n.cast("string")).otherwise(F.lpad(n.cast("string"), 6, "0"))
