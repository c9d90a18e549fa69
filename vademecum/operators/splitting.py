"""Structural splitting of long texts: paragraphs, then lines, then words, then characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.functions import text as T

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the first separator that the text has; a longer part of it at the
    next. Neighbouring parts are joined while they fit, and a piece starts with up to ``overlap`` characters of the last.

    Parts lie end to end, each from its separator on, so a piece is a pair of offsets: no part is copied before the end,
    and every offset is looked at twice at most.
    """
    out: list[str] = []

    def merge(starts: list[int], end: int) -> None:
        """Pieces from parts that begin at ``starts``, the last of which ends at ``end``."""
        first = 0
        for k, start in enumerate(starts):
            after = starts[k + 1] if k + 1 < len(starts) else end
            if k > first and after - starts[first] > most:
                out.append(text[starts[first] : start].strip())
                while first < k and (start - starts[first] > overlap or after - starts[first] > most):
                    first += 1
        if starts:
            out.append(text[starts[first] : end].strip())

    def cut(start: int, end: int, level: int) -> None:
        at = next(i for i in range(level, len(separators)) if text.find(separators[i], start, end) >= 0)
        starts, short = _part_starts(text, start, end, separators[at]), []
        for k, begin in enumerate(starts):
            after = starts[k + 1] if k + 1 < len(starts) else end
            if after - begin < most:
                short.append(begin)
                continue
            merge(short, begin)
            short = []
            if at + 1 < len(separators):
                cut(begin, after, at + 1)
            else:
                out.append(text[begin:after])
        merge(short, end)

    cut(0, len(text), 0)
    return [p for p in out if p]


def _part_starts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Where the parts of a span begin: at its start, unless a separator does, and at every separator."""
    if not separator:
        return list(range(start, end))
    found, at = [], text.find(separator, start, end)
    while at >= 0:
        found.append(at)
        at = text.find(separator, at + len(separator), end)
    return found if found and found[0] == start else [start, *found]


def split_long(df: DataFrame, column: str, most: int, overlap: int = 0) -> DataFrame:
    """One row per piece of ``column``, with piece_ord from 0. Blank texts have no piece. Only texts over ``most``
    characters reach the Python helper."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, most, overlap))

    plain = T.strip(column)
    long = F.length(column) > most
    cut = F.coalesce(pieces(F.when(long, F.col(column))), F.when(F.length(plain) > 0, F.array(plain)), F.array().cast("array<string>"))
    names = [F.col("_piece").alias(column) if c == column else F.col(c) for c in df.columns]
    return df.select("*", F.posexplode(cut).alias("piece_ord", "_piece")).select(*names, "piece_ord")
