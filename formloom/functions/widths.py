"""Cutting texts by the widths of their characters, with a budget for each row."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions import text as X

#: Where a line may end: after a line end or a run of blanks.
BREAK = re.compile(r"\r\n|\r|\n|[ \t\x0B\f]+")
JOINER = "‍"


def breaks(text: str) -> np.ndarray:
    """Places at which a text may be cut, its start and end among them; never before a mark or a joiner, which belong to what stands before them."""
    found = [m.end() for m in BREAK.finditer(text)]
    fine = [at for at in found if at < len(text) and text[at] != JOINER and not unicodedata.category(text[at]).startswith("M")]
    return np.array([0, *fine, len(text)], np.int64)


def cuts(text: str, budget: int, codes: np.ndarray, widths: np.ndarray, default: int) -> list[int] | None:
    """Ends of the longest pieces within the budget, from the start on; None if something between two breaks is wider. From every break the farthest one within
    the budget is looked up at once in the sums of widths; the cuts follow from break to break."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(np.searchsorted(codes, points), max(0, len(codes) - 1))
    each = np.where(codes[at] == points, widths[at], default) if len(codes) else np.full(len(points), default)
    places = breaks(text)
    upto = np.concatenate([[0], np.cumsum(each)])[places]
    farthest = np.searchsorted(upto, upto + budget, "right") - 1
    out, k = [], 0
    while k < len(places) - 1:
        if farthest[k] == k:
            return None
        k = int(farthest[k])
        out.append(int(places[k]))
    return out


def width_chunks(text: Column, budget: Column, widths: dict[str, int], default: int) -> Column:
    """The pieces of a text, each as long as its row's budget allows; null where something can't be broken, or without a text or budget. widths: of the characters
    that haven't the default one (a font's table)."""
    codes = np.array(sorted(map(ord, widths)), np.uint32)
    known = np.array([widths[chr(c)] for c in codes], np.int64)

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(b) else cuts(t, int(b), codes, known, default) for t, b in zip(texts, budgets, strict=True)])

    piece = lambda s, i: F.substring(text, F.coalesce(F.get(s, i - 1), F.lit(0)) + 1, F.get(s, i) - F.coalesce(F.get(s, i - 1), F.lit(0)))
    # cut once: what the function gave is named before its pieces are taken
    return X.let(ends(text, budget.cast("long")), lambda s: F.transform(s, lambda _, i: piece(s, i)))
