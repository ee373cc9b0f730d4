"""Title folding for a small ASCII font."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The widest title box, and the widest line that is drawn at all.
TITLE_BOX, LINE = 28, 30


def fold_text(text: str | None) -> str | None:
    """Decomposed, without what isn't ASCII, blanks made one, and without parentheses around the whole."""
    if text is None:
        return None
    plain = " ".join(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().split())
    within = plain[1:-1].strip() if len(plain) > 1 and plain[0] == "(" and plain[-1] == ")" else ""
    return within or plain


def fold(text: Column) -> Column:
    """fold_text as a column; Spark has no compatibility decomposition."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(fold_text, na_action="ignore")

    return run(text)


def fits(folded: Column) -> Column:
    return F.length(folded) <= TITLE_BOX


def renderable(folded: Column) -> Column:
    return (F.length(folded) <= LINE) & folded.rlike("^[ -~]*$")
