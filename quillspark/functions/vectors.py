"""Columns that built-in expressions cannot state, over Arrow batches; type hints must be real here, so they are not deferred."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..kernel.inlines import unescape as unescape_text


@F.pandas_udf(StringType())
def unescape(t: pd.Series) -> pd.Series:
    """Texts without backslash escapes and with entities decoded, as the parser reads link targets and info strings; null stays null."""
    return t.map(unescape_text, na_action="ignore")
