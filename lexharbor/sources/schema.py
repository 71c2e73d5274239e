"""The article contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
ARTICLE = T.StructType(
    [
        T.StructField(n, k)
        for n, k in (
            ("article_id", _S), ("source", _S), ("year", T.ShortType()), ("date", _S), ("newspaper", _S), ("lccn", _S), ("state", _S), ("page", _S), ("edition", _S),
            ("headline", _S), ("byline", _S), ("text", _S), ("n_bytes", T.IntegerType()), ("n_words", T.IntegerType()), ("lang", _S), ("lang_en_share", T.FloatType()), ("lccn_language", _S),
        )
    ]
)
EXTENDED = T.StructType([*ARTICLE.fields, T.StructField("meta", _S)])


def project(df: DataFrame, extended: bool = True) -> DataFrame:
    """The contract's columns in order and type; missing ones and null texts become the empty string."""
    cols = []
    for f in (EXTENDED if extended else ARTICLE).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        cols.append((F.coalesce(c, F.lit("")) if isinstance(f.dataType, T.StringType) else c).alias(f.name))
    return df.select(*cols)
