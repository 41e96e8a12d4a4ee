"""SQL over one table: ``input_df`` stands for a DataFrame, isolated a call."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean

#: String literals, quoted names, comments, then names and numbers, then single characters.
_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.""", re.S)
#: Words after which a name follows and no operator.
_BEFORE = {"select", "distinct", "all", "where", "and", "or", "on", "having", "by", "when", "then", "else", "case", "between", "from", "as", "limit", "not", "like", "in", "is"}


def _rewritten(query: str, view: str, compat: bool) -> str:
    """The query with the view's name in place of the bare name input_df, and LIKE, where it is the operator, ignoring case."""
    out, last, before = [], "", ""  # the last two tokens that are neither spaces nor comments
    for token in _TOKEN.findall(query):
        word = token.lower()
        bare = re.fullmatch(r"\w+", token) is not None
        if bare and word == "input_df" and last != ".":
            token = view
        elif bare and word == "like" and compat:
            operand = last not in _BEFORE | {"", "(", ",", ".", "=", "<", ">", "+", "-", "*", "/", "%", "|"}
            negated = last == "not" and before not in _BEFORE | {"", "(", ","}
            token, word = ("ILIKE", word) if operand or negated else (f"`{token}`", "`like`")
        out.append(token)
        if not token.isspace() and not token.startswith(("--", "/*")):
            before, last = last, word
    return "".join(out)


def run_sql(df: DataFrame, query: str, compat: bool = False) -> DataFrame:
    """The query's rows; NaN and infinities count as null. With ``compat``, LIKE ignores case and a division
    by zero is null, as in the older dialect; divisions of integers are not cut to integers (``div`` does that). Literals,
    quoted names, comments, and columns named like are left as they are."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    view = f"input_{uuid.uuid4().hex}"
    df.select(*[clean(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]).createOrReplaceTempView(view)
    spark = df.sparkSession
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:  # an expression keeps the mode that it was analysed in; the view is part of the plan by then
        spark.conf.set("spark.sql.ansi.enabled", "false" if compat else ansi)
        return spark.sql(_rewritten(query, view, compat))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        spark.catalog.dropTempView(view)
