"""Column functions on strings: cleaning, tokenising, keys, highlighting, display.

All are built-in Spark expressions (JVM side, whole-stage codegen); none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token = maximal run of Unicode letters or digits, lower-cased (standard analyser
# without stop words). Same pattern is used by the DuckDB oracle.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# Python's str.strip() removes every whitespace character (str.isspace) at both ends.
# Fixed value: that character set, written out so Java and RE2 read it the same way.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """array<string> of lower-cased tokens of the whole text (empty pieces dropped)."""
    return F.array_remove(F.split(F.lower(_c(text)), TOKEN_SPLIT), "")


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: trims all leading/trailing whitespace, not just spaces."""
    return F.regexp_replace(_c(c), _STRIP, "")


def normalise_all_strings(df: DataFrame) -> DataFrame:
    """B1: every string column lower-cased, NULL → ''. Other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(F.lower(F.col(f"`{f.name}`")), F.lit("")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def lower_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B2: lower-case only the named columns."""
    return df.withColumns({n: F.lower(F.col(n)) for n in names})


def first_nonempty(*cols: str | Column) -> Column:
    """First argument that is neither NULL nor '' (Python ``a or b``)."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def tolerant_year(c: str | Column, missing: int | None = None) -> Column:
    """B4: '1911.0' → 1911; unparsable/empty → NULL (or ``missing``, e.g. 0)."""
    y = F.expr(f"try_cast(try_cast({_sql(c)} as double) as int)")
    return F.coalesce(y, F.lit(missing)) if missing is not None else y


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("tolerant_year needs a column name")


def embed_text(name="name", industry="industry", locality="locality", strip: bool = True) -> Column:
    """B6/B19: "{name} {industry} {locality}" with missing fields as ''; stripped."""
    parts = [F.coalesce(_c(x), F.lit("")) for x in (name, industry, locality)]
    s = F.concat_ws(" ", *parts)
    return py_strip(s) if strip else s


def query_cache_key(prefix: str, q: str | Column) -> Column:
    """``prefix + md5(lower(strip(q)))`` (prefix 'intent:' or 'search:')."""
    return F.concat(F.lit(prefix), F.md5(F.lower(py_strip(q))))


def raw_cache_key(prefix: str, q: str | Column) -> Column:
    """``prefix + md5(q)`` without normalising (evidence cache)."""
    return F.concat(F.lit(prefix), F.md5(_c(q)))


def highlight(text: str | Column, query: str | Column) -> Column:
    """Wrap case-insensitive literal matches of ``query`` in ``**…**``.

    Empty/NULL text → 'Unknown'; empty/NULL query → text unchanged. The query is quoted
    (\\Q…\\E) so regex metacharacters match literally; an embedded \\E is split out.
    """
    t, q = _c(text), _c(query)
    quoted = F.concat(F.lit("\\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?iu)("), quoted, F.lit(")"))
    marked = F.regexp_replace(t, pattern, F.lit("**$1**"))
    empty_t = t.isNull() | (t == "")
    empty_q = q.isNull() | (q == "")
    return F.when(empty_t, F.lit("Unknown")).when(empty_q, t).otherwise(marked)


def title_case(c: str | Column) -> Column:
    """Every run of letters gets a capital and small letters, wherever it stands (``3M``, ``O'Brien``, ``X-Ray``)."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def display_location(locality="locality", country="country") -> Column:
    """B13: 'locality, country'."""
    return F.concat_ws(", ", F.coalesce(_c(locality), F.lit("")), F.coalesce(_c(country), F.lit("")))


def display_founded(year="year_founded", size="size_range") -> Column:
    """B13: 'Founded: {year} | Size: {size}' (Python prints None for a missing year)."""
    y = F.coalesce(_c(year).cast("string"), F.lit("None"))
    s = F.coalesce(_c(size), F.lit("None"))
    return F.concat(F.lit("Founded: "), y, F.lit(" | Size: "), s)


def display_tags(tags="tags") -> Column:
    """Tags in backticks joined by ', '; '' when there are none."""
    return F.coalesce(F.array_join(F.transform(_c(tags), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "),
                      F.lit(""))
