"""Column expressions shared by the operators.  All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import fixed_values as fv

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATING)


def is_numeric(dtype: T.DataType) -> bool:
    """Whole or floating numbers; booleans, decimals and dates do not count."""
    return is_integral(dtype) or is_floating(dtype)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column whatever characters its name holds."""
    return F.col(quoted(name))


def value_of(field: T.StructField) -> Column:
    """The column with NaN read as missing, as everywhere in this package."""
    c = col(field.name)
    return F.when(~F.isnan(c), c) if is_floating(field.dataType) else c


def suffix(name: Column) -> Column:
    """Last suffix of a file name, lower-cased; '' for none, for ``.bashrc`` and for ``x.``."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Path without its last part; '' at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def by_suffix(ext: Column, table: dict[str, list[str]], default: str) -> Column:
    """Look a suffix up in a fixed table; becomes a handful of IN tests, no join."""
    out = None
    for label, extensions in table.items():
        test = ext.isin(extensions)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def category(ext: Column) -> Column:
    return by_suffix(ext, fv.CATEGORY_EXTENSIONS, "other")


def framework(ext: Column) -> Column:
    return by_suffix(ext, fv.FRAMEWORK_EXTENSIONS, "unknown")


def artifact_type(ext: Column) -> Column:
    return by_suffix(ext, fv.ARTIFACT_EXTENSIONS, "artifact")


def glob_to_regex(pattern: str) -> str:
    """Shell pattern on a file name (``* ? [seq] [!seq]``) as an anchored Java regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = "^" + body[1:] if body[0] == "!" else ("\\" + body if body[0] == "^" else body)
            out.append(f"[{body}]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Array of lines of a text; a final line end opens no further line."""
    parts = F.split(text, fv.LINE_BREAK_PATTERN, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def canonical(df: DataFrame) -> list[Column]:
    """Columns in a form Spark can group by: maps become sorted entry arrays."""
    return [F.array_sort(F.map_entries(col(f.name))).alias(f.name) if isinstance(f.dataType, T.MapType)
            else col(f.name) for f in df.schema.fields]


def row_digest(columns: list[Column]) -> Column:
    """Digest of several columns that tells NULL from '' and keeps field borders apart."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as DOUBLE, microsecond exact."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros.cast("double") / F.lit(1e6)


def kolmogorov_p(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided p of the two-sample statistic in the Kolmogorov limit (Smirnov 1948)."""
    n, m = n.cast("double"), m.cast("double")
    lam = statistic * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * lam * lam))
    # Below 0.2 the alternating series no longer settles; there 1 - p < 1e-12.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2)))
