"""Column-level helpers (pure ``Column -> Column`` built-ins, no UDFs).

Everything here compiles to Catalyst expressions, so it stays inside
whole-stage code generation and constant parts fold away at planning time.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared widths of the report tables (as the original report declares them).
QTY = T.DecimalType(11, 3)        # ledger quantities
MONEY = T.DecimalType(12, 4)      # ledger money / unit cost
SUMMARY_QTY = T.DecimalType(14, 3)
SUMMARY_VALUE = T.DecimalType(15, 4)
SUM_QTY = T.DecimalType(18, 3)    # our explicit type for summed quantities
SUM_VALUE = T.DecimalType(18, 4)  # ... and summed values
RATIO = T.DecimalType(26, 15)     # decimal(11,3) / decimal(11,3), as SQL types it
PRODUCT = T.DecimalType(24, 7)    # decimal(12,4) * decimal(11,3)

# ISNUMERIC() is 1 for a single digit, sign, decimal or group
# separator, or currency symbol of the money types.
MONEY_SIGNS = "$¢£¤¥৲৳฿៛₠₡₢₣₤₥₦₧₨₩₪₫€₭₮₯₰₱﷼﹩＄￠￡￥￦"
NUMERIC_FIRST_CHAR = rf"^[0-9+\-.,{MONEY_SIGNS}]"


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal (the data has no zone; neither do parameters).

    Folded to a literal by Catalyst, so comparisons with it reach the
    Parquet scan as pushed filters."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def between(col: Column, start, end) -> Column:
    """Closed interval, as SQL BETWEEN (an end at midnight excludes the rest
    of that day)."""
    return col.between(ntz(start), ntz(end))


CASE_INSENSITIVE = "UTF8_LCASE"


def collated(col: Column, case_insensitive: bool) -> Column:
    """``col`` under the case-insensitive collation when asked, else as is
    (binary comparison).  For comparisons that depend on the database's
    collation rather than an explicit ``LOWER``."""
    return F.collate(col, CASE_INSENSITIVE) if case_insensitive else col


def like(col: Column, pattern: str, fold_case: bool = False, case_insensitive: bool = False) -> Column:
    """``col LIKE pattern`` (``%`` and ``_`` wildcards, ``[...]`` character
    classes; a backslash is an ordinary character).

    ``fold_case`` lowers both sides (an explicit ``LOWER(x) LIKE LOWER(p)``);
    ``case_insensitive`` matches under the case-insensitive collation.  A
    pattern made only of ``%`` matches every non-NULL value; it is emitted
    as ``isNotNull`` so Catalyst can drop it where the column is known to be
    non-null instead of evaluating a regex per row."""
    if pattern and set(pattern) == {"%"}:
        return col.isNotNull()
    if "[" in pattern:
        return _like_classes(col, pattern, fold_case, case_insensitive)
    pattern = pattern.replace("\\", "\\\\")  # a backslash is an ordinary character
    if fold_case:
        return F.lower(col).like(pattern.lower())
    return collated(col, case_insensitive).like(pattern)


def _like_classes(col: Column, pattern: str, fold_case: bool, case_insensitive: bool) -> Column:
    """A pattern with character classes (``[abc]``, ``[a-f]``, ``[^x]``) as an
    anchored regular expression.  A bracket that is never closed matches
    itself."""
    if fold_case:
        col, pattern = F.lower(col), pattern.lower()
    out, i = [], 0
    while i < len(pattern):
        ch, end = pattern[i], pattern.find("]", i + 1)
        if ch == "[" and end > i + 1:
            body = pattern[i + 1:end]
            negated = body.startswith("^") and len(body) > 1
            members = "".join(m if m == "-" and 0 < k < len(body[negated:]) - 1 else _quoted(m)
                              for k, m in enumerate(body[negated:]))
            out.append(f"[{'^' if negated else ''}{members}]")
            i = end
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or _quoted(ch))
        i += 1
    flags = "(?isu)" if case_insensitive else "(?s)"
    return col.rlike(f"{flags}\\A{''.join(out)}\\z")


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or ch.isspace() or ord(ch) > 127 else "\\" + ch


def contains_pattern(term: str) -> str:
    """``'%' + term + '%'`` — the search-box form of a LIKE term."""
    return f"%{term}%"


def reporting_qty(qty: Column, factor: Column) -> Column:
    """Stock units -> reporting units.  A zero factor yields NULL, not an error."""
    return qty / F.nullif(factor, F.lit(0))


def reporting_cost(cost: Column, factor: Column) -> Column:
    """Cost per stock unit -> cost per reporting unit."""
    return cost * factor


def unit_cost_from_value(value: Column, qty: Column) -> Column:
    """Value / quantity when the quantity is not zero, else NULL."""
    return F.when(qty != 0, value / qty)


def starts_numeric(name: Column) -> Column:
    """True when the first character would count as numeric (sign, digit,
    separator, currency symbol).  NULL and empty names are not numeric."""
    return F.coalesce(F.substring(name, 1, 1).rlike(NUMERIC_FIRST_CHAR), F.lit(False))


def mismatch_flag(requested: Column, reporting: Column, label: str, ok: str = "OK",
                  case_insensitive: bool = False) -> Column:
    """``label`` when the two unit codes differ; ``ok`` when equal or unknown."""
    differ = collated(requested, case_insensitive) != collated(reporting, case_insensitive)
    return F.when(differ, F.lit(label)).otherwise(F.lit(ok))


def days_before(ts, days: int) -> Column:
    """``ts - days`` as a TIMESTAMP_NTZ value (the look-back bound); ``ts=None``
    is the current local timestamp."""
    base = F.localtimestamp() if ts is None else ntz(ts)
    return base - F.expr(f"INTERVAL {int(days)} DAYS")
