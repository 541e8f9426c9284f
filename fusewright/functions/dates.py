"""Dates in free form: one pass over the tokens of a text fills slots of day, month and year.

Numbers, month names, weekdays, fillers and a time are read in any order; anything else makes the text unreadable.  Slots that the
text leaves open are those of January 2000.  Which number is which follows from names, from sizes and from the order month, day, year.

Every token becomes six characters, a kind and a value: M a named month, L a number of three digits and more, Y one above 31, D one above 12, N another.  The
kinds in a row are looked up in a table of all their sequences, which says where year, month and day stand.
"""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import Column

from .lookups import DATE_FILLERS, LONG_MONTHS, MONTHS, WEEKDAYS
from .text import bind, let_sql, quoted

_CLOCK = r"(?i)(?<![\d:])\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]m)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?(?![\w:])|(?<![\d:])\d{1,2}\s*[ap]m(?!\w)"
_TOKEN = r"(\d+(?:\.\d+)?|[a-z]+|[^\sa-z\d])"
# digits without separators: year of four or two, month, day, and hours at the end; three numbers with dots
_PACKED, _PACKED_SHORT, _DOTTED = r"(?<![\d.])(\d{4})(\d{2})(\d{2})(?:\d{4}|\d{6})?(?![\d.])", r"^\s*(\d{2})(\d{2})(\d{2})(?![\d.])", r"(?<![\d.])(\d+)\.(\d+)\.(\d+)(?![\d.])"
_KINDS = "-MLYDN"
_OPEN = "L02000M00001D00001"  # the slots of an open year, month and day, before those of the text
_BAD, _DAY = "!", "w"


def _places(kinds: str) -> str | None:
    """Where year, month and day stand in a sequence of kinds, as digits from 4 on; 1, 2 and 3 stand for open ones.  None: they cannot be told."""
    month = kinds.find("M")
    if kinds.count("M") > 1 or kinds.count("L") > 1:
        return None
    year_like = lambda i: kinds[i] in "LY"
    n, order = len(kinds), {}
    if n == 1:
        order = {"m" if month == 0 else "y" if year_like(0) else "d": 0}
    elif n == 2 and month >= 0:
        order = {"m": month, "y" if year_like(1 - month) else "d": 1 - month}
    elif n == 2:
        order = {"y": 0, "m": 1} if year_like(0) else {"m": 0, "y": 1} if year_like(1) else {"m": 0, "d": 1}
    elif month >= 0 and "L" in kinds:
        order = {"m": month, "y": kinds.index("L")}
        order["d"] = 3 - sum(order.values())
    elif month == 0:
        order = dict(zip("myd" if year_like(1) else "mdy", range(3)))
    elif month == 1:
        order = dict(zip("ymd" if year_like(0) else "dmy", range(3)))
    elif month == 2:
        order = dict(zip("dym" if year_like(1) else "ydm", range(3)))
    else:
        order = dict(zip("ymd" if year_like(0) else "dmy" if kinds[0] == "D" else "mdy", range(3)))
    return "".join(str(order[k] + 4 if k in order else i + 1) for i, k in enumerate("ymd"))


_WORDS = {m: f"M{i + 1:05}" for i, m in enumerate(MONTHS)} | {m: f"M{MONTHS.index(m[:3]) + 1:05}" for m in LONG_MONTHS} | dict.fromkeys(WEEKDAYS, _DAY) | dict.fromkeys(DATE_FILLERS, "")
_SEQUENCES = {"".join(k): p for n in (1, 2, 3) for k in itertools.product("MLYDN", repeat=n) if (p := _places("".join(k)))}


def _replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)})"


def _slot(token: str) -> str:
    """Kind and value of a token, nothing for a filler."""
    two = f"lpad({token}, 2, '0')"
    kind = f"CASE WHEN length({token}) > 2 THEN 'L' WHEN {two} > '31' THEN 'Y' WHEN {two} > '12' THEN 'D' ELSE 'N' END"
    number = f"CASE WHEN length({token}) > 4 THEN '{_BAD}' ELSE concat({kind}, lpad({token}, 5, '0')) END"
    words = f"str_to_map({quoted('|'.join(f'{k}={v}' for k, v in _WORDS.items()))}, {quoted('[|]')}, '=')"  # one literal: a plan of a few nodes
    digit = f"{token} BETWEEN '0' AND '9:'"
    return f"CASE WHEN {digit} AND NOT contains({token}, '.') THEN {number} WHEN {digit} THEN '{_BAD}' ELSE coalesce(try_element_at({words}, {token}), '{_BAD}') END"


def _places_of(slots: str) -> str:
    """The places for the kinds of up to three slots, found by a number made of them."""
    table = [_SEQUENCES.get("".join(_KINDS[i] for i in (a, b, c) if i), "") for a, b, c in itertools.product(range(6), repeat=3)]
    where = [f"CASE WHEN length({slots}) > {6 * i} THEN instr('{_KINDS[1:]}', substring({slots}, {6 * i + 1}, 1)) ELSE 0 END" for i in range(3)]  # 0 for no slot
    return f"get(split('{','.join(table)}', ','), ({where[0]}) * 36 + ({where[1]}) * 6 + ({where[2]}))"


def sql_free_date(text: str, this_year: int | None = None) -> str:
    """SQL of ``free_date``."""
    now = this_year or datetime.date.today().year
    clock = _replaced(_replaced("low", r"(?<=\d)t(?=\d{2}:)", " "), _CLOCK, " ")
    timed = f"CASE WHEN low RLIKE {quoted(r':|\dm|\d\s*[ap]m')} THEN {clock} ELSE low END"
    parted = _replaced(_replaced(_replaced("timed", _PACKED, "$1 $2 $3"), _PACKED_SHORT, "$1 $2 $3"), _DOTTED, "$1 $2 $3")
    plain = f"CASE WHEN timed RLIKE {quoted(r'\d{6}|\d\.\d')} THEN {parted} ELSE timed END"
    slots = f"array_join(transform(regexp_extract_all({plain}, {quoted(_TOKEN)}, 1), token -> {_slot('token')}), '')"
    blank = "CASE WHEN timed != low THEN '2000-01' END"
    dated = bind("kinds", f"replace(slots, '{_DAY}', '')", _read("kinds", now))
    told = bind("slots", slots, f"CASE WHEN contains(slots, '{_BAD}') THEN NULL WHEN slots = '' THEN {blank} ELSE {dated} END")
    return bind("low", f"lower({text})", bind("timed", timed, told))


def _read(slots: str, now: int) -> str:
    """The date of the slots."""
    places = f"CASE WHEN {slots} = '' THEN '123' WHEN length({slots}) > 18 THEN '' ELSE {_places_of(slots)} END"
    at = [f"substr(whole, CAST(substring(places, {i}, 1) AS INT) * 6 - 5, 6)" for i in (1, 2, 3)]
    part = f"named_struct('y', {at[0]}, 'm', CAST(substr({at[1]}, 2) AS INT), 'd', CAST(substr({at[2]}, 2) AS INT))"
    whole = bind("whole", f"concat('{_OPEN}', {slots})", bind("part", part, _checked(now)))
    return bind("places", places, f"CASE WHEN places != '' THEN {whole} END")


def _checked(now: int) -> str:
    """The date of ``part``, if there is such a day."""
    leap = "((year % 4 = 0 AND year % 100 != 0) OR year % 400 = 0)"
    last = f"CASE WHEN part.m = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN part.m IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    good = f"year > 0 AND part.m BETWEEN 1 AND 12 AND part.d > 0 AND (part.d < 29 OR part.d <= {last})"
    number = "CAST(substr(part.y, 2) AS INT)"
    century = bind("near", f"{number} + 2000", f"CASE WHEN near >= {now + 50} THEN near - 100 WHEN near < {now - 50} THEN near + 100 ELSE near END")
    text = "concat(lpad(CAST(year AS STRING), 4, '0'), '-', lpad(CAST(part.m AS STRING), 2, '0'))"
    return bind("year", f"CASE WHEN startswith(part.y, 'L') THEN {number} ELSE {century} END", f"CASE WHEN {good} THEN {text} END")


def free_date(c: Column, this_year: int | None = None) -> Column:
    """YYYY-MM of a date in any spelling, else null.  Years of two digits lie within fifty years of ``this_year``."""
    return let_sql(c, sql_free_date("x", this_year))
