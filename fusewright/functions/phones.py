"""Phone numbers in E.164, judged by a table of numbering plans: the longest prefix is found by binary search in columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column

from .lookups import NANP, PHONES
from .text import bind, let_sql, quoted

DIGITS = 15  # the most that a number has


@functools.cache
def plans() -> dict[str, tuple[int, int, int]]:
    """prefix (calling code and first national digit): digits of the code, least and most national digits."""
    out = {}
    for code, rules in PHONES.items():
        out[code] = (len(code), 1, 0)  # no number of this code but for the longer prefixes
        for rule in rules.split():
            first, sizes = rule.split(":")
            low, high = first[0], first[-1]
            least, most = sizes.split("-") if "-" in sizes else (sizes, sizes)
            for digit in range(int(low), int(high) + 1):
                out[f"{code}{digit}"] = (len(code), int(least), int(most))
    return out


@functools.cache
def intervals() -> list[tuple[int, int, int, int]]:
    """(first number of 15 digits, digits of the code, least, most): each number lies in the interval of its longest prefix."""
    starts: dict[int, tuple[int, int, int]] = {0: (0, 1, 0)}
    spans = sorted((int(p.ljust(DIGITS, "0")), int(p.ljust(DIGITS, "9")) + 1, len(p), rule) for p, rule in plans().items())
    for point in sorted({x for a, b, *_ in spans for x in (a, b)}):
        over = [(n, rule) for a, b, n, rule in spans if a <= point < b]
        starts[point] = max(over)[1] if over else (0, 1, 0)
    merged: list[tuple[int, int, int, int]] = []
    for point, rule in sorted(starts.items()):
        if not merged or merged[-1][1:] != rule:
            merged.append((point, *rule))
    return merged


def _valid(digits: str) -> str:
    """SQL: whether a number of digits with its calling code follows a plan."""
    table = intervals()
    # tables as one text each, which the optimiser splits once: a plan of a few nodes
    starts, rules = (f"split('{','.join(column)}', ',')" for column in zip(*((f"{n:0{DIGITS}}", f"{a:02}{b:02}{c:02}") for n, a, b, c in table)))
    # steps of a halving size: the last start that is not above the number
    sizes = ", ".join(str(1 << k) for k in reversed(range(len(table).bit_length())))
    search = f"aggregate(array({sizes}), 0, (i, size) -> CASE WHEN get({starts}, i + size) <= number THEN i + size ELSE i END)"
    part = [f"CAST(substring(rule, {i}, 2) AS INT)" for i in (1, 3, 5)]
    fourth = f"(NOT startswith({digits}, '{NANP[0]}') OR substring({digits}, {NANP[1] + len(NANP[0])}, 1) >= '{NANP[2]}')"
    judged = f"length({digits}) - {part[0]} BETWEEN {part[1]} AND {part[2]} AND {fourth}"
    found = bind("number", f"rpad({digits}, {DIGITS}, '0')", bind("rule", f"get({rules}, {search})", judged))
    return f"CASE WHEN length({digits}) <= {DIGITS} AND {digits} != '' THEN {found} ELSE false END"


def sql_phone(x: str, calling_code: str = "91") -> str:
    """SQL of ``phone``."""
    # the digits, with the sign of a number that begins with one
    kept = f"regexp_replace(regexp_replace({x}, {quoted(r'[^0-9+\-\(\)\s]')}, ''), {quoted(r'(?<=.)\+|[^0-9+]')}, '')"
    code = quoted(calling_code)
    abroad = bind("d", "substr(n, 2)", f"CASE WHEN {_valid('d')} THEN n END")
    home = f"CASE WHEN {_valid('h')} THEN concat('+', h) WHEN startswith(n, {code}) AND {_valid('n')} THEN concat('+', n) END"
    here = bind("h", f"concat({code}, regexp_replace(n, '^0', ''))", home)
    return bind("n", kept, f"CASE WHEN startswith(n, '+') THEN {abroad} ELSE {here} END")


def phone(c: Column, calling_code: str = "91") -> Column:
    """E.164, for numbers that follow a plan; without a plus the default calling code counts."""
    return let_sql(c, sql_phone("x", calling_code))
