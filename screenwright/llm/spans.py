"""Pattern matches with their positions, as column expressions.

Spark gives the matches of a pattern and the pieces between them; positions are running sums of their lengths. Both come
from the same leftmost, non-overlapping search. Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:string,value:string,part:string>"
#: Matches, and code points of a text, that are handled as one block.
MATCHES, CHARS = 64, 1024
_FAR = 2**30


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def none() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def before(numbers: str, combine: str, zero: int) -> str:
    """SQL of a running total: for each element of an array of ints, all elements before it combined, ``zero`` if none.

    ``combine`` is an associative expression of ``s`` and ``x``. Totals are worked out by block, then within each block:
    ``aggregate`` copies its state at every step, so a state that gathers results would cost the square of their number.
    """
    def total(array: str, start: str) -> str:
        return f"aggregate({array}, {start}, (s, x) -> {combine})"

    block = f"slice(v, b * {MATCHES} + 1, {MATCHES})"
    each = f"sequence(0, CAST(greatest(size(v) - 1, 0) div {MATCHES} AS INT))"
    return f"""transform(array({numbers}), v -> transform(array(transform({each}, b -> {total(block, str(zero))})), sums ->
        flatten(transform({each}, b -> transform(array({total("slice(sums, 1, b)", str(zero))}), start ->
            transform({block}, (y, j) -> {total(f"slice(v, b * {MATCHES} + 1, j)", "start")}))[0])))[0])[0]"""


def spans(text: str, pattern: str, kind: str, part: int = 0) -> Column:
    """All matches in ``text``; ``part`` is a group of the pattern given along. Null and matchless texts give none."""
    p = quoted(pattern)
    pieces = (f"filter(arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), regexp_extract_all({text}, {p}, 0), "
              f"regexp_extract_all({text}, {p}, {part})), x -> x.`1` IS NOT NULL)")
    at = before("transform(m, x -> x.`0` + length(x.`1`))", "s + x", 0)
    return F.expr(f"""CASE WHEN {text} RLIKE {p} THEN transform(array({pieces}), m -> zip_with(m, {at}, (x, s) ->
        named_struct('start', s + x.`0`, 'end', s + x.`0` + length(x.`1`), 'kind', '{kind}', 'value', x.`1`,
                     'part', x.`2`)))[0] ELSE CAST(array() AS array<{SPAN}>) END""")


def blocks(text: str) -> str:
    """SQL of a text as an array of ``CHARS`` code points each, for ``cut``."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHARS}}}', 0)"


def cut(pieces: str, start: str, end: str) -> str:
    """SQL of the code points from ``start`` to ``end`` of a text in ``blocks``, without reading it from its beginning."""
    return (f"substring(array_join(slice({pieces}, ({start}) div {CHARS} + 1, greatest(0, (({end}) - 1) div {CHARS} "
            f"- ({start}) div {CHARS} + 1)), ''), ({start}) % {CHARS} + 1, ({end}) - ({start}))")


def in_order(arrays: list[str], kinds: list[str]) -> Column:
    """All spans of some array columns by start, then in the order of ``kinds``."""
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds)) + " END"
    return F.expr(f"""transform(array_sort(transform(concat({', '.join(arrays)}),
        x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', x.kind))),
        x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))""")


def joined(array: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.expr(f"array_join(transform({array}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def neighbours(array: str, others: str) -> str:
    """SQL of ``struct<x, before, after>`` for each span of ``array``, whose spans are sorted and apart: the largest end
    of the ``others`` that start no later, and the smallest start of those that start later.

    One sort of all spans and a pass in each direction, so the work grows with their number and not with its square.
    """
    events = (f"array_sort(concat(transform({others}, y -> named_struct('start', y.start, 'own', 0, 'end', y.end)), "
              f"transform({array}, y -> named_struct('start', y.start, 'own', 1, 'end', y.end))))")
    ends = before(f"transform(e, y -> IF(y.own = 0, y.end, -{_FAR}))", "greatest(s, x)", -_FAR)
    starts = before(f"transform(reverse(e), y -> IF(y.own = 0, y.start, {_FAR}))", "least(s, x)", _FAR)

    def of_own(found: str, order: str) -> str:
        return f"filter(zip_with({found}, {order}, (far, y) -> IF(y.own = 1, far, NULL)), far -> far IS NOT NULL)"

    return f"""CASE WHEN size({array}) > 0 THEN transform(array({events}), e -> zip_with(
        zip_with({array}, {of_own(ends, "e")}, (x, far) -> named_struct('x', x, 'before', far)),
        reverse({of_own(starts, "reverse(e)")}),
        (x, far) -> named_struct('x', x.x, 'before', x.before, 'after', far)))[0] END"""


def free_of(array: str, others: str) -> Column:
    """The spans of ``array``, sorted and apart, that overlap none of ``others``."""
    return F.expr(f"coalesce(transform(filter({neighbours(array, others)}, n -> n.before <= n.x.start AND n.after >= n.x.end), "
                  f"n -> n.x), CAST(array() AS array<{SPAN}>))")


def replaced(text: str, array: str) -> Column:
    """``text`` with every span of the sorted ``array`` replaced by its kind in brackets; overlapping ones merge."""
    at = before(f"transform({array}, x -> x.end)", "greatest(s, x)", 0)
    piece = f"IF(x.start < s, '', concat({cut('p', 's', 'x.start')}, '[', upper(x.kind), ']'))"
    return F.expr(f"""
        CASE WHEN size({array}) = 0 THEN {text} ELSE concat(
            transform(array({blocks(text)}), p -> array_join(zip_with({array}, {at}, (x, s) -> {piece}), ''))[0],
            substring({text}, array_max(transform({array}, x -> x.end)) + 1)) END""")
