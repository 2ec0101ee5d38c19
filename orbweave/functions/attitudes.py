"""First and last attitude from containers of any known shape, held as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of roll, pitch and yaw.
NAMES = (("roll", "pitch", "yaw"), ("gamma", "pi", "psi"), ("roll_angle", "pitch_angle", "yaw_angle"))


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _whole(values: list[Column]) -> Column:
    """The three as numbers, null if one is none."""
    numbers = [F.try_variant_get(v, "$", "double").alias(n) for v, n in zip(values, NAMES[0])]
    return F.when(reduce(lambda a, b: a & b, [n.isNotNull() for n in numbers]), F.struct(*numbers))


def _has(m: Column, names: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.map_contains_key(m, n) for n in names])


def _values(m: Column, names: tuple) -> list[Column]:
    return [F.try_element_at(m, F.lit(n)) for n in names]


def _record(m: Column) -> Column:
    """One attitude under the first set of names that the record has all of."""
    return reduce(lambda c, names: c.when(_has(m, names), _whole(_values(m, names))), NAMES, F)


def attitude_of(angles: Column, last: bool = False) -> Column:
    """struct<roll, pitch, yaw> of the first (or last) sample of a container (B14), null where it has none.

    Shapes: a list of records, by any of NAMES; a list of lists of three or more numbers; a record of lists, by the first two of
    NAMES, which may differ in length; a record of numbers by angle names; a record with such a record inside, of several the
    first by key. Texts of numbers are read. Empty lists, missing parts, values that are no numbers, other shapes and null give
    null; a record of lists is judged by its own names alone.
    """
    end = lambda v: F.try_element_at(_list(v), F.lit(-1 if last else 1))
    sample, m = end(angles), _map(angles)
    row = F.when(F.size(_list(sample)) >= 3, _whole([F.get(_list(sample), i) for i in range(3)]))
    of_lists = reduce(lambda c, names: c.when(_has(m, names), _whole([end(v) for v in _values(m, names)])), NAMES[:2], F)
    inside = F.get(F.filter(F.transform(F.map_values(m), lambda v: _record(_map(v))), lambda r: r.isNotNull()), 0)
    named = reduce(lambda a, b: a | b, [_has(m, names) for names in NAMES[:2]])
    return F.coalesce(_record(_map(sample)), row, of_lists, F.when(~named, F.coalesce(_record(m), inside)))
