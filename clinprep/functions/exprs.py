"""Small column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(mapping: dict) -> Column:
    """A constant map column; meant for controlled vocabularies only."""
    cells = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*cells)


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of ``key`` in a small fixed mapping, else ``default`` (null)."""
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, default)


def decode(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Like ``lookup`` as a ``CASE`` over the keys: compiled code, open to simplification.

    Meant for a plain key column; the key expression is repeated per entry.
    """
    return first_match([(key == k, F.lit(v)) for k, v in mapping.items()], default)


def first_match(cases, default: Column | None = None) -> Column:
    """``CASE WHEN`` over ``(condition, value)`` pairs in order."""
    cases = list(cases)
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words) -> Column:
    """True when the text holds any of the words as a plain substring.

    A word that holds another of the words adds nothing and is not searched for.
    """
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return any_of([text.contains(w) for w in needed])


class Phrases:
    """Substring tests on a text for many phrases, most of which few texts hold.

    Every phrase holds one of a few short needles. Each needle is searched once, in a column of its
    own (``found``, to be staged beside the text), and a phrase only where its needle is.
    """

    def __init__(self, *groups):
        phrases = list(dict.fromkeys(w for group in groups for w in group))
        self.needles = [w for w in phrases if not any(o != w and o in w for o in phrases)]

    def searched(self, text: Column) -> Column:
        """One boolean per needle, to be staged as a column."""
        return F.struct(*[text.contains(w).alias(f"n{i}") for i, w in enumerate(self.needles)])

    def within(self, text: Column, found: Column):
        """``test(words)``: whether the text holds any of them, given the staged ``found``."""
        def test(words) -> Column:
            under: dict[int, list[str]] = {}
            for word in dict.fromkeys(words):
                place = next(i for i, needle in enumerate(self.needles) if needle in word)
                under.setdefault(place, []).append(word)
            return any_of([
                found[f"n{i}"] if self.needles[i] in held else found[f"n{i}"] & contains_any(text, held)
                for i, held in under.items()])

        return test


def compare(value: Column, op: str, bound: float) -> Column:
    return {"<": value < bound, ">": value > bound,
            "<=": value <= bound, ">=": value >= bound}[op]


def seeded_hash(seed: int, *cols) -> Column:
    """Reproducible pseudo-random order: md5 of the seed and the id, as hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def scalar(df, expr: Column) -> Column:
    """A one-row aggregate of ``df`` used as a scalar subquery."""
    return df.select(expr).scalar()


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    col = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(col.cast("timestamp"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for costly inputs used several times."""
    return F.get(F.transform(F.array(value), body), 0)


def spread_nulls(key: Column, *spread) -> Column:
    """A text join key in which null keys (which match nothing) do not all share one partition."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.xxhash64(*spread).cast("string")))


def vocabulary_join(df, rows: list[tuple], schema: str, key: str, how: str = "inner"):
    """Join a fixed vocabulary (a few dozen literal rows) by broadcast.

    As columns of a join the looked-up values are computed once per row; as ``CASE``
    expressions the optimizer would copy them into every filter above.
    """
    table = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(table), key, how)
