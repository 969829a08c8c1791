"""Copy-number states: ``array<struct<major,minor,frac>>`` inside, text at the edges.

The text form is ``major,minor,fraction``, with a bar before a second state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state(major: Column, minor: Column, frac: Column) -> Column:
    return F.struct(
        major.cast("double").alias("major"),
        minor.cast("double").alias("minor"),
        frac.cast("double").alias("frac"),
    )


def parse(text: Column) -> Column:
    """Text to states; NULL where the text is empty, or any number in it is not one."""

    def one(part: Column) -> Column:
        nums = F.transform(F.split(part, ","), lambda n: n.try_cast("double"))
        return state(F.get(nums, 0), F.get(nums, 1), F.get(nums, 2))

    states = F.transform(F.split(text, r"\|"), one)
    broken = F.exists(
        states, lambda s: s["major"].isNull() | s["minor"].isNull() | s["frac"].isNull()
    )
    return F.when(text.isNull() | (text == "") | broken, None).otherwise(states)


def render(states: Column) -> Column:
    """States to text; NULL stays NULL."""
    text = F.concat_ws(
        "|",
        F.transform(
            states,
            lambda s: F.concat_ws(
                ",", s["major"].cast("string"), s["minor"].cast("string"), s["frac"].cast("string")
            ),
        ),
    )
    return F.when(states.isNotNull(), text)


def is_neutral(states: Column) -> Column:
    """One state, 1 + 1 in all cells."""
    first = F.get(states, 0)
    hit = (
        (F.size(states) == 1)
        & (first["major"] == 1)
        & (first["minor"] == 1)
        & (first["frac"] == 1)
    )
    return F.coalesce(hit, F.lit(False))


def is_clonal(states: Column) -> Column:
    return F.coalesce(F.size(states) == 1, F.lit(False))


def exceeds(states: Column, limit: int) -> Column:
    over = F.exists(states, lambda s: (s["major"] > limit) | (s["minor"] > limit))
    return F.coalesce(over, F.lit(False))


def blank_invalid(states: Column) -> Column:
    """NULL for a single state that is 0 + 0 or negative."""
    first = F.get(states, 0)
    bad = (F.size(states) == 1) & (
        ((first["major"] == 0) & (first["minor"] == 0)) | (first["major"] < 0) | (first["minor"] < 0)
    )
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(states)


def default_states(ploidy: Column) -> Column:
    """States assumed where none is known: half of the ploidy for each allele."""
    whole = F.bround(ploidy)
    half = F.bround(ploidy / 2)
    diploid_up = whole > 1
    return F.array(
        state(
            F.when(diploid_up, half).otherwise(1.0),
            F.when(diploid_up, half).otherwise(0.0),
            F.lit(1.0),
        )
    )


def mean_total(states: Column) -> Column:
    """Copies over all cells: sum of (major + minor) x fraction; 2 where unknown."""
    total = F.aggregate(
        states, F.lit(0.0), lambda acc, s: acc + (s["major"] + s["minor"]) * s["frac"]
    )
    return F.coalesce(total, F.lit(2.0))


def weighted_ratio(states: Column) -> Column:
    """Copies relative to two."""
    return mean_total(states) / 2


def component(states: Column, index: int, name: str) -> Column:
    """One number of one state, 0 where that state is absent."""
    return F.coalesce(F.get(states, index)[name], F.lit(0.0))


def state_columns(states: Column, tag: str = "") -> dict[str, Column]:
    """The eight model-input columns of a locus (two states, padded with zeros)."""
    out = {}
    for i in (0, 1):
        major, minor = component(states, i, "major"), component(states, i, "minor")
        out[f"major_cn{tag}_sub{i + 1}"] = major
        out[f"minor_cn{tag}_sub{i + 1}"] = minor
        out[f"total_cn{tag}_sub{i + 1}"] = major + minor
        out[f"frac_cn{tag}_sub{i + 1}"] = component(states, i, "frac")
    return out
