"""Column functions: codes, ids, ratios and labels. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The valence codes, and the names of joint emissions by valence.
VALENCE = {"Negative": 0, "Neutral": 1, "Positive": 2}
VALENCE_SHORT = ("neg", "neu", "pos")
N_VALENCE = 3
N_JOINT = N_VALENCE * N_VALENCE


def joint(therapist: Column | str, client: Column | str) -> Column:
    """One symbol, 0 to 8, for the pair of codes."""
    t = F.col(therapist) if isinstance(therapist, str) else therapist
    c = F.col(client) if isinstance(client, str) else client
    return t * N_VALENCE + c


def number(x: Column) -> Column:
    """A double, or null where there is none to read; NaN becomes null."""
    return F.nullif(x.try_cast("double"), F.lit(float("nan")))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0))


def log_clipped(x: Column, least: float = 1e-300) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def rounded(x: Column, digits: int = 6) -> Column:
    """For results that other engines check: a fixed number of digits and no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def zscore(x: Column, *by: str) -> Column:
    """Within groups, against the population deviation; null where that is 0. Over all rows see rollup.standardised()."""
    if not by:
        raise ValueError("zscore() is for groups")
    w = Window.partitionBy(*map(F.col, by))
    return (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))


def mapped(code: Column, legend: Mapping[int, int]) -> Column:
    """A code's value in a small legend; null for unknown codes."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in legend.items() for x in pair)), code)


def leading_number(x: Column) -> Column:
    """The digits an id begins with, as a number."""
    return F.regexp_extract(x, "^([0-9]+)", 1).try_cast("int")


def dyad_key(x: Column) -> Column:
    """A pair's id: what stands before the first dot, its digits padded to three, or without digits the upper-case text."""
    head = F.split_part(F.trim(x), F.lit("."), F.lit(1))
    digits = F.regexp_replace(head, "[^0-9]", "")
    return F.when(digits != "", F.format_string("%03d", digits.try_cast("int"))).otherwise(F.upper(head))


def session_key(x: Column) -> Column:
    """A survey's session code as NNN_A or NNN_B; null where it isn't one."""
    s = F.regexp_replace(F.upper(F.trim(x)), " ", "")
    digits = F.regexp_replace(F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0))), "[^0-9]", "")
    last = F.right(s, F.lit(1))
    good = (F.length(s) >= 2) & last.isin("A", "B") & (digits != "")
    return F.when(good, F.concat(F.format_string("%03d", digits.try_cast("int")), F.lit("_"), last))


def window_id(session: Column, window: Column) -> Column:
    return F.concat(session.cast("string"), F.lit("__w"), F.format_string("%04d", window))


def episode_id(session: Column, regime: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", *(x.cast("string") for x in (session, regime, start, end)))


def motif_digits(motif: Column, k: int, base: int = N_JOINT) -> Column:
    """A motif's number as its symbols, oldest first."""
    return F.array(*(F.pmod(F.floor(motif / F.lit(base ** (k - 1 - i))), F.lit(base)).cast("int") for i in range(k)))


def motif_text(motif: Column, k: int, base: int = N_JOINT) -> Column:
    return F.array_join(F.transform(motif_digits(motif, k, base), lambda x: x.cast("string")), "-")


def first_largest(values: Column) -> Column:
    """The position, from 0, of the first of an array's largest values."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def valence_label(therapist: Column, client: Column) -> Column:
    """Such as Tneg-Cpos, from two arrays of emission probabilities."""
    names = F.array(*(F.lit(v) for v in VALENCE_SHORT))
    return F.concat(F.lit("T"), names[first_largest(therapist)], F.lit("-C"), names[first_largest(client)])


def unlike(label: str, order: Sequence[str], by: Sequence[str] = ()) -> Column:
    """Labels that repeat get -1, -2, ... in the given order."""
    w = Window.partitionBy(*by, label)
    many = F.count("*").over(w) > 1
    return F.when(many, F.concat_ws("-", F.col(label), F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col(label))


def quadrant(client_effect: Column, therapist_effect: Column) -> Column:
    return F.when((client_effect > 0) & (therapist_effect > 0), "Bidirectional").when(client_effect > 0, "Client-led").when(therapist_effect > 0, "Therapist-led").otherwise("Weak")


def scaled(x: Column, low: float, span: float, *by: str) -> Column:
    """Within groups, low + span * x scaled to 0..1; low where all are equal. Over all rows see rollup.standardised()."""
    if not by:
        raise ValueError("scaled() is for groups")
    w = Window.partitionBy(*map(F.col, by))
    least, most = F.min(x).over(w), F.max(x).over(w)
    return F.lit(low) + F.lit(span) * F.coalesce((x - least) / F.nullif(most - least, F.lit(0.0)), F.lit(0.0))


def digest(values: Column) -> Column:
    """sha256 of an array's values joined by commas; independent of partitions if the array is sorted."""
    return F.sha2(F.array_join(F.transform(values, lambda x: x.cast("string")), ",").cast("binary"), 256)


def multiset_digest(digests: Column) -> Column:
    """md5 of a group's md5 digests in sorted order."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(digests)), "|").cast("binary"))
