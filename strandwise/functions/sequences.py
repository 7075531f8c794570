"""Scalar functions over aligned sequences, measurements and table cells, all as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 30
GAP = "-"
ALPHABET = "-ACDEFGHIKLMNPQRSTVWY"
ALL_GAP = GAP * LENGTH
EPS = 1e-12
#: Java's (?U)\s and the four separators that Unicode calls control characters.
_BLANK = r"(?U)[\s\u001c-\u001f]+"


def aligned_from_text(text: Column) -> Column:
    """The first 30 standard residues of the ASCII letters, padded by gaps; null text is all gap. Texts whose start has 30 aren't scanned to their ends."""

    def residues_of(part: Column) -> Column:
        return F.regexp_replace(F.upper(F.regexp_replace(part, "[^A-Za-z]+", "")), "[BJOUXZ]+", "")

    text = F.coalesce(text, F.lit(""))
    start = residues_of(F.substring(text, 1, 4 * LENGTH))
    return F.when(F.length(start) >= LENGTH, F.substring(start, 1, LENGTH)).otherwise(F.rpad(F.substring(residues_of(text), 1, LENGTH), LENGTH, GAP))


def normalise(raw: Column, aligned: bool = True) -> tuple[Column, Column]:
    """(value, error code): the first rule that fails names the error, and the value is then null."""
    bare = F.regexp_replace(raw, _BLANK, "")
    up = F.upper(bare)
    rules = [(raw.isNull(), "not_text"), (raw.contains(">"), "fasta_header"), (bare.rlike("[^\\x00-\\x7F]"), "non_ascii"), (up == "", "empty")]
    if aligned:
        rules.append((F.length(up) != LENGTH, "length"))
    rules.append((up.rlike(f"[^{ALPHABET[1:]}-]"), "alphabet"))
    if aligned:
        rules.append((~up.rlike("[^-]"), "all_gap"))
    error = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    return F.when(error.isNull(), up), error


def residues(aligned: Column) -> Column:
    return F.length(F.replace(aligned, F.lit(GAP), F.lit("")))


def identity(a: Column, b: Column) -> Column:
    """Equal residues over the columns that aren't gaps in both; null if there are none. Unrolled, so it stays in generated code."""
    at = [(F.substring(a, i, 1), F.substring(b, i, 1)) for i in range(1, LENGTH + 1)]
    same = sum((((x == y) & (x != GAP)).cast("int") for x, y in at), F.lit(0))
    used = sum((((x != GAP) | (y != GAP)).cast("int") for x, y in at), F.lit(0))
    return F.when(used > 0, same / used)


def hamming(a: Column, b: Column) -> Column:
    return sum(((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, LENGTH + 1)), F.lit(0))


def one_hot(aligned: Column) -> Column:
    """Active feature of each column: position * 21 + symbol's place in the alphabet."""
    return F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda p: p * len(ALPHABET) + F.position(F.substr(aligned, p + 1, F.lit(1)), F.lit(ALPHABET)) - 1)


def tier(best: Column) -> Column:
    return F.when(best >= 0.85, "close_analogue").when(best >= 0.70, "distant_analogue").otherwise("outside_reference_neighborhood")


def evidence(best: Column) -> Column:
    return F.when(best >= 1 - EPS, "training_reference_match").when(best >= 0.85, "local_analogue_mixed_evidence").when(best >= 0.70, "outside_ranking_scope").otherwise("far_outside_reference_scope")


def direction(sel: Column) -> Column:
    """Which receptor a tenfold-log difference prefers, at a threefold ratio."""
    ratio = F.pow(F.lit(10.0), sel)
    return F.when(ratio >= 3, "glp1r_preferring").when(ratio <= 1 / 3, "gcgr_preferring").otherwise("within_threefold")


def parse_replicate(cell: Column, is_text: Column) -> tuple[Column, Column, Column]:
    """(status, value, threshold): numbers are observed, text must be a bound such as >280,000."""
    bound = F.try_to_number(F.regexp_extract(F.replace(cell, F.lit(","), F.lit("")), r"^\s*>\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1), F.lit("999999999999999.999999")).cast("double")
    number = cell.try_cast("double")
    status = F.when(cell.isNull() | (F.trim(cell) == ""), "missing").when(~is_text & (number > 0) & (number < float("inf")), "observed").when(is_text & (bound > 0), "right_censored").otherwise("error")
    return status, F.when(status == "observed", number), F.when(status == "right_censored", bound)


def constraint_loss(status: Column, value: Column, guess: Column) -> Column:
    """How far a prediction violates what was observed; null where nothing was learned."""
    return F.when(status == "exact", F.abs(guess - value)).when(status == "lower_bound", F.greatest(F.lit(0.0), value - guess)).when(status == "upper_bound", F.greatest(F.lit(0.0), guess - value))


def censor_loss(status: Column, value: Column, guess: Column) -> Column:
    return F.when(status == "observed", F.abs(guess - value)).when(status == "right_censored", F.greatest(F.lit(0.0), value - guess)).when(status == "left_censored", F.greatest(F.lit(0.0), guess - value))


def candidate_id_error(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "missing_id").when(~value.rlike("^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"), "invalid_id")


def spreadsheet_safe(value: Column) -> Column:
    """Control characters as escapes, and a quote before what a spreadsheet would run."""
    plain = F.array_join(F.transform(F.split(value, ""), lambda c: F.when((F.ascii(c) < 32) & (c != "") | (F.ascii(c) == 127), F.format_string("\\u%04x", F.ascii(c))).otherwise(c)), "")
    return F.when(plain.rlike("^[=+\\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)


def squeeze(text: Column) -> Column:
    """Lower case, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("-"), F.lit(" "))), r"\s+", " "))


def weight_hundredths(position: Column, symbol: Column, which: int) -> Column:
    """Stand-in coefficients of a frozen linear model, whole hundredths so that sums don't depend on their order. Position counts from 0."""
    a, b, m, c = ((31, 17, 101, 50), (13, 29, 97, 48))[which]
    return (position * a + F.ascii(symbol) * b) % m - c


def weight(position: Column, symbol: Column, which: int) -> Column:
    return weight_hundredths(position, symbol, which) / 100.0


def linear(aligned: Column, which: int) -> Column:
    """The frozen model's prediction: the intercept and the active weights."""
    return sum((weight_hundredths(F.lit(i), F.substring(aligned, i + 1, 1), which) for i in range(LENGTH)), F.lit(0)) / 100.0 + F.lit((2.0, 1.5)[which])
