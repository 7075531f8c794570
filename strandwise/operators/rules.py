"""Declared rules over tables, with the place of every issue.

A chain is a list of rules of which a row breaks the first that holds, so a rule may rely on those before it. All chains of
a table are evaluated in one pass; what needs other rows (an id's first holder, counts, sets of ids) comes from aggregates by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S

ISSUE = "struct<code:string,message:string,first_row:bigint>"


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column
    message: Column
    first_row: Column | None = None

    def made(self) -> Column:
        first = F.lit(None) if self.first_row is None else self.first_row
        return F.struct(F.lit(self.code).alias("code"), self.message.alias("message"), first.cast("long").alias("first_row"))


def chain(*rules: Rule) -> Column:
    """The first rule of a chain that a row breaks, or null; a condition that is null doesn't hold."""
    found = reduce(lambda c, r: c.when(r.broken, r.made()), rules[1:], F.when(rules[0].broken, rules[0].made()))
    return found.cast(ISSUE)


def placed(rows: DataFrame, sheet: str, chains: list[Column], place: str = "row") -> DataFrame:
    """severity, code, message, sheet, row and first_row of every issue of rows, by their place (a column)."""
    each = rows.select(F.col(place).cast("long").alias("row"), F.explode(F.array_compact(F.array(*chains))).alias("i"))
    return each.select(F.lit("error").alias("severity"), "i.code", "i.message", F.lit(sheet).alias("sheet"), "row", "i.first_row")


def with_first(rows: DataFrame, key: str, place: str = "row") -> DataFrame:
    """rows with __first, the least place of their id: only of ids that several rows have."""
    held = rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("__of")).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    return rows.join(held.drop("__n"), F.col(key) == F.col("__of"), "left").drop("__of")


def id_chain(key: str, place: str = "row") -> Column:
    """Of rows with_first()."""
    return chain(
        Rule("missing_id", F.coalesce(F.col(key), F.lit("")) == "", F.lit(f"no {key}")),
        Rule("duplicate_id", F.col(place) > F.col("__first"), F.concat(F.lit(f"{key} "), F.col(key), F.lit(" is that of row "), F.col("__first").cast("string")), F.col("__first")),
    )


def measure_chain(receptor: str, value: str, logarithm: str, tolerance: float) -> Column:
    """A positive finite value in pM, a finite log10 of it in M, and both the same within a tolerance."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    true = F.log10(F.col(value) * 1e-12)
    return chain(
        Rule("invalid_ec50", ~(finite(value) & (F.col(value) > 0)), F.lit(f"{receptor}: {value} isn't a positive finite number")),
        Rule("invalid_log_ec50", ~finite(logarithm), F.lit(f"{receptor}: {logarithm} isn't a finite number")),
        Rule("log_ec50_mismatch", F.abs(true - F.col(logarithm)) > tolerance, F.concat(F.lit(f"{receptor}: {logarithm} should be "), F.format_number(true, 4))),
    )


def residue_chain(sequence: str, alphabet: str) -> Column:
    """A text that isn't empty, of the alphabet's symbols."""
    others = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(F.upper(sequence), f"[{alphabet}]", ""), ""))), "")
    return chain(
        Rule("invalid_sequence", F.coalesce(F.col(sequence), F.lit("")) == "", F.lit(f"{sequence} is empty")),
        Rule("invalid_residue", F.upper(sequence).rlike(f"[^{alphabet}]"), F.concat(F.lit("other symbols: "), others)),
    )


def table_issue(df: DataFrame, code: str, sheet: str, broken: Column, message: Column) -> DataFrame:
    """An issue without a place, of one row of counts."""
    return df.filter(broken).select(F.lit("error").alias("severity"), F.lit(code).alias("code"), message.alias("message"), F.lit(sheet).alias("sheet"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("first_row"))


def dataset_issues(dataset: DataFrame, alignment: DataFrame, measurements: list[tuple[str, str, str]], expected: int, tolerance: float = 0.011, sheets: tuple[str, str] = ("dataset", "alignment"), length: int = S.LENGTH) -> DataFrame:
    """All issues of a dataset (row, peptide_id, sequence, declared, and of each measurement its value and logarithm) and its alignment (row, peptide_id, sequence, declared).

    measurements: receptor, value column and logarithm column. A dataset passes if there are none. Rows are numbered by their place in the
    sheet, the first below the header being 2.
    """
    said, letters = (F.col("declared"), F.length("sequence")), S.ALPHABET[1:]
    there = F.coalesce(F.col("sequence"), F.lit("")) != ""
    declared = chain(Rule("length_mismatch", there & ~said[0].eqNullSafe(said[1]), F.format_string("declared %s, has %d symbols", F.coalesce(said[0].cast("string"), F.lit("nothing")), said[1])))
    aligned = chain(Rule("aligned_length_mismatch", there & ~((said[1] == length) & said[0].eqNullSafe(F.lit(length))), F.format_string(f"%d symbols and %s declared, not {length}", said[1], F.coalesce(said[0].cast("string"), F.lit("nothing")))))
    rows = placed(with_first(dataset, "peptide_id"), sheets[0], [id_chain("peptide_id"), residue_chain("sequence", letters), declared, *(measure_chain(*m, tolerance) for m in measurements)])
    other = placed(with_first(alignment, "peptide_id"), sheets[1], [id_chain("peptide_id"), residue_chain("sequence", letters + "-"), aligned])
    out = rows.unionByName(other)
    for table, sheet in zip((dataset, alignment), sheets, strict=True):
        counts = table.agg(F.count("*").alias("n"))
        out = out.unionByName(table_issue(counts, "record_count", sheet, F.col("n") != expected, F.format_string(f"%d records, not {expected}", F.col("n"))))
    ids = lambda df, k: df.filter(F.coalesce("peptide_id", F.lit("")) != "").select("peptide_id", F.lit(k).alias("s"))
    sides = ids(dataset, 1).unionByName(ids(alignment, 2)).groupBy("peptide_id").agg(F.bit_or("s").alias("s")).agg(F.count_if(F.col("s") == 1).alias("left"), F.count_if(F.col("s") == 2).alias("right"))
    return out.unionByName(table_issue(sides, "id_set_mismatch", sheets[1], F.col("left") + F.col("right") > 0, F.format_string("%d ids only in the dataset, %d only in the alignment", "left", "right")))
