"""The registry of named queries, and the views that their SQL twins share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

PANEL = """panel as (select doc_id, 'seq_pep' || doc_id as peptide_id, source, cast(doc_id % 3 + 1 as integer) as fold,
    rpad(substr(regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g'), 1, 30), 30, '-') as aligned from documents)"""
CLASSES = PANEL + """,
cls as (select aligned, min(peptide_id) as rep, count(*) as n, 30 - length(replace(aligned, '-', '')) as gaps from panel where aligned <> repeat('-', 30) group by aligned)"""
#: Gaps are at the end only, so both have a gap where the longer one has.
IDENTITY = "((30 - hamming({a}.aligned, {b}.aligned) - least({a}.gaps, {b}.gaps)) / cast(30 - least({a}.gaps, {b}.gaps) as double))"
EDGES = CLASSES + f""",
pairs as (select a.rep as a, b.rep as b, {IDENTITY.format(a='a', b='b')} as identity from cls a join cls b on a.rep < b.rep)"""
MEASURED = PANEL + """,
o as (select o_orderkey as k1, max(o_totalprice) as ec1 from orders group by 1),
li as (select l_orderkey as k2, round(sum(l_extendedprice), 2) as ec2 from lineitem group by 1),
m as (select doc_id, peptide_id, source, fold, aligned, 30 - length(replace(aligned, '-', '')) as gaps, ec1, coalesce(ec2, 1.0) as ec2, log10(ec1) as y1, log10(coalesce(ec2, 1.0)) as y2, log10(ec1) - log10(coalesce(ec2, 1.0)) as sel
    from panel join o on doc_id = k1 left join li on doc_id = k2 where ec1 > 0 and aligned <> repeat('-', 30))"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add
