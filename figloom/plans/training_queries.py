"""Queries of the general training-data operators and their SQL where SQL can say the same."""

from __future__ import annotations

from figloom.operators.packed_values import paper_keywords
from figloom.operators.snapshots import paper_changes
from figloom.workspace import table

_KEY = r"regexp_replace(platform_id, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')"
_VALUE = r"nullif(lower(regexp_replace(decision, '[\s\x{85}\p{Z}]', '', 'g')), '')"

QUERIES = {
    "p1_found": lambda spark, d: paper_changes(table(spark, d, "papers_staging")),
    "p5_found": lambda spark, d: paper_keywords(table(spark, d, "papers")),
}

ORACLE = {
    "p1_found": f"""
        with rows_ as (select snapshot_no, {_KEY} as k, {_VALUE} as v, loaded_at from papers_staging),
        valid as (select snapshot_no, k, arg_max(row(v), loaded_at)[1] as v from rows_ where k <> '' group by 1, 2),
        steps as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from papers_staging)),
        now_ as (select valid.* from valid join steps using (snapshot_no) where before is not null),
        old as (select steps.snapshot_no, valid.k, valid.v from valid join steps on valid.snapshot_no = steps.before)
        select coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(n.k, o.k) as platform_id,
               case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change_kind
        from now_ n full join old o on n.snapshot_no = o.snapshot_no and n.k = o.k
        where o.k is null or n.k is null or n.v is distinct from o.v""",
}
