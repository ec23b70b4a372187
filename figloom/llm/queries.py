"""Queries of the operators of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from figloom.llm import canonical, mixing, near_duplicates, packing, reading, subset
from figloom.workspace import table

QUERIES = {
    "p2_found": lambda spark, d: near_duplicates.similar_papers(table(spark, d, "papers")),
    "p2_classes": lambda spark, d: near_duplicates.paper_classes(table(spark, d, "papers")).select("platform_id", "class_id"),
    "p3_found": lambda spark, d: canonical.paper_decisions(table(spark, d, "papers"), table(spark, d, "decision_ref")),
    "p4_subset": lambda spark, d: subset.figure_subset(table(spark, d, "diagram_data"), table(spark, d, "papers"), table(spark, d, "subset_request")),
    "p4_coverage": lambda spark, d: subset.subset_coverage(table(spark, d, "diagram_data"), table(spark, d, "papers"), table(spark, d, "subset_request")),
    "p6_containers": lambda spark, d: packing.document_containers(table(spark, d, "documents"), table(spark, d, "pack_request")),
    "p6_fill": lambda spark, d: packing.container_fill(table(spark, d, "documents"), table(spark, d, "pack_request")),
    "p7_mix": lambda spark, d: mixing.document_mix(table(spark, d, "documents"), table(spark, d, "mix_target")),
    "p7_shares": lambda spark, d: mixing.document_mix_shares(table(spark, d, "documents"), table(spark, d, "mix_target")),
    "p4_sizes": lambda spark, d: subset.subset_sizes(table(spark, d, "diagram_data"), table(spark, d, "papers"), table(spark, d, "subset_request")),
    "p6_kept": lambda spark, d: packing.containers_kept(table(spark, d, "documents"), table(spark, d, "pack_request")),
    "p7_kept": lambda spark, d: mixing.repeats_kept(table(spark, d, "documents"), table(spark, d, "mix_target")),
    "p8_found": lambda spark, d: reading.easy_documents(table(spark, d, "documents"), table(spark, d, "reading_labels")),
    "p8_profile": lambda spark, d: reading.level_profile(table(spark, d, "documents"), table(spark, d, "reading_labels")),
    "p3_unmatched": lambda spark, d: canonical.unmatched_decisions(table(spark, d, "papers"), table(spark, d, "decision_ref")),
}

_PAIRS = r"""
    texts as (select platform_id as id, arg_max(concat_ws(' ', title, abstract), loaded_at) as t from papers where regexp_matches(abstract, '\S') group by 1),
    words as (select id, w, count(*) as n from (select id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as w from texts) group by 1, 2),
    sizes as (select id, sum(n) as n from words group by 1),
    pairs as (
        select a.id as x, b.id as y from words a join words b on a.w = b.w and a.id < b.id
        join sizes sa on sa.id = a.id join sizes sb on sb.id = b.id where 5 * least(sa.n, sb.n) >= 4 * greatest(sa.n, sb.n)
        group by a.id, b.id, sa.n, sb.n having 5 * sum(least(a.n, b.n)) >= 4 * greatest(sa.n, sb.n))"""

ORACLE = {
    # What must hold of a choice that SQL cannot make itself.
    "p4_sizes": "select request_id, least(subset_size, (select count(*) from diagram_data)) as records, least(subset_size, (select count(*) from diagram_data)) as ids from subset_request where subset_size > 0",
    "p6_kept": "select request_id, (select count(*) from documents) as documents, 0 as overfull, 0 as misplaced from pack_request where capacity_tokens > 0",
    "p7_kept": "select regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') as source, true as kept, 0 as twice from mix_target group by 1",
    "p2_found": f"with {_PAIRS} select x as platform_id_a, y as platform_id_b from pairs",
    "p2_classes": f"""with recursive {_PAIRS},
        both_ as (select x, y from pairs union all select y, x from pairs),
        reach as (select id as x, id as y from sizes union select r.x, b.y from reach r join both_ b on r.y = b.x)
        select x as platform_id, min(y) as class_id from reach group by 1""",
}
