"""Queries of the curation and search operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from figloom.functions import text as X
from figloom.functions import vectors as V
from figloom.operators import search, sync
from figloom.workspace import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: f(lambda t: table(spark, d, t))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# ---------------------------------------------------------------- vector search

#: The three views of a vector that stand for title, abstract and caption.
VIEWS = {"d1": (1, 16), "d2": (17, 16), "d3": (33, 32)}


def _views(corpus: DataFrame) -> DataFrame:
    """Distances of every vector to vector 0 in the three views."""
    target = [float(x) for x in corpus.filter("vec_id = 0").select("embedding").first()[0]]
    parts = {n: (a - 1, target[a - 1 : a - 1 + k]) for n, (a, k) in VIEWS.items()}
    return corpus.select("vec_id", search.distances(F.col("embedding"), parts).alias("d")).select("vec_id", "d.*")


def _sql_distance(a: int, k: int) -> str:
    return f"list_sum(list_transform(range({a}, {a + k}), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2))"


_VIEWS_SQL = "views as (select e.vec_id, " + ", ".join(f"{_sql_distance(a, k)} as {n}" for n, (a, k) in VIEWS.items()) + " from embeddings e cross join (select embedding from embeddings where vec_id = 0) q)"


def _hierarchical_sql(t1: int, t2: int, k: int, f2: int, f3: int) -> str:
    return f"""with {_VIEWS_SQL},
        s1 as (select vec_id from views order by d1, vec_id limit {t1}),
        f2 as (select *, row_number() over (order by d2, vec_id) as rn from views),
        s2 as (select vec_id from f2 where rn <= {f2} * (select count(*) from s1) and vec_id in (select vec_id from s1) order by d2, vec_id limit {t2}),
        f3 as (select *, row_number() over (order by d3, vec_id) as rn from views)
        select vec_id, round(d3, 4) as distance from f3
        where rn <= {f3} * (select count(*) from s2) and vec_id in (select vec_id from s2) order by d3, vec_id limit {k}"""


@query(_hierarchical_sql(100, 10, 3, 100, 1000))
def hierarchical_retrieval(t):
    return search.hierarchical(_views(t("embeddings")), "vec_id", ("d1", "d2", "d3")).select("vec_id", F.round("d3", 4).alias("distance"))


@query(_hierarchical_sql(100, 10, 5, 1, 12))
def hierarchical_retrieval_truncated(t):
    found = search.hierarchical(_views(t("embeddings")), "vec_id", ("d1", "d2", "d3"), 100, 10, 5, 1, 12)
    return found.select("vec_id", F.round("d3", 4).alias("distance"))


@query(f"with {_VIEWS_SQL} select vec_id, round(d1, 4) as distance from views order by d1, vec_id limit 10")
def knn_topk(t):
    return search.nearest(_views(t("embeddings")), "d1", "vec_id", 10).select("vec_id", F.round("d1", 4).alias("distance"))


@query(f"with {_VIEWS_SQL}, f as (select v.* from views v order by d2, v.vec_id limit 200) select vec_id, round(d2, 4) as distance from f join embeddings using (vec_id) where label = 3 order by d2, vec_id limit 10")
def filtered_knn(t):
    allowed = t("embeddings").filter("label = 3")
    return search.filtered_nearest(_views(t("embeddings")), "d2", "vec_id", allowed, 200, 10).select("vec_id", F.round("d2", 4).alias("distance"))


@query(f"with {_VIEWS_SQL} select row_number() over (order by d1, vec_id) as place, vec_id from views qualify place <= 20")
def ranked_results(t):
    top = search.nearest(_views(t("embeddings")), "d1", "vec_id", 20)
    return top.select(F.row_number().over(Window.orderBy("d1", "vec_id")).cast("long").alias("place"), "vec_id")


@query(
    """with q as (select vec_id as query, embedding from embeddings where vec_id % 100 = 0),
    d as (select q.query, e.vec_id as key, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) as distance from embeddings e cross join q)
    select query, key, round(distance, 4) as distance, row_number() over (partition by query order by d.distance, key)::int as place from d qualify place <= 10"""
)
def nearest_for_each(t):
    corpus = t("embeddings")
    found = search.nearest_for_each(corpus, "vec_id", "embedding", corpus.filter("vec_id % 100 = 0"), 10)
    return found.withColumn("distance", F.round("distance", 4))


def _indexed(t, exact: bool) -> DataFrame:
    from figloom.operators import vector_index
    from figloom.workspace import scratch

    corpus = t("embeddings")
    root = scratch(corpus.sparkSession, "index")
    vector_index.build_index(corpus, "vec_id", "embedding", root)
    return vector_index.search_index(vector_index.load_index(corpus.sparkSession, root), corpus.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, exact=exact)


@query(ORACLE["nearest_for_each"])
def indexed_nearest_for_each(t):
    """The same by an index that is built, written, loaded and searched to the end."""
    return _indexed(t, True).withColumn("distance", F.round("distance", 4))


@query("select count(*) as queries, true as enough from embeddings where vec_id % 100 = 0")
def index_recall(t):
    """Whether the index, searched in a few cells only, finds nine tenths of the true results."""
    from figloom.operators import vector_index

    corpus = t("embeddings")
    truth = search.nearest_for_each(corpus, "vec_id", "embedding", corpus.filter("vec_id % 100 = 0"), 10)
    return vector_index.recall(_indexed(t, False), truth).select("queries", (F.col("recall") >= 0.9).alias("enough"))


# The other searches for the same queries: every id divisible by 100.

_EACH_SQL = "views as (select q.vec_id as query, e.vec_id as key, " + ", ".join(f"{_sql_distance(a, k)} as {n}" for n, (a, k) in VIEWS.items()) + " from embeddings e cross join (select vec_id, embedding from embeddings where vec_id % 100 = 0) q)"
_SLICES = {n: slice(a - 1, a - 1 + k) for n, (a, k) in VIEWS.items()}


def _place_sql(d: str) -> str:
    return f"row_number() over (partition by query order by {d}, key)"


def _hierarchical_each_sql(t1: int, t2: int, k: int, f2: int, f3: int) -> str:
    return f"""with {_EACH_SQL},
        s1 as (select query, key from views qualify {_place_sql("d1")} <= {t1}),
        n1 as (select query, count(*) as n from s1 group by 1),
        f2 as (select *, {_place_sql("d2")} as rn from views),
        s2 as (select f2.query, f2.key from f2 join n1 using (query) semi join s1 on f2.query = s1.query and f2.key = s1.key where rn <= {f2} * n qualify row_number() over (partition by f2.query order by d2, f2.key) <= {t2}),
        n2 as (select query, count(*) as n from s2 group by 1),
        f3 as (select *, {_place_sql("d3")} as rn from views)
        select f3.query, f3.key, round(d3, 4) as distance, row_number() over (partition by f3.query order by d3, f3.key)::int as place
        from f3 join n2 using (query) semi join s2 on f3.query = s2.query and f3.key = s2.key where rn <= {f3} * n qualify place <= {k}"""


def _each(t) -> tuple:
    corpus = t("embeddings")
    return corpus, "vec_id", "embedding", corpus.filter("vec_id % 100 = 0")


@query(_hierarchical_each_sql(100, 10, 3, 100, 1000))
def hierarchical_retrieval_for_each(t):
    found = search.hierarchical_for_each(*_each(t), tuple(_SLICES.values()))
    return found.withColumn("distance", F.round("distance", 4))


@query(_hierarchical_each_sql(100, 10, 5, 1, 12))
def hierarchical_retrieval_truncated_for_each(t):
    found = search.hierarchical_for_each(*_each(t), tuple(_SLICES.values()), 100, 10, 5, 1, 12)
    return found.withColumn("distance", F.round("distance", 4))


@query(f"with {_EACH_SQL}, f as (select * from views qualify {_place_sql('d2')} <= 200) select query, key, round(d2, 4) as distance, {_place_sql('d2')}::int as place from f where key in (select vec_id from embeddings where label = 3) qualify place <= 10")
def filtered_knn_for_each(t):
    found = search.filtered_nearest_for_each(*_each(t), _SLICES["d2"], t("embeddings").filter("label = 3"), 200, 10)
    return found.withColumn("distance", F.round("distance", 4))


@query(f"with {_EACH_SQL} select query, key, round(d1, 4) as distance, {_place_sql('d1')}::int as place from views qualify place <= 10")
def knn_topk_for_each(t):
    return search.nearest_for_each(*_each(t), 10, _SLICES["d1"]).withColumn("distance", F.round("distance", 4))


@query(f"with {_EACH_SQL} select query, {_place_sql('d1')} as place, key from views qualify place <= 20")
def ranked_results_for_each(t):
    return search.nearest_for_each(*_each(t), 20, _SLICES["d1"]).select("query", F.col("place").cast("long").alias("place"), "key")


_PROTOTYPES_SQL = """
    norms as (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))) as n from embeddings),
    long as (select vec_id, label, unnest(range(1, 65)) as pos, unnest(embedding)::double / n as x from norms where n > 0),
    means as (select label, pos, avg(x) as x from long group by 1, 2),
    classes as (select label, pos, x / sqrt(sum(x ** 2) over (partition by label)) as x from means)"""


@query(f"with {_PROTOTYPES_SQL} select label, pos::int as pos, round(x, 4) as weight from classes")
def class_prototypes(t):
    found = search.prototypes(t("embeddings"), "label", "embedding").select("label", F.posexplode("prototype").alias("p", "x"))
    return found.select("label", (F.col("p") + 1).alias("pos"), F.round("x", 4).alias("weight"))


_CLASSIFY_SQL = f"""{_PROTOTYPES_SQL},
    scores as (select l.vec_id, c.label, 100 * sum(l.x * c.x) as s from long l join classes c on l.pos = c.pos group by 1, 2),
    shares as (select vec_id, label, exp(s - max(s) over (partition by vec_id)) as p from scores),
    probs as (select vec_id, label, p / sum(p) over (partition by vec_id) as p from shares),
    best as (select vec_id, label as class, p from probs qualify row_number() over (partition by vec_id order by p desc, label) = 1)"""


def _classified(t) -> DataFrame:
    return search.classify(t("embeddings").select("vec_id", "embedding"), "embedding", search.prototypes(t("embeddings"), "label", "embedding"), "label")


@query(f"with {_CLASSIFY_SQL} select vec_id, class, round(p, 4) as confidence from best")
def zero_shot_classify(t):
    return _classified(t).select("vec_id", "class", F.round("class_confidence", 4).alias("confidence"))


@query(f"with {_CLASSIFY_SQL} select class, count(*) as vectors from best where p > 0.8 group by 1")
def class_confidence_filter(t):
    return _classified(t).filter("class_confidence > 0.8").groupBy("class").agg(F.count("*").alias("vectors"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))), 4) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double ** 2))), 4) as first from embeddings")
def normalized_vectors(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(F.sqrt(V.dot(e, e)), 4).alias("norm"), F.round(F.element_at(V.normalized(e), 1), 4).alias("first"))


# ---------------------------------------------------------------- keeping tables in step

#: The paper table and the last snapshot, one row per key each, as the sync operators need them.
_SYNC_SQL = r"""
    target as (select platform_id, arg_max(row(decision), loaded_at)[1] as decision from papers where platform_id is not null group by 1),
    staged as (select trim(platform_id, chr(9) || chr(10) || chr(13) || ' ') as platform_id, decision, loaded_at from papers_staging where snapshot_no = (select max(snapshot_no) from papers_staging)),
    staging as (select platform_id, arg_max(row(decision), loaded_at)[1] as decision from staged where platform_id <> '' group by 1)"""


def _paper_rows(t) -> DataFrame:
    rows = t("papers").filter("platform_id IS NOT NULL").select("platform_id", "decision", "loaded_at")
    return sync.latest_rows(rows, ["platform_id"], [F.col("loaded_at")]).select("platform_id", "decision")


def _staging_rows(t) -> DataFrame:
    staging = t("papers_staging")
    last = staging.agg(F.max("snapshot_no")).first()[0]
    rows = staging.filter(F.col("snapshot_no") == last).select(F.regexp_replace("platform_id", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("platform_id"), "decision", "loaded_at")
    return sync.latest_rows(rows.filter("platform_id <> ''"), ["platform_id"], [F.col("loaded_at")]).select("platform_id", "decision")


@query(f"with {_SYNC_SQL} select * from staging where platform_id not in (select platform_id from target)")
def staging_insert_new(t):
    return sync.missing_rows(_paper_rows(t), _staging_rows(t), ["platform_id"])


@query(f"with {_SYNC_SQL} select count(*) as changed from target join staging s using (platform_id) where lower(target.decision) <> lower(s.decision) and lower(s.decision) <> 'pending/unknown'")
def staging_changed_count(t):
    return sync.changed_rows(_paper_rows(t), _staging_rows(t), ["platform_id"], "decision", "pending/unknown").agg(F.count("*").alias("changed"))


@query(f"with {_SYNC_SQL} select platform_id, case when lower(target.decision) <> lower(s.decision) and lower(s.decision) <> 'pending/unknown' then s.decision else target.decision end as decision from target left join staging s using (platform_id)")
def staging_update_decision(t):
    return sync.update_changed(_paper_rows(t), _staging_rows(t), ["platform_id"], "decision", "pending/unknown")


@query(
    f"""with {_SYNC_SQL}, everything as (select * from target union all select * from staging where platform_id not in (select platform_id from target))
    select platform_id, case when lower(e.decision) <> lower(s.decision) and lower(s.decision) <> 'pending/unknown' then s.decision else e.decision end as decision
    from everything e left join staging s using (platform_id)"""
)
def sync_papers(t):
    return sync.sync(_paper_rows(t), _staging_rows(t), ["platform_id"], "decision", "pending/unknown")


_FIGURE_COLUMNS = "platform_id, figure_number, figure_type, confidence, figure_path, figure_caption, figure_context, loaded_at"


@query("select platform_id, figure_number, max(loaded_at) as loaded_at, max(struct_pack(at := loaded_at, t := coalesce(figure_type, ''))).t as figure_type from figures group by 1, 2")
def figures_upsert(t):
    """Late deliveries (the newer half by load time) replace what was there before."""
    figures = t("figures").select("platform_id", "figure_number", X.or_empty(F.col("figure_type")).alias("figure_type"), "loaded_at")
    cut = F.lit("2024-01-01").cast("timestamp_ntz")
    late = F.coalesce(F.col("loaded_at") >= cut, F.lit(False))
    return sync.upsert(figures.filter(~late), figures.filter(late), ["platform_id", "figure_number"], [F.col("loaded_at")])


@query("select platform_id, figure_number, min(loaded_at) as loaded_at, min(struct_pack(at := loaded_at, t := coalesce(figure_type, ''))).t as figure_type from figures group by 1, 2")
def first_wins_dedup(t):
    rows = t("figures").select("platform_id", "figure_number", "loaded_at", X.or_empty(F.col("figure_type")).alias("figure_type"))
    return sync.first_rows(rows, ["platform_id", "figure_number"], [F.col("loaded_at")])


@query("select l_orderkey, l_linenumber, min(l_shipdate) as l_shipdate, min(struct_pack(d := l_shipdate, p := l_partkey)).p as l_partkey from lineitem group by 1, 2")
def first_wins_lineitem(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return sync.first_rows(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_partkey")])


@query(
    """with latest as (select platform_id, figure_number, max(loaded_at) as at from figures group by 1, 2),
    paths as (select platform_id, figure_number, max(figure_path) as path from diagram_data group by 1, 2)
    select l.platform_id, l.figure_number, coalesce(p.path, 'none') as figure_path from latest l left join paths p on p.platform_id = l.platform_id and p.figure_number = l.figure_number"""
)
def keyed_update_path(t):
    keys = ["platform_id", "figure_number"]
    target = t("figures").select(*keys).distinct().withColumn("figure_path", F.lit("none"))
    updates = t("diagram_data").groupBy(*keys).agg(F.max("figure_path").alias("figure_path"))
    return sync.keyed_update(target, updates, keys, ["figure_path"])


@query("select platform_id, figure_number, null::varchar as figure_type, confidence from figures")
def reset_figure_type(t):
    return sync.reset_column(t("figures").select("platform_id", "figure_number", "figure_type", "confidence"), "figure_type")


@query("select platform_id, figure_number, count(*) as copies from figures group by 1, 2 having count(*) > 1")
def duplicate_figure_keys(t):
    return sync.duplicate_keys(t("figures"), ["platform_id", "figure_number"])


@query("select count(*) as total, count(distinct platform_id) as distinct_ids from papers")
def processed_totals(t):
    return t("papers").agg(F.count("*").alias("total"), F.countDistinct("platform_id").alias("distinct_ids"))


@query("select row_number() over (order by doc_id) - 1 as id, doc_id from documents")
def ordinal_ids(t):
    return sync.dense_ordinals(t("documents").select("doc_id"), [F.col("doc_id")]).select("id", "doc_id")


@query(
    r"""with asset as (select distinct platform_id, year, regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from papers where platform_id is not null),
    wanted as (select platform_id, min(coalesce(nullif(regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'pending_unknown')) as target from (select trim(platform_id, chr(9) || chr(10) || chr(13) || ' ') as platform_id, decision from papers_staging where snapshot_no = (select max(snapshot_no) from papers_staging)) where platform_id <> '' group by 1)
    select a.platform_id, concat(a.year, '/pending_unknown/', a.platform_id) as source_path, concat(a.year, '/', w.target, '/', a.platform_id) as target_path,
      case when w.platform_id is null then 'missing' when w.target = 'pending_unknown' then 'skipped' else 'moved' end as status
    from asset a left join wanted w using (platform_id) where a.slug = 'pending_unknown' and a.year is not null"""
)
def move_plan(t):
    return _move_plan(t)


def _move_plan(t) -> DataFrame:
    """Where the folders of papers without a decision go once the last snapshot has one."""
    assets = t("papers").filter("platform_id IS NOT NULL AND year IS NOT NULL").select("platform_id", "year", X.slug(F.col("decision")).alias("slug")).filter("slug = 'pending_unknown'").distinct()
    staging = t("papers_staging")
    last = staging.agg(F.max("snapshot_no")).first()[0]
    rows = staging.filter(F.col("snapshot_no") == last).select(F.regexp_replace("platform_id", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("platform_id"), X.slug_or_pending(F.col("decision")).alias("target"))
    wanted = rows.filter("platform_id <> ''").groupBy("platform_id").agg(F.min("target").alias("target"))
    status = F.when(F.col("target").isNull(), "missing").when(F.col("target") == "pending_unknown", "skipped").otherwise("moved")
    joined = assets.join(wanted, "platform_id", "left")
    paths = [F.concat_ws("/", F.col("year"), F.lit("pending_unknown"), "platform_id").alias("source_path"), F.concat(F.col("year"), F.lit("/"), X.or_empty(F.col("target")), F.lit("/"), "platform_id").alias("target_path")]
    return joined.select("platform_id", *paths, status.alias("status"))


@query(f"select status, count(*) as papers from ({ORACLE['move_plan']}) group by 1")
def sync_summary(t):
    return _move_plan(t).groupBy("status").agg(F.count("*").alias("papers"))


_PENDING_SQL = ORACLE["move_plan"].replace("select a.platform_id, concat", "select a.year, a.platform_id, concat")


@query(
    f"""with m as ({_PENDING_SQL}), there as (select distinct platform_id from figures)
    select 'papers' as kind, platform_id, source_path, case when status <> 'missing' then target_path end as target_path, case when status = 'moved' and platform_id in (select platform_id from there) then 'exists' else status end as status from m"""
)
def asset_moves(t):
    """Moves of folders; for papers with figures the target is taken to be there already."""
    from figloom.operators.assets import plan_moves

    papers = t("papers").filter("platform_id IS NOT NULL AND year IS NOT NULL").select("platform_id", F.col("year").cast("string").alias("root"), X.slug(F.col("decision")).alias("slug"))
    pending = papers.filter("slug = 'pending_unknown'").select(F.lit("papers").alias("kind"), "platform_id", F.lit(None).cast("string").alias("year"), "root").distinct()
    staging = t("papers_staging")
    last = staging.agg(F.max("snapshot_no")).first()[0]
    rows = staging.filter(F.col("snapshot_no") == last).select(F.regexp_replace("platform_id", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("platform_id"), X.slug_or_pending(F.col("decision")).alias("decision"))
    wanted = rows.filter("platform_id <> ''").groupBy("platform_id").agg(F.min("decision").alias("decision"))
    drawn = t("figures").select("platform_id").distinct()
    existing = pending.join(drawn, "platform_id", "left_semi").join(wanted, "platform_id").select(F.concat_ws("/", "root", "decision", "platform_id").alias("path"))
    return plan_moves(pending, wanted, existing).select("kind", "platform_id", "source_path", "target_path", "status")


@query(r"select platform_id as id, year, regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as decision, concat('https://papers.example/pdf?id=', platform_id) as url from papers where year = 2024 and decision <> ''")
def ledger_round_trip(t):
    """Failed tasks as they come back from a ledger."""
    from figloom.sources.files import failed_tasks
    from figloom.sources.sinks import save_failures
    from figloom.workspace import scratch

    papers = t("papers").filter("year = 2024 OR year = 2023").filter("decision <> ''")
    status = F.when(F.col("year") == 2024, "failed").otherwise("downloaded")
    tasks = papers.select(F.col("platform_id").alias("id"), "year", X.slug(F.col("decision")).alias("decision"), X.pdf_url(F.col("platform_id"), "https://papers.example").alias("url"), status.alias("status"))
    path = scratch(papers.sparkSession, "ledger")
    save_failures(tasks, path)
    return failed_tasks(papers.sparkSession, path)


# ---------------------------------------------------------------- decisions and reports


@query(r"select decision, regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug, count(*) as papers from papers group by 1, 2")
def slug_decisions(t):
    return t("papers").groupBy("decision", X.slug(F.col("decision")).alias("slug")).agg(F.count("*").alias("papers"))


@query(r"select coalesce(nullif(regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'pending_unknown') as folder, count(*) as papers from papers_staging group by 1")
def slug_fallback(t):
    return t("papers_staging").groupBy(X.slug_or_pending(F.col("decision")).alias("folder")).agg(F.count("*").alias("papers"))


_ACCEPTED = "regexp_matches(coalesce(lower(decision), ''), 'accept|spotlight|poster|oral')"


@query(f"select venue, count(*) filter ({_ACCEPTED}) as accepted, count(*) filter (not {_ACCEPTED}) as others, count(*) as papers from papers group by grouping sets ((venue), ())")
def accept_reject_totals(t):
    yes = X.is_accepted(F.col("decision"))
    return t("papers").rollup("venue").agg(F.count_if(yes).alias("accepted"), F.count_if(~yes).alias("others"), F.count("*").alias("papers"))


_BYTES = "octet_length(encode(coalesce(figure_caption, ''))) + octet_length(encode(coalesce(figure_context, '')))"


@query(
    f"""with s as (select upper(venue) as conf, year, case when {_ACCEPTED} then 'Accept' else 'Reject' end as category, sum({_BYTES})::bigint as size from diagram_data group by 1, 2, 3)
    select *, case when size = 0 then '0 B' when size >= 1048576 then concat(round(size / 1048576.0::double, 2), ' MB') when size >= 1024 then concat(round(size / 1024.0::double, 2), ' KB') else concat(size::double, ' B') end as readable from s"""
)
def size_report(t):
    size = F.octet_length(X.or_empty(F.col("figure_caption"))) + F.octet_length(X.or_empty(F.col("figure_context")))
    category = F.when(X.is_accepted(F.col("decision")), "Accept").otherwise("Reject")
    sums = t("diagram_data").groupBy(F.upper("venue").alias("conf"), "year", category.alias("category")).agg(F.sum(size).alias("size"))
    return sums.withColumn("readable", X.human_bytes(F.col("size"))).orderBy("conf", "year", "category")


@query("select year, upper(venue) as venue, count(*) as papers, round(avg(len(scores)), 4) as mean_reviews, round(avg(list_avg(scores)), 4) as mean_score from papers group by 1, 2")
def venue_year_trends(t):
    scores = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("scores"))
    n = F.when(F.col("scores").isNotNull(), F.size("scores"))
    return t("papers").groupBy("year", F.upper("venue").alias("venue")).agg(F.count("*").alias("papers"), F.round(F.avg(n), 4).alias("mean_reviews"), F.round(F.avg(scores), 4).alias("mean_score"))


@query("select figure_type, round(avg(length(figure_caption)), 4) as mean_chars, round(avg(len(regexp_split_to_array(trim(figure_caption), ' +'))), 4) as mean_words, count(figure_caption) as captions from figures group by 1")
def caption_verbosity(t):
    words = F.size(F.split(F.trim("figure_caption"), " +"))
    words = F.when(F.col("figure_caption").isNotNull(), words)
    return t("figures").groupBy("figure_type").agg(F.round(F.avg(F.length("figure_caption")), 4).alias("mean_chars"), F.round(F.avg(words), 4).alias("mean_words"), F.count("figure_caption").alias("captions"))


@query(f"select {_ACCEPTED} as accepted, count(*) as papers, round(avg(s), 4) as mean_score from (select decision, unnest(scores) as s from papers) group by 1")
def score_by_acceptance(t):
    scores = t("papers").select(X.is_accepted(F.col("decision")).alias("accepted"), F.explode("scores").alias("s"))
    return scores.groupBy("accepted").agg(F.count("*").alias("papers"), F.round(F.avg("s"), 4).alias("mean_score"))


@query(
    """with p as (select coalesce(nullif(lower(trim(clip_type)), ''), 'none') as kind, (final_decision = 'keep')::int as ok from diagram_data)
    select kind, count(*) as judged, round(avg(ok), 4) as share, round(greatest(avg(ok) - 1.96 * sqrt(avg(ok) * (1 - avg(ok)) / count(*)), 0), 4) as low, round(least(avg(ok) + 1.96 * sqrt(avg(ok) * (1 - avg(ok)) / count(*)), 1), 4) as high from p where ok is not null group by 1"""
)
def precision_interval(t):
    kind = F.coalesce(F.nullif(F.lower(F.trim("clip_type")), F.lit("")), F.lit("none"))
    p = t("diagram_data").filter("final_decision IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count("*").alias("judged"), F.avg((F.col("final_decision") == "keep").cast("int")).alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("judged"))
    return p.select("kind", "judged", F.round("p", 4).alias("share"), F.round(F.greatest(F.col("p") - half, F.lit(0.0)), 4).alias("low"), F.round(F.least(F.col("p") + half, F.lit(1.0)), 4).alias("high"))


# ---------------------------------------------------------------- filters, joins, counts

_SINCE = "0.8::float"


@query(
    f"""select count(*) as total, count(*) filter (figure_type = 'diagram') as diagrams, count(*) filter (figure_type = 'diagram' and confidence > {_SINCE}) as sure,
    count(*) filter (figure_type = 'diagram' and confidence > 0.9::float) as very_sure, count(*) filter (figure_type = '') as waiting,
    count(*) filter (figure_type is null) as unset, count(*) filter (figure_type is not null) as set_, count(*) filter (coalesce(figure_path, '') = '') as without_path from figures"""
)
def count_filtered(t):
    kind, sure = F.col("figure_type"), F.col("confidence")
    over = lambda x: (kind == "diagram") & (sure > F.lit(x).cast("float"))
    return t("figures").agg(
        F.count("*").alias("total"), F.count_if(kind == "diagram").alias("diagrams"), F.count_if(over(0.8)).alias("sure"), F.count_if(over(0.9)).alias("very_sure"),
        F.count_if(kind == "").alias("waiting"), F.count_if(kind.isNull()).alias("unset"), F.count_if(kind.isNotNull()).alias("set_"),
        F.count_if(X.is_missing(F.col("figure_path"))).alias("without_path"),
    )


@query("select 'year' as field, year::varchar as value from papers union select 'decision', decision from papers union select 'venue', venue from papers")
def distinct_values(t):
    """One scan: a row for each field, reduced before the shuffle."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("year", "decision", "venue")])
    return t("papers").select(F.inline(fields)).distinct()


@query("select " + ", ".join(f"count(*) filter (coalesce({c}, '') = '') as {c}" for c in ("title", "abstract", "keywords", "areas", "tldr", "decision", "bibtex")) + " from papers")
def null_or_empty_audit(t):
    return t("papers").agg(*[F.count_if(X.is_missing(F.col(c))).alias(c) for c in ("title", "abstract", "keywords", "areas", "tldr", "decision", "bibtex")])


@query("select coalesce(venue, '') as venue, coalesce(cascade_path, '') as cascade_path, count(*) as records from diagram_data group by grouping sets ((coalesce(venue, '')), (coalesce(cascade_path, '')), ())")
def group_counts(t):
    d = t("diagram_data").select(X.or_empty(F.col("venue")).alias("venue"), X.or_empty(F.col("cascade_path")).alias("cascade_path"))
    return d.groupingSets([["venue"], ["cascade_path"], []], "venue", "cascade_path").agg(F.count("*").alias("records"))


@query("select platform_id, title, year from papers where year = 2024 and decision = 'Accept (Poster)'")
def papers_of_year_and_decision(t):
    return t("papers").filter("year = 2024 AND decision = 'Accept (Poster)'").select("platform_id", "title", "year")


@query("select * exclude (scores) from papers where platform_id = (select min(platform_id) from papers)")
def paper_by_id(t):
    papers = t("papers").drop("scores")
    return papers.filter(F.col("platform_id") == papers.agg(F.min("platform_id")).first()[0])


_LIKE = "(title like '%Graph%' or title like '% Tree %')"
_JOIN_SQL = f"from (select platform_id, any_value(title) as title from papers group by 1) p, (select distinct platform_id, figure_number from figures) f where p.platform_id = f.platform_id and {_LIKE}"


def _joined(t) -> DataFrame:
    papers = t("papers").groupBy("platform_id").agg(F.min("title").alias("title")).filter(F.col("title").like("%Graph%") | F.col("title").like("% Tree %"))
    return papers.join(t("figures").select("platform_id", "figure_number").distinct(), "platform_id")


@query(f"select p.platform_id, concat(substring(title, 1, 100), '...') as title, figure_number {_JOIN_SQL}")
def join_like_filter(t):
    return _joined(t).select("platform_id", X.preview(F.col("title")).alias("title"), "figure_number")


@query(f"select count(*) as figures {_JOIN_SQL}")
def join_like_count(t):
    return _joined(t).agg(F.count("*").alias("figures"))


@query(f"select p.platform_id, figure_number {_JOIN_SQL} order by p.platform_id, figure_number limit 5")
def join_limit_ordered(t):
    return _joined(t).select("platform_id", "figure_number").orderBy("platform_id", "figure_number").limit(5)


@query("select p.venue, count(*) as figures, count(distinct f.platform_id) as papers from (select platform_id, min(upper(venue)) as venue from papers group by 1) p join figures f using (platform_id) group by 1")
def release_join(t):
    papers = t("papers").groupBy("platform_id").agg(F.min(F.upper("venue")).alias("venue"))
    return papers.join(t("figures"), "platform_id").groupBy("venue").agg(F.count("*").alias("figures"), F.countDistinct("platform_id").alias("papers"))


@query(
    """with p as (select platform_id, arg_max(row(title, venue), loaded_at) as r from papers where platform_id is not null group by 1),
    f as (select platform_id, figure_number, max(struct_pack(at := loaded_at, p := coalesce(figure_path, ''), c := coalesce(figure_caption, ''))) as r from figures where platform_id is not null and figure_number is not null group by 1, 2),
    l as (select platform_id, figure_number, max(clip_type) as clip_type from diagram_data group by 1, 2)
    select row_number() over (order by platform_id, figure_number) - 1 as id, platform_id, figure_number, p.r[2] as venue, md5(coalesce(p.r[1], '')) as title, coalesce(f.r.p, '') as figure_path, md5(f.r.c) as figure_caption, clip_type
    from p join f using (platform_id) left join l using (platform_id, figure_number)"""
)
def release_build(t):
    """The release from its three tables, by its main columns."""
    from figloom.operators.release import build_release

    figures = t("figures").withColumns({c: X.or_empty(F.col(c)) for c in ("figure_path", "figure_caption")})
    labels = t("diagram_data")
    r = build_release(t("papers"), figures, labels)
    return r.select("id", "platform_id", "figure_number", "venue", F.md5(X.or_empty(F.col("title"))).alias("title"), "figure_path", F.md5("figure_caption").alias("figure_caption"), "clip_type")


@query("select event_type as model, count(*) as calls, sum(input_tokens)::bigint as input_tokens, round(sum(input_tokens * length(event_type) + output_tokens * 2 * length(event_type)) / 1000, 4) as cost from (select event_type, coalesce((props->>'k')::bigint, 0) as input_tokens, user_id % 1000 as output_tokens from events) group by 1")
def usage_costs(t):
    """Tokens of calls priced by model: here events, priced by the length of their names."""
    from figloom.operators.external import usage_costs as costs

    e = t("events").select(F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (F.col("user_id") % 1000).alias("output_tokens"))
    prices = e.select("model").distinct().select("model", F.length("model").alias("input"), (2 * F.length("model")).alias("output"))
    used = costs(e, prices).groupBy("model")
    return used.agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.round(F.sum("cost"), 4).alias("cost"))


@query("select platform_id, count(*) as figures, min(figure_number) as first, max(figure_number) as last from (select distinct platform_id, figure_number from figures) group by 1")
def figures_of_papers(t):
    chunks = sync.chunked_lists(t("figures").select("platform_id", "figure_number").distinct(), ["platform_id"], F.col("figure_number"))
    each = chunks.select("platform_id", F.size("items").alias("n"), F.get("items", F.lit(0)).alias("a"), F.element_at("items", -1).alias("b"))
    return each.groupBy("platform_id").agg(F.sum("n").alias("figures"), F.min("a").alias("first"), F.max("b").alias("last"))


@query("select platform_id from papers where platform_id is not null union select platform_id from figures where platform_id is not null")
def pid_union(t):
    return t("papers").select("platform_id").union(t("figures").select("platform_id")).filter("platform_id IS NOT NULL").distinct()


@query("select platform_id from figures where platform_id is not null except select platform_id from papers")
def figures_without_paper(t):
    return t("figures").select("platform_id").filter("platform_id IS NOT NULL").join(t("papers").select("platform_id"), "platform_id", "left_anti").distinct()


@query("select distinct f.platform_id from figures f where exists (select 1 from diagram_data d where d.platform_id = f.platform_id)")
def figures_released(t):
    return t("figures").select("platform_id").join(t("diagram_data").select("platform_id"), "platform_id", "left_semi").distinct()


@query("select upper(venue) as venue, count(*) as papers from papers where upper(venue) in ('ICLR', 'ICML', 'NEURIPS', 'TMLR') group by 1")
def venue_union(t):
    """The tables of four venues as one; they lie in one table here, so it is scanned once."""
    known = t("papers").select(F.upper("venue").alias("venue")).filter(F.col("venue").isin("ICLR", "ICML", "NEURIPS", "TMLR"))
    return known.groupBy("venue").agg(F.count("*").alias("papers"))


@query(
    """select 'rows' as check_, (select count(*) from diagram_data) as actual, (select count(distinct id) from diagram_data) as expected
    union all select 'papers known', (select count(distinct platform_id) from diagram_data), (select count(distinct platform_id) from diagram_data where platform_id in (select platform_id from papers))
    union all select 'figure keys', (select count(*) from figures), (select count(*) from (select distinct platform_id, figure_number from figures))"""
)
def integrity_report(t):
    data, figures = t("diagram_data"), t("figures")
    known = data.select("platform_id").join(t("papers").select("platform_id"), "platform_id", "left_semi").distinct()
    parts = [
        data.agg(F.lit("rows").alias("check_"), F.count("*").alias("actual"), F.countDistinct("id").alias("expected")),
        data.agg(F.lit("papers known").alias("check_"), F.countDistinct("platform_id").alias("actual")).crossJoin(known.agg(F.count("*").alias("expected"))),
        figures.agg(F.lit("figure keys").alias("check_"), F.count("*").alias("actual")).crossJoin(figures.select("platform_id", "figure_number").distinct().agg(F.count("*").alias("expected"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DESCRIBED = ("papers", "papers_staging", "figures", "diagram_data", "documents", "embeddings")
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float", "DOUBLE": "double", "BIGINT[]": "array<bigint>", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>", "TIMESTAMP": "timestamp_ntz"}


@query(
    "with types as (select unnest([" + ", ".join(f"'{k}'" for k in _TYPES) + "]) as their, unnest([" + ", ".join(f"'{v}'" for v in _TYPES.values()) + "]) as ours) select table_name, column_name, ours as data_type from ("
    + " union all ".join(f"select '{n}' as table_name, column_name, data_type from (describe select * from {n}) d(column_name, data_type, a, b, c, e)" for n in _DESCRIBED)
    + ") left join types on data_type = their"
)
def table_columns(t):
    rows = [(n, c, kind) for n in _DESCRIBED for c, kind in t(n).dtypes]
    return t("papers").sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string")


# ---------------------------------------------------------------- text and figure context

_PARAGRAPHS_SQL = "paras as (select doc_id, platform_id, unnest(string_split(text, chr(10) || chr(10))) as para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as pos from documents where text is not null)"
_CAPTION_SQL = r"regexp_matches(para, '(?i)^\s*(?:Figure|Fig)s?\.?\s*\d+\s*[:.]')"


def _paragraphs(t) -> DataFrame:
    return t("documents").filter("text IS NOT NULL").select("doc_id", "platform_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "para"))


@query(f"with {_PARAGRAPHS_SQL} select {_CAPTION_SQL} as caption, length(para) >= 20 as long_enough, count(*) as paragraphs from paras group by 1, 2")
def paragraph_filter(t):
    p = F.col("para")
    return _paragraphs(t).groupBy(X.is_caption(p).alias("caption"), (F.length(p) >= 20).alias("long_enough")).agg(F.count("*").alias("paragraphs"))


@query(r"select doc_id, md5(trim(regexp_replace(replace(regexp_replace(text, '-[\s]*[\n\r]+', '', 'g'), chr(10), ' '), '[\s\x0B\x85\p{Z}]+', ' ', 'g'))) as clean from documents")
def dehyphenate(t):
    return t("documents").select("doc_id", F.md5(X.unbroken(F.col("text"))).alias("clean"))


@query("select figure_number, regexp_replace(figure_number, '\\D', '', 'g') as key, count(*) as figures from figures group by 1, 2")
def figure_keys(t):
    return t("figures").groupBy("figure_number", X.figure_key(F.col("figure_number")).alias("key")).agg(F.count("*").alias("figures"))


_MENTIONS_SQL = rf"""{_PARAGRAPHS_SQL},
    context as (select * from paras where length(para) >= 20 and not {_CAPTION_SQL} and regexp_matches(para, '(?i)fig')),
    numbers as (select distinct figure_number as key, platform_id from figures where regexp_matches(figure_number, '^[0-9]+$')),
    mentions as (select c.doc_id, c.platform_id, c.pos, c.para, n.key from context c join numbers n on n.platform_id = c.platform_id and regexp_matches(c.para, '(?i)\b(?:Figure|Fig)s?\.?.{{0,50}}?\b' || n.key || '(?:\D|$)'))"""


def _mentions(t) -> DataFrame:
    """(doc_id, platform_id, pos, para, key): paragraphs that refer to a figure of their paper.

    Numbers are taken from the paragraphs and joined by equality, so a paper with a tenth of all
    paragraphs and figures gives no pairs of all with all.
    """
    found = _paragraphs(t).filter(F.col("para").rlike("(?i)fig") & X.is_context(F.col("para")))
    found = found.withColumn("key", F.explode(X.mentioned_figures(F.col("para"))))
    figures = t("figures").filter(F.col("figure_number").rlike("^[0-9]+$")).select("platform_id", F.col("figure_number").alias("key")).distinct()
    return found.join(figures, ["platform_id", "key"])


@query(f"with {_MENTIONS_SQL} select doc_id, platform_id, pos::int as pos, key from mentions")
def paragraph_context(t):
    return _mentions(t).select("doc_id", "platform_id", "pos", "key")


@query(
    f"""with {_MENTIONS_SQL}, numbered as (select *, row_number() over (partition by doc_id, platform_id, key order by pos) as i from mentions)
    select doc_id, platform_id, key, md5(string_agg(concat('<paragraph_', i, '>', para, '</paragraph_', i, '>'), chr(10) order by i)) as context from numbered group by 1, 2, 3"""
)
def context_tagged(t):
    """The paragraphs of one document about one figure: a list no longer than the document."""
    lists = _mentions(t).groupBy("doc_id", "platform_id", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "para"))).alias("v"))
    return lists.select("doc_id", "platform_id", "key", F.md5(X.tagged(F.col("v.para"))).alias("context"))


@query(
    """with d as (select platform_id, figure_number, figure_caption, id, row_number() over (partition by platform_id order by id) as i from diagram_data qualify i <= 3)
    select platform_id, md5(string_agg(concat('<figure_', i, '>', coalesce(figure_caption, ''), '</figure_', i, '>'), chr(10) order by i)) as prompt from d group by 1"""
)
def prompt_assembly(t):
    """The first three figures of each paper as numbered parts of one prompt."""
    first = Window.partitionBy("platform_id").orderBy("id")
    top = t("diagram_data").select("platform_id", "id", "figure_caption", F.row_number().over(first).alias("i")).filter("i <= 3")
    parts = top.groupBy("platform_id").agg(F.array_sort(F.collect_list(F.struct("i", X.or_empty(F.col("figure_caption")).alias("c")))).alias("v"))
    return parts.select("platform_id", F.md5(X.tagged(F.col("v.c"), "figure")).alias("prompt"))


@query("select id, unnest(['title', 'abstract', 'caption']) as kind, md5(unnest([coalesce(title, ''), coalesce(abstract, ''), coalesce(figure_caption, '')])) as content from diagram_data")
def document_unpivot(t):
    d = t("diagram_data")
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.md5(X.or_empty(F.col(c))).alias("content")) for k, c in (("title", "title"), ("abstract", "abstract"), ("caption", "figure_caption"))])
    return d.select("id", F.inline(parts))


@query("select event_type, count(*) as events, sum((props->>'k')::int)::bigint as k, min(strftime(ts, '%Y%m%d')) as first_day, max(strftime(ts, '%Y%m%d')) as last_day from events group by 1")
def json_props_extract(t):
    k = F.get_json_object("props", "$.k").cast("int")
    day = X.yyyymmdd(F.col("ts"))
    return t("events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("select platform_id, array_to_string(scores, ', ') as scores, concat('https://papers.example/forum?id=', platform_id) as url, md5(coalesce(bibtex, '')) as bibtex from papers where scores is not null and len(scores) > 0")
def list_join(t):
    p = t("papers").filter(F.size("scores") > 0)
    return p.select("platform_id", X.join_list(F.col("scores").cast("array<string>")).alias("scores"), F.concat(F.lit("https://papers.example/forum?id="), "platform_id").alias("url"), F.md5(X.or_empty(F.col("bibtex"))).alias("bibtex"))


@query(r"select platform_id, year, nullif(regexp_extract(bibtex, 'year=\{?(\d{4})\}?', 1), '')::bigint as bibtex_year from papers where nullif(regexp_extract(bibtex, 'year=\{?(\d{4})\}?', 1), '') is not null")
def bibtex_years(t):
    year = F.nullif(F.regexp_extract("bibtex", r"year=\{?(\d{4})\}?", 1), F.lit("")).cast("long")
    return t("papers").select("platform_id", "year", year.alias("bibtex_year")).filter("bibtex_year IS NOT NULL")


@query("select platform_id, figure_number, concat_ws('/', platform, platform_id, concat('Figure', figure_number, '.png')) as path, regexp_extract(figure_path, 'Figure(.*)\\.png', 1) as number_in_path from figures where figure_path is not null")
def figure_paths(t):
    made = F.concat_ws("/", "platform", "platform_id", F.concat(F.lit("Figure"), "figure_number", F.lit(".png")))
    return t("figures").filter("figure_path IS NOT NULL").select("platform_id", "figure_number", made.alias("path"), F.regexp_extract("figure_path", r"Figure(.*)\.png", 1).alias("number_in_path"))


@query("select event_type as key, round(sum(value), 4) as total, count(*) as entries from events group by 1")
def usage_merge(t):
    """Ledgers merged key by key: the events of each day are one, added up before they are merged."""
    ledgers = t("events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return ledgers.groupBy("key").agg(F.round(F.sum("v"), 4).alias("total"), F.sum("n").alias("entries"))


_FILES = (
    "SHA256SUMS", "data.jsonl", "README.md", "data/faiss_complete.tar.gz", "data/2024/accept_poster.tar.gz", "data/2024/reject.tar.gz", "data/2025/accept_oral.tar.gz",
    "data/2025/pending_unknown.tar.gz", "data/notes.txt", "data/a_research_db.tar.gz", "b_research_db.tar.gz", "reproduce/a_metadata.tar.gz", "reproduce/run.py", "other/b_metadata.tar.gz",
)
_WAYS = (("accept", True, False), ("reject", False, True), ("all", True, True), ("none", True, False))


@query(
    f"""with f as (select unnest({list(_FILES)}) as f, unnest(range({len(_FILES)})) as n),
    p as (select *, case when f in ('data.jsonl', 'SHA256SUMS', 'data/faiss_complete.tar.gz') or ends_with(f, '_research_db.tar.gz') then 0 when starts_with(f, 'data/') and ends_with(f, '.tar.gz') then 1
        when starts_with(f, 'reproduce/') and ends_with(f, '_metadata.tar.gz') then 2 end as part, regexp_matches(f, 'accept|spotlight|poster|oral') as yes from f),
    w as (select unnest({[w[0] for w in _WAYS]}) as subset, unnest({[w[1] for w in _WAYS]}) as core, unnest({[w[2] for w in _WAYS]}) as metadata)
    select subset, (row_number() over (partition by subset order by part, n) - 1)::int as place, f as file from p cross join w
    where (part = 0 and core) or (part = 1 and (subset = 'all' or (subset = 'accept' and yes) or (subset = 'reject' and not yes))) or (part = 2 and metadata)"""
)
def file_selection(t):
    """The files of four ways of asking, in the order in which they would be fetched."""
    from figloom.sources.files import select_files

    spark = t("region").sparkSession
    names = spark.createDataFrame([(f, n) for n, f in enumerate(_FILES)], "file string, n int")
    parts = []
    for subset, core, metadata in _WAYS:
        ordered = select_files(names, "file", "n", subset, core, metadata).agg(F.collect_list("file").alias("files"))
        parts.append(ordered.select(F.lit(subset).alias("subset"), F.posexplode("files").alias("place", "file")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


_VOTE = "(coalesce(lower(trim({c})), '') = 'diagram')::int"
_VOTES_SQL = " + ".join(_VOTE.format(c=c) for c in ("clip_type", "label_haiku", "label_gpt_mini"))


@query(
    f"""with v as (select {_VOTE.format(c="clip_type")} as first, {_VOTES_SQL} as votes, coalesce(lower(trim(label_gpt_tiebreak)), '') as tie from diagram_data)
    select votes, case when votes = 3 then 'unanimous' when first = 0 and votes = 2 and tie = 'diagram' then 'consensus_confirmed' when first = 0 then 'unconfirmed' when votes = 2 then 'majority'
        when votes = 1 and tie = 'diagram' then 'minority_tiebreak' else 'unconfirmed' end as path, count(*) as records from v group by 1, 2"""
)
def label_cascade(t):
    """Three judges vote. What the first takes for a diagram passes by votes, a single one with the
    tie-breaking judge; what it does not needs both others and the tie-breaker. The routing is ours."""
    said = lambda c: (X.or_empty(F.lower(F.trim(c))) == "diagram").cast("int")
    votes = said("clip_type") + said("label_haiku") + said("label_gpt_mini")
    v = t("diagram_data").select(said("clip_type").alias("first"), votes.alias("votes"), said("label_gpt_tiebreak").alias("tie"))
    confirmed = F.when((F.col("votes") == 2) & (F.col("tie") == 1), "consensus_confirmed").otherwise("unconfirmed")
    passed = F.when(F.col("votes") == 2, "majority").when((F.col("votes") == 1) & (F.col("tie") == 1), "minority_tiebreak").otherwise("unconfirmed")
    path = F.when(F.col("votes") == 3, "unanimous").when(F.col("first") == 0, confirmed).otherwise(passed)
    return v.groupBy("votes", path.alias("path")).agg(F.count("*").alias("records"))


@query("select upper(venue) as venue, round(corr(list_avg(scores), len(keywords)), 4) as keyword_corr, round(corr(list_avg(scores), year), 4) as year_corr, count(*) as papers from papers where len(scores) > 0 group by 1")
def score_correlations(t):
    mean = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("scores")
    p = t("papers").filter(F.size("scores") > 0).select(F.upper("venue").alias("venue"), mean.alias("s"), F.length("keywords").cast("double").alias("k"), F.col("year").cast("double").alias("y"))
    return p.groupBy("venue").agg(F.round(F.corr("s", "k"), 4).alias("keyword_corr"), F.round(F.corr("s", "y"), 4).alias("year_corr"), F.count("*").alias("papers"))


@query("select areas, count(*) as records, count(distinct platform_id) as papers, round(count(*) / count(distinct platform_id)::double, 4) as figures_per_paper from diagram_data group by 1")
def figure_density(t):
    d = t("diagram_data").groupBy("areas").agg(F.count("*").alias("records"), F.countDistinct("platform_id").alias("papers"))
    return d.withColumn("figures_per_paper", F.round(F.col("records") / F.col("papers"), 4))
