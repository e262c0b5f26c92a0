"""Named queries over the driver's tables, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import padded, seeded_key, sha_key
from ..functions.typed_json import type_errors
from ..operators import annotation as A
from ..operators import batches, evaluation, identity, layout, metrics, selection, splits
from ..operators.ordering import numbered, zipped

MODEL = "annotator-1"
QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- selection

PICKS_SQL = """picks as (select conv_id, turn, role, pos, n from (
  select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations) c,
  unnest(range(0, 4)) as u(pos) where n >= 4 and i = (pos * n) // 4)"""


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return selection.evenly_spaced(turns, ["conv_id"], ["turn"])


@query(f"with {PICKS_SQL} select conv_id, turn, role, pos::int as pos, n::int as group_size from picks")
def four_view_select(spark, sf_dir):
    return _picks(spark, sf_dir)


@query(
    "select conv_id, count(*)::int as n, 'At least four source images are required, received ' || count(*) as reason from conversations group by 1 having count(*) < 4"
)
def short_group_reject(spark, sf_dir):
    return selection.short_groups(table(spark, sf_dir, "conversations"), ["conv_id"])


@query("select sha256(text) as content_sha256, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def content_dup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return docs.groupBy("content_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


SOURCE_PICKS_SQL = """sp as (select source, doc_id, text, pos from (
  select source, doc_id, text, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents) c,
  unnest(range(0, 4)) as u(pos) where n >= 4 and i = (pos * n) // 4)"""


def _source_picks(spark, sf_dir) -> DataFrame:
    # keys first: only the picked documents' texts are hashed
    docs = table(spark, sf_dir, "documents")
    picked = selection.evenly_spaced(docs.select("source", "doc_id"), ["source"], ["doc_id"], large_groups=True).select("source", "doc_id", "pos")
    return picked.join(docs.select("doc_id", "text"), "doc_id").select("source", "doc_id", "pos", F.sha2("text", 256).alias("sha256"))


@query(f"with {SOURCE_PICKS_SQL} select source, count(*)::int as n_picks, count(distinct sha256(text))::int as n_distinct, count(distinct sha256(text)) < count(*) as rejected from sp group by 1")
def selection_dup_reject(spark, sf_dir):
    return selection.duplicate_contents(_source_picks(spark, sf_dir), ["source"], "sha256")


@query(f"with {PICKS_SQL} select conv_id, turn, pos::int as pos, ['TOP-LEFT', 'TOP-RIGHT', 'BOTTOM-LEFT', 'BOTTOM-RIGHT'][pos + 1] as position from picks")
def view_positions(spark, sf_dir):
    return _picks(spark, sf_dir).select("conv_id", "turn", "pos", selection.position_name(F.col("pos")).alias("position"))


@query(
    f"""with {PICKS_SQL} select conv_id, to_json(list({{'position': ['TOP-LEFT', 'TOP-RIGHT', 'BOTTOM-LEFT', 'BOTTOM-RIGHT'][pos + 1], 'filename': turn || '.jpg',
  'path': conv_id || '/' || turn || '.jpg', 'sha256': sha256(conv_id || '/' || turn || '.jpg')}} order by pos))::varchar as views from picks group by 1"""
)
def view_manifests(spark, sf_dir):
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".jpg"))
    picks = _picks(spark, sf_dir).withColumn("path", path).withColumn("sha256", F.sha2("path", 256))
    return selection.view_manifest(picks, ["conv_id"]).select("conv_id", F.to_json("views").alias("views"))


@query(
    """with a as (select n_nationkey, row_number() over (order by n_name) - 1 as i from nation), b as (select r_regionkey, row_number() over (order by r_regionkey desc) - 1 as i from region)
select i::bigint as ordinal, n_nationkey, r_regionkey from a left join b using (i)"""
)
def positional_zip(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select("r_regionkey")
    backwards = regions.withColumn("o", -F.col("r_regionkey"))
    return zipped(nations, ["n_name"], backwards, ["o"]).select("ordinal", "n_nationkey", "r_regionkey")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def last_wins(spark, sf_dir):
    return selection.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query(
    """with r as (select user_id, event_type, min(ts) as first_ts, min(event_id) as first_id from events group by 1, 2)
select user_id, string_agg(event_type, '; ' order by first_ts, first_id) as reasons from r group by 1"""
)
def first_wins_join(spark, sf_dir):
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"), F.min("event_id").alias("id"))
    lists = firsts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "event_type"))).alias("r"))
    return lists.select("user_id", selection.ordered_reasons(F.col("r.event_type"), F.col("r.event_type")).alias("reasons"))


@query("select doc_id, sha256('17' || chr(10) || doc_id) as seed_key from documents order by 2, 1 limit 25")
def seeded_sample(spark, sf_dir):
    picked = selection.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, 17)
    return picked.select("doc_id", seeded_key(17, F.col("doc_id")).alias("seed_key"))


@query("select o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 100")
def limit_prefix(spark, sf_dir):
    return selection.prefix(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query("select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as rank from orders qualify rank <= 10")
def top_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(order).alias("rank"))
    return ranked.where("rank <= 10")


# ---- identity


@query("select s_suppkey, coalesce(replace(trim(r_name), ' ', '-'), 'object') as category from supplier left join region on s_nationkey = r_regionkey")
def category_default(spark, sf_dir):
    categories = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("obj_id"), F.col("r_name").alias("category"))
    return identity.with_category(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), categories, "s_nationkey").select("s_suppkey", "category")


@query("select p_partkey, replace(trim(p_name), ' ', '-') as category from part")
def category_spaces(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", identity.category_name(F.col("p_name")).alias("category"))


@query("select o_orderkey, o_orderstatus || '_' || o_custkey || '_' || o_orderkey as stem from orders")
def stem_projection(spark, sf_dir):
    stem = identity.instance_stem(F.col("o_orderstatus"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", stem.alias("stem"))


@query(
    f"select doc_id, sha256('{identity.CAPTION_SCHEMA_VERSION}' || chr(10) || '{MODEL}' || chr(10) || '{identity.PROMPT_VERSION}' || chr(10) || lang || chr(10) || sha256(text))[1:16] as cache_key from documents"
)
def cache_identity(spark, sf_dir):
    key = identity.cache_key(F.lit(MODEL), F.col("lang"), F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


@query(f"select doc_id, sha256('{MODEL}' || chr(10) || '{identity.PROMPT_VERSION}' || chr(10) || lang || chr(10) || sha256(text))[1:24] as request_key from documents")
def request_key(spark, sf_dir):
    key = identity.request_key(F.lit(MODEL), F.col("lang"), F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("request_key"))


@query(f"with {SOURCE_PICKS_SQL} select source, sha256(string_agg(sha256(text), chr(10) order by pos)) as composite_sha256 from sp group by 1")
def composite_identity(spark, sf_dir):
    grouped = selection.as_array(_source_picks(spark, sf_dir), ["source"], ["sha256"])
    return grouped.select("source", identity.composite_of(F.col("views.sha256")).alias("composite_sha256"))


# ---- joins and batches


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def captioned_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def uncaptioned_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """select coalesce(d, l) as doc_id, case when l is null then 'left' else 'right' end as side from (select doc_id as d from documents) a
full join (select distinct doc_id as l from labels) b on d = l where d is null or l is null"""
)
def stem_full_outer(spark, sf_dir):
    return splits.one_sided(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """select coalesce(d.doc_id, l.doc_id) as key, case when d.doc_id is null then 'unknown' when l.doc_id is null then 'unanswered' when toxic = 1 then 'error' else 'answered' end as status
from documents d full join labels l on d.doc_id = l.doc_id"""
)
def keyed_result_join(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("key"), F.col("doc_id").alias("ordinal"), F.col("quality").cast("string").alias("response"), F.when(F.col("toxic") == 1, "toxic").alias("error")
    )
    return batches.matched_results(requests, results).select("key", "status")


@query("select page_id, ((row_number() over (order by page_id) - 1) // 100)::int as chunk, printf('input-%03d.jsonl', (row_number() over (order by page_id) - 1) // 100) as input_file from pages")
def request_chunks(spark, sf_dir):
    return batches.chunked(table(spark, sf_dir, "pages").select("page_id"), ["page_id"]).select("page_id", "chunk", "input_file")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 0)")
def uncached_requests(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("validation_errors"))
    return batches.uncached(table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id")


@query("select event_id, (props->>'$.k')::int as k from events")
def json_props(spark, sf_dir):
    props = F.try_parse_json(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(props, "$.k", "int").alias("k"))


# a string where an int belongs, a fraction, no key, a number beyond an int; numbers among tags and for the id; a key too many
TYPED_SQL = """j as (select event_id, ('{"id": ' || case when event_id % 11 = 1 then event_id::varchar else '"' || event_id || '"' end
  || case event_id % 7 when 1 then ', "user": "7"' when 2 then ', "user": 7.5' when 3 then '' when 4 then ', "user": 3000000000' when 5 then ', "user": null' else ', "user": ' || user_id end
  || ', "tags": ["' || event_type || '"' || case when event_id % 5 = 1 then ', 3' else '' end || '], "props": ' || case when event_id % 13 = 1 then '[]' when event_id % 13 = 2 then '{"k": 1, "l": 2}' else props end || '}')::json as j from events),
u as (select *, json_type(j, '$.id') as ti, json_type(j, '$.user') as tu, json_type(j, '$.tags[1]') as tt, json_type(j, '$.props') as tp from j)"""


@query(
    f"""with {TYPED_SQL} select event_id, concat_ws('; ', case when ti <> 'VARCHAR' then '$.id: expected string, got bigint' end,
  case when tu is null then '$.user: missing' when tu = 'NULL' then '$.user: null' when tu = 'VARCHAR' then '$.user: expected int, got string' when tu = 'DOUBLE' then '$.user: expected int, got decimal'
    when (j->>'$.user')::bigint > 2147483647 then '$.user: out of range for int' end,
  case when tt <> 'VARCHAR' then '$.tags[1]: expected string, got bigint' end,
  case when tp <> 'OBJECT' then '$.props: expected object, got array' when len(json_keys(j, '$.props')) > 1 then '$.props.l: not expected' end) as errors from u"""
)
def typed_json(spark, sf_dir):
    n, lit = F.col("event_id"), F.lit
    user = F.when(n % 7 == 1, ', "user": "7"').when(n % 7 == 2, ', "user": 7.5').when(n % 7 == 3, "").when(n % 7 == 4, ', "user": 3000000000').when(n % 7 == 5, ', "user": null')
    text = F.concat(
        lit('{"id": '), F.when(n % 11 == 1, n.cast("string")).otherwise(F.concat(lit('"'), n.cast("string"), lit('"'))), user.otherwise(F.concat(lit(', "user": '), F.col("user_id").cast("string"))),
        lit(', "tags": ["'), "event_type", lit('"'), F.when(n % 5 == 1, ", 3").otherwise(""), lit('], "props": '),
        F.when(n % 13 == 1, "[]").when(n % 13 == 2, '{"k": 1, "l": 2}').otherwise(F.col("props")), lit("}"),
    )
    schema = "id string not null, user int not null, tags array<string> not null, props struct<k:int not null> not null"
    errors = type_errors(F.parse_json(text), schema, closed=True)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, "; ").alias("errors"))


@query("select event_id, event_type || '/' || props as response_text from events")
def response_text(spark, sf_dir):
    part = lambda c: F.struct(c.alias("text"))
    parts = F.array(part(F.col("event_type")), part(F.lit("/")), part(F.col("props")), part(F.lit(None).cast("string")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    return table(spark, sf_dir, "events").select("event_id", batches.response_text(response).alias("response_text"))


# ---- splits

SPLIT_SQL = """g as (select source, sha256('17' || chr(10) || source) as k from (select distinct source from documents)),
held as (select source from g order by k, source limit (select greatest(1, least(count(*) - 1, round_even(count(*) * 0.1, 0)::bigint)) from g)),
s as (select d.doc_id, d.source, d.text, case when held.source is null then 'train' else 'holdout' end as split from documents d left join held on d.source = held.source)"""


def _split(spark, sf_dir, *columns) -> DataFrame:
    return splits.split(table(spark, sf_dir, "documents").select("doc_id", "source", *columns), "source")


@query(f"with {SPLIT_SQL} select doc_id, source, split from s")
def group_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"with {SPLIT_SQL} select sha256(text) as sha256, count(*) as n from s group by 1 having count(distinct split) > 1")
def leakage_report(spark, sf_dir):
    return splits.leakage(_split(spark, sf_dir, F.sha2("text", 256).alias("sha256")), "sha256")


@query(f"with {SPLIT_SQL} select split, doc_id, source, 17 as seed, 0.1::double as holdout_fraction from s where split = 'train' union all select split, doc_id, source, 17, 0.1 from s where split = 'holdout'")
def union_manifest(spark, sf_dir):
    parts = _split(spark, sf_dir)
    both = parts.where("split = 'train'").unionByName(parts.where("split = 'holdout'")).withColumn("stem", F.col("doc_id"))
    return splits.split_manifest(both, seed=17, fraction=0.1).select("split", "doc_id", "source", "seed", "holdout_fraction")


@query(
    """select coalesce(w.n, p.n) as name, case when w.n is null then 'extra' when p.n is null then 'copy' when w.h = p.h then 'skip' else 'conflict' end as action
from (select doc_id::varchar as n, sha256(text) as h from documents) w
full join (select doc_id::varchar as n, sha256(case when toxic = 1 then text || '!' else text end) as h from documents join labels using (doc_id)) p on w.n = p.n"""
)
def copy_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("name"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    present = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("name", F.sha2(changed, 256).alias("sha256"))
    return splits.copy_plan(docs.select("name", F.sha2("text", 256).alias("sha256")), present)


# ---- evaluation

PLAN_SQL = """plan as (select item_id::varchar as prompt_id, text as prompt, seed, condition from benchmark, unnest([1001, 1002]) as u(seed), unnest(['base', 'lora']) as v(condition))"""


def _plan(spark, sf_dir) -> DataFrame:
    return evaluation.generation_plan(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt")))


@query(f"with {PLAN_SQL} select prompt_id, prompt, seed::int as seed, condition, 3.5::double as guidance_scale, 20 as num_inference_steps, 1024 as width, 1024 as height from plan")
def generation_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(
    f"""with {PLAN_SQL}, broken as (select *, case when prompt_id::int % 9 = 4 and condition = 'lora' then 512 else 1024 end as width from plan where not (prompt_id::int % 7 = 3 and condition = 'lora')),
g as (select prompt_id, seed, count(*) as n, count(distinct condition) as c, min(width) <> max(width) as w from broken group by 1, 2)
select prompt_id, seed::int as seed, case when n <> 2 or c <> 2 then 'expected exactly one record for each condition' else 'controlled fields differ: width' end as error from g where n <> 2 or c <> 2 or w"""
)
def pair_validate(spark, sf_dir):
    number = F.col("prompt_id").cast("int")
    lora = F.col("condition") == "lora"
    broken = _plan(spark, sf_dir).where(~((number % 7 == 3) & lora)).withColumn("width", F.when((number % 9 == 4) & lora, 512).otherwise(F.col("width")))
    return evaluation.pair_errors(broken)


BLIND_SQL = f"""{PLAN_SQL}, b as (select *, dense_rank() over (order by prompt_id, seed) as pair_number,
  row_number() over (partition by prompt_id, seed order by sha256('17' || chr(10) || prompt_id || chr(10) || seed || chr(10) || condition), condition) as r from plan)"""


@query(f"with {BLIND_SQL} select prompt_id, seed::int as seed, condition, pair_number::int as pair_number, case r when 1 then 'A' else 'B' end as blind_label from b")
def blind_labels(spark, sf_dir):
    return evaluation.blinded(_plan(spark, sf_dir)).select("prompt_id", "seed", "condition", "pair_number", "blind_label")


@query(
    f"""with {BLIND_SQL} select printf('pair-%03d', pair_number) as pair_id, prompt_id, seed::int as seed, case r when 1 then 'A' else 'B' end as blind_label,
printf('images/pair-%03d_', pair_number) || case r when 1 then 'A' else 'B' end || '.png' as image_path, prompt, {', '.join(f"'' as {f}" for f in evaluation.SCORE_FIELDS)} from b"""
)
def scorecard_blank(spark, sf_dir):
    return evaluation.scorecard(evaluation.blinded(_plan(spark, sf_dir)))


# ---- layout


@query("select s_suppkey, s_name, printf('%04d', row_number() over (order by s_name, s_suppkey)) as new_stem from supplier")
def rename_map(spark, sf_dir):
    order = numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"])
    return order.select("s_suppkey", "s_name", padded(F.col("ordinal") + 1, 4).alias("new_stem"))


@query(
    """with t as (select doc_id, n_chars % 97 as h, row_number() over (order by doc_id) - 1 as i from documents),
r as (select i // 3 as row, max(h) + 384 as rh from t group by 1), y as (select row, coalesce(sum(rh) over (order by row rows between unbounded preceding and 1 preceding), 0) as y from r)
select doc_id, (i // 3)::int as row, (i % 3)::int as col, ((i % 3) * 384)::bigint as x, y.y::bigint as y from t join y on t.i // 3 = y.row"""
)
def grid_layout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("label_height"))
    return layout.grid(numbered(docs, ["doc_id"]), "ordinal").select("doc_id", "row", "col", "x", "y")


# ---- the flagship: conversations as four-view instances with a synthetic annotation


def _annotated(spark, sf_dir) -> DataFrame:
    """One row per conversation of four or more turns, with the annotation that SURVEY §7.6 derives
    from its picks by modular arithmetic."""
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int") + 1)
    c, t, k = F.col("conv_id"), F.col("turn"), F.col("pos")
    h = F.when((3 * c + k) % 13 == 0, "indeterminate").otherwise(at(A.HORIZONTAL_VIEWS[:7], (c + 2 * k + t) % 7))
    lateral = F.col("h").isin(*A.LATERAL)
    side = (
        F.when(lateral & ((c + k) % 11 == 0), "neither")
        .when(lateral, F.when(t % 2 == 0, "left").otherwise("right"))
        .when(F.col("h") == "indeterminate", "indeterminate")
        .when((7 * c + k) % 29 == 0, "left")
        .otherwise("neither")
    )
    vertical = F.when((5 * c + k) % 17 == 0, "indeterminate").otherwise(at(A.VERTICAL_ANGLES[:5], (c + t) % 5))
    confidence = F.when(c % 23 == 0, 1.5).otherwise(((13 * c + 17 * t) % 101) / F.lit(100.0))
    features = F.array(F.concat("role", F.lit(" turn")), F.concat(F.lit("turn "), t.cast("string")))
    rows = _picks(spark, sf_dir).withColumn("h", h).withColumn("s", side)
    view = F.struct(
        at(A.TILES, k).alias("tile"), F.col("h").alias("horizontal_view"), F.col("s").alias("side"), vertical.alias("vertical_angle"), F.lit("full object").alias("framing"), features.alias("visible_features"), confidence.alias("confidence")
    )
    grouped = selection.as_array(rows.withColumn("view", view), ["conv_id"], ["view"], "items")
    return grouped.select("conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("object_summary"), F.col("items.view").alias("raw_views"))


VIEW_SQL = f"""{PICKS_SQL},
h as (select *, case when (3 * conv_id + pos) % 13 = 0 then 'indeterminate' else ['front', 'front_three_quarter', 'side', 'rear_three_quarter', 'back', 'top', 'bottom'][((conv_id + 2 * pos + turn) % 7) + 1] end as h0 from picks),
s as (select *, h0 in ('front_three_quarter', 'side', 'rear_three_quarter') as lat from h),
s2 as (select *, case when lat and (conv_id + pos) % 11 = 0 then 'neither' when lat then case when turn % 2 = 0 then 'left' else 'right' end
  when h0 = 'indeterminate' then 'indeterminate' when (7 * conv_id + pos) % 29 = 0 then 'left' else 'neither' end as s0 from s),
v as (select conv_id, turn, role, pos, ['top_left', 'top_right', 'bottom_left', 'bottom_right'][pos + 1] as tile,
  case when lat and s0 = 'neither' then 'indeterminate' else h0 end as hv, case when lat and s0 = 'neither' then 'indeterminate' else s0 end as side,
  case when (5 * conv_id + pos) % 17 = 0 then 'indeterminate' else ['overhead', 'high_angle', 'eye_level', 'low_angle', 'underside'][((conv_id + turn) % 5) + 1] end as va,
  case when conv_id % 23 = 0 then 1.5 else ((13 * conv_id + 17 * turn) % 101) / 100.0 end as conf from s2),
e as (select *, case when conf > 1 then 'views.' || pos || '.confidence: Input should be less than or equal to 1'
  when hv in ('front', 'back', 'top', 'bottom') and side <> 'neither' then 'views.' || pos || ': Value error, side must be neither for ' || hv end as err,
  array_to_string(list_filter([case when hv = 'indeterminate' then tile || '.horizontal_view is indeterminate' end, case when side = 'indeterminate' then tile || '.side is indeterminate' end,
    case when va = 'indeterminate' then tile || '.vertical_angle is indeterminate' end], lambda x: x is not null), '; ') as why,
  '[' || upper(replace(tile, '_', '-')) || '] ' || case hv when 'side' then upper(side[1:1]) || side[2:] || ' side' when 'front_three_quarter' then 'Front-' || side || ' three-quarter'
    when 'rear_three_quarter' then 'Rear-' || side || ' three-quarter' else upper(hv[1:1]) || hv[2:] end || ', '
    || case va when 'high_angle' then 'high angle' when 'eye_level' then 'eye-level' when 'low_angle' then 'low angle' else va end || '; ' || role || ' turn, turn ' || turn as txt from v),
c as (select conv_id, coalesce(string_agg(err, '; ' order by pos), '') as errors, coalesce(string_agg(why, '; ' order by pos) filter (where why <> ''), '') as reasons,
  '[FOUR-VIEWS] Four views of conversation ' || conv_id || '; ' || string_agg(txt, '; ' order by pos) || '.' as cap from e group by conv_id),
o as (select *, case when errors <> '' then 'failed' when reasons <> '' then 'abstention' else 'accepted' end as outcome from c)"""


def _curated(spark, sf_dir) -> DataFrame:
    rows = _annotated(spark, sf_dir).withColumn("views", A.normalise(F.col("raw_views")))
    out = A.routed(rows)
    return out.select(
        "conv_id", "outcome", F.array_join("validation_errors", "; ").alias("errors"), F.array_join("rejection_reasons", "; ").alias("reasons"), "caption", "views"
    )


@query(f"with {VIEW_SQL} select conv_id, outcome, errors, reasons, case when outcome = 'accepted' then cap end as caption from o")
def curate_conversations(spark, sf_dir):
    return _curated(spark, sf_dir).drop("views")


@query(f"with {VIEW_SQL} select conv_id, pos::int as pos, hv as horizontal_view, side from v")
def annotation_normalize(spark, sf_dir):
    return _curated(spark, sf_dir).select("conv_id", F.posexplode("views").alias("pos", "v")).select("conv_id", "pos", "v.horizontal_view", "v.side")


@query(f"with {VIEW_SQL} select conv_id, errors from o where errors <> ''")
def annotation_validate(spark, sf_dir):
    return _curated(spark, sf_dir).where("errors <> ''").select("conv_id", "errors")


# what is changed in the response of a conversation, by its number modulo CHANGES
CHANGES = 24
PARSE_SQL = f"""{VIEW_SQL},
m as (select conv_id, conv_id % {CHANGES} as m, pos, tile, hv, side, va, 'full object' as framing, 2 as n_features, false as blank, conf from v),
x as (select conv_id, m, case when m = 15 then 3 - pos else pos end as i, case when m = 14 and pos = 1 then 'top_left' else tile end as tile,
  case when m = 21 and pos = 1 then 'indeterminate' when m = 22 and pos = 2 then 'aslant' else hv end as hv, case when m = 21 and pos = 1 then 'left' else side end as side,
  case when m = 16 and pos = 0 then 'sideways' else va end as va, case when m = 17 and pos = 1 then ' ' else framing end as framing,
  case when m = 18 and pos = 2 then 0 else n_features end as n_features, m = 19 and pos = 3 as blank, case when m = 20 and pos = 0 then -1 else conf end as conf
  from m where not (m = 12 and pos = 3)),
y as (select * from x union all select * replace (4 as i) from x where m = 13 and i = 0),
own as (select *, 'views.' || i as place, list_filter([
  case when hv = 'aslant' then '.horizontal_view: Input should be one of the listed values' end,
  case when va = 'sideways' then '.vertical_angle: Input should be one of the listed values' end,
  case when trim(framing) = '' then '.framing: String should have at least 1 character' end,
  case when n_features = 0 then '.visible_features: List should have at least 1 item' when blank then '.visible_features: String should have at least 1 character' end,
  case when conf < 0 then '.confidence: Input should be greater than or equal to 0' when conf > 1 then '.confidence: Input should be less than or equal to 1' end], lambda e: e is not null) as es,
  case when hv in ('front', 'back', 'top', 'bottom') and side <> 'neither' then ': Value error, side must be neither for ' || hv
       when hv = 'indeterminate' and side <> 'indeterminate' then ': Value error, side must be indeterminate when horizontal_view is indeterminate' end as se from y),
per as (select conv_id, m, i, case when len(es) > 0 then list_transform(es, lambda e: place || e) when se is not null then [place || se] else [] end as es from own),
item as (select conv_id, any_value(m) as m, flatten(list(es order by i)) as es from per group by 1),
p as (select conv_id, case m
  when 0 then 'object_summary: Field required' when 1 then 'views: Input should be a valid list' when 2 then 'views.0.framing: Field required'
  when 3 then 'views.1.framing: Input should be a valid string' when 4 then 'views.2.confidence: Input should be a valid number'
  when 5 then 'views.3.extra: Extra inputs are not permitted' when 6 then 'more: Extra inputs are not permitted' when 7 then 'views.0: Input should be a valid dictionary'
  when 8 then 'response is not valid JSON: it cannot be parsed' when 9 then 'Input should be a valid dictionary' when 10 then 'views.0.visible_features: Input should be a valid list of strings'
  else array_to_string(list_concat(case when m = 11 then ['object_summary: String should have at least 1 character'] else [] end,
    case when len(es) > 0 then es when m = 12 then ['views: List should have at least 4 items'] when m = 13 then ['views: List should have at most 4 items']
      when m = 14 then ['Value error, view tile values must be unique'] when m = 15 then ['Value error, views must use canonical tile order'] else [] end), '; ') end as errors from item)"""


def _changed_responses(spark, sf_dir) -> DataFrame:
    """(conv_id, raw_response_text): the annotations as JSON text, each changed in one way or not at all."""
    m = F.col("conv_id") % CHANGES
    put = lambda old, new: lambda t: F.regexp_replace(t, old, F.lit(new))
    changes = {  # by number: the view and what happens to its text
        2: (0, put('"framing":"full object",', "")),
        3: (1, put('"framing":"full object"', '"framing":5')),
        4: (2, put('"confidence":[-0-9.E]+', '"confidence":"0.9"')),
        5: (3, put('^.', '{"extra":1,')),
        7: (0, lambda t: F.lit("3")),
        10: (0, put(r'"visible_features":\[[^\]]*\]', '"visible_features":"x"')),
        14: (1, put('"tile":"top_right"', '"tile":"top_left"')),
        16: (0, put('"vertical_angle":"[a-z_]+"', '"vertical_angle":"sideways"')),
        17: (1, put('"framing":"full object"', '"framing":" "')),
        18: (2, put(r'"visible_features":\[[^\]]*\]', '"visible_features":[]')),
        19: (3, put(r'"visible_features":\[[^\]]*\]', '"visible_features":[" "]')),
        20: (0, put('"confidence":[-0-9.E]+', '"confidence":-1')),
        21: (1, put('"horizontal_view":"[a-z_]+","side":"[a-z]+"', '"horizontal_view":"indeterminate","side":"left"')),
        22: (2, put('"horizontal_view":"[a-z_]+"', '"horizontal_view":"aslant"')),
    }

    def text(v: Column, i: Column) -> Column:
        out = F.to_json(v)
        for number, (place, change) in changes.items():
            out = F.when((m == number) & (i == place), change(F.to_json(v))).otherwise(out)
        return out

    views = F.transform("raw_views", text)
    views = F.when(m == 12, F.slice(views, 1, 3)).when(m == 13, F.concat(views, F.slice(views, 1, 1))).when(m == 15, F.reverse(views)).otherwise(views)
    listed = F.when(m == 1, F.lit('"no"')).otherwise(F.concat(F.lit("["), F.array_join(views, ","), F.lit("]")))
    summary = F.when(m == 11, F.lit("  ")).otherwise(F.col("object_summary"))
    head = F.when(m == 0, F.lit("{")).otherwise(F.concat(F.lit('{"object_summary":"'), summary, F.lit('",')))
    whole = F.concat(head, F.lit('"views":'), listed, F.when(m == 6, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"))
    raw = F.when(m == 8, F.lit("not json")).when(m == 9, F.lit("[1]")).otherwise(whole)
    return _annotated(spark, sf_dir).select("conv_id", raw.alias("raw_response_text"))


@query(f"with {PARSE_SQL} select conv_id, errors from p")
def annotation_parse(spark, sf_dir):
    return A.parsed(_changed_responses(spark, sf_dir)).select("conv_id", F.array_join("validation_errors", "; ").alias("errors"))


@query(
    f"""with {PARSE_SQL}, k as (select *, row_number() over (order by conv_id) - 1 as n from (select conv_id from p where conv_id % 3 <> 0) a)
select p.conv_id, (n // 100)::int as chunk, case when n is null then 'cached' when p.conv_id % 11 = 1 then 'error' when p.conv_id % 13 = 1 then 'no content' when p.conv_id % 17 = 1 then null else 'answered' end as status,
  case when n is null or p.conv_id % 17 = 1 and p.conv_id % 11 <> 1 and p.conv_id % 13 <> 1 then null
       when p.conv_id % 11 = 1 or p.conv_id % 13 = 1 or errors <> '' then 'invalid' else 'valid' end as validation_outcome
from p left join k using (conv_id)"""
)
def batch_lifecycle(spark, sf_dir):
    """Requests that no valid entry answers, their chunks, and what their results become."""
    c = F.col("conv_id")
    own = _changed_responses(spark, sf_dir).withColumn("key", F.lpad(c.cast("string"), 12, "0")).withColumn("category", F.lit("object"))
    own = own.select("*", F.col("key").alias("cache_key"), F.sha2("key", 256).alias("composite_sha256"), F.array("key").alias("source_image_sha256"))
    cached = own.where(c % 3 == 0).select("cache_key", F.array().cast("array<string>").alias("validation_errors"))
    index, _ = batches.prepared(own.drop("raw_response_text"), cached, ["key"])
    text = F.to_json(F.struct(F.col("raw_response_text").alias("text")))
    response = F.when(c % 13 == 1, F.lit('{"candidates":[]}')).otherwise(F.concat(F.lit('{"candidates":[{"content":{"parts":['), text, F.lit("]}}]}")))
    failed = c % 11 == 1
    results = own.where(failed | (c % 13 == 1) | (c % 17 != 1)).select("key", F.lit(1).alias("ordinal"), F.when(~failed, response).alias("response"), F.when(failed, "quota").alias("error"))
    results = results.join(index.where("chunk is not null").select("key"), "key", "left_semi")
    got = batches.collected(index, results, model=MODEL).select("key", "status", "validation_outcome")
    told = F.when(F.col("chunk").isNull(), "cached").otherwise(F.col("status"))
    return index.join(got, "key", "left").select("conv_id", F.col("chunk").cast("int").alias("chunk"), told.alias("status"), "validation_outcome")


@query(f"with {VIEW_SQL} select conv_id, reasons from o")
def annotation_eligibility(spark, sf_dir):
    return _curated(spark, sf_dir).select("conv_id", "reasons")


@query(
    f"""with {VIEW_SQL}, i as (select conv_id, bool_and(hv <> 'indeterminate' and side <> 'indeterminate' and va <> 'indeterminate' and conf >= 0.2) as pose,
  '[FOUR-VIEWS] Four views of conversation ' || conv_id || '; ' || string_agg('[' || upper(replace(tile, '_', '-')) || '] ' || role || ' turn, turn ' || turn, '; ' order by pos) || '.' as cap
  from v group by 1)
select conv_id, 'pose' as policy, null::varchar as identity_caption, null::varchar as export_error from i where pose union all select conv_id, 'identity', cap, null from i
union all select conv_id, 'benchmark', null, null from i"""
)
def export_policies(spark, sf_dir):
    rows = _annotated(spark, sf_dir).select("conv_id", "object_summary", A.normalise(F.col("raw_views")).alias("views"))
    own = lambda p: A.exported(rows, p, threshold=0.2).withColumn("policy", F.lit(p))
    every = own("identity").unionByName(own("pose"), allowMissingColumns=True).unionByName(own("benchmark"), allowMissingColumns=True)
    return every.select("conv_id", "policy", "identity_caption", "export_error")


@query(f"with {VIEW_SQL} select conv_id, cap as caption from o where outcome = 'accepted'")
def caption_render(spark, sf_dir):
    return _curated(spark, sf_dir).where("outcome = 'accepted'").select("conv_id", "caption")


@query(
    f"""with {VIEW_SQL}, k as (select count(*) as n from (select conv_id from conversations group by 1 having count(*) < 4))
select count(*) filter (where outcome = 'accepted') as used, 4 * count(*) filter (where outcome = 'accepted') as images, count(*) filter (where outcome = 'abstention') as ambiguous,
(select n from k) as skipped, count(*) filter (where outcome = 'failed') as failed from o"""
)
def outcome_counters(spark, sf_dir):
    short = selection.short_groups(table(spark, sf_dir, "conversations"), ["conv_id"]).select(F.lit("skipped").alias("outcome"))
    return A.outcome_counters(_curated(spark, sf_dir).select("outcome").unionByName(short))


# ---- metrics


@query(
    """with p as (select quality as g, toxic as q from labels), c as (select g as label from p union select q from p),
f as (select label, (select count(*) from p where g = label and q = label) as t, (select count(*) from p where g = label) as s, (select count(*) from p where q = label) as r from c)
select count(*) as n_classes, round(avg(2.0 * t / (s + r)), 9) as macro_f1 from f"""
)
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(table(spark, sf_dir, "labels"), "quality", "toxic").select("n_classes", F.round("macro_f1", 9).alias("macro_f1"))


PROB_SQL = "p as (select event_id, event_type, (value - min(value) over ()) / nullif(max(value) over () - min(value) over (), 0) as p, (event_id % 3 = 0)::int as y from events)"


def _probabilities(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ends = events.agg(F.min("value"), F.max("value")).first()
    return events.select("event_id", "event_type", F.try_divide(F.col("value") - ends[0], F.lit(ends[1]) - ends[0]).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))


@query(f"with {PROB_SQL} select count(*) as n, round(avg((p - y) * (p - y)), 9) as brier from p")
def brier(spark, sf_dir):
    return metrics.brier(_probabilities(spark, sf_dir), "p", "y").select("n", F.round("brier", 9).alias("brier"))


@query(f"with {PROB_SQL}, b as (select least(floor(p * 10), 9) as b, count(*) as n, avg(p) as c, avg(y) as a from p group by 1) select round(sum(n * abs(c - a)) / sum(n), 9) as ece from b")
def ece(spark, sf_dir):
    return metrics.ece(_probabilities(spark, sf_dir), "p", "y").select(F.round("ece", 9).alias("ece"))


@query(
    f"""with {PROB_SQL}, c as (select round(p, 3) as p, count(*) as n, count(*) filter (where y = 0) as w from p group by 1), k as (select p, sum(n) over o as answered, sum(w) over o as wrong from c window o as (order by p desc))
select p, answered::bigint as answered, round(answered / (select count(*) from events), 9) as coverage, round(wrong / answered, 9) as risk from k"""
)
def risk_coverage(spark, sf_dir):
    rounded = _probabilities(spark, sf_dir).select(F.round("p", 3).alias("p"), "y")
    return metrics.risk_coverage(rounded, "p", "y").select("p", "answered", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"))


@query(
    """with c as (select count(*) filter (where quality = 0 and toxic = 1) as b, count(*) filter (where quality = 0) as g, count(*) filter (where toxic = 1) as p, count(*) as n,
count(*) filter (where quality = 1 and toxic = 1) as o, count(*) filter (where quality = 0 and toxic = 0) as f from labels)
select round(b / p, 9) as precision, round(b / g, 9) as recall, round(2 * b / (g + p), 9) as f1, round(o / (n - g), 9) as over_abstention, round(f / (n - p), 9) as false_determination from c"""
)
def abstention_prf(spark, sf_dir):
    out = metrics.abstention(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(
    """with t as (select event_type as test, round(avg(value) / 1000, 6) as p from events group by 1), r as (select *, row_number() over (order by p, test) as r, count(*) over () as m from t)
select test, p, round(least(1.0, max(p * (m - r + 1)) over (order by p, test)), 9) as adjusted from r"""
)
def holm(spark, sf_dir):
    tests = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("test")).agg(F.round(F.avg("value") / 1000, 6).alias("p"))
    return metrics.holm(tests, "test", "p").select("test", "p", F.round("adjusted", 9).alias("adjusted"))


@query(
    """with e as (select vec_id // 4 as grp, (vec_id % 4)::int as p, embedding::double[] as v from embeddings)
select a.grp, a.p as a, b.p as b, round(list_cosine_similarity(a.v, b.v), 4) + 0.0 as similarity from e a join e b on a.grp = b.grp and a.p < b.p"""
)
def cosine_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("grp"), F.expr("cast(vec_id % 4 as int)").alias("p"), "embedding")
    return metrics.tile_pairs(rows, "grp", "p", "embedding").select("grp", "a", "b", (F.round("similarity", 4) + 0.0).alias("similarity"))


@query("select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def latency_report(spark, sf_dir):
    out = metrics.latency_report(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    """select event_type, count(*) as n, true as p50_within, true as p95_within from events where value is not null group by 1"""
)
def latency_sketch(spark, sf_dir):
    """Quantiles from daily sketches that are merged, held against the ranks that they have in all rows."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    merged = metrics.merged_sketches(metrics.latency_sketches(events, ["day", "event_type"], "value"), ["event_type"])
    found = metrics.sketched_quantiles(merged, {"p50": 0.5, "p95": 0.95})
    ranked = events.where("value is not null").join(found.select(F.col("event_type").alias("e"), "p50", "p95"), F.col("event_type").eqNullSafe(F.col("e")))
    # of equal values the quantile may be any, so its rank lies between those before and with it
    near = lambda c, q: (F.avg((F.col("value") < F.col(c)).cast("double")) <= q + 2 * metrics.rank_error()) & (F.avg((F.col("value") <= F.col(c)).cast("double")) >= q - 2 * metrics.rank_error())
    return ranked.groupBy("event_type").agg(F.count("*").alias("n"), near("p50", 0.5).alias("p50_within"), near("p95", 0.95).alias("p95_within"))


@query("select count(*) as n, round(count(*) filter (where props::json->>'$.k' >= '5') / count(*)::double, 9) as valid_rate from events")
def valid_rate(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return metrics.valid_rate(table(spark, sf_dir, "events"), k >= "5").select("n", F.round("valid_rate", 9).alias("valid_rate"))


CLAIMS_SQL = """a as (select l_orderkey, list(distinct l_returnflag || l_linestatus) as g, list(distinct l_returnflag || case when l_tax > 0.04 then 'O' else 'F' end) as p from lineitem group by 1),
n as (select len(list_intersect(g, p)) as h, len(g) as g, len(p) as p from a)"""


@query(f"with {CLAIMS_SQL} select round(sum(h) / sum(p)::double, 9) as precision, round(sum(h) / sum(g)::double, 9) as recall, round(avg(p), 9) as specificity, round((sum(p) - sum(h)) / sum(p)::double, 9) as hallucination_rate from n")
def claims(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("g"), F.concat("l_returnflag", F.when(F.col("l_tax") > 0.04, "O").otherwise("F")).alias("p"))
    sets = lines.groupBy("l_orderkey").agg(F.collect_set("g").alias("gold"), F.collect_set("p").alias("predicted"))
    out = metrics.claims(sets, "gold", "predicted")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(
    """with m as (select event_type as model, round(avg(value), 6) as latency, count(*) as n, round(count(*) filter (where value < 40) / count(*)::double, 6) as valid from events group by 1)
select model, latency, n, valid from m where valid >= 0.5 and n > 10 order by valid desc, latency, model limit 1"""
)
def model_selection(spark, sf_dir):
    valid = F.round(F.try_divide(F.count_if(F.col("value") < 40), F.count("*")), 6)
    models = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("latency"), F.count("*").alias("n"), valid.alias("valid"))
    return metrics.select_model(models, [F.col("valid") >= 0.5, F.col("n") > 10], [F.desc("valid"), F.col("latency"), F.col("model")])


CURVE_SQL = """s as (select (l_discount * 100 + l_tax * 1000 / 8)::int / 40.0 as c, (l_returnflag <> 'R')::int as y from lineitem),
d as (select c, count(*) as n, count(*) filter (where y = 0) as w from s group by 1),
k as (select c, sum(n) over o as a, sum(w) over o as wrong from d window o as (order by c desc)),
b as (select c, a, a / (select count(*) from lineitem)::double as coverage, wrong, 1 - wrong / a::double as p from k),
l as (select *, (p + 2.7055434540954146 / (2 * a) - 1.6448536269514722 * sqrt(p * (1 - p) / a + 2.7055434540954146 / (4.0 * a * a))) / (1 + 2.7055434540954146 / a) as lower from b)"""


@query(f"with {CURVE_SQL} select round(c, 6) as confidence, a::bigint as answered, round(coverage, 9) as coverage, round(wrong / a::double, 9) as risk, round(lower, 9) as lower from l where lower >= 0.6 and coverage >= 0.2 order by c limit 1")
def calibrated_threshold(spark, sf_dir):
    score = (F.col("l_discount") * 100 + F.col("l_tax") * 1000 / 8).cast("decimal(20,6)")
    rows = table(spark, sf_dir, "lineitem").select((F.round(score, 0) / 40).cast("double").alias("c"), (F.col("l_returnflag") != "R").cast("int").alias("y"))
    out = metrics.calibrated_threshold(rows, "c", "y", precision=0.6, coverage=0.2)
    return out.select(F.round("c", 6).alias("confidence"), "answered", *(F.round(c, 9).alias(c) for c in ("coverage", "risk", "lower")))


@query(
    """with r as (select doc_id, quality, row_number() over (partition by quality order by sha256('17' || chr(10) || doc_id), doc_id) as r, count(*) over (partition by quality) as n from labels)
select doc_id, quality from r where r <= round_even(n * 0.4, 0)"""
)
def stratified_split(spark, sf_dir):
    return metrics.stratified(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.4)


@query("select doc_id from documents where coalesce(sha256(text) not in (select sha256(text) from documents join labels using (doc_id) where toxic = 1 and text is not null), true) and coalesce(sha256(source) not in (select sha256(text) from benchmark), true)")
def benchmark_exclusion(spark, sf_dir):
    """Documents without the contents of labelled ones or of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.sha2("source", 256).alias("s"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    known = docs.join(toxic, "doc_id").select("h").unionByName(table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h")))
    return metrics.without_benchmark(docs.select("doc_id", F.array("h", "s").alias("hashes")), "hashes", known, "h").select("doc_id")


@query(
    """with f as (select event_type, avg(value) as m, count(*) as n from events group by 1)
select event_type, m > 20 as slow, n > 100 as enough, m > 20 and n > 100 as passed from f"""
)
def decision_gates(spark, sf_dir):
    figures = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return metrics.decide(figures, {"slow": F.col("m") > 20, "enough": F.col("n") > 100}).select("event_type", "slow", "enough", "passed")


@query(
    """with r as (select item_id, rep, sha256('17' || chr(10) || item_id || chr(10) || rep) as k from benchmark, unnest(range(0, 3)) as u(rep))
select item_id, rep::int as repeat, row_number() over (order by k, item_id, rep) - 1 as place from r"""
)
def repeated_items(spark, sf_dir):
    """Each item three times; its place in the interleaved order, which is that of the seeded keys."""
    each = metrics.repeats(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")
    key = seeded_key(17, F.concat_ws("\n", F.col("item_id").cast("string"), F.col("repeat").cast("string")))
    return numbered(each.withColumn("k", key), ["k", "item_id", "repeat"], "place").select("item_id", "repeat", "place")


@query(
    f"""with {PLAN_SQL}, kept as (select * from plan where not (prompt_id::int % 7 = 3 and condition = 'lora'))
select prompt_id, seed::int as seed, max(prompt) filter (where condition = 'base') as base_prompt, max(prompt) filter (where condition = 'lora') as lora_prompt from kept group by 1, 2"""
)
def condition_pivot(spark, sf_dir):
    kept = _plan(spark, sf_dir).where(~((F.col("prompt_id").cast("int") % 7 == 3) & (F.col("condition") == "lora")))
    return evaluation.by_condition(kept).select("prompt_id", "seed", F.col("base.prompt").alias("base_prompt"), F.col("lora.prompt").alias("lora_prompt"))


JOB_STATES = "case o_orderstatus when 'F' then 'JOB_STATE_SUCCEEDED' when 'O' then case when o_totalprice > 400000 then 'JOB_STATE_FAILED' else 'JOB_STATE_RUNNING' end else 'JOB_STATE_PENDING' end"


@query(
    f"""with j as (select o_orderpriority, {JOB_STATES} as s from orders), e as (select coalesce(max((s = 'JOB_STATE_FAILED')::int), 0) as bad, coalesce(max((s in ('JOB_STATE_RUNNING', 'JOB_STATE_PENDING'))::int), 0) as pending from j)
select case when bad = 1 then 1 when pending = 1 then 2 else 0 end as exit_code from e"""
)
def job_exit_code(spark, sf_dir):
    return batches.exit_code(table(spark, sf_dir, "orders").select(F.expr(JOB_STATES).alias("state")))


@query(
    """with s as (select o_custkey, o_orderdate::date::varchar as d, count(*) over (partition by o_custkey) as n from orders)
select d as value, count(*) as n from s group by 1 having count(distinct case when s.n % 2 = 0 then 'train' else 'holdout' end) = 2"""
)
def nested_leakage(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderdate").cast("date").cast("string")).alias("days"))
    sided = days.select(F.when(F.size("days") % 2 == 0, "train").otherwise("holdout").alias("split"), "days")
    return splits.nested_leakage(sided, "days").select("value", "n")


@query(
    """with p as (select item_id, case when item_id % 3 = 0 then '[FOUR-VIEWS] [TOP-LEFT] ' else '' end || text || case when item_id % 2 = 0 then ' [BOTTOM-LEFT]' else '' end as prompt from benchmark),
t as (select item_id, prompt, list_filter(['[FOUR-VIEWS]', '[TOP-LEFT]', '[TOP-RIGHT]', '[BOTTOM-LEFT]', '[BOTTOM-RIGHT]'], lambda x: not contains(prompt, x)) as gone from p)
select item_id::varchar as id, 'missing tags ' || array_to_string(gone, ', ') as error from t where len(gone) > 0"""
)
def prompt_tags(spark, sf_dir):
    n = F.col("item_id")
    prompt = F.concat(F.when(n % 3 == 0, "[FOUR-VIEWS] [TOP-LEFT] ").otherwise(""), "text", F.when(n % 2 == 0, " [BOTTOM-LEFT]").otherwise(""))
    return evaluation.prompt_errors(table(spark, sf_dir, "benchmark").select(n.cast("string").alias("id"), prompt.alias("prompt")))


@query(
    """with m as (select event_id, event_id || case when event_id % 7 = 1 then '.jpg' else '.png' end as image, case when event_id % 5 = 1 then event_id + 1 else event_id end || '.txt' as caption from events),
f as (select image as name from m where event_id % 11 <> 1 union select caption from m where event_id % 13 <> 1),
s as (select *, string_split(image, '.')[1] as stem, string_split(caption, '.')[1] as cs from m),
o as (select stem, case when image not like '%.png' then 'image and caption must be .png and .txt' when stem <> cs then 'image and caption stems differ' end as error from s)
select stem, error from o where error is not null union all select stem, 'missing file ' || name as error from (select stem, unnest([image, caption]) as name from s) w where name not in (select name from f)"""
)
def pair_files(spark, sf_dir):
    """Pair records made from events, some with other suffixes or stems, some without their files."""
    n = F.col("event_id")
    made = table(spark, sf_dir, "events").select(
        "event_id", F.concat(n.cast("string"), F.when(n % 7 == 1, ".jpg").otherwise(".png")).alias("output_image"),
        F.concat(F.when(n % 5 == 1, n + 1).otherwise(n).cast("string"), F.lit(".txt")).alias("output_caption"),
    )
    files = made.where(n % 11 != 1).select(F.col("output_image").alias("name")).union(made.where(n % 13 != 1).select("output_caption")).distinct()
    return splits.pair_errors(made, files)
