"""The registered queries of the core library and the SQL that tells the same.

Stand-ins: ``embeddings`` plays hash blocks and re-rank vectors (its label plays a card's name), ``part`` the catalog,
``documents`` and ``labels`` the cache, ``events`` the benchmark results. Query sets are the rows whose id is divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import geometry as G
from lodestar.functions import images as I
from lodestar.functions import models as M
from lodestar.functions import titles as T
from lodestar.functions import vectors as V
from lodestar.operators import catalog as C
from lodestar.operators import evaluate as E
from lodestar.operators import retrieval as R
from lodestar.operators import sampling as S
from lodestar.operators import temporal as W
from lodestar.sources.tables import table
from lodestar.streaming import sessions as X

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def put(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return put


# ---- views ----


def _wide(e):
    """9 by 8 values: each row of 8 and the value that follows it."""
    return F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get(e, ((8 * F.floor(i / 9) + i % 9) % 64).cast("int")))


def _hashes(e):
    return F.array(V.median_hash(e), V.gradient_hash(_wide(e)))


def _hashed(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", "label", "embedding", _hashes(F.col("embedding")).alias("hash"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    q = _hashed(s, d).filter("vec_id % 20 = 0")
    return q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query_embedding"), F.col("hash").alias("query_hash"))


def _near(s: SparkSession, d: str, k: int) -> DataFrame:
    return R.knn(_asked(s, d), _hashed(s, d), k, keep=("label", "query_label"))


def _rated(s: SparkSession, d: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``then`` makes of each query's candidates and their similarities."""
    return R.knn(_asked(s, d), _hashed(s, d), CANDIDATES, keep=("label", "query_label"), sims=True, then=lambda near: then(near.drop("rank")))


def _cards(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("set"),
        F.when(size % 7 == 0, "saga").when(size % 7 == 1, "token").when(size % 7 == 2, F.lit(None)).otherwise("normal").alias("layout"),
        F.when(size % 11 == 0, F.lit(None)).otherwise(size % 5 == 0).alias("full_art"),
        F.when(size % 13 == 0, "borderless").otherwise("black").alias("border_color"),
        F.when(size % 6 == 0, F.array(F.lit("showcase"))).when(size % 6 == 1, F.array(F.lit("etched"))).when(size % 6 == 2, F.lit(None)).otherwise(F.array().cast("array<string>")).alias("frame_effects"),
    )


def _bits_sql(e: str, med: str) -> str:
    return f"list_concat(list_transform({e}, lambda x: case when x > {med} then 1 else 0 end), list_transform(range(64), lambda i: case when {e}[(i + 1) % 64 + 1] > {e}[i + 1] then 1 else 0 end))"


HASHED = f"""h0 as (select vec_id, label, embedding, list_sort(embedding[2:64])[32] as med from embeddings),
h as (select vec_id, label, embedding, {_bits_sql("embedding", "med")} as bits from h0)"""
DIST = "list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2])))::int"
COS = "round(greatest(-1.0, least(1.0, list_dot_product(q.embedding::double[], c.embedding::double[]) / (greatest(sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])), 1e-8) * greatest(sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])), 1e-8)))), 6)"


# fixed value: candidates by hash that are re-ranked
CANDIDATES = 500


def _near_sql(k: int) -> str:
    return f"""{HASHED},
near as (select * from (select q.vec_id as query_id, q.label as query_label, c.vec_id, c.label, {DIST} as dist, {COS} as sim,
  row_number() over (partition by q.vec_id order by {DIST}, c.vec_id)::int as rank from h q join h c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0) where rank <= {k})"""


FOLD = "case when u >= 9223372036854775808::hugeint then (u - 18446744073709551616::hugeint)::bigint else u::bigint end"
CARDS = """cards as (select p_partkey as id, p_name as name, p_brand as "set",
  case when p_size % 7 = 0 then 'saga' when p_size % 7 = 1 then 'token' when p_size % 7 = 2 then null else 'normal' end as layout,
  case when p_size % 11 = 0 then null else p_size % 5 = 0 end as full_art,
  case when p_size % 13 = 0 then 'borderless' else 'black' end as border_color,
  case when p_size % 6 = 0 then ['showcase'] when p_size % 6 = 1 then ['etched'] when p_size % 6 = 2 then null else [] end as frame_effects from part),
framed as (select *, case when layout in ('saga', 'split', 'flip', 'class', 'case', 'battle', 'host', 'meld') then 'special'
  when full_art is true or border_color = 'borderless' or coalesce(list_has_any(frame_effects, ['showcase', 'extendedart']), false) then 'fullart' else 'modern' end as frame_class,
  border_color = 'borderless' or full_art is true or coalesce(list_has_any(frame_effects, ['extendedart', 'showcase', 'inverted', 'etched', 'fullart', 'colorshifted']), false) as alt_art from cards)"""
SHUFFLE = "((({k})::bigint * 48271 + 42 * 16807) % 2147483647)"

# ---- hashes and retrieval ----


def _packed_sql(half: str) -> str:
    return f"with {HASHED}, p as (select vec_id, list_reduce(list_transform(bits[{half}], lambda b: b::hugeint), lambda a, b: a * 2 + b) as u from h) select vec_id, {FOLD} as hash from p"


@_query(_packed_sql("1:64"))
def phash_bits(s, d):
    return _hashed(s, d).select("vec_id", F.col("hash")[0].alias("hash"))


@_query(_packed_sql("65:128"))
def dhash_bits(s, d):
    return _hashed(s, d).select("vec_id", F.col("hash")[1].alias("hash"))


@_query(f"with {_near_sql(10)} select query_id, vec_id, dist, rank from near")
def hamming_topk(s, d):
    return _near(s, d, 10).select("query_id", "vec_id", "dist", "rank")


@_query(f"with {_near_sql(2)}, g as (select query_id, max(dist) filter (rank = 1) as best, coalesce(max(dist) filter (rank = 2) - max(dist) filter (rank = 1), 0)::int as gap from near group by 1) select query_id, best, gap, best <= 4 and gap >= 8 as fast, round(1.0 / (1 + best), 6)::double as score from g")
def fast_path_decisions(s, d):
    near = _near(s, d, 2)
    gaps = R.margins(near, "dist", "query_id", "rank", "gap", 0, descending=False).withColumn("gap", F.col("gap").cast("int"))
    best = near.filter("rank = 1").select("query_id", F.col("dist").alias("best"))
    return best.join(gaps, "query_id").select("query_id", "best", "gap", ((F.col("best") <= 4) & (F.col("gap") >= 8)).alias("fast"), F.round(1.0 / (1 + F.col("best")), 6).cast("double").alias("score"))


@_query(f"with {_near_sql(CANDIDATES)}, r as (select query_id, vec_id, sim, dist, row_number() over (partition by query_id order by sim desc, dist, vec_id)::int as place from near) select * from r where place <= 10")
def cosine_rerank(s, d):
    best = _rated(s, d, lambda near: R.top_k(near, ["query_id"], [F.desc("sim"), F.col("dist"), F.col("vec_id")], 10, "place"))
    return best.select("query_id", "vec_id", "sim", "dist", "place")


_TWO = f"""with {_near_sql(CANDIDATES)}, r as (select *, row_number() over (partition by query_id order by sim desc, dist, vec_id) as r from near),
m as (select query_id, coalesce(max(sim) filter (r = 1) - max(sim) filter (r = 2), 1.0) as margin from r group by 1),
s as (select r.query_id, r.vec_id, r.dist, round(r.sim + case when round(m.margin, 6) < 0.05 and r.label in (0, 1, 2) then 0.10 else 0.0 end, 6) as score from r join m using (query_id)),
k as (select *, row_number() over (partition by query_id order by score desc, dist, vec_id)::int as place from s) select * from k where place <= 5"""


@_query(_TWO)
def two_stage_retrieval(s, d):
    best = _rated(s, d, lambda near: R.rerank(near, [F.col("label").isin(0, 1, 2)], 5))
    return best.select("query_id", "vec_id", "dist", "score", F.col("rank").cast("int").alias("place"))


@_query(
    f"""with {HASHED}, t as (select vec_id as query_id, embedding, t.turn from embeddings, (values (0), (1), (2), (3)) t(turn) where vec_id % 20 = 0),
b as (select query_id, turn, list_transform(range(64), lambda i: embedding[1 + case turn when 0 then i when 1 then (i % 8) * 8 + 7 - i // 8 when 2 then 63 - i else (7 - i % 8) * 8 + i // 8 end]) as block from t),
q as (select query_id, turn, {_bits_sql("block", "med")} as bits from (select *, list_sort(block[2:64])[32] as med from b)),
e as (select q.query_id, q.turn, min({DIST}) as dist from q join h c on c.vec_id <> q.query_id group by 1, 2)
select query_id, min(dist) as best, arg_min(turn, dist * 10 + turn)::int as turn from e group by 1"""
)
def tta_min_distance(s, d):
    turned = R.rotations(_asked(s, d), "query_embedding").select((F.col("query_id") * 4 + F.col("turn")).alias("key"), "query_id", "turn", _hashes(F.col("block")).alias("query_hash"))
    near = R.knn(turned, _hashed(s, d), 1, query="key", keep=("query_id", "turn"))
    return near.groupBy("query_id").agg(F.min("dist").alias("best"), F.min_by("turn", F.col("dist") * 10 + F.col("turn")).alias("turn"))


@_query(f"with h as (select vec_id, label, embedding from embeddings), s as (select q.vec_id as query_id, c.vec_id, {COS} as sim from h q join h c on q.label <> c.label where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by sim desc, vec_id)::int as rank from s) select * from r where rank <= 10")
def hard_negatives(s, d):
    near = R.knn(_asked(s, d), _hashed(s, d), 10, "cosine", differ=(("query_label", "label"),))
    return near.select("query_id", "vec_id", (-F.col("dist")).alias("sim"), F.col("rank").cast("int").alias("rank"))


@_query(f"with {_near_sql(5)}, g as (select query_id, max(query_label) as q, max(label) filter (rank = 1) as first, count(*) filter (label = query_label) as hits from near group by 1) select q as label, count(*) as n, round(100.0 * count(*) filter (first = q) / count(*), 4)::double as top1, round(100.0 * count(*) filter (hits > 0) / count(*), 4)::double as top5 from g group by 1")
def topk_accuracy(s, d):
    near = _near(s, d, 5).groupBy("query_id", "query_label").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("first"), F.count_if(F.col("label") == F.col("query_label")).alias("hits"))
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 4).cast("double")
    return near.groupBy(F.col("query_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("first") == F.col("query_label")).alias("top1"), pct(F.col("hits") > 0).alias("top5"))


# ---- catalog ----


@_query(f"with {CARDS} select id, frame_class, alt_art from framed")
def frame_class_rules(s, d):
    return _cards(s, d).select("id", C.frame_class().alias("frame_class"), C.is_alt_art().alias("alt_art"))


@_query(f"with {CARDS} select c.frame_class, count(id) as n, round(100.0 * count(id) / (select count(*) from framed), 4)::double as pct from (values ('modern'), ('fullart'), ('special')) c(frame_class) left join framed using (frame_class) group by 1")
def frame_distribution(s, d):
    return C.distribution(_cards(s, d).select(C.frame_class().alias("frame_class")), "frame_class", ["modern", "fullart", "special"])


@_query(f"with {CARDS} select id, unnest(range(1, case when alt_art then 4 else 2 end))::int as copy from framed")
def alt_art_oversample(s, d):
    return S.replicate(_cards(s, d).select("id", C.is_alt_art().alias("alt")), F.when(F.col("alt"), 3).otherwise(1)).select("id", "copy")


@_query("select event_type, count(*) as n, count(*) filter (json_extract(props, '$.k') is not null) as with_k, count(*) filter (json_extract(props, '$.z') is not null) as with_z from events group by 1")
def metadata_profile(s, d):
    fields = F.from_json("props", "map<string,string>")
    e = table(s, d, "events").select("event_type", fields.alias("m"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.map_contains_key("m", "k")).alias("with_k"), F.count_if(F.map_contains_key("m", "z")).alias("with_z"))


@_query("with v as (select case when p_size % 7 = 0 then '<missing>' when p_size % 7 = 2 then null else p_type end as value from part) select value, count(*) as n from v group by 1 order by n desc, value nulls last limit 15")
def top_values(s, d):
    kind = F.col("p_size") % 7
    fields = F.when(kind == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("type"), F.when(kind != 2, F.col("p_type"))))
    return C.top_values(table(s, d, "part").select(fields.alias("fields")), "fields", "type", 15)


@_query("select p_partkey, n.label from part left join (select p_brand, (row_number() over (order by p_brand) - 1)::int as label from part where p_brand <> 'Brand#11' group by 1 having count(*) >= 20) n using (p_brand)")
def dictionary_encode(s, d):
    part = table(s, d, "part").select("p_partkey", "p_brand")
    return C.encoded(part, S.dictionary(part.filter("p_brand <> 'Brand#11'"), "p_brand", 20), "p_brand").select("p_partkey", "label")


@_query("select d.doc_id, l.quality, case when l.doc_id is null then 'label missing' end as warning from documents d left join labels l using (doc_id)")
def label_join_warnings(s, d):
    return C.labelled(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "warning")


@_query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def availability_semi(s, d):
    return table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left_semi")


@_query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def cache_missing_anti(s, d):
    return table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left_anti")


@_query("select l.doc_id, l.quality, 'kept' as origin from labels l where l.doc_id in (select doc_id from documents) union all select doc_id, (n_chars > 500)::int, 'computed' from documents where doc_id not in (select doc_id from labels)")
def cache_refresh(s, d):
    return C.refresh(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", (F.col("n_chars") > 500).cast("int"), "quality")


@_query("select doc_id, coalesce(quality, 1) as quality, coalesce(cast(toxic as varchar), lang) as enriched from documents left join labels using (doc_id)")
def lookup_default(s, d):
    j = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), "lang").alias("enriched"))


@_query(
    """with n as (select distinct lower(p_name) as name from part), t as (select distinct concat(left(name, 2), substr(name, 4)) as title from n),
m as (select title, name, levenshtein(title, name) as edits from t join n on abs(length(title) - length(name)) <= 2 where levenshtein(title, name) <= 2),
b as (select title, min(edits) as edits from m group by 1), f as (select title, name as matched, edits, p_partkey as id from m join b using (title, edits) join part on lower(p_name) = name),
r as (select *, row_number() over (partition by title order by id) as r from f) select title, matched, edits::int as edits, id from r where r <= 20"""
)
def fuzzy_title_match(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    n = F.lower("name")
    titles = part.select(F.concat(F.substring(n, 1, 2), F.substring(n, 4, 10_000)).alias("title")).distinct()
    return C.fuzzy_titles(titles, part, "title", "name").select("title", "matched", "edits", "id")


@_query("select p_brand as \"set\", n, (row_number() over (order by p_brand) - 1)::int as label, round(1.0 / n, 8)::double as weight from (select p_brand, count(*) as n from part group by 1 having count(*) >= 20)")
def set_dictionary(s, d):
    return S.dictionary(_cards(s, d), "set", 20)


@_query("select p_partkey from part where p_brand in (select p_brand from part group by 1 having count(*) >= 80)")
def rare_set_filter(s, d):
    part = table(s, d, "part").select("p_partkey", "p_brand")
    return part.join(part.groupBy("p_brand").count().filter("count >= 80"), "p_brand", "left_semi").select("p_partkey")


# ---- sampling ----


@_query(f"with r as (select lang, source, doc_id, row_number() over (partition by lang, source order by {SHUFFLE.format(k='doc_id')}, doc_id)::int as rank from documents) select * from r where rank <= 5")
def stratified_quota_sample(s, d):
    return S.quota_sample(table(s, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 5)


@_query(f"with r as (select source, doc_id, row_number() over (partition by source order by {SHUFFLE.format(k='doc_id')}, doc_id) as r, count(*) over (partition by source) as n from documents) select source, doc_id, case when r <= floor(n * 0.85) then 'train' else 'val' end as split from r")
def stratified_split(s, d):
    return S.stratified_split(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "split")


@_query("select p_partkey as anchor, coalesce(lead(p_partkey) over (partition by p_name order by p_partkey), min(p_partkey) over (partition by p_name)) as positive from part")
def positives(s, d):
    return S.next_of_group(table(s, d, "part").select("p_name", F.col("p_partkey").alias("anchor")), "p_name", "anchor", "positive").select("anchor", "positive")


_TRIPLET = """with p as (select vec_id, label, embedding, coalesce(lead(vec_id) over (partition by label order by vec_id), min(vec_id) over (partition by label)) as pos from embeddings),
f as (select label, min(vec_id) as neg from embeddings group by 1), g as (select label, coalesce(lead(neg) over (order by label), min(neg) over ()) as neg from f),
t as (select p.vec_id as anchor, p.pos, g.neg, sqrt(list_sum(list_transform(list_zip(p.embedding, a.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as dp,
  sqrt(list_sum(list_transform(list_zip(p.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as dn
  from p join g using (label) join embeddings a on a.vec_id = p.pos join embeddings b on b.vec_id = g.neg)
select anchor, pos, neg, round(greatest(0.0, dp - dn + 0.3), 5) as loss from t"""


@_query(_TRIPLET)
def triplet_loss_eval(s, d):
    from pyspark.sql import Window

    e = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    anchors = S.next_of_group(e.select("vec_id", "label"), "label", "vec_id", "pos")  # vectors come later
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("first"))
    other = firsts.withColumn("neg", F.coalesce(F.lead("first").over(Window.orderBy("label")), F.min("first").over(Window.partitionBy()))).select("label", "neg")
    a = e.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("pe"))
    b = e.select(F.col("vec_id").alias("neg"), F.col("embedding").alias("ne"))
    negatives = other.join(b, "neg")  # a row a label, which all its anchors meet
    if firsts.count() <= 10_000:
        negatives = F.broadcast(negatives)
    t = anchors.join(negatives, "label").join(e.select("vec_id", "embedding"), "vec_id").join(a, "pos")
    loss = F.greatest(F.lit(0.0), V.distance(F.col("embedding"), F.col("pe")) - V.distance(F.col("embedding"), F.col("ne")) + 0.3)
    return t.select(F.col("vec_id").alias("anchor"), "pos", "neg", F.round(loss, 5).alias("loss"))


@_query(f"select count(*) as n, round(avg(loss), 5) as mean_loss from ({_TRIPLET})")
def triplet_loss_mean(s, d):
    return triplet_loss_eval(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 5).alias("mean_loss"))


# ---- evaluation ----


@_query("select event_type, (user_id % 3)::bigint as frame, grouping_id(event_type, user_id % 3)::int as level, count(*) as n, " + ", ".join(f"round(100.0 * count(*) filter ({c}) / count(*), 4)::double as {name}" for name, c in (("top1", "value > 50"), ("top5", "value > 20"), ("frame_ok", "event_id % 3 = user_id % 3"))) + ", round(avg(value), 4) as mean_value from events group by cube(event_type, user_id % 3)")
def benchmark_cube(s, d):
    e = table(s, d, "events").select("event_type", (F.col("user_id") % 3).alias("frame"), "event_id", "value")
    return E.report(e, ["event_type", "frame"], {"top1": F.col("value") > 50, "top5": F.col("value") > 20, "frame_ok": F.col("event_id") % 3 == F.col("frame")}, "value")


@_query("select event_type, user_id, list_sort(list(round(value, 3))) as values from events group by 1, 2")
def value_lists(s, d):
    return E.lists(table(s, d, "events").select("event_type", "user_id", F.round("value", 3).alias("value")), ["event_type", "user_id"], "value", "values").select("event_type", "user_id", "values")


@_query("select event_id, round(value + (event_id % 10) / 2 + coalesce(case when user_id % 2 = 0 then value / 4 end, 0), 6) as total from events")
def timing_totals(s, d):
    v, none = F.col("value"), F.lit(None).cast("double")
    timings = F.create_map(F.lit("detect"), v, F.lit("hash"), (F.col("event_id") % 10) / 2, F.lit("ocr"), F.when(F.col("user_id") % 2 == 0, v / 4).otherwise(none))
    return table(s, d, "events").select("event_id", F.round(E.total(timings), 6).alias("total"))


@_query("select event_type, round(100.0 * count(*) filter (value > 50) / count(*), 4)::double as pct, case when 100.0 * count(*) filter (value > 50) / count(*) > 80 then 'OK' when count(*) filter (value > 50) > 0 then 'PARTIAL' else 'MISSING' end as status from events group by 1")
def status_labels(s, d):
    pct = 100.0 * F.count_if(F.col("value") > 50) / F.count(F.lit(1))
    return table(s, d, "events").groupBy("event_type").agg(F.round(pct, 4).cast("double").alias("pct"), E.status(pct).alias("status"))


@_query("select vec_id, list_transform(list_sort(list_transform(embedding, lambda x, i: {'v': -x::double, 'place': i - 1}))[1:3], lambda p: p.place::int) as places, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double))), 6) as top_share from embeddings")
def softmax_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.transform(V.largest(F.col("embedding"), 3), lambda p: p["place"]).alias("places"), F.round(F.array_max(V.softmax(F.col("embedding"))), 6).alias("top_share"))


@_query("select event_type, user_id % 4 as route, count(*) as n from events group by 1, 2")
def route_histogram(s, d):
    return E.histogram(table(s, d, "events").withColumn("route", F.col("user_id") % 4), ["event_type"], "route")


@_query("with r as (select event_type, user_id, event_id, row_number() over (partition by event_type, user_id order by event_id)::int as place from events) select * from r where place <= 2")
def samples_first2(s, d):
    return E.first_samples(table(s, d, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")


@_query("with a as (select cast(ts as date) as day, round(max(value), 6) as best from events group by 1), b as (select *, max(best) over (order by day rows between unbounded preceding and 1 preceding) as best_before from a) select cast(day as varchar) as day, best, best_before, best_before is null or best > best_before as improved from b")
def running_best(s, d):
    days = table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.max("value"), 6).alias("best"))
    return E.running_best(days, "day", "best")


# fixed values: tokens in and out of a call, and their prices
TOKENS_IN, TOKENS_OUT, PRICE_IN, PRICE_OUT = 1568, 10, 3e-6, 1.5e-5


@_query("with a as (select event_type, avg(value) filter (user_id % 2 = 0) as ours, avg(value) filter (user_id % 2 = 1) as theirs, count(*) as n from events group by 1) select event_type, round(theirs / nullif(ours, 0), 4) as speedup, case when ours - theirs > 1 then 'ahead' when theirs - ours > 1 then 'behind' else 'level' end as verdict, round((1568 * 3e-6 + 10 * 1.5e-5) * n, 6)::double as cost from a")
def speedup_gap(s, d):
    a = table(s, d, "events").groupBy("event_type").agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("ours"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("theirs"), F.count(F.lit(1)).alias("n"))
    return a.select("event_type", F.round(F.col("theirs") / F.nullif("ours", F.lit(0)), 4).alias("speedup"), E.verdict(F.col("ours"), F.col("theirs")).alias("verdict"), F.round(F.lit(TOKENS_IN * PRICE_IN + TOKENS_OUT * PRICE_OUT) * F.col("n"), 6).alias("cost"))


@_query("with p as (select event_type, value >= 25 and value <= 235 as valid, value from events) select event_type, count(*) as n, count(*) filter (valid) as detected, round(count(*) filter (valid) / count(*), 6) as rate, round(coalesce(avg(value) filter (valid), 0), 4) as mean_conf, round(coalesce(max(value) filter (valid), 0), 4) as best_conf, round(coalesce(min(value) filter (valid), 0), 4) as least_conf from p group by 1")
def detection_stats(s, d):
    p = table(s, d, "events").select("event_type", F.col("value").between(25, 235).alias("valid"), "value")
    ok = F.when(F.col("valid"), F.col("value"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("detected"), F.round(F.count_if("valid") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 4).alias("mean_conf"), F.round(F.coalesce(F.max(ok), F.lit(0.0)), 4).alias("best_conf"), F.round(F.coalesce(F.min(ok), F.lit(0.0)), 4).alias("least_conf"))


# ---- routing, boosts, negatives, geometry ----


@_query(_TWO.replace("r.label in (0, 1, 2)", "r.label in (r.query_label, (r.query_label + 1) % 10)"))
def tie_break_boost(s, d):
    predicted = F.array(F.col("query_label"), (F.col("query_label") + 1) % 10)
    best = _rated(s, d, lambda near: R.rerank(near, [F.array_contains(predicted, F.col("label"))], 5))
    return best.select("query_id", "vec_id", "dist", "score", F.col("rank").cast("int").alias("place"))


_ROUND = """m{n} as (select query_id, coalesce(max(score) filter (r = 1) - max(score) filter (r = 2), 1.0) as margin from r{n} group by 1),
s{n} as (select r.* exclude (score, r), round(score + case when round(m.margin, 6) < 0.05 and {boost} then 0.10 else 0.0 end, 6) as score from r{n} r join m{n} m using (query_id)),
r{next} as (select *, row_number() over (partition by query_id order by score desc, dist, vec_id) as r from s{n})"""


@_query(f"""with {_near_sql(CANDIDATES)}, r1 as (select *, round(sim, 6) as score, row_number() over (partition by query_id order by sim desc, dist, vec_id) as r from near),
{_ROUND.format(n=1, next=2, boost="r.label in (r.query_label, (r.query_label + 1) % 10)")}, {_ROUND.format(n=2, next=3, boost="r.vec_id % 7 = r.query_id % 7")}
select query_id, vec_id, dist, score, r::int as place from r3 where r <= 5""")
def title_boost(s, d):
    predicted = F.array(F.col("query_label"), (F.col("query_label") + 1) % 10)
    by_title = F.col("vec_id") % 7 == F.col("query_id") % 7  # stands for the catalog rows of the title that was read
    best = _rated(s, d, lambda near: R.rerank(near, [F.array_contains(predicted, F.col("label")), by_title], 5))
    return best.select("query_id", "vec_id", "dist", "score", F.col("rank").cast("int").alias("place"))


@_query(f"with {_near_sql(3)} select query_id, rank, coalesce(p_name, '?') as name, upper(coalesce(p_brand, '?')) as \"set\", coalesce(case when p_size % 5 > 0 then p_type end, '?') as type_line from near left join part on p_partkey = vec_id + 1")
def display_rows(s, d):
    part = table(s, d, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("set"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("type_line"))
    near = _near(s, d, 3).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))
    return R.displayed(near, part, "vec_id", ["name", "set", "type_line"], upper=["set"]).select("query_id", "rank", "name", "set", "type_line")


_SIDE = """{n} as (select query_id, min(dist) as d1, max(dist) filter (rank = 2) as d2 from (select q.vec_id as query_id, {dist} as dist,
  row_number() over (partition by q.vec_id order by {dist}, c.vec_id) as rank from {n}_h q join {n}_h c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0) where rank <= 2 group by 1)"""
_DUAL = f"""with sides as (select vec_id, embedding as m, list_reverse(embedding) as w, list_sort(embedding[2:64])[32] as m_med, list_sort(list_reverse(embedding)[2:64])[32] as w_med from embeddings),
m_h as (select vec_id, {_bits_sql("m", "m_med")} as bits from sides), w_h as (select vec_id, {_bits_sql("w", "w_med")} as bits from sides),
{_SIDE.format(n="m", dist=DIST)}, {_SIDE.format(n="w", dist=DIST)},
b as (select query_id, case when query_id % 3 = 0 then 'modern' when query_id % 3 = 1 then 'fullart' else 'special' end as frame, (query_id % 100) < 70 as unsure, m.d1 as m1, m.d2 as m2, w.d1 as w1, w.d2 as w2 from m join w using (query_id)),
t as (select *, case when unsure then m1 <= w1 else frame = 'modern' end as tm from b),
f as (select *, case when tm then m1 else w1 end as win, coalesce(case when tm then m2 - m1 else w2 - w1 end, 0) as gap from t)
select query_id, concat(case when not unsure then 'single' when tm then 'parallel_modern' else 'parallel_whole' end, case when win <= 4 and gap >= 8 then '+fast_hash' else '' end) as route,
  case when unsure then case when tm then 'modern' else 'fullart' end else frame end as effective_frame, win as winning_dist, case when unsure then case when tm then w1 else m1 end end as losing_dist from f"""


@_query(_DUAL)
def dual_routing(s, d):
    sides = []
    for block in (F.col("embedding"), F.reverse("embedding")):
        rows = table(s, d, "embeddings").select("vec_id", _hashes(block).alias("hash"))
        frame = F.when(F.col("vec_id") % 3 == 0, "modern").when(F.col("vec_id") % 3 == 1, "fullart").otherwise("special")
        asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"), frame.alias("frame"), ((F.col("vec_id") % 100) / 100).alias("conf"))
        sides.append(R.knn(asked, rows, 2, keep=("frame", "conf")))
    return R.dual_route(*sides)


@_query("with n as (select q.label, arg_min(c.label, round(-(" + COS + "), 6) * 1e9 + c.vec_id / 1e6) as guess from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by q.vec_id, q.label) select label, guess, count(*) as n, round(count(*) / sum(count(*)) over (partition by label), 6) as share from n group by 1, 2")
def per_class_accuracy(s, d):
    near = R.knn(_asked(s, d), _hashed(s, d), 1, "cosine", keep=("label", "query_label"))
    return E.confusion(near.select(F.col("query_label").alias("label"), F.col("label").alias("guess")), "label", "guess")


def _draw_sql(anchors: str, own: str, pool: str, by: str, key: str, least: int) -> str:
    mix = lambda k, seed: f"((({k})::bigint * 48271 + {seed} * 16807) % 2147483647)"
    return f"""with g as (select {by} as name, count(*) as n, row_number() over (order by {by}) - 1 as label from {pool} where {by} is not null group by 1 having count(*) >= {least}),
m as (select count(*) as groups from g), p as (select {by} as name, {key} as drawn, row_number() over (partition by {by} order by {mix(key, 42)}, {key}) as place from {pool}),
a as (select t.anchor, o.label as own, groups, groups - (o.label is not null)::int as others from (select {anchors}) t left join g o on o.name = {own} cross join m),
c as (select anchor, case when own is null then {mix("anchor", 7)} % nullif(others, 0) else (own + 1 + {mix("anchor", 7)} % nullif(others, 0)) % groups end as label from a),
r as (select anchor, g.name, {mix("anchor", 8)} % g.n + 1 as place from c left join g using (label))
select anchor, p.drawn from r left join p on p.name = r.name and p.place = r.place"""


@_query(_draw_sql("p_partkey as anchor, p_name from part", "t.p_name", "part", "p_name", "p_partkey", 2))
def random_negatives(s, d):
    part = table(s, d, "part").select("p_partkey", "p_name")
    return S.draws(part.select(F.col("p_partkey").alias("anchor"), "p_name"), part, "p_name", "p_partkey", "anchor", "drawn", 2).select("anchor", "drawn")


@_query(_draw_sql("doc_id as anchor from documents", "null", "documents", "source", "doc_id", 1))
def weighted_sample(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return S.draws(docs.select(F.col("doc_id").alias("anchor")), docs, "source", "doc_id", "anchor", "drawn").select("anchor", "drawn")


@_query(f"with u as (select doc_id, {SHUFFLE.format(k='doc_id')} % 100 as u from documents) select doc_id, case when u < 30 then 'easy' when u < 70 then 'medium' else 'hard' end as difficulty from u")
def difficulty_mixture(s, d):
    return table(s, d, "documents").select("doc_id", S.mixture("doc_id", [("easy", 30), ("medium", 40), ("hard", 30)]).alias("difficulty"))


@_query(f"with u as (select doc_id, {SHUFFLE.format(k='doc_id')} % 100 as u from documents) select doc_id, case when u < 50 then 'easy' else 'mixed' end as identifier, case when u < 60 then 'easy' else 'mixed' end as detector from u")
def easy_mixtures(s, d):
    return table(s, d, "documents").select("doc_id", S.mixture("doc_id", [("easy", 50), ("mixed", 50)]).alias("identifier"), S.mixture("doc_id", [("easy", 60), ("mixed", 40)]).alias("detector"))


@_query(f"select doc_id, place from (select doc_id, row_number() over (order by {SHUFFLE.format(k='doc_id')}, doc_id) as place from documents) where place <= 100")
def uniform_sample(s, d):
    return S.uniform_sample(table(s, d, "documents").select("doc_id"), "doc_id", 100)


@_query(f"select doc_id, row_number() over (order by {SHUFFLE.format(k='doc_id')}, doc_id) as place from documents")
def global_shuffle(s, d):
    return S.numbered(table(s, d, "documents").select("doc_id", F.lit(0).alias("one")), "one", "doc_id").select("doc_id", "place")


@_query(f"with r as (select source, doc_id, row_number() over (partition by source order by {SHUFFLE.format(k='doc_id')}, doc_id) as r, count(*) over (partition by source) as n from documents), t as (select *, r <= greatest(1, floor(n * 0.8)) as train from r) select doc_id, train, concat('real_', doc_id, '_r', lpad(cast(copy as varchar), 2, '0')) as name from t, unnest(range(0, case when train then 10 else 3 end)) u(copy)")
def replicated_split(s, d):
    rows = S.numbered(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id").withColumn("train", F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("size") * 0.8)))
    copies = S.replicate(rows, F.when(F.col("train"), 10).otherwise(3))
    return copies.select("doc_id", "train", F.format_string("real_%d_r%02d", "doc_id", F.col("copy") - 1).alias("name"))


@_query("select doc_id, case when toxic = 1 then null when quality = 1 then 'good' else lang end as lang from documents left join labels using (doc_id)")
def enrich_coalesce(s, d):
    fields = F.when(F.col("toxic") == 1, F.create_map(F.lit("lang"), F.lit(None).cast("string"))).when(F.col("quality") == 1, F.create_map(F.lit("lang"), F.lit("good")))
    joined = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", C.overwritten(F.col("lang"), fields, "lang").alias("lang"))


@_query("with c as (select label, count(*) as n from embeddings group by 1) select label, n, round(1.0 / greatest(1, n), 8)::double as weight, (min(n) over ())::bigint as smallest, count(*) over () as classes from c")
def class_weights(s, d):
    counts = S.dictionary(table(s, d, "embeddings").select(F.col("label").alias("class")), "class")
    totals = counts.agg(F.min("n").alias("smallest"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(totals)).select(F.col("class").alias("label"), "n", F.col("weight").cast("double").alias("weight"), "smallest", "classes")


@_query(f"select event_type, event_id, row_number() over (partition by event_type order by {SHUFFLE.format(k='event_id')}, event_id) as place, count(*) over (partition by event_type) as size from events")
def latency_lists(s, d):
    return S.numbered(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id")


@_query("with c as (select event_type, cast(user_id % 4 as varchar) as k, count(*) as n from events group by 1, 2) select event_type, concat('{', string_agg(concat('\"', k, '\":', n), ',' order by k), '}') as counts from c group by 1")
def route_maps(s, d):
    return E.histogram_map(table(s, d, "events").select("event_type", (F.col("user_id") % 4).alias("route")), ["event_type"], "route")


@_query("""with p as (select vec_id, list_transform(range(4), lambda i: [embedding[2 * i + 1]::double, embedding[2 * i + 2]::double]) as p from embeddings),
s as (select vec_id, p, list_transform(p, lambda x: x[1] + x[2]) as a, list_transform(p, lambda x: x[2] - x[1]) as b from p),
o as (select vec_id, p[list_position(a, list_min(a))] as tl, p[list_position(b, list_min(b))] as tr, p[list_position(a, list_max(a))] as br, p[list_position(b, list_max(b))] as bl from s)
select vec_id, tl[1] as x1, tl[2] as y1, tr[1] as x2, tr[2] as y2, br[1] as x3, br[2] as y3, bl[1] as x4, bl[2] as y4 from o""")
def corner_order(s, d):
    e = F.col("embedding")
    points = F.array(*(F.array(F.get(e, F.lit(2 * i)).cast("double"), F.get(e, F.lit(2 * i + 1)).cast("double")) for i in range(4)))
    o = table(s, d, "embeddings").select("vec_id", G.ordered_corners(points).alias("c"))
    return o.select("vec_id", *(F.col("c")[i][j].alias(f"{'xy'[j]}{i + 1}") for i in range(4) for j in range(2)))


@_query("""with p as (select vec_id, 0.4 + 0.3 * abs(embedding[1]::double) as s, radians(60 * embedding[2]::double) as a, 512 + 100 * embedding[3]::double as x, 512 + 100 * embedding[4]::double as y from embeddings),
c as (select *, unnest([{'i': 1, 'dx': -244.0, 'dy': -340.0}, {'i': 2, 'dx': 244.0, 'dy': -340.0}, {'i': 3, 'dx': 244.0, 'dy': 340.0}, {'i': 4, 'dx': -244.0, 'dy': 340.0}]) as k from p)
select vec_id, k.i as corner, round((x + s * (k.dx::double * cos(a) - k.dy::double * sin(a))) / 1024, 6) as cx, round((y + s * (k.dx::double * sin(a) + k.dy::double * cos(a))) / 1024, 6) as cy from c""")
def affine_corners(s, d):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    placed = G.placed_corners(0.4 + 0.3 * F.abs(v(0)), 60 * v(1), 512 + 100 * v(2), 512 + 100 * v(3), 1024)
    rows = table(s, d, "embeddings").select("vec_id", F.posexplode(placed).alias("i", "c"))
    return rows.select("vec_id", (F.col("i") + 1).alias("corner"), F.round(F.col("c")[0], 6).alias("cx"), F.round(F.col("c")[1], 6).alias("cy"))


@_query("""with v as (select vec_id, list_transform(embedding, lambda x: 128 + 200 * x::double) as v from embeddings), m as (select vec_id, v, list_sum(v) / len(v) as mean, list_sum(list_transform(v, lambda x: x * x)) / len(v) as sq from v)
select vec_id, coalesce(round(sqrt(greatest(sq - mean * mean, 0)), 6) >= 25 and round(mean, 6) between 20 and 235, false) as valid from m""")
def validity_filter(s, d):
    pixels = F.transform("embedding", lambda x: 128 + 200 * x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", G.valid_region(pixels).alias("valid"))


@_query("select p_partkey, least(480 + p_size, 600 + p_partkey % 200) >= 200 and abs((480 + p_size) / (600 + p_partkey % 200) - 488 / 680) < 0.02 and greatest(480 + p_size, 600 + p_partkey % 200) <= 1500 as clean from part")
def clean_bypass(s, d):
    part = table(s, d, "part").select("p_partkey", (480 + F.col("p_size")).alias("w"), (600 + F.col("p_partkey") % 200).alias("h"))
    return part.select("p_partkey", G.clean_card(F.col("w"), F.col("h")).alias("clean"))


# ---- rasters, candidates, classes: a text's bytes play an image, a byte a pixel ----

BYTES = """d as materialized (select doc_id, row_number() over () as r, hex(encode(text)) as h from documents),
s as (select r, ceil(sqrt((strlen(h) // 2)::double))::bigint as w, ceil((strlen(h) // 2) / ceil(sqrt((strlen(h) // 2)::double)))::bigint as hh, regexp_extract_all(h, '..') as p from d where strlen(h) > 0),
b as materialized (select r, w, hh, (i - 1) // w as y, (i - 1) % w as x, ('0x' || v)::int as v from (select r, w, hh, unnest(p) as v, generate_subscripts(p, 1) as i from s))"""


def _rasters(s: SparkSession, d: str) -> DataFrame:
    data = F.col("text").cast("binary")
    return table(s, d, "documents").select("doc_id", data.alias("data"), I.square(data).alias("width"))


def _phash_sql() -> str:
    part = lambda p, n: f"least(({p} + 1) * {n} / {I.REDUCED}::double, {{0}} + 1) - greatest({p} * {n} / {I.REDUCED}::double, {{0}})"
    cells = lambda x, n: f"unnest(range(({x} * {I.REDUCED}) // {n}, (({x} + 1) * {I.REDUCED} - 1) // {n} + 1))"
    wave = lambda k, x: f"(case when {k} = 0 then sqrt(1 / {I.REDUCED}::double) else sqrt(2 / {I.REDUCED}::double) * cos(pi() * (2 * {x} + 1) * {k} / {2 * I.REDUCED}::double) end)"
    return f"""with {BYTES},
across as (select r, w, hh, y, c, sum(v * ({part("c", "w").format("x")})) as v from (select *, {cells("x", "w")} as c from b) group by all),
cells as (select r, e, c, sum(v * ({part("e", "hh").format("y")})) * {I.REDUCED}::double * {I.REDUCED} / (any_value(w) * any_value(hh)) as v from (select *, {cells("y", "hh")} as e from across) group by r, e, c),
half as (select r, e, k, sum(v * {wave("k", "c")}) as v from cells, range({I.BLOCK}) t(k) group by r, e, k),
coefs as (select r, j, k, round(sum(v * {wave("j", "e")}), 4) + 0.0 as v from half, range({I.BLOCK}) t(j) group by r, j, k),
blocks as (select r, list(v order by j, k) as l from coefs group by r),
bits as (select r, list_transform(l, lambda x: (x > m)::hugeint) as bits from (select r, l, list_sort(l[2:64])[32] as m from blocks)),
p as (select r, list_reduce(bits, lambda a, b: a * 2 + b) as u from bits)
select doc_id, {FOLD} as hash from d left join p using (r)"""


@_query(_phash_sql())
def phash_dct(s, d):
    return I.low_frequencies(_rasters(s, d), "data", "width").select("doc_id", V.median_hash(F.col("block")).alias("hash"))


_REGIONS = {"title": lambda h, w: I.region(h, w, I.TITLE), "type": lambda h, w: I.region(h, w, I.TYPE_LINE), "whole": I.inset}


def _regions_sql(names: list[str], select: str) -> str:
    inside, columns = {}, []
    for n, shares in (("title", I.TITLE), ("type", I.TYPE_LINE)):
        edges = [f"floor({side} * {share}::double)" for side, share in zip(("hh", "hh", "w", "w"), shares, strict=True)]
        inside[n] = "y >= {} and y < {} and x >= {} and x < {}".format(*edges)
    inside["whole"] = "y >= floor(hh * 0.03::double) and y < hh - floor(hh * 0.03::double) and x >= floor(w * 0.03::double) and x < w - floor(w * 0.03::double)"
    for n in names:
        f = f"filter ({inside[n]})"
        columns.append(f"count(*) {f} as {n}_n, round(sum(v) {f} / (count(*) {f})::double, 6) as {n}_mean, case when count(*) {f} > 0 then round(sqrt(greatest(0, sum(v * v) {f} / (count(*) {f})::double - pow(sum(v) {f} / (count(*) {f})::double, 2))), 6) end as {n}_std")
    # what the last row lacks is 0
    full = "f as (select r, w, hh, y, x, v from b union all select r, w, hh, hh - 1, x, 0 from (select r, w, hh, unnest(range(max(x) + 1, w)) as x from b where y = hh - 1 group by r, w, hh))"
    return f"with {BYTES}, {full}, g as (select r, {', '.join(columns)} from f group by r) {select}"


@_query(_regions_sql(["title", "type", "whole"], "select doc_id, title_n, title_mean, title_std, type_n, type_mean, type_std, whole_n, whole_mean, whole_std from d left join g using (r)"))
def region_stats(s, d):
    found = I.region_stats(_rasters(s, d), "data", "width", _REGIONS)
    return found.select("doc_id", *(F.round(c, 6).alias(c) if not c.endswith("_n") else c for c in found.columns if c != "doc_id"))


@_query(_regions_sql(["title", "type"], f"select doc_id, case when title_std < {I.PLAIN_STD} and type_std < {I.PLAIN_STD} then 'modern' when title_std > {I.PICTURE_STD} and type_std > {I.PICTURE_STD} then 'fullart' end as from_image, coalesce(from_image, 'modern') as frame_class from d left join g using (r)"))
def frame_from_image(s, d):
    found = I.region_stats(_rasters(s, d), "data", "width", {n: _REGIONS[n] for n in ("title", "type")})
    found = found.withColumn("from_image", I.frame_of(F.round("title_std", 6), F.round("type_std", 6)))
    none = {c: F.lit(None).cast(t) for c, t in (("layout", "string"), ("full_art", "boolean"), ("border_color", "string"), ("frame_effects", "array<string>"))}
    return found.withColumns(none).select("doc_id", "from_image", C.frame_class(F.col("from_image")).alias("frame_class"))


@_query("""with q as (select vec_id, embedding as e, 1 + embedding[1]::double as x1, 1 + embedding[2]::double as y1, 6 + embedding[3]::double as x2, 1 + embedding[4]::double as y2,
  6 + embedding[5]::double as x3, 6 + embedding[6]::double as y3, 1 + embedding[7]::double as x4, 6 + embedding[8]::double as y4 from embeddings),
c as (select *, x1 - x2 + x3 - x4 as sx, y1 - y2 + y3 - y4 as sy, x2 - x3 as dx1, x4 - x3 as dx2, y2 - y3 as dy1, y4 - y3 as dy2 from q),
g as (select *, (sx * dy2 - dx2 * sy) / (dx1 * dy2 - dx2 * dy1) as g, (dx1 * sy - sx * dy1) / (dx1 * dy2 - dx2 * dy1) as h from c),
t as (select *, i % 5 / 4.0::double as u, i // 5 / 4.0::double as v from g, range(25) t(i)),
p as (select vec_id, e, i, ((x2 - x1 + g * x2) * u + (x4 - x1 + h * x4) * v + x1) / (g * u + h * v + 1) as x, ((y2 - y1 + g * y2) * u + (y4 - y1 + h * y4) * v + y1) / (g * u + h * v + 1) as y from t),
f as (select *, floor(x)::int as j, floor(y)::int as k from p),
s as (select vec_id, i, list_sum(list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda o: case when k + o[1] between 0 and 7 and j + o[2] between 0 and 7 then e[8 * (k + o[1]) + j + o[2] + 1]::double else 0 end
  * (case when o[1] = 1 then y - k else 1 - (y - k) end) * (case when o[2] = 1 then x - j else 1 - (x - j) end))) as value from f)
select vec_id, i::int as place, round(value, 6) + 0.0 as value from s""")
def perspective_rectify(s, d):
    at = lambda i, base: base + F.get("embedding", F.lit(i)).cast("double")
    rows = table(s, d, "embeddings", ["vec_id", "embedding"]).withColumn("corners", F.array(*(at(i, b) for i, b in enumerate((1, 1, 6, 1, 6, 6, 1, 6)))))
    found = I.rectified(rows, "embedding", 8, "corners", (5, 5))
    return found.select("vec_id", F.posexplode("rectified").alias("place", "value")).withColumn("value", F.round("value", 6) + 0.0)


@_query(f"""with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as ws from benchmark),
runs as (select item_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as candidate from (select item_id, ws, i, unnest(range(1, least({T.WORDS}, len(ws) - i + 1) + 1)) as n from (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from w))),
firsts as (select item_id, candidate, min((i, -n)) as first from runs group by all)
select item_id, (row_number() over (partition by item_id order by first))::int as place, candidate from firsts""")
def title_candidates(s, d):
    return T.candidates(table(s, d, "benchmark", ["item_id", "text"]), "item_id", "text")


@_query("""with e as (select vec_id, label, embedding, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
m as (select label, list(m order by i) as w from (select label, i, avg(x) as m from e where label is not null group by 1, 2) group by 1),
s as (select vec_id, m.label, 20 * (list_dot_product(embedding::double[], w) - list_dot_product(w, w) / 2) as score from embeddings, m),
r as (select vec_id, label, score, row_number() over (partition by vec_id order by score desc, label) as k, max(score) over (partition by vec_id) as top from s)
select vec_id, max(label) filter (k = 1) as class, round(1 / sum(exp(score - top)), 6) as confidence from r group by vec_id""")
def class_prediction(s, d):
    rows = table(s, d, "embeddings", ["vec_id", "label", "embedding"])
    found = M.predicted(rows.select("vec_id", "embedding"), "embedding", *M.class_means(rows, "label", "embedding"), scale=20.0)
    return found.select("vec_id", "class", F.round("confidence", 6).alias("confidence"))



# ---- joins by time ----


@_query("""select l.event_id, l.user_id, r.event_id as as_of_event_id, r.ts as as_of_ts, r.value as as_of_value
from (select * from events where event_type <> 'view') l asof left join (select * from events where event_type = 'view') r on l.user_id = r.user_id and l.ts > r.ts""")
def as_of_view(s, d):
    e = table(s, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    found = W.as_of(e.filter("event_type <> 'view'"), e.filter("event_type = 'view'"), "user_id", "ts", "event_id", ["value"])
    return found.select("event_id", "user_id", "as_of_event_id", "as_of_ts", "as_of_value")


@_query("""select event_id, event_type, count(*) over w as n, round(avg(value) over w, 6) as mean, max(value) over w as most
from events window w as (partition by event_type order by ts range between interval 1 hour preceding and current row)""")
def sliding_means(s, d):
    e = table(s, d, "events", ["event_id", "ts", "event_type", "value"])
    found = W.sliding(e, "event_type", "ts", 3600, n=F.count(F.lit(1)), mean=F.avg("value"), most=F.max("value"))
    return found.select("event_id", "event_type", "n", F.round("mean", 6).alias("mean"), "most")


@_query("""with s as (select l_partkey, l_orderkey, l_linenumber, l_returnflag = 'R' as back, o_orderdate as a, l_shipdate as b from lineitem join orders on l_orderkey = o_orderkey)
select x.l_partkey as part, x.l_orderkey as order_a, x.l_linenumber as line_a, y.l_orderkey as order_b, y.l_linenumber as line_b
from s x join s y on x.l_partkey = y.l_partkey and x.back and not y.back and x.a <= y.b and y.a <= x.b where x.a <= x.b and y.a <= y.b""")
def overlapping_spans(s, d):
    lines = table(s, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate"])
    spans = lines.join(table(s, d, "orders", ["o_orderkey", "o_orderdate"]), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = spans.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "l_returnflag", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("from"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("to"))
    side = lambda df, t: df.select("part", *(F.col(c).alias(f"{c}_{t}") for c in ("order", "line", "from", "to")))
    a, b = side(spans.filter("l_returnflag = 'R'"), "a"), side(spans.filter("l_returnflag <> 'R'"), "b")
    return W.overlapping(a, b, "part", F.col("from_a"), F.col("to_a"), F.col("from_b"), F.col("to_b")).select("part", "order_a", "line_a", "order_b", "line_b")


@_query("""with g as (select *, coalesce(ts - lag(ts) over w > interval 30 minutes, true)::int as new from events window w as (partition by user_id order by ts)),
n as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as first, max(ts) as last, count(*) as n, round(sum(value), 4) as total from n group by user_id, k""")
def user_sessions(s, d):
    return X.sessions(table(s, d, "events", ["user_id", "ts", "value"]), "user_id", "ts", "value").withColumn("total", F.round("total", 4))



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
