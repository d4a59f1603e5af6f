"""Core queries against DuckDB, kernels against plain Python, boundaries."""

import math
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as G
from lodestar.functions import vectors as V
from lodestar.operators import catalog as C
from lodestar.operators import retrieval as R
from lodestar.operators import sampling as S
from lodestar.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = core.queries()[name](spark, SF), con.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    theirs = sorted(repr([plain(r[sql.columns.index(c)]) for c in sorted(sql.columns)]) for r in sql.fetchall())
    assert ours == theirs


def test_hamming_and_packing(spark):
    df = spark.createDataFrame([([True] * 64, -1), ([False] * 63 + [True], 1), ([True] + [False] * 63, -(2**63))], "flags array<boolean>, bits long")
    assert all(r.got == r.bits for r in df.select("bits", V.pack_bits(F.col("flags")).alias("got")).collect())
    row = spark.range(1).select(V.hamming(F.lit(-1), F.lit(0)).alias("all"), V.hamming(F.lit(5), F.lit(5)).alias("none")).first()
    assert (row["all"], row["none"]) == (64, 0)


def test_zero_vector_is_clamped(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>").select(V.unit(F.col("a")).alias("z"), V.unit(F.col("b")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert list(row["z"]) == [0, 0] and [round(x, 6) for x in row["u"]] == [0.6, 0.8] and row["c"] == 0


def test_frame_rules_order_and_nulls(spark):
    rows = [("saga", True, "black", [], "special"), ("normal", True, None, None, "fullart"), ("normal", None, "borderless", None, "fullart"), ("normal", False, "black", ["extendedart"], "fullart"), ("emblem", None, None, ["etched"], "modern"), (None, None, None, None, "modern")]
    df = spark.createDataFrame(rows, "layout string, full_art boolean, border_color string, frame_effects array<string>, want string")
    assert all(r.want == r.got for r in df.select("want", C.frame_class().alias("got")).collect())


def test_margin_default_for_single_row(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.5)], "q int, r int, v double")
    got = {r.q: round(r.m, 6) for r in R.margins(df, "v", "q", "r", "m", 1.0).collect()}
    assert got == {1: 0.1, 2: 1.0}


def test_quota_and_split_cover_all(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    assert S.quota_sample(df, ["g"], "id", 400).count() == 1000
    split = S.stratified_split(df, "g", "id")
    assert split.count() == 1000 and {r.g: r.n for r in split.filter("split = 'train'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 283, 1: 283, 2: 283}


def test_refresh_twice_is_once(spark):
    have, all_ = spark.createDataFrame([(1, 7), (9, 9)], "id int, v int"), spark.createDataFrame([(1,), (2,)], "id int")
    once = C.refresh(have, all_, "id", F.lit(0), "v").drop("origin")
    assert sorted(map(tuple, C.refresh(once, all_, "id", F.lit(5), "v").drop("origin").collect())) == sorted(map(tuple, once.collect())) == [(1, 7), (2, 0)]


def test_draws_leave_their_own_group(spark):
    pool = spark.createDataFrame([(i, "hot" if i < 90 else "b" if i < 95 else "c") for i in range(100)] + [(100, None)], "id long, name string")
    got = S.draws(pool.select(F.col("id").alias("anchor"), "name"), pool, "name", "id", "anchor", "drawn").collect()
    name = {r.id: r.name for r in pool.select("id", "name").collect()}
    assert len(got) == 101 and all(r.drawn is not None and name[r.drawn] != r["name"] for r in got)
    alone = S.draws(pool.filter("name = 'b'").select(F.col("id").alias("anchor"), "name"), pool.filter("name = 'b'"), "name", "id", "anchor", "drawn").collect()
    assert len(alone) == 5 and all(r.drawn is None for r in alone)


def test_shuffled_takes_any_id(spark):
    df = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (0,), (5,)], "id long")
    assert [r.h for r in df.select(S.shuffled("id").alias("h")).collect()] == [(i * 48271 + 42 * 16807) % 2147483647 for i in (2**63 - 1, -(2**63), 0, 5)]


def test_numbered_counts_each_group(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "g") for i in range(40)], "id long, g string")
    rows = S.numbered(df, "g", "id").collect()
    assert sorted(r.place for r in rows if r.g) == list(range(1, 31)) and sorted(r.place for r in rows if not r.g) == list(range(1, 11))
    assert {(r.g, r["size"]) for r in rows} == {("g", 30), (None, 10)} and S.numbered(df.filter("id < 0"), "g", "id").count() == 0


@pytest.mark.parametrize("rows", [1, 3, 100_000])
def test_numbers_don_t_depend_on_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "ROWS_A_BUCKET", rows)
    rng = random.Random(rows)
    words = [rng.choice(["a", "ab", "b", "\u00e9", "z" * 50, "", "https://x/1", "https://x/2", None]) for _ in range(60)]
    keys = rng.sample([*range(50), *(10**12 + i for i in range(20))], 60)  # clustered
    df = spark.createDataFrame(list(zip(words, keys, strict=True)), "w string, k long")
    ordered = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    assert {(r.w, r.n, r.label) for r in S.dictionary(df, "w").collect()} == {(w, words.count(w), i) for i, w in enumerate(ordered)}
    assert S.dictionary(df.filter("k < 0"), "w").count() == 0
    want = set()
    for w in set(words):
        mine = sorted(k for v, k in zip(words, keys, strict=True) if v == w)
        want |= {(w, k, mine[(i + 1) % len(mine)]) for i, k in enumerate(mine)}
    for least in (1, 5, 64):
        assert {(r.w, r.k, r.next) for r in S.next_of_group(df, "w", "k", "next", least).collect()} == want
    places = S.numbered(df, "w", "k").collect()
    for w in set(words):
        mine = sorted((r.place, (r.k % 2147483647 * 48271 + 42 * 16807) % 2147483647) for r in places if r.w == w)
        assert [p for p, _ in mine] == [*range(1, len(mine) + 1)] and [h for _, h in mine] == sorted(h for _, h in mine)


def test_dual_route(spark):
    schema = "query_id int, frame string, conf double, dist int, rank int"
    modern = spark.createDataFrame([(1, "fullart", 0.5, 3, 1), (1, "fullart", 0.5, 20, 2), (2, "fullart", 0.9, 1, 1), (3, "special", 0.1, 9, 1), (4, "modern", 0.7, 2, 1)], schema)
    whole = spark.createDataFrame([(1, "fullart", 0.5, 3, 1), (2, "fullart", 0.9, 8, 1), (3, "special", 0.1, 7, 1), (4, "modern", 0.7, 1, 1)], schema)
    got = {r.query_id: tuple(r)[1:] for r in R.dual_route(modern, whole).collect()}
    assert got == {1: ("parallel_modern+fast_hash", "modern", 3, 3), 2: ("single", "fullart", 8, None), 3: ("parallel_whole", "fullart", 7, 9), 4: ("single", "modern", 2, None)}


def _lists(rows, k):
    """Each query's k nearest rows (id, bits) by brute force, ties to the smaller id."""
    bits = {i: [h & (2**64 - 1) for h in hashes] for i, hashes in rows if hashes is not None and i is not None}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
    return {q: sorted((apart(q, i), i) for i in bits if i != q)[:k] for q in bits if q % 20 == 0}


@pytest.mark.parametrize("k,same,hashes", [(40, 150, 2), (60, 300, 1), (33, 0, 4), (500, 0, 2)])
def test_long_lists_equal_brute_force(spark, monkeypatch, k, same, hashes):
    rng = random.Random(k)
    some = [[rng.getrandbits(64) - 2**63 for _ in range(hashes)] for _ in range(12)]
    rows = [(i, some[0] if i < same else [h ^ (1 << rng.randrange(63)) for h in rng.choice(some)]) for i in range(400)] + [(1001, None), (None, some[1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, hash array<long>").repartition(6)
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"))
    want = sorted((q, i, d, n) for q, found in _lists(rows, k).items() for n, (d, i) in enumerate(found, 1))
    for changed in ({}, {"QUERIES": 14, "STRIP": 3, "CHUNK": 7}):
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setattr(R, name, value)
            got = sorted((r.query_id, r.vec_id, r.dist, r["rank"]) for r in R.knn(asked, df, k).collect())
            assert got == want and len(want) == 20 * min(k, 399)
    assert R.knn(asked.filter("query_id < 0"), df, k).count() == R.knn(asked, df.filter("vec_id < 0"), k).count() == 0


def test_long_lists_hold_little_and_report_little(spark, monkeypatch):
    """Parts of the rows report only what the whole lists hold, and no vectors of all pairs are held at once."""
    n, k, parts, steps = 4_000, 500, 8, []
    rng = np.random.default_rng(1)
    vectors, hashes = rng.normal(size=(n, 64)).tolist(), rng.integers(-(2**63), 2**63 - 1, (n, 2)).tolist()
    rows = spark.createDataFrame(list(zip(range(n), hashes, vectors, strict=True)), "vec_id long, hash array<long>, embedding array<float>")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"), F.col("embedding").alias("query_embedding"))
    kind, own = type(rows), type(rows).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, *a, **b: (steps.append((f, df)), own(df, f, *a, **b))[1])
    R.knn(asked, rows, k, sims=True)
    report, df = steps[-1]
    batches = df.toArrow().combine_chunks().to_batches(max_chunksize=n // parts)
    list(report(iter(batches[:1])))
    tracemalloc.start()
    reported = sum(out.num_rows for batch in batches for out in report(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(batches) == parts and 200 * k <= reported < 200 * k * 1.5 and peak < 40e6


@pytest.mark.parametrize("name,k", [("tie_break_boost", 5), ("two_stage_retrieval", 5), ("title_boost", 5), ("cosine_rerank", 10)])
def test_blocks_keep_results_only(spark, monkeypatch, name, k):
    query = core.queries()[name]
    at_once = sorted(map(tuple, (df := query(spark, SF)).collect()))
    kept, own = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda df, *a, **b: (kept.append(out := own(df, *a, **b)), out)[1])
    monkeypatch.setattr(R, "QUERIES", 20)
    assert sorted(map(tuple, query(spark, SF).collect())) == at_once and len(at_once) == 25 * k
    sizes = [x.count() for x in kept if "query_id" in x.columns]
    assert len(sizes) > 1 and sum(sizes) == 25 * k


def test_corners_and_regions(spark):
    df = spark.createDataFrame([([[9.0, 8.0], [0.0, 1.0], [8.0, 0.0], [1.0, 9.0]], [0.0, 255.0] * 8, [7.0] * 8, [])], "p array<array<double>>, good array<double>, flat array<double>, none array<double>")
    row = df.select(G.ordered_corners(F.col("p")).alias("c"), *(G.valid_region(F.col(n)).alias(n) for n in ("good", "flat", "none")), G.clean_card(F.lit(488), F.lit(680)).alias("clean"), G.clean_card(F.lit(4880), F.lit(6800)).alias("photo")).first()
    assert [list(x) for x in row.c] == [[0, 1], [8, 0], [9, 8], [1, 9]]
    assert (row.good, row.flat, row.none, row.clean, row.photo) == (True, False, False, True, False)


def test_entry_without_llm():
    import __spark_entry__ as e

    assert "two_stage_retrieval" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
