"""Operators against brute force, round trips and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, langid, licenses, mixing, quality, queries, sharding, simhash, suffix, token_counts, topk
from lodestar.llm.queries import tokenizer_path

BPE = tokenizer_path("word_bpe_49k.json")
UGLY = [None, "", " ", "a" * 3000, "İstanbul ΑΣΣ I'LL don't ½²", "x<|endoftext|>y", "\x1c\x85 é 한국어 😀", "the mit\n" * 40, "same text", "same text"]


def docs(spark, texts, **more):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("lang", F.lit("en"))


def test_bpe_equals_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = bpe.decode(bpe.encode(docs(spark, UGLY), BPE), BPE).collect()
    assert len(got) == len(UGLY)
    for r in got:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)


def test_one_tree_equals_many():
    c = bpe.Codec(BPE)
    for w in ("hello", "internationalisation", "ab" * 100):
        raw = w.encode()
        s = c.bytes[np.frombuffer(raw, np.uint8)]
        s[-1] = c.last[raw[-1]]
        assert bpe.merge_all(s.tolist(), c.pairs) == np.frombuffer(c.encode([w])[0], "<u4").tolist()


def test_token_counts_across_blocks(spark, monkeypatch):
    import tiktoken  # noqa: F401
    from public_tokenizers import PATTERN

    monkeypatch.setattr(token_counts, "BLOCK", 7)
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    texts = [t for t in UGLY if t is None or len(t) < 500]
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_documents(docs(spark, texts).filter("doc_id is not null"), ranks, PATTERN, 50256).collect())
    encode = token_counts.encoder(ranks, PATTERN)
    assert got == [(i, len(encode(t or ""))) for i, t in enumerate(texts) if i != 3]


def test_suffix_array_by_grouping():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(40))] + [0]
        assert suffix.group_suffixes(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        yield len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 200_000)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    texts = spark.range(0, 1000, 1, 1).selectExpr("repeat(cast(id as string), 2000) as text")
    found = [r.n for r in suffix.written(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert max(found) < 400_000 < sum(found)
    assert spark.conf.get(key) == before
    # nor do the cut texts pass through Python beside the last join
    passage = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(0, f"AB{passage}éX"), (1, f"CD{passage}èY"), (2, "other")]  # é and è share a byte, which goes with the passage
    cut = suffix.deduped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "MapInArrow" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.text for r in cut.collect()} == {0: "ABX", 1: "CDY", 2: "other"}


@pytest.mark.parametrize(("hot", "segment"), [(1000, 1 << 19), (2, 300)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, segment):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    rng = random.Random(5)
    noise = lambda n, a="abcd é": "".join(rng.choice(a) for _ in range(n))
    base = [noise(900), noise(900)]
    texts = [noise(rng.randrange(200)) + rng.choice(base)[rng.randrange(300) : rng.randrange(500, 900)] + noise(rng.randrange(200)) for _ in range(25)]
    texts += [noise(rng.randrange(60)) + base[0][400:650] + noise(rng.randrange(60)) for _ in range(12)]
    texts += ["a" * 1000, "ab" * 300, "q" * 401, base[0], base[0], *UGLY]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("t1", "t2", "kept", "__kept")})
    got = {r.doc_id: tuple(r)[1:] for r in suffix.dedup(df).collect()}
    short = [*brute_repeats(texts, suffix.PASSAGE)]
    assert [got[i][:4] for i in range(len(texts))] == [*brute_repeats(texts)]
    assert [got[i][4:] for i in range(len(texts))] == [(got[i][2] or s[2], s[2] > 0) for i, s in enumerate(short)]
    cut = suffix.deduped(df)
    assert cut.columns == df.columns
    for r in cut.collect():
        n, gone, spans, _ = short[r.doc_id]
        assert (r.text is None) == (texts[r.doc_id] is None) and 0 <= n - gone - len((r.text or "").encode()) <= 2 * spans


def test_one_core_with_thousands_of_members_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 300)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("ab") for _ in range(n))
    core = noise(390)
    texts = [noise(30) + core + noise(30) for _ in range(5000)]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.dedup(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [*brute_repeats(texts)]


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(5, 80), rng.choice(["a", "b", None])) for i in range(900)] + [(900, None, "c"), (901, "", "c")]
    mixed = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(mixed) == sorted(again) and len(mixed) == len(rows)
    source = {r[0]: r[2] for r in rows}
    for s in {"a", "b", None, "c"}:
        mine = [r for r in mixed if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5 and all(r.taken <= 3 * r.size for r in mine)
    total = {source[r.doc_id]: r.target for r in mixed}
    assert abs(sum(total.values()) - sum(r.size for r in mixed)) < 1e-6


def test_flight_keeps_totals():
    rng = random.Random(2)
    p, size = [0.3] * 500, [rng.randrange(1, 99) for _ in range(500)]
    q = mixing.flight(p[:], size, rng, False)
    assert sum(1e-9 < x < 1 - 1e-9 for x in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, size) - np.dot(p, size)) < 1e-4


def test_licenses(spark):
    texts = ["Under the MIT License. x under the mit license", "under teh mit licence here", "CC-BY-NC", None, "", "nothing to see", "apache license, version 2.0"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 0, 5, "mit", 1.0)
    assert (got[1].n_base, got[1].base_labels, got[1].labels) == (0, "", "")  # three edits: one too many
    assert got[2].base_labels == "cc-by-nc" and got[6].base_labels == "apache-2"
    assert all(got[i].labels == "" and got[i].score == 0 and got[i].first_word is None for i in (3, 4, 5))


def test_license_edits_are_found(spark):
    got = licenses.scan(spark.createDataFrame([(1, "it is under the mitt licence now")], "doc_id long, text string")).first()
    assert got.n_base == 0 and got.labels == "mit" and 0.8 < got.score < 1 and (got.spans[0].start, got.spans[0].end) == (2, 6)


def test_quality(spark):
    rng = random.Random(4)
    clean = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120)) for _ in range(60)]
    texts = [*clean, " ".join(w + "###" for w in clean[0].split()), None, "", "a b c " * 40, "x\ny\nx\n"]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 65))
    assert (got[60].n_symbols, got[63].n_repeat_words, got[64].n_dup_lines, got[61].n_words) == (360, 120, 1, 0)


def test_simhash_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    texts = [None, "", "one two"]
    for b in base:
        for _ in range(12):
            c = b[:]
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    fps = [simhash.fingerprint(t, 3, 42) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i][1] for i in range(len(texts))] == root and all(got[i][0] % 2**64 == fps[i] for i in range(len(texts)))


def test_sharding_law(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(df).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and len({r.shard for r in rows}) == 16
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == [*range(sum(r.shard == s for r in rows))]


def brute_shard(key: str, n: int, weights: dict) -> int:
    """The tree told anew: a node's weight is its shards' sum; at each level the smallest draw wins."""

    def pick(level: str, of: dict) -> int:
        if len(of) == 1:
            return next(iter(of))
        u = {c: (int(hashlib.md5(f"{key}/{level}{c}".encode()).hexdigest()[:13], 16) + 1) / float(2**52 + 1) for c in of}
        return min(of, key=lambda c: (-math.log(u[c]) / w if (w := of[c]) else math.inf, c))

    weight = lambda shards: sum(weights.get(s, 1.0) for s in shards)
    groups = lambda shards, size: {g: [s for s in shards if s // size == g] for g in {s // size for s in shards}}
    regions = groups(range(n), 8)
    racks = groups(regions[pick("region", {g: weight(x) for g, x in regions.items()})], 4)
    shards = racks[pick("rack", {g: weight(x) for g, x in racks.items()})]
    return pick("shard", {s: weights.get(s, 1.0) for s in shards})


def test_sharding_equals_brute_force(spark):
    df = docs(spark, UGLY)
    df = df.unionByName(df.limit(3)).unionByName(spark.range(100, 1100).select(F.col("id").alias("doc_id"), F.lit("caf\u00e9").alias("text")), allowMissingColumns=True)
    given = df.select("doc_id", "text").collect()
    rows = sharding.shard_documents(df).collect()
    name = lambda x: "null" if x is None else str(x)
    text = lambda x: (x or "").encode()
    want = [(r.doc_id, len(text(r.text)) + 1, zlib.crc32(text(r.text)), brute_shard(name(r.doc_id), 16, {}), brute_shard(name(r.doc_id), 17, {})) for r in given]
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows))) == sorted(map(repr, want))


def test_a_weight_moves_rows_into_its_subtree_alone(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    heavy = {5: 3.0}
    both = sharding.assign(sharding.assign(df, "doc_id", 16, "old"), "doc_id", 16, "new", heavy).collect()
    assert all(r.new == brute_shard(str(r.doc_id), 16, heavy) for r in both)
    moved = [(r.old, r.new) for r in both if r.old != r.new]
    assert moved
    for old, new in moved:  # into the shard, its rack (4 to 7) or its region (0 to 7): never between others
        assert new == 5 or (new // 4 == 1 and old // 4 != 1) or (new // 8 == 0 and old // 8 != 0), (old, new)
    shares = {s: sum(r.new == s for r in both) / 4000 for s in range(16)}
    assert abs(shares[5] - 3 / 18) < 0.03 and all(abs(shares[s] - 1 / 18) < 0.02 for s in range(16) if s != 5)


def test_langid_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, model = langid.fit(d.filter("doc_id % 2 = 0"), rows=100)
    test = langid.text_scores(d.filter("doc_id % 2 = 1").select("lang", "text"), ["lang"], "text", names, model, is_page=False)
    rows = test.collect()
    assert np.mean([names[int(np.argmax(r.ll))] == r.lang for r in rows]) > 0.9


def test_topk_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 1500)
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(400, 16)))
    rows = [(i, (x / 256).tolist()) for i, x in enumerate(v)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    want = [(q, r + 1, c, int(v[q] @ v[c])) for q in range(0, 400, 20) for r, c in enumerate(sorted((c for c in range(400) if c != q), key=lambda c: (-(v[q] @ v[c]), c))[:5])]
    assert sorted(map(tuple, got)) == want


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [-1.0, 0.1]), (50, [1.0, 1.0]), (5, [1.0]), (None, [9.0, 9.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    assert sorted(tuple(r) for r in got if r.query_id == 50) == [(50, 1, 0, 98304), (50, 2, 1, 98304), (50, 3, 1, 98304)]


def test_empty_tables_and_edge_rows(spark):
    none = docs(spark, UGLY).limit(0)
    some = docs(spark, UGLY)
    for f in (lambda d: bpe.encode(d, BPE), suffix.dedup, mixing.mix_documents, licenses.scan, quality.judge, simhash.near_duplicates, sharding.shard_documents, quality.passing, simhash.one_of_each, suffix.deduped, mixing.mixed_rows):
        assert f(none).count() == 0
        f(some).collect()
    assert suffix.dedup(some).count() == sharding.shard_documents(some).count() == len(UGLY)


def test_pipeline(spark):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "/root/testdata/sf0.001")
        assert sorted(d.columns) == sorted(names) and d.count() > 0


def test_quality_fences_follow_the_group(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    text = lambda n, symbols=0: " ".join(noise(n if k % 2 else n + 1) + "#" * (k < symbols) for k in range(120))
    rows = []
    for i in range(400):  # code has a symbol in 10 to 60 of 120 words, prose in up to 3; names are longer than prose's words
        rows += [(i, text(5, i % 4), "en", "prose"), (1000 + i, text(5, 10 + i % 50), "en", "code"), (2000 + i, text(rng.choice([9, 10]), 0), "fi", "names")]
    rows += [(9001, text(5, 100), "en", "prose"), (9002, text(5, 100), "en", "code"), (9003, text(9), "en", "prose"), (9004, text(9), "fi", "names"), (9005, text(2), "fi", "names")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in got)
    assert sum(not got[i].kept for i in range(400)) + sum(not got[1000 + i].kept for i in range(400)) + sum(not got[2000 + i].kept for i in range(400)) == 0
    assert (got[9001].kept, got[9002].kept, got[9003].kept, got[9004].kept, got[9005].kept) == (False, True, False, True, False)


def test_rare_measures_have_fences_of_their_own(spark):
    rng = random.Random(9)
    text = lambda symbols: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + "#" * (k < symbols) for k in range(100))
    # one document in 20 has symbols, so quartiles of the others tell no scale; in "many" they have ten times as many
    rows = [(i + 10_000 * g, text((4 + i // 20 % 5) * (1, 10)[g] if i % 20 == 0 else 0), "en", ("few", "many")[g]) for i in range(1000) for g in (0, 1)]
    rows += [(90_000, text(60), "en", "few"), (90_001, text(60), "en", "many"), (90_002, text(1), "en", "none")]
    rows += [(30_000 + i, text(0), "en", "none") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert (got[90_000], got[90_001], got[90_002]) == (False, True, True)
    assert all(kept for i, kept in got.items() if i < 90_000 and i % 20)
    measures = spark.createDataFrame([(r[2], r[3], r[1].count("#") / 100, 0.0, 0.0, 5.0) for r in rows], "lang string, source string, symbol_rate double, dup_line_rate double, repeat_rate double, word_length double")
    once, scaled = (quality.thresholds(d).filter("source = 'many'").first() for d in (measures, measures.withColumn("symbol_rate", F.col("symbol_rate") * 3)))
    assert not once.symbol_rate_scaled and abs(scaled.symbol_rate_high / once.symbol_rate_high - 3) < 0.01
    assert once.word_length_low < 5 <= once.word_length_high < once.word_length_low * 1.01


def test_langid_without_labelled_documents(spark):
    names, model = langid.fit(spark.createDataFrame([(None, "text"), ("en", None)], "lang string, text string"))
    pages = spark.createDataFrame([(1, "http://a.de/", "<html lang=de>")], "page_id long, url string, html string")
    found = langid.identify(pages, names, model)
    assert names == [] and found.collect() == []
    assert found.dtypes == [("page_id", "bigint"), ("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string")]


def test_langid_fusion_equals_brute_force(spark):
    names = ["aa", "bb", "cc"]
    rng = np.random.default_rng(2)
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3))
    word = lambda i: "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(5))
    by_lang = {n: [] for n in names}
    for i in range(3000):
        by_lang[names[int(np.argmax(table @ langid.gram_counts(word(i))))]].append(word(i))
    pages = []
    for i in range(40):
        pages.append(("http://hot.xx/", f'<html lang="bb"><p>{" ".join(by_lang["bb"][i : i + 4])}</p></html>'))
        pages.append((f"http://h{i % 5}.yy/", f'<html lang="{names[i % 3]}"><p>{" ".join(by_lang[names[i % 3]][i : i + 3])}</p></html>'))
    pages += [("http://hot.xx/", h) for h in [None, "", '<html lang="bb"><img src="a"></html>', "<p>1 2 3</p>"] * 60] + [(None, None), ("http://h1.yy/", '<html lang="zz"></html>')]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string"), names, table).collect()}
    rows = []
    for url, page in pages:
        c = langid.gram_counts(langid.visible(page))
        ll = table @ c * min(1.0, langid.EFFECTIVE / max(c.sum(), 1))
        said = page.split('lang="')[1][:2] if 'lang="' in (page or "") else ""
        host = url.split("/")[2] if url else ""
        rows.append((ll, int(np.argmax(ll)) if c.sum() else None, host, host.split(".")[-1], said if said in ("", *names) else "other"))
    tally = lambda keep: np.bincount([r[1] for r in rows if r[1] is not None and keep(r)], minlength=3).astype(float)
    n = tally(lambda r: True)
    flat = n / n.sum() * 0.99 + 0.01 / 3
    smooth = lambda up, c: (c + langid.STRENGTH * up) / (c.sum() + langid.STRENGTH)
    for i, (ll, told, host, suffix, said) in enumerate(rows):
        prior = smooth(smooth(flat, tally(lambda r: r[3] == suffix)), tally(lambda r: r[2] == host))
        share = (tally(lambda r: r[4] == said) + 1) / (tally(lambda r: r[4] != "") + 2 + 3) if said else np.ones(3)
        score = ll + np.log(prior) + np.log(share)
        p = np.exp(score - score.max())
        want = (names[int(np.argmax(score))], None if told is None else names[told])
        assert (got[i].lang, got[i].text_lang) == want and abs(got[i].probability - 1 / p.sum()) < 2e-6
    assert all(got[i].lang == "bb" for i in range(80, len(pages) - 2))


def test_one_of_each_keeps_one_near_copy(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COPY_TILE", 5000)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    texts = [None, "", " ", "one two", "One  two"]
    for size in (60, 200, 200, 330):
        base = [rng.choice(words) for _ in range(size)]
        for n in (0, 0, 1, 2, 3, 4, 5, 6, 8, 12):
            c = base[:]
            for _ in range(n * size // 200):
                c[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(c))
    base = [f"{rng.choice(words)}{i}" for i in range(400)]
    texts += [" ".join(base + base[i : i + 10] * 60) for i in (0, 100, 200)]  # copies by sets, far apart by fingerprints
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    fps = [simhash.fingerprint(t, 3, 42) for t in texts]
    root, far = list(range(len(texts))), 0
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4)]
    apart = {(fps[i] ^ fps[j]).bit_count() for i, j in near}
    assert any(3 < x <= simhash.COPY_RADIUS for x in apart) and max(apart) > simhash.COPY_RADIUS
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(set(root))


def test_pipeline_run_writes_each_stage(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    def note(k):
        def stage(spark, d, sf_dir):
            seen.append(d.inputFiles())
            return d.select("doc_id", F.rand().alias("x"))
        return stage

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage {k}", note(k)) for k in range(3)])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(out.collect()) == sorted(out.collect())
    assert all(f"stage-{k - 1}-" in f for k in (1, 2) for f in seen[k])


def test_quality_has_one_verdict(spark):
    rows = [(i, " ".join("abcdefghijk"[: 1 + (i * j) % 11] + str(j) for j in range(60 + i % 50)), "en", "s") for i in range(3000)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert "kll" not in judged._jdf.queryExecution().optimizedPlan().toString()


def test_quality_verdicts_are_the_same_in_any_partitioning(spark):
    rng = random.Random(11)
    words = lambda i: ("".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9 + i % 3))) + "#" * (rng.random() < i % 40 / 40) for _ in range(60 + i % 50))
    rows = [(i, " ".join(words(i)) if i % 50 else "#x " + "#" * 400 + " ".join(words(i)), ("en", None)[i % 2], "st"[i % 7 == 0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = [sorted((r.doc_id, r.kept) for r in quality.judge(d).collect()) for d in (df, df.repartition(7), df.repartitionByRange(3, F.desc("doc_id")))]
    assert verdicts[0] == verdicts[1] == verdicts[2] and len({k for _, k in verdicts[0]}) == 2


def test_sketches_keep_quartiles(spark):
    rng = random.Random(10)
    values = [0.0] * 500 + [rng.lognormvariate(0, 2) for _ in range(1500)]
    rows = spark.createDataFrame([("en", v, v / 2, 0.0, v) for v in values], "lang string, symbol_rate double, dup_line_rate double, repeat_rate double, word_length double")
    got = quality._quartiles(quality.sketches(rows, ("lang",)), ("lang",), "g").first()
    above = sorted(v for v in values if v > 0)
    assert (got.g_n, got.g_n_symbol_rate, got.g_n_repeat_rate, got.g_repeat_rate_1) == (2000, 1500, 0, None)
    for i, place in ((1, 374), (3, 1124)):
        assert abs(got[f"g_symbol_rate_{i}"] / above[place] - 1) < 0.001 and abs(got[f"g_dup_line_rate_{i}"] / above[place] * 2 - 1) < 0.001


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op6_quality", "op10_topk"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
