"""Alignment of two tokenizers against whole-text encoding and a walk over bytes."""

import hashlib
import random
from collections import Counter

import pytest
from public_tokenizers import path

from lodestar.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    None,
    "",
    " ",
    "  two  spaces and trailing ",
    "line\nbreak\r\n\ttab  \n x",
    "<|endoftext|> is text, <s> too</s>",
    "naïve café — “quotes” 你好 😀",
    "nbsp and wide​zero ᠎ x",
    "piece ▁ mark",
    "nul \x00 byte",
    "é combining ́alone",
    "ﬁ ligature ½ ² ™",
    "a" * 5000,
    "word " * 60_000,
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = alignment.byte_level(A).tokens, alignment.pieces(B).tokens
    docs, counts = [], Counter()
    for t in texts:
        a = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        if t and any(b"".join(x[i] for i in ids) != f" {t}".encode() for x, ids in ((a_bytes, a), (b_bytes, b))):
            a = b = []
        ends = []
        for ids, x in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(x[i]), i))
                at += len(x[i])
            ends.append(out)
        pairs, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            pairs.append((a[i], b[j]))
            x, y = ends[0][i][1], ends[1][j][1]
            i, j = i + (x <= y), j + (y <= x)
        cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups, before = [], 0
        by_end = [{}, {}]
        for k in (0, 1):
            at = 0
            for _, e, n in ends[k]:
                while e > cuts[at]:
                    at += 1
                by_end[k].setdefault(at, []).append(str(n))
        groups = ";".join(f"{','.join(by_end[0][g])}|{','.join(by_end[1][g])}" for g in range(len(cuts)))
        counts.update(pairs)
        docs.append((len(a), len(b), len(cuts), pairs, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(na, nb, g, len(ps), sum(counts[p] == most[p[1]] for p in ps), sum(counts[p] for p in ps), h) for na, nb, g, ps, h in docs]


def told(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as pair", "3 as row", "4 as n_a")
    return [tuple(r)[1:] for r in sorted(alignment.align(df, A, B, **more).collect())]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 7, 0])
def test_equals_brute_force(spark, broadcast):
    """Whether pairs are broadcast or joined."""
    assert told(spark, TEXTS, broadcast=broadcast) == brute(TEXTS)


def test_documents(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    assert told(spark, texts) == brute(texts)


def test_chunks_equal_whole_texts():
    """Random strings of characters that tokenizers treat in their own ways."""
    rng = random.Random(3)
    letters = ["a", "B", "1", "'s", "é", "ß", ".", "-", " ", " ", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "▁", "<s>", "<|endoftext|>", "the", "tion", "你", "́", "​"]
    texts = ["".join(rng.choices(letters[: rng.choice([12, 17, 25])], k=rng.randint(1, 40))) for _ in range(3000)]
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.byte_level(A), alignment.pieces(B)
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    ids_a, ids_b = alignment.tokens_of(texts, a, b)
    for t, x, y in zip(texts, ids_a, ids_b, strict=True):
        one, other = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        whole = f" {t}".encode()
        if b"".join(a.tokens[i] for i in one) != whole or b"".join(b.tokens[i] for i in other) != whole:
            one = other = []
        assert (x.tolist(), y.tolist()) == (one, other), repr(t)


@pytest.mark.parametrize(("cached", "run"), [(300_000, 64), (40, 3)])
def test_aligned_chunks_equal_whole_texts(monkeypatch, cached, run):
    """Links and groups put together from chunks, which are kept, forgotten, met again, and not given back."""
    monkeypatch.setattr(alignment, "CACHED", cached)
    monkeypatch.setattr(alignment, "RUN", run)
    rng = random.Random(4)
    letters = ["a", "B", "1", "'s", "é", "ß", ".", "-", "the", "tion", " ", " ", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "▁", "<s>", "你"]
    texts = ["".join(rng.choices(letters[: rng.choice([12, 13, 15, 22])], k=rng.randint(1, 60))) for _ in range(900)]
    texts += [None, "", " ", "x" * 300 + " end", "end " + "y" * 300, *TEXTS]
    rng.shuffle(texts)
    worker = alignment.Aligned(alignment.byte_level(A), alignment.pieces(B))
    got, counts = [], Counter()
    for i in range(0, len(texts), 100):
        out = worker(texts[i : i + 100])
        for pairs, times in zip(out["pair"], out["times"], strict=True):
            assert len(set(pairs.tolist())) == len(pairs)
            counts.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
        got += [(*map(int, x), h, sum(t)) for *x, h, t in zip(*(out[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "times")), strict=True)]
        assert len(worker.known) == len(worker.told) and len(worker.known) < cached + 10_000
    want = brute(texts)
    assert got == [(na, nb, g, n, h, n) for na, nb, g, n, _, _, h in want]
    assert sum(n * n for n in counts.values()) == sum(s for *_, s, _ in want)
    assert any(h == "" for t, (*_, h) in zip(texts, want, strict=True) if t)  # some aren't given back


def test_a_chunk_is_aligned_once(monkeypatch):
    seen = []
    plain = alignment.overlaps
    monkeypatch.setattr(alignment, "overlaps", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    worker = alignment.Aligned(alignment.byte_level(A), alignment.pieces(B))
    words = ["alignment", "of", "two", "tokenizers"]
    for _ in range(3):
        assert worker([" ".join(words * 500), " ".join(words[::-1] * 500)])["n_a"].min() >= 2000
    assert sum(seen) < 20


def test_a_text_that_is_not_given_back_is_encoded_once():
    b = alignment.pieces(B)
    seen, plain = [], b.encode
    b.encode = lambda texts: (seen.extend(texts), plain(texts))[1]
    texts = [f"piece ▁ mark {i}" for i in range(20)]
    out = alignment.Aligned(alignment.byte_level(A), b)([*texts, "plain words"])
    assert out["n_a"].tolist()[:-1] == [0] * 20 and out["n_a"][-1] > 0
    assert max(map(seen.count, texts)) == 1


def test_empty_table(spark):
    assert told(spark, []) == []
