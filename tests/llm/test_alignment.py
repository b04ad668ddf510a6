"""Tokenizer alignment against the two libraries and a plain count of links."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SF, frame
from test_tokens import STRANGE, documents, rows_of

from sonde.llm import op12, queries
from sonde.llm.textvec import utf8

public = pytest.importorskip("public_tokenizers")
EXTRA = ["a▁b", "▁", " ", "  two  spaces   three    ", "\n\n", "x", "<0x41><s></s>�", "é" * 50 + " " + "漢" * 9, "a\tb\r\n c", "…—“quoted” ‘x’", "▁▂"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabularies():
    return op12.byte_level(open(public.path("byte_bpe_50k.json"), "rb").read()), op12.sentence_pieces(open(public.path("piece_bpe_32k.model"), "rb").read())


def brute(rows, libraries, vocabularies):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) with links read off byte by byte."""
    (first, second), (left, right) = libraries, vocabularies
    found, count = [], Counter()
    for i, t in rows:
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        if any(b"".join(p.bytes_of[x] for x in ids) != (" " + t).encode() for p, ids in ((left, a), (right, b)) if t):
            a, b = [], []
        ends = [np.cumsum([0, *(len(p.bytes_of[x]) for x in ids)]).tolist() for p, ids in ((left, a), (right, b))]
        owner = [[k for k, x in enumerate(ids) for _ in p.bytes_of[x]] for p, ids in ((left, a), (right, b))]
        links = [(a[x], b[y]) for x, y in sorted(set(zip(*owner)))]
        count.update(links)
        shared = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups = [[",".join(str(ids[k]) for k in sorted(set(of[low:high]))) for ids, of in zip((a, b), owner)] for low, high in zip([0, *shared], shared)]
        found.append((i, a, b, links, groups))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else "") for i, a, b, links, groups in found]


def order(rows):
    return sorted(tuple((x is not None, x) for x in r) for r in rows)


def small(spark):
    rows = [(i, t[:1500] if t else t) for i, t in rows_of(spark)[:160]] + [(7000 + i, t) for i, t in enumerate(EXTRA + STRANGE)]
    return rows + [(7000, EXTRA[0]), (7005, "x"), (7100, "x " * 700)]


def test_alignment(spark, monkeypatch, libraries, vocabularies):
    rows = small(spark)
    want = order(brute(rows, libraries, vocabularies))
    odd = frame(spark, rows).withColumnsRenamed({"n_chars": "n_a", "row": "a", "key": "b", "bucket": "count_sum"}).repartition(5)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for chunk, pairs, bucket, part in ((1 << 20, 8_000_000, 50_000, 1 << 16), (5000, 4000, 300, 64)):    # one slice; many slices, buckets, parts
        for name, value in (("CHUNK", chunk), ("PAIRS", pairs), ("BUCKET", bucket), ("PART", part), ("FAN", 2), ("HELD", bucket * 40)):
            monkeypatch.setattr(op12, name, value)
        assert order(map(tuple, op12.align_documents(odd, *vocabularies).select(columns).collect())) == want
    none = op12.align_documents(odd.where("doc_id in (0, 1)"), *vocabularies).select(columns).collect()
    assert order(map(tuple, none)) == order((i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1))
    assert op12.align_documents(odd.limit(0), *vocabularies).count() == 0


def test_alignment_query(spark, libraries, vocabularies):
    assert order(map(tuple, queries.op12_alignment(spark, SF).collect())) == order(brute(documents(spark), libraries, vocabularies))


def test_encoders_equal_the_libraries(libraries, vocabularies):
    rng = random.Random(12)
    left, right, own_a, own_b = op12.machines(*vocabularies)
    parts = [[p.bytes_of[i].decode("utf-8", "ignore") for i in range(len(p.bytes_of))] for p in vocabularies]
    for _ in range(6):
        texts = ["".join(rng.choice((rng.choice(parts[0]), rng.choice(parts[1]), " ", chr(rng.choice((rng.randrange(1, 128), rng.randrange(0x80, 0xd800), rng.randrange(0xe000, 0x110000))))))
                         for _ in range(rng.randint(1, 50))) for _ in range(80)] + STRANGE + EXTRA
        texts = [t for t in texts if t and "▁" not in t]
        data, ends = op12.spaced(*utf8(pa.array(texts)))
        a, at = own_a.encode(data, ends)
        assert [a[x:y].tolist() for x, y in zip(at, at[1:])] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
        b, at = op12.encode_pieces(own_b, vocabularies[1].single(), vocabularies[1].fallback, data, ends)
        assert [b[x:y].tolist() for x, y in zip(at, at[1:])] == [libraries[1].encode(t) for t in texts]


def test_hash_is_minimal_and_verified(spark, monkeypatch):
    monkeypatch.setattr(op12, "BUCKET", 500)
    keys = np.unique(np.random.default_rng(1).integers(0, 10**9, 20_000))
    pairs = spark.createDataFrame(pa.table({"key": keys, "cell": op12._cell(keys)}))
    own = op12.PairHash(op12.build_hashes(pairs, 40).toArrow(), 40)
    assert sorted(own.find(keys).tolist()) == list(range(len(keys)))
    assert (own.keys[own.find(keys)] == keys).all()
    others = np.setdiff1d(np.random.default_rng(2).integers(0, 10**9, 20_000), keys)
    assert (own.find(others) == -1).all()
    assert op12.PairHash(op12.build_hashes(pairs.limit(0), 40).toArrow(), 40).find(keys).max() == -1
