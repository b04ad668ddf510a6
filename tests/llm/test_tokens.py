"""Byte-level BPE and fill-in-middle against the libraries and plain re-statements."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import SF, frame, odd_rows

from sonde.llm import op11, op13, queries
from sonde.llm.pretoken import tiktoken_kinds
from sonde.llm.textvec import utf8

STRANGE = ["it's we'll I'd'll 'sabc ''s '' 've x'rez\n\n  a \t b 12ab é3  x <|endoftext|> end  ", "'", "a'", "\n", " 's don'T can't'll  'm\n'd",
           "² ½ Ⅷ á 　x 漢字 123漢", "aaa" * 400, "\U0001f600\U0001f44d\U0001f3fd" * 40, "\x00\x01 \x1c\x1d\x85 ", " " * 300, "-" * 999, "▁<s>▁▁",
           "".join(map(chr, range(1, 0x500))), "ÃÂ" * 300, "\U0001df10꟒Ᲊ x௰"]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark):
    return odd_rows() + [(i + 5000, t) for i, t in documents(spark)] + [(9000 + i, t) for i, t in enumerate(STRANGE)]


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def merges(public):
    return op11.compile_merges(op11.read_ranks(open(public.path("byte_bpe_50k.tiktoken"), "rb").read()))


@pytest.fixture(scope="module")
def library(public, merges):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(merges.tokens)}, special_tokens={})


def test_byte_bpe(spark, monkeypatch, public, merges, library):
    monkeypatch.setattr(op11, "CHUNK", 3000)
    rows = rows_of(spark)
    got = op11.decode(op11.encode(frame(spark, rows).repartition(3), merges), merges.tokens).collect()
    say = lambda found: sorted(((-1 if i is None else i), ids, t) for i, ids, t in found)
    assert say((r.doc_id, r.ids, r.text) for r in got) == say((i, library.encode_ordinary(t or ""), t or "") for i, t in rows)
    assert op11.encode(frame(spark, rows).limit(0), merges).count() == 0
    gone = spark.createDataFrame([(1, None), (2, []), (3, [64, 64])], "doc_id bigint, ids array<int>")
    assert sorted(r.text for r in op11.decode(gone, merges.tokens).collect()) == ["", "", "aa"]


def test_byte_bpe_query(spark, public, library):
    for r, (i, t) in zip(queries.op11_byte_bpe(spark, SF).orderBy("doc_id").collect(), sorted(documents(spark))):
        ids = library.encode_ordinary(t or "")
        assert tuple(r) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_transducer_on_random_texts(merges, library, monkeypatch):
    """Few and many pieces in step, machines that start anew, every kind of character."""
    rng = random.Random(8)
    heads = [t.decode("utf-8", "ignore") for t in merges.tokens]
    for few, known in ((0, 10**6), (30, 10**6), (10**6, 10**6), (24, 500)):
        monkeypatch.setattr(op11, "FEW", few)
        monkeypatch.setattr(op11, "KNOWN", known)
        own = op11.Transducer(merges, tiktoken_kinds())
        for _ in range(4):
            texts = ["".join(rng.choice((rng.choice(heads), chr(rng.choice((rng.randrange(1, 128), rng.randrange(0x80, 0xd800), rng.randrange(0xe000, 0x110000))))))
                             for _ in range(rng.randint(0, 60))) for _ in range(60)] + STRANGE
            import pyarrow as pa

            ids, at = own.encode(*utf8(pa.array(texts)))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode_ordinary(t) for t in texts]


def test_neighbours_are_those_of_own_encodings(merges, library):
    own, rng = op11.Transducer(merges, tiktoken_kinds()), random.Random(3)
    for _ in range(20_000):
        a = rng.randrange(len(merges.tokens)) if rng.random() < 0.5 else rng.randrange(2000)
        b = rng.randrange(len(merges.tokens)) if rng.random() < 0.5 else rng.randrange(2000)
        assert own.follows(a, b) == (library._core_bpe.encode_single_piece(merges.tokens[a] + merges.tokens[b]) == [a, b])


def test_two_cuts_are_an_error():
    """A token that its own merges never reach leaves no single cut."""
    with pytest.raises(ValueError):
        op11.compile_merges([bytes([b]) for b in range(256)] + [b"abc"])


def test_streamed_decoding(merges):
    rng = np.random.default_rng(5)
    own = op11.Decoder(merges.tokens)
    odd = np.flatnonzero([any(b > 127 for b in t) for t in merges.tokens])
    for _ in range(300):
        ids = np.where(rng.random(40) < 0.7, rng.choice(odd, 40), rng.integers(0, len(merges.tokens), 40))
        whole, cuts = b"".join(merges.tokens[i] for i in ids), np.sort(rng.integers(0, 41, 5))
        parts = [own.feed(part) for part in np.split(ids, cuts)]
        assert "".join(parts) + own.finish() == whole.decode("utf-8", "replace")
    text = "é漢\U0001f600x" * 5
    shown = [own.feed(np.array([merges.tokens.index(bytes([b]))])) for b in text.encode()]
    assert "".join(shown) == text and own.finish() == "" and max(map(len, shown)) == 1


def brute_middle(doc_id, text):
    text = text or ""
    found = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(found) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(found), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(found), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    rng = random.Random(6)
    rows = rows_of(spark) + [(20_000 + i, "".join(rng.choice("ab Z[@`{é漢\U0001f600\n<PSM>") for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(30_000, "x" * 100_000 + "é" * 50_000), (30_001, "a <P> b"), (30_002, "<M"), (30_003, "P>" * 9)]
    order = lambda found: sorted(found, key=lambda r: tuple((x is not None, x) for x in r))
    want = order((i, *brute_middle(i, t), t or "") for i, t in rows)
    for feed in (op13.FEED, 50):
        monkeypatch.setattr(op13, "FEED", feed)
        assert order(map(tuple, op13.restored(op13.transform(frame(spark, rows))).collect())) == want
    assert op13.digest(op13.transform(frame(spark, rows).limit(0))).count() == 0
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_op9_tokenizer_uses_no_threads_beside_its_task(monkeypatch):
    import os

    import public_tokenizers
    from sonde.llm import op9

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    own = op9.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    text = "it's 1,024  pieces\n\n of café 中文 'll"      # pieces are not split again, and need not be
    assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
