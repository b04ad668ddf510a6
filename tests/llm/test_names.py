"""Strings that every polynomial modulo 2^64 takes for one another are told apart."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, jaccard_components

from sonde.llm import op3, op8, op9, textvec
from sonde.llm.table import Column, Table


def twins(n):
    """The Thue-Morse word of n letters, and its complement."""
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [16, 128, 256, 1024, 2048])
def test_words_have_names_of_their_own(n):
    one, two = twins(n)
    texts = [one, two, f"x {one} {two}", one[:-1], one + "a", f"{one}\0"]
    data, ends = textvec.utf8(pa.array(texts))
    found = textvec.words(data, ends, textvec.UNSPACED)
    spelled = [w for t in texts for w in t.split(" ")]
    assert len({(m, w) for m, w in zip(found.marks.tolist(), spelled)}) == len(set(spelled)) == len(set(found.marks.tolist()))


def test_names_of_all_lengths():
    text = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 40, np.uint8)
    start = np.repeat(np.arange(60), 300)
    size = np.tile(np.arange(1, 301), 60)
    found = textvec.names(text, start, start + size)
    spelled = [text[a:a + b].tobytes() for a, b in zip(start, size)]
    by = {}
    for name, s in zip(found.tolist(), spelled):
        assert by.setdefault(name, s) == s
    assert len(by) == len(set(spelled))


def test_no_false_links_hits_or_ids(spark, tmp_path):
    one, two = twins(1024)
    more = twins(2048)
    rows = [(1, f"{one} p q r s"), (2, f"{two} p q r s"), (3, f"{more[0]} {more[1]} {one}"), (4, f"{more[1]} {more[0]} {two}"), (5, f"{one} p q r s")]
    sets, _ = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in op8.join(frame(spark, rows)).collect()} == sets == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    bench = spark.createDataFrame([(7, one), (8, more[1])], "item_id bigint, text string")
    hits = {r.doc_id: (r.n_hit, r.items_sha256) for r in op3.decontaminate(frame(spark, rows), bench).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert hits == {1: (1, sha("7")), 2: (0, sha("")), 3: (2, sha("7,8")), 4: (1, sha("8")), 5: (1, sha("7"))}
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [t for _, t in rows]
    assert [x.tolist() for x in op9.encode(texts, public.path("byte_bpe_50k.json"))] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_name_are_compared(monkeypatch):
    """With names cut to two bits nearly all pieces collide; ids stay right, in one call and over several."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own, plain, names = Tokenizer.from_file(path), op9.Encoder(path), textvec.names
    monkeypatch.setattr(op9, "names", lambda *a: names(*a) & np.uint64(6))
    for texts in (["the cat sat on the mat, it's 12 é漢", "a b c d the"], ["dog the cat fog", "", "mat mat mat"], ["ꟑ \U0001df10x௰ Ᲊ"]):
        assert [x.tolist() for x in plain.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_and_column():
    rng = np.random.default_rng(1)
    table, column, seen = Table(), Column(np.int64), {}
    for _ in range(12):
        keys = np.unique(rng.integers(0, 2**63 - 1, 3000))
        keys = keys[table.find(keys) < 0]
        assert column.extend(keys) == len(seen)
        table.enter(keys)
        seen |= {k: len(seen) + i for i, k in enumerate(keys.tolist())}
    known = np.array(list(seen))
    assert (table.find(known) == np.array(list(seen.values()))).all() and (column.data[table.find(known)] == known).all()
    assert (table.find(rng.integers(0, 2**63 - 1, 1000)) == -1).all()
