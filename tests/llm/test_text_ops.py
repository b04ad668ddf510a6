import hashlib
import random
import re
import zlib

import duckdb
import pytest
from cases import SF, frame, jaccard_components, odd_rows
from pyspark.sql import functions as F

from sonde.llm import op1, op3, op5, op8, op10, queries
from sonde.llm.common import components


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).cache()


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op1.fit(docs.where(queries.remainder(4) != 2))
    got = op1.identify(docs, model).join(docs, "doc_id").where((queries.remainder(4) == 2) & F.col("lang").isNotNull())
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.9
    rows = op1.identify(odd, model).collect()
    assert len(rows) == len(odd_rows())
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 10))
    assert all(0 <= r.score <= 1 for r in rows)
    empty = op1.fit(docs.limit(0))
    assert {r.lang_pred for r in op1.identify(odd, empty).collect()} == {"und"}


def brute_decontamination(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            n = min(10, len(w))
            for j in range(len(w) - n + 1):
                windows.setdefault(tuple(w[j:j + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, held = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[j:j + n]))):
                    hit |= set(range(j, j + n))
                    held |= found
        names = ",".join(sorted(map(str, held)))
        out.append((-1 if i is None else i, len(w), len(hit), len(held), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("slice_windows", [500_000, 40])
def test_decontamination(spark, slice_windows):
    rng = random.Random(3)
    names = [f"w{i}" for i in range(60)] + ["é", "ß1"]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    items = [(i, say(rng.randint(8, 30))) for i in range(25)] + [(30, "W1"), (31, None), (None, say(12)), (32, ""), (33, "w2 w3"), (3, "é ß1 w5"), (40, say(10))]
    rows = odd_rows()
    for i in range(100, 160):
        own = (items[i % 25][1] or "").upper().split()
        cut = own[rng.randint(0, 5):]
        rows.append((i, f"{say(6)}. {'- '.join(cut)} {say(4)}"))
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    got = op3.decontaminate(frame(spark, rows), bench, slice_windows).drop("hits").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_decontamination(rows, items)
    none = op3.decontaminate(frame(spark, rows), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_mixing_shares(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op5.mix(docs)
    assert got.count() == docs.count()
    assert got.where("probability < 0 or probability > 1 or probability is null").count() == 0
    kept = got.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("kept"), F.sum("tokens").alias("n")).collect()
    want = {r.lang: r.n ** op5.TEMPER for r in kept}
    for r in kept:
        assert abs(r.kept / sum(x.kept for x in kept) - want[r.lang] / sum(want.values())) < 0.02
    assert op5.mix(odd).count() == len(odd_rows()) and op5.mix(odd.limit(0)).count() == 0
    goal = spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "lang string, share double")
    only = op5.mix(docs, {"lang": goal}).where("lang not in ('en', 'fr')")
    assert only.where("sampled").count() == 0


def test_mixing_oracle(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op5_mixing"]).fetchall()
    got = [tuple(r) for r in queries.op5_mixing(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_jaccard_join(spark):
    rows = odd_rows()
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    root, sets = jaccard_components(rows)
    got = op8.join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == root | {None: None}
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(
        (i, len(s)) for i, many in sets.items() if i is not None for s in many)
    assert op8.join(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_join_of_an_id_with_two_texts(spark):
    """An id's own text links to near copies although its other text is a copy of a smaller id's."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    own, other = say(120), say(90)
    rows = odd_rows() + [(300, other), (301, own), (301, other), (302, own + " end"), (303, "start " + own)]
    root, _ = jaccard_components(rows)
    assert {root[i] for i in (300, 301, 302, 303)} == {300}
    assert {r.doc_id: r.component_id for r in op8.join(frame(spark, rows)).collect()} == root | {None: None}


def test_components_of_stars_take_few_jobs(spark):
    """Edges that already are stars need no round; those that are not settle on the smallest vertex."""
    edges = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("stars", "components of stars")
    try:
        got = components(edges([(i, i % 3) for i in range(60)]))
        assert len(tracker.getJobIdsForGroup("stars")) <= 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.v: r.root for r in got.collect()} == {i: i % 3 for i in range(3, 60)}
    line = list(range(40))
    random.Random(3).shuffle(line)
    loose = [(100, 101), (102, 101), (103, 103), (None, 104), (101, 100), (-5, 200), (200, 201)]
    got = components(edges([*zip(line, line[1:]), *loose]))
    assert {r.v: r.root for r in got.collect()} == {i: 0 for i in range(1, 40)} | {101: 100, 102: 100, 200: -5, 201: -5}
    assert components(edges(loose[2:4])).count() == 0


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Near copies on both sides of the threshold, in groups larger than SMALL, dealt over many blocks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    made = []
    tiles = op8._tiles
    monkeypatch.setattr(op8, "_tiles", lambda *a: made.append(tiles(*a)) or made[-1])
    monkeypatch.setattr(op8, "TILE", 7)
    root, _ = jaccard_components(rows)
    got = {r.doc_id: r.component_id for r in op8.join(frame(spark, rows)).collect()}
    assert got == root and len(set(root.values())) > 1
    assert made and made[0].select("lead", "x", "y").distinct().count() > 4


def test_signatures_miss_no_pair():
    """Random pairs at and just above the threshold share a signature, at sizes over all bands."""
    import numpy as np

    rng = np.random.default_rng(1)
    for trial in range(400):
        small = int(rng.integers(3, 120))
        large = int(rng.integers(small, small * 100 // 75 + 1))
        both = -(-75 * (small + large) // 175)
        if both > small:
            continue
        pool = rng.choice(2**62, small + large, replace=False).astype(np.uint64)
        x, y = pool[:small], np.concatenate([pool[:both], pool[small:small + large - both]])
        doc = np.repeat([0, 1], [len(x), len(y)])
        value = np.concatenate([np.sort(x), np.sort(y)])
        of, sign = op8.signatures(np.bincount(doc), doc, value)
        assert set(sign[of == 0].tolist()) & set(sign[of == 1].tolist()), (small, large)


def test_sharding(spark, odd):
    got = op10.shard(odd).collect()
    assert len(got) == len(odd_rows())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    text = dict(odd_rows())
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
    wide = op10.shard(spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text"), weights={0: 3.0})
    n = {r["shard"]: r["count"] for r in wide.groupBy("shard").count().collect()}
    assert abs(n[0] / 20000 - 0.3) < 0.02 and all(abs(n[i] / 20000 - 0.1) < 0.02 for i in range(1, 8))
    assert op10.shard(odd.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = frame(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "sharding" or out.columns == docs.columns
        docs = out
    assert docs.count() > 0
    assert corpus_pipeline.near_duplicates(spark, frame(spark, odd_rows()[20:40]), SF).count() < 20


def test_pipeline_judges_rows(spark):
    """Null ids and texts that share an id: each row stays or goes by its own text."""
    import corpus_pipeline as stages

    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(4).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy(F.desc(F.length("text"))).first().text
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    some = lambda rows: frame(spark, rows)
    kept = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = lambda rows: sorted(rows, key=repr)
    good, bad = [(None, real[0]), (7, real[1]), (8, real[2])], [(7, "12 34 !!"), (None, None), (9, "")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*some(good).columns[:4])
    out = stages.language(spark, docs.unionByName(some(good + bad).select(docs.columns)), SF).where("doc_id is null or doc_id in (7, 8, 9)")
    base = {(r.doc_id, r.text) for r in docs.where("doc_id in (7, 8, 9)").collect()}
    assert [x for x in kept(out) if x not in base] == want(x for x in good if x not in base)

    a, b, c, d = (say(100) for _ in range(4))
    rows = [(5, a), (5, b), (3, a + " end"), (None, c), (None, d), (2, d + " end"), (None, "start " + c), (5, b), (None, "")]
    out = kept(stages.near_duplicates(spark, some(rows), SF))
    assert [x for x in out if x[1] not in (c, "start " + c)] == want([(5, b), (3, a + " end"), (2, d + " end"), (None, "")])
    assert sum(x in ((None, c), (None, "start " + c)) for x in out) == 1

    clean = [(5, a), (None, b)]
    assert kept(stages.decontamination(spark, some([*clean, (5, item), (None, item)]), SF)) == want(clean)

    rows = [(i % 40, "x" * (100 + 6000 * (i // 40))) for i in range(80)] + [(None, "y"), (None, "http")]
    mixed = some(rows)
    cell = ["doc_id", "lang", "source", op5.topic_of(F.col("text")).alias("topic")]
    drawn = op5.mix(mixed)
    got = stages.mixing(spark, mixed, SF).select(cell)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, drawn.where("sampled").select("doc_id", "lang", "source", "topic").collect()))
    both = drawn.groupBy("doc_id").agg(F.count_distinct("sampled").alias("n")).where("n > 1")
    assert both.count() > 0
