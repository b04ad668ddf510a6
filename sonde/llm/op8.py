"""N-gram Jaccard join by PartEnum signatures, and the groups its links form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import attach, components, stored
from sonde.llm.textvec import chunks, mix, shingle_sets, utf8

SHINGLE = 5
PERCENT = 75            # two sets link when 100 * intersection >= PERCENT * union
FLUSH = 1_000_000       # signatures a task gathers before it sends them on
BUCKET = 1_000_000      # signatures of one shuffled bucket, about
SMALL = 12              # sets of one signature that are paired at once; more are linked as a star first
TILE = 2_000            # sets of a block of a large group; blocks are compared in pairs
TILE_BYTES = 16 << 20   # and bytes of their sketches

_tops: list[int] = []


def band_tops(size: int) -> np.ndarray:
    """Largest sizes of the bands: sets in bands two apart are too unlike in size to link."""
    if not _tops:
        _tops.append(2)
    while _tops[-1] < size:
        _tops.append((_tops[-1] + 1) * 100 // PERCENT)
    return np.array(_tops)


def shape(top: int) -> tuple[int, int, int]:
    """(differences, parts, subset) of the instance whose lower band ends at `top`.

    A linked pair with the smaller set at most `top` differs in at most `most` features, so it agrees on
    all but `most` of the parts of the feature domain, and on every subset of those.
    """
    most = (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    subset = 2 if most <= 6 else 1
    return most, most + subset + -(-most // 5), subset


def signatures(size: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, signature) of the sets given as sorted (doc, value), of `size` features each.

    A set signs in its own band's instance and in the next one.  A signature covers a subset of parts: the
    features that fall there.  Subsets without a feature are left out where the set has a feature in more
    parts than can differ: then every partner agrees with it on one that has.
    """
    docs_out, signs = [], []
    if not len(size):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    tops = band_tops(int(size.max()) + 1)
    band = np.searchsorted(tops, size)
    low, high = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)
    for role in (0, 1):
        instance = band + role
        known = [shape(int(t)) for t in band_tops(int(tops[-1]) * 2)[:int(instance.max()) + 1]]
        most, parts, subset = (np.array([k[i] for k in known]) for i in range(3))
        own = instance - 1  # the instance is named by its lower band
        usable = (own >= 1) & (size > 0) if role == 0 else (band >= 1)
        n_parts = np.where(usable, parts[np.maximum(own, 0)], 0)
        base = np.cumsum(n_parts) - n_parts
        at = np.flatnonzero(usable[doc])
        d = doc[at]
        part = mix(value[at] + np.uint64(7)) % n_parts[d].astype(np.uint64)
        slot = base[d] + part.astype(np.int64)
        total = int(n_parts.sum())
        filled = np.bincount(slot, minlength=total)
        a = np.bincount(slot, low[at].astype(np.float64), total).astype(np.uint64)
        b = np.bincount(slot, high[at].astype(np.float64), total).astype(np.uint64)
        of = np.repeat(np.arange(len(size)), n_parts)
        number = (np.arange(total) - base[of]).astype(np.uint64)
        sign = mix(mix(a + np.uint64(3)) + b + number * np.uint64(0x9E3779B97F4A7C15))
        busy = np.bincount(of, filled > 0, len(size))
        sure = busy > most[np.maximum(own, 0)]
        salt = mix(own.astype(np.uint64) + np.uint64(1000))
        single = subset[np.maximum(own, 0)] == 1
        keep = single[of] & ((filled > 0) | ~sure[of])
        docs_out.append(of[keep])
        signs.append(mix(sign[keep] ^ salt[of[keep]]))
        for i in np.unique(own[usable & ~single]):
            who = np.flatnonzero(usable & (own == i))
            grid = base[who][:, None] + np.arange(parts[i])
            pairs = np.array(list(combinations(range(parts[i]), 2)))
            x, y = grid[:, pairs[:, 0]], grid[:, pairs[:, 1]]
            keep = (filled[x] + filled[y] > 0) | ~sure[who][:, None]
            docs_out.append(np.broadcast_to(who[:, None], x.shape)[keep])
            signs.append(mix((mix(sign[x]) + sign[y])[keep] ^ salt[who[0]]))
    return np.concatenate(docs_out), np.concatenate(signs)


def _sizes(n: int, doc: np.ndarray) -> np.ndarray:
    return np.bincount(doc, minlength=n)


def _keys(size: np.ndarray, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set."""
    m = mix(value + np.uint64(11))
    a = np.bincount(doc, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), len(size)).astype(np.uint64)
    b = np.bincount(doc, (m >> np.uint64(32)).astype(np.float64), len(size)).astype(np.uint64)
    return mix(mix(a) + b + mix(size.astype(np.uint64))).view(np.int64)


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, ends = utf8(batch.column(column))
    for a, b in chunks(ends):
        doc, value = shingle_sets(data, ends[a:b + 1], SHINGLE)
        yield a, b, _sizes(b - a, doc), doc, value


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the name (`key`) of each row's set; the key of an empty set is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, n, doc, value in _each(batch, 1):
                size[a:b], key[a:b] = n, _keys(n, doc, value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size), pa.array(key, mask=size == 0)],
                                             ["doc_id", "n_shingles", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key bigint")


def _heads(sign: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, key), sorted and once each; the group number of each row; the size of its group."""
    order = np.lexsort((key, sign))
    sign, key = sign[order], key[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (key[1:] != key[:-1])
    sign, key = sign[new], key[new]
    head = np.ones(len(sign), bool)
    head[1:] = sign[1:] != sign[:-1]
    group = np.cumsum(head) - 1
    return sign, key, group, np.bincount(group)[group] if len(group) else group


def _stars(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Links of the members of each group to its smallest key."""
    head = np.ones(len(key), bool)
    head[1:] = group[1:] != group[:-1]
    lead = key[head][np.cumsum(head) - 1] if len(key) else key
    return np.unique(np.column_stack([lead[~head], key[~head]]), axis=0)


_SENT = ("bucket", "sign", "key", "large", "a", "b", "rows", "keys")


def _named(bucket: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """A signature's name over all buckets: bucket and low half."""
    return (bucket << 32) | sign.astype(np.int64)


def _send(sign: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures by bucket, as blobs of their low halves: a bucket holds about BUCKET of them, so few unlike ones
    share a half, and those are only candidates.  A signature that over SMALL sets share here sends a single set, marked; its star
    and its rows are final.
    """
    sign, key, group, size = _heads(sign, key)
    bucket = ((sign >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    sign = sign.astype(np.uint32)
    many = size > SMALL
    head = np.ones(len(sign), bool)
    head[1:] = group[1:] != group[:-1]
    star = _stars(key[many], group[many])
    rows, keys = _named(bucket[many], sign[many]), key[many]
    go = ~many | head
    bucket, sign, key, large = bucket[go], sign[go], key[go], many[go]
    order = np.argsort(bucket, kind="stable")
    bucket, sign, key, large = bucket[order], sign[order], key[order], large[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = [(int(bucket[i]), sign[i:j].tobytes(), key[i:j].tobytes(), large[i:j].tobytes(), b"", b"", b"", b"")
             for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)])]
    for i in range(0, len(rows), 100_000):
        # These are final, so any bucket will do: a frequent signature's rows are dealt over buckets of their own.
        spread = buckets + int(mix((rows[i:i + 1] ^ keys[i:i + 1]).view(np.uint64))[0] % np.uint64(buckets))
        blobs.append((spread, b"", b"", b"", star[i:i + 100_000, 0].tobytes(), star[i:i + 100_000, 1].tobytes(),
                      rows[i:i + 100_000].tobytes(), keys[i:i + 100_000].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in blobs], pa.int64()), *(pa.array([r[i] for r in blobs], pa.binary()) for i in range(1, 8))],
                                     list(_SENT))


def _signed(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, keys, held = [], [], 0
        for batch in batches:
            for _, _, size, doc, value in _each(batch, 0):
                of, sign = signatures(size, doc, value)
                signs.append(sign)
                keys.append(_keys(size, doc, value)[of])
                held += len(of)
                if held >= FLUSH:
                    yield from _send(np.concatenate(signs), np.concatenate(keys), buckets)
                    signs, keys, held = [], [], 0
        if held:
            yield from _send(np.concatenate(signs), np.concatenate(keys), buckets)

    return docs.select("text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{c} binary" for c in _SENT[1:]))


def _grouped(table: pa.Table) -> pa.Table:
    """Of a bucket: candidate pairs (all of small groups, stars of large ones), and the rows (signature, key) of large groups."""
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    sign, key, large = joined("sign", np.uint32), joined("key", np.int64), joined("large", bool)
    bucket = np.int64(table.column("bucket")[0].as_py())
    marked = np.unique(sign[large])
    order = np.argsort(sign)
    sign, key = sign[order], key[order]
    same = np.zeros(len(sign) + 1, bool)
    same[1:-1] = sign[1:] == sign[:-1]
    some = same[:-1] | same[1:]
    sign, key, group, size = _heads(sign[some], key[some])
    many = (size > SMALL) | np.isin(sign, marked)
    pairs = [np.column_stack([joined("a", np.int64), joined("b", np.int64)]), _stars(key[many], group[many])]
    rows = [np.column_stack([joined("rows", np.int64), joined("keys", np.int64)]), np.column_stack([_named(bucket, sign[many]), key[many]])]
    key, group = key[~many], group[~many]
    for step in range(1, SMALL):
        near = group[step:] == group[:-step]
        if not near.any():
            break
        pairs.append(np.column_stack([key[:-step][near], key[step:][near]]))
    pairs, rows = (np.unique(np.concatenate(x), axis=0) for x in (pairs, rows))
    both = np.concatenate([pairs, rows])
    return pa.table({"pair": pa.array(np.arange(len(both)) < len(pairs)), "a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})


def _cells(value: np.ndarray) -> bytes:
    """Counts of a set's features over a power of two of parts, at least as many as features; a lower bound of differences."""
    parts = 1 << max(4, int(len(value) - 1).bit_length())
    return np.minimum(np.bincount((value >> np.uint64(20)) & np.uint64(parts - 1), minlength=parts), 255).astype(np.uint8).tobytes()


def _sketch(cells: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(cells, np.uint8).astype(np.int16).reshape(-1, parts).sum(0, dtype=np.int16)


def _sets(docs: DataFrame, keys: DataFrame, whole: bool) -> DataFrame:
    """(key, n, cells or marks) of the sets of the documents whose doc_id is in `keys`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, size, doc, value in _each(batch, 0):
                ends = np.append(0, np.cumsum(size))
                key = _keys(size, doc, value)
                some = np.flatnonzero(size > 0)
                each = [value[ends[i]:ends[i + 1]] for i in some]
                held = pa.array([v.view(np.int64) for v in each], pa.list_(pa.int64())) if whole else pa.array([_cells(v) for v in each], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(size[some]), held], ["key", "n", "held"])

    found = attach(docs, keys, "doc_id", "left_semi").select("text")
    return found.mapInArrow(run, f"key bigint, n bigint, held {'array<bigint>' if whole else 'binary'}")


def _bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT
            x, y = batch.column(4), batch.column(5)
            for i in np.flatnonzero(ok).tolist():
                p, q = x[i].as_py(), y[i].as_py()
                parts = min(len(p), len(q))
                gap = int(np.abs(_sketch(p, parts) - _sketch(q, parts)).sum())
                ok[i] = gap * (100 + PERCENT) <= int(na[i] + nb[i]) * (100 - PERCENT)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    left = sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("held").alias("ca"))
    right = sketches.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("held").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with 100 * intersection >= PERCENT * union, counted on the whole sets."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("held").alias("ma"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("held").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b")


def _across(table: pa.Table) -> pa.Table:
    """Pairs of two blocks of one group, from different components, whose sizes and sketches allow a link."""
    side, comp, key, n = (table.column(c).to_numpy() for c in ("side", "comp", "key", "n"))
    cells = table.column("held").to_pylist()
    parts = min(map(len, cells))
    sketch = np.stack([_sketch(c, parts) for c in cells])
    rest = np.flatnonzero(side == 1)
    a, b = [], []
    for i in np.flatnonzero(side == 0):
        some = rest[(comp[rest] != comp[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * PERCENT)]
        gap = np.abs(sketch[some] - sketch[i]).sum(1)
        got = key[some[gap * (100 + PERCENT) <= (n[some] + n[i]) * (100 - PERCENT)]]
        a.append(np.minimum(got, key[i]))
        b.append(np.maximum(got, key[i]))
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _tiles(large: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of blocks of each group that lies in several components.

    Each pair of different components has a set outside the group's largest one, so only those (side 0) meet
    the rest (side 1).  Both sides are dealt into blocks of bounded rows and bytes, and blocks meet in pairs.
    """
    # Signatures with one smallest set are compared together: near copies share many of them.
    lead = large.groupBy("sign").agg(F.min("key").alias("lead"))
    sized = held.select("key", "comp", F.length("held").alias("wide"))
    member = stored(large.join(lead, "sign").select("lead", "key").distinct().join(sized, "key"), "members")
    each = member.groupBy("lead", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("wide").alias("wide"))
    most = F.max(F.struct("rows", "wide", "comp"))
    groups = each.groupBy("lead").agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("wide").alias("wide"), F.count(F.lit(1)).alias("comps"))

    def blocks(rows, wide):
        return F.greatest(F.ceil(rows / TILE), F.ceil(wide / TILE_BYTES), F.lit(1)).cast("int")

    mixed = groups.where("comps > 1").select(
        "lead", F.col("most.comp").alias("main"), blocks(F.col("rows") - F.col("most.rows"), F.col("wide") - F.col("most.wide")).alias("few"),
        blocks(F.col("rows"), F.col("wide")).alias("all"))
    dealt = attach(member.drop("wide"), stored(mixed, "mixed"), "lead", "inner")
    dealt = dealt.join(held.select("key", "n", "held"), "key").withColumn("h", F.xxhash64("key"))
    columns = ["lead", "key", "comp", "n", "held"]
    others = dealt.where("comp <> main").select(
        *columns, F.lit(0).alias("side"), F.expr("pmod(h, few)").cast("int").alias("x"), F.explode(F.expr("sequence(0, `all` - 1)")).alias("y"))
    rest = dealt.select(
        *columns, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, few - 1)")).alias("x"), F.expr("pmod(h, `all`)").cast("int").alias("y"))
    return others.unionByName(rest)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    Words are runs without white space, A-Z folded; a set holds the distinct 5-word shingles of the
    whole text, or its whole sequence if shorter.  Equal sets are one vertex, however many rows have them.
    Sets link at 100 * intersection >= 75 * union; component_id is the smallest doc_id reachable.  Rows of
    one doc_id are one vertex.  Empty and null texts have 0 shingles and link with nothing; a row without
    doc_id has no component.

    1. PartEnum signatures of every set are grouped by value.  Up to SMALL sets of one signature are candidate
       pairs; a larger group is a star around its smallest set for now, formed in the sending tasks first, so
       a frequent signature sends one row from each flush.
    2. Candidates whose sketches prove too many differences go; the others are counted on whole sets.
    3. In large groups, all pairs of different components so far are held against the sketches, and those left are
       counted too.  Pairs inside a component need no look: they change nothing.
    """
    docs = docs.select("doc_id", "text")
    named = stored(describe(docs), "sets")
    reps = stored(named.where("doc_id is not null and key is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.7) // BUCKET)
    # An id goes unsigned only if all of its sets are held by smaller ids; one that has a set of its own is signed whole.
    held_by = named.where("doc_id is not null and key is not null").join(reps, "key")
    copies = stored(held_by.groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("rep")).alias("all")).where("all").select("doc_id"), "copies")
    only = attach(docs.where("doc_id is not null"), copies, "doc_id", "left_anti")
    found = stored(_signed(only, buckets).groupBy("bucket").applyInArrow(_grouped, "pair boolean, a bigint, b bigint"), "candidates")
    pairs, large = found.where("pair").select("a", "b").distinct(), found.where("not pair").select(F.col("a").alias("sign"), F.col("b").alias("key"))

    def sets_of(keys: DataFrame, whole: bool) -> DataFrame:
        ids = reps.join(keys.distinct(), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        return stored(_sets(docs, stored(ids, "wanted"), whole), "sets")

    def ends_of(some: DataFrame) -> DataFrame:
        return some.select(F.explode(F.array("a", "b")).alias("key"))

    sketches = sets_of(ends_of(pairs), False)   # the stars reach every set of a large group
    sized = reps.select("key", "n")
    alike = pairs.join(sized.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(
        sized.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    alike = alike.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    near = stored(_bounded(alike, sketches), "near")
    good = stored(_verified(near, sets_of(ends_of(near), True)), "good")
    if not large.isEmpty():
        comp = components(good).select(F.col("v").alias("key"), F.col("root").alias("comp"))
        held = stored(sketches.join(comp, "key", "left").select("key", "n", "held", F.coalesce("comp", "key").alias("comp")), "held")
        more = stored(_tiles(large, held).groupBy("lead", "x", "y").applyInArrow(_across, "a bigint, b bigint").distinct(), "across")
        good = good.unionAll(_verified(more, sets_of(ends_of(more), True)))
    name = reps.select("key", "rep")
    links = good.join(name.select(F.col("key").alias("a"), F.col("rep").alias("ra")), "a").join(
        name.select(F.col("key").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    twice = named.where("key is not null and doc_id is not null").join(name, "key").where("doc_id <> rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    ids = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    links = links.unionAll(twice.join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b"))
    roots = stored(components(links), "roots")
    rooted = stored(name.join(roots, name.rep == roots.v, "left").select("key", F.coalesce("root", "rep").alias("root")), "rooted")
    return named.join(rooted, "key", "left").select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
