"""MinHash near-duplicates with tensored banding.

Tables are not hashed one by one. Two small collections of half keys, each of `SIDE` values that join
two minima, are computed; every pair of a left and a right half key is one table key. `SIDE ** 2`
four-row tables thus cost `4 * SIDE` minima. A half key that no other class has can make no table
key, so it is dropped before the pairs are formed: lone documents never reach the tables.

Inside a table bucket nobody is paired with everybody. Each class is compared with the ends of its
buckets and with its neighbours in some buckets sorted by a run of minima; links that hold on the
full shingle sets are joined into components. Only buckets that then hold several components go on:
small ones with all pairs across components, larger ones in blocks, group of overlapping buckets by
group: no pair of a bucket stays untested unless its members are already in one component. Pairs
inside a component cost nothing, however large a group of copies is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.llm import common, hashing
from exprspark.session import cut

WIDTH = 5
SIDE = 14
ROWS = 2 * 2 * SIDE
MULTIPLIERS = hashing.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
SHIFTS = hashing.mix(np.arange(501, 501 + ROWS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: At similarity 0.75 a pair agrees on 42 of 56 minima, 3.2 the standard deviation; below 23 is six of those off.
AGREE = 23
#: Up to this size a bucket of several components is compared pair by pair, a larger one in blocks of about `BLOCK` members
#: and `BLOCK_SHINGLES` shingles. One text may hold more; a product of blocks takes `VALUES` shingles at a time.
SMALL_BUCKET = 48
BLOCK = 512
BLOCK_SHINGLES = 1 << 16
VALUES = 4096

PROFILE = "doc_id bigint, text_key bigint, n_shingles bigint, class bigint, halves array<bigint>, minima binary"


def minima(values: np.ndarray) -> np.ndarray:
    out = np.full(ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(values), 4096):
        part = (values[at : at + 4096, None] ^ SHIFTS) * MULTIPLIERS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def half_keys(low: np.ndarray) -> np.ndarray:
    pairs = low.reshape(2 * SIDE, 2)
    return hashing.mix(pairs[:, 0] * hashing.FACTORS[0] + pairs[:, 1] * hashing.FACTORS[1] + np.arange(2 * SIDE, dtype=np.uint64) * hashing.FACTORS[2])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            sets = hashing.shingle_sets(common.encoded(part.column("text")), WIDTH)
            classes, halves, lows = [], [], []
            for values in sets:
                if not len(values):
                    classes.append(None), halves.append(None), lows.append(None)
                    continue
                low = minima(values)
                classes.append(int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True))
                halves.append(half_keys(low).view(np.int64))
                lows.append((low >> np.uint64(48)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array(halves, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "class", "halves", "minima"])


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: size of its shingle set, its class (digest of the set; null for an empty set), half keys and minima."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key().alias("text_key"), "text").mapInArrow(_profiles, PROFILE)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, ROWS) for c in ("left", "right"))
        keep = pa.array((left == right).sum(axis=1) >= AGREE)
        yield batch.select(["u", "v"]).filter(keep)


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= 75 * (len(left) + len(right) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
    for batch in batches:
        for part in common.slices(batch, "left"):
            own = hashing.shingle_sets(common.encoded(part.column("left")), WIDTH)
            keep = []
            for values, text in zip(own, common.encoded(part.column("right"))):
                if held[0] != text:
                    held = text, hashing.shingle_sets([text], WIDTH)[0]
                keep.append(similar(values, held[1]))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, class, root) in order: each class with the nearest one before it, in the same bucket, of another component."""
    last = np.empty((3, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in ("key", "class", "root")])], axis=1)
        last = rows[:, -1:]
        key, cls, root = rows
        if len(key) < 2:
            continue
        at = np.arange(1, len(key))
        same = key[1:] == key[:-1]
        change = np.maximum.accumulate(np.where(same & (root[1:] != root[:-1]), at, 0))
        start = np.maximum.accumulate(np.where(~same, at, 0))
        good = change > start
        yield pa.RecordBatch.from_arrays([pa.array(cls[1:][good]), pa.array(cls[change[good] - 1])], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            sets = hashing.shingle_sets(common.encoded(part.column("text")), WIDTH)
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "shingles"])


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of `one` with each set of `two`: products of incidence matrices over the shared
    values, a few thousand values at a time."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), np.int64)
    sides = []
    for sets in (one, two):
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, values)
        here = column < len(shared)
        here[here] = shared[column[here]] == values[here]
        order = np.argsort(column[here], kind="stable")
        sides.append((len(sets), owner[here][order], column[here][order]))
    for at in range(0, len(shared), VALUES):
        width = min(VALUES, len(shared) - at)
        parts = []
        for size, owner, column in sides:
            low, high = np.searchsorted(column, (at, at + width))
            part = np.zeros((size, width), np.float32)
            part[owner[low:high], column[low:high] - at] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of entries that join the same rows and columns as all true entries do, fewer than rows plus columns."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in np.flatnonzero(rows_left):
        rows = np.array([start] if rows_left[start] else [], np.int64)
        rows_left[rows] = False
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & columns_left)
            columns_left[columns] = False
            further = np.flatnonzero(linked[:, columns].any(axis=1) & rows_left)
            rows_left[further] = False
            if len(columns):
                i.append(rows[linked[np.ix_(rows, columns)].argmax(axis=0)]), j.append(columns)
            if len(further):
                i.append(further), j.append(columns[linked[np.ix_(further, columns)].argmax(axis=1)])
            rows = further
    return np.concatenate(i), np.concatenate(j)


def _members(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    cls, root, shingles = block.flatten()
    return cls.to_numpy(), root.to_numpy(), [np.frombuffer(s, np.uint64) for s in shingles.to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components of two blocks, tested on the full shingle sets. Of links that join the same classes only a
    spanning forest comes back, so a pair of blocks gives fewer rows than it has members."""
    for batch in batches:
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in range(batch.num_rows):
            one, two = (_members(batch.column(c)[r].values) for c in ("left", "right"))
            apart = one[1][:, None] != two[1][None, :]
            if not apart.any():
                continue
            both = np.array([len(s) for s in one[2]])[:, None] + np.array([len(s) for s in two[2]])[None, :]
            shared = intersections(one[2], two[2])
            i, j = spanning(apart & (100 * shared >= 75 * (both - shared)))
            u.append(one[0][i]), v.append(two[0][j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _near(pairs: DataFrame, kept: DataFrame, parts: int) -> DataFrame:
    """The pairs (u, v) without those whose minima are far apart."""
    low = kept.select("class", "minima")
    return cut(pairs.join(low.select(F.col("class").alias("u"), F.col("minima").alias("left")), "u")
               .join(low.select(F.col("class").alias("v"), F.col("minima").alias("right")), "v").select("u", "v", "left", "right").mapInArrow(_alike, "u bigint, v bigint").coalesce(parts))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity."""
    return cut(pairs.join(texts.select(F.col("class").alias("u"), F.col("text").alias("left")), "u")
               .join(texts.select(F.col("class").alias("v"), F.col("text").alias("right")), "v").select("u", "v", "left", "right").mapInArrow(_verify, "u bigint, v bigint"))


def _tables(survivors: DataFrame) -> DataFrame:
    """One row per class and table: its bucket key and the table's two slots."""
    keys = F.expr("flatten(transform(lefts, a -> transform(rights, b -> named_struct('key', xxhash64(a.half, b.half), 'left', a.slot, 'right', b.slot - " + str(SIDE) + "))))")
    return survivors.select("class", F.explode(keys).alias("t")).select("class", "t.*")


def class_roots(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(class, root) of every class linked to another one; all others are their own root."""
    classes = cut(profile.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("halves").alias("halves"), F.first("minima").alias("minima"), F.first("n_shingles").alias("n")))
    halves = classes.select("class", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("half")
    own = F.struct("slot", "half")
    left, right = F.collect_list(F.when(F.col("slot") < SIDE, own)), F.collect_list(F.when(F.col("slot") >= SIDE, own))  # at most SIDE values each
    survivors = cut(halves.join(shared, "half").groupBy("class").agg(left.alias("lefts"), right.alias("rights")).where("size(lefts) > 0 and size(rights) > 0"))
    # tables of a few numbers per surviving class need few files; texts and bucket members need ten times as many
    active = survivors.count()
    few, many = max(12, active // 20_000), max(12, active // 2_000)
    kept = cut(classes.join(survivors.select("class"), "class").select("class", "row", "minima", "halves", "n"))
    tables = _tables(survivors)
    buckets = tables.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    members = cut(tables.join(buckets, "key").coalesce(many))

    wanted = kept.select("class", F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("k"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(texts.join(wanted, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("class", "text").dropDuplicates(["class"]).coalesce(many))

    # every class with the first and the last member of its buckets, and with its neighbours in some sorted buckets
    pairs = _ends(members, "low", F.min).unionByName(_ends(members, "high", F.max))
    pairs = cut(_ordered(pairs.unionByName(_nearest(members.where("size > 2").withColumn("root", F.col("class")), kept, (0,), 0))).coalesce(few))
    links = _links(pairs, texts)
    roots = cut(common.components(links, few).coalesce(few))

    # then what lies across the components of a bucket
    placed = members.select("class", "key", "left", "right", "size").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    still = cut(placed.join(mixed, "key").coalesce(few))
    small = still.where(F.col("size") <= SMALL_BUCKET).select("key", "class", "root")
    within = small.alias("l").join(small.alias("r"), F.expr("l.key = r.key and l.class > r.class and l.root <> r.root")).select(F.col("l.class").alias("u"), F.col("r.class").alias("v"))
    across = cut(_ordered(within).join(pairs, ["u", "v"], "left_anti"))
    more = _links(_near(across, kept, few), texts)
    roots = _joined(links.unionByName(more), roots, few)

    # at last all that is still apart in large buckets; what is left apart after this pass has been tested
    large = members.where(F.col("size") > SMALL_BUCKET).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rest = _all_blocks(large, kept, texts, few)
    if rest is not None:
        roots = _joined(rest, roots, few)
    return roots.select(F.col("node").alias("class"), "root").unionByName(roots.select(F.col("root").alias("class"), "root")).distinct()


def _joined(links: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """(node, root) after new links: those between the groups known so far, once each, and every class to its group."""
    known = roots.withColumnsRenamed({"node": "x", "root": "y"})
    ends = [F.coalesce("y", end).alias(end) for end in ("u", "v")]
    between = links.join(known, F.col("u") == F.col("x"), "left").select(ends[0], "v").join(known, F.col("v") == F.col("x"), "left").select("u", ends[1])
    edges = cut(_ordered(between).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))).coalesce(parts))
    return cut(common.components(edges, parts).coalesce(parts))


def _all_blocks(large: DataFrame, kept: DataFrame, texts: DataFrame, few: int) -> DataFrame | None:
    """(u, v): links across components that share a large bucket, enough of them to join all that are linked. Buckets of several
    components that share a class form one group, so a class carries its shingles once and a pair is compared once, however many
    buckets hold it. In a group the members outside its largest component meet each other and that one. Members are dealt over
    blocks; a block goes to as many tasks as there are blocks on the other side. None where no bucket holds several components."""
    mixed = large.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("class").alias("first")).where("a <> b").select("key", "first")
    still = cut(large.join(mixed, "key").select("class", "root", "first").distinct())
    if still.isEmpty():
        return None
    groups = common.components(still.select(F.col("class").alias("u"), F.col("first").alias("v")), few).select(F.col("node").alias("class"), F.col("root").alias("group"))
    own = still.select("class", "root").distinct().join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
    own = cut(own.join(kept.select("class", "n"), "class"))
    per = own.groupBy("group", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    main = F.max(F.struct("count", "root", "n"))
    sizes = per.groupBy("group").agg(main.alias("main"), F.sum("count").alias("count"), F.sum("n").alias("n"))

    def pieces(count, n):
        return F.ceil(F.greatest(count / BLOCK, n / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.select("group", F.col("main.root").alias("main"), pieces(F.col("main.count"), F.col("main.n")).alias("inner"),
                         pieces(F.col("count") - F.col("main.count"), F.col("n") - F.col("main.n")).alias("outer"))
    placed = own.join(sizes, "group").withColumn("side", F.col("root") == F.col("main"))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("class", F.lit(5)), F.when(F.col("side"), F.col("inner")).otherwise(F.col("outer"))))
    shingles = texts.join(own.select("class"), "class", "left_semi").mapInArrow(_sets, "class bigint, shingles binary")
    parts = cut(placed.join(shingles, "class").groupBy("group", "side", "piece").agg(F.collect_list(F.struct("class", "root", "shingles")).alias("members")))
    blocks = parts.select("group", "side", "piece")
    pairs = blocks.where("not side").select("group", F.col("piece").alias("p")).join(blocks, "group").where("side or p <= piece")
    one = parts.where("not side").select("group", F.col("piece").alias("p"), F.col("members").alias("left"))
    two = parts.withColumnRenamed("members", "right")
    return cut(pairs.join(one, ["group", "p"]).join(two, ["group", "side", "piece"]).select("left", "right").mapInArrow(_blocks, "u bigint, v bigint"))


def _ends(members: DataFrame, end: str, extreme) -> DataFrame:
    """(u, v): each class with one end of the bucket it shares most tables with, and with the furthest of all its ends."""
    counted = members.where(F.col("class") != F.col(end)).groupBy("class", end).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("class").agg(F.max(F.struct("n", F.col(end).alias("rep"))).alias("most"), extreme(end).alias("far"))
    return best.select(F.col("class").alias("u"), F.explode(F.array_distinct(F.array("most.rep", "far"))).alias("v"))


def _nearest(members: DataFrame, kept: DataFrame, diagonals: tuple[int, ...], step: int) -> DataFrame:
    """(u, v): in the tables of some diagonals of the grid, whose buckets are sorted by a run of minima, each member and the
    nearest one before it of another root. The sort spreads a large bucket over tasks."""
    chosen = members.where(F.pmod(F.col("left") - F.col("right"), F.lit(SIDE)).isin(*diagonals))
    twice = F.concat("minima", "minima")
    begin = F.pmod(4 * F.col("left") + 4 * F.lit(step) + 4, F.lit(2 * ROWS))
    run = F.concat(F.substring(twice, begin + 1, F.lit(24)), F.substring(twice, F.pmod(begin + ROWS, F.lit(2 * ROWS)) + 1, F.lit(24)))
    ordered = chosen.join(kept.select("class", "minima"), "class").select("key", "class", "root", run.alias("run"))
    return ordered.repartitionByRange("key", "run", "class").sortWithinPartitions("key", "run", "class").select("key", "class", "root").mapInArrow(_neighbours, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_shingles, component_id, kept, class, root.

    Rows link when 100 * |A & B| >= 75 * |A | B| over sets of distinct five-word windows. component_id is the smallest
    doc_id reachable. A null or blank text has an empty set and stays alone. Rows that repeat a document share its
    component. A null doc_id counts in the class of its text, never as a smallest id; where a component has no other
    id, component_id is null. kept is component_id = doc_id, both null included.
    """
    profile = cut(profiles(docs))
    roots = class_roots(docs, profile)
    rows = profile.drop("halves", "minima").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
    out = rows.join(lowest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), "class", "root")
