"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its lower-case words between white space. Overlapping k-mers of ``WORDS`` words (a shorter text is one k-mer) are each labelled with how often they have
occurred before. Each of ``SKETCHES`` hash functions picks the ``LEAST`` labelled k-mers with the least hashes and keeps them in text order; texts whose picks agree,
order included, in any function share a bucket and are candidates. That depends on the k-mers that they share and on their order, as edits do.

Candidates are verified by an alignment of their words within the band that the similarity allows: with d words inserted, deleted or replaced at least, the
similarity is 1 - d / (words of the longer text). Texts of similarity ``threshold`` or more are linked; linked texts, directly or by others, form a class. Texts of
k-mer (shingle) similarity ``threshold`` in order have at least that similarity of words, so they are linked too.

Equal word sequences are one class from the start. In a bucket, every member is verified against the bucket's first and last member, which is a number of
pairs in proportion to the rows; that is every pair of a bucket of up to three. In larger buckets, members that are not yet in the bucket's largest component are
held against all members of like length, in cells of bounded size: a cell counts the words that two texts share by a product of incidence matrices, and aligns the
pairs that share enough and are not connected yet, those of most shared words first, each pair in the first bucket that it shares. The counts are exact for texts of
any length, so no pair of a bucket is lost; a cell returns links between components alone, so no group is expanded into its pairs.

Null and empty texts and texts without words link with nothing and are kept. Repeated rows are copies of each other. Rows without an id take part; the row that a
class keeps is that of its least id. Texts of any length are read whole; an empty table gives no rows. Other columns are left behind, whatever their names, but for
``deduplicated``, which returns them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import documents, drop_written, even_join, map_arrow, mark, mix64, ship, written
from corridor.llm.components import components

WORDS, SKETCHES, LEAST = 5, 24, 3
#: Texts and words a side of a cell has at most (one text at least).
TILE, TILE_WORDS = 512, 1 << 18
BROADCAST = 300_000
SKETCH = "uid long, doc_id long, text_hash long, key binary, grade int, picks array<long>, words binary"
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64), 11)[:, None]
_ODD = np.uint64(0x9FB21C651E98DF25)
#: Lengths of a grade differ by less than this factor, the least similarity; so texts that may be similar are of the same grade or the next. A node's id ends in its grade.
RATIO, GRADES = 0.8, 128


def words_of(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def numbered(words: bytes) -> np.ndarray:
    """A number for every word."""
    return np.fromiter(map(zlib.crc32, words.split(b" ")), np.uint32) if words else np.zeros(0, np.uint32)


def occurrences(h: np.ndarray) -> np.ndarray:
    """Hashes mixed with how often each has occurred before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        at = np.arange(len(s))
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], at, 0))
        times = np.zeros(len(s), np.uint64)
        times[order] = (at - first).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = np.where(times > 0, mix64(h + times * _ODD), h)
    return h


def labelled(w: np.ndarray) -> np.ndarray:
    """Hashes of the labelled k-mers of numbered words, in text order."""
    if not len(w):
        return np.zeros(0, np.uint64)
    w = w.astype(np.uint64)
    k = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = h * _ODD + w[i : len(w) - k + 1 + i] + np.uint64(1)
    return occurrences(mix64(h))


def sketch(h: np.ndarray) -> np.ndarray:
    """The picks of every function, in text order, as one number each."""
    size = min(LEAST, len(h))
    picks = np.empty(SKETCHES, np.int64)
    step = max(1, min(SKETCHES, (1 << 20) // len(h)))
    for lo in range(0, SKETCHES, step):
        with np.errstate(over="ignore"):
            x = (h[None, :] ^ _SEEDS[lo : lo + step]) * _ODD
            x ^= x >> np.uint64(31)
            x *= _ODD
        at = np.argpartition(x, size - 1, axis=1)[:, :size] if size < len(h) else np.tile(np.arange(len(h)), (len(x), 1))
        with np.errstate(over="ignore"):
            value = np.zeros(len(x), np.uint64)
            for k in np.sort(at, axis=1).T:
                value = mix64(value * _ODD + h[k], 3)
        picks[lo : lo + step] = value.view(np.int64)
    return picks


def distance(a: list[int], b: list[int], most: int) -> int:
    """The least number of words to insert, delete or replace, if it is at most ``most``; else any number beyond. a is the longer one, by ``most`` at most.

    The alignment stays within ``most`` of the diagonal. A column of that band is two numbers, whose bits tell where the distance rises or falls by one from row to row;
    adding and shifting whole numbers takes a column to the next.
    """
    width = 2 * most + 1
    full, edge = (1 << width) - 1, 1 << (width - 1)
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    rises, falls, here = ((1 << (most + 1)) - 1) << most, 0, most
    limit, below = 2 * most + len(b) - len(a), edge >> 1
    for j, x in enumerate(b):
        same = at.get(x, 0)
        same = (same >> (j - most) if j >= most else same << (most - j)) & full
        free = (((same & rises) + rises) ^ rises) & full | same | falls
        across_up = (falls | ~(free | rises)) & full
        across_down = free & rises
        if j < len(a) - most:
            here += not free & edge
        else:
            here += bool(across_up & below) - bool(across_down & below)
            below >>= 1
        if here > limit:
            return most + 1
        shifted = free >> 1
        rises = (across_down | ~(shifted | across_up)) & full
        falls = shifted & across_up
    return here


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """The similarity of two texts of numbered words if it is at least the threshold, else 0."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    longer, most = len(a), int((1 - threshold) * len(a) + 1e-9)
    if not len(b) or longer - len(b) > most:
        return 0.0
    differ = np.flatnonzero(a[: len(b)] != b)
    head = int(differ[0]) if len(differ) else len(b)
    differ = np.flatnonzero(a[::-1][: len(b) - head] != b[::-1][: len(b) - head])
    tail = int(differ[0]) if len(differ) else len(b) - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    d = len(a) if not len(b) else distance(a.tolist(), b.tolist(), min(most, len(a)))
    return 1 - d / longer if d <= most else 0.0


def sketches(docs: DataFrame) -> DataFrame:
    """A row per row of docs in the columns of ``SKETCH``; key and what follows are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("grade", pa.int32()), ("picks", pa.list_(pa.int64())), ("words", pa.binary())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, keys, grades, picks, numbers = batch.slice(lo, 1024), [], [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    w = numbered(words)
                    keys.append(hashlib.blake2b(words, digest_size=16).digest() if words else None)
                    grades.append(grade(len(w)) if words else None)
                    picks.append(sketch(labelled(w)) if words else None)
                    numbers.append(w.astype("<u4").tobytes() if words else None)
                uids = pa.array(range(uid, uid + part.num_rows), pa.int64())
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays([uids, part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(grades, pa.int32()), pa.array(picks, pa.list_(pa.int64())), pa.array(numbers, pa.binary())], schema=schema)

    return map_arrow(documents(docs).withColumn("text_hash", F.xxhash64("text")), run, SKETCH)


def grade(n: int) -> int:
    return int(np.log(n) / np.log(1 / RATIO) + 1e-9)


def grade_of(node: Column | str) -> Column:
    return F.pmod(F.col(node) if isinstance(node, str) else node, F.lit(GRADES))


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most BROADCAST rows; else joins deal both sides out."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b: nodes) whose texts are similar."""
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    found = written(words.join(small(ends), "node", "left_semi"), "texts")
    left, right = found.toDF("a", "words_a"), found.toDF("b", "words_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()

        def read(node: int, data: pa.Scalar) -> np.ndarray:
            if node not in known:
                known[node] = np.frombuffer(data.as_py(), "<u4")
                if len(known) > 64:
                    known.popitem(last=False)
            return known[node]

        for batch in batches:
            a, b, wa, wb = batch.columns
            keep = [similarity(read(x, y), read(u, v), threshold) >= threshold for x, y, u, v in zip(a.to_pylist(), wa, b.to_pylist(), wb, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = even_join(even_join(pairs, left, ["a"]), right, ["b"], spread=["a"], sizes=pairs.groupBy("b").agg(F.count("*").alias("rows")))
    return written(map_arrow(both.select("a", "b", "words_a", "words_b"), run, "a long, b long"), "links")


def shared(sides: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """How many numbers each set of one side shares with each of the other, by products of incidence matrices over the numbers that both sides have."""
    flat = [np.concatenate(own) if own else np.zeros(0, np.uint64) for own in sides]
    rows = [np.repeat(np.arange(len(own)), [len(x) for x in own]) for own in sides]
    common = np.intersect1d(*flat)
    out = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    places = [np.searchsorted(common, x) for x in flat]
    known = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for p, x in zip(places, flat, strict=True)]
    for lo in range(0, len(common), 4096):
        parts = []
        for own, r, p, k in zip(sides, rows, places, known, strict=True):
            part = np.zeros((len(own), 4096), np.float32)
            inside = k & (p >= lo) & (p < lo + 4096)
            part[r[inside], p[inside] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def top(root: dict[int, int], x: int) -> int:
    while (up := root.setdefault(x, x)) != x:
        root[x] = x = root[up] if up in root else up
    return x


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def resolved(cell: pa.Table, threshold: float) -> pa.Table:
    """Links between components of a cell's texts, as many as connect what its similar pairs connect. Columns: side (0: to be held against all of side 1), band, node, component, outside, own, picks, words."""
    side, node, component, outside, own = (cell[c].to_numpy(zero_copy_only=False) for c in ("side", "node", "component", "outside", "own"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return LINKS.empty_table()
    words = [np.frombuffer(x, "<u4") for x in cell["words"].to_pylist()]
    n = np.array([len(w) for w in words])
    a, b = n[left][:, None], n[right][None, :]
    longer = np.maximum(a, b)
    most = np.floor((1 - threshold) * longer + 1e-9)
    ok = (component[left][:, None] != component[right]) & (own[left][:, None] | own[right]) & (np.abs(a - b) <= most)
    ok &= ~outside[right] | (node[left][:, None] < node[right])  # both would otherwise be on both sides
    if not ok.any():
        return LINKS.empty_table()
    picks = cell["picks"].combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
    band, earlier = cell["band"][0].as_py(), np.zeros(ok.shape, bool)
    for k in range(band):
        earlier |= picks[left, k][:, None] == picks[right, k]
    ok &= ~earlier  # a pair belongs to the first bucket that it shares
    sets = [occurrences(mix64(words[k].astype(np.uint64), 5)) for k in (*left, *right)]
    counts = shared((sets[: len(left)], sets[len(left) :]))
    x, y = np.nonzero(ok & (counts >= longer - most))
    order = np.argsort(-(counts[x, y] / longer[x, y]), kind="stable")
    root: dict[int, int] = {}
    links = []
    for p, q in zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True):
        u, v = top(root, component[p]), top(root, component[q])
        if u != v and similarity(words[p], words[q], threshold) >= threshold:
            root[u] = v
            links.append((node[p], node[q]))
    return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())}, schema=LINKS)


def resolving(threshold: float):
    return lambda cell: resolved(cell, threshold)


def between(members: DataFrame, found: DataFrame, nodes: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of a bucket's members. members: band, pick, node, size."""
    keys = ["band", "pick", "grade"]
    own = members.join(found, "node", "left").select("band", "pick", "node", F.coalesce("component", "node").alias("component"))
    places = F.array(F.struct(grade_of("node").alias("grade"), F.lit(True).alias("own")), F.struct((grade_of("node") + 1).alias("grade"), F.lit(False).alias("own")))
    graded = written(own.withColumn("p", F.explode(places)).select("band", "pick", "node", "component", "p.grade", "p.own"), "graded")
    parts = graded.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.bool_or("own").alias("own"))
    groups = parts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("component", "n").alias("largest"), F.bool_or("own").alias("own")).where("own AND rows > most").drop("own")
    groups = written(groups, "groups")
    rows = F.greatest(F.lit(1.0), F.least(F.lit(float(TILE)), F.lit(float(TILE_WORDS)) * F.pow(F.lit(RATIO), F.col("grade") + 1)))
    blocks = lambda n: F.ceil(n / F.floor(rows)).cast("long")
    groups = groups.select(*keys, "rows", "largest", blocks(F.col("rows") - F.col("most")).alias("across"), blocks(F.col("rows")).alias("down"))
    mixed = even_join(graded, groups.drop("rows"), keys, sizes=groups).withColumn("outside", F.col("component") != F.col("largest"))
    wanted = small(written(mixed.select("node").distinct(), "wanted"))
    texts = written(words.join(wanted, "node", "left_semi").join(nodes.select("node", "picks").join(wanted, "node", "left_semi"), "node"), "texts")
    full = mixed.join(texts, "node").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = full.where("outside").withColumns({"side": F.lit(0), "i": F.pmod("h", "across"), "j": every("down")})
    second = full.withColumns({"side": F.lit(1), "i": every("across"), "j": F.pmod("h", "down")})
    columns = [*keys, "i", "j", "side", "node", "component", "outside", "own", "picks", "words"]
    ship(members.sparkSession)
    return written(first.select(*columns).union(second.select(*columns)).groupBy(*keys, "i", "j").applyInArrow(resolving(threshold), "a long, b long"), "links")


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """uid, doc_id, text_hash (xxhash64), class_id (least doc_id of the class), kept, of every row."""
    if not RATIO <= threshold <= 1:
        raise ValueError(f"thresholds are from {RATIO} to 1")
    spark, since = docs.sparkSession, mark()
    rows = written(sketches(docs), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("class_id"), F.col("uid").alias("first"))).alias("head")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), head, F.first("grade").alias("grade"), F.first("picks").alias("picks"))
    nodes = written(nodes.select("key", (F.col("uid") * GRADES + F.col("grade")).alias("node"), "copies", "head", "picks"), "nodes")
    words = rows.where("key IS NOT NULL").select((F.col("uid") * GRADES + F.col("grade")).alias("node"), "words")
    picks = nodes.select("node", F.posexplode("picks").alias("band", "pick"))
    buckets = picks.groupBy("band", "pick").agg(F.count("*").alias("rows"), F.min("node").alias("first"), F.max("node").alias("last")).where("rows > 1")
    buckets = written(buckets, "buckets")
    members = even_join(picks, buckets.withColumn("size", F.col("rows")).drop("rows"), ["band", "pick"], spread=["node"], sizes=buckets)
    members = written(members, "members")
    drop_written(spark, since, rows, nodes, members)
    pairs = members.select("node", F.explode(F.array("first", "last")).alias("end")).where((F.col("node") != F.col("end")) & (F.abs(grade_of("node") - grade_of("end")) <= 1))
    pairs = written(pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct(), "pairs")
    links = verified(pairs, words, threshold)
    found = components(links)
    drop_written(spark, since, rows, nodes, members, links, found)
    more = between(members.where("size > 3").select("band", "pick", "node"), found, nodes, words, threshold)
    drop_written(spark, since, rows, nodes, links, found, more)
    if not more.isEmpty():
        found = components(links.union(more))
    rooted = written(nodes.select("key", "node", "head").join(found, "node", "left").select("key", "head", F.coalesce("component", "node").alias("root")), "roots")
    heads = rooted.groupBy("root").agg(F.min("head").alias("best"), F.count("*").alias("rows"))
    heads = written(heads, "heads")
    decided = written(even_join(rooted.select("root", "key"), heads.select("root", "best"), ["root"], sizes=heads).select("key", "best.class_id", "best.first"), "decided")
    own = rows.select("uid", "doc_id", "text_hash", "key")
    sizes = nodes.select("key", F.col("copies").alias("rows"))
    held = even_join(own.where("key IS NOT NULL"), decided, ["key"], spread=["uid"], sizes=sizes).select("uid", "doc_id", "text_hash", "class_id", (F.col("first") == F.col("uid")).alias("kept"))
    out = written(held.unionByName(own.where("key IS NULL").select("uid", "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))), "classes")
    drop_written(spark, since, out)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, kept of every row."""
    return classes(docs, threshold).select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The kept rows of docs, with all columns; of repeated rows one."""
    own = classes(docs, threshold).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"))
    own = written(own.where("NOT _kept OR _n > 1"), "copies")
    name = "_hash"
    while name.lower() in (c.lower() for c in docs.columns):  # the caller's columns keep their names and values
        name += "_"
    rows = docs.withColumn(name, F.xxhash64(docs["text"].cast("string")))

    def joined(keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, (rows[name] == keys["_text"]) & rows["doc_id"].cast("long").eqNullSafe(keys["_id"]), how)

    out = joined(small(own.select("_id", "_text")), "left_anti")
    repeated = written(own.where("_kept").select("_id", "_text"), "repeated")
    if not repeated.isEmpty():
        out = out.union(joined(small(repeated), "left_semi").dropDuplicates(["doc_id", name]))
    return out.drop(name)
