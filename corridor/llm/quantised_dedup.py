"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Exact copies (equal label and components) form a class first, so that a vector that fills a third of the table is compared once. The classes of a label are
dealt into blocks of bounded size, and every pair of blocks is a tile. Unit vectors u are rounded to s*q with q in int8; with e = |u - s*q|, the cosine of
two vectors differs from the product of the rounded ones by at most e1 + (1 + e1) * e2. Only pairs whose product and bound reach the threshold are
computed again in double precision. A tile returns, for each of its vectors, the number of vectors that it links with and the least one that it is
connected with inside the tile: no list of pairs, however many links a group has.

Tiles get components as the table has them, four bytes each where it has floats: they are exact, and tiles round them themselves. A class is known by two
64-bit hashes of its label and components, so no join or sort carries vectors as keys.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing: no links, a component of their
own. Vectors of different lengths don't link. Rows of one id count as vectors of their own in n_links and share a component; a row without an id takes no
part and gets a null component. An empty table gives no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.llm.common import drop_written, even_join, mark, ship, written
from corridor.llm.components import components
from corridor.llm.topk_search import matrix, usable

BLOCK, STRIP = 8192, 256
TILE = "node long, links long, root long"


class Quantised:
    def __init__(self, x: np.ndarray) -> None:
        big = np.abs(x).max(1, keepdims=True)
        self.x = x / big  # keeps squares in range; the cosine stays
        self.norm = np.sqrt((self.x**2).sum(1))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.scale[:, None] * self.q) ** 2).sum(1)) + 1e-12


def links(a: Quantised, b: Quantised, threshold: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows lo..hi of a and all rows of b whose cosine reaches the threshold."""
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers below are exact
    product = (a.q[lo:hi].astype(kind) @ b.q.astype(kind).T) * a.scale[lo:hi, None] * b.scale
    e = a.error[lo:hi, None]
    i, j = np.nonzero(product + e + (1 + e) * b.error + 1e-9 >= threshold)
    keep = [np.einsum("ij,ij->i", a.x[lo + i[t : t + 65536]], b.x[j[t : t + 65536]]) / (a.norm[lo + i[t : t + 65536]] * b.norm[j[t : t + 65536]]) >= threshold for t in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return lo + i[keep], j[keep]


def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lets every position point at the least position that it is connected with, by the links i, j besides those before."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def tile(nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, block: np.ndarray, same: bool, threshold: float) -> pa.Table:
    order = np.argsort(nodes, kind="stable")
    nodes, copies, x, block = nodes[order], copies[order], x[order], block[order]
    root, counts = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    left = np.arange(len(nodes)) if same else np.flatnonzero(block == block.min())
    right = left if same else np.flatnonzero(block != block.min())
    if len(left) and len(right):
        a = Quantised(x[left])
        b = a if same else Quantised(x[right])
        for lo in range(0, len(left), STRIP):
            i, j = links(a, b, threshold, lo, min(lo + STRIP, len(left)))
            i, j = left[i], right[j]
            i, j = (i[i != j], j[i != j]) if same else (i, j)
            np.add.at(counts, i, copies[j])
            if not same:
                np.add.at(counts, j, copies[i])
            join(root, i, j)
    linked = counts > 0
    return pa.table({"node": nodes[linked], "links": counts[linked], "root": nodes[root[linked]]}, schema=pa.schema([(n, pa.int64()) for n in ("node", "links", "root")]))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vec_id, embedding, label."""
    spark, since = vectors.sparkSession, mark()
    narrow = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    v = vectors["embedding"] if narrow else vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"), vectors["label"].cast("string").alias("label"))
    able = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"v": F.when(able, F.transform("v", lambda x: x + F.lit(0).cast("float" if narrow else "double"))), "label": F.when(able, F.col("label"))})  # no negative zeros
    rows = rows.withColumns({f"k{n}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(n), "label", "v")) for n in (1, 2)})
    classes = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"), F.count("*").alias("rows"))
    dealt = even_join(classes.select("label", "dim", "k1", "node", "copies", "v"), sizes, ["label", "dim"], spread=["node"], sizes=sizes).withColumn("block", F.pmod(F.col("k1"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "v", "block")
    ship(spark)

    def run(group: pa.Table) -> pa.Table:
        return tile(group["node"].to_numpy(), group["copies"].to_numpy(), matrix(group["v"]).astype(np.float64), group["block"].to_numpy(), group["i"][0].as_py() == group["j"][0].as_py(), threshold)

    tiles = written(dealt.groupBy("label", "dim", "i", "j").applyInArrow(run, TILE), "tiles")
    found = components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.select("k1", "k2", "node", "copies").join(counts, "node", "left").join(found, "node", "left")
    own = written(own.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component")), "per_class")
    keyed, alone = rows.where("k1 IS NOT NULL").select("vec_id", "k1", "k2"), rows.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    sizes = classes.select("k1", "k2", F.col("copies").alias("rows"))
    out = written(even_join(keyed, own, ["k1", "k2"], sizes=sizes).select("vec_id", "n", "component").unionByName(alone), "linked")
    drop_written(spark, since, out)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
