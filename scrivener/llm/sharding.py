"""Sharding by extendible hashing (native: DataFrame and SQL functions only).

The directory is indexed by the leading bits of a 64-bit hash. It starts with no bit, one bucket of all; a bucket over the
byte limit splits on its next bit, the others stay. Sizes are summed per directory entry (a partial aggregation), STEP bits
at a time, so splits are decided on at most 2^STEP numbers of one bucket, never on its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

STEP = 6


def _split(cells: DataFrame, depth: int, deep: int, limit: int) -> DataFrame:
    """cell -> depth of the bucket that holds it, for all cells (numbers of ``deep`` bits); null if still too large there.

    A cell's bucket has the fewest bits, from ``depth`` on, at which the cells that share them fit the limit. One document
    alone always makes a bucket.
    """
    peers = lambda d: f"filter(c, y -> shiftright(y.cell, {deep - d}) = shiftright(x.cell, {deep - d}))"
    fits = lambda d: f"aggregate({peers(d)}, named_struct('b', 0L, 'n', 0L), (a, y) -> named_struct('b', a.b + y.bytes, 'n', a.n + y.n), a -> a.b <= {limit}L or a.n = 1)"
    found = "coalesce(" + ", ".join(f"case when {fits(d)} then {d} end" for d in range(depth, deep + 1)) + ")"
    return (
        cells.groupBy(F.shiftright("cell", deep - depth).alias("top"))
        .agg(F.collect_list(F.struct("cell", "bytes", "n")).alias("c"))  # at most 2^STEP entries
        .select(F.explode(F.expr(f"transform(c, x -> named_struct('cell', x.cell, 'bytes', x.bytes, 'n', x.n, 'depth', {found}))")).alias("x"))
        .select("x.*")
    )


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, carry: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, shard_id (the bucket's bits), depth, shard_bytes, shard_docs, oversize.

    No shard is over ``limit_bytes`` unless it is one document that alone is over (oversize), and every shard's parent is
    over it. Null text has 0 bytes. The first 32 bits are those of the md5 of seed and id (null: as the word null); further
    bits hash the row's number, so repeated or null ids, however many, can be split too. An empty table gives an empty
    result; with one bucket the shard_id is the empty string. ``carry``: the whole input row comes along, as struct ``row``.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    h = F.shiftleft(high, 32).bitwiseOR(F.shiftrightunsigned(low, 32))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), h.alias("h"), *own), "shard-rows")
    done, left, depth = None, rows, 0
    while True:
        deep = min(depth + STEP, 63)
        # cells are numbers of at most 63 bits: never negative
        left = left.withColumn("cell", F.shiftrightunsigned("h", 64 - deep) if deep else F.lit(0).cast("long"))
        cells = left.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        tree = materialize(_split(cells, depth, deep, limit_bytes), "shard-tree")
        if deep == 63:  # all bits are spent
            tree = tree.withColumn("depth", F.coalesce("depth", F.lit(63)))
        leaf = tree.filter("depth is not null").withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = leaf.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        entry = leaf.join(sums, ["depth", "prefix"]).select("cell", "depth", F.expr("case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end").alias("shard_id"), "shard_bytes", "shard_docs")
        here = left.join(entry, "cell").select(
            "doc_id", "n_bytes", "shard_id", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversize"), *(["row"] if carry else [])
        )
        done = here if done is None else done.unionByName(here)
        full = tree.filter("depth is null").select("cell")
        if deep == 63 or full.isEmpty():
            return done
        left, depth = left.join(full, "cell", "left_semi").drop("cell"), deep


def write_shards(docs: DataFrame, limit_bytes: int, path: str, **options) -> None:
    """Write the documents, each row as it is, in one folder for each shard: ``shard=b`` and the bucket's bits.

    Rows carry their documents through the sharding, so null and repeated ids stay what they are. A shard is written by one
    task, which therefore holds no more than the limit or one document. ``docs`` may have no column ``shard``.
    """
    if "shard" in docs.columns:
        raise ValueError("documents have a column named shard already")
    found = shard(docs, limit_bytes, carry=True, **options)
    named = found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.concat(F.lit("b"), "shard_id").alias("shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
