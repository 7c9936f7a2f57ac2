"""Prefix trie of conversations, built level by level and rolled up level by level.

Turns are numbered by ranges of (conversation, turn), so that one endless conversation spans many tasks. Conversations of
equal turns are one class, known by its smallest id; the levels are built over classes. A class that is alone in its node
leaves the levels: the rest of its path is a chain whose counts and savings follow from prefix sums, so there are only as
many levels as different conversations share turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of

#: Conversation ids that are joined to one string before a member list is hashed.
BLOCK = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key, chars, before (code points of the turns in front), of rows with a conv_id.

    Order: turn, null first; equal turns by the digest of role and text; repeated rows are turns of their own. Rows are sorted
    into even ranges; only a conversation that begins in an earlier range needs a carry, at most one for each range.
    """
    role, text = text_of("role"), text_of("text")
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", key.alias("turn_key"), F.char_length(text).cast("long").alias("chars"))
    # repeated rows may fall into any order, so a number of their own only keeps the ranges even
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "trie-rows")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_key").asc(), F.col("row").asc()]
    ranged = materialize(rows.repartitionByRange(ranges, F.col("conv_id").asc(), *order).withColumn("range", F.spark_partition_id()), "trie-ranges")
    parts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("sum"))
    split = parts.groupBy("conv_id").agg(F.min("range").alias("first"), F.max("range").alias("last")).filter("first < last").select("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.join(split, "conv_id", "left_semi").select(F.col("conv_id").alias("c_conv"), F.col("range").alias("c_range"), F.sum("n").over(earlier).alias("c_n"), F.sum("sum").over(earlier).alias("c_sum"))
    carry = materialize(carry.filter("c_n is not null"), "trie-carries")
    inside = Window.partitionBy("range", "conv_id").orderBy(*order)
    pos = F.row_number().over(inside) + F.coalesce("c_n", F.lit(0))
    before = F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars") + F.coalesce("c_sum", F.lit(0))
    known = ranged.join(carry, (F.col("conv_id") == F.col("c_conv")) & (F.col("range") == F.col("c_range")), "left")
    return known.select("conv_id", pos.cast("long").alias("pos"), "turn_key", "chars", before.alias("before"))


def rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and the turns of the rebuilt ones: conv_id, depth, turn_key, chars, upto (code points to here).

    Conversation c takes the first h = crc32(c) % heads turns of conversation c - c % group, then its own behind its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.groupBy("conv_id").agg(F.sum(F.when(F.col("pos") <= h, F.col("chars")).otherwise(0)).alias("skipped")).select("conv_id", h, "skipped")
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "chars", "before"))).alias("first"))
    taken = F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left").select("conv_id", "h", "skipped", taken.alias("taken"))
    convs = materialize(convs, "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "skipped", F.size("taken").alias("m"), F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("sum")), "conv_id")
    own = own.filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "turn_key", "chars", (F.col("before") - F.col("skipped") + F.col("sum") + F.col("chars")).alias("upto"))
    front = convs.select("conv_id", F.explode("taken").alias("t"))
    front = front.select("conv_id", F.col("t.pos").alias("depth"), "t.turn_key", "t.chars", (F.col("t.before") + F.col("t.chars")).alias("upto"))
    return convs.select("conv_id"), materialize(own.unionByName(front), "trie-turns")


def _member_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, conv_id (the smallest), ends: hash of the decimal ids, ascending. Blocks of ids are strings before they meet, and the hash reads block after block: no list of a class's members is ever held."""
    block = F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))
    blocks = rows.groupBy(*keys, block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select(*keys, "block", F.element_at("ids", 1).alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "block")
    schema = ", ".join(f"{k} long" for k in keys) + ", conv_id long, n long, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, smallest, count, state = None, 0, 0, None
        names = [*keys, "conv_id", "n", "ends"]
        for b in batches:
            done = []
            for key, conv, n, ids in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in ("conv_id", "n", "ids")), strict=True):
                if key == now:
                    count += n
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, smallest, count, state.hexdigest()))
                now, smallest, count, state = key, conv, n, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, smallest, count, state.hexdigest())], names=names)

    return dealt.mapInArrow(run, schema)


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct rebuilt conversation: conv_id (its smallest), n (conversations), length, total (code points), ends."""
    item = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "depth", "turn_key"))
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), F.sum("chars").alias("total"), item(1).alias("d1"), item(2).alias("d2"))
    keys = ["length", "total", "d1", "d2"]
    whole = convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in keys])
    return materialize(_member_digest(whole, keys).select("conv_id", "n", "length", "total", "ends"), "trie-classes")


def _saved_behind(chars: Column, upto: Column) -> Column:
    """What the rest of a chain saves: every turn from here to the end, for each conversation but one."""
    return (F.col("n_convs") - 1) * (F.col("total") - upto + chars)


def prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text; other columns may have any names. Null role or text: empty. Rows without a
    conv_id belong to no conversation. Null turns come first; equal turns are ordered by the digest of role and text; repeated
    rows are turns of their own. A turnless rebuilt conversation is a member of the root alone. Texts count whole, at any
    length, in code points. An empty table has no root: the result is empty.
    """
    with scratch(conversations.sparkSession):
        convs, turns = rebuilt(materialize(numbered_turns(conversations), "trie-numbered"), group, heads)
        classes = _classes(convs, turns)
        root = classes.agg(F.min("conv_id")).first()[0]
        steps = turns.join(classes.select("conv_id"), "conv_id", "left_semi")
        # doubling folders: level d reads the one of its power of two
        path = materialize(steps.withColumn("power", F.floor(F.log2("depth")).cast("int")), "trie-steps", partition_by="power")
        live = classes.select("conv_id", F.lit(root).cast("long").alias("node"), "n", "length", "total")
        top = classes.agg(F.sum("n").alias("n_convs")).select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars"))
        levels, ends = [materialize(top.filter("node is not null"), "trie-root")], [live.filter("length = 0").select("node", F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("ends_conv"))]
        while not live.isEmpty():
            depth = len(levels)
            step = live.join(path.filter((F.col("power") == depth.bit_length() - 1) & (F.col("depth") == depth)).drop("power", "depth"), "conv_id").withColumnRenamed("node", "parent")
            # of a node with one class, the maxima are that class's own values
            alone = [F.max(c).alias(c) for c in ("chars", "upto", "length", "total")]
            nodes = step.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("classes"), *alone)
            nodes = materialize(nodes, "trie-level")
            shared = nodes.filter("classes > 1").select("parent", "turn_key", "node")
            live = materialize(step.join(shared, ["parent", "turn_key"]).select("conv_id", "node", "n", "length", "total"), "trie-live")
            levels.append(nodes)
            ends.append(live.filter(F.col("length") == depth).select("node", F.lit(depth).cast("long").alias("depth"), F.col("conv_id").alias("ends_conv")))
        found = _rolled_up(levels, classes, path)
        at = ends[0]
        for more in ends[1:]:
            at = at.unionByName(more)
        at = at.join(classes.select(F.col("conv_id").alias("ends_conv"), F.col("ends").alias("met")), "ends_conv").select("node", "depth", "met")
        found = found.join(at, ["node", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", "met", F.lit(NO_MEMBERS)))
        return materialize(found.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *COLUMNS[3:]), "trie", keep=True)


def _rolled_up(levels: list[DataFrame], classes: DataFrame, steps: DataFrame) -> DataFrame:
    """From the deepest level up, each node takes children, leaves and savings of the next; chains follow from their classes."""
    out = ["node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    below, parts, chains = None, [], []
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].withColumn("depth", F.lit(depth).cast("long"))
        here = nodes if depth == 0 else nodes.filter("classes > 1")
        if below is None:
            here = here.withColumns({"c": F.lit(0).cast("long"), "l": F.lit(0).cast("long"), "s": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            here = here.join(sums, "node", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        here = here.select("node", "depth", "parent", "n_convs", zero("c").alias("n_children"), F.greatest(zero("l"), F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + zero("s")).alias("saved_tokens"), F.lit(None).cast("string").alias("ends"))
        if depth:
            single = nodes.filter("classes = 1").join(classes.select(F.col("conv_id").alias("node"), F.col("ends").alias("own")), "node")
            last = F.col("length") == F.col("depth")
            here = here.unionByName(single.select("node", "depth", "parent", "n_convs", (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), _saved_behind(F.col("chars"), F.col("upto")).alias("saved_tokens"), F.when(last, F.col("own")).alias("ends")))
            chains.append(single.filter(~last).select(F.col("node").alias("conv_id"), F.col("depth").alias("from"), "n_convs", "length", "total", "own"))
        below = materialize(here.select(*out), "trie-rolled")
        parts.append(below)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if not chains:
        return found
    tails = chains[0]
    for more in chains[1:]:
        tails = tails.unionByName(more)
    tails = materialize(tails, "trie-chains").join(steps.select("conv_id", "depth", "chars", "upto"), "conv_id").filter(F.col("depth") > F.col("from"))
    last = F.col("length") == F.col("depth")
    tails = tails.select(
        F.col("conv_id").alias("node"), "depth", F.col("conv_id").alias("parent"), "n_convs", (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        _saved_behind(F.col("chars"), F.col("upto")).alias("saved_tokens"), F.when(last, F.col("own")).alias("ends"),
    )
    return found.unionByName(tails)
