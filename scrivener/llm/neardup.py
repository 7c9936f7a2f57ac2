"""Near-duplicate documents by ProbMinHash over shingles, banding and exact verification.

A shingle is five words. Every shingle sends Poisson arrivals, at a rate of its weight, into random components of the
signature; a component keeps the shingle that arrives first, so two components agree with the probability Jaccard
similarity. Every distinct shingle weighs 1: that is the Jaccard similarity of the sets, the measure of the classes. (With
counts as weights, copies that repeat a line a different number of times would not meet.) A shingle stops as soon as its next arrival is later than the latest
component (early termination). Bands of components give candidates, exact Jaccard similarity of the shingle sets verifies
them, and verified links join documents into classes.

No bucket is expanded into its pairs: exact copies are one representative, each member of a bucket is compared with the
bucket's hub, and only members whose class differs from the hub's after that are compared with others of their bucket, with
further hubs first. What is left open is settled by prefixes: of two sets that are near enough, the rarest shingles of both
share one, so members of a bucket meet only where they share a rare shingle, and no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, scratch, text_of

SHINGLE, SIMILARITY = 5, 0.8
#: Pairs at Jaccard similarity s of their shingle sets meet in a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8, 0.02 at 0.3.
BANDS, ROWS = 28, 6
#: Words that are worked on at once: a bound of memory, save for one longer document.
CHUNK_WORDS = 300_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _U(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the end): words are lower-cased runs without ASCII white space."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    change = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    begin, end = change[::2], change[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    h = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    at = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    return h, np.searchsorted(begin, at)


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles, sorted by text and hash; and a hash of all words of each text, 0 without words.

    A text of fewer words than the width has one shingle: all of them.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - at[:-1][doc]
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    s = np.zeros(len(h), np.uint64)
    for k in range(width):
        s = _mix(s * _U(0x2545F4914F6CDD1D) + np.where(place + k < n[doc], padded[k : k + len(h)], _U(k)))
    whole = np.zeros(len(texts), np.uint64)
    if len(h):
        parts = _mix(h + place.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        sums = np.concatenate([[_U(0)], np.cumsum(parts, dtype=np.uint64)])
        whole = np.where(n > 0, _mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)), _U(0))
    use = (place + width <= n[doc]) | (place == 0)
    doc, s = doc[use], s[use]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], s[first], np.diff(np.concatenate([first, [len(s)]])), whole


def signatures(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, docs: int, components: int) -> np.ndarray:
    """ProbMinHash: for every text and component the shingle of the first arrival; docs x components."""
    earliest = np.full(docs * components, np.inf)
    winner = np.zeros(docs * components, np.uint64)
    sizes = np.bincount(doc, minlength=docs)
    alone = sizes[doc] == 1  # a single shingle wins everywhere
    winner.reshape(docs, components)[doc[alone]] = s[alone, None]
    d, e, w, time = doc[~alone], s[~alone], weight[~alone].astype(float), np.zeros((~alone).sum())
    step = 0
    while len(d):
        step += 1
        z = _mix(e + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((z >> _U(11)).astype(float) + 1) * 2.0**-53) / w
        slot = d * components + (((_mix(z) >> _U(32)) * _U(components)) >> _U(32)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = e[won]
        active = time < earliest.reshape(docs, components).max(1)[d]
        d, e, w, time = d[active], e[active], w[active], time[active]
    return winner.reshape(docs, components)


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    out = np.empty((len(signature), n_bands), np.uint64)
    for b in range(n_bands):
        key = np.full(len(signature), _U(b + 1))
        for r in range(rows):
            key = _mix(key * _U(0x2545F4914F6CDD1D) + signature[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > 6 * CHUNK_WORDS:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _sketch(n_bands: int, rows: int):
    def run(batch: dict[str, list], _: int) -> Iterator[tuple[range, dict]]:
        texts = batch["text"]
        for i, j in _chunks(texts):
            doc, s, weight, whole = shingles(texts[i:j])
            keys = bands(signatures(doc, s, np.ones(len(s)), j - i, n_bands * rows), n_bands, rows)
            sizes = np.bincount(doc, minlength=j - i).astype(np.int32)
            check = np.zeros(j - i, np.uint64)
            np.add.at(check, doc, _mix(s * weight.astype(np.uint64) + _U(1)))
            yield range(i, j), {"key": whole.view(np.int64), "key2": check.view(np.int64), "size": sizes, "bands": list(keys)}

    return run


def _sets(batch: dict[str, list], _: int) -> Iterator[tuple[range, dict]]:
    texts = batch["text"]
    for i, j in _chunks(texts):
        doc, s, _, _ = shingles(texts[i:j])
        yield range(i, j), {"shingles": np.split(s.view(np.int64), np.searchsorted(doc, np.arange(1, j - i)))}


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the least node of its connected component.

    Alternating large-star and small-star steps, each an aggregation and a join; the edges are written out after each.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        both = materialize(e.union(e.select("b", "a")).toDF("u", "v"), "star")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-least")
        # large star: every larger neighbour goes to the least neighbour
        e = materialize(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct(), "large-star")
        # small star: every smaller neighbour, and the node, go to the least one
        least = materialize(e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "small-least")
        moved = e.withColumnRenamed("b", "u").join(least, "u")
        e = materialize(moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select("m", "u")).filter("a <> b").distinct(), "small-star")
        if e.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and e.groupBy("b").count().filter("count > 1").isEmpty():
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())


def _near(big: str, small: str) -> str:
    return f"least({big}, {small}) >= {SIMILARITY}D * greatest({big}, {small})"


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILARITY.

    Nothing follows the joins that needs their partitioning, so that adaptive execution can split the pairs of a hot hub.
    """
    one = pairs.join(sets.toDF("b", "sb"), "b")
    two = one.join(sets.toDF("a", "sa"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return materialize(two.filter(shared >= SIMILARITY * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id and the text."""
    return [F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("digest")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each input row: doc_id, class_id, copy_of, kept.

    class_id: the least id of the document's class, the connected component of exact copies and of links between documents
    whose sets of five-word shingles (lower-cased words) have a Jaccard similarity of 0.8 or more. copy_of: the least id
    with the same words. kept: the document is the first of its class by id, then by md5 of the text; rows without an id come
    last. Rows equal in id and text are one document and have the same result; rows that share an id but not the text are
    documents of their own. Ids may have any type that can be ordered. Null, empty and blank texts are classes of their own,
    kept. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        found = _classes(docs, id_col, text_col, n_bands, rows)
        return materialize(found.drop("digest"), "near-duplicates", keep=True)


def _first() -> Column:
    """The least (id, digest), rows without an id last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))


def _classes(docs: DataFrame, id_col: str, text_col: str, n_bands: int, rows: int) -> DataFrame:
    texts = docs.select(*_row_key(id_col, text_col), text_of(text_col).alias("text"))
    sketched = materialize(in_arrow(texts, _sketch(n_bands, rows), "key long, key2 long, size int, bands array<long>", ["doc_id", "digest"]), "sketches")
    same = ["key", "key2", "size"]  # 128 bits and the number of shingles
    grouped = sketched.filter("size > 0").groupBy(*same).agg(_first().alias("named"), F.first("bands").alias("bands"))
    # a number of its own stands for each text
    reps = materialize(grouped.select("*", F.monotonically_increasing_id().alias("rep")), "representatives")
    members = reps.select("rep", "size", F.explode("bands").alias("band"))
    shared = materialize(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    inside = materialize(members.join(shared, "band"), "members")
    # the original of many edited copies meets more documents than any copy does: the most popular member makes the best hub
    popular = materialize(inside.groupBy("rep").agg(F.sum("n").alias("popularity")), "popularity")
    inside = materialize(inside.drop("n").join(popular, "rep").withColumn("order", F.struct("popularity", -F.col("rep"))), "ordered-members")
    named = materialize(reps.join(popular, "rep").select("rep", F.col("named.doc_id").alias("n_id"), F.col("named.digest").alias("n_digest")), "named")
    # as many texts move at every size
    wanted = texts.join(named.hint("merge"), (F.col("digest") == F.col("n_digest")) & F.col("doc_id").eqNullSafe(F.col("n_id"))).select("rep", "text")
    sets = materialize(in_arrow(wanted, _sets, "shingles array<long>", ["rep"]), "sets")
    if sets.count() > named.count():  # rows that repeat an id and a text
        sets = materialize(sets.dropDuplicates(["rep"]), "distinct-sets")
    hubs = materialize(inside.groupBy("band").agg(F.max_by(F.struct("rep", "size"), "order").alias("h")).select("band", F.col("h.rep").alias("h"), F.col("h.size").alias("h_size")), "hubs")
    pairs = _ordered(inside.join(hubs, "band").filter("rep <> h").filter(_near("size", "h_size")).select("rep", "h"))
    tested = materialize(pairs, "pairs")
    links = _verify(tested, sets)
    for last in (False, False, True):
        roots = materialize(components(links), "roots")
        placed = materialize(inside.join(roots, F.col("rep") == F.col("node"), "left").select("band", "rep", "size", "order", F.coalesce("root", "rep").alias("root")), "placed")
        # buckets of more than one class; the first class is that of the most popular member
        open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", "order").alias("first")).filter("low <> high")
        left = materialize(placed.join(materialize(open_.select("band", "first"), "open-buckets"), "band"), "open-members")
        if last:
            pairs = _open_pairs(left, sets)
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "last-pairs")
            if not pairs.isEmpty():
                links = links.union(_verify(pairs, sets))
            break
        odd = left.filter("root <> first")
        # other hubs: one of the first class, and the most popular of the others
        hubs = left.groupBy("band", (F.col("root") == F.col("first")).alias("_")).agg(
            F.when(F.first("root") == F.first("first"), F.min_by(F.struct("rep", "size", "root"), F.xxhash64("rep", "band"))).otherwise(F.max_by(F.struct("rep", "size", "root"), "order")).alias("h"))
        new = odd.join(materialize(hubs.select("band", F.col("h.rep").alias("h"), F.col("h.size").alias("h_size"), F.col("h.root").alias("h_root")), "hubs"), "band")
        new = _ordered(new.filter("root <> h_root").filter(_near("size", "h_size")).select("rep", "h"))
        new = materialize(new.join(tested, ["a", "b"], "left_anti"), "new-pairs")
        if not new.isEmpty():
            links = links.union(_verify(new, sets))
            tested = tested.union(new)
    roots = materialize(components(links), "roots")
    classes = reps.join(roots, F.col("rep") == F.col("node"), "left").select(*same, "named", F.coalesce("root", "rep").alias("root"))
    classes = materialize(classes, "classes")
    firsts = classes.groupBy("root").agg(F.min("named").alias("first"))
    placed = materialize(classes.join(firsts, "root").select(*same, "named", "first"), "placed-texts")
    found = sketched.filter("size > 0").join(placed, same).select(
        "doc_id", "digest", F.col("first.doc_id").alias("class_id"), F.col("named.doc_id").alias("copy_of"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("kept"),
    )
    blank = sketched.filter("size = 0").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(True).alias("kept"))
    return found.unionByName(blank)


def _open_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that members of buckets of more than one class may still form: of different classes, with a common
    shingle among their rarest, and enough shingles left behind it.

    Ordered by how many of these documents have a shingle, sets of sizes s and t with a Jaccard similarity of J or more share
    one among the first s - ceil(J s) + 1 and t - ceil(J t) + 1; if the first that they share stands behind p and q others,
    they share min(s - p, t - q) at most, and they must share J / (1 + J) (s + t). A passage that many documents hold is last
    in this order, and edits that no other document has take up the places of a text that is near to nothing: neither makes
    pairs, however large the buckets are.
    """
    odd = F.max((F.col("root") != F.col("first")).cast("int")).alias("odd")
    reps = materialize(left.groupBy("rep", "size", "root").agg(odd), "open-texts")
    own = materialize(sets.join(reps.select("rep"), "rep", "left_semi").select("rep", F.explode("shingles").alias("s")), "open-shingles")
    counts = materialize(own.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "common-shingles")
    # a shingle of one document can't be shared: it takes a place but makes no pair
    ranked = own.join(counts, "s", "left").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "s"))).alias("all"))
    places = F.size("all") - F.ceil(SIMILARITY * F.size("all") - 1e-9).cast("int") + 1
    prefix = ranked.select("rep", F.posexplode(F.slice("all", F.lit(1), places)).alias("p", "x")).filter("x.n > 1").select("rep", "p", F.col("x.s").alias("s"))
    keyed = materialize(reps.join(prefix, "rep").withColumn("room", F.col("size") - F.col("p")), "open-keys")
    x, y = keyed.filter("odd = 1").alias("x"), keyed.alias("y")
    enough = F.least("x.room", "y.room") >= SIMILARITY / (1 + SIMILARITY) * (F.col("x.size") + F.col("y.size")) - 1e-9
    met = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.odd") == 0) | (F.col("x.rep") < F.col("y.rep"))) & enough
    return _ordered(x.join(y, met).select(F.col("x.rep"), F.col("y.rep")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each class, with all their columns; of rows equal in id and text one stays."""
    with scratch(docs.sparkSession):
        kept = _classes(docs, id_col, text_col, BANDS, ROWS).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        kept = materialize(kept, "kept-rows")
        distinct = materialize(kept.distinct(), "kept-keys", keep=True)
        repeated = kept.count() > distinct.count()
    # the row as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_key"), F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")))).alias("_text"))
    same = (F.col("_text") == F.col("_digest")) & F.col("_key").eqNullSafe(F.col("_id"))
    out = rows.join(distinct.hint("merge"), same, "left_semi")  # the same plan at every size
    out = out.dropDuplicates(["_key", "_text"]) if repeated else out
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
