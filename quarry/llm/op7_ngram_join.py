"""N-gram Jaccard self-join with a prefix tree.

Documents become sets of word n-grams (64-bit hashes). All sets follow one global order, rare n-grams
first, from counts over all documents. Two sets at or above the threshold share at least EXTRA of their
first n - ceil(t * n) + EXTRA elements (fewer for tiny sets), so only those prefixes are compared:

1. Equal sets fall together by fingerprint; one representative of each goes on.
2. Prefix elements are grouped; each document proposes one partner, the one it meets most often as head
   of a group or as neighbour in it by size. Proposals grow with the documents, not with pairs in a group.
3. A proposal is verified on the whole texts: partners' sets are stored in a trie in global order, and the
   other set traverses it, sharing the overlap of common beginnings and pruning subtrees whose
   remaining length cannot reach the threshold.
4. Verified links give components. Where a group spans components, its member with the fewest unshared prefix
   elements is proposed to the others, which joins what first proposals left apart. Pairs in different components that share as many prefix elements as a
   link of sets of their sizes needs are then verified too, so no component is left unmerged; pairs within
   one component need no test, which keeps a group of near copies from costing its square. Before a pair
   becomes a row, parity bitmaps of the whole sets bound its overlap from above (each bit that differs is an
   element of only one set), so pairs below the threshold are not made.

Nothing of all documents reaches the driver but the table of counts, 2**BITS_MOST bytes at most, whose size is
fixed by construction (about 64 counters a document below that). Id lists are broadcast only up to
FEW bytes and joined by shuffle beyond.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; a
text of fewer than ``words`` words is one n-gram; rows with a null id take no part in linking and get a
null component; rows that repeat an id are one document (equal texts) and each get its component.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, numbered

EXTRA = 4
BITS_LEAST, BITS_MOST, CHUNK = 16, 24, 1 << 16
FEW = 16 << 20  # bytes of ids that are broadcast
HOT = 100_000  # at most so many groups of equal sets are joined by broadcast: those with more than a HOT-th of the rows
GROUP = 256
BATCH = 1000  # rows of an Arrow batch: whole texts, some very long
PARITY = 8  # 64-bit words of a set's parity bitmap

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``, A-Z lower-cased."""
    raw = np.frombuffer(data, np.uint8)
    live = ~_BLANK[raw]
    step = np.diff(live.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def ngram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The n-gram set of each text, as ascending hashes."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        parts, size, begin = [], 0, at
        while at < len(texts) and (not parts or size < 1 << 19):
            data = (texts[at] or "").encode()
            parts.append(data)
            size += len(data) + 1
            at += 1
        hashes, starts = word_hashes(b" ".join(parts))
        edges = np.searchsorted(starts, np.r_[0, np.cumsum([len(p) + 1 for p in parts])])
        grams = hashes.copy()
        for k in range(1, min(words, len(hashes))):
            grams[:-k] = grams[:-k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]
        grams = _mix(grams)
        for a, b in zip(edges[:-1], edges[1:]):
            n = b - a
            if n >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif n:
                one = int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little")
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        assert len(out) == begin + len(parts)
    return out


def in_order(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the global order: by counter, then by hash."""
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    return grams[np.argsort(counts[grams >> shift], kind="stable")]


def parity(grams: np.ndarray) -> np.ndarray:
    """The set's bitmap of PARITY words: bit k tells whether an odd number of elements ends in k."""
    odd = np.bincount((grams & np.uint64(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n elements with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def links(inter: int, n: int, m: int, num: int, den: int) -> bool:
    return den * inter >= num * (n + m - inter)


class _Node:
    __slots__ = ("part", "children", "sets", "least", "most")

    def __init__(self, part: np.ndarray):
        self.part, self.children, self.sets = part, {}, []
        self.least, self.most = 1 << 60, 0


class Trie:
    """Ordered sets by common beginnings; runs without branching are one node."""

    def __init__(self):
        self.root = _Node(np.empty(0, np.uint64))

    def add(self, key, elements: np.ndarray) -> None:
        node, at, n = self.root, 0, len(elements)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.sets.append((key, n))
                return
            child = node.children.get(int(elements[at]))
            if child is None:
                child = node.children[int(elements[at])] = _Node(elements[at:])
                child.least = child.most = n
                child.sets.append((key, n))
                return
            m = min(len(child.part), n - at)
            differ = np.flatnonzero(child.part[:m] != elements[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.part):
                upper = _Node(child.part[:same])
                upper.least, upper.most = child.least, child.most
                child.part = child.part[same:]
                upper.children[int(child.part[0])] = child
                node.children[int(elements[at])] = upper
                child = upper
            node, at = child, at + same

    def partners(self, probe: np.ndarray, num: int, den: int) -> list:
        """Keys of the stored sets that link with ``probe`` (ascending)."""
        found, n = [], len(probe)
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if len(node.part):
                spot = np.searchsorted(probe, node.part)
                spot[spot == n] = 0
                overlap += int((probe[spot] == node.part).sum())
                depth += len(node.part)
            bound = min(n, overlap + node.most - depth)
            if (num + den) * bound < num * (n + node.least):
                continue
            found += [key for key, m in node.sets if links(overlap, n, m, num, den)]
            stack += [(child, depth, overlap) for child in node.children.values()]
        return found


def count_table(docs: DataFrame, words: int) -> np.ndarray:
    """Saturated counts of all documents' n-grams by leading hash bits."""
    n = docs.count()
    bits = min(BITS_MOST, max(BITS_LEAST, (max(n, 1) * 64 - 1).bit_length()))
    schema = pa.schema([("chunk", pa.int32()), ("data", pa.binary())])

    def count(batches):
        table = np.zeros(1 << bits, np.uint16)
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for grams in ngram_sets(batch.column("text").slice(at, 512).to_pylist(), words):
                    seen = seen or len(grams) > 0
                    where = grams >> np.uint64(64 - bits)
                    np.add.at(table, where[table[where] < 60000], 1)
        if seen:
            small = np.minimum(table, 255).astype(np.uint8)
            for k in range(0, len(small), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([zlib.compress(small[k : k + CHUNK].tobytes(), 1)], pa.binary())], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint8).astype(np.int64) for x in group.column("data"))
        data = zlib.compress(np.minimum(total, 255).astype(np.uint8).tobytes(), 1)
        return pa.Table.from_arrays([group.column("chunk").slice(0, 1), pa.chunked_array([pa.array([data], pa.binary())])], schema=schema)

    parts = docs.select("text").mapInArrow(count, "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary")
    table = np.zeros(1 << bits, np.uint8)
    for row in parts.collect():  # one row for each CHUNK of the table, whatever the data
        table[row["chunk"] * CHUNK :][:CHUNK] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return table


def _sets(docs: DataFrame, words: int, num: int, den: int, counts) -> DataFrame:
    """doc_id, n, fp and parity bitmap (of the whole set) and the prefix of every document."""
    odd = [f"odd{k}" for k in range(PARITY)]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("prefix", pa.list_(pa.int64()))] + [(k, pa.int64()) for k in odd])

    def run(batches):
        table = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = ngram_sets(part.column("text").to_pylist(), words)
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                heads = [in_order(s, table)[: len(s) - need(len(s), num, den) + min(EXTRA, need(len(s), num, den))].view(np.int64) for s in sets]
                offsets = np.r_[0, np.cumsum([len(h) for h in heads])].astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), flat] + [pa.array(k) for k in np.array([parity(x) for x in sets]).T], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp binary, prefix array<long>" + "".join(f", {k} long" for k in odd))


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """``df``, a table of numbers, marked for broadcast if its rows take at most ``limit`` bytes, else as it is."""
    width = sum(4 if f.dataType.simpleString() == "int" else 8 for f in df.schema)
    return F.broadcast(df) if df.count() * width <= limit else df


def verify(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int, counts) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts link. A pair's texts meet in groups of at most GROUP partners of a."""
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(GROUP))).cast("int").alias("shares"))
    dealt = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    dealt = cut(dealt, "dealt")
    wanted = dealt.select(F.col("b").alias("__id"), "a", "share").unionByName(dealt.select(F.col("a").alias("__id"), "a", "share").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(few(wanted), "__id").select("a", "share", F.col("__id").alias("b"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        ids = group.column("b").to_pylist()
        sets = dict(zip(ids, ngram_sets(group.column("text").to_pylist(), words)))
        trie = Trie()
        for b in sorted(sets):
            if b != a:
                trie.add(b, in_order(sets[b], counts.value))
        found = trie.partners(sets[a], num, den) if a in sets else []
        return pa.Table.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return texts.groupBy("a", "share").applyInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes of an edge list (a, b), but for those that are the smallest: alternating stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = cut(small.distinct(), "small")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = state


def overlap_least(n, m, num: int, den: int):
    """Least overlap of linked sets of n and m elements."""
    return F.ceil((n + m) * num / F.lit(float(num + den)) - 1e-9)


def shared_least(n, m, num: int, den: int):
    """Prefix elements that sets of n and m elements share at least if they link.

    Of the two prefixes one ends first in the global order; common elements up to there lie in both, and behind
    it that set has need - EXTRA elements. So the overlap is at most the shared prefix elements plus that rest.
    """
    behind = lambda x: F.greatest(F.ceil(x * num / F.lit(float(den))) - EXTRA, F.lit(0))
    return F.greatest(overlap_least(n, m, num, den) - F.greatest(behind(n), behind(m)), F.lit(1))


def apart(bits: list, other: list):
    """Elements that two sets surely do not share, from their parity bitmaps."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits, other)), F.lit(0))


def apart_most(n, m, num: int, den: int):
    """Elements that linked sets of n and m elements do not share at most."""
    return n + m - 2 * overlap_least(n, m, num, den)


def contested(rows: DataFrame, part: DataFrame) -> DataFrame:
    """The rows (gram, rep, ...) of groups that span components, with each document's component and its number s of such rows.

    All prefix elements that a document can share with another component lie in these rows.
    """
    named = rows.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_gram = Window.partitionBy("gram")
    named = named.withColumns({"lo": F.min("component").over(by_gram), "hi": F.max("component").over(by_gram)}).where("lo <> hi").drop("lo", "hi")
    return named.withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("rep")))


def join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); threshold num / den."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH)
    try:  # all stages in Python end in here
        return _join(docs, words, num, den)
    finally:
        conf.set(key, before)


def _join(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = spark.sparkContext.broadcast(count_table(docs, words))
    base = cut(_sets(docs, words, num, den, counts), "sets")
    live = base.where("n > 0 and doc_id is not null")
    reps = live.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    met = Window.partitionBy("gram").orderBy("n", "rep")
    grams = reps.select("rep", "n", F.explode("prefix").alias("gram"))
    before, first, after = (f(F.struct("rep", "n")).over(met) for f in (F.lag, F.first, F.lead))
    groups = grams.withColumns({"near": before, "head": first, "next": after}).where("near is not null or next is not null").drop("next")
    groups = cut(groups, "groups")
    least_n = lambda n: F.least(F.lit(EXTRA), F.ceil(n * num / F.lit(float(den))).cast("int"))
    offers = groups.select(F.col("rep").alias("b"), "n", F.explode(F.array_distinct(F.array("near", "head"))).alias("x")).where(F.col("x").isNotNull() & (F.col("x.rep") != F.col("b")) & (F.col("x.n") * den >= F.col("n") * num))
    offers = offers.groupBy("b", F.col("x.rep").alias("a")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.least(F.lit(2), least_n(F.col("n"))))
    first_pairs = cut(offers.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b"), "offers")
    found = cut(verify(docs, first_pairs, words, num, den, counts), "links")
    part = cut(components(found), "components")
    # a second round: in each group that spans components, its member with the fewest unshared prefix elements is offered to the others
    odd = [f"odd{k}" for k in range(PARITY)]
    held = contested(groups.select("gram", "rep", "n"), part)
    held = cut(held.join(live.select(F.col("doc_id").alias("rep"), *odd).dropDuplicates(["rep"]), "rep"), "held")
    by_gram = Window.partitionBy("gram")
    unshared = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den))) - F.col("s")
    hubs = held.withColumn("hub", F.min(F.struct(unshared.alias("unshared"), "rep", "n", "component", *odd)).over(by_gram)).where("hub.component <> component")
    hubs = hubs.withColumn("apart", apart([F.col(k) for k in odd], [F.col("hub")[k] for k in odd])).where(F.col("apart") <= apart_most(F.col("n"), F.col("hub.n"), num, den))
    hubs = hubs.groupBy(F.col("rep").alias("b")).agg(F.min(F.struct("apart", F.col("hub.rep").alias("a")))["a"].alias("a")).select("a", "b")
    tried = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hubs = cut(hubs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a", "b").join(tried.toDF("low", "high"), ["low", "high"], "left_anti").select("a", "b"), "hubs")
    if not hubs.isEmpty():
        found = cut(found.unionByName(verify(docs, hubs, words, num, den, counts)), "links")
        part = cut(components(found), "components")
        tried = tried.unionByName(hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # pairs of different components that share enough prefix elements; in a group, members of its most frequent component meet only the others
    held = contested(held.drop("component", "s"), part)
    held = held.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("gram", "component")))
    held = cut(held.withColumn("major", F.max(F.struct("c", "component")).over(by_gram)["component"]).drop("c"), "held")
    left = held.where("component <> major").select("gram", F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"), F.col("s").alias("ps"), *[F.col(k).alias("p" + k) for k in odd])
    right = held.select("gram", F.col("rep").alias("q"), F.col("n").alias("qn"), F.col("component").alias("qc"), (F.col("component") == F.col("major")).alias("q_major"), F.col("s").alias("qs"), *[F.col(k).alias("q" + k) for k in odd])
    close = (F.least("ps", "qs") >= shared_least(F.col("pn"), F.col("qn"), num, den)) & (F.least("pn", "qn") * den >= F.greatest("pn", "qn") * num) & (F.col("pc") != F.col("qc")) & (F.col("q_major") | (F.col("p") < F.col("q")))
    close = close & (apart([F.col("p" + k) for k in odd], [F.col("q" + k) for k in odd]) <= apart_most(F.col("pn"), F.col("qn"), num, den))
    more = left.join(right, "gram").where(close).groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("pn").alias("pn"), F.first("qn").alias("qn"))
    more = more.where(F.col("c") >= shared_least(F.col("pn"), F.col("qn"), num, den)).select("a", "b")
    more = cut(more.join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        found = found.unionByName(verify(docs, more, words, num, den, counts))
        part = cut(components(found), "components")
    rep_of = live.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = rep_of.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "copies")
    named = cut(named, "named")
    # large groups of equal sets, at most HOT of them whatever the data, meet their rows by broadcast, so no task holds one
    edge = max(GROUP, -(-live.count() // HOT))
    hot = F.broadcast(named.where(F.col("copies") > edge).drop("copies"))
    rows = live.select("doc_id", "n", "fp")
    cold = rows.join(hot, "fp", "left_anti").join(named.where(F.col("copies") <= edge).drop("copies"), "fp")
    linked = cold.unionByName(rows.join(hot, "fp")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = base.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; rows without id stay. Other columns, whatever their names, go along."""
    joined = cut(join(docs, words, num, den), "joined")
    rows, of = numbered(docs)
    key = F.col(of["doc_id"])
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = rows.join(few(cut(gone, "gone")), key == F.col("gone"), "left_anti")
    again = joined.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    again = cut(again, "again")
    if not again.isEmpty():
        twice = kept.join(again, key == F.col("again"), "left_semi").dropDuplicates([of["doc_id"]])
        kept = kept.join(again, key == F.col("again"), "left_anti").unionByName(twice)
    return kept.toDF(*docs.columns)
