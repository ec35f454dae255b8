"""N-gram Jaccard join: token-combination prefixes.

A document is the set of hashes of its word shingles; two documents link if
the Jaccard similarity of their sets reaches ``percent``. Tokens have one
global order: rare ones first, frequent ones last, each class by hash. Let
``e = |x| - ceil(t |x|)`` be the most tokens of x that a partner can lack.

* If the first shared token is rare, it is among the first ``e + 1`` tokens of
  both sides: these are indexed as single tokens.
* Otherwise every rare token of x (``n1`` of them, at most ``e``) is a mismatch, which
  leaves at most ``e - n1`` among its frequent tokens, and ``D = |x| (1 - t) / t - n1``
  on both sides together. Each mismatch breaks the neighbourhood of at most
  one pair of consecutive shared tokens, so of the first ``D + 1`` such pairs
  one is adjacent on both sides: the adjacent pairs of the first
  ``D + 2 + e - n1`` frequent tokens are indexed as 2-token combinations.

So a frequent token never is a signature alone, prefixes grow linearly with
the set, and no link is lost. Within a signature, documents are cut into
runs of compatible sizes; each run's first document is its leader. All
documents with the same leader are verified together, sets in hand, in
blocks of bounded bytes; pairs of blocks are met as far as their documents
are not linked already. Links come out as a forest, never as all pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.bytehash import MULT, scramble, word_hashes
from tuneframe.llm.common import components, cut, lean, scratch, slices, small_batches

SKETCH_BITS = 22
BLOCK_BYTES = 6 << 20
PARITY_GROUP = 8192


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none."""
    a = word_hashes(raw or b"")
    if not len(a):
        return a
    n = min(words, len(a))
    # A short sequence must not equal a part of a longer one.
    h = np.full(len(a) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = scramble(h * MULT + a[k : len(a) - n + 1 + k])
    return np.unique(h)


def pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits, six bytes each: enough to compare two documents, a quarter smaller on disk."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view("<u8").ravel()


def node_id(h: np.ndarray) -> int:
    """Equal sets have equal ids; different ones share one with probability 2**-64."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(s: np.ndarray, rank: np.ndarray, often: int, percent: int) -> np.ndarray:
    """Signatures of one set of 48-bit tokens.

    ``rank`` is each token's frequency rank; from ``often`` on it belongs to
    the second class. Tokens are ordered by rank, then by hash.
    """
    n = len(s)
    e = n - -(-percent * n // 100)
    mixed = scramble(s)
    order = np.lexsort((mixed, rank))
    s, n1 = s[order], int((rank < often).sum())
    single = scramble(s[: min(n1, e + 1)] + MULT)
    if n1 > e:
        return single
    d = n * (100 - percent) // percent - n1
    p = s[n1 : n1 + max(2, d + 2 + e - n1)]
    pairs = scramble(scramble(p[:-1] * MULT + np.uint64(1)) + p[1:])
    return np.concatenate([single, pairs])


def parity(tokens: np.ndarray) -> bytes:
    """2048 bits: how many tokens fall on each, odd or even. Two sets differ in at least as many tokens as bits."""
    on = np.bincount((scramble(tokens + MULT) & np.uint64(2047)).astype(np.int64), minlength=2048) & 1
    return np.packbits(on.astype(np.uint8)).tobytes()


def may_link(bits: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Members that another member could be linked with, by their parities: never false for one that is."""
    b = np.frombuffer(b"".join(bits), dtype="<u8").reshape(len(bits), -1)
    out = np.zeros(len(bits), bool)
    for k in range(len(bits)):
        if out[k]:
            continue
        differ = np.bitwise_count(b ^ b[k]).sum(1, dtype=np.int64)
        ok = differ * (100 + percent) <= (sizes + sizes[k]) * (100 - percent)
        ok[k] = False
        if ok.any():
            # Only the partners found here are settled; the others are looked at in their own turn.
            out[k] = True
            out |= ok
    return out


def covered(percent: int) -> bool:
    """Whether pairs find every link: sets of any size that may differ share two frequent tokens more than they miss.

    It holds from 70 on for all sizes; from some size on it holds wherever ``percent ** 2 > 100 * (100 - percent)``.
    """
    return percent**2 > 100 * (100 - percent) and all(
        -(-percent * n // 100) >= n * (100 - percent) // percent + 2 for n in range(1, 2000) if n * (100 - percent) >= percent)


def linked(n: int, m: int, both, percent: int):
    """The threshold in whole numbers."""
    return 100 * both >= percent * (n + m - both)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def verify(sets: list[np.ndarray], percent: int, lead: int | None, groups: np.ndarray | None = None,
           settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all links among ``sets``.

    Members are counted against all others at once through the tokens they
    share. A member linked to ``lead`` needs no count of its own: pairs of
    such members are connected already, and any other pair is counted from
    its other end. The same holds for ``settled`` members, which are known to
    be connected. With ``groups`` only pairs of different groups matter.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by_token = np.argsort(token, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    holders = owner[by_token]
    forest, links = Forest(n), []

    def count(k: int) -> np.ndarray:
        t = token[at[k] : at[k + 1]]
        lens = start[t + 1] - start[t]
        pos = np.repeat(start[t] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        return np.bincount(holders[pos], minlength=n)

    def meet(k: int) -> None:
        both = count(k)
        ok = linked(sizes[k], sizes, both, percent)
        ok[k] = False
        if groups is not None:
            ok &= groups != groups[k]
        for j in np.flatnonzero(ok).tolist():
            if forest.join(k, j):
                links.append((k, j))

    if lead is not None:
        meet(lead)
    for k in range(n):
        if settled is not None and settled[k]:
            continue
        if lead is None or forest.find(k) != forest.find(lead):
            meet(k)
    # Those that joined the leader's tree in between were met from the other end or are counted here.
    return links


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
            frequent_share: float = 0.002, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Near-duplicate classes: one row per row of ``docs``: ``id, n_shingles, component, node``.

    ``component`` is the smallest id reachable over links of at least
    ``percent`` Jaccard similarity between sets of ``words``-word shingles;
    words are split at ASCII white space, A-Z lower-cased. Equal sets are one
    node. Texts without words and null texts link with nothing and are
    their own component, even if their id is null (then null). A null id is never the
    smallest unless its component has no other. Repeated rows link
    with each other. An empty table gives no rows.

    ``frequent_share`` is the share of documents from which a token counts as
    frequent; any value gives the same classes. A ``percent`` that pairs of
    tokens can't answer whole (under 70) raises.
    """
    if not 1 <= percent <= 100 or not covered(percent):
        raise ValueError(f"pairs of tokens don't find every link of {percent} percent")
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "shingles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [shingles(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in rows], pa.int64()),
                 pa.array([node_id(h) for h in rows], pa.int64()), pa.array([pack48(h) for h in rows], pa.binary())],
                names=["id", "n", "node", "tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    # Hashes do not compress; trying to would only cost time.
    picked.mapInArrow(sets, "id long, n long, node long, tokens binary").write.option("compression", "none").parquet(path)
    known = spark.read.parquet(path)

    # Token frequencies by hash cell: 2 ** 22 counters, whatever the corpus. Any estimate is right for any
    # token, as order and classes only need to be the same everywhere.
    cells, parts = 1 << SKETCH_BITS, 32
    part = cells // parts

    def cell(t: np.ndarray) -> np.ndarray:
        return (t >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in slices(batches):
            found, times = np.unique(cell(unpack48(b"".join(batch.column(0).to_pylist()))), return_counts=True)
            total[found] += times.astype(np.uint32)
        chunks = [(k, total[k * part : (k + 1) * part]) for k in range(parts)]
        chunks = [(k, zlib.compress(c.astype("<u4").tobytes(), 1)) for k, c in chunks if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())],
                                         names=["k", "c"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.int64)
        for c in pdf["c"]:
            total += np.frombuffer(zlib.decompress(c), "<u4")
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "c": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    counted = known.select("tokens").mapInArrow(sketch, "k int, c binary").groupBy("k").applyInPandas(add, "k int, c binary")
    # The driver holds the counters compressed and spreads one part at a time.
    packed = {r["k"]: bytes(r["c"]) for r in counted.toLocalIterator()}

    def counters(k: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(packed[k]), "<i8")

    rows = known.count()
    # A cell's mean load is noise that every token in it carries; ranks are bytes, linear around that load.
    mean = sum(int(counters(k).sum()) for k in packed) / cells
    border = mean + 8 * math.sqrt(mean + 1) + max(8.0, frequent_share * rows)
    often = 200
    ranks = np.zeros(cells, np.uint8)
    for k in packed:
        ranks[k * part : (k + 1) * part] = np.minimum(counters(k) * often / border, 255).astype(np.uint8)
    packed.clear()
    shared = spark.sparkContext.broadcast(ranks.tobytes())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        # Copies of a set are signed once a task, so a signature has no more rows of one node than tasks.
        done: set[int] = set()
        for batch in slices(batches):
            out, node, size = [], [], []
            for raw, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x in done:
                    continue
                done.add(x)
                s = unpack48(raw)
                # Sets this small can only link with their equals, which are the same node.
                if len(s) * (100 - percent) < percent:
                    continue
                sig = signatures(s, table[cell(s)], often, percent)
                out.append(sig)
                node.append(np.full(len(sig), x, np.int64))
                size.append(np.full(len(sig), len(s), np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(node)),
                                                  pa.array(np.concatenate(size))], names=["sig", "node", "size"])

    signed = known.select("tokens", "node").mapInArrow(sign, "sig long, node long, size int")
    # One shuffle by signature; all that follows keeps its order. Copies of a set fall together first,
    # then documents of sizes that can't link are cut apart, then those left alone are dropped.
    w = Window.partitionBy("sig").orderBy("size", "node")
    run = signed.withColumn("_last", F.lag("node").over(w)).filter("_last is null or _last <> node")
    run = run.withColumn("_size", F.lag("size").over(w))
    run = run.withColumn("_cut", F.when(F.col("_size").isNull() | (F.col("_size") * 100 < F.col("size") * percent), F.col("node")))
    run = run.withColumn("leader", F.last("_cut", ignorenulls=True).over(w))
    # The first of a run is its leader; it matters only if another follows.
    stars = cut(run.filter("leader <> node").select("leader", "node").distinct())
    lead = stars.select(F.col("leader").alias("node")).distinct().select(F.col("node").alias("leader"), "node")
    members = stars.withColumn("lead", F.lit(False)).union(lead.withColumn("lead", F.lit(True)))

    # One row of ``documents`` lends each node its set; blocks of a group follow its bytes. All narrow.
    holders = known.select("node", "id", "n").join(members.select("node").distinct(), "node")
    holders = holders.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    members = members.join(holders, "node")
    # Parities sort out most candidates that share a token by chance, before any set is moved. Groups of
    # more than PARITY_GROUP documents go on as they are.
    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("_count"))
    members = cut(members.join(size, "leader"))
    lenders = members.select("node", "id").distinct()
    if lenders.count() <= 1_000_000:  # a checked bound of 16 bytes a row
        lenders = F.broadcast(lenders)

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([parity(unpack48(t)) for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "bits"])

    lent = known.select("node", "id", "tokens").alias("s").join(
        lenders.alias("m"), (F.col("s.node") == F.col("m.node")) & F.col("s.id").eqNullSafe(F.col("m.id")))
    bits = lent.select("s.node", "s.tokens").mapInArrow(parities, "node long, bits binary").dropDuplicates(["node"])

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        return pdf[may_link(pdf["bits"].tolist(), pdf["n"].to_numpy(), percent)].drop(columns="bits")

    few = members.filter(F.col("_count") <= PARITY_GROUP).drop("_count").join(bits, "node")
    kinds = "node long, leader long, lead boolean, id long, n long"
    few = few.select("node", "leader", "lead", "id", "n", "bits").groupBy("leader").applyInPandas(sift, kinds)
    many = members.filter(F.col("_count") > PARITY_GROUP).select("node", "leader", "lead", "id", "n")
    members = cut(few.union(many))
    per = members.groupBy("leader").agg(F.sum(F.col("n") * 6 + 200).alias("bytes"))
    per = per.select("leader", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    members = cut(members.join(per, "leader").drop("n"))
    small = members.count() <= 1_000_000  # a checked bound of some 40 bytes a row; beyond it the planner sorts and merges
    side = F.broadcast(members) if small else members
    dealt = known.select("node", "id", "tokens").alias("s").join(
        side.alias("m"), (F.col("s.node") == F.col("m.node")) & F.col("s.id").eqNullSafe(F.col("m.id"))
    ).select("m.leader", "m.node", "m.lead", "m.blocks", "s.tokens")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # The leader sits in every block of its group (unless it was sorted out: then every pair of blocks is met in full).
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        pdf = pdf.sort_values(["lead", "node"], ascending=[False, True], kind="stable")
        node = pdf["node"].to_numpy()
        links = verify([unpack48(t) for t in pdf["tokens"]], percent, 0) if len(node) > 1 else []
        return pd.DataFrame({"a": pd.Series([node[i] for i, _ in links], dtype="int64"), "b": pd.Series([node[j] for _, j in links], dtype="int64")})

    edges = dealt.groupBy("leader", "block").applyInPandas(inside, "a long, b long")
    several = per.filter("blocks > 1")
    if several.limit(1).count():
        # Documents linked with their leader are connected; the others still have to meet the other blocks.
        edges = cut(edges)
        tied = edges.select(F.col("a").alias("leader"), F.col("b").alias("node")).union(
            edges.select(F.col("b").alias("leader"), F.col("a").alias("node"))).distinct().withColumn("tied", F.lit(True))
        big = dealt.filter("not lead").join(several.select("leader"), "leader").join(tied, ["leader", "node"], "left")
        big = big.withColumn("tied", F.coalesce("tied", F.lit(False)))
        # A free document meets all other blocks, a tied one only those that hold a free document.
        free = cut(big.filter("not tied").select("leader", F.col("block").alias("other")).distinct())
        if free.count() <= 1_000_000:  # 12 bytes each: a checked bound
            free = F.broadcast(free)
        everywhere = big.filter("not tied").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        somewhere = big.filter("tied").join(free, "leader")
        pairs = everywhere.unionByName(somewhere).filter("other <> block")
        pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            lean()
            free = ~pdf["tied"].to_numpy()
            out = []
            if free.any():
                node, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
                links = verify([unpack48(t) for t in pdf["tokens"]], percent, None, block, ~free)
                out = [(node[i], node[j]) for i, j in links]
            return pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.Series([x for _, x in out], dtype="int64")})

        edges = edges.union(pairs.groupBy("leader", "i", "j").applyInPandas(across, "a long, b long"))

    comp = cut(components(edges))
    nodes = known.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    nodes = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    nodes = cut(nodes)
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(nodes.join(least, "root").select("node", "component"))
    full = known.filter("n > 0").select("id", "n", "node").join(named, "node")
    alone = known.filter("n = 0").select("id", "n", "node", F.col("id").alias("component"))
    out = full.select("id", "n", "node", "component").union(alone)
    return out.select("id", F.col("n").alias("n_shingles"), "component", "node")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one document of each class: the row with the smallest id.

    Texts without words are classes of their own, so all of them stay. Rows
    that repeat the kept id with an equal text stay once; different texts
    under the kept id all stay. Columns of ``docs`` may have any names.
    """
    found = classes(docs, words, percent, id_col, text_col)
    keep = cut(found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_id")))
    ids = keep.distinct()
    rows, kept = keep.count(), ids.count()
    if kept <= 1_000_000:  # 8 bytes each: a checked bound
        ids = F.broadcast(ids)
    out = docs.alias("d").join(ids.alias("k"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k._id")), "left_semi")
    return out if rows == kept else out.dropDuplicates([id_col, text_col])
