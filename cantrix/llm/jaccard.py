"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100 share at
least ``l`` tokens of their l-prefixes: the first ``n - ceil(n * percent / 100) + l`` tokens of the
set in one global order. The order puts tokens of a bounded table of frequent tokens last, so that
most prefixes hold rare tokens. Each document lengthens its prefix where the estimated cost of its
candidates is larger than that of the longer prefix: with a larger ``l`` a candidate must share
more prefix tokens before it is verified (the smaller ``l`` of a pair holds). The places of the
shared tokens bound the overlap too: what follows the first and the last of them is all that is left.

Texts are read once; the distinct sets of each task are written, and everything else reads these.
Equal sets are one node from the start. Posting lists up to ``LIST`` nodes are counted pair by
pair, in buckets of about ``ENTRIES`` entries whatever the input. Tokens that the table knows from
more nodes are never gathered: their entries stay rows, and only places at which a token can be the
first that two sets share take part (a smaller set's index place, a larger set's probe place). Such
nodes join a group through their list's head. A group is verified in blocks of ``BLOCK`` nodes, each
with the group's pivots; pairs of one list that this leaves in different components are then verified
too, block by block, so that copies that found each other through a pivot cost no pairs. In a block
too, pairs must share ``l`` prefix tokens before they are verified. Other candidates are verified by
connected part where that has no more than ``BLOCK`` nodes, else around one end of each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import KEY, TEXT, cut, drop, sums
from .components import components
from .textbuf import U64, Texts, chunks, numbered, spans, splitmix, words

#: Nodes of a posting list that are paired one by one; longer lists go to blocks.
LIST = 64
#: Nodes of a group that one side of a task verifies.
BLOCK = 128
#: Nodes of a group of long lists that all its blocks are compared with.
PIVOTS = 12
#: Tokens of the broadcast table of frequent tokens (12 bytes each).
TABLE = 400_000
#: Index entries of a bucket, about, and those that a task gathers before it deals them out.
ENTRIES, GATHER = 500_000, 400_000
#: Bits of the broadcast filter of active nodes, at most: 16 MB. A full filter only costs time.
FILTER_BITS = 1 << 27
#: Digests that one task remembers to write copies once; forgetting costs only time.
REMEMBER = 1_000_000
WORDS = 5
#: Tokens of a set for each further prefix token that a candidate has to share.
CHANCE = 48
#: Rows of a batch that goes back to Spark.
SLICE = 1 << 14
COLUMNS = 4096  # of the token matrix that are multiplied at once


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by row and value, their rows, each row's first, and each row's digest."""
    w = words(t, lower=True)
    at = np.arange(len(w.row))
    count = np.diff(w.first)
    long = at[at + WORDS <= w.first[1:][w.row]] if len(at) else at
    h, row = [spans(w.hash, long, WORDS)], [w.row[long]]
    for n in range(1, WORDS):
        short = np.flatnonzero(count == n)
        h.append(splitmix(spans(w.hash, w.first[short], n) ^ U64(n)))
        row.append(short)
    h, row = np.concatenate(h), np.concatenate(row)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    first = np.searchsorted(row, np.arange(len(t) + 1))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(splitmix(h), dtype=U64)])
        digest = splitmix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)).view(np.int64)
    return h, row, first, digest


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def least_overlap(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of m and n tokens share if they link."""
    return -(-(m + n) * percent // (100 + percent))


class _Once:
    """Which rows hold a digest that this task has not written."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, digest: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digest), bool)
        for i in np.flatnonzero(wanted).tolist():
            d = int(digest[i])
            if d not in self.seen:
                if len(self.seen) >= REMEMBER:
                    self.seen.clear()
                self.seen.add(d)
                out[i] = True
        return out


def sets_of(docs: DataFrame, percent: int, text: str, key: str) -> DataFrame:
    """Key, set size and digest of each row; ``tokens`` where the task meets the set first and it can link with others than equal ones."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for b in batches:
            for t in chunks(b.column(1)):
                h, _, first, digest = shingles(t)
                n = np.diff(first)
                sent = once(digest, 100 * n >= percent * (n + 1))
                ends = np.concatenate([[0], np.cumsum(np.where(sent, 8 * n, 0))])
                data = h[np.repeat(sent, n)].tobytes()
                buffers = (np.packbits(sent, bitorder="little").tobytes(), ends.astype(np.int64).tobytes(), data)
                tokens = pa.Array.from_buffers(pa.large_binary(), len(t), [pa.py_buffer(x) for x in buffers]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), pa.array(n), pa.array(digest), tokens], [KEY, "n_shingles", "node", "tokens"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(TEXT)).mapInArrow(run, f"{KEY} {kind}, n_shingles bigint, node bigint, tokens binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some sets, the row of each, and each row's first."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    h = np.frombuffer(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes(), U64)
    first = (offsets - offsets[0]) // 8
    return h, np.repeat(np.arange(len(column)), np.diff(first)), first


def _parts(batches: Iterator[pa.RecordBatch], tokens: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of tokens."""
    for b in batches:
        each = max(1, int(len(b) * size / max(b.column(tokens).nbytes, 1)))
        for at in range(0, len(b), each):
            yield b.slice(at, each)


class _Frequent:
    """Tokens that occur twice or more within a million and a half tokens of a task, with that count."""

    FLUSH = 1_500_000

    def __init__(self) -> None:
        self.held, self.n = [], 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 0):
            self.held.append(_flat(b.column(0))[0])
            self.n += len(self.held[-1])
            if self.n >= self.FLUSH:
                yield self.end()
        if self.n:
            yield self.end()

    def end(self) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        many = count > 1
        return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many])], ["token", "cnt"])


def frequent(sets: DataFrame, most: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the commonest tokens, sorted, and their counts. They only decide the order and which lists are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Frequent()(batches)

    seen = cut(sets.select("tokens").mapInArrow(run, "token bigint, cnt bigint").groupBy("token").agg(F.sum("cnt").alias("cnt")))
    by = {r["b"]: r["n"] for r in seen.groupBy(F.floor(F.log2("cnt")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = max(by, default=0) + 1, 0
    for b in sorted(by, reverse=True):
        held += by[b]
        if held > most:
            break
        least = b
    got = seen.filter(F.floor(F.log2("cnt")) >= least).toArrow()
    drop(seen)
    token, count = got["token"].to_numpy().view(U64), got["cnt"].to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(count[order], 1 << 30).astype(np.int32)


def prefixes(h: np.ndarray, row: np.ndarray, first: np.ndarray, percent: int, token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which tokens are prefix tokens, their rows, places and known counts, and each row's l."""
    n = np.diff(first)
    at = np.minimum(np.searchsorted(token, h), max(len(token) - 1, 0))
    seen = np.where(token[at] == h, count[at], 0) if len(token) else np.zeros(len(h), np.int32)
    order = np.lexsort((h, seen, row))
    place = np.arange(len(h)) - first[row]
    least = n - _least_shared(n, percent) + 1
    cost = np.maximum(seen[order] - 1, 0)
    extra = n // CHANCE  # every token can meet by chance, so longer sets ask for more from the start
    dear = np.flatnonzero(sums(np.where(place < least[row], cost, 0), first) > 4)
    for i in dear.tolist():
        upto = np.cumsum(cost[first[i] : first[i + 1]])
        # candidates must share l of these tokens, so at most cost / l are verified, each for about n tokens
        steps = [int(extra[i]), *(s for s in (n[i] // 32, n[i] // 16, n[i] // 8, n[i] // 4) if extra[i] < s and least[i] + s <= n[i])]
        price = [upto[least[i] + s - 1] / (1 + s) * n[i] / 16 + s for s in steps]
        extra[i] = steps[int(np.argmin(price))]
    inside = place < (least + extra)[row]
    return order[inside], row[inside], place[inside], seen[order[inside]], extra + 1


def pairs_of(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, need: np.ndarray, far: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """From index entries: which belong to lists of more than ``most`` nodes, and the pairs of the others.

    A pair is (a, b, shared, need, best, worst, least): tokens shared and needed, the largest and smallest
    number of tokens that can follow from a shared one on, and the overlap of a link.
    """
    order = np.lexsort((node, token))
    new = np.ones(len(token), bool)
    new[1:] = (token[order[1:]] != token[order[:-1]]) | (node[order[1:]] != node[order[:-1]])
    order = order[new]
    token, node, n, place, need, far = token[order], node[order], n[order], place[order], need[order], far[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(token))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(size[(size > 1) & (size <= most)]).tolist():
        i, j = np.triu_indices(k, 1)
        s = start[size == k]
        i, j = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
        near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        left.append(i[near])
        right.append(j[near])
    i, j = np.concatenate(left), np.concatenate(right)
    by = np.lexsort((node[j], node[i]))
    i, j = i[by], j[by]
    a, b = node[i], node[j]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    after = np.minimum(n[i] - place[i], n[j] - place[j])
    some = len(first) > 0
    best = np.maximum.reduceat(after, first) if some else after
    worst = np.minimum.reduceat(after, first) if some else after
    fi, fj = i[first], j[first]
    # tokens of lists that stay rows may be shared too, and are not counted here
    least = np.maximum(np.minimum(need[fi], need[fj]) - np.minimum(far[fi], far[fj]), 1)
    pairs = (a[first], b[first], np.diff(first, append=len(a)), least, best, worst, least_overlap(n[fi], n[fj], percent))
    return order[np.repeat(size > most, size)], pairs


ENTRY = "tokens binary, nodes binary, sizes binary, places binary, needs binary, fars binary"
KINDS = (U64, np.int64, np.int32, np.int32, np.uint16, np.uint16)
LISTED = ["u", "v", "shared", "need", "best", "worst", "least"]


def candidates(sets: DataFrame, percent: int, table: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) between nodes that share enough prefix tokens, and edges (u, v) of nodes with the head of a long list."""
    spark = sets.sparkSession
    shared, most = spark.sparkContext.broadcast(table), LIST

    def entries(h, row, first, node):
        n = np.diff(first)
        pick, of, place, seen, need = prefixes(h, row, first, percent, *shared.value)
        need = np.minimum(need, 60_000)
        hot = seen > most
        far = np.minimum(np.bincount(of[hot], minlength=len(n)), need)
        # the first token that two sets share lies in the index part of the smaller and in the probe part of the larger
        probe = place <= (n - _least_shared(n, percent))[of]
        index = place <= (n - least_overlap(n, n, percent))[of]
        keep = ~hot | probe
        token, of, place, hot, index = h[pick][keep], of[keep], place[keep], hot[keep], index[keep]
        # entries of long lists are dealt by node; a need of 0 marks them, and far whether they are index places
        columns = token, node[of], n[of], place, np.where(hot, 0, need[of]), np.where(hot, index, far[of])
        return tuple(x.astype(k, copy=False) for x, k in zip(columns, KINDS, strict=True))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def deal() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            by = np.where(columns[4] == 0, splitmix(columns[1].view(U64)), columns[0])
            bucket = (by % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cuts[1:], len(bucket))
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (c[order] for c in columns)]
            out = pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *blobs], ["bucket", *(x.split()[0] for x in ENTRY.split(", "))])
            yield from (out.slice(at, 64) for at in range(0, len(out), 64))

        for b in _parts(batches, 1):
            h, row, first = _flat(b.column(1))
            got = entries(h, row, first, b.column(0).to_numpy())
            held.append(got)
            count += len(got[0])
            if count >= GATHER:
                yield from deal()
                count = 0
        if count:
            yield from deal()
        held = []
        pa.default_memory_pool().release_unused()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in KINDS]
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            token, node, n, place, need, far = (np.frombuffer(b"".join(x), k) for x, k in zip(held, KINDS, strict=True))
            n, place, need, far = (x.astype(np.int64) for x in (n, place, need, far))
            row = np.flatnonzero(need == 0)
            rest = np.flatnonzero(need > 0)
            long, found = pairs_of(token[rest], node[rest], n[rest], place[rest], need[rest], far[rest], percent, most)
            # a long list that the table does not know: all its places count as index places
            row, index = np.concatenate([row, rest[long]]), np.concatenate([far[row], np.ones(len(long), np.int64)])
            none = np.zeros(len(row), np.int64)
            rows = (token[row].view(np.int64), node[row], n[row], none, index, none, none)
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([a.astype(np.int64), b])) for a, b in zip(found, rows, strict=True)], LISTED)
            yield from (out.slice(at, SLICE) for at in range(0, len(out), SLICE))

        for batch in batches:  # sorted by bucket
            bucket = batch.column(0).to_numpy()
            for i in range(len(batch)):
                if now is not None and bucket[i] != now:
                    yield from flush()
                    held = [[] for _ in KINDS]
                now = bucket[i]
                for k in range(len(KINDS)):
                    held[k].append(batch.column(k + 1)[i].as_py())
        if now is not None:
            yield from flush()

    dealt = sets.select("node", "tokens").mapInArrow(index, f"bucket bigint, {ENTRY}")
    listed = cut(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, ", ".join(f"{x} bigint" for x in LISTED)))
    total = listed.filter("need > 0").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"), F.max("best").alias("best"), F.min("worst").alias("worst"), F.max("least").alias("least"))
    enough = total.filter("shared >= need and best >= least and shared - 1 + worst >= least").select("u", "v")
    long = listed.filter("need = 0").select(F.col("u").alias("token"), F.col("v").alias("node"), F.col("shared").alias("n"), (F.col("best") > 0).alias("own"))
    own = F.when(F.col("own"), F.col("n"))
    heads = long.groupBy("token").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("head"), F.min(own).alias("low"), F.max(own).alias("high"))
    joined = long.join(heads.filter("head is not null"), "token").filter("node != head")
    met = joined.filter(F.col("own") | ((F.col("n") >= F.col("low")) & (F.ceil(F.col("n") * percent / 100) <= F.col("high"))))
    edges, met = cut(enough), cut(met.select(F.col("head").alias("u"), F.col("node").alias("v")).distinct())
    drop(listed)
    shared.destroy()
    return edges, met


def _shared(owner: np.ndarray, token: np.ndarray, sets: int) -> np.ndarray:
    """How many tokens each pair of sets shares, from (set, token) entries without repeats."""
    code, found = numbered(token)
    several = np.bincount(code, minlength=len(found)) > 1
    number = np.cumsum(several) - 1
    owner, code = owner[several[code]], number[code[several[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both, total = np.zeros((sets, sets), np.float64), int(several.sum())
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        part = np.zeros((sets, min(COLUMNS, total - low)), np.float32)
        part[owner[a:b], code[a:b] - low] = 1
        both += part @ part.T  # whole numbers below 2**24 a column chunk, exact in float32
    return both


def _promising(sets: list[np.ndarray], percent: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sets of a block that share enough prefix tokens with another one of a fitting size."""
    n = np.array([len(x) for x in sets])
    h = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(n)])
    pick, of, _, _, need = prefixes(h, np.repeat(np.arange(len(n)), n), first, percent, *table)
    near = 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
    near &= _shared(of, h[pick], len(n)) >= np.minimum(need[:, None], need)
    np.fill_diagonal(near, False)
    return near.any(1)


def links_of(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets."""
    n = np.array([len(x) for x in sets])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(sets) <= 4:
        both = np.zeros((len(sets), len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        both = _shared(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), len(sets))
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _split(count: Column) -> Column:
    return F.ceil(count / BLOCK).cast("int")


def _blocks(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Number of blocks of each key, and each node's own."""
    size = rows.groupBy(by).agg(_split(F.count(F.lit(1))).alias(f"{name}s"))
    return rows.join(size, by).withColumn(name, F.pmod(F.xxhash64("node", F.lit(7)), F.col(f"{name}s")).cast("int"))


def _task(kind: int, root: str, i: Column, j: Column) -> list[Column]:
    return [F.col("node"), F.lit(kind).alias("kind"), F.col(root).alias("root"), i.cast("int").alias("i"), j.cast("int").alias("j")]


def first_tasks(edges: DataFrame, met: DataFrame) -> DataFrame:
    """Which node takes part in which verification: node, kind, root, i, j. ``met`` has the edges of long lists.

    kind 0: blocks of a group of long lists, each with the group's pivots; kind 1: a small connected
    part; kind 2: the neighbours of one end, in blocks.
    """
    none = F.lit(0)
    groups = cut(_blocks(components(met), "root", "block"))
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(11)), "node"))
    pivots = groups.withColumn("place", place).filter(F.col("place") <= PIVOTS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = groups.select(*_task(0, "root", F.col("block"), none)).unionByName(pivots.select(*_task(0, "root", F.col("block"), none)))

    parts = components(edges)
    parts = cut(parts.join(parts.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root"))
    small = parts.filter(F.col("members") <= BLOCK).select(*_task(1, "root", none, none))
    large = edges.join(parts.filter(F.col("members") > BLOCK).select(F.col("node").alias("u")), "u", "left_semi")
    star = _blocks(large.select("u", F.col("v").alias("node")), "u", "block")
    ends = star.select("u", "block").distinct().withColumn("node", F.col("u"))
    around = star.select(*_task(2, "u", F.col("block"), none)).unionByName(ends.select(*_task(2, "u", F.col("block"), none)))
    return hot.unionByName(small).unionByName(around)


def rest_tasks(met: DataFrame, links: DataFrame) -> DataFrame:
    """Verifications of what the first left open: nodes of one long list in different components.

    Each list has a main component. Nodes of its lists outside it are its guests: blocks of both
    meet (kind 3), and blocks of guests among themselves where there are several (kind 4).
    """
    lists = met.select(F.col("u").alias("list"), F.col("v").alias("node"))
    lists = lists.unionByName(lists.select("list", F.col("list").alias("node")).distinct())
    known = components(links).withColumnRenamed("root", "part")
    lists = cut(lists.join(known, "node", "left").withColumn("part", F.coalesce("part", "node")))
    held = lists.groupBy("list", "part").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("list").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = cut(lists.join(main.select("list", "main"), "list").select("main", "node", (F.col("part") == F.col("main")).alias("own")).distinct())
    guests = _blocks(open_.filter("not own").select("main", "node"), "main", "guest")
    hosts = _blocks(open_.filter("own").select("main", "node"), "main", "block")
    sizes = guests.select("main", "guests").distinct(), hosts.select("main", "blocks").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = hosts.join(sizes[0], "main").withColumn("guest", every("guests")).select(*_task(3, "main", F.col("block"), F.col("guest")))
    came = guests.join(sizes[1], "main").withColumn("block", every("blocks")).select(*_task(3, "main", F.col("block"), F.col("guest")))
    among = guests.filter("guests > 1").withColumn("other", every("guests")).select(*_task(4, "main", F.least("guest", "other"), F.greatest("guest", "other")))
    return met.unionByName(came).unionByName(among)


def verified(sets: DataFrame, percent: int, table: tuple[np.ndarray, np.ndarray], edges: DataFrame, met: DataFrame) -> DataFrame:
    """Links (u, v) that connect what the candidate edges and the long lists allow."""
    dealt = cut(first_tasks(edges, met))
    links = checked(sets, percent, table, dealt)
    drop(dealt)
    rest = cut(rest_tasks(met, links))
    if rest.isEmpty():
        return links
    return links.unionByName(checked(sets, percent, table, rest))


def checked(sets: DataFrame, percent: int, table: tuple[np.ndarray, np.ndarray], dealt: DataFrame) -> DataFrame:
    """A spanning forest of the links among the nodes of each task of ``dealt``."""
    spark = sets.sparkSession
    nodes = dealt.select("node").distinct()
    bits = 1 << max(16, min(FILTER_BITS.bit_length() - 1, int(16 * max(nodes.count(), 1)).bit_length()))
    words_ = nodes.select(F.pmod(F.xxhash64("node"), F.lit(bits)).alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("bigint").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask"))
    got = words_.toArrow()  # a filter of fixed size
    bitmap = np.zeros(bits // 32, np.int64)
    bitmap[got["word"].to_numpy()] = got["mask"].to_numpy()
    active, shared = spark.sparkContext.broadcast(bitmap.astype(np.uint32)), spark.sparkContext.broadcast(table)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = active.value
        for b in batches:
            bit = np.mod(_xxhash64(b.column(0).to_numpy()), len(mask) * 32)
            wanted = (mask[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 == 1
            yield b.filter(pa.array(wanted))

    # a set that several tasks have written is sent once
    wanted = sets.select("node", "tokens").mapInArrow(filtered, "node bigint, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
    grouped = wanted.join(dealt, "node").repartition("kind", "root", "i", "j").sortWithinPartitions("kind", "root", "i", "j", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def flush() -> pa.RecordBatch:
            node = list(held)
            tokens = [np.frombuffer(held[x], U64) for x in node]
            if key[0] in (0, 3, 4):  # the other kinds have candidates only
                some = np.flatnonzero(_promising(tokens, percent, shared.value)).tolist()
                node, tokens = [node[i] for i in some], [tokens[i] for i in some]
            found = links_of(tokens, percent) if len(node) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], ["u", "v"])

        for b in batches:
            node, kind, root, i, j = (b.column(x).to_pylist() for x in ("node", "kind", "root", "i", "j"))
            for k in range(len(b)):
                own = (kind[k], root[k], i[k], j[k])
                if own != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = own, {}
                if node[k] not in held:
                    held[node[k]] = b.column("tokens")[k].as_py()
        if len(held) > 1:
            yield flush()

    links = cut(grouped.mapInArrow(check, "u bigint, v bigint"))
    active.destroy()
    shared.destroy()
    return links


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigints (seed 42), so that both sides set the same bits."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << U64(r)) | (v >> U64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(x), U64(42) + p5 + U64(8), U64)
        h ^= turn(x.view(U64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        return (h ^ (h >> U64(32))).view(np.int64)


def jaccard_components(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles, component_id (the smallest ``key`` that links reach) of each row.

    Sets are the distinct 5-word shingles of the text with A-Z in lower case, or the whole sequence
    where it has fewer words; shingles are compared by 64-bit fingerprints. A null or empty text
    has an empty set, links with nothing and is its own component. Equal rows are in one component.
    Null keys count as larger than all others. A very long text is one row of the table of sets, 8 bytes
    a word, and is held whole by a task that verifies it. Other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    rows = cut(sets_of(docs, percent, text, key))
    sets = rows.filter("tokens is not null").select("node", "tokens", "n_shingles")
    sizes = sets.agg(F.sum("n_shingles")).first()[0] or 0
    entries = sizes * (100 - percent) // 100 + sizes // CHANCE
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // ENTRIES)
    table = frequent(sets)
    edges, met = candidates(sets, percent, table, buckets)
    links = components(verified(sets, percent, table, edges, met))

    least = rows.filter("n_shingles > 0").groupBy("node").agg(F.min(KEY).alias("least"))
    known = least.join(links.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = known.join(of_root, "root").select("node", "component_id")
    out = rows.filter("n_shingles > 0").join(by_node, "node", "left").select(KEY, "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select(KEY, "n_shingles", F.col(KEY).alias("component_id"))
    return out.unionByName(alone).withColumnRenamed(KEY, key)
