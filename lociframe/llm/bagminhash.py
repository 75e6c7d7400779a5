"""Near-duplicates of documents as bags of word shingles, by BagMinHash.

A document is the bag (multiset) of its shingles of five words; texts of one to four words have one shingle. A
signature of K registers is made so that two documents agree in a register with the probability of their weighted
Jaccard similarity. Every shingle drives a Poisson process over (time, weight): a hierarchy of processes over the grid
of weights 0, 1, 2, 4, ...: a process over all weights above a grid line is split into its lowest cell and the rest,
and only cells that the weight reaches are followed. Where the weight ends inside a cell, points above it don't count.
Points fall into random registers, and a register keeps the earliest. Points later than all
registers need not be made, so a document costs its shingles plus about K ln K steps, not shingles times K.

The signature is cut into BANDS of ROWS registers. Documents that share a band are candidates, and links are verified
on the whole bags (similarity 0.8 or more):

1. Texts of equal words are one node from the start, however many copies there are.
2. In each band bucket every node is compared with the bucket's smallest one: a star, not all pairs.
3. A bucket whose nodes then lie in one class is done. In the others every two nodes of different classes are compared:
   small buckets by pairs, larger ones cut into tiles, where a task owns two tiles and counts what all their bags share
   as a matrix product.

So every two documents that share a band are compared or already lie in one class, whatever the size of the bucket.

Classes are the connected components of the verified links, named by their smallest doc_id.

Nulls: a null or wordless text is linked to nothing and is its own class. Rows of one doc_id are one document: they
share a class, and each of their texts has a signature and is verified. A null doc_id counts as a number from 2^62 on, made from the text. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, table_cut, whole_text

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
#: Buckets of so many nodes are compared by pairs, larger ones by tiles.
SMALL = 8
#: Nodes and shingles of a tile, on average.
TILE, TILE_SHINGLES = 1024, 1_000_000
#: Shingles in one step of a matrix product.
COLUMNS = 4096
K = BANDS * ROWS
#: Top of the weight grid: more copies of one shingle in a document count as this many in the signature (not in the check).
TOP = 1 << 20
#: Shingles whose processes are worked together.
BLOCK = 60_000
_STEPS = [8, 8, 16, 32, 64, 128, 256]

#: Byte table of UTF-8: word bytes (0-9, a-z, all beyond ASCII) stay, A-Z become lower-case, the rest spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _gap(h: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Exponential time with the given rate from the upper 44 bits."""
    return -np.log(((h >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44) / rate


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8 bytes: cut at ASCII characters that are no letters or digits, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Hasher:
    """64-bit hashes of shingles; word hashes are kept in a dictionary of bounded size."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def shingles(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, np.uint64(len(h) if len(h) < SHINGLE else SHINGLE))
        for i in range(min(SHINGLE, len(h))):
            out = _mix(out * _A + h[i:i + n])
        return out


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """Registers (n_docs x k) of weighted elements: doc index, 64-bit element and whole weight of each."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    registers = np.full((n_docs, k), np.inf)
    bound = np.where(total > 0, k / np.maximum(total, 1) * (np.log(k) + 3.0), 0.0)
    left = np.flatnonzero(total > 0)
    while len(left):  # until every register of every document has a point; the bound doubles for those that lack one
        chosen = np.zeros(n_docs, bool)
        chosen[left] = True
        on = chosen[doc]
        registers[left] = np.inf
        _fill(registers, doc[on], element[on], np.minimum(weight[on], TOP), bound, k)
        left = left[np.isinf(registers[left]).any(axis=1)]
        bound[left] *= 2
    return registers


def _fill(registers: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> None:
    """Enter all points up to the documents' bounds."""
    seed = _mix(element + _A)
    p = np.zeros(len(doc), np.int64)
    x = _gap(_mix(seed), np.full(len(doc), TOP))
    ready = []
    while len(doc):  # the process over [p, TOP) is split into its lowest cell [p, r) and the rest
        r = np.maximum(1, 2 * p)
        h = _mix(seed ^ _A)
        in_cell = (h >> np.uint64(20)).astype(np.float64) * 2.0**-44 * (TOP - p) < r - p
        cell_seed, seed = _mix(seed + _B), _mix(seed + _C)
        first = np.where(in_cell, x, x + _gap(_mix(cell_seed), r - p))
        x = np.where(in_cell, x + _gap(_mix(seed), np.maximum(TOP - r, 1)), x)
        on = first <= bound[doc]
        ready.append((doc[on], cell_seed[on], weight[on], p[on], r[on], first[on]))
        go = (r < weight) & (x <= bound[doc])
        doc, seed, weight, p, x = doc[go], seed[go], weight[go], r[go], x[go]
    if not ready:
        return
    doc, seed, weight, p, r, x = (np.concatenate(part) for part in zip(*ready))
    flat = registers.reshape(-1)
    step, base = 0, np.uint64(1)
    while len(doc):
        size = _STEPS[min(step, len(_STEPS) - 1)]
        h = _mix(seed[:, None] + (base + np.arange(size, dtype=np.uint64))[None, :] * _A)
        after = x[:, None] + np.cumsum(_gap(h, (r - p)[:, None]), axis=1)
        times = np.concatenate([x[:, None], after[:, :-1]], axis=1)
        register = doc[:, None] * k + (((h & np.uint64(0xFFFFF)) * np.uint64(k)) >> np.uint64(20)).astype(np.int64)
        use = times <= bound[doc][:, None]
        wide = np.flatnonzero(r > weight)  # the weight ends inside the cell: points above it don't count
        if len(wide):
            level = p[wide][:, None] + ((_mix(h[wide] ^ _C) >> np.uint64(40)).astype(np.int64) * (r - p)[wide][:, None] >> 24)
            use[wide] &= level < weight[wide][:, None]
        np.minimum.at(flat, register[use], times[use])
        x = after[:, -1]
        on = x <= bound[doc]
        doc, seed, weight, p, r, x = doc[on], seed[on], weight[on], p[on], r[on], x[on]
        base += np.uint64(size)
        step += 1


def bands_of(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), bands, rows)
    h = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(registers), 1), np.uint64)
    for i in range(rows):
        h = _mix(h * _A + values[:, :, i])
    return h.view(np.int64)


def _number() -> Column:
    """The id; for null a number from 2^62 on, made from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(whole_text()), 2))


def _numbered(docs: DataFrame) -> DataFrame:
    """__id (never null), a hash of the text (th) and the text."""
    return docs.select(_number().alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))


def signature_table(docs: DataFrame) -> DataFrame:
    """__id, th, digest of the words, number of shingles and band keys of each row; null digest and bands without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()

        def rows(ids, digests, sizes, bags):
            doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
            sig = signatures(doc, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags)) if len(doc) else np.zeros((len(bags), K))
            keys = bands_of(sig)
            return pd.DataFrame({"__id": [i for i, _ in ids], "th": [h for _, h in ids], "digest": digests, "n": sizes, "bands": [None if d is None else k for d, k in zip(digests, keys)]})

        for batch in batches:
            ids, digests, sizes, bags, load = [], [], [], [], 0
            for i, th, text in zip(batch["__id"], batch["th"], batch["text"]):
                words = words_of(text) if isinstance(text, str) else []
                ids.append((i, th))
                if words:
                    element, count = np.unique(hasher.shingles(words), return_counts=True)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                else:
                    element, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    digests.append(None)
                sizes.append(int(count.sum()))
                bags.append((element, count))
                load += len(element)
                if load > BLOCK:
                    yield rows(ids, digests, sizes, bags)
                    ids, digests, sizes, bags, load = [], [], [], [], 0
            if ids:
                yield rows(ids, digests, sizes, bags)

    return _numbered(docs).mapInPandas(run, "__id long, th long, digest binary, n long, bands array<long>")


def bag_table(rows: DataFrame) -> DataFrame:
    """node and bag, the shingles of (node, text) rows with copies told apart by number: bag overlap is set overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            bags = []
            for text in batch["text"]:
                element, count = np.unique(hasher.shingles(words_of(text)), return_counts=True)
                more = count > 1
                parts = [element]
                for e, c in zip(element[more], count[more]):
                    parts.append(_mix(np.full(c - 1, e) + np.arange(1, c, dtype=np.uint64) * _A))
                bags.append(np.concatenate(parts).view(np.int64))
            yield pd.DataFrame({"node": batch["node"], "bag": bags})

    return rows.mapInPandas(run, "node long, bag array<long>")


def _bucket(*key: Column) -> Column:
    return F.xxhash64(*key).alias("bucket")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of a bucket's smallest node with its other nodes: a, b. members: bucket, node, n."""
    heads = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pairs = members.join(heads, "bucket").filter(F.col("node") != F.col("head.node"))
    # similar bags have similar sizes
    pairs = pairs.filter(F.least("n", "head.n") >= SIMILARITY * F.greatest("n", "head.n"))
    return pairs.select(F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with a weighted Jaccard similarity of SIMILARITY or more: a, b. texts: node and text, a row for each node."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bags = table_cut(bag_table(texts.join(wanted, "node", "left_semi")), "bags")
    left, right = (bags.select(F.col("node").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    either = F.size("bag_a") + F.size("bag_b") - F.col("shared")
    return (pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
            .filter(F.col("shared") >= SIMILARITY * either).select("a", "b"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, class: the smallest node that can be reached, for all nodes of the edges (a, b).

    Large-star and small-star steps in turn until nothing changes; each result is a table in the shared folder.
    """
    now = table_cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = table_cut(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = table_cut(small.select("e.u", "e.v").filter("u <> v").distinct(), name)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links for each row: the class's smallest doc_id, and verified links found at the row's node."""
    signed = table_cut(signature_table(docs), "signatures")
    nodes = table_cut(_nodes(signed), "nodes")
    texts = _numbered(docs).join(nodes.select("__id", "th", "node"), ["__id", "th"]).dropDuplicates(["__id", "th"]).select("node", "text")
    links = _links(nodes, texts)
    held = table_cut(signed.select("__id", "digest").join(nodes.select("digest", "node"), "digest", "left").select("__id", "node"), "rows")
    classes = components(links.unionByName(_same_id(held)))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("node").join(classes, "node", "left").join(degree, "node", "left").select(
        "node", F.coalesce("class", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    worded = held.filter(F.col("node").isNotNull()).join(named, "node").select("__id", "class_id", "n_links")
    # A row without words has the class of its id's other rows.
    bare = held.filter(F.col("node").isNull()).select("__id")
    bare = bare.join(worded.groupBy("__id").agg(F.min("class_id").alias("c")), "__id", "left").select("__id", F.coalesce("c", "__id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(bare).withColumnRenamed("__id", "doc_id")


def _nodes(signed: DataFrame) -> DataFrame:
    """A row for each text: digest, node, n, bands, and __id and th of the row that the text is read from.

    A node's number is the smallest id of its text's rows. Where an id has several texts, one of them has the number and
    the others one made from the text, larger than any id; links between the texts of an id join them again.
    """
    texts = signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("__id", "th")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = texts.select("digest", "r.__id", "r.th", "n", "bands")
    own = texts.groupBy("__id").agg(F.min("digest").alias("own"))
    made = F.lit(3 << 61) + F.shiftrightunsigned(F.xxhash64("digest"), 3)
    return texts.join(own, "__id").select("digest", "__id", "th", F.when(F.col("digest") == F.col("own"), F.col("__id")).otherwise(made).alias("node"), "n", "bands")


def _same_id(rows: DataFrame) -> DataFrame:
    """Links of an id's smallest node with its others: a, b."""
    pairs = rows.filter(F.col("node").isNotNull()).distinct()
    several = pairs.groupBy("__id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a <> hi").select("__id", "a")
    return pairs.join(several, "__id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _links(nodes: DataFrame, node_texts: DataFrame) -> DataFrame:
    """Verified links that join the classes: a, b. node_texts: node and text, a row for each node."""
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "key")).select(_bucket("band", "key"), "node", "n", "band")
    found = table_cut(_verified(table_cut(_stars(members), "star-pairs"), node_texts), "links")
    classes = table_cut(components(found), "classes")
    open_members = table_cut(_unsettled(members, classes, nodes), "open")
    if open_members.isEmpty():
        return found
    sizes = open_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    few = _verified(table_cut(_small_pairs(open_members, sizes), "small-pairs"), node_texts)
    many = _tile_links(open_members, sizes, node_texts)
    more = table_cut(few.unionByName(many), "more-links")
    return table_cut(found.unionByName(more).distinct(), "links")


def _small_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of different classes in the buckets of up to SMALL nodes: a, b."""
    held = members.join(sizes.filter(F.col("size") <= SMALL).select("bucket"), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("node", "n", "class")).alias("own"))
    fits = lambda x, y: (x["node"] < y["node"]) & (x["class"] != y["class"]) & (F.least(x["n"], y["n"]) >= SIMILARITY * F.greatest(x["n"], y["n"]))
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return held.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b").distinct()


def _tile_links(members: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the classes of the buckets of more than SMALL nodes: a, b.

    A bucket of m tiles has m (m + 1) / 2 pairs of tiles, and a node takes part in m of them. A pair of tiles returns the
    links that join its classes, without those between classes that it has joined already.
    """
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES), F.lit(1))
    placed = (members.join(sizes.filter(F.col("size") > SMALL).select("bucket", tiles.cast("int").alias("tiles")), "bucket")
              .withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")))
    one = placed.filter("tiles = 1").select("bucket", F.lit(0).alias("s"), F.lit(0).alias("t"), "tile", "node", "class")
    cut = placed.filter("tiles > 1").select("bucket", "tile", "node", "class", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("peer")).select(
        "bucket", F.least("tile", "peer").alias("s"), F.greatest("tile", "peer").alias("t"), "tile", "node", "class")
    placed = table_cut(one.unionByName(cut), "tiles")
    bags = table_cut(bag_table(texts.join(placed.select("node").distinct(), "node", "left_semi")), "tile-bags")
    return placed.join(bags, "node").groupBy("bucket", "s", "t").applyInPandas(_join_tiles, "a long, b long").distinct()


def _join_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """a, b: verified links of two tiles (or within one) that join their classes."""
    pdf = pdf.sort_values("node")
    if pdf["s"].iloc[0] == pdf["t"].iloc[0]:
        left = right = pdf
    else:
        left, right = pdf[pdf["tile"] == pdf["s"]], pdf[pdf["tile"] == pdf["t"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    i, j = similar_pairs(list(left["bag"]), list(right["bag"]), left["class"].to_numpy(), right["class"].to_numpy())
    return pd.DataFrame(_joining(left["node"].to_numpy()[i], right["node"].to_numpy()[j], left["class"].to_numpy()[i], right["class"].to_numpy()[j]), columns=["a", "b"], dtype=np.int64)


def similar_pairs(left: list, right: list, left_class: np.ndarray, right_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different classes with a weighted Jaccard similarity of SIMILARITY or more."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    wanted = (left_class[:, None] != right_class[None, :]) & (np.minimum.outer(*sizes) >= SIMILARITY * np.maximum.outer(*sizes))
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return rows, rows
    bags = [[side[k] for k in at] for side, at in ((left, rows), (right, columns))]
    flat = [np.concatenate(b) for b in bags]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    cells = []  # element number and row of what both sides have, by element
    for b, f in zip(bags, flat):
        at = np.searchsorted(both, f)
        on = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool)
        element, row = at[on], np.repeat(np.arange(len(b)), [len(x) for x in b])[on]
        order = np.argsort(element, kind="stable")
        cells.append((element[order], row[order]))
    shared = np.zeros((len(rows), len(columns)), np.int64)
    for start in range(0, len(both), COLUMNS):
        dense = []
        for (element, row), b in zip(cells, bags):
            lo, hi = np.searchsorted(element, [start, start + COLUMNS])
            m = np.zeros((len(b), min(COLUMNS, len(both) - start)), np.float32)
            m[row[lo:hi], element[lo:hi] - start] = 1
            dense.append(m)
        shared += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    either = np.add.outer(sizes[0][rows], sizes[1][columns]) - shared
    i, j = np.nonzero(wanted[np.ix_(rows, columns)] & (shared >= SIMILARITY * either))
    return rows[i], columns[j]


def _joining(a: np.ndarray, b: np.ndarray, class_a: np.ndarray, class_b: np.ndarray) -> list[tuple[int, int]]:
    """The links (smaller node first) that join classes not joined by links before them."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    # one link for each pair of classes is enough
    _, first = np.unique(np.stack([np.minimum(class_a, class_b), np.maximum(class_a, class_b)]), axis=1, return_index=True) if len(a) else (None, [])
    for k in first:
        x, y = top(int(class_a[k])), top(int(class_b[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(int(a[k]), int(b[k])), max(int(a[k]), int(b[k]))))
    return out


def _unsettled(members: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the buckets whose nodes lie in more than one class, with the class.

    A bucket's smallest node, and buckets of two, are left out: there every pair has been compared.
    """
    many = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 2").select("bucket", "first")
    named = nodes.select("node").join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class"))
    shared = members.join(many, "bucket").filter("node <> first").drop("first").join(named, "node")
    split = shared.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("bucket")
    return shared.join(split, "bucket", "left_semi")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: all columns of the class's smallest doc_id, of its texts the smallest; one row if it repeats."""
    own, keep = free_name(docs, "__id"), free_name(docs, "__keep")
    classes = near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias(keep)).distinct()
    rows = docs.withColumn(own, _number())
    return rows.join(classes, F.col(own) == F.col(keep), "left_semi").dropDuplicates([own]).drop(own)
