"""N-gram Jaccard self-join of documents, by signature trees.

A document is the set of its distinct runs of five lower-cased words (a shorter text: one run).
Documents link when 100 * |A n B| >= 80 * |A u B|; a component is what links connect.

1. Equal sets are one class, found by a 128-bit digest; only its first document goes on.
2. A set can only link if four fifths of it also occur elsewhere. Chunks of documents tell hash
   buckets which runs they have (every other run, by its hash: any share gives a correct filter)
   and learn which of them another chunk has too, and how many chunks. In an order of all runs
   that puts those nobody else has first, then the rare ones, a set's first n - ceil(0.8 n) + 1
   runs must hold one that any partner has among its own first ones.
   Most documents end here: their first runs are theirs alone.
3. The rest is grouped by common first runs; no link leaves a group. A group of more than
   ``UNIT`` sets is dealt into blocks.
4. Each block gets a signature tree: leaves of 32 similar sets, eight children a node, a node
   with the OR (and the AND) of its sets' bitmaps and their range of sizes. The tree is walked
   against itself; a pair of nodes is dropped when the greatest overlap that sizes and bitmaps
   allow is less than the least that a link of such sizes needs, or when all its sets already
   are in one component. Pairs of sets that are left are compared exactly.
5. Where a group has several blocks, its components' first sets are dealt into blocks anew and
   joined, again and again while that makes them fewer by a quarter: a group of near copies,
   however large, mostly ends as one component. What is left in other components than the group's
   largest is dealt into blocks by size and compared with itself and with the largest component,
   block by block, where sizes allow a link. So a group costs in proportion to its size and to the
   blocks outside its largest component. (A group that neither falls apart by first runs nor grows
   together costs the square of its blocks; the trees are what prunes inside a pair.)

Links are only followed as far as they connect something new; all sets end in the right
component, but links inside a component aren't all listed.

Null and wordless texts have no runs, and are components alone. Rows with a null doc_id link
with nothing and have a null component_id; rows that share a doc_id are one node that has the
links of all its texts. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklode.llm import components as C
from ranklode.llm import kernels as K
from ranklode.llm.chunks import by_bucket, chunked, ddl, packed, rows, shared_counts
from ranklode.session import cut, n_shuffle, ship

RUN = 5
UNIT, UNIT_BYTES, BIN_BYTES = 4096, 16 << 20, 8 << 20
#: Lists of members of at most so many rows (some 20 MB) are broadcast.
BROADCAST_MEMBERS = 200_000
LEAF, FAN = 32, 8


# --- one chunk of documents -------------------------------------------------------------


class _Sets:
    """Sorted distinct run hashes of each document that has an id and a word."""

    def __init__(self, table: pa.Table, run: int):
        doc, null = K.ids(table.column("doc_id"))
        order = np.lexsort((null, doc))
        self.doc, self.null = doc[order], null[order]
        words = K.words(K.texts(table.column("text").combine_chunks().take(pa.array(order))), lower=True)
        n = words.counts()
        h = K.mix(K.grams(words.hash, run))
        short = {k: K.mix(K.grams(words.hash, k), k) for k in range(1, run) if (n == k).any()}
        self.sets = []
        for k, size in enumerate(n.tolist()):
            a = words.bounds[k]
            if size >= run:
                s = np.sort(h[a : a + size - run + 1])
                s = s[np.r_[True, s[1:] != s[:-1]]]
            else:
                s = short[size][a : a + 1] if size else h[:0]
            self.sets.append(s)
        self.n = np.array([len(s) for s in self.sets], np.int64)

    def only(self, docs: np.ndarray):
        keep = np.flatnonzero(K.member(self.doc, np.sort(docs)) & (self.n > 0) & ~self.null)
        return self.doc[keep], [self.sets[k] for k in keep]


def _half(h: np.ndarray) -> np.ndarray:
    return (h & K.U64(2)) == 0


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> K.U64(32)).astype(np.uint32)


def need(n):
    """Least overlap of a set of n with any partner."""
    return (4 * n + 4) // 5


# --- signature trees --------------------------------------------------------------------


class Forest:
    """Components of numbered sets."""

    def __init__(self, labels):
        names, first, at = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[at].tolist()

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Tree:
    def __init__(self, number: np.ndarray, sets: list[np.ndarray], bits: int):
        size = np.array([len(s) for s in sets], np.int64)
        least = np.array([s[0] for s in sets], K.U64)  # near copies mostly share it
        last = np.array([s[-1] for s in sets], K.U64)
        order = np.lexsort((size, last, least))
        self.number, self.sets, size = number[order], [sets[k] for k in order], size[order]
        table = np.zeros((len(sets), bits), bool)
        for k, s in enumerate(self.sets):
            table[k, (s & K.U64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(table, axis=1).view(np.uint64)
        self.size, self.maps = size, maps
        # levels from the leaves up: OR, AND, least and greatest size
        cut_ = np.arange(0, len(sets), LEAF)
        level = (np.bitwise_or.reduceat(maps, cut_), np.bitwise_and.reduceat(maps, cut_), np.minimum.reduceat(size, cut_), np.maximum.reduceat(size, cut_))
        self.levels = [level]
        while len(level[0]) > 1:
            cut_ = np.arange(0, len(level[0]), FAN)
            level = tuple(f.reduceat(x, cut_) for f, x in zip((np.bitwise_or, np.bitwise_and, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, (k + 1) * LEAF)


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _possible(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of one level can hold a set that links with one of nodes j of another."""
    or_a, and_a, lo_a, hi_a = (x[i] for x in a)
    or_b, and_b, lo_b, hi_b = (x[j] for x in b)
    most = np.minimum(hi_a - _count(and_a & ~or_b), hi_b - _count(and_b & ~or_a))
    least = np.maximum((4 * (lo_a + lo_b) + 8) // 9, need(np.maximum(lo_a, lo_b)))
    return (most >= least) & (5 * hi_a >= 4 * lo_b) & (5 * hi_b >= 4 * lo_a)


def _leaf_pairs(a: Tree, b: Tree):
    """Pairs of leaves left by the walk of both trees from their roots."""
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = _possible(a.levels[la], b.levels[lb], i, j)
        i, j = i[ok], j[ok]
        if la == lb == 0 or not len(i):
            return i, j
        down_a, down_b = la >= lb, lb >= la  # the taller tree goes down, or both
        if down_a and la:
            n = len(a.levels[la - 1][0])
            count = np.minimum(FAN, n - i * FAN)
            i, j = K.ranges(i * FAN, count), np.repeat(j, count)
        if down_b and lb:
            n = len(b.levels[lb - 1][0])
            count = np.minimum(FAN, n - j * FAN)
            i, j = np.repeat(i, count), K.ranges(j * FAN, count)
        if down_a and la:
            la -= 1
        if down_b and lb:
            lb -= 1
        if same:
            i, j = i[i <= j], j[i <= j]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    both = int(K.member(x, y).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def join_trees(a: Tree, b: Tree, forest: Forest):
    """Links (as numbers) that connect components."""
    out = []
    i, j = _leaf_pairs(a, b)
    near = np.lexsort((i, j - i))  # what lies together first: it merges most
    for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
        p, q = a.leaf(p), b.leaf(q)
        tops_a = [forest.top(x) for x in a.number[p].tolist()]
        tops_b = [forest.top(x) for x in b.number[q].tolist()]
        if len(set(tops_a) | set(tops_b)) == 1:
            continue
        sa, sb, ma, mb = a.size[p], b.size[q], a.maps[p], b.maps[q]
        most = np.minimum(sa[:, None] - _count(ma[:, None] & ~mb[None]), sb[None] - _count(mb[None] & ~ma[:, None]))
        ok = (9 * most >= 4 * (sa[:, None] + sb[None])) & (np.array(tops_a)[:, None] != np.array(tops_b)[None])
        if a is b and p == q:
            ok = np.triu(ok, 1)
        for x, y in np.argwhere(ok).tolist():
            u, v = int(a.number[p.start + x]), int(b.number[q.start + y])
            if forest.top(u) != forest.top(v) and linked(a.sets[p.start + x], b.sets[q.start + y]):
                forest.join(u, v)
                out.append((u, v))
    return out


def _width(sets) -> int:
    most = max(len(s) for s in sets)
    return min(8192, max(256, 1 << (2 * most - 1).bit_length()))


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edge_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=EDGES)


def _within(docs: np.ndarray, sets: list[np.ndarray]):
    """Connecting links within one unit."""
    if len(docs) < 2:
        return []
    number = np.arange(len(docs))
    tree = Tree(number, sets, _width(sets))
    return [(int(docs[u]), int(docs[v])) for u, v in join_trees(tree, tree, Forest(number))]


def _bin_of_units(key, table):
    comp, block, docs = (table.column(k).to_numpy() for k in ("comp", "block", "doc"))
    blobs = table.column("x").to_pylist()
    order = np.lexsort((docs, block, comp))
    cuts = np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    out = []
    for at in np.split(order, cuts):
        out += _within(docs[at], [np.frombuffer(blobs[k], K.U64) for k in at])
    return _edge_table(out)


def _pair_of_blocks(key, table):
    docs, side, label = (table.column(k).to_numpy() for k in ("doc", "side", "label"))
    sets = [np.frombuffer(x, K.U64) for x in table.column("x").to_pylist()]
    bits = _width(sets)
    trees = []
    for s in (0, 1):
        at = np.flatnonzero(side == s)
        if not len(at):
            return EDGES.empty_table()
        trees.append(Tree(at, [sets[k] for k in at], bits))
    return _edge_table([(int(docs[u]), int(docs[v])) for u, v in join_trees(*trees, Forest(label))])


# --- the join over all documents --------------------------------------------------------


def _survivors(d, run: int, firsts: DataFrame) -> DataFrame:
    """kind 0: doc, n, x (its set); kind 1: b, x (first runs), y (their first document here);
    kind 2: x, y (edges within the chunk)."""
    buckets = d.buckets
    tell, out = packed("b c | h"), pa.schema([("kind", pa.int32()), ("b", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def tell_halves(key, table, chosen):
        if not table.num_rows or not chosen.num_rows:
            return tell.empty_table()
        c = key[0].as_py()
        _, sets = _Sets(table, run).only(K.ids(chosen.column("doc"))[0])
        if not sets:
            return tell.empty_table()
        h = np.concatenate([s[_half(s)] for s in sets])
        h = np.unique(h)
        return rows(tell, [(b, c, K.blob(np.unique(x))) for b, x in by_bucket((h % K.U64(buckets)).astype(np.int32), _short(h))])

    def candidates(key, table, told):
        if not table.num_rows or not told.num_rows:
            return out.empty_table()
        chosen = told.filter(pc.is_valid(told.column("doc")))
        docs, sets = _Sets(table, run).only(K.ids(chosen.column("doc"))[0])
        if not sets:
            return out.empty_table()
        heard = told.filter(pc.is_valid(told.column("h")))
        size = [len(x) // 4 for x in heard.column("h").to_pylist()]
        known = np.repeat(heard.column("b").to_numpy().astype(K.U64), size) << K.U64(32) | K.join_blobs(heard.column("h"), np.uint32)
        order = np.argsort(known)
        known, level = known[order], K.join_blobs(heard.column("n"), np.uint8)[order]
        flat = np.concatenate(sets)
        bounds = np.cumsum([0, *(len(s) for s in sets)])
        ordered = np.sort(flat)
        often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        # places in the order of runs: 0 nobody else has it; then by how many chunks have it;
        # at last those that weren't told
        rank = np.full(len(flat), 300, np.int64)
        half = np.flatnonzero(_half(flat))
        key = (flat[half] % K.U64(buckets)) << K.U64(32) | _short(flat[half])
        at = np.searchsorted(known, key)
        at[at == len(known)] = 0
        there = known[at] == key if len(known) else np.zeros(len(key), bool)
        rank[half] = np.where(there, level[at].astype(np.int64) + 2 if len(known) else 0, K.member(flat[half], often).astype(np.int64))
        n = np.diff(bounds)
        left = n - need(n) + 1 - K.sums(rank == 0, bounds)  # first runs besides those that are its alone
        who = np.flatnonzero(left > 0)
        data = [(0, None, int(docs[k]), int(n[k]), K.blob(sets[k]), None) for k in who]
        runs = []
        for k in who:
            r = rank[bounds[k] : bounds[k + 1]]
            some = np.flatnonzero(r > 0)
            runs.append(sets[k][some[np.argsort(r[some], kind="stable")[: left[k]]]])
        if not runs:
            return out.empty_table()
        token = np.concatenate(runs)
        owner = np.repeat(np.arange(len(who)), [len(x) for x in runs])
        order = np.argsort(token, kind="stable")
        t, o = token[order], owner[order]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        lead = np.repeat(o[head], np.diff(np.r_[head, len(t)]))
        label = C.local(len(who), o, lead)
        mine = docs[who]
        moved = np.flatnonzero(label != np.arange(len(who)))
        if len(moved):
            data.append((2, None, None, None, K.blob(mine[moved]), K.blob(mine[label[moved]])))
        lone = t[head]
        data += [(1, b, None, None, K.blob(x), K.blob(y)) for b, x, y in by_bucket((lone % K.U64(buckets)).astype(np.int32), lone, mine[o[head]])]
        return rows(out, data)

    chosen = firsts.select(F.pmod(F.xxhash64("doc"), F.lit(d.chunks)).cast("int").alias("c"), "doc")
    told = d.docs.groupBy("c").cogroup(chosen.groupBy("c")).applyInArrow(tell_halves, ddl(tell))
    answers = shared_counts(told, np.uint32)
    none = {"doc": "long", "b": "int", "h": "binary", "n": "binary"}
    side = lambda x: x.select("c", *(k if k in x.columns else F.lit(None).cast(v).alias(k) for k, v in none.items()))
    both = side(chosen).unionByName(side(answers))
    return d.docs.groupBy("c").cogroup(both.groupBy("c")).applyInArrow(candidates, ddl(out))


def _bucket_edges(key, table):
    """Documents that share a first run, each with the first of them."""
    token, doc = K.join_blobs(table.column("x"), K.U64), K.join_blobs(table.column("y"), np.int64)
    order = np.lexsort((doc, token))
    t, d = token[order], doc[order]
    head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    lead = np.repeat(d[head], np.diff(np.r_[head, len(t)]))
    pairs = np.unique(np.stack([d, lead])[:, d != lead], axis=1)
    return pa.table([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], schema=EDGES)


def _unpacked(batches):
    for b in batches:
        u, v = (K.join_blobs(b.column(k), np.int64) for k in ("x", "y"))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=EDGES)


def _of(found: DataFrame, members: DataFrame) -> DataFrame:
    """Members (doc, ...) with their sets x. A bounded list of members goes to the sets, which
    then stay where they are; a longer one is joined by a shuffle."""
    sets = found.filter("kind = 0").select(F.col("doc").alias("_doc"), "x")
    if members.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
        members = F.broadcast(members)
    return sets.join(members, F.col("_doc") == F.col("doc")).drop("_doc")


def _links(found: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what links connect."""
    spark = found.sparkSession
    edges = found.filter("kind = 1").select("b", "x", "y").groupBy("b").applyInArrow(_bucket_edges, "u long, v long")
    edges = edges.unionByName(found.filter("kind = 2").select("x", "y").mapInArrow(_unpacked, "u long, v long"))
    group = C.components(edges)
    member = found.filter("kind = 0").select("doc", "n").join(group, F.col("doc") == F.col("node")).select("doc", "n", "comp")
    sized = member.groupBy(F.col("comp").alias("_comp")).agg(F.count("*").alias("_n"), F.sum(8 * F.col("n")).alias("_bytes"))
    sized = cut(sized.select("_comp", _blocks("_n", "_bytes").alias("blocks"), "_bytes"), "groups")
    most, total = sized.agg(F.max("blocks"), F.sum("_bytes")).first()
    if not total:
        return spark.createDataFrame([], "u long, v long")
    bins = max(1, -(-total // BIN_BYTES))
    member = member.join(sized.drop("_bytes"), F.col("comp") == F.col("_comp")).select("doc", "comp", "n", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))
    member = cut(member, "members")

    def units(x: DataFrame) -> DataFrame:
        x = x.withColumn("bin", F.pmod(F.xxhash64("comp", "block"), F.lit(bins)).cast("int"))
        x = x.select("bin", "comp", "block", "doc", "x").repartition(max(n_shuffle(spark), bins), "bin")
        return x.groupBy("bin").applyInArrow(_bin_of_units, "u long, v long")

    sets = found.filter("kind = 0").select(F.col("doc").alias("_doc"), "x")
    links = cut(units(sets.join(member, F.col("_doc") == F.col("doc")).drop("_doc")), "links")
    if most <= 1:
        return links
    large = member.filter("blocks > 1").select("doc", "comp", "n")
    before = None
    while True:
        marked = _labelled(large, links)
        firsts = marked.filter("doc = label").select("doc", "comp", "n")
        left = firsts.groupBy("comp").agg(F.count("*").alias("_n"), F.sum(8 * F.col("n")).alias("_bytes")).filter("_n > 1")
        left = cut(left.select(F.col("comp").alias("_c"), _blocks("_n", "_bytes").alias("blocks"), "_n"), "firsts")
        now = left.agg(F.sum("_n")).first()[0] or 0
        if not now:
            return links
        if before is not None and 4 * now > 3 * before:
            break
        dealt = firsts.join(left, F.col("comp") == F.col("_c")).select("doc", "comp", F.pmod(F.xxhash64("doc", F.lit(now)), F.col("blocks")).cast("int").alias("block"))
        links = cut(links.unionByName(units(_of(found, dealt))), "links")
        before = now
    sides = _sides(marked)
    if sides is None:
        return links
    return links.unionByName(cut(_of(found, sides).groupBy("comp", "pair").applyInArrow(_pair_of_blocks, "u long, v long"), "links"))


def _blocks(n: str, size: str) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / UNIT), F.ceil(F.col(size) / UNIT_BYTES)).cast("int")


def _labelled(large: DataFrame, links: DataFrame) -> DataFrame:
    """Members of large groups with the first document of their component by now."""
    now = C.components(links).select(F.col("node").alias("_node"), F.col("comp").alias("_label"))
    return cut(large.join(now, F.col("doc") == F.col("_node"), "left").select("doc", "comp", "n", F.coalesce("_label", "doc").alias("label")), "labels")


def _sides(marked: DataFrame) -> DataFrame | None:
    """doc, comp, label, pair, side: the pairs of blocks that may still hold a link between
    components of a group. Side 0 is the largest component or the rest, side 1 the rest; blocks are
    of one class of sizes, and linked sets lie in the same or the next class."""
    sizes = marked.groupBy("comp", "label").agg(F.count("*").alias("_k"))
    main = sizes.groupBy(F.col("comp").alias("_c")).agg(F.max(F.struct("_k", "label"))["label"].alias("main"), F.count("*").alias("_labels")).filter("_labels > 1").drop("_labels")
    rows = marked.join(main, F.col("comp") == F.col("_c")).select("doc", "comp", "label", "n", (F.col("label") != F.col("main")).cast("int").alias("rest"), F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("z"))
    rows = cut(rows, "left-over")
    cells = rows.groupBy("comp", "rest", "z").agg(F.count("*").alias("_n"), F.sum(8 * F.col("n")).alias("_bytes")).select("comp", "rest", "z", _blocks("_n", "_bytes").alias("blocks"))
    cells = cut(cells, "cells")
    every = cells.select("comp", "rest", "z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    a, b = (every.select(*(F.col(k).alias(f"{k}_{s}") for k in every.columns)) for s in "ab")
    near = (F.col("comp_a") == F.col("comp_b")) & (F.abs(F.col("z_a") - F.col("z_b")) <= 1)
    pairs = a.join(b.filter("rest_b = 1"), near).filter("rest_a = 0 or z_a < z_b or (z_a = z_b and b_a <= b_b)")
    name = F.concat_ws(":", "rest_a", "z_a", "b_a", "z_b", "b_b").alias("pair")
    ends = F.explode(F.array(*(F.struct(F.col(f"rest_{s}").alias("rest"), F.col(f"z_{s}").alias("z"), F.col(f"b_{s}").alias("b"), F.lit(k).alias("side")) for k, s in enumerate("ab")))).alias("e")
    pairs = cut(pairs.select(F.col("comp_a").alias("_c"), name, ends).select("_c", "pair", F.col("e.rest").alias("_rest"), F.col("e.z").alias("_z"), F.col("e.b").alias("_b"), "e.side"), "pairs")
    dealt = rows.join(cells.select(F.col("comp").alias("_k"), F.col("rest").alias("_r"), F.col("z").alias("_s"), "blocks"), F.expr("comp = _k and rest = _r and z = _s"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    sides = cut(dealt.join(pairs, F.expr("comp = _c and rest = _rest and z = _z and block = _b")).select("doc", "comp", "label", "pair", "side"), "sides")
    return sides if sides.limit(1).count() else None


def classes(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_shingles, class_id (the first document with the same set), component_id."""
    ship(docs.sparkSession)
    d = chunked(docs)
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def digest(batches):
        for batch in batches:
            s = _Sets(pa.Table.from_batches([batch]), run)
            one = [np.add.reduce(x) if len(x) else K.U64(0) for x in s.sets]
            two = [np.add.reduce(K.mix(x, 3)) if len(x) else K.U64(0) for x in s.sets]
            yield pa.RecordBatch.from_arrays([K.id_array(s.doc, s.null), pa.array(s.n), *(pa.array(np.array(x, K.U64).view(np.int64)) for x in (one, two))], schema=out)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(narrow.mapInArrow(digest, ddl(out)), "digests")
    same = sets.filter("n > 0 and doc_id is not null").groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n").alias("_n")).agg(F.min("doc_id").alias("class_id"))
    same = cut(same, "classes")
    found = cut(_survivors(d, run, same.select(F.col("class_id").alias("doc")).distinct()), "candidates")
    group = C.components(_links(found)).select(F.col("node"), F.col("comp"))
    got = same.join(group, F.col("class_id") == F.col("node"), "left").select("_d1", "_d2", "_n", "class_id", F.coalesce("comp", "class_id").alias("comp"))
    all_ = sets.join(got, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n")) & F.col("doc_id").isNotNull(), "left")
    first = F.coalesce("class_id", "doc_id").alias("class_id")
    return all_.select("doc_id", F.col("n").alias("n_shingles"), first, F.coalesce("comp", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents, of each component only the one with the smallest doc_id (of rows that
    share it, all); rows without doc_id stay."""
    gone = classes(docs, run).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
