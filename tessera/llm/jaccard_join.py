"""Jaccard similarity join on word shingles with adaptive multi-match prefixes.

Two sets of which each holds at least three quarters of their union share, among the first
p = n - need + l tokens of either in any common order, at least l tokens (need: the least
overlap that a set of n tokens must have). So a set may take a longer prefix if it then asks
for more shared tokens. The join uses this twice:

1. Screen. In hash order every set shows a prefix with l of about a tenth of its size. A set of
   whose shown tokens fewer than l occur in any other set has no partner and goes. This is the
   only step that moves a share of all tokens, packed and in 32 bits.
2. Join. The remaining sets count their tokens and order them by rarity. Each chooses l by the
   estimated cost of its candidates, and pairs that share min(l, l') prefix tokens are verified.

Groups of copies of any size are joined without listing their pairs: sets first try the most
central member of their token groups, what is linked becomes a component, and only pairs
between different components are still looked at, until all of those are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, discard, materialize, row_key, table
from .components import contract
from .shingles import few_rows, shingle_sets, slices_by_bytes, tidy

#: Bytes of text that a task shingles at once, and packed tokens that it holds before it hands them on.
TEXT_BYTES, HELD_TOKENS = 1_000_000, 1_000_000
#: Text for which there is one shard of tokens, so that a shard's size doesn't grow with the input.
SHARD_TEXT_BYTES = 16_000_000
#: Ids of sets that passed the screen are broadcast up to so many (16 MB).
BROADCAST_ROWS = 1_000_000
#: Verifying a pair costs as much as so many entries of the token index.
VERIFY_COST = 40
#: Token groups of up to so many sets list their pairs of different components; larger ones are held against an index.
GROUP_ROWS = 48
PAIRS_PER_TASK = 4_000_000
#: Tokens of the members of a family that a task indexes; larger families are cut into blocks.
BLOCK_TOKENS = 2_000_000
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def least_overlap(n, num: int, den: int):
    return (n * num + den - 1) // den


def _texts(part: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return part.column(0).to_pylist(), [(t or "").encode() for t in part.column(1).to_pylist()]


def _node(tokens: np.ndarray) -> int:
    """Equal sets are one node. Its number is a 64-bit hash of the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


class _Packer:
    """Tokens by shard: rows of (shard, tokens, index of the owner of each, owners' numbers and sizes)."""

    def __init__(self, shards: int):
        self.shards, self.tokens, self.counts, self.nodes, self.sizes, self.held = shards, [], [], [], [], 0

    def add(self, tokens: np.ndarray, node: int, size: int) -> None:
        self.tokens.append(tokens)
        self.counts.append(len(tokens))
        self.nodes.append(node)
        self.sizes.append(size)
        self.held += len(tokens)

    def rows(self, narrow: bool) -> list[dict]:
        if not self.held:
            return []
        tokens, who = np.concatenate(self.tokens), np.repeat(np.arange(len(self.counts), dtype=np.uint32), self.counts)
        nodes, sizes = np.array(self.nodes, np.int64), np.array(self.sizes, np.int32)
        shard = ((tokens & np.uint64(0xFFFFF)) % np.uint64(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        tokens, who, shard = tokens[order], who[order], shard[order]
        if narrow:
            tokens = ((tokens >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, index = np.unique(who[a:b], return_inverse=True)
            steps = np.diff(index, prepend=0).astype(np.uint8 if len(own) < 256 else np.uint32)  # ascending: small steps
            found.append({"shard": int(shard[a]), "tokens": tokens[a:b].tobytes(), "steps": steps.tobytes(), "nodes": nodes[own].tobytes(), "sizes": sizes[own].tobytes()})
        self.__init__(self.shards)
        return found


def _unpack(row: dict, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, nodes = np.frombuffer(row["tokens"], kind), np.frombuffer(row["nodes"], np.int64)
    steps = np.frombuffer(row["steps"], np.uint8 if len(nodes) < 256 else np.uint32)
    index = np.cumsum(steps, dtype=np.int64)
    return tokens, nodes[index], np.frombuffer(row["sizes"], np.int32)[index]


_PACKED = "shard int, tokens binary, steps binary, nodes binary, sizes binary"
_META = "doc_id long, row long, node long, n long"


def _show(docs: DataFrame, shards: int, width: int, num: int, den: int) -> DataFrame:
    """Per row (doc_id, text, row) its node and number of shingles; per shard the shown tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("shard", pa.int32()), ("tokens", pa.binary()), ("steps", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = _Packer(shards), set()

        def flush():
            seen.clear()
            return pa.RecordBatch.from_pylist(pack.rows(True), schema)

        for part in few_rows(parts):
            ids, texts = _texts(part)
            rows = part.column(2).to_pylist()
            for a, b in slices_by_bytes(list(map(len, texts)), TEXT_BYTES):
                bounds, hashes = shingle_sets(texts[a:b], width)
                meta = []
                for i in range(b - a):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    n, node = len(own), _node(own) if len(own) else None
                    meta.append({"doc_id": ids[a + i], "row": rows[a + i], "node": node, "n": n})
                    if n and node not in seen and ids[a + i] is not None:
                        seen.add(node)
                        pack.add(own[: n - least_overlap(n, num, den) + 1 + n // 10], node, n)
                yield pa.RecordBatch.from_pylist(meta, schema)
                if pack.held > HELD_TOKENS:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, f"{_META}, {_PACKED}")


def _shared(packed: DataFrame, shards: int) -> DataFrame:
    """node, size, m: how many of its shown tokens are shown by other nodes too. Counts are added up within a task first."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("m", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes = [], [], []
        for part in parts:
            for row in part.to_pylist():
                tokens, who, size = _unpack(row, np.uint32)
                keys.append(tokens.astype(np.uint64) << np.uint64(32) | np.uint64(row["shard"]))
                nodes.append(who)
                sizes.append(size)
        if not keys:
            return
        key, node, size = map(np.concatenate, (keys, nodes, sizes))
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node, size = key[fresh], node[fresh], size[fresh]
        same = key[1:] == key[:-1]
        common = np.concatenate((same, [False])) | np.concatenate(([False], same))
        own, at, m = np.unique(node[common], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(size[common][at]), pa.array(m)], schema=schema)
        del keys, nodes, sizes, key, node, size, order, common
        tidy()

    counts = packed.repartition(shards, "shard").mapInArrow(run, "node long, size int, m long")
    return counts.groupBy("node", "size").agg(F.sum("m").alias("m"))


def _tokens_of(docs: DataFrame, shards: int, width: int) -> DataFrame:
    """All tokens of the sets that passed, packed by shard, in 64 bits."""
    schema = pa.schema([("shard", pa.int32()), ("tokens", pa.binary()), ("steps", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(shards)
        for part in few_rows(parts):
            wanted, texts = _texts(part)
            for a, b in slices_by_bytes(list(map(len, texts)), TEXT_BYTES):
                bounds, hashes = shingle_sets(texts[a:b], width)
                for i in range(b - a):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    if len(own) and _node(own) == wanted[a + i]:
                        pack.add(own, wanted[a + i], len(own))
                if pack.held > HELD_TOKENS:
                    yield pa.RecordBatch.from_pylist(pack.rows(False), schema)
        yield pa.RecordBatch.from_pylist(pack.rows(False), schema)

    return docs.mapInArrow(run, _PACKED)


def _counted(packed: DataFrame, shards: int) -> DataFrame:
    """home, nodes, sizes, lengths, tokens, counts: of the sets of a home, one after the other, the tokens of this task's shards that other sets have too, with how many sets have them."""
    schema = pa.schema([("home", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_tokens, nodes, sizes = [], [], []
        for part in parts:
            for row in part.to_pylist():
                for held, x in zip((all_tokens, nodes, sizes), _unpack(row, np.uint64), strict=True):
                    held.append(x)
        if not all_tokens:
            return
        token, node, size = map(np.concatenate, (all_tokens, nodes, sizes))
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node, size = token[fresh], node[fresh], size[fresh]
        _, group, times = np.unique(token, return_inverse=True, return_counts=True)
        count = times[group].astype(np.int32)
        keep = count > 1
        token, node, size, count = token[keep], node[keep], size[keep], count[keep]
        home = (node % shards).astype(np.int32)
        order = np.lexsort((node, home))
        token, node, size, count, home = token[order], node[order], size[order], count[order], home[order]
        for h in np.unique(home):
            a, b = np.searchsorted(home, [h, h + 1])
            own, at, lengths = np.unique(node[a:b], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pylist([{"home": int(h), "nodes": own.tobytes(), "sizes": size[a:b][at].tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "tokens": token[a:b].tobytes(), "counts": count[a:b].tobytes()}], schema)
        del all_tokens, nodes, sizes, token, node, size, count, home, order
        tidy()

    return packed.repartition(shards, "shard").mapInArrow(run, "home int, nodes binary, sizes binary, lengths binary, tokens binary, counts binary")


def _choose(counts: np.ndarray, n: int, need: int) -> int:
    """The l of least cost: index entries of the prefix, and candidates, of which more are ruled out the more tokens they must share."""
    best, at = 1, None
    ahead = np.cumsum(counts - 1)
    for ell in CHOICES:
        p = len(counts) - need + ell
        if p > len(counts):
            break
        cost = ahead[p - 1] * (1 + VERIFY_COST / ell)
        if at is None or cost < at:
            best, at = ell, cost
    return best


def _sets(counted: DataFrame, shards: int, num: int, den: int) -> DataFrame:
    """node, n, ell, central, tokens (common ones, ascending), prefix (array<long>) of the sets with enough common tokens."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("ell", pa.int32()), ("central", pa.float64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for part in parts:
            for row in part.to_pylist():
                nodes, sizes, lengths, tokens, counts = (np.frombuffer(row[k], t) for k, t in (("nodes", np.int64), ("sizes", np.int32), ("lengths", np.int32), ("tokens", np.uint64), ("counts", np.int32)))
                ends = np.cumsum(lengths)
                for node, size, a, b in zip(nodes.tolist(), sizes.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                    own = held.setdefault(node, [size, [], []])
                    own[1].append(tokens[a:b])
                    own[2].append(counts[a:b])
        rows = []
        for node, (n, tokens, counts) in held.items():
            token, count = np.concatenate(tokens), np.concatenate(counts).astype(np.int64)
            need = least_overlap(n, num, den)
            if len(token) < need:
                continue
            order = np.lexsort((token, count))
            ell = _choose(count[order], n, need)
            prefix = token[order][: len(token) - need + ell]
            rows.append({"node": node, "n": n, "ell": ell, "central": float(count.sum()) / n, "tokens": np.sort(token).tobytes(), "prefix": prefix.view(np.int64).tolist()})
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return counted.repartition(shards, "home").mapInArrow(run, "node long, n int, ell int, central double, tokens binary, prefix array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, shards: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar. A set is sent once to each task that has a partner of it."""
    home = lambda c: F.pmod(F.hash(c), F.lit(shards)).alias("home")
    asked = pairs.select(home("a"), "a", "b").distinct()
    none = F.lit(None)
    ask = asked.select("home", "a", "b", none.cast("int").alias("n"), none.cast("binary").alias("tokens"))
    sent = asked.select("home", F.col("a").alias("node")).union(asked.select("home", F.col("b"))).distinct()
    sent = sent.join(sets.select("node", "n", "tokens"), "node").select("home", F.col("node").alias("a"), none.cast("long").alias("b"), "n", "tokens")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, todo = {}, []
        for part in parts:
            for a, b, n, tokens in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if b is None:
                    have[a] = (n, np.frombuffer(tokens, np.uint64))
                else:
                    todo.append((a, b))
        found = []
        for a, b in todo:
            (n, x), (m, y) = have[a], have[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if den * both >= num * (n + m - both):
                found.append({"a": a, "b": b})
        yield pa.RecordBatch.from_pylist(found, schema)
        have.clear()
        tidy()

    return ask.union(sent).repartition(shards, "home").mapInArrow(run, "a long, b long")


def _labelled(index: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return index.withColumn("comp", F.col("node"))
    return index.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _pivots(index: DataFrame, order: F.Column, tries: int, central: bool) -> DataFrame:
    """Pairs of a set and the first, by ``order``, of its token groups. Of these ``tries`` stay: the most central, or those that most of its tokens name."""
    first = index.groupBy("token").agg(F.max(F.struct(order.alias("o"), "node", "n", "comp")).alias("p"))
    near = index.join(first, "token").filter("comp <> p.comp and 4 * least(n, p.n) >= 3 * greatest(n, p.n)")
    votes = near.groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.count(F.lit(1)).alias("votes"), F.max("p.o").alias("o"))
    by = F.struct("o", "votes", "b") if central else F.struct("votes", "o", "b")
    best = votes.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(by), False), 1, tries).alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


def _open(index: DataFrame) -> DataFrame:
    """The index rows of tokens that sets of several components have, with the token's largest component (main) and its number of rows (k)."""
    sizes = index.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k")).filter("comps > 1")
    return index.join(main.drop("comps"), "token")


def _rest(rows: DataFrame) -> DataFrame:
    """Every pair of different components that shares enough prefix tokens, of token groups of a bounded size.

    The members of a group's largest component meet the others, and the others meet each
    other; members of one component never meet.
    """
    a = rows.filter("comp <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "ell", "comp")])
    pairs = a.join(rows, "token").filter("comp <> comp_a and (comp = main or node_a < node) and 4 * least(n, n_a) >= 3 * greatest(n, n_a)")
    pairs = pairs.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b"), F.least("ell", "ell_a").alias("ell"))
    return pairs.groupBy("a", "b", "ell").agg(F.count(F.lit(1)).alias("m")).filter("m >= ell").select("a", "b")


def _families(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components in the larger token groups, whose pairs are never rows.

    Groups with one main component are a family. Its outsiders (sets of other components) are cut
    into parts and its members into blocks, as their comparisons and tokens need, and each part is held
    against an inverted index of each block: all overlaps at once, and a task holds one part and one
    block however large the family is. Of a set's links to a component one a block is told.
    """
    members = materialize(rows.select("main", "node", "comp", "n").distinct(), "join-families")
    sizes = members.groupBy("main").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("comp") != F.col("main")).cast("long")).alias("m"), F.sum("n").alias("tokens"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int"))
    sizes = sizes.select("main", "blocks", F.greatest(F.lit(1), F.ceil(F.col("k") / F.col("blocks") * F.col("m") / PAIRS_PER_TASK)).cast("int").alias("parts"))
    dealt = members.join(sizes, "main")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = dealt.filter("comp <> main").select("main", F.pmod(F.hash("node", F.lit(3)), "parts").alias("part"), every("blocks").alias("block"), "node", "comp", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    inside = dealt.select("main", every("parts").alias("part"), F.pmod(F.hash("node", F.lit(5)), "blocks").alias("block"), "node", "comp", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    both = outside.unionByName(inside).groupBy("main", "part", "block", "node", "comp").agg(F.max("asks").alias("asks"), F.max("held").alias("held"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(members: list[dict]) -> list[dict]:
        held = [m for m in members if m["held"]]
        node, comp, n = (np.array([m[c] for m in held], np.int64) for c in ("node", "comp", "n"))
        sets = [np.frombuffer(m["tokens"], np.uint64) for m in held]
        tokens, who = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        found = []
        for m in members:
            if m["asks"] and held:
                own = np.frombuffer(m["tokens"], np.uint64)
                a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                shared = np.bincount(np.concatenate([who[x:y] for x, y in zip(a, b, strict=True)]), minlength=len(sets))
                near = np.flatnonzero((den * shared >= num * (m["n"] + n - shared)) & (comp != m["comp"]))
                _, first = np.unique(comp[near], return_index=True)
                found += [{"a": m["node"], "b": int(node[k])} for k in near[first]]
        return found

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for part in parts:
            for row in part.to_pylist():
                held.setdefault((row["main"], row["part"], row["block"]), []).append(row)
        for key in list(held):
            yield pa.RecordBatch.from_pylist(links(held.pop(key)), schema)
        tidy()

    sent = both.join(sets.select("node", "n", "tokens"), "node").select("main", "part", "block", "node", "comp", "asks", "held", "n", "tokens")
    return sent.repartition("main", "part", "block").mapInArrow(run, "a long, b long")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(meta, comps): doc_id, row (common.row_key()), node, n of every row; node, comp of every set that has a partner.

    The pairs of a component that the rounds already joined aren't all listed; no component
    is missed. num / den is the least similarity, 3 / 4 at least (the size filter uses it).
    """
    if num * 4 < den * 3:
        raise ValueError("a similarity of 3/4 at least is asked for")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    shards = max(16, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_TEXT_BYTES))
    shown = materialize(_show(rows, shards, width, num, den), "join-shown")
    meta = shown.filter("n is not null").select("doc_id", "row", "node", "n")
    screened = _shared(shown.filter("shard is not null").select("shard", "tokens", "steps", "nodes", "sizes"), shards)
    passed = screened.filter(F.col("m") >= 1 + F.floor(F.col("size") / 10)).select("node")
    owners = materialize(meta.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(passed, "node"), "join-passed")
    texts = rows.join(broadcast_if(owners, BROADCAST_ROWS), "doc_id").select("node", "text")
    sets = materialize(_sets(_counted(_tokens_of(texts, shards, width), shards), shards, num, den), "join-sets")
    index = materialize(sets.select("node", "n", "ell", "central", F.explode("prefix").alias("token")), "join-index")
    discard(owners)
    links, comps, told = None, None, []
    for k in range(rounds + 1):
        now = _labelled(index, comps)
        if k < rounds:
            found = _verify(_pivots(now, F.col("central") if k == 0 else F.xxhash64("node", F.lit(k)), 2, k == 0), sets, shards, num, den)
        else:
            left = materialize(_open(now), "join-open")
            found = _verify(_rest(left.filter(F.col("k") <= GROUP_ROWS)), sets, shards, num, den)
            found = found.union(_families(left.filter(F.col("k") > GROUP_ROWS), sets, num, den))
        found = materialize(found, "join-links")
        told.append(found)
        links = found if links is None else links.union(found)
        before, comps = comps, contract(links)
        discard(before)
    discard(index, sets, left, *told)
    return meta, comps


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """Per row doc_id, row (common.row_key()), n (shingles), comp, best: the component and the first (doc_id, row) of it where it has several rows."""
    meta, comps = jaccard_links(docs, id_col, text_col, width, num, den)
    rows = meta.join(comps, "node", "left").withColumn("comp", F.when(F.col("doc_id").isNull() | F.col("node").isNull(), None).otherwise(F.coalesce("comp", "node")))
    best = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("comp", "best")
    return rows.join(best, "comp", "left").select("doc_id", "row", "n", "comp", "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links. Null and empty texts have no
    shingles and are linked with nothing, equal ones neither. A row without doc_id is linked
    with nothing and its component is null. Rows that repeat an id are judged by their own text
    each. Only the named columns are looked at.
    """
    rows = near_rows(docs, id_col, text_col, width, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES: dict[str, str] = {}
