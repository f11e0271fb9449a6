"""Chosen-path set similarity join over word shingles.

Documents with one shingle set are first folded into one node. Every node gets 64 minwise tokens. Sixteen independent trees
branch the sets by one selected minwise token a level (four levels, no token is used by two trees). A tree node of at most
`LEAF` sets is compared exhaustively; a larger one is branched on. One of more than `PART` sets, too many for a task, is
branched on over the cluster, by the first level at which it falls into parts that a task can hold. What stays larger over all
levels is dense: its sets are compared with `PIVOTS` of them and within salted parts, both chosen anew in each tree. A pair of
similarity s survives d levels of one tree with probability s**d, so the 16 trees miss a pair of 0.85 at depth one with
0.15**16 and at depth four with less than 1e-5, and a pair of 0.80 with 0.2**16 and 2.2e-4. All trees estimate a pair from the
same 64 tokens, so that an estimate that is too low loses it in all of them; links need so few equal tokens that this happens
to a pair at the threshold with less than `MISS`. Estimated links only build clusters; within a cluster every pair that isn't
yet connected is confirmed on the full sets. In a cluster too large for one task the estimated links are confirmed first; every
set that isn't connected to the largest part by then is compared with all sets of the cluster on full sets, in blocks of
bounded size.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, byte_values, connected_components, materialize, mix64, powers, prefix_hash, seeds

TREES, LEVELS, TOKENS = 16, 4, 64
LEAF = 48  # sets that a node compares exhaustively without branching on
PART = 4096  # sets of a dense node that one group holds
PIVOTS = 8  # sets that all sets of a dense node are compared with
CLUSTER_SETS, CLUSTER_SHINGLES = 4096, 2_000_000  # larger clusters are confirmed edge by edge, and then in blocks
STAR = 512  # links of one set that a task confirms
QUERY_SETS, QUERY_SHINGLES = 512, 1_000_000  # what a block holds of the sets outside a cluster's largest part
SLICE_SETS, SLICE_SHINGLES = 4096, 2_000_000  # and of the sets that these are compared with
MISS = 1e-6  # the probability at most that a pair at the threshold is estimated too low for a link
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_MULTIPLIERS = seeds(TOKENS, 77)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `words`-word shingles of a text (ASCII letters lower-cased, words parted by
    ASCII white space); fewer words: one shingle of them all; none: an empty array."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    prefix = prefix_hash(byte_values(data))
    _, inverse = powers(len(data) + 1)
    word = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    width = min(words, len(word))
    n = len(word) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + word[k : k + n])
    return np.unique(out)


def min_tokens(shingles: np.ndarray) -> np.ndarray:
    """64 minwise tokens (32 bits each) of a set that isn't empty."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(best, (_MULTIPLIERS[:, None] * shingles[None, k : k + 4096]).min(axis=1), out=best)
    return (mix64(best) >> U64(32)).astype(np.uint32)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set."""
    mixed = mix64(s ^ U64(0xA5A5A5A5))
    return int(mixed.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(mixed + U64(12345)), initial=U64(0)).view(np.int64))


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, two 64-bit set keys, 64 minwise tokens."""

    def make():
        def step(batch):
            n, keys, tokens = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                keys.append(set_keys(s))
                tokens.append(min_tokens(s).tobytes() if len(s) else None)
            yield {"doc_id": batch.column(0), "text_key": batch.column(1), "n_shingles": n, "k1": [x for x, _ in keys], "k2": [x for _, x in keys], "tokens": tokens}

        return step

    text = F.col("text").cast("string")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text), "doc_id long, text_key long, n_shingles long, k1 long, k2 long, tokens binary", make)


def tree_rows(reps: DataFrame) -> DataFrame:
    """A row for each set (node, tokens) and tree: its node at each level, and its tokens cut to 8 bits for comparison."""

    def make():
        def step(batch):
            if not batch.num_rows:
                return
            ids = np.asarray(batch.column(0))
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            short = [x.tobytes() for x in (tokens & np.uint32(255)).astype(np.uint8)]
            for tree in range(TREES):
                out = {"set": ids, "short": short}
                node = np.full(len(ids), tree + 1, dtype=np.uint64)
                for level in range(LEVELS):
                    node = mix64(node * U64(0x9E3779B97F4A7C15) + tokens[:, tree * LEVELS + level])
                    out[f"n{level + 1}"] = node.view(np.int64)
                yield out

        return step

    return arrow_map(reps, "set long, short binary, n1 long, n2 long, n3 long, n4 long", make)


def least_share(threshold: float) -> float:
    """The share of equal tokens that makes an estimated link: a pair of this similarity has less with `MISS` at most."""
    below = 0.0
    for equal in range(TOKENS + 1):
        below += comb(TOKENS, equal) * threshold**equal * (1 - threshold) ** (TOKENS - equal)
        if below > MISS:
            return equal / TOKENS
    return 1.0


def links_within(tokens: np.ndarray, least: float):
    """A spanning forest of the graph of pairs that agree in `least` of the tokens: each set is compared with all that
    aren't reached yet."""
    rest = np.arange(len(tokens))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = (tokens[rest] == tokens[at]).mean(axis=1) >= least
            for x in rest[near]:
                yield at, x
                frontier.append(x)
            rest = rest[~near]


def branch(ids, tokens, nodes, least, level=1):
    """The recursion within a task: small nodes are compared, larger ones are branched by the next level's token."""
    if len(ids) <= LEAF or level == LEVELS:
        for a, b in links_within(tokens, least):
            yield int(ids[a]), int(ids[b])
        return
    order = np.argsort(nodes[level], kind="stable")
    cuts = np.flatnonzero(np.diff(nodes[level][order])) + 1
    for part in np.split(order, cuts):
        if len(part) > 1:
            yield from branch(ids[part], tokens[part], [x[part] for x in nodes], least, level + 1)


def _by_group(batches, key, size_limit=None):
    """Consecutive rows of one key, as a table each, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held)


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """Estimated links (a, b) between sets (node, tokens), a spanning forest of each tree node."""
    least = least_share(threshold)
    rows = tree_rows(reps)
    kept = ("set", "short", "n1", "n2", "n3", "n4")
    none = F.array().cast("array<struct<h:bigint,set:bigint,short:binary>>")
    parts, rest = [], rows
    for level in range(1, LEVELS + 1):
        n = f"n{level}"
        sizes = materialize(rest.groupBy(n).agg(F.count("*").alias("c")).where("c > 1"), "nodes")  # two numbers a node
        # the table of nodes grows with the input: the same plan at every size, and the rows of a level move once
        shared = materialize(rest.join(sizes.hint("merge"), n).select(*kept, "c"), "level")
        parts.append(shared.where(F.col("c") <= PART).select(F.col(n).alias("group"), F.lit(level).alias("level"), *kept, none.alias("pivots")))
        rest = shared.where(F.col("c") > PART)
        if not rest.limit(1).count():
            break
        if level < LEVELS:
            rest = rest.drop("c")
    else:
        pivot = lambda k: F.min(F.struct(F.xxhash64("n4", "set", F.lit(k)).alias("h"), "set", "short"))
        pivots = rest.groupBy("n4").agg(F.array(*map(pivot, range(PIVOTS))).alias("pivots"))
        salt = F.pmod(F.xxhash64("n4", "set"), F.ceil(F.col("c") / PART))  # n4 differs from tree to tree, and so do salts and pivots
        parts.append(rest.join(pivots, "n4").select(F.xxhash64("n4", salt).alias("group"), F.lit(LEVELS).alias("level"), *kept, "pivots"))
    usual, *others = parts
    for part in others:
        usual = usual.unionByName(part)
    dealt = usual.repartition("group").sortWithinPartitions("group", "set")

    def run(batches):
        for group in _by_group(batches, 0):
            ids = group.column("set").to_numpy()
            tokens = np.frombuffer(b"".join(group.column("short").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            nodes = [group.column(f"n{k}").to_numpy() for k in range(1, LEVELS + 1)]
            pivots = group.column("pivots")[0].as_py()
            found = list(branch(ids, tokens, nodes, least, group.column("level")[0].as_py()))
            for pivot in pivots:
                near = (tokens == np.frombuffer(pivot["short"], dtype=np.uint8)).mean(axis=1) >= least
                found += [(pivot["set"], int(x)) for x in ids[near] if x != pivot["set"]]
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def exact_components(ids: list[int], sets: list[np.ndarray], percent: int):
    """(doc, component) of a cluster: each set is compared with all that aren't reached yet and whose size allows a link."""
    rest = sorted(range(len(ids)), key=lambda i: ids[i])
    while rest:
        root = ids[rest[0]]
        frontier, rest = [rest[0]], rest[1:]
        while frontier:
            at = frontier.pop()
            yield ids[at], root
            left = []
            for x in rest:
                (frontier if similar(sets[at], sets[x], percent) else left).append(x)
            rest = left


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Each row of `docs` (doc_id, text) with n_shingles, component_id and kept, then text_key and link_group.

    Two sets are linked when 100 * intersection >= percent * union. Null or blank texts have no shingles and no links; they
    are components of their own, without a link_group. component_id is the smallest doc_id reachable; kept says that a row has
    it. Rows that repeat a doc_id are documents of their own, linked by their texts only: their link_group (the same for all
    rows of a component) tells them apart, and text_key, a hash of the text, which row is which. A row without a doc_id
    takes part by its text if a row with one has the same set, and has a null component otherwise."""
    prof = materialize(profiles(docs, words), "profiles")
    full = prof.where("n_shingles > 0 and doc_id is not null")
    folded = full.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    reps = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "sets")
    edges = materialize(candidate_edges(reps.select("node", "tokens"), percent / 100), "edges")
    cluster = connected_components(edges)
    sized = cluster.join(reps.select("node", "rep", "n_shingles", "k1", "k2"), "node")
    totals = sized.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
    big = (F.col("sets") > CLUSTER_SETS) | (F.col("shingles") > CLUSTER_SHINGLES)
    members = materialize(sized.join(totals, "component").select("node", "component", "rep", F.col("n_shingles").alias("n"), "k1", "k2", big.alias("big")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    # the one time that whole texts are looked up; members grow with the input, so they are never broadcast
    told = materialize(texts.join(members.hint("merge"), "rep").select("component", "node", "n", "k1", "k2", "big", "text"), "texts")

    def run(batches):
        for group in _by_group(batches, 0):
            ids, sets = _sets(group, words)
            found = list(exact_components(ids, sets, percent))
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in found], pa.int64()), "component": pa.array([x for _, x in found], pa.int64())})

    labels = told.where("not big").select("component", "node", "k1", "k2", "text").repartition("component").sortWithinPartitions("component", "node").mapInArrow(run, "node long, component long")
    large = members.where("big")
    if large.limit(1).count():
        texts = told.where("big").select("node", "k1", "k2", "text")
        links = confirmed(texts, large, edges, words, percent)
        rest = left_over(texts, large, connected_components(links), words, percent)
        labels = labels.unionByName(connected_components(links.unionByName(rest), "links"))
    labelled = reps.select("n_shingles", "k1", "k2", "rep", "node").join(labels, "node", "left").withColumn("link_group", F.coalesce("component", "node")).drop("component", "node")
    smallest = labelled.groupBy("link_group").agg(F.min("rep").alias("component_id"))
    classes = labelled.drop("rep").join(smallest, "link_group")
    out = prof.drop("tokens").join(classes, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "text_key", "link_group")


def _sets(group: pa.Table, words: int) -> tuple[list[int], list[np.ndarray]]:
    """The nodes of a group and their sets. A doc_id that repeats brings other texts, too; those have other keys."""
    out: dict[int, np.ndarray] = {}
    for node, k1, k2, text in zip(*(group.column(c).to_pylist() for c in ("node", "k1", "k2")), group.column("text")):
        if node not in out:
            s = shingle_set(text.as_py(), words)
            if set_keys(s) == (k1, k2):
                out[node] = s
    return list(out), list(out.values())


def confirmed(texts: DataFrame, members: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of large clusters (members: node, component; their texts: node, k1, k2, text) that hold on the full sets: each set with its cluster's first, then every estimated edge of
    every tree between sets that this leaves apart, so that most texts move once."""
    firsts = members.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    links = materialize(star_links(texts, firsts, words, percent), "links")
    parts = members.select("node").join(connected_components(links), "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    inside = edges.join(parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
    apart = inside.where("pa <> pb").select("a", "b")
    return materialize(links.unionByName(star_links(texts, apart, words, percent)), "links")


def star_links(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked on the full sets. A set with its pairs' other ends makes a star; those of
    more than STAR pairs are split."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    ends = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(False).alias("centre"), F.col("b").alias("node"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("centre"), F.col("a").alias("node"))
    rows = ends.unionByName(centres).hint("merge").join(texts, "node").select(F.xxhash64("a", "part").alias("group"), "a", "centre", "node", "k1", "k2", "text")

    def run(batches):
        held = centre = None
        done: set[int] = set()
        for batch in batches:
            found = []
            for group, a, first, node, k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, a) != held:
                    held, centre, done = (group, a), None, set()
                if node in done or (first and centre is not None):
                    continue
                s = shingle_set(text, words)
                if set_keys(s) != (k1, k2):
                    continue
                if first:
                    centre = s
                else:
                    done.add(node)
                    if similar(centre, s, percent):
                        found.append((a, node))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return rows.repartition("group").sortWithinPartitions("group", "a", F.desc("centre"), "node").mapInArrow(run, "a long, b long")


def left_over(texts: DataFrame, members: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of large clusters between parts that `labels` (node, component) keeps apart.

    The sets outside a cluster's largest part are dealt to blocks, all its sets to slices; a group is one block and one slice,
    both of bounded size. A set's shingles are looked up in those of the slice, which counts what it shares with each set there;
    the first link to each other part is given."""
    part = labels.withColumnRenamed("component", "part")
    state = members.select("node", F.col("component").alias("cluster"), "n").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = state.groupBy("cluster", "part").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    largest = F.max_by(F.struct("part", "c", "m"), F.struct("c", "part")).alias("l")
    about = sizes.groupBy("cluster").agg(largest, F.sum("c").alias("c"), F.sum("m").alias("m")).where("c > l.c")
    needed = lambda c, m, sets, shingles: F.greatest(F.ceil(c / sets), F.ceil(m / shingles))
    plan = about.select("cluster", F.col("l.part").alias("main"), needed(F.col("c") - F.col("l.c"), F.col("m") - F.col("l.m"), QUERY_SETS, QUERY_SHINGLES).alias("blocks"), needed(F.col("c"), F.col("m"), SLICE_SETS, SLICE_SHINGLES).alias("slices"))
    sets = state.join(plan, "cluster").hint("merge").join(texts, "node")
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kinds = ["cluster", "node", "part", "k1", "k2", "text"]
    targets = sets.select(*kinds, F.lit(False).alias("query"), dealt(1, "slices").alias("slice"), every("blocks").alias("block"))
    queries = sets.where("part <> main").select(*kinds, F.lit(True).alias("query"), dealt(2, "blocks").alias("block"), every("slices").alias("slice"))
    rows = targets.unionByName(queries)
    grouped = rows.select(F.xxhash64("cluster", "block", "slice").alias("group"), "query", "node", "part", "k1", "k2", "text").repartition("group").sortWithinPartitions("group", F.desc("query"), "node")

    def run(batches):
        for group in _by_group(batches, 0):
            query = group.column("query").to_numpy(zero_copy_only=False)
            asked, own = _sets(group.filter(pa.array(query)), words)
            others, theirs = _sets(group.filter(pa.array(~query)), words)
            n, node, sets = len(asked), [*asked, *others], own + theirs
            wanted = dict(zip(group.column("node").to_pylist(), group.column("part").to_pylist()))
            parts = [wanted[x] for x in node]
            sizes = np.array([len(x) for x in sets[n:]], dtype=np.int64)
            shingles = np.concatenate([np.empty(0, dtype=np.uint64), *sets[n:]])
            order = np.argsort(shingles)
            shingles, owner = shingles[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            found = []
            for i in range(n):
                low = np.searchsorted(shingles, sets[i], "left")
                count = np.searchsorted(shingles, sets[i], "right") - low
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                linked = {int(parts[i])}
                for j in (np.flatnonzero((both > 0) & (100 * both >= percent * (len(sets[i]) + sizes - both))) + n).tolist():
                    if int(parts[j]) not in linked:
                        linked.add(int(parts[j]))
                        found.append((int(node[i]), int(node[j])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return grouped.mapInArrow(run, "a long, b long")
