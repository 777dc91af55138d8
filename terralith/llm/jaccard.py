"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes of near copies it yields.

Documents are sets of five-word shingles; two link when their Jaccard similarity is at least 0.8.

1. Equal sets become one node. A count sketch of fixed size, over all documents, orders shingles from
   rare to common.
2. Large groups of near copies would make all pairs. Each node is first compared with the most central
   node of its MinHash buckets only; what links is one component before the join begins.
3. Nodes compared with one central node are told apart by what sets them off from it: two of them link
   only if enough of these differences, which are few and rare, are common. Their pairs are found by
   prefixes of the differences and decided on the whole of these.
4. The join proper, for all other pairs: a node's prefix holds its rarest shingles, so many that a partner of enough overlap
   must share `matches` of them. A node whose prefix meets many others by the sketch gets a longer prefix
   and asks for more shared shingles. Only pairs from different components are formed and verified, so
   no link between components is lost, and pairs inside one are never listed.

Every pair is decided on the exact sets of both whole texts.

Defined results: null or wordless texts have an empty set and link with nothing; texts of one to four
words have one shingle, the whole sequence; rows of one doc_id are one document; a null doc_id links
with nothing and has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import HOT, chunks, joined_by_key, materialize, merged, mix, shingle_hashes, small_batches, table, utf8_column, word_hashes
from terralith.llm.graph import components

SIZE, PERCENT = 5, 80
#: Counters of the sketch, and hash functions for the first comparison with central nodes.
SKETCH, PERMUTATIONS = 1 << 16, 16
AGREEING = 6
#: Cost of verifying a candidate, in prefix entries shuffled; other nodes that any shingle is taken to
#: meet beyond what the sketch can tell; the longest lengthening, as a part of the set.
VERIFY_COST, UNSEEN, MOST = 64, 0.05, 8
FILTER_BITS = 1 << 23
GROUP = 128

_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))


def _sets(batch):
    """(row, sorted distinct shingle hashes) of every row of a batch with a text column."""
    data, offsets = utf8_column(batch.column("text"))
    for a, b in chunks(offsets):
        base = offsets[a]
        words, _, _, first = word_hashes(data[base : offsets[b]], offsets[a : b + 1] - base)
        for k in range(a, b):
            yield k, np.unique(shingle_hashes(words[first[k - a] : first[k - a + 1]], SIZE))


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SKETCH - 1)).astype(np.int64)


def _i64(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _profile(batches):
    import pyarrow as pa

    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        n, s1, s2, mh = [], [], [], []
        for _, s in _sets(batch):
            counts += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) if len(s) > 2000 else 0
            if len(s) <= 2000:
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n.append(len(s))
            s1.append(np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0))
            s2.append(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0))
            mh.append([(s * (seed | np.uint64(1)) ^ (s >> np.uint64(29)) * seed).min() for seed in _SEEDS] if len(s) else [np.uint64(0)] * PERMUTATIONS)
        flat = _i64(np.array(mh, np.uint64).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PERMUTATIONS), pa.int32()), pa.array(flat, pa.int64()))
        none = pa.nulls(len(n), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(_i64(s1)), pa.array(_i64(s2)), lists, none, pa.nulls(len(n), pa.int64())], ["doc_id", "n", "s1", "s2", "mh", "bucket", "count"])
    at = np.flatnonzero(counts)
    void = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([void, void, void, void, pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(counts[at])], ["doc_id", "n", "s1", "s2", "mh", "bucket", "count"])


def prefix(s: np.ndarray, counts: np.ndarray, usual: float) -> tuple[int, int, np.ndarray]:
    """(matches, length of the prefix against larger sets, prefix against smaller ones) of one set.

    Of two sets with n <= m elements and a similarity of 0.8, at least 8n/9 and 4m/5 elements are
    common, so for any k the first n - ceil(8n/9) + k and m - ceil(4m/5) + k share at least k.
    """
    n = len(s)
    seen = counts[_slot(s)]
    order = np.lexsort((s, seen))
    spare_small, spare_large = n - -(-8 * n // 9), n - -(-4 * n // 5)
    most = max(1, min(n // MOST, n - spare_large))
    met = np.cumsum(UNSEEN + np.maximum(0.0, seen[order[: spare_large + most]] - usual))
    k = np.arange(1, most + 1)
    # entries written and met, and candidates: each shares k of the entries met, so they are met / k
    met = met[spare_large + k - 1]
    k = int(np.argmin(k + met + VERIFY_COST * met / k)) + 1
    return k, spare_small + k, s[order[: spare_large + k]]


def profile(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n, s1, s2 (128 bits that name the set), mh; and the sketch's counters."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = materialize(rows.mapInArrow(_profile, "doc_id bigint, n bigint, s1 bigint, s2 bigint, mh array<bigint>, bucket int, count bigint"), "jaccard-profile")
    return both.where("bucket IS NULL").drop("bucket", "count"), both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count"))


def central_pairs(nodes: DataFrame, keys: int = PERMUTATIONS, agreeing: int = AGREEING, percent: int = PERCENT, most: int | None = None) -> DataFrame:
    """(a, b): each node with the most central node of its buckets, one for each of its keys (column mh).

    A node is the more central, the larger the buckets of all its keys are. Pairs that agree in few
    of them are left to the join, as are all but the `most` central nodes (where given) with which a node agrees in most.
    """
    each = nodes.select("node", F.posexplode("mh").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("bucket"))
    sizes = materialize(each.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "jaccard-buckets")
    total = keys * nodes.count()
    # one row a node again, so that its score needs no join
    held = joined_by_key(each, sizes, "bucket", total).groupBy("node").agg(F.collect_list("bucket").alias("buckets"), F.round(F.sum(F.log("m")), 6).alias("score"))
    held = materialize(held, "jaccard-scores")
    kept = held.select("node", "score", F.explode("buckets").alias("bucket"))
    best = kept.groupBy("bucket").agg(F.count("*").alias("m"), F.max(F.struct("score", (-F.col("node")).alias("neg"))).alias("best"))
    best = best.select("bucket", "m", (-F.col("best.neg")).alias("a"))
    pairs = joined_by_key(kept.select("node", "bucket"), materialize(best, "jaccard-best"), "bucket", total)
    pairs = pairs.select("a", F.col("node").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("same")).where(F.col("same") >= agreeing)
    if most is not None:  # a node has as many rows here as it has keys, at most
        ranked = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("same")).alias("k"), "a"))), 1, most).alias("best"))
        return ranked.select("b", F.explode("best").alias("c")).select(F.col("c.a").alias("a"), "b")  # sizes are the caller's to compare
    size = nodes.select("node", "n")
    pairs = merged(pairs, size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
    pairs = merged(pairs, size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    return pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and compressed text of the documents that ids name (and a few more): a bitmap of bounded
    size keeps most other texts out of the shuffle."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col("node")), F.lit(bits))
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32").cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS INT)))").alias("bits")).collect()
    seen = np.zeros(bits // 32 + 1, np.uint32)
    for w in words:
        seen[w["at"]] = w["bits"]

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((seen[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1))
            texts = batch.column("text").take(pa.array(hit)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(hit)), pa.array([zlib.compress((t or "").encode(), 1) for t in texts], pa.binary())], ["node", "z"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").where("node IS NOT NULL")
    return rows.select("node", "text", bit.alias("bit")).mapInArrow(pack, "node bigint, z binary")


def _compare(batches, percent: int):
    """Rows by (hub, salt), the hub's own first: (a, b) of those that share half of both sets, whether they
    link, and b's n, s1 and differences from a (none where a stands for several texts)."""
    import pyarrow as pa

    def unpack(z: bytes) -> np.ndarray:
        text = np.frombuffer(zlib.decompress(z), np.uint8)
        return np.unique(shingle_hashes(word_hashes(text, np.array([0, len(text)]))[0], SIZE))

    hub, held = None, []
    for batch in batches:
        out = []
        for h, other, z in zip(*(batch.column(c).to_pylist() for c in ("hub", "other", "z")), strict=True):
            s = unpack(z)
            if other == h:
                held = ([t for t in held if not np.array_equal(t, s)] if hub == h else []) + [s]
                hub = h
            elif hub == h and len(s):
                shared = [len(np.intersect1d(t, s, assume_unique=True)) for t in held]
                linked = any(100 * i >= percent * (len(t) + len(s) - i) for t, i in zip(held, shared, strict=True))
                if linked or any(3 * i >= len(t) + len(s) for t, i in zip(held, shared, strict=True)):
                    alone = len(held) == 1
                    out.append((h, other, linked, len(s), np.bitwise_xor.reduce(mix(s)).view(np.int64), _i64(np.setxor1d(held[0], s, assume_unique=True)) if alone else None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], ["a", "b", "linked", "n", "s1", "delta"])


def compare(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b; a written table) of similar nodes, as _compare gives them. The work of a
    node with many pairs is dealt over groups that each get a copy of its text."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = merged(pairs, degree, "a").select(F.col("a").alias("hub"), F.col("b").alias("other"), F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / GROUP)).cast("int").alias("salt"))
    both = dealt.union(dealt.select("hub", F.col("hub").alias("other"), "salt").distinct())
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = merged(both, _packed(docs, ids).withColumnRenamed("node", "other"), "other").select("hub", "salt", "other", "z")
    rows = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("other") != F.col("hub"))
    return materialize(rows.mapInArrow(lambda batches: _compare(batches, percent), "a bigint, b bigint, linked boolean, n int, s1 bigint, delta array<bigint>"), "jaccard-compared")


def verify(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs whose exact similarity is high enough."""
    return compare(docs, pairs, percent).where("linked").select("a", "b").distinct()


def around_hubs(compared: DataFrame, popular: bool = False) -> DataFrame:
    """hub, node, s1, n, delta: every node with the central node it is most like, or (popular) with that which most nodes
    were found like, so that a group of copies has one hub and not several; and these themselves."""
    known = compared.where("delta IS NOT NULL")
    if popular:
        degree = materialize(known.groupBy("a").agg(F.count("*").alias("m")), "jaccard-degrees")
        known = joined_by_key(known, degree, "a", known.count()).withColumn("first", -F.col("m"))
    else:
        known = known.withColumn("first", F.size("delta"))
    best = known.groupBy("b", "s1").agg(F.min_by(F.struct("a", "n", "delta"), F.struct("first", "a")).alias("at"))
    best = best.select(F.col("at.a").alias("hub"), F.col("b").alias("node"), "s1", F.col("at.n").alias("n"), F.col("at.delta").alias("delta"))
    hubs = best.select(F.col("hub").alias("node")).distinct()
    return materialize(best.join(hubs, "node", "left_anti").select("hub", "node", "s1", "n", "delta"), "jaccard-hubs")


def difference_links(groups: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between nodes of one hub and different components.

    With dx and dy differences from the hub, c of them common, x and y differ in dx + dy - 2c shingles, and
    link (at 80 percent) if that is at most (nx + ny) / 9: c must be at least (9dx - nx + 9dy - ny) / 18. Of two nodes of
    different components one doesn't link with the hub (it is far), so that c is at least 1, and a prefix
    of all but c - 1 differences holds a common one. The least 9d - n of the group stands for the partner's;
    a pair is met at its first common difference, after which enough of both must be left.
    """
    unit = math.gcd(100 + percent, 100 - percent)
    up, down = (100 + percent) // unit, (100 - percent) // unit  # 9 and 1 at 80 percent
    total = groups.count()
    named = labels.select(F.col("node").alias("hub"), F.col("component").alias("at_hub"))
    own = merged(groups.groupBy("hub").agg(F.count("*").alias("m")), named, "hub", "left")
    g = joined_by_key(groups, materialize(own, "jaccard-hub-sizes"), "hub", total)
    g = merged(g, labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    far = (F.col("component") != F.coalesce("at_hub", "hub")).alias("far")
    g = g.select("hub", "node", "s1", "n", "delta", "component", far, F.size("delta").alias("d"), F.expr(f"{up} * size(delta) - {down} * n").alias("e"))
    g = materialize(g, "jaccard-around")
    ends = [F.count("*").alias("m"), F.min("e").alias("e_all"), F.min(F.when(F.col("far"), F.col("e"))).alias("e_far")]
    least = materialize(g.groupBy("hub").agg(*ends).where("e_far IS NOT NULL"), "jaccard-least")
    needed = f"d + 1 - greatest(1, cast(ceil((e + if(far, e_all, e_far)) / {2 * up}) AS INT))"
    g = joined_by_key(g, least, "hub", total).withColumn("p", F.expr(needed)).where("p > 0").drop("e_all", "e_far", "m")
    g = materialize(g, "jaccard-groups")
    each = g.select("hub", "node", "s1", "component", "far", "n", "d", "e", "p", F.explode("delta").alias("token"))
    rare = each.groupBy("hub", "token").agg(F.count("*").alias("m"))
    order = Window.partitionBy("hub", "node", "s1").orderBy("m", "token")
    held = materialize(each.join(rare, ["hub", "token"]).withColumn("at", F.row_number().over(order)).where("at <= p AND m > 1").drop("p", "m"), "jaccard-differences")
    fits = f"x.hub = y.hub AND x.token = y.token AND x.component <> y.component AND (NOT y.far OR x.node < y.node) AND x.e + y.e <= {2 * up} * (1 + least(x.d - x.at, y.d - y.at)) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    key = lambda side: [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("node", "s1")]
    met = held.where("far").alias("x").join(held.alias("y"), F.expr(fits)).select(*key("x"), *key("y")).distinct()
    whole = lambda side: g.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "s1", "n", "delta")])
    both = met.join(whole("x"), ["node_x", "s1_x"]).join(whole("y"), ["node_y", "s1_y"])
    same = F.size(F.array_intersect("delta_x", "delta_y"))
    near = both.where(up * (F.size("delta_x") + F.size("delta_y") - 2 * same) <= down * (F.col("n_x") + F.col("n_y")))
    return near.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Per row node, s1, n, matches, small (the length of the prefix against larger sets), the place of the
    last token in the order of all tokens, and the prefix itself."""
    usual = float(np.median(counts)) + 3 * float(np.median(counts)) ** 0.5

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, found, sizes, names = [], [], [], []
            for k, s in _sets(batch):
                if len(s):
                    rows.append(k)
                    found.append(prefix(s, counts, usual))
                    sizes.append(len(s))
                    names.append(np.bitwise_xor.reduce(mix(s)))
            tokens = [f[2] for f in found]
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *map(len, tokens)])
            last = np.array([t[-1] for t in tokens], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(_i64(names)),
                    pa.array(sizes, pa.int32()),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array(counts[_slot(last)], pa.int64()),
                    pa.array(_i64(last ^ np.uint64(1 << 63))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_i64(flat), pa.int64())),
                ],
                ["node", "s1", "n", "matches", "small", "seen", "last", "tokens"],
            )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return own.mapInArrow(run, "node bigint, s1 bigint, n int, matches int, small int, seen bigint, last bigint, tokens array<bigint>")


def _met_tokens(own: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, s1, small) of the tokens that prefixes of different sets hold.

    These rows are the bulk of the join and carry nothing else. A token that may be in more than one part
    in HOT of all shingles is known from the sketch; its rows are combined before they are shuffled.
    """
    hot_slots = np.flatnonzero(counts > max(1, int(counts.sum()) // HOT)).tolist()  # HOT at most
    each = own.select("s1", "small", F.posexplode("tokens").alias("at", "token")).select("token", "s1", (F.col("at") < F.col("small")).alias("small"))
    hot = F.col("token").bitwiseAND(F.lit(SKETCH - 1)).isin(hot_slots)
    by = Window.partitionBy("token")
    cold = each.where(~hot).withColumn("lo", F.min("s1").over(by)).withColumn("hi", F.max("s1").over(by)).where("lo <> hi")
    cold = cold.groupBy("token", "s1").agg(F.max("small").alias("small"))
    once = each.where(hot).groupBy("token", "s1").agg(F.max("small").alias("small"))
    once = materialize(once, "jaccard-hot-tokens")
    keys = once.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return cold.unionByName(joined_by_key(once, keys, "token", once.count()).drop("m"))


def placed(nodes: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """node, s1, component, hub of every node; one without a component or hub is its own."""
    hubs = groups.select("node", "s1", "hub").union(groups.selectExpr("hub AS node", "CAST(NULL AS BIGINT) AS s1", "hub").distinct())
    named = merged(nodes.select("node", "s1"), labels, "node", "left").alias("n")
    named = named.join(hubs.hint("merge").alias("h"), F.expr("n.node = h.node AND (h.s1 IS NULL OR n.s1 = h.s1)"), "left")
    return named.selectExpr("n.node", "n.s1", "coalesce(component, n.node) AS component", "coalesce(hub, n.node) AS hub")


def candidates(docs: DataFrame, nodes: DataFrame, labels: DataFrame, groups: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs of nodes of different components and hubs that share enough of their prefixes."""
    counts = np.zeros(SKETCH, np.int64)
    for r in sketch.collect():  # SKETCH rows at most
        counts[r["bucket"]] = r["count"]
    own = materialize(prefixes(docs, counts), "jaccard-prefixes")
    about = own.select("node", "s1", "n", "matches", F.struct("seen", "last").alias("last"), F.size("tokens").alias("p"))
    named = merged(placed(nodes, labels, groups), about, ["node", "s1"]).dropDuplicates(["node", "s1"])
    rows = materialize(merged(_met_tokens(own, counts), named, "s1").drop("s1"), "jaccard-met")
    # tokens within one component or one hub lead to no pair
    ends = [F.expr(f"{f}({c})").alias(f"{f}_{c}") for c in ("component", "hub") for f in ("min", "max")]
    across = rows.groupBy("token").agg(F.count("*").alias("m"), *ends).where("min_component <> max_component AND min_hub <> max_hub").select("token", "m")
    shared = joined_by_key(rows, materialize(across, "jaccard-across"), "token", rows.count()).drop("m")
    shared = materialize(shared, "jaccard-shared")
    # what a node's prefix shares with no other is missing from its overlap with nodes whose prefix ends later
    most = shared.groupBy("node", "n", "p").agg(F.count("*").alias("h")).selectExpr("node", "cast(n - p + h AS INT) AS most")
    shared = merged(shared, most, "node").drop("p")
    x, y = shared.where("small").alias("x"), shared.hint("merge").alias("y")
    fits = """x.token = y.token AND x.component <> y.component AND x.hub <> y.hub AND struct(x.n, x.node) < struct(y.n, y.node)
        AND 5 * x.n >= 4 * y.n AND 9 * if(x.last <= y.last, x.most, y.most) >= 4 * (x.n + y.n)"""
    met = x.join(y, F.expr(fits)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.matches", "y.matches").alias("k"))
    return met.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("k").alias("k")).where("m >= k").select("a", "b")


def same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of documents to the node of their set; the rows of one doc_id are one document, whatever its sets."""
    return merged(rows.where("n > 0").select("doc_id", "s1", "s2"), nodes.select("node", "s1", "s2"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")


def joint_classes(rows: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (doc_id, n), from components and further links between them."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = merged(merged(found, a, "a", "left"), b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    joint = components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = merged(labels, joint, "component", "left").select("node", F.coalesce("merged", "component").alias("c"))
    alone = merged(joint, labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("merged").alias("c"))
    final = final.union(alone).withColumnRenamed("node", "doc_id")
    return merged(rows.select("doc_id", "n"), final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("c", "doc_id")).alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    rows, sketch = profile(docs)
    nodes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("mh").alias("mh"))
    nodes = materialize(nodes, "jaccard-nodes")
    compared = compare(docs, materialize(central_pairs(nodes), "jaccard-central"))
    near, groups = compared.where("linked").select("a", "b").distinct(), around_hubs(compared)
    labels = materialize(components(near.union(same_document(rows, nodes))), "jaccard-components")
    found = verify(docs, materialize(candidates(docs, nodes, labels, groups, sketch), "jaccard-pairs"))
    return joint_classes(rows, labels, found.union(difference_links(groups, labels)))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one document (the least doc_id) of each class."""
    own = materialize(classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct(), "jaccard-copies")
    return docs.join(own, docs["doc_id"].cast("bigint") == own["__drop"], "left_anti")


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
