"""Near copies by SetSketch registers: band their values, estimate jointly by likelihood, verify on full sets.

A document is the set of its five-word shingles. Every shingle throws points of a Poisson process at the registers;
a register holds the least point, on a scale that is exponential with base BASE and truncated at TOP. So registers
of a union are the greater ones of both (merge), and two sets agree in a register about as often as they share
shingles.

1. Equal sets become one node. Nodes meet where all registers of a band are equal.
2. Each node is first compared with the most central node of its buckets, by short bands, so that large groups of near copies never
   make all pairs; what links is one component. Nodes of one such hub are decided by their differences from it.
3. Nodes of different components and hubs that share a bucket are candidates. Their similarity is estimated by maximum
   likelihood over the three counts of registers (greater, equal, less) and both exact sizes; what is likely to
   reach the threshold is verified on the whole sets of both texts.

A pair at the threshold of 0.85 agrees in a band with 0.27 and so misses all of them once in 10^9; the estimate's
deviation there is 0.016, and FLOOR is almost seven of them below. Everything else is exact.

Defined results: null or wordless texts have an empty set and link with nothing; texts of one to four words have
one shingle, the whole sequence; rows of one doc_id are one document; a null doc_id links with nothing and has a
null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm import jaccard
from terralith.llm.common import chunks, joined_by_key, materialize, merged, mix, shingle_hashes, small_batches, table, utf8_column, word_hashes
from terralith.llm.graph import components

PERCENT = 85
#: Registers (a power of two); bands and rows of those that make candidates; base and rate of the scale, and its greatest value.
REGISTERS, BANDS, ROWS = 512, 64, 8
#: Short bands, of the first registers: nodes half alike meet in them, and so find a common central node.
SHORT_BANDS, SHORT_ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Central nodes that a node is compared with: those of most of its bands. The others meet it as candidates.
CENTRES = 4
#: Least estimate of a pair that is compared with its hub, and of one that is verified.
HALF, FLOOR = 0.4, 0.74
#: Similarities among which the likeliest is sought.
GRID = np.linspace(0.0, 1.0, 101)
#: Points drawn at once.
AT_ONCE = 1 << 16


def sketches(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of sets of distinct 64-bit hashes; set k is shingles[first[k]:first[k + 1]].

    A shingle's points come in rising order, each for a random register, and stop when they exceed all that its set
    holds: about n + m log m points for a set of n and m registers.
    """
    n = len(first) - 1
    low = np.full(n * REGISTERS, np.inf)
    owner = np.repeat(np.arange(n), np.diff(first))
    seed, at, drawn = mix(shingles), np.zeros(len(shingles)), np.zeros(len(shingles), np.uint64)
    while len(seed):
        many = int(np.clip(AT_ONCE // len(seed), 1, 64))
        step = drawn[:, None] + np.arange(1, many + 1, dtype=np.uint64)
        h = mix(seed[:, None] + step * np.uint64(0x9E3779B97F4A7C15))
        register = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * REGISTERS)
        x = at[:, None] + np.cumsum(gap, axis=1)
        np.minimum.at(low, (owner[:, None] * REGISTERS + register).ravel(), x.ravel())
        at, drawn = x[:, -1], drawn + np.uint64(many)
        on = at < low.reshape(n, REGISTERS).max(axis=1)[owner]
        seed, at, drawn, owner = seed[on], at[on], drawn[on], owner[on]
    level = np.floor(1.0 - np.log(np.where(np.isinf(low), 1e300, low)) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16).reshape(n, REGISTERS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of both sets."""
    return np.maximum(a, b)


def bands(registers: np.ndarray, many: int, rows: int) -> np.ndarray:
    """A 64-bit key for each of many bands of rows registers of each sketch."""
    parts = registers[:, : many * rows].reshape(len(registers), many, rows).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, many + 1, dtype=np.uint64)), (len(registers), many))
    for k in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return out


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of each row's two sketches, their sizes known."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = chance(u - (1 - u) * GRID), chance(1 - u - u * GRID)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    fit = more * log(above) + less * log(below) + (REGISTERS - more - less) * log(1 - above - below)
    fit[np.minimum(u / (1 - u), (1 - u) / u) + 0.005 < GRID] = -np.inf
    return GRID[np.argmax(fit, axis=1)]


def _profile(batches):
    import pyarrow as pa

    names = ["doc_id", "n", "s1", "s2", "sketch", "mh", "keys"]
    for batch in batches:
        data, offsets = utf8_column(batch.column("text"))
        for a, b in chunks(offsets):
            base = offsets[a]
            words, _, _, first = word_hashes(data[base : offsets[b]], offsets[a : b + 1] - base)
            sets = [np.unique(shingle_hashes(words[first[k] : first[k + 1]], jaccard.SIZE)) for k in range(b - a)]
            size = np.array([len(s) for s in sets], np.int64)
            found = sketches(np.concatenate(sets), np.cumsum([0, *size]))
            s1 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
            s2 = np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
            lists = []
            for many, length in ((SHORT_BANDS, SHORT_ROWS), (BANDS, ROWS)):
                keys = bands(found, many, length).reshape(-1).view(np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, many), pa.int32()), pa.array(keys)))
            rows = [batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([r.tobytes() for r in found], pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(rows, names)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (128 bits that name the set), sketch, mh and keys (of short bands and of bands) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_profile, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch binary, mh array<bigint>, keys array<bigint>"), "setsketch-profile")


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sketches put them at least as near; a node with several sets counts by any of them."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = merged(merged(pairs, side("a"), "a"), side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    both = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            size_a, size_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            near = pa.array(np.flatnonzero(similarity(a, b, size_a, size_b) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(near) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(test, "a bigint, b bigint").distinct()


def candidates(nodes: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components and hubs that share a bucket and are likely near."""
    named = merged(jaccard.placed(nodes, labels, groups), nodes.select("node", "s1", "n", "keys"), ["node", "s1"])
    rows = materialize(named.select("node", "component", "hub", "n", F.explode("keys").alias("bucket")), "setsketch-bands", "zstd")
    ends = [F.expr(f"{f}({c})").alias(f"{f}_{c}") for c in ("component", "hub") for f in ("min", "max")]
    across = rows.groupBy("bucket").agg(F.count("*").alias("m"), *ends).where("min_component <> max_component AND min_hub <> max_hub").select("bucket", "m")
    shared = joined_by_key(rows, materialize(across, "setsketch-across"), "bucket", rows.count()).drop("m")
    shared = materialize(shared, "setsketch-shared")
    fits = f"x.bucket = y.bucket AND x.component <> y.component AND x.hub <> y.hub AND x.node < y.node AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"
    met = shared.alias("x").join(shared.hint("merge").alias("y"), F.expr(fits)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return likely(met, nodes, FLOOR)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows = profile(docs)
    nodes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", "sketch", "mh", "keys")])
    nodes = materialize(nodes, "setsketch-nodes", "zstd")
    central = likely(jaccard.central_pairs(nodes, SHORT_BANDS, 1, PERCENT, CENTRES), nodes, HALF)
    compared = jaccard.compare(docs, materialize(central, "setsketch-central"), PERCENT)
    near, groups = compared.where("linked").select("a", "b").distinct(), jaccard.around_hubs(compared, popular=True)
    labels = materialize(components(near.union(jaccard.same_document(rows, nodes))), "setsketch-components")
    found = jaccard.verify(docs, materialize(candidates(nodes, labels, groups), "setsketch-pairs"), PERCENT)
    out = jaccard.joint_classes(rows, labels, found.union(jaccard.difference_links(groups, labels, PERCENT)))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_setsketch(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def link_sql(percent: int, kept: str = "") -> str:
    """Classes by the plain definition: all pairs that share a shingle, counted."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
  FROM w, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS u(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.doc_id),
class AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id{kept} FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)"""


ORACLE_SQL = link_sql(PERCENT, ", coalesce(component_id, d.doc_id) = d.doc_id AS kept")
