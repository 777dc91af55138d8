"""Exact removal of repeated passages: every byte covered by a 200-byte string that starts anywhere else.

1. Anchors: of the 40-byte grams inside a window of 200 bytes, the one with the least hash (the last of
   ties) is the window's anchor. Equal windows have equal anchors at equal places, so windows need only
   be compared among those of equal anchors. A run of windows with one anchor is one row.
2. Rows whose anchor occurs once go. Rows of one anchor whose contexts (all bytes of all their windows)
   hash alike are repeated whole. Each such class is verified: a BLAKE2b digest of every row's bytes is made
   and the classes whose rows don't all share one digest are given up, their rows compared like all others.
3. The other contexts, one of each class, are gathered by anchor and suffix-sorted from the anchor on and, reversed, from the
   anchor back. Suffixes are compared by binary search over prefix polynomial hashes in a merge sort, and
   neighbours' common extensions are verified byte by byte. Windows are equal where both the forward and
   the backward extension fall in the same class.
4. Anchors with very many contexts are not gathered: their windows are hashed (128 bits) and counted,
   combined before the shuffle.

Defined results: a null text is empty (0 bytes, nothing removed); equal rows are two documents; texts
under 200 bytes keep everything; an empty table gives an empty result. A row is named by a 64-bit hash of
doc_id and text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import chunks, joined_by_key, materialize, mix, small_batches, table, utf8_column

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
#: Anchors with more different contexts than this (9 MB of them) are counted window by window.
HOT = 32768
FILTER_BITS = 1 << 23
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_MASK = np.uint64((1 << 24) - 1)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_P, _INV):
            steps = np.full(n + n // 4 + 64, np.uint64(base))
            steps[0] = 1
            _tables.append(np.cumprod(steps, dtype=np.uint64))
    return _tables


class Hashes:
    """Prefix polynomial hashes of a byte buffer: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.pow, self.inv = _powers(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pow[: len(data)], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.upto[end] - self.upto[start]) * self.inv[start]


class BlockHashes(Hashes):
    """Hashes of substrings of eight bytes or more, over mixed eight-byte blocks: equal hashes can't be made
    by texts that exploit the polynomial (as sums of powers of two terms allow)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = data
        words = np.zeros(n, np.uint64)
        for k in range(8):
            words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        self.pow, self.inv = _powers(n + 1)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * self.pow[:n], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return super().of(start, end - 7)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor position, least and most bytes between a window's start and its anchor, gram hash,
    context hash) of every run of windows; positions within the text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = BlockHashes(data)
    at = np.arange(n - GRAM + 1)
    grams = mix(hashes.of(at, at + GRAM))
    place = at.astype(np.uint64) & _MASK
    low = _least((grams & ~_MASK) | (_MASK - place), SPAN)
    p = np.arange(len(low))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    p = p[p + LENGTH <= offsets[text + 1]]
    if not len(p):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    chosen = p + (((_MASK - (low[p] & _MASK)).astype(np.int64) - p) & int(_MASK))
    new = np.flatnonzero(np.r_[True, (np.diff(chosen) != 0) | (np.diff(p) != 1)])
    first, last, a = p[new], p[np.r_[new[1:] - 1, len(p) - 1]], chosen[new]
    most, least = a - first, a - last
    context = mix(hashes.of(first, last + LENGTH) ^ mix((most * 1024 + least).astype(np.uint64)))
    return text[first], a - offsets[text[first]], least, most, grams[a], context


def _rows(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = utf8_column(batch.column("text"))
        keys = batch.column("key").to_numpy()
        for lo, hi in chunks(offsets):
            base = offsets[lo]
            text, pos, least, most, gram, context = anchors(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys[lo + text]), pa.array(pos.astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16))],
                ["gram", "context", "key", "pos", "least", "most"],
            )


def extension(h: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes at a and b, most at most: binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = h.of(a, a + mid) == h.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of rows by group, then by their bytes start .. start + length: a merge sort whose runs are
    merged all at once, every row finding its place in the sister run by binary search."""
    h, n = Hashes(data), len(start)
    padded = np.append(data, 0).astype(np.int64)

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        short = np.minimum(length[x], length[y])
        e = np.where(group[x] == group[y], extension(h, start[x], start[y], np.where(group[x] == group[y], short, 0)), 0)
        cx = np.where(e < length[x], padded[np.minimum(start[x] + e, len(data))], -1)
        cy = np.where(e < length[y], padded[np.minimum(start[y] + e, len(data))], -1)
        inside = (cx < cy) | ((cx == cy) & ties)
        return np.where(group[x] == group[y], inside, group[x] < group[y])

    order, width = np.arange(n), 1
    while width < n:
        index = np.arange(n)
        run = index // width
        left = run % 2 == 0
        sister = np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(sister, n), np.minimum(sister + width, n)
        begin = low.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) // 2
            other, own = order[mid], order[at]
            # rows of the left run stand before equal rows of the right one
            past = np.where(left[at], before(other, own, False), before(other, own, True))
            low[at] = np.where(past, mid + 1, low[at])
            high[at] = np.where(past, high[at], mid)
        target = (run // 2) * 2 * width + (index - run * width) + (low - begin)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, width = merged, 2 * width
    return order


def _common(data: np.ndarray, order: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """Verified common bytes of each row with the one before it in order, going by step."""
    out = np.zeros(len(order), np.int64)
    x, y = order[1:], order[:-1]
    short = np.where(group[x] == group[y], np.minimum(length[x], length[y]), 0)
    alive = short > 0
    for k in range(int(short.max(initial=0))):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        same = data[start[x[at]] + step * k] == data[start[y[at]] + step * k]
        out[1:][at[same]] = k + 1
        alive[at] = same & (short[at] > k + 1)
    return out


def repeated_windows(group: np.ndarray, least: np.ndarray, most: np.ndarray, contexts: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, r0, r1): the row's windows that start r0 .. r1 bytes before its anchor occur elsewhere."""
    n = len(group)
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    anchor = begin + most
    ahead, back = begin + sizes - anchor, most.astype(np.int64)
    forward = suffix_sort(data, group, anchor, ahead)
    mirrored = data[::-1].copy()
    backward = suffix_sort(mirrored, group, len(data) - anchor, back)
    f_common = _common(data, forward, group, anchor, ahead, 1)
    b_common = _common(data, backward, group, anchor - 1, back, -1)
    # the longest extensions, which a row has with a neighbour in either order, bound its windows
    f_best, b_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    f_best[forward] = np.maximum(f_common, np.append(f_common[1:], 0))
    b_best[backward] = np.maximum(b_common, np.append(b_common[1:], 0))
    low, high = np.maximum(least, LENGTH - f_best), np.minimum(most, b_best)
    hit = np.zeros((n, int(most.max(initial=0)) + 2), bool)
    f_class, b_class = np.empty(n, np.int64), np.empty(n, np.int64)
    f_new, b_new = np.r_[True, group[forward][1:] != group[forward][:-1]], np.r_[True, group[backward][1:] != group[backward][:-1]]
    some = low <= high
    for r in range(int(low[some].min(initial=LENGTH)), int(high[some].max(initial=-1)) + 1):
        live = np.flatnonzero((low <= r) & (r <= high))
        if len(live) < 2:
            continue
        f_class[forward] = np.cumsum(f_new | (f_common < LENGTH - r))
        b_class[backward] = np.cumsum(b_new | (b_common < r))
        code = f_class[live] * (n + 1) + b_class[live]
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        hit[live[by[1:][same]], r] = True
        hit[live[by[:-1][same]], r] = True
    out = []
    for row in np.flatnonzero(hit.any(axis=1)):
        edge = np.flatnonzero(np.diff(np.r_[0, hit[row].astype(np.int8), 0]))
        out += [(int(row), int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]
    return out


def _groups(batches, limit: int = 20_000):
    """Rows of whole anchors, at least limit of them at a time where there are more."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "pos", "least", "most", "bytes")), strict=True)
        while len(held) > limit:
            cut = next((k for k in range(limit, 0, -1) if held[k][0] != held[k - 1][0]), None) or next((k for k in range(limit, len(held)) if held[k][0] != held[k - 1][0]), None)
            if cut is None:
                break
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


def _sorted_windows(batches):
    import pyarrow as pa

    for rows in _groups(batches):
        gram, key, pos, least, most, contexts = zip(*rows, strict=True)
        _, group = np.unique(np.array(gram), return_inverse=True)
        found = repeated_windows(group, np.array(least), np.array(most), list(contexts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[i] for i, _, _ in found], pa.int64()), pa.array([pos[i] - b for i, _, b in found], pa.int32()), pa.array([pos[i] - a + LENGTH for i, a, _ in found], pa.int32())],
            ["key", "start", "end"],
        )


def _hashed_windows(batches):
    import pyarrow as pa

    for batch in batches:
        w, keys, starts = [], [], []
        for key, pos, least, most, context in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "least", "most", "bytes")), strict=True):
            for k in range(most - least + 1):
                w.append(hashlib.blake2b(context[k : k + LENGTH], digest_size=16).digest())
                keys.append(key)
                starts.append(pos - most + k)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32())], ["w", "key", "start"])


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (a written table, one row a key) with z, the compressed text. A bitmap of bounded size over
    the keys keeps most other texts out of the shuffle."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col("key")), F.lit(bits))
    seen = np.zeros(bits // 32 + 1, np.uint32)
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 32 AS INT)").alias("at"))
    for w in words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS INT)))").alias("bits")).collect():
        seen[w["at"]] = w["bits"]

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = pa.array(np.flatnonzero((seen[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)))
            z = [zlib.compress((t or "").encode(), 1) for t in batch.column("text").take(hit).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(hit), pa.array(z, pa.binary())], ["key", "z"])

    packed = texts.select("key", "text", bit.alias("bit")).mapInArrow(pack, "key bigint, z binary")
    return wanted.join(packed.groupBy("key").agg(F.first("z").alias("z")), "key")


SPOTS = "gram bigint, context bigint, key bigint, pos int, least smallint, most smallint, bytes binary, d0 bigint, d1 bigint"


def _contexts(batches):
    """The bytes of every spot's context or, where the spot is only to be verified, their digest."""
    import pyarrow as pa

    for batch in batches:
        spots, digests = [], []
        for key, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "z", "spots")), strict=True):
            text = zlib.decompress(z)
            for s in wanted:
                part = text[s["pos"] - s["most"] : s["pos"] - s["least"] + LENGTH]
                digests.append(hashlib.blake2b(part + b"%d,%d" % (s["least"], s["most"]), digest_size=16).digest() if s["verify"] else bytes(16))
                spots.append((s["gram"], s["context"], key, s["pos"], s["least"], s["most"], None if s["verify"] else part))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [pa.array([x[k] for x in spots], kind) for k, kind in enumerate(kinds)] + [pa.array(halves[:, k].copy()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "key", "pos", "least", "most", "bytes", "d0", "d1"])


def _read_contexts(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """SPOTS of spots (gram, context, key, pos, least, most, verify)."""
    wanted = spots.groupBy("key").agg(F.collect_list(F.struct("gram", "context", "pos", "least", "most", "verify")).alias("spots"))
    return materialize(_with_text(texts, materialize(wanted, "repeat-spots")).mapInArrow(_contexts, SPOTS), "repeat-contexts")


def _cut(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for key, z, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "z", "spans")), strict=True):
            text, kept, at, removed, runs = zlib.decompress(z), [], 0, 0, []
            for s in sorted(spans, key=lambda s: s["start"]):
                if runs and s["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    runs.append([s["start"], s["end"]])
            for a, b in runs:
                kept.append(text[at:a])
                removed += b - a
                at = b
            kept.append(text[at:])
            out.append((key, removed, len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), runs))
        spans = pa.array([[{"start": a, "end": b} for a, b in x[4]] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string()), spans],
            ["key", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_spans(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(key, start, end), overlapping, of the bytes that are repeated; texts: key, text.

    bits: how many of the context hash are used; results are the same with any number, as classes are verified.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(_rows, "gram bigint, context bigint, key bigint, pos int, least smallint, most smallint")
    if bits < 64:
        rows = rows.withColumn("context", F.shiftrightunsigned("context", 64 - bits))
    rows = materialize(rows, "repeat-anchors")
    often = rows.groupBy("gram").agg(F.count("*").alias("m"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("m > 1")
    often = materialize(often.select("gram", "m", F.expr("c0 <> c1").alias("mixed")), "repeat-often")
    total = rows.count()
    marks = materialize(joined_by_key(rows, often, "gram", total).select("gram", "context", "key", "pos", "least", "most", "mixed"), "repeat-marks")
    # of equal contexts one is compared with the others; where there are two, all their windows are repeated
    one = marks.where("mixed").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "least", "most")).alias("s"))
    one = materialize(one, "repeat-kinds")
    alike = joined_by_key(marks.where("mixed"), one.where("n > 1").select("gram", "context", F.col("n").alias("m")), ["gram", "context"], total)
    spot = ["gram", "context", "key", "pos", "least", "most"]
    alike = materialize(marks.where("NOT mixed").select(*spot).unionByName(alike.select(*spot)), "repeat-alike")
    kinds = one.select("gram", "context", "s.*")
    read = _read_contexts(texts, alike.withColumn("verify", F.lit(True)).unionByName(kinds.withColumn("verify", F.lit(False))))
    digests = read.where("bytes IS NULL").groupBy("gram", "context").agg(*[f(d).alias(f"{d}_{f.__name__}") for d in ("d0", "d1") for f in (F.min, F.max)])
    false_ = materialize(digests.where("d0_min <> d0_max OR d1_min <> d1_max").select("gram", "context"), "repeat-false")
    contexts = read.where("bytes IS NOT NULL").select(*spot, "bytes")
    if not false_.isEmpty():
        again = _read_contexts(texts, alike.join(false_, ["gram", "context"]).withColumn("verify", F.lit(False)))
        contexts = contexts.join(false_, ["gram", "context"], "left_anti").unionByName(again.select(*spot, "bytes"))
        alike = alike.join(false_, ["gram", "context"], "left_anti")
    whole = alike.select("key", F.expr("cast(pos - most AS INT)").alias("start"), F.expr(f"cast(pos - least + {LENGTH} AS INT)").alias("end"))
    many = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where(f"kinds > {HOT}").select("gram", F.lit(True).alias("hot"))
    contexts = contexts.join(materialize(many, "repeat-many"), "gram", "left")
    gathered = contexts.where("hot IS NULL").select("gram", "key", "pos", "least", "most", "bytes").repartition(n, "gram").sortWithinPartitions("gram")
    sorted_ = gathered.mapInArrow(_sorted_windows, "key bigint, start int, end int")
    hashed = materialize(contexts.where("hot").select("key", "pos", "least", "most", "bytes").mapInArrow(_hashed_windows, "w binary, key bigint, start int"), "repeat-windows")
    counted = hashed.groupBy("w").agg(F.count("*").alias("m")).where("m > 1").select("w")
    hot = hashed.join(counted, "w").select("key", "start", F.expr(f"start + {LENGTH}").alias("end"))
    return whole.union(sorted_).union(hot)


def remove_repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes, end exclusive) of every row."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    texts = docs.select(key.alias("key"), text.alias("text"))
    spans = materialize(repeated_spans(texts, bits).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeat-spans")
    cut = _with_text(texts, spans).mapInArrow(_cut, "key bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")
    base = docs.select("doc_id", key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    return base.join(cut, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans"
    )


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
