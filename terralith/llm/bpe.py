"""Byte-level BPE encoding and decoding; long text by tree concatenation.

Usual texts are encoded whole, inside their task. A text of more than LONG code points is halved, wherever the
middle falls, down to parts of UNIT code points at most, which many tasks encode. Neighbours are joined
pairwise, up a tree: a window from the start of the left side's last pre-token on is split into pre-tokens
anew, and grows to the right until one of its pre-tokens ends where one of the right side's does; from there
outwards both sides agree exactly, as a pre-token depends on the text from its start on only. Where the
window is one pre-token, the last of the left side and the first of the right, its encoding is joined from
theirs: tokens around the join are merged anew, in a window that grows until its first and last tokens are
the ones that either side had, as BPE is settled by neighbouring tokens. A pre-token of over PIECE code
points inside a part is encoded by such halves too.

Defined results: a null text is the empty text (no tokens); repeated rows are encoded each by itself; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialize, small_batches, table

LONG, UNIT, PIECE = 32768, 16384, 2048
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _fast(path: str, pattern: str):
    """The same vocabulary as ranks; it gives the same ids, several times as fast."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


class Codec:
    """Encodes by path's tokenizer (a tokenizers file) and its ranks (a tiktoken file)."""

    def __init__(self, path: str, ranks: str, pattern: str):
        self.args = (path, ranks, pattern)

    @property
    def slow(self):
        return _tokenizer(self.args[0])

    @property
    def fast(self):
        return _fast(*self.args[1:])

    def encode(self, text: str) -> list[int]:
        return self.fast.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")

    def merge(self, units: str) -> list[int]:
        """Plain BPE, without pre-tokens, of a string in the byte alphabet."""
        return [t.id for t in self.slow.model.tokenize(units)]

    def join(self, left: list[int], right: list[int], reach: int = 4) -> list[int]:
        """The encoding of two neighbouring parts of one pre-token, from their own encodings."""
        if not left or not right:
            return left + right
        name = self.slow.id_to_token
        while True:
            i, j = min(reach, len(left)), min(reach, len(right))
            a, b = left[len(left) - i :], right[:j]
            new = self.merge("".join(map(name, a + b)))
            if (i == len(left) or new[0] == a[0]) and (j == len(right) or new[-1] == b[-1]):
                return left[: len(left) - i] + new + right[j:]
            reach *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    @property
    def splitter(self):
        return _compiled(self.args[2])

    def pre_tokens(self, text: str) -> list[int]:
        """Ends of the pre-tokens of a text; a special token is one."""
        ends, at = [], 0
        for k, piece in enumerate(text.split(SPECIAL)):
            if k:
                at += len(SPECIAL)
                ends.append(at)
            ends += [at + m.end() for m in self.splitter.finditer(piece)]
            at += len(piece)
        return ends

    def piece(self, pre: str) -> list[int]:
        """Ids of one pre-token (or special token); a long one by halves."""
        if pre == SPECIAL:
            return self.encode(SPECIAL)
        names = _alphabet(self.args)
        return self.tree([self.merge("".join([names[b] for b in half.encode()])) for half in _halves(pre)])

    def part(self, text: str) -> Part:
        """The encoding of a part by itself, with the places where its pre-tokens end."""
        ends = self.pre_tokens(text)
        starts = [0, *ends[:-1]]
        if any(b - a > PIECE for a, b in zip(starts, ends, strict=True)):
            pieces = [self.piece(text[a:b]) for a, b in zip(starts, ends, strict=True)]
            ids = [i for p in pieces for i in p]
            return Part(text, ids, np.array(ends, np.int64), np.cumsum([len(p) for p in pieces]).astype(np.int64))
        ids = self.encode(text)
        size = _sizes(self.args)
        reach = np.cumsum(size[np.array(ids, np.int64)])
        byte_ends = np.cumsum([len(text[a:b].encode()) for a, b in zip(starts, ends, strict=True)]) if ends else np.zeros(0, np.int64)
        return Part(text, ids, np.array(ends, np.int64), np.searchsorted(reach, byte_ends) + 1)

    def concatenate(self, a: Part, b: Part) -> Part:
        """The encoding of the text a + b."""
        if not a.text or not b.text:
            return a if not b.text else b
        start, first = (int(a.ends[-2]), int(a.counts[-2])) if len(a.ends) > 1 else (0, 0)
        last = a.text[start:]
        reach = 1
        while True:
            reach = min(reach, len(b.ends))
            whole = reach == len(b.ends)
            window = last + b.text[: int(b.ends[reach - 1])]
            ends = self.pre_tokens(window)
            stops = {len(last) + int(e): k + 1 for k, e in enumerate(b.ends[:reach])} | {len(last): 0}
            # the window's own last pre-token may go on beyond it
            agreed = next((k for k, e in enumerate(ends) if e in stops and (whole or k + 1 < len(ends))), None)
            if agreed is not None:
                break
            reach *= 2
        taken = stops[ends[agreed]]
        if agreed == 0 and taken == 1:
            pieces = [self.join(a.ids[first:], b.ids[: int(b.counts[0])])]
        else:
            pieces = [self.piece(window[x:y]) for x, y in zip([0, *ends[:agreed]], ends[: agreed + 1], strict=True)]
        middle = [i for p in pieces for i in p]
        skip = int(b.counts[taken - 1]) if taken else 0
        counts = np.concatenate([a.counts[:-1], first + np.cumsum([len(p) for p in pieces]), b.counts[taken:] + (first + len(middle) - skip)])
        places = np.concatenate([a.ends[:-1], start + np.array(ends[: agreed + 1]), b.ends[taken:] + len(a.text)])
        return Part(a.text + b.text, a.ids[:first] + middle + b.ids[skip:], places, counts)

    def assemble(self, parts: list[Part]) -> list[int]:
        while len(parts) > 1:
            parts = [self.concatenate(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids if parts else []


@dataclass
class Part:
    """A text, its ids, and for each pre-token where it ends in the text and how many ids there are up to it."""

    text: str
    ids: list[int]
    ends: np.ndarray
    counts: np.ndarray


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _sizes(args: tuple[str, str, str]) -> np.ndarray:
    """Bytes of every token."""
    fast = _fast(*args[1:])
    return np.array([len(fast.decode_single_token_bytes(i)) for i in range(fast.n_vocab)], np.int64)


@lru_cache(maxsize=4)
def _alphabet(args: tuple[str, str, str]) -> list[str]:
    """The character that stands for each byte in the tokenizers file."""
    fast, slow = _fast(*args[1:]), _tokenizer(args[0])
    return [slow.id_to_token(fast.encode_single_token(bytes([b]))) for b in range(256)]


def halved(text: str) -> list[str]:
    """Parts of UNIT code points at most, by halves; a special token is never cut."""
    if len(text) <= UNIT:
        return [text]
    middle = len(text) // 2
    found = text.find(SPECIAL, max(0, middle - len(SPECIAL) + 1), middle + len(SPECIAL) - 1)
    if 0 <= found < middle:
        middle = found or len(SPECIAL)
    return halved(text[:middle]) + halved(text[middle:])


def _halves(text: str) -> list[str]:
    if len(text) <= PIECE:
        return [text]
    return _halves(text[: len(text) // 2]) + _halves(text[len(text) // 2 :])


_TEXTS: dict[int, str] = {}


def digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    if not _TEXTS:
        _TEXTS.update((i, str(i)) for i in range(1 << 16))
    said = ",".join([_TEXTS[i] for i in ids]).encode()
    return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def _out(keys, all_ids, codec, want_ids):
    import pyarrow as pa

    d = [digests(codec, ids) for ids in all_ids]
    columns = [keys, pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.string()), pa.array([x[2] for x in d], pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if want_ids:
        columns.append(pa.array(all_ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def default_codec(path: str | None = None, ranks: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encode(docs: DataFrame, codec: Codec | None = None, want_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids of every row of docs."""
    codec = codec or default_codec()
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * want_ids

    def whole(batches):
        for batch in batches:
            yield _out(batch.column("doc_id"), [codec.encode(t) for t in batch.column("text").to_pylist()], codec, want_ids)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = halved(text)
                columns = [pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "unit", "part"])

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [codec.part(t) for t in batch.column("part").to_pylist()]
            lists = [pa.array([x.tolist() for x in column], pa.list_(pa.int32())) for column in ([np.array(p.ids) for p in parts], [p.ends for p in parts], [p.counts for p in parts])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("unit"), batch.column("part"), *lists], ["row", "unit", "part", "ids", "ends", "counts"])

    def joined(group):
        import pyarrow as pa

        group = group.sort_by("unit").combine_chunks()
        columns = [group.column(c).to_pylist() for c in ("part", "ids", "ends", "counts")]
        parts = [Part(t, i, np.array(e, np.int64), np.array(c, np.int64)) for t, i, e, c in zip(*columns, strict=True)]
        return pa.Table.from_batches([_out(group.column("doc_id")[:1].combine_chunks(), [codec.assemble(parts)], codec, want_ids)])

    short = rows.where(F.char_length("text") <= LONG).mapInArrow(whole, schema)
    # row numbers are given to a written table, so every later read sees the same ones
    long = materialize(rows.where(F.char_length("text") > LONG).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = long.select("row", "text").mapInArrow(cut, "row bigint, unit int, part string").repartition(n, "row", "unit")
    ids = units.mapInArrow(each, "row bigint, unit int, part string, ids array<int>, ends array<int>, counts array<int>").join(long.select("row", "doc_id"), "row")
    return short.unionByName(ids.groupBy("row").applyInArrow(joined, schema))


def decode(encoded: DataFrame, codec: Codec | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    codec = codec or default_codec()
    small_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def back(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, f"doc_id {kind}, text string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), want_ids=False)
