"""Exchange formats as Python data sources: shapefiles of polygons and tiled GeoTIFF rasters.

Both are folders on storage that driver and executors share. Every write task makes files of its own; every read task
takes a range of records, or some tiles of one file, by seeking: no file is read whole and none passes through the driver.

Defined results: shapefile names are cut to ten letters and told apart by numbers, texts to 254 bytes, empty geometries
become null shapes; null numbers are blank. Raster cells that aren't written hold the no-data value and have no row when
read. An empty layer makes a folder without files, and reading it gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RING = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<shell:{RING},holes:array<{RING}>>>"
#: Records of a shapefile that one task reads.
RECORDS = 10_000


def _open(path: str):
    """File system and path of an address; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(path: str, end: str) -> list[str]:
    from pyarrow import fs

    store, at = _open(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(end))


def _bytes(store, path: str, start: int, size: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(size, start)


def _put(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


# ---------------------------------------------------------------- shapefiles


def safe_names(columns: list[str]) -> list[str]:
    """Names of at most ten letters, all different: later ones of equal names end in numbers."""
    out: list[str] = []
    for c in columns:
        name, k = c[:10], 0
        while name in out:
            k += 1
            name = f"{c[: 10 - len(str(k)) - 1]}_{k}"
        out.append(name)
    return out


def _signed(ring) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def shape_record(parts) -> bytes:
    """A polygon record: shells clockwise, holes counterclockwise, all closed; a null shape for an empty polygon."""
    rings = []
    for part in parts or []:
        for k, ring in enumerate([part["shell"], *part["holes"]]):
            xy = [(p["x"], p["y"]) for p in ring]
            if len(xy) >= 3:
                xy = xy[::-1] if (_signed(xy) > 0) == (k == 0) else xy
                rings.append([*xy, xy[0]])
    if not rings:
        return struct.pack("<i", 0)
    points = np.array([p for r in rings for p in r], "<f8")
    starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
    box = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8")
    return struct.pack("<i", 5) + box.tobytes() + struct.pack("<2i", len(rings), len(points)) + starts.tobytes() + points.tobytes()


def shape_parts(record: bytes):
    """Parts of a polygon record: each hole goes to the smallest shell around its first corner."""
    if struct.unpack_from("<i", record)[0] != 5:
        return []
    n, m = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n}i", record, 44), m]
    points = np.frombuffer(record, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2).tolist()
    rings = [points[a : b - 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    dots = lambda ring: [{"x": x, "y": y} for x, y in ring]
    shells = sorted(((abs(_signed(r)), r[::-1]) for r in rings if _signed(r) < 0), key=lambda s: s[0])
    parts = [{"shell": dots(r), "holes": []} for _, r in shells]
    for hole in (r for r in rings if _signed(r) > 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        for (_, r), part in zip(shells, parts, strict=True):
            if sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1], strict=True)) % 2:
                part["holes"].append(dots(hole[::-1]))
                break
    return parts


#: Field type, width and decimals of a column type in a dBase table.
_FIELDS = {"bigint": ("N", 20, 0), "int": ("N", 11, 0), "double": ("F", 24, 15), "boolean": ("L", 1, 0), "date": ("D", 8, 0), "string": ("C", 254, 0)}


def _cell(value, kind: str) -> bytes:
    letter, width, _ = _FIELDS[kind]
    if letter == "C":
        # cut between letters, never within one
        return (value or "").encode()[:width].decode(errors="ignore").encode().ljust(width)
    text = "" if value is None else {"L": lambda: "T" if value else "F", "D": lambda: value.strftime("%Y%m%d"), "F": lambda: f"{value:.16e}"}.get(letter, lambda: str(value))()
    return text.encode().rjust(width) if text or letter != "L" else b"?"


def _value(raw: bytes, letter: str, decimals: int):
    import datetime

    if letter == "C":
        return raw.decode().rstrip(" ")
    text = raw.decode().strip()
    if not text or text == "?":
        return None
    if letter == "L":
        return text in "TtYy"
    if letter == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:]))
    return float(text) if letter == "F" or decimals else int(text)


class ShapefileSource(DataSource):
    """Polygons: a column `parts`, and the fields of the dBase table."""

    @classmethod
    def name(cls):
        return "terralith_shapefile"

    def schema(self):
        names = _names(self.options["path"], ".dbf")
        kinds = {"C": "string", "L": "boolean", "D": "date", "F": "double"}
        fields = _dbf(*_dbf_head(names[0], self.options["path"]))[2] if names else []
        return ", ".join([f"`{n}` {kinds.get(k, 'double' if d else 'bigint')}" for n, k, _, d in fields] + [f"parts {PARTS}"])

    def reader(self, schema: StructType):
        return ShapefileReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool):
        return ShapefileWriter(self.options["path"], schema, self.options.get("wkt", ""))


def _dbf_head(name: str, path: str) -> tuple[bytes, str]:
    store, _ = _open(path)
    head = _bytes(store, name, 0, 32)
    return _bytes(store, name, 0, struct.unpack_from("<H", head, 8)[0]), name


def _dbf(head: bytes, name: str):
    """Header size, record size and fields (name, type, width, decimals) of a dBase table."""
    fields = []
    for at in range(32, len(head) - 1, 32):
        if head[at] == 0x0D:
            break
        fields.append((head[at : at + 11].split(b"\0")[0].decode(), chr(head[at + 11]), head[at + 16], head[at + 17]))
    return struct.unpack_from("<H", head, 8)[0], struct.unpack_from("<H", head, 10)[0], fields


@dataclass
class Range(InputPartition):
    name: str
    start: int
    stop: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.names

    def partitions(self):
        store, _ = _open(self.path)
        out = []
        for name in _names(self.path, ".shx"):
            n = (store.get_file_info(name).size - 100) // 8
            out += [Range(name[:-4], k, min(k + RECORDS, n)) for k in range(0, n, RECORDS)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.name:
            return
        store, _ = _open(self.path)
        index = struct.unpack(f">{2 * (part.stop - part.start)}i", _bytes(store, part.name + ".shx", 100 + 8 * part.start, 8 * (part.stop - part.start)))
        top, width, fields = _dbf(*_dbf_head(part.name + ".dbf", self.path))
        n, first = part.stop - part.start, 2 * index[0]
        # the records of a range lie one after the other
        shapes = _bytes(store, part.name + ".shp", first, 2 * index[-2] + 8 + 2 * index[-1] - first)
        rows = _bytes(store, part.name + ".dbf", top + width * part.start, width * n)
        for k in range(n):
            at = 2 * index[2 * k] + 8 - first
            row, raw = {"parts": shape_parts(shapes[at : at + 2 * index[2 * k + 1]])}, rows[width * k : width * (k + 1)]
            at = 1
            for name, letter, size, decimals in fields:
                row[name] = _value(raw[at : at + size], letter, decimals)
                at += size
            yield tuple(row.get(c) for c in self.columns)


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, wkt: str):
        self.path, self.wkt = path, wkt
        self.kinds = {f.name: f.dataType.simpleString() for f in schema if f.name != "parts"}
        unknown = [k for k in self.kinds.values() if k not in _FIELDS]
        if unknown or "parts" not in schema.names:
            raise ValueError(f"a shapefile needs a column parts and holds no {unknown}")

    def write(self, rows):
        shapes, index, table, at, box, n = [], [], [], 50, None, 0
        for row in rows:
            record, n = shape_record(row["parts"]), n + 1
            shapes.append(struct.pack(">2i", n, len(record) // 2) + record)
            index.append(struct.pack(">2i", at, len(record) // 2))
            at += 4 + len(record) // 2
            table.append(b" " + b"".join(_cell(row[c], k) for c, k in self.kinds.items()))
            if len(record) > 4:
                b = struct.unpack_from("<4d", record, 4)
                box = b if box is None else (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
        if not n:
            return Written([])
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *(box or (0, 0, 0, 0)), 0, 0, 0, 0)
        fields = b"".join(name.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, d]) + bytes(14) for name, (k, w, d) in zip(safe_names(list(self.kinds)), map(_FIELDS.get, self.kinds.values()), strict=True))
        width = 1 + sum(_FIELDS[k][1] for k in self.kinds.values())
        dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(fields), width) + fields + b"\r" + b"".join(table) + b"\x1a"
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{uuid.uuid4().hex}"
        for end, data in ((".shp", head(at) + b"".join(shapes)), (".shx", head(50 + 4 * n) + b"".join(index)), (".dbf", dbf), (".prj", self.wkt.encode()), (".cpg", b"UTF-8")):
            _put(store, name + end, data)
        return Written([name + e for e in (".shp", ".shx", ".dbf", ".prj", ".cpg")])

    def abort(self, messages):
        _drop(self.path, messages)


def _drop(path: str, messages) -> None:
    """Files of tasks that were written before the job failed."""
    store, _ = _open(path)
    for name in (f for m in messages if m for f in m.files):
        store.delete_file(name)


# ---------------------------------------------------------------- tiled rasters

TILE = 256
_WIDTH, _LENGTH, _BITS, _PACKED, _SAMPLES, _PLANES = 256, 257, 258, 259, 277, 284
_TILE_WIDTH, _TILE_LENGTH, _TILE_AT, _TILE_SIZE, _FORMAT = 322, 323, 324, 325, 339
_SCALE, _TIE, _NOTES, _NO_DATA = 33550, 33922, 42112, 42113


def geotiff(planes: np.ndarray, left: float, top: float, size: float, no_data: float, names: list[str]) -> bytes:
    """A tiled GeoTIFF of deflated doubles, one plane a band, with corner, cell size, no-data value and band names."""
    bands, rows, cols = planes.shape
    down, along = -(-rows // TILE), -(-cols // TILE)
    tiles = []
    for plane in planes:
        whole = np.full((down * TILE, along * TILE), no_data, "<f8")
        whole[:rows, :cols] = plane
        tiles += [zlib.compress(whole[r : r + TILE, c : c + TILE].tobytes()) for r in range(0, down * TILE, TILE) for c in range(0, along * TILE, TILE)]
    sizes = np.array([len(t) for t in tiles], "<u4")
    starts = (8 + np.cumsum(sizes) - sizes).astype("<u4")
    notes = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{_escaped(n)}</Item>' for k, n in enumerate(names)) + "</GDALMetadata>"
    short = lambda *v: (3, np.array(v, "<u2"))
    text = lambda s: (2, np.frombuffer(s.encode() + b"\0", np.uint8))
    tags = {
        _WIDTH: (4, np.array([cols], "<u4")), _LENGTH: (4, np.array([rows], "<u4")), _BITS: short(*[64] * bands), _PACKED: short(8), 262: short(1), _SAMPLES: short(bands), _PLANES: short(2),
        _TILE_WIDTH: short(TILE), _TILE_LENGTH: short(TILE), _TILE_AT: (4, starts), _TILE_SIZE: (4, sizes), _FORMAT: short(*[3] * bands),
        _SCALE: (12, np.array([size, size, 0], "<f8")), _TIE: (12, np.array([0, 0, 0, left, top, 0], "<f8")), _NOTES: text(notes), _NO_DATA: text(repr(no_data)),
    }
    first = 8 + int(sizes.sum())
    at, entries, rest = first + 2 + 12 * len(tags) + 4, b"", b""
    for tag, (kind, value) in sorted(tags.items()):
        raw = value.tobytes()
        entries += struct.pack("<HHI", tag, kind, len(value)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(rest)))
        rest += raw if len(raw) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, first) + b"".join(tiles) + struct.pack("<H", len(tags)) + entries + bytes(4) + rest


def _escaped(text: str) -> str:
    from xml.sax.saxutils import escape

    return escape(text)


def tiff_tags(store, name: str) -> dict[int, tuple]:
    """Values of all tags of a file's first image."""
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}
    first = struct.unpack("<2sHI", _bytes(store, name, 0, 8))[2]
    n = struct.unpack("<H", _bytes(store, name, first, 2))[0]
    raw, out = _bytes(store, name, first + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from("<HHI", raw, 12 * k)
        form = f"<{count}{sizes[kind]}"
        long = struct.calcsize(form)
        data = raw[12 * k + 8 : 12 * k + 8 + long] if long <= 4 else _bytes(store, name, struct.unpack_from("<I", raw, 12 * k + 8)[0], long)
        out[tag] = struct.unpack(form, data)
    return out


def band_names(notes: bytes) -> dict[int, str]:
    from xml.etree import ElementTree

    items = ElementTree.fromstring(notes.rstrip(b"\0").decode()).iter("Item")
    return {int(i.get("sample")): i.text or "" for i in items if i.get("role") == "description"}


class RasterSource(DataSource):
    """Cells of all rasters of a folder: band (from 0), description, row and col counted from the grid's corner, value.

    Options: left, top and size of the grid; bands, and a window row0, row1, col0, col1 (ends exclusive), choose tiles
    before any is read.
    """

    @classmethod
    def name(cls):
        return "terralith_raster"

    def schema(self):
        return "band int, description string, row bigint, col bigint, value double"

    def reader(self, schema: StructType):
        return RasterReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return RasterWriter(self.options)


@dataclass
class Tile(InputPartition):
    name: str
    tiles: list[tuple[int, int, int, int, int]]  # band, row, col, start, size


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.left, self.top, self.size = options["path"], float(options["left"]), float(options["top"]), float(options["size"])
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.window = tuple(int(options.get(c, d)) for c, d in (("row0", -(2**62)), ("row1", 2**62), ("col0", -(2**62)), ("col1", 2**62)))

    def partitions(self):
        store, _ = _open(self.path)
        out = []
        for name in _names(self.path, ".tif"):
            t = tiff_tags(store, name)
            down, along = -(-t[_LENGTH][0] // t[_TILE_LENGTH][0]), -(-t[_WIDTH][0] // t[_TILE_WIDTH][0])
            row0, col0 = round((self.top - t[_TIE][4]) / self.size), round((t[_TIE][3] - self.left) / self.size)
            chosen = []
            for k, (at, size) in enumerate(zip(t[_TILE_AT], t[_TILE_SIZE], strict=True)):
                band, rest = divmod(k, down * along)
                row, col = row0 + rest // along * t[_TILE_LENGTH][0], col0 + rest % along * t[_TILE_WIDTH][0]
                r0, r1, c0, c1 = self.window
                if (self.bands is None or band in self.bands) and row < r1 and row + t[_TILE_LENGTH][0] > r0 and col < c1 and col + t[_TILE_WIDTH][0] > c0:
                    chosen.append((band, row, col, at, size))
            out += [Tile(name, chosen[k : k + 16]) for k in range(0, len(chosen), 16)]
        return out or [Tile("", [])]

    def read(self, part: Tile):
        import pyarrow as pa

        if not part.name:
            return
        store, _ = _open(self.path)
        t = tiff_tags(store, part.name)
        names, none = band_names(t[_NOTES][0]) if _NOTES in t else {}, float(t[_NO_DATA][0].rstrip(b"\0")) if _NO_DATA in t else float("nan")
        r0, r1, c0, c1 = self.window
        for band, row, col, at, size in part.tiles:
            raw = _bytes(store, part.name, at, size)
            cells = np.frombuffer(zlib.decompress(raw) if t[_PACKED][0] == 8 else raw, "<f8").reshape(t[_TILE_LENGTH][0], t[_TILE_WIDTH][0])
            r, c = np.nonzero((cells != none) & ~np.isnan(cells))
            keep = (row + r >= r0) & (row + r < r1) & (col + c >= c0) & (col + c < c1)
            r, c = r[keep], c[keep]
            n = len(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, band, np.int32)), pa.array([names.get(band)] * n, pa.string()), pa.array((row + r).astype(np.int64)), pa.array((col + c).astype(np.int64)), pa.array(cells[r, c].astype(np.float64))],
                ["band", "description", "row", "col", "value"],
            )


class RasterWriter(DataSourceWriter):
    """Rows: tile_row, tile_col, band, row, col, value, sorted by tile; each tile is a file."""

    def __init__(self, options):
        self.path, self.left, self.top, self.size = options["path"], float(options["left"]), float(options["top"]), float(options["size"])
        self.names, self.no_data = options["names"].split("|"), float(options.get("no_data", "-9999"))

    def write(self, rows):
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        now, planes, made = None, None, []

        def close():
            if now is not None:
                name = f"{base}/tile-{now[0]}-{now[1]}-{uuid.uuid4().hex}.tif"
                _put(store, name, geotiff(planes, self.left + now[1] * TILE * self.size, self.top - now[0] * TILE * self.size, self.size, self.no_data, self.names))
                made.append(name)

        for r in rows:
            if (r["tile_row"], r["tile_col"]) != now:
                close()
                now, planes = (r["tile_row"], r["tile_col"]), np.full((len(self.names), TILE, TILE), self.no_data)
            if r["value"] is not None:
                planes[r["band"], r["row"] - now[0] * TILE, r["col"] - now[1] * TILE] = r["value"]
        close()
        return Written(made)

    def abort(self, messages):
        _drop(self.path, messages)


# ---------------------------------------------------------------- for callers


def _ready(spark: SparkSession) -> None:
    for source in (ShapefileSource, RasterSource):
        spark.dataSource.register(source)


def write_shapefiles(layer: DataFrame, path: str, wkt: str = "") -> None:
    """A layer with a column parts, as many shapefiles as there are tasks with rows."""
    _ready(layer.sparkSession)
    layer.write.format("terralith_shapefile").option("wkt", wkt).mode("append").save(path)


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    _ready(spark)
    return spark.read.format("terralith_shapefile").load(path)


def write_rasters(cells: DataFrame, bands: list[str], path: str, left: float, top: float, size: float) -> None:
    """cells (row, col, a column for each band) as tiles, each a GeoTIFF of all bands."""
    _ready(cells.sparkSession)
    from pyspark.sql import functions as F

    values = F.array(*[F.struct(F.lit(k).alias("band"), F.col(c).cast("double").alias("value")) for k, c in enumerate(bands)])
    flat = cells.select(F.floor(F.col("row") / TILE).cast("bigint").alias("tile_row"), F.floor(F.col("col") / TILE).cast("bigint").alias("tile_col"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.explode(values).alias("v")).select("*", "v.*").drop("v")
    dealt = flat.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col")
    dealt.write.format("terralith_raster").options(left=left, top=top, size=size, names="|".join(bands)).mode("append").save(path)


def read_rasters(spark: SparkSession, path: str, left: float, top: float, size: float, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells with data; bands and window (rows from, to, columns from, to) leave other tiles unread."""
    _ready(spark)
    options = {"left": left, "top": top, "size": size} | ({"bands": ",".join(map(str, bands))} if bands is not None else {}) | (dict(zip(("row0", "row1", "col0", "col1"), window, strict=True)) if window else {})
    return spark.read.format("terralith_raster").options(**options).load(path)
