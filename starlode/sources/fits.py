"""FITS images and tables: a NumPy codec, and DataFrames over many files.

Listing goes through Spark's file source; a task opens its own frames by path, so pixels
never pass through the JVM. Three layouts are known: ``cube`` (a three-plane primary),
``bayer`` (a mosaic with BAYERPAT) and ``mef`` (three named or first image extensions).
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("R", "G", "B")
PLANE_NAMES = (("RED", "R"), ("GREEN", "G"), ("BLUE", "B"))
NOT_PLANES = ("FOOTPRINT", "MASK", "WEIGHT")
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMNS = {"L": "?", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
BLOCK = 2880


@dataclass
class Hdu:
    header: dict
    data: np.ndarray | None = None

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "")).strip().upper()


@dataclass
class Frame:
    """An image as planes (3, ny, nx) in R, G, B order, with its primary header."""

    path: str
    data: np.ndarray
    header: dict
    layout: str
    bayer: np.ndarray | None = None
    star_tab: dict | None = None
    extra: dict = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, int]:
        return self.data.shape[1:]

    def plane(self, band: str) -> np.ndarray:
        return self.data[BANDS.index(band)]


def open_file(path: str):
    """A file to read and seek in, on the local disk or any file system that pyarrow knows."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_bytes(path: str) -> bytes:
    with open_file(path) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Writes a file under another name first, so that a reader never sees half of it."""
    from pyarrow import fs

    parsed = urlparse(path)
    system, inner = (fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    system.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    with system.open_output_stream(f"{inner}.part") as out:
        out.write(data)
    system.move(f"{inner}.part", inner)


def scan_file(path: str, wanted=None) -> list[Hdu]:
    """The HDUs of a file by their headers alone; data are read only of those for which ``wanted(header)`` holds."""
    out: list[Hdu] = []
    with open_file(path) as f:
        end = f.seek(0, 2)
        end, at = f.tell() if end is None else end, 0
        while at < end:
            f.seek(at)
            raw = b""
            while b"END".ljust(80) not in [raw[i : i + 80] for i in range(max(len(raw) - BLOCK, 0), len(raw), 80)]:
                block = f.read(BLOCK)
                if len(block) < BLOCK:
                    raise ValueError("truncated FITS header")
                raw += block
            header, size = parse_header(raw, 0)
            data = data_size(header)
            if at + size + data > end:
                raise ValueError("truncated FITS data")
            out.append(read_hdus(raw + f.read(data))[0] if wanted is not None and wanted(header) else Hdu(header))
            at += size + -(-data // BLOCK) * BLOCK
    return out


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        out, i = "", 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            out += text[i]
            i += 1
        return out.rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def parse_header(raw: bytes, at: int) -> tuple[dict, int]:
    header: dict = {}
    while True:
        if at + BLOCK > len(raw):
            raise ValueError("truncated FITS header")
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80]
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= " and key not in header:
                header[key] = _value(card[10:])


def _axes(header: dict) -> list[int]:
    return [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]


def data_size(header: dict) -> int:
    """Bytes of an HDU's data, without padding."""
    axes = _axes(header)
    return int(np.prod(axes, dtype=np.int64)) * abs(int(header.get("BITPIX", 8))) // 8 + int(header.get("PCOUNT", 0) or 0) if axes else 0


def read_hdus(raw: bytes) -> list[Hdu]:
    at, out = 0, []
    while at < len(raw):
        header, at = parse_header(raw, at)
        axes, bits, size = _axes(header), int(header.get("BITPIX", 8)), data_size(header)
        hdu = Hdu(header)
        if size:
            if at + size > len(raw):
                raise ValueError("truncated FITS data")
            if header.get("XTENSION") == "BINTABLE":
                hdu.data = _table(header, raw[at : at + axes[0] * axes[1]])
            else:
                x = np.frombuffer(raw, TYPES[bits], int(np.prod(axes, dtype=np.int64)), at).reshape(axes[::-1])
                scale, zero = float(header.get("BSCALE", 1)), float(header.get("BZERO", 0))
                hdu.data = x.astype(np.float32) if scale == 1 and zero == 0 else (x * scale + zero).astype(np.float32)
        out.append(hdu)
        at += -(-size // BLOCK) * BLOCK
    return out


def _table(header: dict, raw: bytes) -> np.ndarray:
    fields = []
    for i in range(1, int(header["TFIELDS"]) + 1):
        form = str(header[f"TFORM{i}"]).strip()
        count = int("".join(c for c in form if c.isdigit()) or 1)
        kind = next(c for c in form if c.isalpha())
        fields.append((str(header.get(f"TTYPE{i}", f"col{i}")).strip(), f"S{count}" if kind == "A" else COLUMNS[kind], *(() if kind == "A" or count == 1 else (count,))))
    return np.frombuffer(raw, np.dtype(fields))


def normalise_cube(data: np.ndarray) -> np.ndarray:
    """(3, ny, nx) float32 from a channel-first or channel-last cube."""
    if data.ndim == 3 and data.shape[0] == 3:
        pass
    elif data.ndim == 3 and data.shape[-1] == 3:
        data = np.moveaxis(data, -1, 0)
    else:
        raise ValueError(f"not a three-band cube: {data.shape}")
    return np.ascontiguousarray(data, np.float32)


def plane_index(hdus: list[Hdu]) -> list[int]:
    """The HDUs of red, green and blue: by name, else the first three images that aren't masks."""
    flat = [i for i, h in enumerate(hdus) if int(h.header.get("NAXIS", 0)) == 2 and h.header.get("XTENSION", "IMAGE") != "BINTABLE" and h.name not in NOT_PLANES]
    named = [next((i for i in flat if hdus[i].name in names), None) for names in PLANE_NAMES]
    if None not in named:
        return named
    if len(flat) < 3:
        raise ValueError(f"{len(flat)} image planes; three are needed")
    return flat[:3]


def layout_of(hdus: list[Hdu]) -> str:
    axes = int(hdus[0].header.get("NAXIS", 0))
    return "cube" if axes == 3 else "bayer" if axes == 2 and hdus[0].header.get("BAYERPAT") else "mef"


def load_frame(path: str, pattern: str | None = None) -> Frame:
    from ..pixels.mosaic import debayer, pattern_of

    hdus = read_hdus(read_bytes(path))
    header, layout = hdus[0].header, layout_of(hdus)
    mosaic = None
    if layout == "cube":
        data = normalise_cube(hdus[0].data)
    elif layout == "bayer":
        mosaic = hdus[0].data
        data = debayer(mosaic, pattern or pattern_of(header))
    else:
        data = np.ascontiguousarray(np.stack([hdus[i].data for i in plane_index(hdus)]), np.float32)
    tab = next((h.data for h in hdus if h.name == "STAR-TAB"), None)
    return Frame(path, data, header, layout, mosaic, {n: tab[n] for n in tab.dtype.names} if tab is not None else None)


# ------------------------------------------------------------------ writing


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{int(value):>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".upper()
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}"[:80].ljust(80).encode("ascii", "replace")


def _padded(raw: bytes, fill: bytes) -> bytes:
    return raw + fill * (-len(raw) % BLOCK)


STRUCTURAL = ("SIMPLE", "XTENSION", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "EXTEND", "PCOUNT", "GCOUNT", "BSCALE", "BZERO", "TFIELDS")


def write_fits(planes: list[tuple[str, np.ndarray | dict | None]], header: dict, extra: dict[str, dict] | None = None) -> bytes:
    """A file of HDUs (name, image or table or None); the first one carries ``header``, others their name and ``extra``."""
    out = io.BytesIO()
    for i, (name, data) in enumerate(planes):
        table = isinstance(data, dict)
        cards = [("SIMPLE", True)] if not i else [("XTENSION", "BINTABLE" if table else "IMAGE")]
        body = b""
        if table:
            kinds = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I"}
            arrays = {k: np.asarray(v) for k, v in data.items()}
            row = np.zeros(len(next(iter(arrays.values()))), [(k, ">" + v.dtype.str[1:]) for k, v in arrays.items()])
            for k, v in arrays.items():
                row[k] = v
            body = row.tobytes()
            cards += [("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", row.dtype.itemsize), ("NAXIS2", len(row)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(arrays))]
            for j, (k, v) in enumerate(arrays.items(), 1):
                cards += [(f"TTYPE{j}", k), (f"TFORM{j}", kinds[v.dtype.str[1:]])]
        elif data is None:
            cards += [("BITPIX", 8), ("NAXIS", 0)]
        else:
            raw = data.dtype == np.uint16
            bits = 16 if raw else 8 if data.dtype == np.uint8 else -32
            cards += [("BITPIX", bits), ("NAXIS", data.ndim), *((f"NAXIS{j + 1}", n) for j, n in enumerate(data.shape[::-1]))]
            cards += [("BZERO", 32768), ("BSCALE", 1)] if raw else []
            body = (data.astype(np.int32) - 32768).astype(">i2").tobytes() if raw else data.astype(TYPES[bits]).tobytes()
        own = header if not i else ({"EXTNAME": name} | (extra or {}).get(name, {}))
        cards += [("EXTEND", True)] if not i else []
        cards += [(k, v) for k, v in own.items() if k not in STRUCTURAL and v is not None]
        out.write(_padded(b"".join(_card(k, v) for k, v in cards) + b"END".ljust(80), b" ") + _padded(body, b"\0"))
    return out.getvalue()


# ------------------------------------------------------------------ DataFrames


def list_frames(spark: SparkSession, roots: str | list[str], patterns: tuple[str, ...] = ("*.fit", "*.fits"), curate=None) -> DataFrame:
    """(path, length, modified) of the files below the roots, each once, in the order of lower-cased paths.

    ``curate`` is a Column predicate over path, or a function of a path.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    glob = "{" + ",".join(p.removeprefix("/") for p in patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    files = files.select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    if curate is not None:
        if callable(curate) and not hasattr(curate, "_jc"):

            def chosen(batches):
                for batch in batches:
                    yield batch.filter(pa.array([bool(curate(p)) for p in batch.column(0).to_pylist()], pa.bool_()))

            files = files.mapInArrow(chosen, files.schema)
        else:
            files = files.where(curate)
    return files.orderBy(F.lower("path"))


HEADER_SCHEMA = "path string, status string, message string, layout string, ny int, nx int, header map<string,string>"


def _text(value) -> str:
    return ("T" if value else "F") if isinstance(value, bool) else str(value)


def typed_header(texts: dict[str, str]) -> dict:
    """Header values of their texts: flags, numbers, else text."""
    return {k: True if v == "T" else False if v == "F" else _number(v) for k, v in texts.items()}


def _number(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def header_row(path: str) -> tuple:
    """(path, status, message, layout, ny, nx, header) of one file, of which only header blocks are read."""
    try:
        hdus = scan_file(path)
        layout = layout_of(hdus)
        main = hdus[0].header if layout != "mef" else hdus[plane_index(hdus)[0]].header
        last = layout == "cube" and main.get("NAXIS1") == 3 and main.get("NAXIS3") != 3
        ny, nx = (main.get("NAXIS3"), main.get("NAXIS2")) if last else (main.get("NAXIS2"), main.get("NAXIS1"))
        return path, "ok", None, layout, ny, nx, {k: _text(v) for k, v in hdus[0].header.items() if v is not None}
    except Exception as e:
        return path, "failed", f"{type(e).__name__}: {e}", None, None, None, None


def read_headers(frames: DataFrame) -> DataFrame:
    """path, status, message, layout, ny, nx and the primary header of each file; an unreadable one has status failed."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def run(batches):
        for batch in batches:
            rows = [header_row(path) for path in batch.column(0).to_pylist()]
            rows = [(*r[:6], list(r[6].items()) if r[6] is not None else None) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "status", "message", "layout", "ny", "nx", "header"])

    return frames.select("path").mapInArrow(run, HEADER_SCHEMA)


def star_table(path: str) -> np.ndarray | None:
    """A file's STAR-TAB, read without its pixels."""
    found = scan_file(path, lambda h: str(h.get("EXTNAME", "")).strip().upper() == "STAR-TAB")
    return next((h.data for h in found if h.name == "STAR-TAB"), None)


def read_star_tables(frames: DataFrame) -> DataFrame:
    """(path, x, y, flux) rows of the embedded STAR-TAB tables; files without one have none."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                tab = star_table(path)
                if tab is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(tab)), *(pa.array(tab[c].astype(np.float64)) for c in ("x", "y", "flux"))], ["path", "x", "y", "flux"])

    return frames.select("path").mapInArrow(run, "path string, x double, y double, flux double")
