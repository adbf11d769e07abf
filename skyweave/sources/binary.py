"""Sources and sinks of the binary catalogue formats.

* ``sky_catalogue``: 48-byte header (magic, version, count, units per Mpc, z range, bounds), then column sections;
  versions 1 (positions and redshift), 2 (and profile bytes), 3 (and sky position, warnings, identity).  Read by row ranges.
* ``fits_table``: the first binary table of a FITS file, by row ranges; scaled, unsigned, null and vector columns.
* ``row_vector``: k numbers a row and nothing else, such as a byte of flags or a pair of corrections.
  These three read only the columns of option ``columns`` (comma separated) or of a given schema; their paths are
  seen by driver and executors alike.  Writers fill a file beside the target, which takes its name at commit.
* chunks (gzip of axis-separated 16-bit deltas), consolidated chunks (64-byte header and five sections) and row-aligned
  float payloads are whole small files: they are read with Spark's binaryFile reader, so from any store, and decoded by
  ``mapInPandas``.  Encoders make gzip members of parts of a file in many tasks; ``write_files`` puts them in place.

Magic strings are parameters: the format doesn't depend on them.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skyweave.sources import files as files_
from skyweave.storage import materialize

#: Fixed: head of a catalogue file: magic, version, count, units per Mpc, z range, bounds.
HEADER = struct.Struct("<4sIIfff6f")
#: Fixed: sections of the catalogue file: column, type, values per row, first version.
SECTIONS = [("pos", "<i2", 3, 1), ("zq", "<u2", 1, 1), ("morph", "u1", 1, 2), ("shape", "u1", 1, 2), ("gr", "u1", 1, 2), ("rz", "u1", 1, 2), ("ra", "<f4", 1, 3), ("dec", "<f4", 1, 3), ("zwarn", "<u4", 1, 3), ("targetid", "<u8", 1, 3)]
SPARK_TYPE = {"<i2": "int", "<u2": "int", "u1": "int", "<f4": "float", "<u4": "bigint", "<u8": "bigint"}


def read_header(path: str) -> dict:
    """Header of a catalogue file, with its size checked."""
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
        size = f.seek(0, 2)
    magic, version, count, units, low, high, *bounds = HEADER.unpack(raw)
    width = sum(np.dtype(t).itemsize * k for _, t, k, v in SECTIONS if v <= version)
    if not 1 <= version <= 3 or size != HEADER.size + width * count:
        raise ValueError(f"{path}: version {version}, {count} rows, {size} bytes")
    return {"magic": magic, "version": version, "count": count, "unitsPerMpc": units, "zMin": low, "zMax": high, "bounds": bounds}


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def ranges(count: int, step: int) -> list[Rows]:
    return [Rows(k, min(count, k + step)) for k in range(0, count, step)] or [Rows(0, 0)]


def picked(options: dict, every: list[tuple[str, str]]) -> str:
    """Schema of the columns (name, type) that option columns names; of all without it."""
    names = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    types = dict(every)
    lost = [c for c in names if c not in types]
    if lost:
        raise ValueError(f"no columns {lost} among {sorted(types)}")
    return ", ".join(f"`{n}` {types[n]}" for n in names or types)


def as_arrow(values: np.ndarray, spark: str) -> pa.Array:
    return pa.array(values.astype({"int": np.int32, "float": np.float32, "bigint": np.int64, "double": np.float64}[spark]))


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict, wanted: list[str]):
        self.path, self.step, self.wanted = options["path"], int(options.get("rowsPerPartition", 1_000_000)), wanted

    def partitions(self):
        return ranges(read_header(self.path)["count"], self.step)

    def read(self, partition: Rows):
        head = read_header(self.path)
        if partition.begin == partition.end:
            return
        at, found = HEADER.size, {"row_index": pa.array(np.arange(partition.begin, partition.end))}
        for name, kind, k, version in SECTIONS:
            if version > head["version"]:
                continue
            size = np.dtype(kind).itemsize * k
            names = [name if k == 1 else f"q{'xyz'[j]}" for j in range(k)]
            if set(names) & set(self.wanted):
                own = np.fromfile(self.path, kind, (partition.end - partition.begin) * k, offset=at + partition.begin * size)
                found |= {n: as_arrow(own[j::k], SPARK_TYPE[kind]) for j, n in enumerate(names)}
            at += size * head["count"]
        yield pa.RecordBatch.from_arrays([found[n] for n in self.wanted], names=self.wanted)


class SkyCatalogue(DataSource):
    """spark.read.format('sky_catalogue').load(path)"""

    @classmethod
    def name(cls) -> str:
        return "sky_catalogue"

    def schema(self) -> str:
        version = read_header(self.options["path"])["version"]
        cols = [("row_index", "bigint")]
        for name, kind, k, v in SECTIONS:
            if v <= version:
                cols += [(name if k == 1 else "q" + "xyz"[j], SPARK_TYPE[kind]) for j in range(k)]
        return picked(self.options, cols)

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> "PlacedWriter":
        o, version = self.options, int(self.options.get("version", 3))
        head = (o.get("magic", "SKYC").encode(), version, int(o["count"]), *(float(o[k]) for k in ("unitsPerMpc", "zMin", "zMax")), *map(float, o["bounds"].split(",")))
        sections = [([n] if k == 1 else ["qx", "qy", "qz"], t) for n, t, k, v in SECTIONS if v <= version]
        return PlacedWriter(o["path"], HEADER.pack(*head), sections, int(o["count"]), overwrite)


class Done(WriterCommitMessage):
    """What a task wrote: ranges of rows, [begin, end), sorted and merged."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = ranges


#: Ranges of rows that a task of PlacedWriter reports at most: the driver merges them.
RANGES = 4096


def merged(ranges: list[tuple[int, int]], what: str) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch as one; a row in two of them aborts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            raise ValueError(f"{what}: row {a} comes more than once")
        if out and a == out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class PlacedWriter(DataSourceArrowWriter):
    """Rows (row_index 0 to count - 1, once each) go to their places in a file that the driver has laid out with its head.

    The file stands beside the target until all tasks are done, and takes its name only if the ranges of rows that the
    tasks report are, together, each row once; a task that runs twice writes the same bytes twice, and only one report
    of it counts.  Tasks take rows in any order, but in few ranges (RANGES): place_rows() sorts them so.  A target that
    exists aborts unless the mode is overwrite; so do numbers that the file's types don't hold, and nulls.
    """

    def __init__(self, path: str, head: bytes, sections: list[tuple[list[str], str]], count: int, overwrite: bool):
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.path, self.part, self.first, self.sections, self.count = path, f"{path}.{uuid.uuid4().hex}.part", len(head), sections, count
        width = sum(np.dtype(t).itemsize * len(names) for names, t in sections)
        with open(self.part, "wb") as f:
            f.write(head)
            f.truncate(len(head) + width * count)

    def column(self, batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
        own = batch.column(batch.schema.get_field_index(name))
        if own.null_count:
            raise ValueError(f"{self.path}: nulls in {name}")
        x = own.to_numpy(zero_copy_only=False)
        out = x.astype(kind)
        if out.dtype.kind in "iu" and kind != "<u8" and (out.astype(np.int64) != x).any():
            raise ValueError(f"{self.path}: {name} holds numbers that {kind} doesn't")
        return out

    def write(self, batches) -> Done:
        ranges: list[tuple[int, int]] = []
        with open(self.part, "r+b") as f:
            for b in batches:
                if b.num_rows:
                    ranges += self.place(f, b)
                if len(ranges) > RANGES:
                    ranges = merged(ranges, self.path)
                    if len(ranges) > RANGES:
                        raise ValueError(f"{self.path}: the rows of a task lie in more than {RANGES} ranges; sort them by place_rows()")
        return Done(merged(ranges, self.path))

    def place(self, f, batch: pa.RecordBatch) -> list[tuple[int, int]]:
        """Each run of consecutive rows goes to its place in every section at once; gives the runs."""
        index = self.column(batch, "row_index", "<i8")
        order = np.argsort(index, kind="stable")
        index = index[order]
        if index[0] < 0 or index[-1] >= self.count:
            raise ValueError(f"{self.path}: rows {index[0]} to {index[-1]} of {self.count}")
        cuts = np.flatnonzero(np.diff(index, prepend=index[0] - 2) != 1).tolist()
        ends, at = [*cuts[1:], len(index)], self.first
        for names, kind in self.sections:
            own = np.stack([self.column(batch, n, kind) for n in names], 1)[order]
            size = np.dtype(kind).itemsize * len(names)
            for a, b in zip(cuts, ends):
                f.seek(at + int(index[a]) * size)
                f.write(own[a:b].tobytes())
            at += size * self.count
        return [(int(index[a]), int(index[a]) + b - a) for a, b in zip(cuts, ends)]

    def commit(self, messages) -> None:
        try:
            held = merged([r for m in messages if m is not None for r in m.ranges], self.path)
            if held != ([(0, self.count)] if self.count else []):
                raise ValueError(f"{self.path}: rows 0 to {self.count - 1} are due once each; these came: {held[:5]}")
        except ValueError:
            os.remove(self.part)
            raise
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def place_rows(rows: DataFrame, kind: str, path: str, mode: str = "append", **options) -> None:
    """Write rows to a sky_catalogue or row_vector file, each task a range of row_index."""
    rows.repartitionByRange("row_index").sortWithinPartitions("row_index").write.format(kind).mode(mode).options(path=path, **options).save()


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, wanted: list[str]):
        self.path, self.step, self.wanted = options["path"], int(options.get("rowsPerPartition", 1_000_000)), wanted
        self.kind, self.values = vector_layout(options)
        self.width = np.dtype(self.kind).itemsize * len(self.values)

    def partitions(self):
        size = os.path.getsize(self.path)
        if size % self.width:
            raise ValueError(f"{self.path}: {size} bytes aren't rows of {self.width}")
        return ranges(size // self.width, self.step)

    def read(self, partition: Rows):
        n, k = partition.end - partition.begin, len(self.values)
        own = np.fromfile(self.path, self.kind, n * k, offset=partition.begin * self.width)
        found = {"row_index": pa.array(np.arange(partition.begin, partition.end))} | {v: as_arrow(own[j::k], SPARK_TYPE[self.kind]) for j, v in enumerate(self.values)}
        yield pa.RecordBatch.from_arrays([found[c] for c in self.wanted], names=self.wanted)


def vector_layout(options: dict) -> tuple[str, list[str]]:
    return options.get("type", "u1"), [c.strip() for c in options["values"].split(",")]


class RowVector(DataSource):
    """spark.read.format('row_vector').option('values', 'fog_mpc,rsd_mpc').option('type', '<f4').load(path); the writer also takes count."""

    @classmethod
    def name(cls) -> str:
        return "row_vector"

    def schema(self) -> str:
        kind, values = vector_layout(self.options)
        return picked(self.options, [("row_index", "bigint"), *((v, SPARK_TYPE[kind]) for v in values)])

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        kind, values = vector_layout(self.options)
        return PlacedWriter(self.options["path"], b"", [(values, kind)], int(self.options["count"]), overwrite)


#: Fixed: FITS column codes: numpy type, Spark type; without a Spark type columns aren't read.
FITS_TYPES = {"L": ("S1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "C": ("V8", None), "M": ("V16", None), "P": ("V8", None), "Q": ("V16", None)}
#: Fixed: zero points by which FITS stores unsigned (and signed 8-bit) numbers, and what they become.
FITS_UNSIGNED = {"B": (-128, "int"), "I": (1 << 15, "int"), "J": (1 << 31, "bigint"), "K": (1 << 63, "decimal(20,0)")}


def fits_column(cards: dict[str, str], k: int, path: str) -> dict:
    """One column: name, numpy type, values a row, Spark type of one value, scale, zero point, null code."""
    found = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
    n, code = int(found[1] or 1) if found else 1, found[2] if found else ""
    number = lambda key, default: float(cards.get(f"{key}{k}", default).replace("D", "E"))
    out = {"name": cards[f"TTYPE{k}"].lower(), "n": n, "scale": number("TSCAL", "1"), "zero": number("TZERO", "0"), "null": int(cards[f"TNULL{k}"]) if f"TNULL{k}" in cards else None, "unsigned": False}
    if code == "A":
        return out | {"kind": f"S{n}", "n": 1, "spark": "string", "bytes": n}
    if code == "X":
        return out | {"kind": f"V{-(-n // 8)}", "n": 1, "spark": None, "bytes": -(-n // 8)}
    if code not in FITS_TYPES:
        raise ValueError(f"{path}: column form {cards[f'TFORM{k}']}")
    kind, spark = FITS_TYPES[code]
    if (out["scale"], out["zero"]) != (1.0, 0.0) and code in "BIJKED":
        zero, wide = FITS_UNSIGNED.get(code, (None, "double"))
        out["unsigned"] = out["scale"] == 1.0 and out["zero"] == zero
        spark = wide if out["unsigned"] else "double"
    return out | {"kind": kind, "spark": spark, "bytes": np.dtype(kind).itemsize * n}


def fits_layout(path: str) -> dict:
    """Offset, rows, row width and columns (fits_column() and offset in the row) of the first binary table."""
    with open(path, "rb") as f:
        while True:
            cards: dict[str, str] = {}
            while "END" not in cards:
                block = f.read(2880)
                if len(block) < 2880:
                    raise ValueError(f"{path}: no binary table")
                for k in range(0, 2880, 80):
                    card = block[k : k + 80].decode("ascii", "replace")
                    if card[:8].strip() == "END":
                        cards["END"] = ""
                        break
                    if card[8:10] == "= ":
                        value = card[10:].strip()
                        cards[card[:8].strip()] = value[1 : value.index("'", 1)].strip() if value.startswith("'") else value.split("/")[0].strip()
            size = abs(int(cards.get("BITPIX", 8))) // 8
            for k in range(int(cards.get("NAXIS", 0))):
                size *= int(cards[f"NAXIS{k + 1}"])
            size = size if int(cards.get("NAXIS", 0)) else 0
            if cards.get("XTENSION") == "BINTABLE":
                break
            f.seek(-(-size // 2880) * 2880, 1)
        columns, at = [], 0
        for k in range(1, int(cards["TFIELDS"]) + 1):
            columns.append(fits_column(cards, k, path) | {"at": at})
            at += columns[-1]["bytes"]
        if at != int(cards["NAXIS1"]):
            raise ValueError(f"{path}: columns take {at} bytes of a row of {cards['NAXIS1']}")
        return {"offset": f.tell(), "rows": int(cards["NAXIS2"]), "width": at, "columns": columns}


def fits_values(own: np.ndarray, column: dict) -> pa.Array:
    """Values of a column (flat): scale and zero point applied, null codes as nulls."""
    spark = column["spark"]
    if spark == "string":
        return pa.array([x.decode("ascii", "replace").rstrip(" \0") for x in own.tolist()])
    if spark == "boolean":
        return pa.array((own == b"T").tolist())
    mask = None if column["null"] is None or own.dtype.kind == "f" else own == column["null"]
    if spark.startswith("decimal"):
        # 64-bit numbers around 2 ** 63: the sign bit turned
        whole = own.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return pa.array(whole, mask=mask).cast(pa.decimal128(20, 0))
    if column["unsigned"]:
        own = own.astype(np.int64) + int(column["zero"])
    elif (column["scale"], column["zero"]) != (1.0, 0.0):
        own = own.astype(np.float64) * column["scale"] + column["zero"]
    return pa.array(own.astype({"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[spark]), mask=mask)


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, wanted: list[str]):
        self.path, self.step, self.wanted = options["path"], int(options.get("rowsPerPartition", 250_000)), wanted

    def partitions(self):
        return ranges(fits_layout(self.path)["rows"], self.step)

    def read(self, partition: Rows):
        head = fits_layout(self.path)
        n = partition.end - partition.begin
        if not n:
            return
        held = [c for c in head["columns"] if c["name"] in self.wanted]
        rows = np.memmap(self.path, np.uint8, "r", head["offset"] + partition.begin * head["width"], (n, head["width"]))
        found = {"row_index": pa.array(np.arange(partition.begin, partition.end))}
        for c in held:
            own = np.ascontiguousarray(rows[:, c["at"] : c["at"] + c["bytes"]]).view(c["kind"]).reshape(-1)
            values = fits_values(own, c)
            found[c["name"]] = values if c["n"] == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c["n"]), values)
        yield pa.RecordBatch.from_arrays([found[c] for c in self.wanted], names=self.wanted)


class FitsTable(DataSource):
    """spark.read.format('fits_table').load(path): row_index and the columns, vectors as arrays (flat, whatever TDIM says).

    Scaled columns are double, unsigned ones as wide as they need, null codes null.  Columns of bits, complex numbers
    or variable length abort when they are named in option columns, and are left out otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        known = [c for c in fits_layout(self.options["path"])["columns"] if c["spark"] and c["bytes"]]
        return picked(self.options, [("row_index", "bigint"), *((c["name"], c["spark"] if c["n"] == 1 else f"array<{c['spark']}>") for c in known)])

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options, schema.names)


def clustering(spark: SparkSession, path: str, weights: tuple[str, ...] = ()) -> DataFrame:
    """row_index, targetid, ra, dec, z (and weights) of a clustering table; other columns aren't read."""
    return spark.read.format("fits_table").option("columns", ",".join(["row_index", "targetid", "ra", "dec", "z", *weights])).load(path)


def morphology(spark: SparkSession, path: str) -> DataFrame:
    """targetid, type, shape_r, flux_g, flux_r, flux_z, zwarn of an imaging table."""
    cols = ["targetid", "morphtype", "shape_r", "flux_g", "flux_r", "flux_z", "zwarn"]
    return spark.read.format("fits_table").option("columns", ",".join(cols)).load(path).withColumnRenamed("morphtype", "type")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SkyCatalogue)
    spark.dataSource.register(FitsTable)
    spark.dataSource.register(RowVector)


def files(spark: SparkSession, path: str, pattern: str = r"_(\d+)\.") -> DataFrame:
    """chunk (number in the file name), name and content of whole small files."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_extract(name, pattern, 1).cast("int").alias("chunk"), name.alias("name"), "content")


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def undelta(planes: np.ndarray) -> np.ndarray:
    """Running sums that wrap at 16 bits, as (rows, axes)."""
    return np.cumsum(planes.astype(np.int64), axis=1).astype(np.int16).T


def decode_chunks(found: DataFrame) -> DataFrame:
    """chunk, pos_in_chunk, qx, qy, qz of delta chunks (files())."""

    def work(batches):
        for b in batches:
            for chunk, content in zip(b["chunk"], b["content"]):
                p = undelta(np.frombuffer(plain(content), "<i2").reshape(3, -1)).astype(np.int32)
                yield pd.DataFrame({"chunk": chunk, "pos_in_chunk": np.arange(len(p)), "qx": p[:, 0], "qy": p[:, 1], "qz": p[:, 2]})

    return found.select("chunk", "content").mapInPandas(work, "chunk int, pos_in_chunk long, qx int, qy int, qz int")


def due(counts: dict[int, int] | None, chunk: int, n: int, what: str) -> None:
    if counts is not None and counts.get(int(chunk)) != n:
        raise ValueError(f"{what} {chunk} has {n} rows; {counts.get(int(chunk))} are due")


def decode_types(found: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """chunk, pos_in_chunk, type of files with a byte a row."""

    def work(batches):
        for b in batches:
            for chunk, content in zip(b["chunk"], b["content"]):
                x = np.frombuffer(plain(content), "u1")
                due(counts, chunk, len(x), "types of chunk")
                yield pd.DataFrame({"chunk": chunk, "pos_in_chunk": np.arange(len(x)), "type": x.astype(np.int32)})

    return found.select("chunk", "content").mapInPandas(work, "chunk int, pos_in_chunk long, type int")


def decode_payload(found: DataFrame, value: str = "value", counts: dict[int, int] | None = None) -> DataFrame:
    """chunk, pos_in_chunk, value of row-aligned float payloads; a value that isn't finite, or another number of rows than counts gives, aborts."""

    def work(batches):
        for b in batches:
            for chunk, content in zip(b["chunk"], b["content"]):
                x = np.frombuffer(plain(content), "<f4")
                due(counts, chunk, len(x), "payload")
                if not np.isfinite(x).all():
                    raise ValueError(f"payload {chunk} has values that aren't finite")
                yield pd.DataFrame({"chunk": chunk, "pos_in_chunk": np.arange(len(x)), value: x})

    return found.select("chunk", "content").mapInPandas(work, f"chunk int, pos_in_chunk long, {value} float")


def decode_identities(found: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """chunk, row_index, targetid of .npy identity arrays (gzip or plain) of unsigned 64-bit numbers; other types or counts abort."""
    import io

    def work(batches):
        for b in batches:
            for chunk, content in zip(b["chunk"], b["content"]):
                x = np.load(io.BytesIO(plain(content)), allow_pickle=False)
                if x.dtype != np.dtype("<u8") or x.ndim != 1:
                    raise ValueError(f"identities {chunk} are {x.dtype}, {x.shape}")
                due(counts, chunk, len(x), "identities")
                yield pd.DataFrame({"chunk": chunk, "row_index": np.arange(len(x)), "targetid": x.astype(np.int64)})

    return found.select("chunk", "content").mapInPandas(work, "chunk int, row_index long, targetid long")


def decode_caches(found: DataFrame) -> DataFrame:
    """name, targetid, delta_mpc of .npz caches."""
    import io

    def work(batches):
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"name": name, "targetid": z["targetid"].astype(np.int64), "delta_mpc": z["delta_mpc"].astype(np.float32)})

    return found.select("name", "content").mapInPandas(work, "name string, targetid long, delta_mpc float")


#: Fixed: head of a consolidated chunk: magic, version, rows, five section offsets, length.
CONSOLIDATED = "<4s8I"


def decode_consolidated(found: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """chunk, pos_in_chunk, type, row_index, qx, qy, qz, zq, morph, shape, gr, rz of consolidated chunks; sections out of order abort."""

    def work(batches):
        for b in batches:
            for chunk, content in zip(b["chunk"], b["content"]):
                raw = plain(content)
                _, version, n, *offsets, total = struct.unpack_from(CONSOLIDATED, raw)
                due(counts, chunk, n, "chunk")
                ends = [64, *offsets, total]
                if version != 1 or total != len(raw) or any(o % 4 for o in offsets) or n and any(a >= b for a, b in zip(ends[1:], ends[2:])) or ends[1] < 64:
                    raise ValueError(f"chunk {chunk}: version {version}, {total} of {len(raw)} bytes, sections at {offsets}")
                p = undelta(np.frombuffer(raw, "<i2", 3 * n, offsets[2]).reshape(3, n)).astype(np.int32)
                attributes = np.frombuffer(raw, "u1", 4 * n, offsets[4]).reshape(4, n).astype(np.int32)
                yield pd.DataFrame({"chunk": chunk, "pos_in_chunk": np.arange(n), "type": np.frombuffer(raw, "u1", n, offsets[0]).astype(np.int32), "row_index": np.frombuffer(raw, "<u4", n, offsets[1]).astype(np.int64), "qx": p[:, 0], "qy": p[:, 1], "qz": p[:, 2], "zq": np.frombuffer(raw, "<u2", n, offsets[3]).astype(np.int32), **dict(zip(("morph", "shape", "gr", "rz"), attributes))})

    return found.select("chunk", "content").mapInPandas(work, "chunk int, pos_in_chunk long, type int, row_index long, qx int, qy int, qz int, zq int, morph int, shape int, gr int, rz int")


#: Members of files: a file is its members in the order of section and part.
FILE = "chunk int, name string, section int, part long, content binary"
#: Rows of a member.
PART = 1 << 18


def parted(rows: DataFrame, columns: list[str], chunk: str, position: str, part: int, before: bool = False) -> DataFrame:
    """rows (chunk, pos, n, columns) with _part and _edge; before: the last row of each part also goes to the next one, as its edge."""
    c, pos = F.col(chunk).cast("int").alias("chunk"), F.col(position).cast("long").alias("pos")
    n = rows.groupBy(F.col(chunk).cast("int").alias("_c")).agg(F.count("*").alias("n"))  # a row for each file
    own = rows.select(c, pos, *columns).join(F.broadcast(n), F.col("chunk") == F.col("_c")).drop("_c").withColumn("_part", F.floor(F.col("pos") / part))
    if not before:
        return own.withColumn("_edge", F.lit(False))
    edge = own.where((F.col("pos") + 1) % part == 0).withColumn("_part", F.col("_part") + 1)
    return own.withColumn("_edge", F.lit(False)).unionByName(edge.withColumn("_edge", F.lit(True)))


def zipped(raw: bytes, level: int) -> bytes:
    """A gzip member, if it unpacks to the same bytes; members in a row are one gzip file."""
    out = gzip.compress(raw, level, mtime=0)
    if gzip.decompress(out) != raw:
        raise ValueError("a gzip member doesn't unpack to what it was made of")
    return out


def deltas(g: pd.DataFrame) -> np.ndarray:
    """Axis by axis the differences of a part's positions, from its edge on; they must sum up to the positions again."""
    at = g[["qx", "qy", "qz"]].to_numpy().astype(np.int64)
    edge = g["_edge"].to_numpy()
    start = at[0] if edge[0] else np.zeros(3, np.int64)
    at = at[1:] if edge[0] else at
    d = np.diff(at, axis=0, prepend=start[None]).astype("<i2")
    if (np.cumsum(d.astype(np.int64), axis=0) + start).astype(np.int16).tolist() != at.astype(np.int16).tolist():
        raise ValueError(f"chunk {int(g['chunk'].iloc[0])} doesn't decode to its rows")
    return d.T


def encoded(rows: DataFrame, make) -> DataFrame:
    """Members of parted() rows: make(part's rows in order, its edge included) gives (section, content) pairs."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos", ignore_index=True)
        k, part = int(g["chunk"].iloc[0]), int(g["_part"].iloc[0])
        if (np.diff(g["pos"]) != 1).any() or part == 0 and g["pos"].iloc[0] != 0:
            raise ValueError(f"chunk {k}: positions of part {part} aren't consecutive")
        own = [] if g["_edge"].all() else make(k, part, g)
        return pd.DataFrame([(k, name, s, part, c) for name, s, c in own], columns=["chunk", "name", "section", "part", "content"])

    return rows.groupBy("chunk", "_part").applyInPandas(work, FILE)


def encode_chunks(rows: DataFrame, name: str = "chunk_%03d.bin.gz", part: int = PART) -> DataFrame:
    """Files of delta chunks, as members of `part` rows and one axis, made by many tasks."""

    def make(k: int, _: int, g: pd.DataFrame) -> list:
        return [(name % k, axis, zipped(d.tobytes(), 9)) for axis, d in enumerate(deltas(g))]

    return encoded(parted(rows, ["qx", "qy", "qz"], "chunk", "pos_in_chunk", part, before=True), make)


def encode_column(rows: DataFrame, value: str, kind: str, name: str, level: int, npy: bool = False, part: int = PART) -> DataFrame:
    """Files of one column in chunk order: gzip of bare values, or a plain .npy array."""

    def make(k: int, p: int, g: pd.DataFrame) -> list:
        import io

        x = g[value].to_numpy(np.dtype(kind)).tobytes()
        if not npy:
            return [(name % k, 0, zipped(x, level))]
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": kind, "fortran_order": False, "shape": (int(g["n"].iloc[0]),)})
        return [(name % k, -1, head.getvalue())] * (p == 0) + [(name % k, 0, x)]

    return encoded(parted(rows, [value], "chunk", "pos_in_chunk", part), make)


def encode_payload(rows: DataFrame, value: str, name: str = "payload_%03d.bin", part: int = PART) -> DataFrame:
    return encode_column(rows, value, "<f4", name, 6, part=part)


def encode_types(rows: DataFrame, name: str = "type_%03d.bin", part: int = PART) -> DataFrame:
    """Files of type bytes beside delta chunks."""
    return encode_column(rows, "type", "u1", name, 9, part=part)


def encode_identities(rows: DataFrame, name: str = "targetid_%03d.npy", part: int = PART) -> DataFrame:
    """Files of identities in the order of delta chunks: the index by which corrections are aligned."""
    return encode_column(rows, "targetid", "<u8", name, 0, npy=True, part=part)


def encode_pairs(rows: DataFrame, first: str, second: str, name: str, part: int = PART) -> DataFrame:
    """One gzip file of two floats a row, in the order of row_index."""

    def make(_: int, p: int, g: pd.DataFrame) -> list:
        return [(name, 0, zipped(g[[first, second]].to_numpy("<f4").tobytes(), 9))]

    return encoded(parted(rows.withColumn("chunk", F.lit(0)), [first, second], "chunk", "row_index", part), make)


def encode_consolidated(rows: DataFrame, magic: str = "SKY3", name: str = "catalog_%03d.bin.gz", part: int = PART) -> DataFrame:
    """Files of consolidated chunks: sections at multiples of four bytes after a 64-byte head, as members of `part` rows and one column."""
    columns = ["type", "row_index", "qx", "qy", "qz", "zq", "morph", "shape", "gr", "rz"]

    def make(k: int, p: int, g: pd.DataFrame) -> list:
        n, at, offsets, gaps = int(g["n"].iloc[0]), 64, [], []
        for width in (1, 4, 6, 2, 4):
            gaps.append(-at % 4)
            at += gaps[-1]
            offsets.append(at)
            at += width * n
        head = struct.pack(CONSOLIDATED, magic.encode(), 1, n, *offsets, at).ljust(64, b"\0")
        d, own = deltas(g), g[~g["_edge"]]
        column = lambda c, kind: own[c].to_numpy(np.dtype(kind)).tobytes()
        # (section, column, whether a gap precedes it)
        parts = [(column("type", "u1"), 0), (column("row_index", "<u4"), 1), (d[0].tobytes(), 2), (d[1].tobytes(), None), (d[2].tobytes(), None), (column("zq", "<u2"), 3), (column("morph", "u1"), 4), *((column(c, "u1"), None) for c in ("shape", "gr", "rz"))]
        out = [(name % k, -1, zipped(head, 6))] * (p == 0)
        for s, (raw, gap) in enumerate(parts):
            out.append((name % k, s, zipped((bytes(gaps[gap]) if p == 0 and gap is not None else b"") + raw, 6)))
        return out

    return encoded(parted(rows, columns, "chunk", "pos_in_chunk", part, before=True), make)


def write_files(members: DataFrame, folder: str) -> DataFrame:
    """Write members (FILE) as files of a folder that executors share; gives name, bytes, sha256.

    Members are written once to the session's shared folder, so that their places in the files are known; then tasks
    put them there, each file beside its name, under a name of this run.  Files take their names together, when all
    bytes are in place.  A file that exists stays if it holds the same bytes, and aborts otherwise.
    """
    from pyspark.sql.window import Window

    spark = members.sparkSession
    os.makedirs(folder, exist_ok=True)
    held = materialize(members.select("name", "section", "part", "content"), "members")
    before = Window.partitionBy("name").orderBy("section", "part").rowsBetween(Window.unboundedPreceding, -1)
    sized = held.select("name", "section", "part", F.octet_length("content").cast("long").alias("bytes"))
    places = sized.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    totals = {r["name"]: r["bytes"] for r in sized.groupBy("name").agg(F.sum("bytes").alias("bytes")).collect()}
    run = uuid.uuid4().hex
    beside = lambda n: f"{folder}/.{n}.{run}.part"
    try:
        for n, size in totals.items():
            with open(beside(n), "wb") as f:
                f.truncate(size)

        def work(batches):
            for b in batches:
                for n, at, content in zip(b["name"].to_pylist(), b["at"].to_pylist(), b["content"]):
                    with open(f"{folder}/.{n}.{run}.part", "r+b") as f:
                        f.seek(at)
                        f.write(content.as_buffer())
                yield pa.RecordBatch.from_arrays([b["name"], pa.compute.binary_length(b["content"]).cast(pa.int64())], names=["name", "bytes"])

        done = held.join(places, ["name", "section", "part"]).select("name", "at", "content").mapInArrow(work, "name string, bytes long")
        got = {r["name"]: r["bytes"] for r in done.groupBy("name").agg(F.sum("bytes").alias("bytes")).collect()}
        if got != totals:
            raise ValueError(f"{folder}: {got} bytes were written where {totals} are due")
        paths = spark.createDataFrame([(beside(n),) for n in totals], "path string")
        found = {r["name"][1 : -len(run) - 6]: (r["bytes"], r["sha256"]) for r in files_.digests(paths).collect()}
        there = [n for n in totals if os.path.exists(f"{folder}/{n}")]
        for n in there:
            if files_.sha256_of(f"{folder}/{n}") != found[n]:
                raise FileExistsError(f"{folder}/{n} holds other bytes")
        for n in totals:
            if n not in there:
                os.replace(beside(n), f"{folder}/{n}")
    finally:
        for n in totals:
            if os.path.exists(beside(n)):
                os.remove(beside(n))
    return spark.createDataFrame([(n, *found[n]) for n in sorted(found)], "name string, bytes long, sha256 string")
