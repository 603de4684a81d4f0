"""Archives made of rows: every entry is deflated where its row lies, and a file is an ordered run of parts.

An entry becomes its local header and its compressed bytes; running sums of their lengths give where each lies, from which the
records of the central directory and the end follow, again as rows. So no task holds more than one entry,
whatever a work holds, and the parts of a work in order are the bytes that one writer would have made.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.running import running
from quire.sources.scratch import once

#: Beyond these a field of the format is too small and its 64-bit form is used.
MOST_BYTES, MOST_ENTRIES = 2**31 - 1, 65_535
#: Compressed bytes that a task gathers before it gives them on.
_GIVEN_ON = 4 << 20
# Fixed values of the format: version, the first day it can name, and the rights of a file.
_VERSION, _VERSION_64, _DATE, _RIGHTS, _UNIX = 20, 45, 33, 0o600 << 16, 3


def local_part(name: str, data: bytes, stored: bool) -> tuple[bytes, int, int]:
    """(local header and compressed bytes, CRC, compressed size) of an entry."""
    raw = name.encode()
    if stored:
        packed = data
    else:
        deflate = zlib.compressobj(wbits=-15)
        packed = deflate.compress(data) + deflate.flush()
    crc = zlib.crc32(data)
    head = struct.pack("<4s5H3L2H", b"PK\x03\x04", _VERSION, 0 if raw.isascii() else 0x800, 0 if stored else 8, 0, _DATE, crc, len(packed), len(data), len(raw), 0)
    return head + raw + packed, crc, len(packed)


def central_record(name: str, stored: bool, crc: int, packed: int, size: int, offset: int, most: int = MOST_BYTES) -> bytes:
    raw, extra, version = name.encode(), b"", _VERSION
    if offset > most:
        extra, version = struct.pack("<HHQ", 1, 8, offset), _VERSION_64
        offset = 0xFFFFFFFF
    head = struct.pack("<4s4B4H3L5H2L", b"PK\x01\x02", version, _UNIX, version, 0, 0 if raw.isascii() else 0x800, 0 if stored else 8, 0, _DATE, crc, packed, size, len(raw), len(extra), 0, 0, 0, _RIGHTS, offset)
    return head + raw + extra


def end_record(entries: int, size: int, offset: int, most: int = MOST_BYTES, few: int = MOST_ENTRIES) -> bytes:
    """The end of an archive whose central directory of so many bytes lies at an offset."""
    out = b""
    if entries > few or size > most or offset > most:
        out = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, _VERSION_64, _VERSION_64, 0, 0, entries, entries, size, offset) + struct.pack("<4sLQL", b"PK\x06\x07", 0, offset + size, 1)
        entries, size, offset = min(entries, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF)
    return out + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, entries, entries, size, offset, 0)


def deflated(entries: DataFrame, key: str = "work_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entries (key, section, k, name, data, stored) as (own, section, k, name, stored, crc, packed, size, content), each computed once: with content, and without it but with the columns to keep.

    What reads the second leaves the bytes of the first where they lie.
    """
    rows = entries.select("data", F.col(key).alias("own"), F.col("section").cast("int").alias("section"), F.col("k").cast("long").alias("k"), "name", "stored", *keep)
    rows = rows.withColumn("data", F.col("data").cast("binary"))
    counted = ["crc", "packed", "size", "content"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, held, begun = [], 0, 0
            data, names, stored = b.column("data"), b.column("name"), b.column("stored")
            for i in range(b.num_rows):  # an entry at a time, given on in batches of a few MB
                entry = data[i].as_py() or b""
                content, crc, packed = local_part(names[i].as_py(), entry, stored[i].as_py())
                made.append((crc, packed, len(entry), content))
                held += len(content)
                if held >= _GIVEN_ON or i + 1 == b.num_rows:
                    own = b.slice(begun, len(made))
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*made), [pa.int64()] * 3 + [pa.binary()])]
                    yield pa.RecordBatch.from_arrays(own.columns[1:] + columns, names=b.schema.names[1:] + counted)
                    made, held, begun = [], 0, i + 1

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    done = once(rows.mapInArrow(pack, f"{told}, crc long, packed long, size long, content binary"))
    return done.drop(*keep), once(done.drop("content"))


_ORDER = ["section", "k", "name"]


def _directory(sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of deflated entries without their content: where each lies (own, section, k, name, part_no, offset, upto, length), and each work's totals (own, n, directory, bytes), central records (own, part_no, at, content) and end (own, content).

    ``at`` and ``upto`` count the bytes of the central directory before and up to an entry's record, whose length follows from name and offset.
    """
    most, few = MOST_BYTES, MOST_ENTRIES
    kind, order = sizes.schema["own"].dataType.simpleString(), [F.col(c) for c in _ORDER]
    lengths = sizes.withColumn("taken", F.col("packed") + F.lit(30) + F.octet_length("name"))
    laid = running(lengths, ["own"], order, {"part_no": ("sum", F.lit(1).cast("long")), "end": ("sum", F.col("taken"))}).withColumn("offset", F.col("end") - F.col("taken"))
    laid = laid.withColumn("length", (F.octet_length("name") + F.when(F.col("offset") > most, 58).otherwise(46)).cast("long"))
    placed = once(running(laid, ["own"], order, {"upto": ("sum", F.col("length"))}))
    totals = placed.groupBy("own").agg(F.max("end").alias("directory"), F.max("part_no").alias("n"), F.sum("length").alias("bytes"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [central_record(*row, most) for row in zip(*(b.column(c).to_pylist() for c in ("name", "stored", "crc", "packed", "size", "offset")))]
            yield pa.RecordBatch.from_arrays([b.column("own"), b.column("part_no"), b.column("at"), pa.array(made, pa.binary())], names=["own", "part_no", "at", "content"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [end_record(*row, most, few) for row in zip(*(b.column(c).to_pylist() for c in ("n", "bytes", "directory")))]
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(made, pa.binary())], names=["own", "content"])

    told = placed.select("own", "part_no", (F.col("upto") - F.col("length")).alias("at"), "name", "stored", "crc", "packed", "size", "offset")
    return placed, totals, told.mapInArrow(describe, f"own {kind}, part_no long, at long, content binary"), totals.mapInArrow(close, f"own {kind}, content binary")


def in_parts(contents: DataFrame, sizes: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, part_no, offset, content) of deflated entries: the bytes of an archive for each key, in parts that count from 1 without gaps."""
    placed, totals, records, ends = _directory(sizes)
    first = contents.select("own", *_ORDER, "content").join(placed.select("own", *_ORDER, "part_no", "offset"), ["own", *_ORDER]).select("own", "part_no", "offset", "content")
    central = records.join(totals, "own").select("own", (F.col("n") + F.col("part_no")).alias("part_no"), (F.col("directory") + F.col("at")).alias("offset"), "content")
    last = ends.join(totals, "own").select("own", (2 * F.col("n") + 1).alias("part_no"), (F.col("directory") + F.col("bytes")).alias("offset"), "content")
    return first.unionByName(central).unionByName(last).withColumnRenamed("own", key)


def whole(contents: DataFrame, sizes: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, content) of deflated entries: the bytes of an archive for each key in a cell, for which each entry is shuffled once."""
    _, _, records, ends = _directory(sizes)
    none = [F.lit(None).cast(contents.schema[c].dataType).alias(c) for c in _ORDER]
    piece = lambda df, stage, place, order: df.select("own", F.lit(stage).alias("stage"), *order, place.cast("long").alias("place"), "content")
    pieces = piece(contents, 0, F.lit(0), _ORDER).unionByName(piece(records, 1, F.col("part_no"), none)).unionByName(piece(ends, 2, F.lit(0), none))
    joined = F.expr(f"listagg(content) WITHIN GROUP (ORDER BY stage, {', '.join(_ORDER)}, place)")
    return pieces.repartition("own").groupBy("own").agg(joined.alias("content")).withColumnRenamed("own", key)


def parts(entries: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, part_no, offset, content) for entries (key, section, k, name, data, stored): the bytes of an archive for each key, in parts.

    Entries stand in the order of section, k and name, which together name one; null data is empty. Parts count from 1 without gaps.
    """
    return in_parts(*deflated(entries, key), key)
