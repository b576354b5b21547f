"""Reading and writing the file formats of dictionaries, codebooks, weights and signatures.

Dictionaries, weights and codebooks are small and go through the driver; signature files are written from partitions in order and
read by one task each.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary
from ..plans.tables import ranked

_CODES = ("Start", "End", "Mid", "Letter", "Whole", "Delimiter")
_BLOCKS = ("Whole", "Start", "Mid", "End", "Letter", "Delimiter")
CHUNK = 65535
Part = tuple[str, str]


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """file, text: a row for each file, whole."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines that aren't empty."""
    return stripped(spark.read.text(path).select(F.col("value").alias("word")), "word")


def stripped(lines: DataFrame, column: str) -> DataFrame:
    """Lines without the signs that end them, and without those that are empty then."""
    return lines.withColumn(column, F.regexp_replace(column, r"[\r\n]+$", "")).where(F.col(column) != "")


def parts_of(parts: DataFrame) -> list[Part]:
    return [(r.kind, r.value) for r in parts.orderBy("part_id").collect()]


def _trained(parts: list[Part]) -> list[Part]:
    fixed = set(dictionary.atoms())
    return [p for p in parts if p not in fixed and p[0] != "Letter"]


def escape(value: str) -> str:
    named = {"\n": r"\n", "\t": r"\t", "\r": r"\r", "\\": r"\\"}
    return "".join(named.get(c) or (f"\\x{ord(c):02X}" if c < " " or c == "\x7f" else c) for c in value)


def unescape(value: str, hexadecimal: bool = True) -> str:
    """hexadecimal: whether \\xHH is a character; the older form has only the named ones."""
    named = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
    if not hexadecimal:
        return re.sub(r"\\([ntr\\])", lambda m: named[m[1]], value)
    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|([ntr\\]))", lambda m: chr(int(m[1], 16)) if m[1] else named[m[2]], value)


def to_text(parts: list[Part]) -> str:
    """Trained parts by line, w, s##, ##m##, ##e; then those delimiters that aren't fixed ones."""
    shape = {"Whole": "{}", "Start": "{}##", "Mid": "##{}##", "End": "##{}"}
    own = _trained(parts)
    return "".join([shape[k].format(v) + "\n" for k, v in own if k in shape] + ["[delim]\n"] + [escape(v) + "\n" for k, v in own if k == "Delimiter"])


def text_lines(parts: DataFrame) -> DataFrame:
    """line (from 0), text: the lines of the text form as a table, for dictionaries of any size."""
    shape = {"Whole": ("", ""), "Start": ("", "##"), "Mid": ("##", "##"), "End": ("##", "")}
    fixed = parts.sparkSession.createDataFrame(dictionary.atoms(), "kind string, value string")
    own = parts.where("kind <> 'Letter'").join(F.broadcast(fixed), ["kind", "value"], "left_anti")  # atoms: a set number
    shown = F.lit(None).cast("string")
    for kind, (a, b) in shape.items():
        shown = F.when(F.col("kind") == kind, F.concat(F.lit(a), F.col("value"), F.lit(b))).otherwise(shown)
    escaped = F.pandas_udf(lambda s: s.map(escape), "string")
    words = own.where("kind <> 'Delimiter'").select(F.lit(0).alias("g"), "part_id", shown.alias("text"))
    delims = own.where("kind = 'Delimiter'").select(F.lit(2).alias("g"), "part_id", escaped("value").alias("text"))
    mark = parts.sparkSession.createDataFrame([(1, 0, "[delim]")], "g int, part_id int, text string")
    return ranked(words.unionAll(mark).unionAll(delims), "g", "part_id").select((F.col("rank") - 1).alias("line"), "text")


def from_text(text: str) -> list[Part]:
    out: list[Part] = []
    delimiters = False
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line:
            continue
        first, last = line.startswith("##"), line.endswith("##")
        if line == "[delim]":
            delimiters = True
        elif delimiters:
            out.append(("Delimiter", unescape(line)))
        elif first and last:
            if len(line) >= 4:
                out.append(("Mid", line[2:-2]))
        else:
            out.append(("Start", line[:-2]) if last else ("End", line[2:]) if first else ("Whole", line))
    return list(dict.fromkeys([*out, *dictionary.atoms()]))


def to_binary(parts: list[Part]) -> bytes:
    out = [b"BDI2\x01\x00\x00\x00"]
    for kind, value in _trained(parts):
        raw = value.encode()
        if len(raw) > 0xFFFF:
            raise ValueError("a part is longer than 65535 bytes")
        out.append(struct.pack("<BH", _CODES.index(kind), len(raw)) + raw)
    return b"".join(out)


def from_binary(data: bytes) -> list[Part]:
    if data[:4] != b"BDI2" or len(data) < 8:
        raise ValueError("no BDI2 file")
    if data[4] != 1:
        raise ValueError(f"version {data[4]} is not known")
    at, out = 8, []
    while at < len(data):
        if at + 3 > len(data):
            raise ValueError("the file is cut short")
        code, size = struct.unpack_from("<BH", data, at)
        if code >= len(_CODES):
            raise ValueError(f"kind {code} is not known")
        raw = data[at + 3 : at + 3 + size]
        if len(raw) < size:
            raise ValueError("the file is cut short")
        out.append((_CODES[code], raw.decode()))
        at += 3 + size
    return list(dict.fromkeys([*out, *dictionary.atoms()]))


def to_table(parts: list[Part]) -> str:
    """The older text form: id, kind and value by tab."""
    named = str.maketrans({"\\": r"\\", "\n": r"\n", "\t": r"\t", "\r": r"\r"})
    return "".join(f"{i}\t{k}\t{v.translate(named)}\n" for i, (k, v) in enumerate(parts))


def from_table(text: str) -> list[Part]:
    out = []
    for line in text.split("\n"):
        if line.count("\t") >= 2:
            _, kind, value = line.split("\t", 2)
            if kind not in _CODES:
                raise ValueError(f"kind {kind} is not known")
            out.append((kind, unescape(value, hexadecimal=False)))
    return list(dict.fromkeys(out))


def to_blocks(parts: list[Part]) -> bytes:
    """The older binary form: a block for each kind."""
    out = [b"BDIC", struct.pack("<HHI", 1, 0, len(_BLOCKS))]
    for code, kind in enumerate(_BLOCKS, 1):
        values = [v.encode() for k, v in parts if k == kind]
        out.append(struct.pack("<B3xI", code, len(values)))
        out += [struct.pack("<H", len(v)) + v for v in values]
    return b"".join(out)


def from_blocks(data: bytes) -> list[Part]:
    if data[:4] != b"BDIC":
        raise ValueError("no BDIC file")
    version, _, kinds = struct.unpack_from("<HHI", data, 4)
    if version != 1 or kinds != len(_BLOCKS):
        raise ValueError("version or number of kinds is not known")
    at, out = 12, []
    for _ in range(kinds):
        if at + 8 > len(data):
            raise ValueError("the file is cut short")
        code, count = struct.unpack_from("<B3xI", data, at)
        if not 1 <= code <= len(_BLOCKS):
            raise ValueError(f"kind {code} is not known")
        at += 8
        for _ in range(count):
            size = struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0
            if at + 2 + size > len(data):
                raise ValueError("the file is cut short")
            out.append((_BLOCKS[code - 1], data[at + 2 : at + 2 + size].decode()))
            at += 2 + size
    return out


def _magic(data: bytes, magic: bytes) -> None:
    if data[:4] != magic:
        raise ValueError(f"no {magic.decode()} file")
    if struct.unpack_from("<I", data, 4)[0] != 1:
        raise ValueError("version is not known")


def weights_to_bytes(weights: dict[int, int], dim: int, cap: int) -> bytes:
    table = np.zeros(dim, "<u2")
    for bit, w in weights.items():
        table[bit] = w
    return b"WGT1" + struct.pack("<IIB3x", 1, dim, cap) + table.tobytes()


def weights_from_bytes(data: bytes) -> tuple[np.ndarray, int]:
    """(weight of each bit, cap)"""
    _magic(data, b"WGT1")
    dim, cap = struct.unpack_from("<IB", data, 8)
    if len(data) < 16 + 2 * dim:
        raise ValueError("the file is cut short")
    return np.frombuffer(data, "<u2", dim, 16), cap


def codebook_to_bytes(atoms: list[list[int]], dim: int, width: int) -> bytes:
    return b"CBK1" + struct.pack("<IIII", 1, dim, width, len(atoms)) + b"".join(struct.pack(f"<I{len(a)}I", len(a), *a) for a in atoms)


def codebook_from_bytes(data: bytes) -> tuple[list[list[int]], int, int]:
    """(atoms, dim, width)"""
    _magic(data, b"CBK1")
    dim, width, count = struct.unpack_from("<III", data, 8)
    at, out = 20, []
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(list(struct.unpack_from(f"<{n}I", data, at + 4)))
        at += 4 + 4 * n
    return out, dim, width


def signature_bytes(bits: list[int], dim: int) -> bytes:
    """One record: for each chunk of 65535 bits, how many are set and which."""
    a = np.asarray(bits, np.int64)
    if len(a) and (a.min() < 0 or a.max() >= dim):
        raise ValueError(f"a signature has bits beyond {dim}")
    chunk, local = a // CHUNK, (a % CHUNK).astype("<u2")
    return b"".join(struct.pack("<I", int((chunk == c).sum())) + local[chunk == c].tobytes() for c in range(-(-dim // CHUNK)))


def signature_records(signatures: DataFrame, dim: int, order: str = "sig_id") -> DataFrame:
    """order, record: the records of a signature file, made in parallel. signatures: order, bits (ascending)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature_bytes(x or [], dim) for x in b.column(1).to_pylist()], pa.binary())], names=["sig_id", "record"])

    return signatures.select(F.col(order).cast("long").alias("sig_id"), "bits").mapInArrow(pack, "sig_id long, record binary")


def write_signatures(signatures: DataFrame, dim: int, path: str, order: str = "sig_id") -> int:
    """A CND3 file in order of sig_id; the number of records. Records stream through the driver, partition by partition."""
    records, n = signature_records(signatures, dim, order).orderBy("sig_id"), 0
    with open(path, "wb") as f:
        f.write(b"CND3" + struct.pack("<IIQ", 1, dim, 0))
        for r in records.toLocalIterator():
            f.write(r.record)
            n += 1
        f.seek(12)
        f.write(struct.pack("<Q", n))
    return n


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """file, sig_id, bits of CND3 files."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                _magic(data, b"CND3")
                dim, count = struct.unpack_from("<IQ", data, 8)
                at, rows = 20, []
                for _ in range(count):
                    bits: list[int] = []
                    for c in range(-(-dim // CHUNK)):
                        (n,) = struct.unpack_from("<I", data, at)
                        bits += (np.frombuffer(data, "<u2", n, at + 4).astype(np.int64) + c * CHUNK).tolist()
                        at += 4 + 2 * n
                    rows.append(bits)
                yield pa.RecordBatch.from_arrays([pa.array([file] * count), pa.array(range(count), pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["file", "sig_id", "bits"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, sig_id long, bits array<int>")


def report(df: DataFrame, path: str, digits: int = 4) -> None:
    """A small table as lines of tab-separated columns under their names, numbers with so many digits: the report of a run."""
    rows = df.collect()
    shown = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else " ".join(map(str, v)) if isinstance(v, list) else str(v)
    with open(path, "w") as f:
        f.write("".join("\t".join(x) + "\n" for x in [df.columns, *([shown(v) for v in r] for r in rows)]))


def cached_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of a text file, by way of a binary file of the same name ending in .bin: that is read where it is there and no older than
    the text, and else written. A binary file that can't be read is written anew."""
    binary = path.rsplit(".", 1)[0] + ".bin" if "." in os.path.basename(path) else path + ".bin"
    if path != binary and os.path.exists(binary) and os.path.getmtime(binary) >= os.path.getmtime(path):
        try:
            return load_dictionary(spark, binary)
        except ValueError:
            pass
    parts = load_dictionary(spark, path)
    if path != binary:
        save_dictionary(parts, binary)
    return parts


def save_dictionary(parts: DataFrame, path: str) -> None:
    """As text, or binary where the name ends in .bin."""
    own = parts_of(parts)
    with open(path, "wb") as f:
        f.write(to_binary(own) if path.endswith(".bin") else to_text(own).encode())


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as f:
        data = f.read()
    return dictionary.numbered(spark, from_binary(data) if path.endswith(".bin") else from_text(data.decode()))
