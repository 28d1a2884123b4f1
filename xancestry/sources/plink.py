"""Genotype filesets: variants (.bim), people (.fam) and packed genotypes (.bed), the last as a Spark data source."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.numbering import dense
from .text import SourceError, lines

#: Fixed values of the format: magic number, and the byte of the order by variant.
MAGIC, BY_VARIANT = b"\x6c\x1b", b"\x01"
#: Copies of the second allele by two-bit code; the code 2 (low bit 0, high bit 1 reads 01) is missing.
MISSING = -1
DOSAGE = np.array([0, MISSING, 1, 2], np.int8)


def _indexed(d: DataFrame, name: str) -> DataFrame:
    """Numbers by the place in the file: within each block that one task reads, and over the blocks' counts."""
    return dense(d, [F.col("place.f"), F.col("place.b")], [F.col("place.i")], name).drop("place")


def bim(spark: SparkSession, path: str) -> DataFrame:
    """snp_idx (the place in the file, which the packed genotypes go by), CHR, SNP, CM, BP, A1, A2."""
    p = F.split(F.trim("value"), r"\s+")
    kinds = (("CHR", "string"), ("SNP", "string"), ("CM", "double"), ("BP", "long"), ("A1", "string"), ("A2", "string"))
    return _indexed(lines(spark, path).select("place", *(p[i].cast(t).alias(n) for i, (n, t) in enumerate(kinds))), "snp_idx")


def fam(spark: SparkSession, path: str) -> DataFrame:
    """ind_idx and IID, the second column."""
    return _indexed(lines(spark, path).select("place", F.split(F.trim("value"), r"\s+")[1].alias("IID")), "ind_idx")


def ancestry_map(spark: SparkSession, path: str) -> DataFrame:
    """IID and ancestry, without a header."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).select(p[0].alias("IID"), p[1].alias("ancestry"))


def decode(packed: bytes, n: int) -> np.ndarray:
    """Dosages of n people from packed bytes, the lowest two bits first."""
    return decoded(np.frombuffer(packed, np.uint8)[None, :], n)[0]


def decoded(rows: np.ndarray, n: int) -> np.ndarray:
    """Dosages [variant, person] of n people from packed rows [variant, byte], MISSING where not called."""
    codes = (rows[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return DOSAGE[codes.reshape(len(rows), -1)[:, :n]]


def as_lists(first: int, g: np.ndarray) -> pa.RecordBatch:
    """(snp_idx, dosage) of consecutive variants."""
    n, people = g.shape
    flat = pa.array(g.astype(np.int32).ravel(), pa.int32(), mask=(g == MISSING).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * people), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], ["snp_idx", "dosage"])


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


#: Dosages that make a batch.
BATCH = 1 << 21


class _Reader(DataSourceReader):
    """Ranges of variants, each read by one seek from any file system that Arrow knows; of people only those wanted."""

    def __init__(self, path: str, people: int, variants: int, step: int, wanted: np.ndarray | None, within: tuple[int, int]):
        self.path, self.people, self.variants, self.step, self.wanted, self.within = path, people, variants, step, wanted, within
        self.width = (people + 3) // 4

    def _open(self):
        fs, path = FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (LocalFileSystem(), self.path)
        return fs.open_input_file(path)

    def partitions(self):
        with self._open() as f:
            if f.read(2) != MAGIC:
                raise SourceError(f"{self.path} isn't a packed genotype file")
            if f.read(1) != BY_VARIANT:
                raise SourceError(f"{self.path} isn't ordered by variant")
            if f.size() != 3 + self.width * self.variants:
                raise SourceError(f"{self.path} hasn't the length of {self.variants} variants and {self.people} people")
        first, last = max(0, self.within[0]), min(self.variants, self.within[1])
        return [_Range(i, min(i + self.step, last)) for i in range(first, last, self.step)]

    def read(self, part):
        rows = max(1, BATCH // max(1, self.people))
        with self._open() as f:
            f.seek(3 + part.first * self.width)
            for j in range(part.first, part.last, rows):
                n = min(rows, part.last - j)
                g = decoded(np.frombuffer(f.read(n * self.width), np.uint8).reshape(n, self.width), self.people)
                yield as_lists(j, g if self.wanted is None else g[:, self.wanted])


class PackedGenotypes(DataSource):
    """spark.read.format("packed_genotypes").option("path", bed).option("people", n).option("variants", m).load()

    Ranges of variants (option step) are read in parallel. Options first and last restrict the variants, and kept, a base64
    bitmap of people with the highest bit first, the people. The path has to be one that Arrow opens on every executor; bed() reads any path.
    """

    @classmethod
    def name(cls):
        return "packed_genotypes"

    def schema(self):
        return "snp_idx long, dosage array<int>"

    def reader(self, schema):
        o = self.options
        people, variants = int(o["people"]), int(o["variants"])
        wanted = np.flatnonzero(np.unpackbits(np.frombuffer(base64.b64decode(o["kept"]), np.uint8))[:people]) if "kept" in o else None
        return _Reader(o["path"], people, variants, int(o.get("step", 1000)), wanted, (int(o.get("first", 0)), int(o.get("last", variants))))


def bitmap(places, people: int) -> str:
    """The option kept from places of people."""
    bits = np.zeros(people, np.uint8)
    bits[np.asarray(places, np.int64)] = 1
    return base64.b64encode(np.packbits(bits).tobytes()).decode()


def arrow_opens(path: str) -> bool:
    """Whether Arrow has a file system for the path; others are read through Spark's."""
    if "://" not in path and not path.startswith("file:"):
        return True
    try:
        FileSystem.from_uri(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def bed(spark: SparkSession, path: str, people: int, variants: int, kept=None, first: int = 0, last: int | None = None) -> DataFrame:
    """snp_idx and dosage (copies of the second allele, null where missing), from any file system that Spark reads.

    kept: places of the people whose dosages are wanted, in order; first and last: a range of variants. Both are read no further than
    asked for. A file system that Arrow doesn't know is read by Spark's whole-file source, which holds files up to 2 GB, in one task.
    """
    last = variants if last is None else min(last, variants)
    if arrow_opens(path):
        spark.dataSource.register(PackedGenotypes)
        read = spark.read.format("packed_genotypes").option("path", path).option("people", people).option("variants", variants).option("first", first).option("last", last)
        return (read if kept is None else read.option("kept", bitmap(kept, people))).load()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    width = (people + 3) // 4
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() != 3 + width * variants:
        raise SourceError(f"{path} hasn't the length of {variants} variants and {people} people")
    wanted = None if kept is None else np.sort(np.asarray(kept, np.int64))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                if bytes(data[:3]) != MAGIC + BY_VARIANT:
                    raise SourceError(f"{path} isn't a packed genotype file ordered by variant")
                rows = max(1, BATCH // max(1, people))
                for j in range(first, last, rows):
                    n = min(rows, last - j)
                    g = decoded(np.frombuffer(data[3 + j * width : 3 + (j + n) * width], np.uint8).reshape(n, width), people)
                    yield as_lists(j, g if wanted is None else g[:, wanted])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "snp_idx long, dosage array<int>")
