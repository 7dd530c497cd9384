"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed random order."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopclock.llm.shared import Scratch, map_batches, open_folder
from stopclock.llm.words import mix
from stopclock.session import hadoop_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern of the vocabulary, and the id that is free for the end of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Up to so many input files their places are sent to every task; for more, texts are joined with them.
FILES = 100_000
#: Sequences that a task hands on together.
_TOGETHER = 4096
#: Bytes of a shard that a task reads at once.
_PIECE = 1 << 20


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Feistel:
    """A keyed permutation of 0 … size-1: eight balanced rounds over the next even power of two, walked until inside."""

    def __init__(self, size: int, key: int, rounds: int = 8):
        self.size = size
        self.half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right + key) & self.mask)
        return (left << self.half) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64))
        outside = np.flatnonzero(out >= self.size)
        while len(outside):
            out[outside] = self._once(out[outside])
            outside = outside[out[outside] >= self.size]
        return out.astype(np.int64)


def _places(numbers: np.ndarray, room: int, count: int, key: int, window: int | None) -> np.ndarray:
    """Permuted numbers: over the room of all documents, or inside that of each ``window`` documents."""
    if window is None or window >= count:
        return Feistel(count * room, key)(numbers)
    out, wide = np.empty_like(numbers), window * room
    of = numbers // wide
    for w in np.unique(of):
        own = of == w
        out[own] = int(w) * wide + Feistel(wide, key + int(w) * 0x9E37)(numbers[own] - int(w) * wide)
    return out


def _sequences(ranks: dict[bytes, int], length: int, dtype: str, room: int, count: int, key: int, window: int | None, per_shard: int):
    """Rows ``pos, d, text`` as sequences of ids, each with its permuted number and its shard, a range of these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        numbers, owners, nth, sizes, records = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            place = _places(np.concatenate(numbers), room, count, key, window) if numbers else np.zeros(0, np.int64)
            columns = [pa.array(place), pa.array(place // per_shard), pa.array(owners, pa.int64()), pa.array(nth, pa.int64()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())]
            for some in (numbers, owners, nth, sizes, records):
                some.clear()
            return pa.RecordBatch.from_arrays(columns, ["place", "shard", "doc_id", "seq", "n_tokens", "record"])

        for batch in batches:
            for pos, owner, text in zip(batch.column("pos").to_pylist(), batch.column("d").to_pylist(), batch.column("text"), strict=True):
                tokens = np.append(encoding.encode_to_numpy(text.as_py() or "", disallowed_special=()), END).astype(dtype)
                own = -(-len(tokens) // length)
                numbers.append(np.arange(pos * room, pos * room + own))
                owners += [owner] * own
                nth += range(own)
                for k in range(0, len(tokens), length):
                    part = tokens[k : k + length]
                    sizes.append(len(part))
                    records.append(part.tobytes())
                if len(records) >= _TOGETHER:
                    yield flush()
        yield flush()

    return run


def _shard_name(shard: int) -> str:
    return f"shard-{shard:012d}.bin"


def _writer(folder: str, private: str, stride: int):
    """Writes rows that come sorted by shard and place; a shard appears in ``folder`` when it is whole, until then it grows in ``private``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        attempts = open_folder(private)[1]
        attempt, shard, row, stream = uuid.uuid4().hex, None, 0, None

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(f"{attempts}/{attempt}-{shard}", f"{root}/{_shard_name(shard)}")

        for batch in batches:
            shards, rows = batch.column("shard").to_pylist(), []
            for s, record in zip(shards, batch.column("record"), strict=True):
                if s != shard:
                    close()
                    shard, row = s, 0
                    stream = fs.open_output_stream(f"{attempts}/{attempt}-{shard}")
                stream.write(record.as_py().ljust(stride, b"\xff"))
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(rows, pa.int64()), *(batch.column(c) for c in ("doc_id", "seq", "n_tokens"))], ["shard", "row", "doc_id", "seq", "n_tokens"])
        close()

    return run


def _from_files(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def placed_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pos, d, text``: documents with their places from 0 in the order of their files and of the rows in them.

    That order doesn't depend on how Spark cuts the files. Documents that aren't read from files are written to
    some first, sorted by id and text.
    """
    text = F.col(text_col).cast("string")
    if _from_files(docs):
        rows = docs.select(F.col(id_col).cast("long").alias("d"), text.alias("text"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    else:
        plain = docs.select(F.col(id_col).cast("long").alias("d"), text.alias("text"))
        written = scratch.keep(plain.repartitionByRange(F.col("d"), F.xxhash64("text")).sortWithinPartitions("d", "text"))
        rows = written.select("d", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    # One row per file; no text is read for it.
    bases, total = [], 0
    for found in sorted(rows.groupBy("f").agg((F.max("r") + 1).alias("n")).collect()):
        bases.append((found["f"], total))
        total += found["n"]
    # From Arrow no Python worker is started for it.
    table = docs.sparkSession.createDataFrame(pa.table({"_f": pa.array([f for f, _ in bases], pa.string()), "_base": pa.array([n for _, n in bases], pa.int64())}))
    return rows.join(F.broadcast(table) if len(bases) <= FILES else table, F.col("f") == F.col("_f")).select((F.col("_base") + F.col("r")).alias("pos"), "d", "text")


def write_training_order(
    docs: DataFrame, path: str, key: int = 0, length: int = 256, per_shard: int = 1 << 16, vocabulary: str = VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text", window: int | None = None,
) -> None:
    """Writes every text's token ids as sequences of ``length`` in an order that ``key`` and the data fix.

    Under ``path``: ``shards`` with raw binary files of records, each ``length`` ids of two bytes (four for
    vocabularies above 65,535), the last of a text filled up with 0xff; ``index`` (Parquet: shard, row, doc_id, seq, n_tokens);
    ``manifest`` (Parquet: shard, base, rows, stride, width). A record's global slot is its shard's base plus its row, so slots
    have no gaps, and reading from any slot on is a seek and a sequential read.

    Every text ends with an end marker, so null and empty texts are one sequence of one token. A document's place in its files
    (see ``placed_documents``) and a room that is the same for all, enough for the longest text, number the sequences before texts are
    tokenised, which happens once. A Feistel permutation with cycle-walking over all that room orders them, or over the room of each
    ``window`` documents, which keeps an order that the documents have in the large; slots are the ranks. Nothing depends on how Spark cuts the
    input. Shards are ranges of permuted numbers, of ``per_shard`` records at most and about a third of it for ordinary text: one task sorts one
    shard's records and writes them. A lost task writes its shard again under a private name first, in a folder that is removed at the end.

    Repeated rows have sequences of their own; very long texts are many. An empty table writes no shards.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    dtype = "<u2" if max(max(ranks.values()), END) < (1 << 16) - 1 else "<u4"
    width = int(dtype[-1])
    scratch = Scratch(spark, "token-order")
    rows = placed_documents(docs, scratch, id_col, text_col)
    # A token has one byte at least, and one more ends the text.
    room = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length)
    bound = rows.agg(F.max("pos"), F.max(room), F.sum(room)).first()
    count, most, total = (0 if bound[0] is None else bound[0] + 1), bound[1] or 1, bound[2] or 0
    folder, private = f"{path}/shards", f"{path}/_attempts"
    for name in (folder, private):
        target, fs = hadoop_path(spark, name)
        fs.mkdirs(target)
    shards = max(1, -(-total // per_shard))
    wide = max(1, -(-count * most // shards))
    dealt = map_batches(rows, _sequences(ranks, length, dtype, most, count, key, window, wide), "place long, shard long, doc_id long, seq long, n_tokens long, record binary")
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "place")
    map_batches(dealt, _writer(folder, private, length * width), "shard long, row long, doc_id long, seq long, n_tokens long").write.mode("overwrite").parquet(f"{path}/index")
    fs.delete(target, True)
    # The records lie in shards now, their shuffle files can go.
    scratch.drop()
    sizes = spark.read.schema("shard long, row long").parquet(f"{path}/index").groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), "rows", F.lit(length * width).alias("stride"), F.lit(width).alias("width")).write.mode("overwrite").parquet(f"{path}/manifest")


_MANIFEST = "shard long, base long, rows long, stride int, width int"
_INDEX = "shard long, row long, doc_id long, seq long, n_tokens long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``slot, shard, row, doc_id, seq, n_tokens`` of every record; the manifest has one row per shard."""
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    return index.join(read_manifest(spark, path).select("shard", "base"), "shard").select(
        (F.col("base") + F.col("row")).alias("slot"), "shard", "row", "doc_id", "seq", "n_tokens"
    )


def read_records(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """``slot, shard, row, record`` of the records from slot ``start`` on, read from the binary files; earlier shards aren't opened.

    A task reads one shard, a piece of about ``_PIECE`` bytes at a time.
    """
    manifest = read_manifest(spark, path).where(F.col("base") + F.col("rows") > start)
    shards = manifest.agg(F.max("shard") - F.min("shard") + 1).first()[0] or 1
    folder = f"{path}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for shard, base, stride in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "stride")), strict=True):
                with fs.open_input_file(f"{root}/{_shard_name(shard)}") as file:
                    first, count, some = max(0, start - base), file.size() // stride, max(1, _PIECE // stride)
                    file.seek(min(first, count) * stride)
                    for a in range(first, count, some):
                        n = min(some, count - a)
                        records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, file.read_buffer(n * stride)]).cast(pa.binary())
                        rows = np.arange(a, a + n)
                        yield pa.RecordBatch.from_arrays([pa.array(rows + base), pa.array(np.full(n, shard)), pa.array(rows), records], ["slot", "shard", "row", "record"])

    dealt = manifest.select("shard", "base", "stride").repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int"))
    return map_batches(dealt, run, "slot long, shard long, row long, record binary")


def training_order(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Writes the shards and returns ``slot, shard, row, doc_id, seq, n_tokens, record_crc32`` as read from the files.

    The planner takes the records for as small as the manifest that they are read by, and would collect all of them into the driver for
    a broadcast: both sides are as long as the corpus, so they are merged.
    """
    write_training_order(docs, path, **settings)
    spark = docs.sparkSession
    found = read_records(spark, path).select("slot", F.crc32("record").alias("record_crc32"))
    return read_index(spark, path).join(found.hint("merge"), "slot").select("slot", "shard", "row", "doc_id", "seq", "n_tokens", "record_crc32")
