"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

A folder of token files holds

* ``ranks``  Parquet (rank, id): every id by falling corpus frequency, ties by id;
* ``shards`` raw files written by Spark's own committer, in ascending doc_id order;
* ``manifest`` Parquet (path, first_start, n_tokens): one row per shard.

A shard is a run of frames, each closed by one byte 0x0A.  A frame is one document: 32 bytes
of header (shard number, doc_id, count, data length, null flag), then the control bytes (two
bits per code: its length in bytes less one) and the data bytes (little endian, one to four
per rank).  The decoder looks every control byte up in a table of lengths, so whole documents
decode in numpy without a loop over tokens.

Defined cases: a null or empty text is a document with the end id alone; a null doc_id comes
first; a very long text is one frame; repeated rows are documents of their own, and rows of
one doc_id stand in the order of their ids' bytes; an empty table gives no shards and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from posixpath import join
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import count_pieces, default_vocabulary
from .common import arrow_rows, held_in_stage, shared_folder, text_or_empty, tidy, to_batch
from .runs import KNOWN_RUNS, RunTable

END_ID = 1
TOGETHER_NEW = 1 << 12
TOGETHER_DOCUMENTS = 256
#: Rows that are handed back at a time.
TOGETHER_ROWS = 1024
SHARD_DOCUMENTS = 1 << 13
SHARD_BYTES = 1 << 26
#: Shard number, null flag, doc_id, count, data length.
HEADER = Struct("<iiqqq")
MARK = 0x0A

#: Lengths of the four codes that each control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    raw = np.ascontiguousarray(values, "<u4")
    codes = ((raw > 0xFF).astype(np.uint8) + (raw > 0xFFFF) + (raw > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    padded[: len(raw)] = codes
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = np.arange(4) <= codes[:, None]
    return control.astype(np.uint8).tobytes(), raw.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The values again, by table lookup of the control bytes."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    filled = np.zeros((count, 4), np.uint8)
    filled[np.arange(4) < lengths[:, None]] = data
    return filled.view("<u4").reshape(-1)


def pack_all(parts: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """``pack`` of many arrays at once."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    room = -(-lengths // 4) * 4
    ends = np.cumsum(room)
    values = np.zeros(int(ends[-1]) if len(parts) else 0, "<u4")
    real = np.zeros(len(values), bool)
    at = np.repeat(ends - room - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    values[at], real[at] = np.concatenate(parts), True
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = codes.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[(np.arange(4) <= codes[:, None]) & real[:, None]].tobytes()
    stops = np.concatenate(([0], np.cumsum((codes + 1) * real, dtype=np.int64)))[np.concatenate(([0], ends))].tolist()
    marks = np.concatenate(([0], ends // 4)).tolist()
    return [(control[a:b], data[c:d]) for a, b, c, d in zip(marks, marks[1:], stops, stops[1:], strict=False)]


def unpack_all(controls: list[np.ndarray], datas: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
    """``unpack`` of many frames at once."""
    count = np.array(counts, np.int64)
    room = -(-count // 4) * 4
    lengths = LENGTHS[np.concatenate(controls)].reshape(-1)
    at = np.repeat(np.cumsum(room) - room - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    filled = np.zeros((len(at), 4), np.uint8)
    filled[np.arange(4) < lengths[at][:, None]] = np.concatenate(datas)
    values = filled.view("<u4").reshape(-1)
    edges = np.concatenate(([0], np.cumsum(count))).tolist()
    return [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class RunEncoder:
    """Ids of whole texts by the tokenizers library; each new run between spaces is encoded once."""

    def __init__(self, path: str, known_runs: int = KNOWN_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.table = RunTable(self.learn, self.alone, known_runs)

    def learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each run's ids).  Many runs go in one call and
        are told apart by the tokens that close a word; where their number is not as
        expected, one by one."""
        ids, counts = [], []
        for at in range(0, len(runs), TOGETHER_NEW):
            part = runs[at : at + TOGETHER_NEW]
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[own]) + 1
            words = np.cumsum([1 if run.isalpha() else count_pieces(run) for run in part])
            if len(ends) == words[-1]:
                ids.append(own)
                counts.append(np.diff(ends[words - 1], prepend=0))
            else:
                alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids += alone
                counts.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        return np.concatenate(ids), np.concatenate(counts)

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, little-endian unsigned 32-bit integers."""
        return self.table.encode_all(texts)


def encode_ids(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids of every whole text with the end id, 16 bits each where all fit."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = held_in_stage(("library", vocabulary), lambda: RunEncoder(vocabulary))
        last = np.uint32(end_id)
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER_ROWS):
                part, rows = batch.slice(low, TOGETHER_ROWS), []
                for encoded in encoder.encode_all(text_or_empty(part)):
                    ids = np.append(encoded, last)
                    rows.append(b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + ids.tobytes())
                yield to_batch(schema, (part.column(0), rows))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary")


def stage_ids(cell: pa.Scalar) -> np.ndarray:
    raw = cell.as_py()
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def id_ranks(staged: DataFrame) -> DataFrame:
    """(rank, id) by falling frequency over all documents; at most one row per vocabulary entry."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = np.bincount(np.concatenate([stage_ids(cell) for cell in batch.column(0)[low : low + 256]]))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield to_batch(schema, (seen, total[seen]))

    counts = staged.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ordered = counts.toArrow()
    ids, n = (ordered.column(c).to_numpy() for c in ("id", "n"))
    ids = ids[np.lexsort((ids, -n))]
    return staged.sparkSession.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ids)), pa.int64()), "id": pa.array(ids, pa.int64())}))


def write(documents: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_documents: int = SHARD_DOCUMENTS) -> None:
    """Encode all documents and write ranks, shards and manifest into ``folder``."""
    spark = documents.sparkSession
    with arrow_rows(spark, TOGETHER_ROWS):
        encode_ids(documents, vocabulary or default_vocabulary(), end_id).write.parquet(join(folder, "staged"))
    staged = spark.read.schema("doc_id long, ids binary").parquet(join(folder, "staged"))
    ranks = id_ranks(staged)
    ranks.coalesce(1).write.parquet(join(folder, "ranks"))
    order = np.array([row.id for row in ranks.orderBy("rank").collect()], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))

    def frames(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER_DOCUMENTS):
                part = batch.slice(low, TOGETHER_DOCUMENTS)
                ranks = [rank_of[stage_ids(cell)] for cell in part.column(1)]
                rows = [frame(shard, doc_id, len(own), control, data) for doc_id, own, (control, data) in zip(part.column(0).to_pylist(), ranks, pack_all(ranks), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    many, size = staged.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    shards = max(1, -(-many // shard_documents), -(-size // SHARD_BYTES))
    ordered = staged.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    with arrow_rows(spark, TOGETHER_ROWS):
        ordered.mapInArrow(tidy(frames), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", chr(MARK)).text(join(folder, "shards"))
    write_manifest(spark, folder)


def frame(shard: int, doc_id: int | None, count: int, control: bytes, data: bytes) -> bytes:
    return HEADER.pack(shard, doc_id is None, doc_id or 0, count, len(data)) + control + data


def frame_walk(content: np.ndarray):
    """(shard, null, doc_id, count, data length, offset of the control bytes) of each frame."""
    at = 0
    while at < len(content):
        header = HEADER.unpack_from(content, at)
        yield *header, at + HEADER.size
        at += HEADER.size + -(-header[3] // 4) + header[4] + 1


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(join(folder, "shards")).select("path", "content")


def write_manifest(spark: SparkSession, folder: str) -> None:
    """One row per shard, from the frame headers alone."""
    schema = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_tokens", pa.int64())])

    def totals(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                frames = [(shard, count) for shard, _, _, count, _, _ in frame_walk(np.frombuffer(content.as_buffer(), np.uint8))]
                if frames:
                    yield to_batch(schema, ([path.as_py()], [frames[0][0]], [sum(n for _, n in frames)]))

    rows = shard_files(spark, folder).mapInArrow(tidy(totals), "path string, shard int, n_tokens long").collect()
    start, manifest = 0, []
    for row in sorted(rows, key=lambda r: r.shard):
        manifest.append((row.path, start, row.n_tokens))
        start += row.n_tokens
    spark.createDataFrame(manifest, "path string, first_start long, n_tokens long").coalesce(1).write.parquet(join(folder, "manifest"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a folder: doc_id, start, n_tokens, ids_crc32, and the ids on request."""
    order = np.array([r.id for r in spark.read.parquet(join(folder, "ranks")).orderBy("rank").collect()], "<u4")
    starts = {r.path: r.first_start for r in spark.read.parquet(join(folder, "manifest")).collect()}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                start, rows, frames = starts[path.as_py()], [], list(frame_walk(raw))
                for low in range(0, len(frames), TOGETHER_DOCUMENTS):
                    part = frames[low : low + TOGETHER_DOCUMENTS]
                    middles = [at + -(-count // 4) for _, _, _, count, _, at in part]
                    controls = [raw[f[5] : middle] for f, middle in zip(part, middles, strict=True)]
                    datas = [raw[middle : middle + f[4]] for f, middle in zip(part, middles, strict=True)]
                    for (_, null, doc_id, count, _, _), ranks in zip(part, unpack_all(controls, datas, [f[3] for f in part]), strict=True):
                        ids = order[ranks]
                        rows.append((None if null else doc_id, start, count, zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                        start += count
                for at in range(0, len(rows), 4096):
                    yield to_batch(schema, zip(*rows[at : at + 4096], strict=True))

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shard_files(spark, folder).mapInArrow(tidy(decode), shape)


def written_and_read(documents: DataFrame, folder: str | None = None, **options) -> DataFrame:
    folder = folder or shared_folder(documents.sparkSession, "token-files")
    write(documents, folder, **options)
    return read(documents.sparkSession, folder)
