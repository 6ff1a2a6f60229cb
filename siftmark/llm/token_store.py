"""Token-id output: a static range asymmetric numeral system (rANS) over whole corpora.

Layout. The corpus is a sequence of token ids in ascending order of doc_id, an end id after each
document. It is cut into *segments* (whole documents, about ``SEGMENT`` ids), each one binary
string:

    magic "SMRA1\\0\\0\\0" | uint32 length of the head | head (zlib, JSON) | blocks

The head holds the ids, lengths and CRC32s of the documents and, for each block, a *checkpoint*:
its first id, count, byte offset, byte length, lanes and CRC32. A block holds ``BLOCK`` ids (the
last one fewer) and is coded on its own: 64-bit rANS states, one for each of its interleaved
lanes, then 32-bit words in the order in which the decoder takes them. So any block decodes alone
and in parallel with the others, and a damaged one is found by its checksum. All blocks share one
static frequency table, counted over all ids of the corpus and stored once beside the segments.

Segments are rows of a Parquet dataset written by Spark's committer into any file system Spark
knows; that is what makes a lost executor harmless. ``write_segments``/``read_documents`` are the
two halves; ``encode_segment``/``decode_segment`` work on plain bytes.

Edge cases: a null text is the empty text and yields the end id alone; null doc_ids sort first;
equal doc_ids are ordered by their ids; an empty table yields an empty store and an empty result;
extra columns are ignored. Strings of special tokens in a text become their ids, as the library
has it by default; ids are packed in 16 bits if the whole vocabulary fits, else in 32.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import bounded_batches
from siftmark.session import materialize, scratch_path

#: Bits of the frequencies' total; ids in a segment and in a block; ids for each lane, most lanes.
PRECISION, SEGMENT, BLOCK, PER_LANE, LANES = 20, 1 << 21, 1 << 18, 128, 2048
LOW, MAGIC = 1 << 31, b"SMRA1\0\0\0"
#: Entries, and their bytes, beyond which a worker forgets its pre-tokens.
MEMO, MEMO_CHARS = 1_000_000, 32_000_000
#: Pre-tokens that are numbered at once.
PIECES = 1_000_000


class Tables:
    """Static frequencies, scaled to 2**PRECISION, with every counted id at one or more."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        used = counts > 0
        total = 1 << PRECISION
        if used.sum() > total:
            raise ValueError("more ids than the precision can hold")
        freq = np.where(used, np.maximum(1, np.floor(counts * (total / max(counts.sum(), 1)))), 0).astype(np.int64)
        if used.any():
            over = int(freq.sum()) - total  # what rounding up took, or rounding down left, evens out on frequent ids
            order = np.argsort(-freq, kind="stable")
            if over < 0:
                freq[order[0]] -= over
            for i in order:
                if over <= 0:
                    break
                take = min(over, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
                freq[i] -= take
                over -= take
            while over > 0:
                i = int(np.argmax(freq))
                freq[i] -= 1
                over -= 1
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Tables:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


def encode_block(ids: np.ndarray, tables: Tables) -> tuple[bytes, int]:
    """One block and its number of lanes. Step t codes ids[t * lanes : (t + 1) * lanes]."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // PER_LANE)))
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    shift, bits, low32 = np.uint64(63 - PRECISION), np.uint64(PRECISION), np.uint64(32)
    freqs, starts = tables.freq[ids], tables.start[ids]
    limits = freqs << shift
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        f, s, x = freqs[at : at + lanes], starts[at : at + lanes], state[: min(lanes, n - at)]
        full = x >= limits[at : at + lanes]
        if full.any():
            words.append(x[full].astype(np.uint32))
            x[full] >>= low32
        q = x // f
        x[:] = (q << bits) + (x - q * f) + s
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + stream.astype("<u4").tobytes(), lanes


def decode_block(data: bytes, n: int, lanes: int, tables: Tables) -> np.ndarray:
    """The ids of one block."""
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    bits, mask, low32, low = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), np.uint64(32), np.uint64(LOW)
    freq, start, symbol, taken = tables.freq, tables.start, tables.symbol, 0
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        slot = x & mask
        ids = symbol[slot.astype(np.int64)]
        out[at : at + lanes] = ids
        x[:] = freq[ids] * (x >> bits) + slot - start[ids]
        short = np.flatnonzero(x < low)
        if len(short):
            x[short] = (x[short] << low32) | words[taken : taken + len(short)]
            taken += len(short)
    return out


def encode_segment(doc_ids: list[int | None], documents: list[np.ndarray], tables: Tables) -> bytes:
    """A segment from whole documents (their end ids included)."""
    lengths = [len(x) for x in documents]
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    blocks, checkpoints, offset = [], [], 0
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        data, lanes = encode_block(part, tables)
        checkpoints.append([at, len(part), offset, len(data), lanes, zlib.crc32(data)])
        blocks.append(data)
        offset += len(data)
    head = {"docs": doc_ids, "lengths": lengths, "crc32": zlib.crc32(ids.astype("<u4").tobytes()), "checkpoints": checkpoints}
    packed = zlib.compress(json.dumps(head).encode())
    return MAGIC + struct.pack("<I", len(packed)) + packed + b"".join(blocks)


def read_head(segment: bytes) -> tuple[dict, int]:
    """The head of a segment and the offset of its first block."""
    if segment[: len(MAGIC)] != MAGIC:
        raise ValueError("not a segment")
    (size,) = struct.unpack_from("<I", segment, len(MAGIC))
    begin = len(MAGIC) + 4
    return json.loads(zlib.decompress(segment[begin : begin + size])), begin + size


def decode_checkpoint(segment: bytes, base: int, checkpoint: list[int], tables: Tables) -> np.ndarray:
    """The ids of the block at a checkpoint; ValueError if it is damaged."""
    _, n, offset, size, lanes, crc = checkpoint
    data = segment[base + offset : base + offset + size]
    if zlib.crc32(data) != crc:
        raise ValueError("damaged block")
    return decode_block(data, n, lanes, tables)


def decode_segment(segment: bytes, tables: Tables) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a segment."""
    head, base = read_head(segment)
    parts = [decode_checkpoint(segment, base, c, tables) for c in head["checkpoints"]]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["crc32"]:
        raise ValueError("damaged segment")
    cuts = np.cumsum(head["lengths"])[:-1]
    return head["docs"], np.split(ids, cuts) if head["docs"] else []


def byte_characters() -> str:
    """The characters by which byte-level models know the bytes: printable ones of Latin-1 as they are, others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


BYTE_CHARACTERS = byte_characters()


class LibraryEncoder:
    """Ids by the tokenizers library, which sees each distinct pre-token once while it is remembered.

    The library's byte-level pre-tokenizer splits by a pattern and merges within a pre-token only, so
    the ids of a text are those of its pre-tokens in a row (tests hold this against whole texts).
    Remembered pre-tokens are an Arrow array; their ids lie behind each other in one array.
    """

    def __init__(self, definition: str, memo: int = MEMO, memo_chars: int = MEMO_CHARS):
        self.definition, self.memo, self.memo_chars = definition, memo, memo_chars
        self.library = None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __getstate__(self):
        return {"definition": self.definition, "memo": self.memo, "memo_chars": self.memo_chars}

    def __setstate__(self, state):
        self.__init__(**state)

    def _load(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition)
        return self.library

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text that isn't split here."""
        return np.array(self._load().encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: pa.StringArray) -> None:
        """Remember distinct pre-tokens, merged by the library's model, which takes bytes as characters."""
        merge, ids, sizes = self._load().model.tokenize, [], []
        for piece in pieces.to_pylist():
            found = merge(piece.encode().decode("latin-1").translate(BYTE_CHARACTERS))
            ids += [t.id for t in found]
            sizes.append(len(found))
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.known = pa.concat_arrays([self.known, pieces])

    def encode_pieces(self, pieces: pa.ListArray) -> list[np.ndarray]:
        """Ids of texts given as lists of their pre-tokens; a null list is an empty one."""
        if len(self.known) > self.memo or self.known.nbytes > self.memo_chars:
            self._forget()
        encoded = pieces.flatten().dictionary_encode()
        at = pc.index_in(encoded.dictionary, value_set=self.known)
        if at.null_count:
            first = len(self.known)
            self._learn(encoded.dictionary.filter(at.is_null()))
            new = np.asarray(at.is_null())
            at = at.fill_null(0).to_numpy().copy()
            at[new] = np.arange(first, len(self.known))
        else:
            at = at.to_numpy()
        at = at[encoded.indices.to_numpy()]
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def split_column(text: Column, definition: str, pattern: str) -> Column:
    r"""Pre-tokens of a text, made in the JVM; null where only the library may split it.

    That is where the definition isn't plain byte-level, where a text has the content of an added
    token, or a character that the JVM's Unicode version doesn't know: its class may differ.
    ``\s`` and ``\S`` of the pattern are Unicode's white space, as in the library.
    """
    parts = json.loads(definition)
    level = parts.get("pre_tokenizer") or {}
    plain = parts.get("normalizer") is None and parts["model"].get("type") == "BPE" and not parts["model"].get("dropout") and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
    able = F.lit(bool(plain)) & ~text.rlike(r"\p{Cn}")
    for token in parts.get("added_tokens") or []:
        able = able & ~F.contains(text, F.lit(token["content"]))
    in_jvm = pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    return F.when(able, F.regexp_extract_all(text, F.lit(in_jvm), F.lit(0)))


def id_width(definition: str, end_id: int) -> str:
    """Type of packed ids: 16 bits if every id of the vocabulary fits, else 32."""
    parts = json.loads(definition)
    ids = [*parts["model"]["vocab"].values(), *(t["id"] for t in parts.get("added_tokens") or []), end_id]
    return "<u2" if max(ids) < 1 << 16 else "<u4"


def _tokenize(shared, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it may use
        encoder, pack = shared.value, zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], width).tobytes()
        for rows in _gathered(batches):
            split = encoder.encode_pieces(rows.column("pieces"))
            found = [x if t is None else encoder.whole(t) for x, t in zip(split, rows.column("text").to_pylist(), strict=True)]
            ids = [pack.compress(x.astype(width).tobytes() + end) for x in found]
            yield pa.record_batch([rows.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``PIECES`` pre-tokens: the more, the fewer distinct ones in all."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("pieces").values) + batch.num_rows
        if size >= PIECES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def unpack_ids(data: bytes, width: str) -> np.ndarray:
    """Ids of one row of the token table."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), width)


def token_table(docs: DataFrame, definition: str, pattern: str, end_id: int, width: str) -> DataFrame:
    """``doc_id, ids`` with the end id appended; ids packed as ``width`` and compressed."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(LibraryEncoder(definition))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", split_column(text, definition, pattern).alias("pieces"), text.alias("text"))
    return rows.select("doc_id", "pieces", F.when(F.col("pieces").isNull(), F.col("text")).alias("text")).mapInArrow(_tokenize(shared, end_id, width), "doc_id long, ids binary")


def count_ids(tokens: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs in the whole token table: partial counts by task, summed by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                got = np.bincount(np.concatenate([unpack_ids(x.as_py(), width) for x in batch.column(0)]), minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def _segments(shared, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, part = shared.value, TaskContext.get().partitionId()
        docs, held, size, seq, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([x], t) for x, t in ((part, pa.int64()), (seq, pa.int64()), (start, pa.int64()), (size, pa.int64()), (encode_segment(docs, held, tables), pa.binary()))],
                names=["part", "seq", "part_start", "n_tokens", "segment"],
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                docs.append(doc.as_py())
                held.append(unpack_ids(ids.as_py(), width).astype(np.uint32))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield flush()
                    docs, held, seq, start, size = [], [], seq + 1, start + size, 0
        if docs:
            yield flush()

    return run


def write_segments(docs: DataFrame, path: str, definition: str, pattern: str, end_id: int) -> None:
    """Encode ``docs`` and write the store: ``path/segments`` and ``path/table``.

    One shuffle, of packed ids, by ranges of doc_id; a partition's segments follow each other and
    partitions are in the order of their ranges.
    """
    spark, width = docs.sparkSession, id_width(definition, end_id)
    tokens = materialize(token_table(docs, definition, pattern, end_id, width), "ids", codec="uncompressed")
    tables = Tables(count_ids(tokens, width))
    shared = spark.sparkContext.broadcast(tables)
    ranged = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ranged.mapInArrow(_segments(shared, width), "part long, seq long, part_start long, n_tokens long, segment binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")
    spark.createDataFrame(pd.DataFrame({"frequencies": [tables.to_bytes()]}), "frequencies binary").coalesce(1).write.parquet(f"{path}/table")


def _documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for part, start, segment in zip(*(batch.column(c) for c in ("part", "part_start", "segment")), strict=True):
                docs, documents = decode_segment(segment.as_py(), tables)
                sizes = np.array([len(x) for x in documents], np.int64)
                yield pa.record_batch(
                    [
                        pa.array([part.as_py()] * len(docs), pa.int64()),
                        pa.array(docs, pa.int64()),
                        pa.array(start.as_py() + np.cumsum(sizes) - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in documents], pa.int64()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(spark, path: str) -> DataFrame:
    """Decode a store: ``doc_id, start, n_tokens, ids_crc32``.

    The driver sums ids by partition of the store (a row for each written file) to place them.
    """
    segments = spark.read.parquet(f"{path}/segments")
    shared = spark.sparkContext.broadcast(Tables.from_bytes(spark.read.parquet(f"{path}/table").first().frequencies))
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    placed = spark.createDataFrame(rows, "part long, before long")
    found = segments.select("part", "part_start", "segment").mapInArrow(_documents(shared), "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(placed), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, definition: str, pattern: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a store in the scratch folder and read it back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_segments(docs, path, definition, pattern, end_id)
    return read_documents(docs.sparkSession, path)
