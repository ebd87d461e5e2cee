"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, taken from all tokens, is shared by all files. A segment (one row of the files) holds whole
documents: their ids and lengths, then blocks of tokens. A block is coded by LANES interleaved coders, token j by coder
j mod LANES, independently of other blocks; every CHECKPOINT steps it notes the coders' states and the place in its
words, so parts of one block can be decoded side by side, and each part has the CRC-32 of its tokens.

Segment, little-endian: magic "LRS1"; documents u32, blocks u32, first token u64 (within its range of documents);
document ids i64 and token counts u64; then for each block: tokens u32, words u32, the checkpoints (coder states
u64 x LANES, place u32, crc u32), and the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch, give_back, prepare, row_chunks, stored, table_path, word_bounds, word_hashes

MAGIC = b"LRS1"
LANES = 64
SCALE = 20
LOW = np.uint64(1 << 31)
CHECKPOINT = 64
BLOCK_STEPS = 512
SEGMENT_TOKENS = 1 << 18
U32 = np.uint64(32)


class Table:
    """Frequencies that sum to 2**SCALE, in proportion to counts and 1 at least for tokens that occur."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        some = counts > 0
        if some.sum() > 1 << SCALE:
            raise ValueError("more kinds of tokens than slots")
        share = counts / max(counts.sum(), 1) * (1 << SCALE)
        freq = np.where(some, np.maximum(1, np.floor(share)), 0).astype(np.int64)
        left = (1 << SCALE) - int(freq.sum())
        if not some.any():
            freq[0], left = 1 << SCALE, 0
        order = np.argsort(-freq, kind="stable")
        while left:  # what rounding left over goes to or comes from the most frequent
            take = order[freq[order] > 1][: max(1, abs(left))] if left < 0 else order[: max(1, min(left, int(some.sum())))]
            step = take[: abs(left)]
            freq[step] += 1 if left > 0 else -1
            left -= len(step) if left > 0 else -len(step)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_blocks(tokens: np.ndarray, table: Table) -> list[bytes]:
    """The blocks of a run of tokens, coded together: step s of all of them at once."""
    size = LANES * BLOCK_STEPS
    n_blocks = -(-len(tokens) // size)
    grid = np.zeros(n_blocks * size, np.int64)
    grid[: len(tokens)] = tokens
    grid = grid.reshape(n_blocks, BLOCK_STEPS, LANES)
    counts = np.full(n_blocks, size)
    if n_blocks:
        counts[-1] = len(tokens) - (n_blocks - 1) * size
    live = (np.arange(size)[None] < counts[:, None]).reshape(grid.shape)
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    sent, words = np.zeros(grid.shape, bool), np.zeros(grid.shape, np.uint32)
    marks = np.zeros((n_blocks, BLOCK_STEPS // CHECKPOINT, LANES), np.uint64)
    for s in range(BLOCK_STEPS - 1, -1, -1):
        on = live[:, s]
        if on.any():
            freq = np.where(on, table.freq[grid[:, s]], np.uint64(1 << SCALE))
            full = on & (state >= (freq << np.uint64(63 - SCALE)))
            sent[:, s] = full
            words[:, s] = state.astype(np.uint32)
            x = np.where(full, state >> U32, state)
            state = np.where(on, (x // freq << np.uint64(SCALE)) + x % freq + table.start[grid[:, s]], state)
        if s % CHECKPOINT == 0:
            marks[:, s // CHECKPOINT] = state
    out = []
    for b in range(n_blocks):
        steps = -(-int(counts[b]) // LANES)
        n_marks = -(-steps // CHECKPOINT)
        place = np.concatenate(([0], np.cumsum(sent[b].sum(1))))
        body = words[b][sent[b]].astype("<u4")
        head = [struct.pack("<II", counts[b], len(body))]
        for m in range(n_marks):
            part = tokens[b * size + m * CHECKPOINT * LANES : min(b * size + (m + 1) * CHECKPOINT * LANES, b * size + int(counts[b]))]
            head.append(marks[b, m].astype("<u8").tobytes() + struct.pack("<II", place[m * CHECKPOINT], zlib.crc32(part.astype("<u4").tobytes())))
        out.append(b"".join(head) + body.tobytes())
    return out


def decode_blocks(blocks: list[bytes], table: Table) -> np.ndarray:
    """The tokens of blocks, all checkpoints' parts decoded side by side; a wrong checksum is an error."""
    states, places, sizes, crcs, bodies, base = [], [], [], [], [], 0
    for data in blocks:
        n, n_words = struct.unpack_from("<II", data)
        n_marks = -(-(-(-n // LANES)) // CHECKPOINT)
        for m in range(n_marks):
            at = 8 + m * (LANES * 8 + 8)
            states.append(np.frombuffer(data, "<u8", LANES, at))
            place, crc = struct.unpack_from("<II", data, at + LANES * 8)
            places.append(base + place)
            crcs.append(crc)
            sizes.append(min(CHECKPOINT * LANES, n - m * CHECKPOINT * LANES))
        bodies.append(np.frombuffer(data, "<u4", n_words, 8 + n_marks * (LANES * 8 + 8)))
        base += n_words
    if not states:
        return np.zeros(0, np.uint32)
    body = np.append(np.concatenate(bodies), np.uint32(0)).astype(np.uint64)
    state, place, size = np.array(states, np.uint64), np.array(places, np.int64), np.array(sizes)
    out = np.zeros((len(size), CHECKPOINT, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    lane = np.arange(LANES)
    for s in range(CHECKPOINT):
        on = s * LANES + lane[None] < size[:, None]
        if not on.any():
            break
        slot = state & mask
        token = table.symbol[slot]
        out[:, s] = token
        x = table.freq[token] * (state >> np.uint64(SCALE)) + slot - table.start[token]
        need = on & (x < LOW)
        rank = np.cumsum(need, axis=1)
        take = body[np.minimum(place[:, None] + rank - 1, len(body) - 1)]
        state = np.where(need, x << U32 | take, np.where(on, x, state))
        place = place + rank[:, -1]
    parts = [out[i].ravel()[: size[i]] for i in range(len(size))]
    for part, crc in zip(parts, crcs, strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a checkpoint's tokens does not match")
    return np.concatenate(parts)


def pack_segment(ids: list[int], lengths: list[int], first: int, tokens: np.ndarray, table: Table) -> bytes:
    blocks = encode_blocks(tokens, table)
    head = MAGIC + struct.pack("<IIQ", len(ids), len(blocks), first)
    head += np.array(ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    return head + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def unpack_segment(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(document ids, their token counts, first token, tokens)."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, n_blocks, first = struct.unpack_from("<IIQ", data, 4)
    ids, lengths = np.frombuffer(data, "<i8", n, 20), np.frombuffer(data, "<u8", n, 20 + 8 * n)
    at, blocks = 20 + 16 * n, []
    for _ in range(n_blocks):
        (size,) = struct.unpack_from("<I", data, at)
        blocks.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return ids, lengths, first, decode_blocks(blocks, table)


# ---------------------------------------------------------------- tokens

#: What a worker holds beside its batch: words whose ids it knows, text taken apart at a time, and words asked for at a time.
CACHED_WORDS = 750_000
ENCODE_BYTES = 1 << 20
ASKED_WORDS = 8_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False


class WordEncoder:
    """Ids as the tokenizers library gives them, each word asked for once.

    Only for tokenizers that lower-case, let no token cross a space, make none of spaces, and part letters from marks
    (but for the apostrophe), like those whose pieces end with a word mark. Then a text's ids are its words' ids, one
    after the other, where an ASCII letter next to an ASCII mark ends a word, too. Words are known by a 64-bit hash.
    A text with one of the tokenizer's added tokens goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        vocab = self.tool.get_vocab()
        self.kinds = max(vocab.values()) + 1
        self.ends = np.zeros(self.kinds, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.added = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, where each word's begin, and how many each has."""
        whole = np.fromiter((w.isalpha() for w in words), bool, len(words))
        n = np.zeros(len(words), np.int64)
        alone = np.flatnonzero(whole).tolist()
        ids = np.zeros(0, np.uint32)
        if alone:  # one word mark each
            texts = [" ".join([words[i] for i in alone[j : j + 500]]) for j in range(0, len(alone), 500)]
            ids = np.concatenate([x for x, _ in self._asked(texts, ASKED_WORDS // 500)])
            stops = np.flatnonzero(self.ends[ids])
            if len(stops) != len(alone):
                whole[:], ids = False, np.zeros(0, np.uint32)
            else:
                n[whole] = np.diff(np.append(-1, stops))
        rest = np.flatnonzero(~whole).tolist()
        other, sizes = zip(*self._asked([words[i] for i in rest], ASKED_WORDS), strict=True)
        n[rest] = np.concatenate(sizes)
        order = np.concatenate((np.flatnonzero(whole), rest)).astype(np.int64)
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate((ids, *other)), begin, n

    def _asked(self, texts: list[str], step: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each text has) of every step texts: the library's answers hold much beside ids, so few are kept at a time."""
        out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for lo in range(0, len(texts), step):
            found = [e.ids for e in self.tool.encode_batch_fast(texts[lo : lo + step], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            out.append((np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())), n))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column end to end, and how many each row has."""
        ids, n = zip(*[self._chunk(data, at) for _, _, data, at in row_chunks(column, ENCODE_BYTES)] or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], strict=True)
        return np.concatenate(ids), np.concatenate(n)

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if any(t in raw for t in self.added):
            texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            odd = [i for i, x in enumerate(texts) if any(t in x for t in self.added)]
            if odd and len(texts) > 1:  # row by row, so that only such rows go whole
                ids, n = zip(*[self._chunk(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in texts], strict=True)
                return np.concatenate(ids), np.concatenate(n)
            if odd:
                ids = np.array(self.tool.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                return ids, np.array([len(ids)])
        letter, mark = _LETTER[data], _MARK[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        starts, ends, words_at = word_bounds(data, at, cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        words, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, words)
        fresh = np.ones(len(words), bool)
        inside = place < len(self.hash)
        fresh[inside] = self.hash[place[inside]] != words[inside]
        if fresh.any():
            if len(self.hash) + fresh.sum() > CACHED_WORDS:
                self.forget()
                place, fresh = np.zeros(len(words), np.int64), np.ones(len(words), bool)
            asked = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[fresh].tolist()]
            ids, begin, n = self.ask(asked)
            begin += len(self.pool)
            self.pool = np.concatenate((self.pool, ids))
            self.at, self.n = np.insert(self.at, place[fresh], begin), np.insert(self.n, place[fresh], n)
            self.hash = np.insert(self.hash, place[fresh], words[fresh])
            place = np.searchsorted(self.hash, words)
        n = self.n[place][which]
        ends_of = np.cumsum(n)
        ids = self.pool[np.arange(ends_of[-1]) + np.repeat(self.at[place][which] - ends_of + n, n)]
        return ids, np.diff(np.append(0, ends_of)[words_at])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the texts and writes, in ascending order of ids (nulls first), folder/segments and folder/table.

    Documents are dealt by ranges of ids, so each range is coded by itself. Rows that share an id follow each other
    in any order; a null id is written as the smallest long. A null text counts as empty: the end id alone. An empty
    table gives files without segments.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    schema = "part int, first long, id long, n long, ids binary"

    small = encoder(path).kinds <= 1 << 16 and end_id < 1 << 16
    kind = "<u2" if small else "<u4"

    def tokenize(batches):
        give_back()
        tool, first = encoder(path), 0
        for b in batches:
            ids, n = tool.encode(b.column(1))
            ids = np.insert(ids, np.cumsum(n), end_id).astype(kind)  # the end id, after each document
            n = n + 1
            stop = np.cumsum(n)
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, stop * ids.itemsize).astype(np.int64)), pa.py_buffer(ids.tobytes())])
            yield batch(schema, [b.column(2), first + stop - n, b.column(0), n, raw.cast(pa.binary())])
            first += int(stop[-1]) if len(stop) else 0

    tokens = stored(rows.mapInArrow(tokenize, schema), "tokens")

    def tally(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                n = np.bincount(np.frombuffer(b"".join(b.column(0).slice(lo, 500).to_pylist()), kind), minlength=len(total))
                n[: len(total)] += total
                total = n
        some = np.flatnonzero(total)
        yield batch("token long, n long", [some, total[some]])

    counted = tokens.select("ids").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted.coalesce(1).write.parquet(f"{folder}/table")
    shared = read_table(spark, folder)  # one row for each kind of token: the vocabulary bounds it

    def code(batches):
        table = Table(shared.value)
        held, total = [], 0

        def flush():
            ids, lengths = [x[1] for x in held], [x[2] for x in held]
            data = pack_segment(ids, lengths, held[0][4], np.frombuffer(b"".join(x[3] for x in held), kind).astype(np.int64), table)
            return batch("part int, first_token long, n_tokens long, segment binary", [[held[0][0]], [held[0][4]], [sum(lengths)], [data]])

        for b in batches:
            for part, first, i, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (total + n > SEGMENT_TOKENS or part != held[-1][0] or first != held[-1][4] + held[-1][2]):
                    yield flush()
                    held, total = [], 0
                held.append((part, i, n, ids, first))
                total += n
        if held:
            yield flush()

    tokens.mapInArrow(code, "part int, first_token long, n_tokens long, segment binary").write.option("compression", "none").parquet(f"{folder}/segments")


def read_table(spark: SparkSession, folder: str):
    rows = spark.read.parquet(f"{folder}/table").collect()
    counts = np.zeros(max([r[0] for r in rows], default=0) + 1, np.int64)
    for token, n in rows:
        counts[token] = n
    return spark.sparkContext.broadcast(counts)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files; start counts from 0 over all of them."""
    prepare(spark)
    files = spark.read.parquet(f"{folder}/segments")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of documents.
    base = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = read_table(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"

    def decode(batches):
        table = Table(shared.value)
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, lengths, first, tokens = unpack_segment(data, table)
                ends = np.cumsum(lengths).astype(np.int64)
                starts = ends - lengths.astype(np.int64)
                raw = tokens.astype("<u4").tobytes()
                each = [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch(schema, [ids, starts + first + base, lengths.astype(np.int64), [zlib.crc32(x) for x in each], each])

    return files.join(F.broadcast(base), "part").select("base", "segment").mapInArrow(decode, schema)


def packed_documents(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' tokens to the shared folder and gives each document's entry as the files have it."""
    folder = table_path(docs.sparkSession, "tokenfiles")
    write_tokens(docs, path, end_id, folder)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
