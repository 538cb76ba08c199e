"""Token ids of whole texts in a frequency-ranked, byte-aligned variable-length file format.

File format: a Parquet table of blocks. A block holds whole documents in output order and has the columns
shard (int), block (int), base (long: ids before it in its shard), doc_ids (binary, int64), counts (binary, uint32: ids of
each document), control (binary) and data (binary). Every id is stored as its rank by corpus frequency, in one to four
little-endian bytes. control holds the byte count less one of four successive ids, two bits each, lowest bits first.
Beside it lies the table of ranks (rank, id).
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

# --- encoding ------------------------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: White space as the tokenizer's pattern has it, and the contractions that it splits off.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT, _LONG = "stmd", (("r", "e"), ("v", "e"), ("l", "l"))
_state: dict = {}


def _kinds() -> np.ndarray:
    if "kinds" not in _state:
        of = {"L": _LETTER, "N": _NUMBER}
        kinds = np.fromiter((of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        kinds[_WHITE] = _SPACE
        _state["kinds"] = kinds
    return _state["kinds"]


def _spelled(data: np.ndarray) -> str:
    """Byte-level text of bytes: a character for each byte, its own where that is visible in Latin-1, else the next from 256 on."""
    if "bytes" not in _state:
        visible = np.zeros(256, dtype=bool)
        for low, high in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)):
            visible[low:high] = True
        _state["bytes"] = np.where(visible, np.arange(256), 255 + np.cumsum(~visible)).astype("<u2")
    return _state["bytes"][data].tobytes().decode("utf-16-le")


def pieces(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the byte-level tokenizer's pattern begins a piece, in the code points of many texts laid end to end.

    edges: where each text begins. Runs of letters, of digits and of other marks are pieces, each with one blank before
    it; the rest of a run of white space is a piece; contractions are split off where a piece begins with the apostrophe.
    """
    kind = _kinds()[points]
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    space = kind == _SPACE
    begin = change.copy()
    # a run of two or more white spaces before other text gives up its last one
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin |= last
    blank = last & (points == 32)
    begin[1:] &= ~(blank[:-1] & ~first[1:n])  # what follows a blank belongs to it
    quote = np.flatnonzero((points == 39) & begin & change)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        near = points[quote + 1]
        hit = np.isin(near, [ord(c) for c in _SHORT])
        short = quote[hit]
        begin[short + 1] = False
        begin[short[short + 2 < n] + 2] = True
        rest = quote[(quote + 2 < n) & ~hit]
        rest = rest[~first[rest + 2]]
        for x, y in _LONG:
            long = rest[(points[rest + 1] == ord(x)) & (points[rest + 2] == ord(y))]
            begin[long + 1] = False
            begin[long[long + 3 < n] + 3] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of texts by the tokenizers library, which encodes each distinct piece once; pieces are independent of each other."""

    def __init__(self, path: str, keep: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        if not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        # known pieces by their hashes in order, and the slot of each
        self.known, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.at, self.many = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the known ones, and which of them are known."""
        place = np.searchsorted(self.known, hashes)
        if not len(self.known):
            return place, np.zeros(len(hashes), dtype=bool)
        return place, self.known[np.minimum(place, len(self.known) - 1)] == hashes

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words, pieces in byte-level text, by the library's model; hashes are in order."""
        n, encode = len(self.known), self.model.tokenize
        ids: list[int] = []
        ends = np.zeros(len(words) + 1, dtype=np.int64)
        for k, word in enumerate(words):
            ids += [token.id for token in encode(word)]
            ends[k + 1] = len(ids)
        while n + len(words) > len(self.at):
            self.at, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.many))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.many[n : n + len(words)] = np.diff(ends)
        self.at[n : n + len(words)] = self.used + ends[:-1]
        self.used += len(ids)
        place = np.searchsorted(self.known, hashes)
        self.slots = np.insert(self.slots, place, np.arange(n, n + len(words), dtype=np.int32))
        self.known = np.insert(self.known, place, hashes)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not any(s in t for s in self.special) for t in texts]
        out: list = [None] * len(texts)
        for k, ok in enumerate(plain):
            if not ok:
                out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.int32)
        todo = [k for k, ok in enumerate(plain) if ok]
        joined = [texts[k] for k in todo]
        if not any(joined):
            return [np.zeros(0, dtype=np.int32) if x is None else x for x in out]
        if len(self.known) > self.keep:
            self.clear()
        whole = "".join(joined)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
        edges = np.cumsum(length) - length
        starts = pieces(points, edges[length > 0])
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        ends = np.append(starts[1:], len(points))
        from_, to = byte_at[starts], byte_at[ends]
        hashes = C.span_hashes(data, from_, to)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._find(distinct)[1]
        if not known.all():
            new, spelled = where[~known], _spelled(data)
            self._learn(distinct[~known], [spelled[x:y] for x, y in zip(from_[new].tolist(), to[new].tolist(), strict=True)])
        slot = self.slots[self._find(distinct)[0]][back]
        many = self.many[slot].astype(np.int64)
        after = np.cumsum(many)
        flat = self.flat[np.repeat(self.at[slot] - (after - many), many) + np.arange(after[-1])]
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, np.append(edges, len(points)))]
        for k, a, b in zip(todo, bounds[:-1], bounds[1:], strict=True):
            out[k] = flat[a:b]
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if ("encoder", path) not in _state:
        _state["encoder", path] = Encoder(path)
    return _state["encoder", path]


# --- byte-aligned variable-length coding --------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    four[: len(values)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


#: Byte counts of the four values under each control byte.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values under control and data bytes, by looking control bytes up in a table."""
    size = _SIZES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size)
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)[: int(ends[-1]) if n else 0]
    return out.view("<u4").reshape(-1)


#: Stands for a null document id in files.
_NO_ID = -(2**63)

# --- the operator --------------------------------------------------------------------------------------------------


def encode_texts(docs: DataFrame, path: str, end_id: int, key: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """key columns, doc_id and ids (binary, uint16 or uint32 with a width column) of every whole text, the end id appended."""

    def run(batches):
        encode = encoder(path)
        for pdf in C.slabs(batches, "text_", 500_000):
            ids = encode(C.texts_of(pdf["text_"]))
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) + 1
            ends = np.cumsum(size)
            inside = np.ones(ends[-1], dtype=bool)
            inside[ends - 1] = False
            flat = np.full(len(inside), end_id, dtype="<u4")
            flat[inside] = np.concatenate(ids)
            width = 4 if flat.max() > 0xFFFF else 2
            raw = flat.astype(f"<u{width}").tobytes()
            yield pdf.drop(columns="text_").assign(width=np.int32(width), ids=[raw[a:b] for a, b in zip((ends - size) * width, ends * width, strict=True)])

    columns = [F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc_id")] + [k for k in key if k != "doc_id"] + [F.col(text).alias("text_")]
    chosen = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text_") + ", width int, ids binary"
    return chosen.mapInPandas(run, schema)


def _ids(row_ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(row_ids, dtype="<u4" if width == 4 else "<u2")


def rank_table(encoded: DataFrame, vocabulary: int) -> pd.DataFrame:
    """Ids by falling corpus frequency, then id. At most vocabulary rows come to the driver, whatever the corpus holds."""

    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for pdf in batches:
            for width, some in pdf.groupby("width"):
                flat = _ids(b"".join(some["ids"]), width)
                for k in range(0, len(flat), 1_000_000):
                    total += np.bincount(flat[k : k + 1_000_000], minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at.astype(np.int32), "n": total[at]})

    counts = encoded.select("width", "ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)


def write_shards(docs: DataFrame, path: str, end_id: int = 2, order: list[str] | None = None, id_column: str = "doc_id", text: str = "text", vocabulary: int = 65536, block_ids: int = 1_000_000) -> tuple[DataFrame, pd.DataFrame]:
    """Encode every whole text and write the blocks of the file format, in the order of the order columns.

    Returns (blocks, ranks): the table of blocks as read back, and the table of ranks. Null texts count as empty and get
    the end id alone; rows with equal order keys keep an arbitrary order among themselves but for doc_id; rows of an empty
    table give no block; further columns are left out. Texts are encoded once, into a table in the shared folder, from
    which frequencies are counted and which is dealt into contiguous ranges of the order; a task holds one block.
    """
    spark = docs.sparkSession
    order = order or ["doc_id"]
    raw = C.keep(encode_texts(docs, path, end_id, order, id_column, text), "ids")
    ranks = rank_table(raw, vocabulary)
    code = np.zeros(vocabulary, dtype=np.uint32)
    code[ranks["id"].to_numpy()] = np.arange(len(ranks), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(code)
    by = list(dict.fromkeys([*order, "doc_id"]))

    def run(batches):
        from pyspark import TaskContext

        shard, block, base = TaskContext.get().partitionId(), 0, 0
        names, values, held = [], [], 0

        def close():
            nonlocal block, base, names, values, held
            flat = np.concatenate(values)
            control, data = pack(sent.value[flat])
            counts = np.fromiter(map(len, values), dtype="<u4", count=len(values))
            row = {"shard": shard, "block": block, "base": base, "doc_ids": np.array(names, dtype="<i8").tobytes(), "counts": counts.tobytes(), "control": control, "data": data}
            block, base, names, values, held = block + 1, base + len(flat), [], [], 0
            return pd.DataFrame([row])

        for pdf in batches:
            for name, raw_ids, width in zip(pdf["doc_id"], pdf["ids"], pdf["width"], strict=True):
                names.append(name)
                values.append(_ids(raw_ids, width))
                held += len(values[-1])
                if held >= block_ids:
                    yield close()
        if names:
            yield close()

    sorted_ids = raw.repartitionByRange(C.n_partitions(spark), *by).sortWithinPartitions(*by).select("doc_id", "width", "ids")
    blocks = C.keep(sorted_ids.mapInPandas(run, "shard int, block int, base long, doc_ids binary, counts binary, control binary, data binary"), "shards")
    C.drop(raw)
    return blocks, ranks


def read_shards(blocks: DataFrame, ranks: pd.DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks.

    start counts the ids of all documents before it. What comes to the driver is one sum for each shard.
    """
    spark = blocks.sparkSession

    def totals(batches):
        for pdf in batches:
            yield pd.DataFrame({"shard": pdf["shard"], "n": [int(np.frombuffer(c, dtype="<u4").sum(dtype=np.int64)) for c in pdf["counts"]]})

    sums = blocks.select("shard", "counts").mapInPandas(totals, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).toPandas().sort_values("shard")
    first = dict(zip(sums["shard"].tolist(), (sums["n"].cumsum() - sums["n"]).tolist(), strict=True))
    sent = spark.sparkContext.broadcast((first, ranks["id"].to_numpy(dtype="<u4")))

    def run(batches):
        starts, ids = sent.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                names, counts = np.frombuffer(row.doc_ids, dtype="<i8"), np.frombuffer(row.counts, dtype="<u4").astype(np.int64)
                ends = np.cumsum(counts)
                flat = ids[unpack(row.control, row.data, int(ends[-1]))]
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": names, "start": starts[row.shard] + row.base + ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, dtype=np.int64)})

    out = blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def token_shards(docs: DataFrame, path: str, end_id: int = 2, order: list[str] | None = None) -> DataFrame:
    """Write every text of docs to the file format and return what the files hold: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(*write_shards(docs, path, end_id, order))
