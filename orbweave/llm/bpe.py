"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Documents are packed into chunks of about CHUNK_BYTES of text. A chunk numbers its distinct pre-tokens and keeps,
for each position, the number of the word there. The distinct words travel, hashed into buckets, to the task that
owns their bucket; it encodes each distinct word once and answers every chunk that asked. Answers and positions meet
by chunk, where ids are put together in the order of positions. Messages are packed and compressed, one for each
chunk and bucket, so what is shuffled is the positions and each chunk's distinct words, not every pre-token.

A chunk's key is a hash of its partition, its number there and its content, so equal chunks of repeated documents stay
apart. Both passes over the documents cut the same chunks as long as the input is read in a stable
order, as files are. Where it is not, the join of answers fails loudly and nothing is lost silently; give such inputs
to common.cut() first.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, table

#: UTF-8 bytes of text in a chunk, but for its last document, which is never split.
CHUNK_BYTES = 6_000_000
#: Words whose ids a task remembers.
KNOWN_WORDS = 200_000
#: Documents handed to Python at once; long ones make large batches.
BATCH_DOCUMENTS = 500
# Characters for which the classes of `re` could differ from those of the pattern: such texts take the slower engine.
_UNUSUAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
_COMMON = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 and number on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pre_tokenizer(pattern: str):
    """text -> pre-tokens."""
    import public_tokenizers

    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    return lambda text: (full if _UNUSUAL.search(text) else _COMMON.findall)(text)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays by byte planes, so that small numbers cost little."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.int32)
        parts += [np.int64(len(a)).tobytes(), a.view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        at += 8
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel())
        at += 4 * n
    return out


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], np.int32)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 + 4 * n + np.cumsum(np.frombuffer(raw, np.int32, n, 8))
    starts = np.concatenate(([8 + 4 * n], ends[:-1]))
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def gather(offsets: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices flat[offsets[w]:offsets[w + 1]] for each w one after another, and the length of each."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(offsets[:-1][which] - (ends - lengths), lengths)
    return flat[at], lengths


def _chunks(batches, split, n_ids: int):
    """(key, id columns, pre-tokens per document, distinct words, word number at each position) of each chunk."""
    rows: list[pa.RecordBatch] = []
    sizes: list[int] = []
    positions: list[np.ndarray] = []
    numbers: dict[str, int] = defaultdict(count().__next__)
    held = 0
    partition, chunk_numbers = TaskContext.get().partitionId(), count()

    def done():
        ids = pa.Table.from_batches(rows).combine_chunks()
        words = [w.encode("utf-8", "surrogatepass") for w in numbers]
        where = np.concatenate(positions) if positions else np.empty(0, np.int32)
        digest = xxhash.xxh3_64(np.array([partition, next(chunk_numbers)], np.int64).tobytes())
        digest.update(where.tobytes())
        digest.update(b"\0".join(words))
        digest.update(np.array(sizes, np.int64).tobytes())
        for c in ids.columns:
            digest.update(str(c.to_pylist()).encode())
        return digest.intdigest() - (1 << 63), ids, np.array(sizes, np.int32), words, where

    for batch in batches:
        names = batch.schema.names[:n_ids]
        start = 0
        sizes_in = pc.fill_null(pc.binary_length(batch.column(n_ids)), 0).to_pylist()
        for i, text in enumerate(batch.column(n_ids)):
            found = split(text.as_py() or "")
            sizes.append(len(found))
            positions.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            held += sizes_in[i]
            if held >= CHUNK_BYTES:
                rows.append(batch.select(names).slice(start, i + 1 - start))
                yield done()
                start, held = i + 1, 0
                rows, sizes, positions, numbers = [], [], [], defaultdict(count().__next__)
        if start < batch.num_rows:
            rows.append(batch.select(names).slice(start))
    if sizes:
        yield done()


def _bucket(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n)


def _by_bucket(words: list[bytes], n: int):
    """(bucket, numbers of its words), ascending; the same on both sides of the exchange."""
    buckets = _bucket(words, n)
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(buckets[part[0]]), part


_MESSAGE = "chunk long, bucket int, body binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, bucket, body = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], ["chunk", "bucket", "body"]
    )


class TokenTable:
    """Token bytes by id, laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; an id that the table lacks is an error."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.max() >= len(self.ends) - 1 or ids.min() < 0):
            raise ValueError("an id is not in the token table")
        out, lengths = gather(self.ends, self.flat, ids)
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))]
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def encode(docs: DataFrame, id_columns: list[str], ranks: dict[bytes, int], pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Id columns of each row of docs with `ids`, the token ids of its whole text (array<int>).

    decoded: a column `decoded` too, the bytes of these ids, as decode() gives them; the ids then need no second worker.

    Each match of the pattern is encoded alone, without special tokens. Null and empty texts have no ids. Repeated
    rows give repeated rows, and rows of one id with different texts stay apart; ids may be null. A text is never
    split, however long. Columns other than id_columns and text are not read. Id columns may be named chunk, bucket or
    body. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary file, of fixed size
    n_ids = len(id_columns)
    named = docs.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(id_columns)], F.col(f"`{text}`").alias("text"))
    id_schema = named.drop("text").schema
    buckets = max(docs.rdd.getNumPartitions() * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def words_out(batches):
        for chunk, _, _, words, _ in _chunks(batches, pre_tokenizer(pattern), n_ids):
            parts = list(_by_bucket(words, buckets))
            for i in range(0, len(parts), 256):
                yield _messages([(chunk, b, _pack_words([words[k] for k in part])) for b, part in parts[i : i + 256]])

    def positions_out(batches):
        for chunk, ids, sizes, words, where in _chunks(batches, pre_tokenizer(pattern), n_ids):
            order = np.concatenate([p for _, p in _by_bucket(words, buckets)]) if words else np.empty(0, np.int64)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_table(ids)
            head, body = sink.getvalue().to_pybytes(), _squeeze(sizes, rank[where])
            yield _messages([(chunk, -1, len(head).to_bytes(8, "little") + len(words).to_bytes(8, "little") + head + body)])

    def answer(batches):
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = []
                for w in _unpack_words(row["body"]):
                    if w not in known:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        known[w] = coder.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                    found.append(known[w])
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                out.append((row["chunk"], row["bucket"], _squeeze(sizes, np.array([i for ids in found for i in ids], np.int32))))
            if out:
                yield _messages(out)

    def assemble(key, group):
        group = group.sort_by("bucket")
        bodies = group["body"].to_pylist()
        if group["bucket"][0].as_py() != -1:
            raise RuntimeError("the two passes cut different chunks: give a stable input, such as common.cut(docs)")
        n_head, n_words = (int.from_bytes(bodies[0][i : i + 8], "little") for i in (0, 8))
        ids = pa.ipc.open_stream(bodies[0][16 : 16 + n_head]).read_all()
        sizes, where = _unsqueeze(bodies[0][16 + n_head :])
        answers = [_unsqueeze(b) for b in bodies[1:]]
        lengths = np.concatenate([a[0] for a in answers]) if answers else np.empty(0, np.int32)
        if len(lengths) != n_words:
            raise RuntimeError("the two passes cut different chunks: give a stable input, such as common.cut(docs)")
        flat = np.concatenate([a[1] for a in answers]) if answers else np.empty(0, np.int32)
        tokens, per_word = gather(np.concatenate(([0], np.cumsum(lengths))), flat, where)
        upto = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(sizes)))]
        values = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(tokens, pa.int32()))
        more = [TokenTable(shared.value).decode(values)] if decoded else []
        return pa.table([*ids.columns, values, *more], names=[*ids.schema.names, "ids", *["decoded"] * decoded])

    asked = named.mapInArrow(words_out, _MESSAGE).repartition(buckets, "bucket").mapInArrow(answer, _MESSAGE)
    kept = named.mapInArrow(positions_out, _MESSAGE)
    # kept comes first in the union, so that its partitions have the same numbers in both passes
    out = kept.union(asked).groupBy("chunk").applyInArrow(
        assemble, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in id_schema], "ids array<int>", *["decoded binary"] * decoded])
    )
    return out.select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(id_columns)], "ids", *["decoded"] * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of its ids, from the broadcast token table; null ids give no bytes.

    An id that the table lacks is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(TokenTable(ranks))  # a vocabulary file, of fixed size
    plain = encoded.drop("decoded")
    schema = plain.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            yield pa.RecordBatch.from_arrays([*batch.columns, shared.value.decode(lists)], names=[*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, schema)


def token_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's ids and of what they decode to, as a table.

    Null and empty texts have no ids and the digests of nothing; nulls, repeats and clashes as in encode().
    """
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    digests = encode(docs, ["doc_id"], ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return cut(digests, "tokens", BATCH_DOCUMENTS)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of all `documents`: see token_digests for nulls, empty and long texts, repeats and empty tables."""
    return token_digests(table(spark, sf_dir, "documents"))
