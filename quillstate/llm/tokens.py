"""Token ids of a whole corpus under a public byte-level BPE, by a table of distinct words.

Merges of a byte-level BPE never cross the words its split pattern makes, so a text's ids
are the ids of its words in a row. Texts are gathered in blocks of some megabytes;
words are split in Spark by the vocabulary's own pattern; each block sends its distinct
words once; each distinct word of the corpus is encoded once; the (block, word, ids) rows
go back to their blocks, where ids are joined to the words by position. The texts are read
once and shuffled once: both the words and the join take them from one exchange. Beside it
the shuffles carry each block's vocabulary, never one row per word occurrence, and the most
frequent word is one row per block. Block sizes are planned from the sizes of the files read.

The JVM knows the letters of an older Unicode than the tokenizer. Texts with a character
the JVM holds for unassigned are encoded whole by the tokenizer itself, in their block.

Defined results: a NULL or an empty text has no ids (an empty list); a NULL ``doc_id`` is
kept; repeated ids and repeated rows stay separate rows; strings of special tokens are ordinary text; an
empty table gives no rows. Only ``doc_id``, ``text`` and the columns named by ``keep``, which
come out beside the result, are used, so other columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstate.session import shuffle_partitions

#: Blocks grow with the corpus between these sizes: larger blocks repeat fewer words between them.
BLOCK_BYTES, MAX_BLOCK_BYTES = 1_000_000, 32_000_000
#: Texts one partition of the gathered blocks should hold at most.
PARTITION_BYTES = 256_000_000
#: Bytes of text that a byte of a compressed file may hold, for planning.
EXPANSION = 2
#: Sizes from here on are Catalyst's way to say that it knows none.
UNKNOWN = 1 << 60
#: The split pattern of the vocabulary. ``S`` is Unicode White_Space, which the JVM's \s is not.
_S = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of ``path``, loaded once per Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODERS[path]


def _lists(ids: list[list[int]]) -> pa.Array:
    return pa.array(ids, pa.list_(pa.int32()))


def _encode_words(path: str):
    """Adds the ids to (block, word) rows sorted by word; a word is encoded where its run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last, last_ids = None, []
        for b in batches:
            coded = b.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if not words:
                continue
            ids = [last_ids if w == last else enc.encode_ordinary(w) for w in words]
            last, last_ids = words[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("word"), _lists(ids).take(coded.indices)], ["at", "word", "ids"])

    return run


def _gather(words: pa.Array, known: pa.Array, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has."""
    at = pc.index_in(words, value_set=known)
    if at.null_count:
        raise ValueError("a word of a block is missing from the word table")
    at = at.to_numpy(zero_copy_only=False)
    bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)[at].astype(np.int64)
    ends = np.cumsum(sizes)
    where = np.repeat(bounds[:-1][at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return flat[where].astype(np.int32), sizes


def _join_block(path: str, carried: list[str], out: str):
    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        doc_words = docs.column("words").combine_chunks()
        words, bounds = doc_words.flatten(), doc_words.offsets.to_numpy() - doc_words.offsets[0].as_py()
        if len(table):
            ids, sizes = _gather(words, table.column("word").combine_chunks(), table.column("ids").combine_chunks())
        else:
            ids, sizes = np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ends = np.r_[0, np.cumsum(sizes)][bounds].astype(np.int64)
        n = np.diff(ends)
        rest = docs.column("raw").combine_chunks()
        odd = np.flatnonzero(rest.is_valid().to_numpy(zero_copy_only=False))
        if len(odd):  # texts with characters newer than the JVM's Unicode
            own = [np.asarray(encoder(path).encode_ordinary(rest[int(i)].as_py()), np.int32) for i in odd]
            parts = np.split(ids, ends[1:-1])
            for i, x in zip(odd, own):
                parts[i] = x
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        made = {c: docs.column(c) for c in carried}
        if out == "n_tokens":
            return pa.table({**made, out: pa.array(n, pa.int64())})
        return pa.table({**made, out: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))})

    return run


def _text_bytes(docs: DataFrame) -> int:
    """About how many bytes of text there are: by the file sizes Catalyst knows of, or by counting where it knows none."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < UNKNOWN:
        return size * EXPANSION
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0


def _blocks(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """All rows by block, moved once: ``block, doc_id, keep0.., text``; NULL texts are empty.

    Rows equal in id and text go to a block for each task that reads them, so no block holds
    more of them than one task has read.
    """
    size = _text_bytes(docs)
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // PARTITION_BYTES))
    n_blocks = max(1, -(-size // min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, size // (2 * parts)))))
    n_parts = min(n_blocks, parts)
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks))
    texts = docs.select(block.alias("block"), "doc_id", *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    return texts.repartition(n_parts, "block"), n_parts


def _words() -> Column:
    return F.when(~F.col("text").rlike(r"\p{Cn}"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))


def word_table(blocks: DataFrame, n_parts: int, path: str) -> DataFrame:
    """``at`` (the block), ``word, ids`` of each block's distinct words."""
    # 0 in every row; naming all columns, it keeps the exchange equal to that of the texts, so that one serves both
    every = F.xxhash64(*[c for c in blocks.columns if c not in ("block", "text")]).bitwiseAND(F.lit(0).cast("bigint"))
    words = blocks.select("block", every.alias("zero"), F.explode(_words()).alias("word"))
    used = words.groupBy("block", "word").agg(F.max("zero").alias("zero"))
    sorted_ = used.repartition(max(n_parts, shuffle_partitions(blocks.sparkSession)), "word").sortWithinPartitions("word")
    return sorted_.mapInArrow(_encode_words(path), "at bigint, word string, ids array<int>")


def _encode(docs: DataFrame, path: str | None, keep: list[str], counts_only: bool) -> DataFrame:
    path = path or default_vocabulary()
    blocks, n_parts = _blocks(docs, keep)
    kept = [f"keep{i}" for i in range(len(keep))]
    split = blocks.select("block", "doc_id", *kept, "text", _words().alias("words"))
    left = split.select("block", "doc_id", *kept, F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.when(F.col("words").isNull(), F.col("text")).alias("raw"))
    right = word_table(blocks, n_parts, path).repartition(n_parts, "at")
    out = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")
    run, types = _join_block(path, ["doc_id", *kept], out[0]), dict(docs.dtypes)
    schema = ", ".join([f"doc_id {types['doc_id']}", *[f"{k} {types[c]}" for k, c in zip(kept, keep)], " ".join(out)])
    done = left.groupBy("block").cogroup(right.groupBy("at")).applyInArrow(lambda a, b: run(a, b), schema)
    return done.select("doc_id", *[F.col(k).alias(c) for k, c in zip(kept, keep)], out[0])


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, *keep, ids`` of every row of ``docs``."""
    return _encode(docs, path, keep or [], counts_only=False)


def token_counts(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, *keep, n_tokens`` of every row of ``docs``."""
    return _encode(docs, path, keep or [], counts_only=True)


_PIECES: dict = {}


def pieces(path: str) -> pa.Array:
    """The bytes of every id of the vocabulary, in order of the ids; its size is that of the file."""
    if path not in _PIECES:
        ranks = load_ranks(path)
        table: list = [None] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            table[i] = piece
        _PIECES[path] = pa.array(table, pa.binary())
    return _PIECES[path]


def _join_pieces(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """Texts of lists of ids: every id is joined to its piece, a text is the bytes between its first and last."""
    found = table.take(ids.flatten())
    if found.null_count:
        raise ValueError("an id has no piece")
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    _, offsets, data = found.buffers()
    starts = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(starts[bounds])), data if data is not None else pa.py_buffer(b"")])
    texts.validate(full=True)
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, path: str | None = None, keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """``doc_id, *keep`` and the text of ``ids``, by a join of ids to pieces.

    The vocabulary is fixed, so the join needs no shuffle: every task holds the pieces in order
    of their ids. An empty list decodes to an empty text, a NULL list to NULL; an id outside the
    vocabulary raises.
    """
    path, keep = path or default_vocabulary(), keep or []
    kept = [f"keep{i}" for i in range(len(keep))]
    types = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ["doc_id", *kept]], _join_pieces(b.column("ids"), table)], ["doc_id", *kept, "decoded"])

    schema = ", ".join([f"doc_id {types['doc_id']}", *[f"{k} {types[c]}" for k, c in zip(kept, keep)], "decoded string"])
    rows = encoded.select("doc_id", *[F.col(c).alias(k) for k, c in zip(kept, keep)], "ids").mapInArrow(run, schema)
    return rows.select("doc_id", *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("decoded").alias(out))
