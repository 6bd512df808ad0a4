"""LM scoring: a Katz backoff bigram model over whole-corpus counts, with Good-Turing discounts and exact normalisation.

``p(w | h) = d c(hw) / c(h)`` for pairs seen in training, else ``alpha(h) p(w)``; ``p(w) = d c(w) / N``, and words never seen share
one event with the mass the discounts leave. ``alpha(h)`` is (1 - discounted mass after h) / (1 - sum of p(w) over words seen after h),
so every history sums to one. A count r up to ``CUT`` is discounted by Katz's ratio from the counts of
counts; above it the same absolute amount as at ``CUT`` is taken, so each history keeps some mass for new words.

Distribution. Texts become *blocks*: about ``BLOCK_BYTES`` of whole documents as local word ids with a sorted vocabulary of 64-bit
hashes, written once. A block asks for the global count of each of its distinct words and pairs: its sorted keys are cut by their top bits into
shards, a shard's task adds up all blocks' training counts and answers each block with an array aligned with its keys. Three such
exchanges (words, pairs, histories) make the model; what moves is one key per block and distinct word or pair, a word or pair that is in every
document is one key a block, and no task holds more than a shard or a block. The shards' sums are the model's
tables. No count is cut off.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.llm.common import bucket_of, column_of, documents, expand, expand_sorted, mix, partitions, seeded, sliced, squeeze, squeeze_sorted, text_bytes, words, written
from hitfold.session import remove_path, stored

BLOCK_BYTES, SHARD_KEYS = 6 << 20, 1 << 20
CUT = 5
NO_ID = -(1 << 63)
START, END = (int(x) for x in seeded(41, 2))
_A, _B = (np.uint64(int(x) | 1) for x in seeded(43, 2))


# --- the model's numbers -------------------------------------------------------------------------


def discounts(counts: np.ndarray, cut: int = CUT) -> np.ndarray:
    """d for r from 1 to ``cut`` from the numbers of types seen 1 to ``cut`` + 1 times.

    Where the ratio isn't between 0 and 1 (small or odd samples), half an occurrence is taken off instead.
    """
    n = counts.astype(float)
    out = np.array([(r - 0.5) / r for r in range(1, cut + 1)])
    if (n[: cut + 1] > 0).all():
        a = (cut + 1) * n[cut] / n[0]
        for r in range(1, cut + 1):
            d = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0.0
            if 0 < d < 1:
                out[r - 1] = d
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d c for counts ``c``; 0 stays 0."""
    c = c.astype(float)
    low = np.concatenate([[0.0], d * np.arange(1, len(d) + 1)])
    return np.where(c <= len(d), low[np.minimum(c, len(d)).astype(np.int64)], c - len(d) * (1 - d[-1]))


# --- blocks --------------------------------------------------------------------------------------

BLOCK = "block long, n_tokens long, docs binary, train binary, ends binary, vocab binary, rank binary, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, train) as blocks of local word ids; each document is a start, its words and an end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, limit=BLOCK_BYTES):
            hashes, owner = words(*text_bytes(column_of(batch, "text")))
            n = batch.num_rows
            sizes = np.bincount(owner, minlength=n) + 2
            ends = np.cumsum(sizes)
            stream = np.empty(int(ends[-1]), np.uint64)
            inner = np.ones(len(stream), bool)
            inner[ends - 1] = inner[ends - sizes] = False
            stream[ends - 1], stream[ends - sizes], stream[inner] = END, START, hashes
            vocab, local, often = np.unique(stream, return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable").astype("<i4")
            place = np.empty(len(vocab), "<i4")
            place[rank] = np.arange(len(vocab))
            blobs = [
                squeeze(column_of(batch, "doc_id").fill_null(NO_ID).to_numpy()), squeeze(column_of(batch, "train").to_numpy(zero_copy_only=False).astype(np.uint8)),
                squeeze(ends), squeeze_sorted(vocab), squeeze(rank), squeeze(place[local]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(stream)]), *(pa.array([b], pa.binary()) for b in blobs)],
                ["block", "n_tokens", "docs", "train", "ends", "vocab", "rank", "tokens"],
            )
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(scan, BLOCK)


class Block:
    """A block's documents, vocabulary and distinct pairs in hash order, with training counts."""

    def __init__(self, row: dict):
        self.docs, self.train, self.ends = expand(row["docs"], "<i8"), expand(row["train"], "u1").astype(bool), expand(row["ends"], "<i8")
        self.vocab = expand_sorted(row["vocab"])
        self.stream = expand(row["rank"], "<i4")[expand(row["tokens"], "<i4")].astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.docs)), np.diff(self.ends, prepend=0))
        self.learned = self.train[self.owner]
        self.word_counts = np.bincount(self.stream[self.learned], minlength=len(self.vocab))
        # tokens are all but the starts; each has the place before it as its history
        first = self.ends - np.diff(self.ends, prepend=0)
        self.at = np.ones(len(self.stream), bool)
        self.at[first] = False
        self.at = np.flatnonzero(self.at)

    def find_pairs(self) -> None:
        n = len(self.vocab)
        code, self.pair = np.unique(self.stream[self.at - 1] * n + self.stream[self.at], return_inverse=True)
        self.left, self.right = code // n, code % n
        key = mix(self.vocab[self.left] * _A + self.vocab[self.right] * _B)
        order = np.argsort(key)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.left, self.right, self.pair = key[order], self.left[order], self.right[order], place[self.pair]
        self.pair_counts = np.bincount(self.pair[self.learned[self.at]], minlength=len(order))


# --- exchanges -----------------------------------------------------------------------------------


def shards_for(keys: int) -> int:
    """A power of two that gives shards of at most about ``SHARD_KEYS``."""
    return 1 << max(-(-int(keys) // SHARD_KEYS) - 1, 0).bit_length()


def cut(block: int, kind: int, keys: np.ndarray, loads: list[np.ndarray], shards: int) -> list[tuple]:
    """A block's question, one row a shard: (kind, block, shard, keys, loads)."""
    edges = np.searchsorted(keys, np.arange(shards, dtype=np.uint64) * np.uint64((1 << 64) // shards)).tolist() if shards > 1 else [0]
    rows = []
    for shard, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
        if b > a:
            load = np.concatenate([x[a:b] for x in loads])
            rows.append((kind, block, shard, squeeze_sorted(keys[a:b]), squeeze(load if load.dtype.kind == "f" else load.astype("<i8"))))
    return rows


QUESTION = "kind int, block long, shard int, keys binary, load binary"


def grouped_rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of a stream sorted by ``names``, group by group; of a batch, one row at a time becomes Python objects."""
    held, key = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: column[i].as_py() for n, column in zip(batch.schema.names, batch.columns, strict=True)}
            own = tuple(row[n] for n in names)
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def answers(questions: DataFrame, cut_: int = CUT) -> DataFrame:
    """(kind, block, shard, answer, stats): sums of the loads of equal keys, aligned with each question's keys.

    Counts answer with ``4 * sum + 2 * shared + first``: shared keys are in other blocks too, first marks one block per key that is in training. Histories (discounted mass, lower mass, count) answer with the logarithm of their backoff weight. ``stats`` rows
    (block -1) hold, for counts, the numbers of keys seen 1 to ``cut_`` + 1 times, of keys and of occurrences.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, shard), rows in grouped_rows(batches, "kind", "shard"):
            keys = [expand_sorted(r["keys"]) for r in rows]
            edges = np.cumsum([0, *map(len, keys)]).tolist()
            flat = np.concatenate(keys)
            del keys
            unique, inverse = np.unique(flat, return_inverse=True)
            stats = None
            if kind == 2:
                asked = [expand(r["load"], "<f8").reshape(3, -1) for r in rows]
                mass, lower = (np.bincount(inverse, np.concatenate([p[i] for p in asked]), len(unique)) for i in (0, 1))
                count = np.zeros(len(unique))
                count[inverse] = np.concatenate([p[2] for p in asked])  # every block knows the whole count
                logs = np.where(count > 0, np.log10(weight(mass, lower, np.maximum(count, 1))), 0.0)[inverse]
                out = [squeeze(logs[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            else:
                load = np.concatenate([expand(r["load"], "<i8") for r in rows])
                total = np.bincount(inverse, load, len(unique)).astype(np.int64)
                seen = np.flatnonzero(load > 0)
                _, first = np.unique(flat[seen], return_index=True)
                answer = 4 * total[inverse] + 2 * (np.bincount(inverse)[inverse] > 1)
                answer[seen[first]] += 1
                out = [squeeze(answer[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                count = total[(unique != np.uint64(START)) & (total > 0)]
                stats = [*np.bincount(np.minimum(count, cut_ + 2), minlength=cut_ + 3)[1 : cut_ + 2].tolist(), len(count), int(count.sum())]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * (n + 1), pa.int32()), pa.array([*(r["block"] for r in rows), -1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()),
                 pa.array([*out, None], pa.binary()), pa.array([*[None] * n, stats], pa.list_(pa.int64()))],
                ["kind", "block", "shard", "answer", "stats"],
            )

    return (
        questions.repartition(partitions(questions.sparkSession), "kind", "shard").sortWithinPartitions("kind", "shard", "block")
        .mapInArrow(add, "kind int, block long, shard int, answer binary, stats array<long>")
    )


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_QUESTION = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("load", pa.binary())])


def ask_counts(cut_blocks: DataFrame, word_shards: int, pair_shards: int) -> DataFrame:
    """The questions of all blocks for words (kind 0) and pairs (kind 1)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                yield batch_of(cut(row["block"], 0, block.vocab, [block.word_counts], word_shards), _QUESTION)
                block.find_pairs()
                yield batch_of(cut(row["block"], 1, block.keys, [block.pair_counts], pair_shards), _QUESTION)

    return cut_blocks.mapInArrow(ask, QUESTION)


# --- scoring -------------------------------------------------------------------------------------

PARTIAL = "docs binary, sums binary, uses binary, upto binary"
_PARTIAL = pa.schema([*_QUESTION, *((n, pa.binary()) for n in ("docs", "sums", "uses", "upto"))])


def score(docs: DataFrame, train) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; the rows where ``train`` holds are learned from.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z and one end; a null or empty text has the end alone. Without training rows
    every token is new: the base is log10(1) = 0 and so is the score. Repeated rows count and are scored each. Only doc_id and text are read; an empty table
    gives no rows. Scores are log10 of the probability of the whole text.
    """
    spark = docs.sparkSession
    own, blocks_at = stored(blocks(docs.withColumn("train", F.coalesce(train, F.lit(False)))), "lm-blocks")
    n_tokens = own.agg(F.sum("n_tokens")).first()[0] or 0
    shards = shards_for(n_tokens // 8), shards_for(n_tokens)
    told, counts_at = stored(answers(ask_counts(own, *shards)), "lm-counts")
    found = {
        (r["kind"], r["pos"]): r["n"]
        for r in told.filter("block = -1 AND stats IS NOT NULL").select("kind", F.posexplode("stats").alias("pos", "v")).groupBy("kind", "pos").agg(F.sum("v").alias("n")).collect()
    }  # 2 * (CUT + 3) rows
    uni, bi = (np.array([found.get((k, p), 0) for p in range(CUT + 3)], np.int64) for k in (0, 1))
    d1, d2 = discounts(uni[: CUT + 1]), discounts(bi[: CUT + 1])
    n, v = int(uni[CUT + 2]), int(uni[CUT + 1])
    # mass of the words seen: sum of d c over types, from the counts of counts and the absolute amount above CUT
    low = uni[:CUT]
    high = v - int(low.sum())
    mass = (float((low * d1 * np.arange(1, CUT + 1)).sum()) + (n - int((low * np.arange(1, CUT + 1)).sum())) - high * CUT * (1 - d1[-1])) / n if n else 0.0
    new = 1.0 - mass
    hist_shards = shards[0]

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in grouped_rows(batches, "block"):
            parts = [np.concatenate([expand(r["answer"], "<i8") for r in rows if r["kind"] == k] or [np.empty(0, np.int64)]) for k in (0, 1)]
            block = Block(next(r for r in rows if r["kind"] == -1))
            del rows
            block.find_pairs()
            del block.keys, block.pair_counts, block.learned  # questions only
            count, pairs = parts[0] >> 2, parts[1] >> 2
            p = np.where(count > 0, discounted(count, d1) / max(n, 1), new)
            # sums after each history over the pairs that this block stands for
            mine = (parts[1] & 1).astype(bool)
            left, taken = block.left[mine], discounted(pairs, d2)
            size = len(block.vocab)
            after = [np.bincount(left, x[mine], size).astype(float) for x in (taken, p[block.right])]
            # a history that no other block has is settled here
            here = parts[0] & 2 == 0
            alpha = np.ones(size)
            known = here & (count > 0)
            alpha[known] = weight(after[0][known], after[1][known], count[known])
            token, history, word = block.pair, block.left[block.pair], block.right[block.pair]
            owner = block.owner[block.at]
            seen = pairs[token] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.where(seen, np.log10(taken[token] / np.maximum(count[history], 1)), np.log10(p[word]) + np.log10(alpha[history]))
            base = np.log10((count[word] + 1) / (n + v + 1))
            docs_ = len(block.docs)
            sums = [np.bincount(owner, x, docs_).astype(float) for x in (np.ones(len(owner)), (count[word] > 0).astype(float), base, logs)]
            later = ~seen & ~here[history]
            # asked of the shards: histories whose weight is used here, or to which this block gives a part
            asked = ~here & (after[0] > 0)
            asked[history[later]] = True
            asked = np.flatnonzero(asked)
            uses = np.searchsorted(asked, history[later]).astype("<i4")
            upto = np.searchsorted(owner[later], np.arange(docs_ + 1))
            tail = [squeeze(block.docs), np.concatenate(sums).tobytes(), squeeze(uses), squeeze(upto.astype("<i8"))]
            out = [(-1, number, -1, None, None, *tail)]
            if len(asked):
                out += [(*q, *[None] * 4) for q in cut(number, 2, block.vocab[asked], [after[0][asked], after[1][asked], count[asked].astype(float)], hist_shards)]
            yield batch_of(out, _PARTIAL)

    names = [f.split()[0] for f in BLOCK.split(", ")]
    blank = [F.lit(None).cast("binary").alias(c) for c in names[2:]]
    told_rows = told.filter("block >= 0").select("kind", "block", F.lit(0).cast("long").alias("n_tokens"), *blank, "shard", "answer")
    own_rows = own.select(F.lit(-1).alias("kind"), *names, F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("answer"))
    half = written(
        own_rows.unionByName(told_rows).repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "shard")
        .mapInArrow(halfway, f"{QUESTION}, {PARTIAL}"),
        "lm-partial",
    )
    for done in (blocks_at, counts_at):  # all that is read from now on is in ``half``
        remove_path(spark, done)
    after = written(answers(half.filter("kind = 2").select("kind", "block", "shard", "keys", "load")), "lm-histories")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped_rows(batches, "block"):
            own_row = next(r for r in rows if r["kind"] == -1)
            keys = expand(own_row["docs"], "<i8")
            sums = np.frombuffer(own_row["sums"], "<f8").reshape(4, -1)
            logs = np.concatenate([expand(r["answer"], "<f8") for r in rows if r["kind"] == 2] or [np.empty(0)])
            run = np.concatenate([[0.0], np.cumsum(logs[expand(own_row["uses"], "<i4")])])
            upto = expand(own_row["upto"], "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if k == NO_ID else k for k in keys.tolist()], pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                 pa.array(sums[2]), pa.array(sums[3] + run[upto[1:]] - run[upto[:-1]])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    tail = PARTIAL.replace(" binary", "").split(", ")
    last = half.filter("kind = -1").select("kind", "block", "shard", *tail, F.lit(None).cast("binary").alias("answer")).unionByName(
        after.filter("block >= 0").select("kind", "block", "shard", *[F.lit(None).cast("binary").alias(c) for c in tail], "answer")
    )
    return (
        last.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "shard")
        .mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        .withColumn("train_tokens", F.lit(n).cast("long"))
    )


def weight(mass: np.ndarray, lower: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Backoff weight: what the pairs after a history leave, over what their words leave in the lower model."""
    return np.maximum(1 - mass / count, 1e-12) / np.maximum(1 - lower, 1e-12)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored by the model of the six folds of seven that are not held out."""
    held = bucket_of(F.col("doc_id"), 2, 7)
    scored = score(documents(spark, sf_dir, "doc_id", "text"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
