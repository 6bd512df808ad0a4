"""Alignment of two tokenizers: which ids of one stand for which ids of the other, and in how many documents.

A text is tokenised whole by both. A byte offset at which both have a token that begins with a space is an *anchor*: what lies before it ends
there in both. Anchors cut a document into windows, pairs of short id sequences, and natural text repeats them, so a worker keeps the
alignment of every window it has met under its ids (tuple of both sides) and looks it up. Aligning a window means cutting it where tokens of both
sides end together; each cut is a *group*, and each occurrence of a left id in a group is linked with each occurrence of a right one.

Documents are handled in *blocks* of about ``BLOCK_WINDOWS`` windows. A block sends each of its id pairs once, with the number of its documents
that hold it; these rows are summed over the corpus, joined back to the blocks that asked, and read by the documents of the block in one sorted stream. So rows
follow distinct pairs a block, not links. Links of a group are never spelled out: its distinct ids are multiplied with their counts.

Texts that are null or empty, or whose tokens do not spell the text, have no tokens and only zeros. Texts of any length are taken whole; one alone
may exceed a block. Rows that repeat a doc_id, or have none, are documents of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken import Encoding
from tokenizers import Tokenizer

from hitfold.llm.common import column_of, documents, expand, partitions, sliced, squeeze, written
from hitfold.llm.tokens import _ODD, byte_letters

#: Windows, or different ones, after which a block of documents is closed; the latter are then forgotten. Words a worker keeps the ids of.
BLOCK_WINDOWS, MEMO, WORDS = 400_000, 100_000, 100_000
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


class Bytes:
    """Ids of texts behind one space, by a byte-level file of the ``tokenizers`` library.

    Where the file's merges are numbered in their order, as ranks, and its text is split by the usual pattern, ``tiktoken`` gives the same ids from its vocabulary, several
    times faster. Texts with letters or white space that Unicode tables might judge differently go to the library of the file.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary, spec = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        spell = lambda token: bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {spell(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        usual = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranked = usual and all(self.vocabulary["".join(x)] == 256 + i for i, x in enumerate(merges))
        self.ranks = Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.vocabulary.items():
            self.bytes[i] = spell(token)

    def encode(self, text: str) -> list[int]:
        held = " " + text
        if self.ranks is not None and (text.isascii() or max(text) < "\u0250") and not _ODD.search(text):
            return self.ranks.encode_ordinary(held)
        return self.tokenizer.encode(held, add_special_tokens=False).ids


class Pieces:
    """Ids of texts by a sentencepiece model, each distinct word encoded once per worker.

    A piece holds its space mark, U+2581, in front only (``plain``), so no merge crosses a space and a text cut at single spaces gives words whose ids do
    not depend on their neighbours. Other texts are encoded whole. New words are encoded together, and all are forgotten when there are too many.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.plain = all("▁" not in p.lstrip("▁") for p in self.pieces)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts that are not empty."""
        whole = [not self.plain or "  " in t or t[0] == " " or t[-1] == " " or "▁" in t or _ODD.search(t) is not None for t in texts]
        cut = [None if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set(chain.from_iterable(filter(None, cut))).difference(self.known))
        for word, ids in zip(new, self.model.encode(new, num_threads=1) if new else (), strict=True):
            self.known[word] = array("I", ids).tobytes()
        known = self.known.__getitem__
        return [array("I", self.model.encode(t)).tobytes() if words is None else b"".join(map(known, words)) for t, words in zip(texts, cut, strict=True)]


class Windows(dict):
    """Alignments of windows by their ids, left ones, ``MARK`` and right ones as 32-bit numbers in bytes.

    A window is known as a number; ``groups[ends[n - 1]:ends[n]]`` are its groups. Different groups are few, so each has its text, links and pairs once.
    """

    MARK = (1 << 32) - 1

    def __init__(self, owner: Aligner):
        super().__init__()
        self.owner = owner
        self.groups, self.ends = array("q"), array("q")
        self.numbers: dict[tuple[int, ...] | int, int] = {}
        self.texts: list[str] = []
        self.links, self.pairs, self.times, self.upto = array("q"), array("q"), array("q"), array("q")

    def __missing__(self, key: bytes) -> int:
        ids = memoryview(key).cast("I").tolist()
        sizes_a, sizes_b, size_b, numbers, groups = self.owner.sizes_a, self.owner.sizes_b, self.owner.size_b, self.numbers, self.groups
        i, middle, end = 0, ids.index(self.MARK), len(ids)
        j = middle + 1
        while i < middle:  # as ``Aligner.groups`` cuts, without a call a group
            x, y = ids[i], ids[j]
            at_a, at_b, i0, j0 = sizes_a[x], sizes_b[y], i, j
            i += 1
            j += 1
            if at_a == at_b:
                group = x * size_b + y
            else:
                while at_a != at_b:
                    if at_a < at_b:
                        at_a += sizes_a[ids[i]]
                        i += 1
                    else:
                        at_b += sizes_b[ids[j]]
                        j += 1
                group = (*ids[i0:i], self.MARK, *ids[j0:j])
            number = numbers.get(group)
            groups.append(self.added(group, ids[i0:i], ids[j0:j]) if number is None else number)
        if j != end:
            raise ValueError("a window whose sides differ in length")
        self[key] = number = len(self.ends)
        self.ends.append(len(groups))
        return number

    def added(self, group: tuple[int, ...] | int, left: list[int], right: list[int]) -> int:
        held: Counter[int] = Counter()
        others = Counter(right)
        for x, n in Counter(left).items():
            for y, m in others.items():
                held[x * self.owner.size_b + y] += n * m
        self.texts.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        self.links.append(len(left) * len(right))
        self.pairs.extend(held)
        self.times.extend(held.values())
        self.upto.append(len(self.pairs))
        self.numbers[group] = number = len(self.texts) - 1
        return number


class Aligner:
    """Two tokenizer files as a worker holds them, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.bytes_a = self.a.bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if _BYTE.fullmatch(p) else p.replace("▁", " ").encode() for p in self.b.pieces]
        self.size_b = len(self.bytes_b)
        self.sizes_a, self.sizes_b = ([len(x) for x in side] for side in (self.bytes_a, self.bytes_b))
        self.len_a, self.len_b = np.array(self.sizes_a, np.int64), np.array(self.sizes_b, np.int64)
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.memo = Windows(self)

    def groups(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """Cut two id sequences of the same bytes wherever tokens of both end together."""
        sizes_a, sizes_b = self.sizes_a, self.sizes_b
        i = j = 0
        while i < len(a):
            i0, j0 = i, j
            at_a, at_b = sizes_a[a[i]], sizes_b[b[j]]
            i += 1
            j += 1
            while at_a != at_b:
                if at_a < at_b:
                    at_a += sizes_a[a[i]]
                    i += 1
                else:
                    at_b += sizes_b[b[j]]
                    j += 1
            yield a[i0:i], b[j0:j]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[bytes]]:
        """Ids of both sides for every text; none where the text is null or empty or its ids do not spell it."""
        full = [t for t in texts if t]
        right = iter(self.b.encode(full))
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        left, other = [], []
        for text in texts:
            a, b = (self.a.encode(text), next(right)) if text else ([], b"")
            if text:
                spelled = b" " + text.encode()
                if b"".join(map(spell_a, a)) != spelled or b"".join(map(spell_b, memoryview(b).cast("I"))) != spelled:
                    a, b = [], b""
            left.append(a)
            other.append(b)
        return left, other

    def windows(self, left: list[list[int]], right: list[bytes]) -> list[list[bytes]]:
        """The windows of each document: ids of both sides between anchors, as ``Windows`` has them."""
        before = np.cumsum([0, *map(len, left)])
        a = np.fromiter(chain.from_iterable(left), "<u4", int(before[-1]))
        b = np.frombuffer(b"".join(right), "<u4")
        if not len(a):
            return [[] for _ in left]
        at_a, at_b = (np.cumsum(sizes) - sizes for sizes in (self.len_a[a], self.len_b[b]))
        spaced = np.zeros(int(max(at_a[-1], at_b[-1])) + 1, bool)
        spaced[at_a[self.space_a[a]]] = True
        both = at_b[self.space_b[b]]
        anchor = np.zeros(len(spaced), bool)
        anchor[both[spaced[both]]] = True
        anchor[at_a[before[:-1][np.diff(before) > 0]]] = True  # where a document begins
        is_a, is_b = anchor[at_a], anchor[at_b]
        from_a, from_b = np.flatnonzero(is_a), np.flatnonzero(is_b)
        n = len(from_a)
        # window by window: its left ids, the mark, its right ids
        line = np.full(len(a) + len(b) + n, Windows.MARK, "<u4")
        own_a, own_b = np.cumsum(is_a) - 1, np.cumsum(is_b) - 1
        line[np.arange(len(a)) + from_b[own_a] + own_a] = a
        line[np.arange(len(b)) + np.append(from_a[1:], len(a))[own_b] + own_b + 1] = b
        blob, cuts = line.tobytes(), [*((from_a + from_b + np.arange(n)) * 4).tolist(), len(line) * 4]
        keys = list(map(blob.__getitem__, map(slice, cuts, cuts[1:])))
        upto = np.searchsorted(from_a, before).tolist()
        return [keys[i:j] for i, j in zip(upto, upto[1:], strict=False)]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_FIELDS = (
    ("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("held", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
)
_SCHEMA = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary, pairs array<long>, docs array<long>"
)


def _expanded(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs that end at ``ends``, for each number in turn, and how many each has."""
    ends = np.concatenate([np.zeros(1, np.int64), ends])
    counts = ends[numbers + 1] - ends[numbers]
    return np.arange(counts.sum()) + np.repeat(ends[numbers] - (np.cumsum(counts) - counts), counts), counts


class Block:
    """Documents with their windows, until their pairs are summed up together."""

    def __init__(self, own: Aligner):
        self.own, self.rows, self.found, self.size = own, [], [], 0

    def add(self, doc_id: int | None, n_a: int, n_b: int, keys: list[bytes]) -> None:
        self.rows.append((doc_id, n_a, n_b))
        self.found.append(np.fromiter(map(self.own.memo.__getitem__, keys), np.int64, len(keys)))
        self.size += len(keys)

    def batch(self, block: int) -> pa.RecordBatch:
        """A row of the block's pairs and the documents that hold each, then a row for each document."""
        memo, n = self.own.memo, len(self.rows)
        windows = np.concatenate([np.empty(0, np.int64), *self.found])
        view = lambda x: np.frombuffer(x, np.int64)
        at, counts = _expanded(windows, view(memo.ends))
        groups = view(memo.groups)[at]
        n_groups = np.array([int(x.sum()) for x in np.split(counts, np.cumsum([len(x) for x in self.found])[:-1])], np.int64)
        cuts = np.cumsum(n_groups)
        links = np.concatenate([np.zeros(1, np.int64), np.cumsum(view(memo.links)[groups])])
        n_links = links[cuts] - links[cuts - n_groups]
        names, listed, digests = memo.texts.__getitem__, groups.tolist(), []
        for i, j in zip((cuts - n_groups).tolist(), cuts.tolist(), strict=True):
            digests.append(hashlib.sha256(";".join(map(names, listed[i:j])).encode()).hexdigest() if j > i else "")
        at, counts = _expanded(groups, view(memo.upto))
        docs = np.repeat(np.repeat(np.arange(n), n_groups), counts)
        pairs, which = np.unique(view(memo.pairs), return_inverse=True)
        used = np.zeros(len(pairs), bool)
        used[which[at]] = True
        place, pairs = (np.cumsum(used) - 1)[which], pairs[used]
        cells, times = docs * (len(pairs) + 1) + place[at], view(memo.times)[at]
        if (times == 1).all():
            cells, times = np.unique(cells, return_counts=True)
        else:
            order = np.argsort(cells)
            cells, first = np.unique(cells[order], return_index=True)
            times = np.add.reduceat(times[order], first) if len(first) else times
        times = times.astype("<u8")
        owner, place = cells // (len(pairs) + 1), (cells % (len(pairs) + 1)).astype("<u4")
        upto = np.searchsorted(owner, np.arange(n + 1)).tolist()
        held = [squeeze(place[i:j]) for i, j in zip(upto, upto[1:], strict=False)]
        sums = [squeeze(times[i:j]) for i, j in zip(upto, upto[1:], strict=False)]
        none = [None] * n
        columns = [
            [0, *[1] * n], [block] * (n + 1), *[[None, *x] for x in zip(*self.rows, strict=True)],
            [None, *n_groups.tolist()], [None, *n_links.tolist()], [None, *digests], [None, *held], [None, *sums],
            [pairs.tolist(), *none], [np.bincount(place, minlength=len(pairs)).tolist(), *none],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents and blocks of documents with their aligned pairs, written once (see ``Block.batch``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        block, number = Block(own), TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            left, right = own.tokens(column_of(batch, "text").to_pylist())
            keys = own.windows(left, right)
            for doc_id, a, b, held in zip(column_of(batch, "doc_id").to_pylist(), left, right, keys, strict=True):
                block.add(doc_id, len(a), len(b) // 4, held)
            if block.size >= BLOCK_WINDOWS or len(own.memo) >= MEMO:
                yield block.batch(number)
                block, number = Block(own), number + 1
                if len(own.memo) >= MEMO:
                    own.memo = Windows(own)
        if block.rows:
            yield block.batch(number)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA), "aligned")


def pair_counts(measures: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, count, best): documents that hold a linked pair of ids; whether no pair of its left id has more."""
    held = measures.filter("kind = 0").select(F.inline(F.arrays_zip("pairs", "docs")))
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {size_b}"))
    counts = written(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # at most one row an id of the vocabulary
    return counts.join(F.broadcast(top), "a").select("pair", "a", (F.col("pair") % size_b).alias("b"), "count", (F.col("count") == F.col("top")).alias("best"))


def scored(measures: DataFrame, counts: DataFrame) -> DataFrame:
    """Every document with the counts of its links."""
    asked = measures.filter("kind = 0").select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))
    scalars = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    names = ("block", "kind", *scalars, "held", "times")
    empty = F.lit(None).cast("array<struct<place:int,count:long,best:boolean>>").alias("known")
    stream = measures.filter("kind = 1").select(*names, empty).unionByName(answers.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = best = np.empty(0, np.int64)
        for batch in batches:
            out, sums, bests = [], [], []
            kinds, known = column_of(batch, "kind").to_pylist(), column_of(batch, "known")
            for i, (kind, held, times) in enumerate(zip(kinds, column_of(batch, "held").to_pylist(), column_of(batch, "times").to_pylist(), strict=True)):
                if not kind:
                    rows = known[i].values
                    count, best = rows.field("count").to_numpy(), rows.field("best").to_numpy(zero_copy_only=False)
                    continue
                at, often = expand(held, "<u4"), expand(times, "<u8").astype(np.int64)
                out.append(i)
                sums.append(int((count[at] * often).sum()) if len(at) else 0)
                bests.append(int((best[at] * often).sum()) if len(at) else 0)
            kept = batch.take(pa.array(out, pa.int64()))
            columns = [column_of(kept, name) for name in scalars]
            yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), columns[5]], [*scalars[:5], "n_best", "count_sum", scalars[5]])

    dealt = stream.repartition(partitions(measures.sparkSession), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups themselves: (doc_id, start, stop, a, b), bytes of the text behind one space and ids of both sides, a row a group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in sliced(batches):
            left, right = own.tokens(column_of(batch, "text").to_pylist())
            for doc_id, a, b in zip(column_of(batch, "doc_id").to_pylist(), left, right, strict=True):
                groups = list(own.groups(a, memoryview(b).cast("I").tolist()))
                stops = np.cumsum([sum(map(own.len_a.__getitem__, x)) for x, _ in groups]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(groups), pa.int64()), pa.array(np.concatenate([[0], stops[:-1]])[: len(groups)], pa.int64()), pa.array(stops, pa.int64()),
                     pa.array([x for x, _ in groups], pa.list_(pa.int32())), pa.array([y for _, y in groups], pa.list_(pa.int32()))],
                    ["doc_id", "start", "stop", "a", "b"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, stop long, a array<int>, b array<int>")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, and how common its links are over all documents."""
    measures = measured(docs, path_a, path_b)
    return scored(measures, pair_counts(measures, Pieces(path_b).model.get_piece_size()))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents under both tokenizers."""
    import public_tokenizers

    return align(documents(spark, sf_dir, "doc_id", "text"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
