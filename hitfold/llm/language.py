"""Language ID: a linear-chain conditional random field labels every word, also where a text switches language.

A word is a run of letters (ASCII letters and bytes from 0x80 on); runs above ``LONGEST_WORD`` bytes, as in scripts without spaces, are cut into pieces of
whole characters, alike in training and prediction. Its features are hashed prefixes and suffixes of one to four
bytes, all bigrams and trigrams with word edges, and its entry in a lexicon of words that the sample repeats. Weights and the
transitions between labels are learned together by maximum likelihood (forward-backward, Adam) on a bounded sample: spans of at
most ``SPAN`` words of ``SAMPLE`` documents a language, spliced so that labels change inside a sequence.

Prediction is forward-backward over the whole word sequence of each text. All texts of a slice run together: every
chunk of ``CHUNK`` words is first folded into one small transfer matrix, chunks of a text are then chained, and marginals are
filled in inside the chunks. That equals the pass word by word. A text's language is the one with the largest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hitfold.llm.common import _LOWER, bucket_of, column_of, documents, seeded, sliced, span_hashes, text_bytes

SAMPLE, SPAN, LONGEST_WORD = 200, 256, 64
TABLE, CHUNK, STEPS = 1 << 15, 32, 60
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEED = seeded(31, 16)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of end-to-end texts; a text's end ends a word. Longer runs are cut every ``LONGEST_WORD`` bytes or up to three before, where
    a character begins."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    pieces = np.maximum(-(-(ends - starts) // LONGEST_WORD), 1)
    if (pieces > 1).any():
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = (np.repeat(starts, pieces) + step * LONGEST_WORD)[step > 0]
        for _ in range(3):  # back to the first byte of a character
            cuts = cuts - ((data[cuts] & 0xC0) == 0x80)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of words, end to end, and the first of each word. Every byte of a word takes part."""
    sizes = ends - starts
    room = sizes + 2  # a zero byte before and after each word
    first = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()) + 4, np.uint64)
    inner = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    flat[np.repeat(first + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(len(inner))] = data[inner]

    def place(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), _SEED[kind], np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x100000001B3)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(TABLE)).astype(np.int32)

    n = int(room.sum())
    two = place(0, flat[:n], flat[1 : n + 1])
    three = place(1, flat[:n], flat[1 : n + 1], flat[2 : n + 2])
    fixed = []
    for k in range(1, 5):
        at = [flat[first + np.minimum(i, sizes + 1)] for i in range(1, k + 1)]
        fixed.append(place(1 + k, *at))
        at = [flat[first + np.maximum(sizes + 1 - i, 0)] for i in range(1, k + 1)]
        fixed.append(place(5 + k, *at))
    # by word: 8 affixes, a bigram for every start but the last, a trigram for every start but the last two
    count = 8 + (room - 1) + (room - 2)
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for k, column in enumerate(fixed):
        out[begin + k] = column
    for shift, less, grams in ((8, 1, two), (7, 2, three)):
        many = room - less
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        to = begin + shift + (0 if less == 1 else room)
        out[np.repeat(to, many) + step] = grams[np.repeat(first, many) + step]
    return out, begin


@dataclass
class Model:
    """Weights of a field over ``languages``: hashed features, lexicon entries (sorted word hashes), transitions, start."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and each word's row in them."""
        hashes = span_hashes(data, starts, ends)
        unique, at, row = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.empty((len(at), len(self.languages)), np.float32)
        for a in range(0, len(at), 1 << 14):  # bounds the gathered weights
            pick = at[a : a + (1 << 14)]
            places, begin = features(data, starts[pick], ends[pick])
            out[a : a + len(pick)] = np.add.reduceat(self.weights[places], begin, axis=0)
        if len(self.lexicon):
            known = np.minimum(np.searchsorted(self.lexicon, unique), len(self.lexicon) - 1)
            out += np.where((self.lexicon[known] == unique)[:, None], self.entries[known], 0)
        return out, row


# --- inference -----------------------------------------------------------------------------------


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """P(label of word | all words of its text), for texts of ``lengths`` words end to end; ``scores`` are by word."""
    k = len(start)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.empty((0, k))
    weight = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    jump = np.exp(moves - moves.max())
    chunks = -(-lengths // CHUNK)
    base = np.cumsum(chunks) - chunks  # first chunk of a text
    total = int(chunks.sum())
    head = np.cumsum(lengths) - lengths
    spot = np.arange(len(weight)) - np.repeat(head, lengths)
    slot = (np.repeat(base, lengths) + spot // CHUNK) * CHUNK + spot % CHUNK
    grid = np.ones((total * CHUNK, k))
    grid[slot] = weight
    filled = np.zeros(total * CHUNK, bool)
    filled[slot] = True
    grid, filled = grid.reshape(total, CHUNK, k), filled.reshape(total, CHUNK)
    opens = np.zeros(total, bool)
    opens[base] = True
    # what a chunk does to the labels before it; the first word of a text has no move into it
    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(CHUNK):
        moved = (carry.reshape(-1, k) @ jump).reshape(total, k, k)
        if t == 0:
            moved[opens] = carry[opens]
        moved *= grid[:, t, None, :]
        use = filled[:, t]
        carry = np.where(use[:, None, None], _unit(moved, (1, 2)), carry)
    # chain the chunks of each text, all texts together, the longest first
    order = np.argsort(-chunks, kind="stable")
    into, out_of = np.empty((total, k)), np.ones((total, k))
    state = np.broadcast_to(_unit(np.exp(start - start.max()), 0), (len(lengths), k)).copy()
    for c in range(int(chunks.max())):
        live = order[: np.searchsorted(-chunks[order], -c, "left")]
        into[base[live] + c] = state[live]
        state[live] = _unit(np.einsum("ni,nij->nj", state[live], carry[base[live] + c]), 1)
    for c in range(int(chunks.max()) - 1, 0, -1):
        live = order[: np.searchsorted(-chunks[order], -c, "left")]
        at = base[live] + c
        out_of[at - 1] = _unit(np.einsum("nij,nj->ni", carry[at], out_of[at]), 1)
    ahead, state = np.empty((total, CHUNK, k)), into
    for t in range(CHUNK):
        moved = state @ jump
        if t == 0:
            moved[opens] = state[opens]
        state = np.where(filled[:, t, None], _unit(moved * grid[:, t], 1), state)
        ahead[:, t] = state
    state = out_of
    for t in range(CHUNK - 1, -1, -1):
        ahead[:, t] *= state
        state = np.where(filled[:, t, None], _unit((state * grid[:, t]) @ jump.T, 1), state)
    return _unit(ahead.reshape(-1, k)[slot], 1)


# --- training ------------------------------------------------------------------------------------


def sample(docs: DataFrame, label: str = "lang", size: int = SAMPLE, span: int = SPAN) -> list[tuple[str, bytes]]:
    """(label, words) of at most ``size`` documents a label, the least by a hash of doc_id, at most ``span`` words of each
    from a place that the hash chooses. This bounded sample is all that the fit sees."""
    rank = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    ids = docs.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= size)
    wanted = [r["doc_id"] for r in ids.select("doc_id").collect()]  # at most size a label

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_bytes(column_of(batch, "text"))
            data = _LOWER[data]
            starts, ends = letter_runs(data, offsets)
            cuts = np.searchsorted(starts, offsets)
            rows = []
            for doc_id, a, b in zip(column_of(batch, "doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                a += (doc_id * 7919) % max(b - a - span + 1, 1)
                rows.append(b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : min(b, a + span)].tolist(), ends[a : min(b, a + span)].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "label"), column_of(batch, "doc_id").cast(pa.int64()), pa.array(rows, pa.binary())], ["label", "doc_id", "words"])

    found = docs.filter(F.col("doc_id").isin(wanted) & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), "doc_id", "text")
    rows = found.filter("label IS NOT NULL").mapInArrow(spans, "label string, doc_id long, words binary").collect() if wanted else []
    return [(r["label"], bytes(r["words"])) for r in sorted(rows, key=lambda r: (r["label"], r["doc_id"], bytes(r["words"])))]


def fit(spans: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Model:
    """The field that makes the labels of spliced spans most likely."""
    rng = np.random.default_rng(seed)
    languages = sorted({label for label, words in spans if words})
    k = len(languages)
    if not k:
        return Model([], np.zeros((TABLE, 0), np.float32), np.empty(0, np.uint64), np.empty((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    # splice: runs of 3 to 40 words, each from one span, in random order, cut into sequences of 64 words
    runs = []
    for label, text in spans:
        words, at = text.split(b" ") if text else [], 0
        while at < len(words):
            size = int(rng.integers(3, 41))
            runs.append((languages.index(label), words[at : at + size]))
            at += size
    order = rng.permutation(len(runs))
    words = [w for i in order for w in runs[i][1]]
    labels = np.array([runs[i][0] for i in order for _ in runs[i][1]])
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    hashes = span_hashes(data, starts, starts + sizes)
    unique, at, row, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    places, begin = features(data, starts[at], starts[at] + sizes[at])
    owner = np.repeat(np.arange(len(at)), np.diff(np.append(begin, len(places))))
    entry = np.flatnonzero(often > 2)
    lengths = np.full(-(-len(words) // 64), 64)
    lengths[-1] = len(words) - 64 * (len(lengths) - 1)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(words), bool)
    inside[first] = False
    inner = np.flatnonzero(inside)
    gold = np.zeros((len(words), k))
    gold[np.arange(len(words)), labels] = 1
    theta = {"w": np.zeros((TABLE, k)), "e": np.zeros((len(entry), k)), "m": np.zeros((k, k)), "s": np.zeros(k)}
    mean = {n: np.zeros_like(v) for n, v in theta.items()}
    square = {n: np.zeros_like(v) for n, v in theta.items()}
    for step in range(1, steps + 1):
        scores = np.add.reduceat(theta["w"][places], begin, axis=0)
        scores[entry] += theta["e"]
        by_word = scores[row]
        p = marginals(by_word, theta["m"], theta["s"], lengths)
        # expected moves, from the marginals of neighbours under the local field
        jump = np.exp(theta["m"] - theta["m"].max())
        left = p[inner - 1]
        right = p[inner]
        pair = left[:, :, None] * jump * (right / np.maximum(left @ jump, 1e-12))[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        miss = gold - p
        by_type = np.stack([np.bincount(row, miss[:, j], len(at)) for j in range(k)], 1)
        grad = {
            "w": np.stack([np.bincount(places, by_type[owner, j], TABLE) for j in range(k)], 1),
            "e": by_type[entry],
            "m": np.einsum("ni,nj->ij", gold[inner - 1], gold[inner]) - pair.sum(axis=0),
            "s": miss[first].sum(axis=0),
        }
        for n, g in grad.items():
            g = g / len(words) - 1e-6 * theta[n]
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            theta[n] = theta[n] + 0.08 * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, theta["w"].astype(np.float32), unique[entry], theta["e"].astype(np.float32), theta["m"], theta["s"])


# --- prediction ----------------------------------------------------------------------------------


def _labelled(batch: pa.RecordBatch, model: Model):
    """Bytes, offsets, words and word marginals of a slice."""
    data, offsets = text_bytes(column_of(batch, "text"))
    low = _LOWER[data]
    starts, ends = letter_runs(low, offsets)
    cuts = np.searchsorted(starts, offsets)
    if not len(starts) or not model.languages:
        return offsets, starts, ends, cuts, np.zeros((len(starts), len(model.languages)))
    scores, row = model.emissions(low, starts, ends)
    return offsets, starts, ends, cuts, marginals(scores[row], model.moves, model.start, np.diff(cuts))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean marginal of that language over the words of the whole text.

    Text that is null, empty or without a letter is ``und`` with score 0, and so is everything if nothing was learned. Only the text is read;
    other columns pass through, columns named lang_pred or score are replaced. Ties go to the first language by name.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.withColumn("__llm_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in sliced(batches):
            *_, cuts, p = _labelled(batch, model)
            total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
            share = (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)[:, None]
            known = np.diff(cuts) > 0
            known &= column_of(batch, "__llm_lettered").to_numpy(zero_copy_only=False) & bool(model.languages)
            best = share.argmax(axis=1) if model.languages else np.zeros(batch.num_rows, np.int64)
            labels = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names), pa.array(labels, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return lettered.mapInArrow(tag, schema)


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` whose language is known: not ``und``, and with a score of at least ``least``. Columns are unchanged.

    The threshold is a little above an even guess among four languages: texts that switch between two or three languages stay.

    The model is learned from the rows that carry a ``lang`` and are not in the held-out fold.
    """
    model = fit(sample(docs.filter(~bucket_of(F.col("doc_id"), 2, 4))))
    text = docs.select(F.col("text").alias("__llm_text"), F.struct(*docs.columns).alias("__llm_row")).withColumnRenamed("__llm_text", "text")
    kept = predict(text, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select("__llm_row.*")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words of one language: (doc_id, start, end, lang, words), start and end in UTF-8 bytes of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in sliced(batches):
            offsets, starts, ends, cuts, p = _labelled(batch, model)
            if not len(p) or not model.languages:
                continue
            best = p.argmax(axis=1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            first = np.flatnonzero(np.diff(best, prepend=-1).astype(bool) | np.diff(owner, prepend=-1).astype(bool))
            last = np.append(first[1:], len(best)) - 1
            doc = column_of(batch, "doc_id").cast(pa.int64()).take(pa.array(owner[first]))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(starts[first] - offsets[owner[first]]), pa.array(ends[last] - offsets[owner[last]]),
                 pa.array([model.languages[i] for i in best[first].tolist()], pa.string()), pa.array(last - first + 1)],
                ["doc_id", "start", "end", "lang", "words"],
            )

    return docs.select("doc_id", "text").mapInArrow(tag, "doc_id long, start long, end long, lang string, words long")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the three folds of four that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(sample(docs.filter(~bucket_of(F.col("doc_id"), 2, 4))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", bucket_of(F.col("doc_id"), 2, 4).alias("held_out"), "lang_pred", "score")
