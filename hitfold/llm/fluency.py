"""Which texts fit a learned language at all, whatever the number of languages.

The conditional random field of ``language`` tells languages from each other and has to choose one of them for any letters. Here each word, under the label that the field gives
it, is also judged by how likely its letters follow each other in that language: the mean log2 probability of a byte after the byte before it (word
edges count, unseen pairs fall back on the byte's own frequency), learned from the field's own bounded sample. A text fits if its bytes need at most ``BACKGROUND`` bits each, what
bytes at random need: prose needs 2 to 4, short texts with a key or a number in them up to 7, random letters about 10, other alphabets more than 20. Words are judged one by one, so texts that switch between learned languages fit as well as others.

Null, empty and letterless texts do not fit; without a learned language nothing does. Whole texts are judged, of any length; repeated rows alike. Columns pass through unchanged, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.llm.common import _LOWER, bucket_of, column_of, sliced, text_bytes
from hitfold.llm.language import Model, _labelled, fit, sample

#: Bits a byte beyond which a text fits no language.
BACKGROUND = 8.0
#: Weight of a byte's own frequency against the pairs seen after the byte before.
PRIOR = 2.0


def letter_pairs(spans: list[tuple[str, bytes]], languages: list[str]) -> np.ndarray:
    """Bits of a byte after another, by language: (language, before, byte); 0 stands for a word's edge."""
    out = np.empty((len(languages), 256, 256), np.float32)
    for k, language in enumerate(languages):
        text = np.frombuffer(b"\0" + b"\0".join(w.replace(b" ", b"\0") for label, w in spans if label == language and w) + b"\0", np.uint8).astype(np.int64)
        pairs = np.bincount(text[:-1] * 256 + text[1:], minlength=1 << 16).reshape(256, 256).astype(float)
        single = (pairs.sum(axis=0) + 2.0**-8) / (pairs.sum() + 1)
        out[k] = -np.log2((pairs + PRIOR * single) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
    return out


def bits(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, label: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word under its label, and the bytes they are for (a word's end is one)."""
    sizes = ends - starts
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    at = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)
    now = low[at].astype(np.int64)
    before = np.concatenate([np.zeros(1, np.int64), now[:-1]]) if len(now) else now
    before[upto[:-1]] = 0
    cost = pairs[np.repeat(label, sizes), before, now]
    total = np.concatenate([np.zeros(1), np.cumsum(cost, dtype=float)])
    return total[upto[1:]] - total[upto[:-1]] + pairs[label, low[ends - 1].astype(np.int64), 0], sizes + 1


def fluency(docs: DataFrame, model: Model, pairs: np.ndarray) -> DataFrame:
    """``docs`` (text and a struct ``row``) with ``bits``, the mean bits of a byte in its words; null for texts without words."""
    held = docs.sparkSession.sparkContext.broadcast((model, pairs))
    schema = docs.select("row", F.lit(0.0).alias("bits")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = held.value
        for batch in sliced(batches):
            _, starts, ends, cuts, p = _labelled(batch, model)
            mean = np.full(batch.num_rows, np.nan)
            if len(starts) and model.languages:
                data, _ = text_bytes(column_of(batch, "text"))
                cost, sizes = bits(_LOWER[data], starts, ends, p.argmax(axis=1), pairs)
                sums = [np.concatenate([np.zeros(1), np.cumsum(x, dtype=float)]) for x in (cost, sizes)]
                cost, sizes = (x[cuts[1:]] - x[cuts[:-1]] for x in sums)
                mean = np.where(sizes > 0, cost / np.maximum(sizes, 1), np.nan)
            yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(mean, pa.float64(), from_pandas=True)], ["row", "bits"])

    return docs.mapInArrow(judge, schema)


def keep_fluent(docs: DataFrame, most: float = BACKGROUND) -> DataFrame:
    """``docs`` without texts that fit no learned language.

    The model is learned from the rows that carry a ``lang`` and are not in the held-out fold.
    """
    spans = sample(docs.filter(~bucket_of(F.col("doc_id"), 2, 4)))
    model = fit(spans)
    rows = docs.filter(F.col("text").rlike(r"\p{L}")).select("text", F.struct(*docs.columns).alias("row"))
    return fluency(rows, model, letter_pairs(spans, model.languages)).filter(F.col("bits") <= most).select("row.*")
