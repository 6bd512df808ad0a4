"""Secret scans: candidates from every whole text, and a random forest that removes the false positives.

Candidates are runs of at least ``LEAST`` of ``[A-Za-z0-9+/_-]`` with a letter or digit, also with dots inside or padding (whole and in parts), values of any length and
signs that follow key words (after = or :, or in quotes), passwords in URLs, and PEM blocks; they may overlap. Features are the length, the mix of and transitions between
character classes, how many distinct characters there are, how usual the letter pairs are, how much of it words of the dictionary cover, the path (hashed source) and
the words and signs around it. The forest is Spark's own, trained on labelled findings (doc_id, start, label).

The dictionary and the letter pairs describe ordinary prose and are counted over all documents. A word is in the dictionary if, among the documents of
any one path, at least ``REPEATED`` and a share of ``USUAL`` hold it, so small sources keep their own words. It is broadcast as a filter of fixed size
(``common.Membership``), which takes a few other strings for words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.llm.common import _LOWER, Membership, bucket_of, column_of, documents, sliced, span_hashes, text_bytes, written

LEAST, LONGEST, HASHED = 12, 24, 16
COVERED = 9  # place of that feature
REPEATED, USUAL = 5, 1e-4
TREES, DEPTH = 40, 8
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}" % LEAST)
_WIDE = re.compile(r"[A-Za-z0-9+/_\-.]{%d,}+={0,2}" % LEAST)
_NAMED = re.compile(r"(?i)(pass|pwd|token|secret|key|auth|cred|bearer)[\w.\-]*+[\"'\])]*+[ \t]*+(=>|:=|==|[=:])?+[ \t]*+")
_STRONG = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|token|secret)(?![A-Za-z])")
_VALUE = re.compile(r"""\"((?:[^\"\\\n]++|\\.)++)|'((?:[^'\\\n]++|\\.)++)|([^\s\"']\S*+)""")
_PART = re.compile(r"[^\s;&,\"'<>]*+")
_URL = re.compile(r"://[^\s/:@]*+:([^\s/]+)@")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----")
_SCHEMES = ("basic", "bearer", "digest", "token")
_WORD = re.compile(r"[A-Za-z]+")
_KEY = re.compile(r"(?i)pass|pwd|token|secret|key|auth|cred|bearer")


class Lexicon:
    """What ordinary words are like: a membership filter of their hashes and the log frequency of each letter pair."""

    def __init__(self, docs: DataFrame, path: str):
        rows = written(word_counts(docs, path), "words")
        found = {r["word"]: r["n"] for r in rows.filter("kind = 1").collect()}  # at most 26 * 26 rows
        counts = np.zeros(26 * 26)
        counts[list(found)] = list(found.values())
        self.pairs = np.log((counts + 1) / (counts.sum() + 26 * 26)).reshape(26, 26)
        sizes = rows.filter("kind = 2").select("place", F.col("n").alias("docs"))
        usual = rows.filter("kind = 0").join(sizes, "place").filter(F.col("n") >= F.col("docs") * USUAL)
        self.known = Membership(usual.select("word").distinct(), "word")

    def measure(self, runs: list[str]) -> tuple[list[float], list[float]]:
        """Of each run: the share that words cover (the longest first), and the mean log frequency of its letter pairs."""
        sizes = np.array([len(r) for r in runs], np.int64)
        low = _LOWER[np.frombuffer("".join(runs).encode("ascii", "replace"), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends = letter_runs(low, offsets)
        room = np.zeros(len(low), np.int64)
        inside = np.arange(int((ends - starts).sum())) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        at = np.repeat(starts, ends - starts) + inside
        room[at] = np.repeat(ends, ends - starts) - at
        longest = np.zeros(len(low), np.int64)
        for k in range(3, LONGEST + 1):
            at = np.flatnonzero(room >= k)
            if not len(at):
                break
            longest[at[self.known.holds(span_hashes(low, at, at + k))]] = k
        whole = starts[self.known.holds(span_hashes(low, starts, ends)) & (ends - starts >= 3)]
        longest[whole] = room[whole]
        jumps, covered = longest.tolist(), []
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            done, i = 0, start
            while i < end:
                done, i = done + jumps[i], i + (jumps[i] or 1)
            covered.append(done / max(end - start, 1))
        two = np.flatnonzero(room > 1)
        owner = np.searchsorted(offsets, two, "right") - 1
        usual = self.pairs[low[two].astype(np.int64) - 97, low[two + 1].astype(np.int64) - 97]
        means = np.bincount(owner, usual, len(runs)) / np.maximum(np.bincount(owner, minlength=len(runs)), 1)
        return covered, means.tolist()


def letter_runs(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a-z in lower-cased texts end to end."""
    letter = (low >= 97) & (low <= 122)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | edge[1:])) + 1
    return starts, ends


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(kind, place, word, n) over all documents: of words (kind 0, by hash, at least ``REPEATED``) and all (kind 2) the documents of each path, of letter
    pairs (kind 1) the occurrences. Equal rows are added up inside tasks first."""

    def merged(held: list[np.ndarray]) -> np.ndarray:
        place, word, n = np.concatenate(held, axis=1)
        order = np.lexsort((word, place))
        place, word, n = place[order], word[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (word[1:] != word[:-1])])) if len(word) else order
        return np.stack([place[first], word[first], np.add.reduceat(n, first) if len(first) else n])

    def rows(kind: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(counts.shape[1], kind, np.int32)), *map(pa.array, counts)], ["kind", "place", "word", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, size = np.zeros(26 * 26, np.int64), [], 0
        for batch in sliced(batches):
            data, offsets = text_bytes(column_of(batch, "text"))
            low = _LOWER[data]
            place = column_of(batch, "place").to_numpy()
            yield rows(2, merged([np.stack([place, np.zeros_like(place), np.ones_like(place)])]))
            if not len(low):
                continue
            starts, ends = letter_runs(low, offsets)
            inner = np.ones(len(low), bool)
            inner[ends - 1] = False
            two = np.flatnonzero(inner & (low >= 97) & (low <= 122))
            pairs += np.bincount((low[two].astype(np.int64) - 97) * 26 + low[two + 1] - 97, minlength=26 * 26)
            long = ends - starts >= 3
            words = span_hashes(low, starts[long], ends[long]).view(np.int64)
            owner = np.searchsorted(offsets, starts[long], "right") - 1
            each = merged([np.stack([owner, words, np.ones_like(words)])])  # a word counts once a document
            held.append(merged([np.stack([place[each[0]], each[1], np.ones_like(each[1])])]))
            size += held[-1].shape[1]
            if size > 1 << 20:
                held = [merged(held)]
                size = held[0].shape[1]
                if size > 1 << 19:
                    yield rows(0, held[0])
                    held, size = [], 0
        if held:
            yield rows(0, merged(held))
        yield rows(1, np.stack([np.zeros(26 * 26, np.int64), np.arange(26 * 26), pairs]))

    own = docs.select("text", F.xxhash64(F.col(path).cast("string")).alias("place"))
    total = own.mapInArrow(count, "kind int, place long, word long, n long").groupBy("kind", "place", "word").agg(F.sum("n").alias("n"))
    return total.filter((F.col("kind") != 0) | (F.col("n") >= REPEATED))


def features(text: str, start: int, end: int, path: str | None, covered: float, usual: float, follows: bool) -> list[float]:
    run, n = text[start:end], end - start
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in run]
    before = text[max(0, start - 40) : start]
    last = before.split()[-2:] if before else []
    words = re.findall(r"[A-Za-z]+", before)[-2:]
    spread = [0.0] * HASHED
    for w in words[-1:]:
        spread[crc32(w.lower().encode()) % HASHED] = 1.0
    return [
        float(n), *(kinds.count(k) / n for k in "duls"), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        len(set(run)) / n, float(all(c in "0123456789abcdef" for c in run)), usual,
        covered, float(bool(_KEY.search(" ".join(words)))), float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
        float(len(last)), float(follows), float(crc32((path or "").encode()) % HASHED), *spread,
    ]


def spots(text: str) -> list[tuple[int, int, str]]:
    """Where candidates are, by place: (start, end, form); the form is private or public (PEM blocks and the runs in them), assigned
    (to a password, token or secret, or a URL's password), named (after other key words), wide or run."""
    out: dict[tuple[int, int], str] = {}
    blocks = list(_BLOCK.finditer(text))
    last = 0
    for m, after in zip(blocks, [*(x.start() for x in blocks[1:]), len(text)], strict=False):
        if last != -1 and last < m.end():
            last = text.find("-----END ", m.end())
        closed = text.find("-----", last + 9, after) if last != -1 and last < after else -1
        end = closed + 5 if closed != -1 else after
        form = "private" if "PRIVATE" in m[1] else "public"
        out[m.start(), end] = form
        for r in _RUN.finditer(text, m.end(), end):
            if not r[0].startswith("-----"):
                out.setdefault((r.start(), r.end()), form)
    for m in _URL.finditer(text):
        out.setdefault(m.span(1), "assigned")
    whole = part = 0  # ends of the last value without quotes and of its last part: what is inside isn't taken again
    for m in _NAMED.finditer(text):
        at, form = m.end(), "assigned" if m[2] and _STRONG.match(m[0]) else "named"
        v = _VALUE.match(text, at) if at >= whole or text[at : at + 1] in ("\"", "'") else None
        if v and v[3] and v[3].lower() in _SCHEMES and m[2]:
            v = _VALUE.match(text, v.end() + 1) or v
            at = v.start()
        if v and not v[3]:
            out.setdefault(v.span(v.lastindex), form)
        elif at >= part and (m[2] or m[1].lower() == "bearer"):
            if v:
                whole = v.end()
                out.setdefault((at, whole), form)
            part = _PART.match(text, at).end()  # without quotes the value may end before a sign
            short = at + len(text[at:part].rstrip(".)]}"))
            if short > at:
                out.setdefault((at, short), form)
    for m in _WIDE.finditer(text):
        a = m.end() - len(m[0].lstrip("."))
        b = m.start() + len(m[0].rstrip("."))
        if b - a >= LEAST and any(map(str.isalnum, m[0])):
            out.setdefault((a, b), "run" if _RUN.fullmatch(text, a, b) else "wide")
        for r in _RUN.finditer(text, m.start(), m.end()):
            if any(map(str.isalnum, r[0])):
                out.setdefault(r.span(), "run")
    return sorted((a, b, form) for (a, b), form in out.items())


def candidates(docs: DataFrame, lexicon: Lexicon, path: str = "source") -> DataFrame:
    """(doc_id, start, length, found, form, features) of every candidate; start and length in code points."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for doc_id, text, place in zip(*(column_of(batch, c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
                found += [(doc_id, text, place, *spot) for spot in spots(text or "")]
            measured = zip(*lexicon.measure([text[a:b] for _, text, _, a, b, _ in found]), strict=True) if found else ()
            after = [m[0] if (m := _WORD.search(text[b : b + 24])) else "" for _, text, _, _, b, _ in found]
            follows = lexicon.measure(after)[0] if found else ()
            rows = [
                (doc_id, a, b - a, text[a:b], form, features(text, a, b, place, covered, usual, share == 1))
                for (doc_id, text, place, a, b, form), (covered, usual), share in zip(found, measured, follows, strict=True)
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "found", "form", "features"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(path).cast("string").alias("path"))
    return own.mapInArrow(scan, "doc_id long, start long, length long, found string, form string, features array<double>")


def train(found: DataFrame, label: Column) -> RandomForestClassificationModel | None:
    """The forest over all labelled findings, both labels with the same weight in all; None unless both occur."""
    rows = found.select(array_to_vector("features").alias("x"), label.cast("double").alias("y")).filter("y IS NOT NULL")
    many = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(many) < 2:
        return None
    rows = rows.withColumn("w", F.when(F.col("y") == 1, sum(many.values()) / many[1.0] / 2).otherwise(sum(many.values()) / many[0.0] / 2))
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=TREES, maxDepth=DEPTH, seed=17).fit(rows)


def scan(docs: DataFrame, label, path: str = "source") -> DataFrame:
    """Findings of all texts: (doc_id, start, length, found, score, is_secret).

    ``label`` makes a column (0, 1 or null) of the candidates' doc_id, start, length, found, form and features: the labelled findings. Null and empty texts have no
    candidates; repeated rows give theirs each; columns other than doc_id, text and the path aren't read. Without findings of both labels
    nothing can be removed, and every candidate scores 1.
    """
    found = written(candidates(docs, Lexicon(docs, path), path), "candidates")
    forest = train(found, label)
    if forest is None:
        return found.select("doc_id", "start", "length", "found", F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", "found", score.alias("score"), (score >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found secret replaced by ``mark``; other columns are unchanged."""
    per_doc = findings.filter("is_secret").groupBy(F.col("doc_id").alias("__llm_id")).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__llm_cuts"))
    step = lambda done, cut: F.struct(
        F.when(cut["start"] < done["at"], done["out"])  # findings that overlap get one mark
        .otherwise(F.concat(done["out"], F.substr(F.col("text"), (done["at"] + 1).cast("int"), (cut["start"] - done["at"]).cast("int")), F.lit(mark))).alias("out"),
        F.greatest(done["at"], cut["start"] + cut["length"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate("__llm_cuts", start, step)
    text = F.when(F.col("__llm_cuts").isNull(), F.col("text")).otherwise(F.concat(folded["out"], F.substr(F.col("text"), (folded["at"] + 1).cast("int"))))
    return docs.join(per_doc, F.col("doc_id") == F.col("__llm_id"), "left").withColumn("text", text).select(*docs.columns)


#: The form of the secrets in the given tables, for comparison in tests; no label follows from it.
CONFIRMED = r"AKIA[0-9A-Z]{16}|[0-9a-fA-F]{18}|[0-9a-fA-F]{40}"
#: Prefixes that vendors give to keys, and JSON web tokens.
VENDORS = (
    r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[\w-]{35}|[rs]k_(live|test)_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]*)$"
)
#: Numbers (of cards too), dates, times and dotted numbers, and addresses of letters alone.
HARMLESS = r"^([0-9]+([-./_][0-9]+)*|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2,6}|(//|www\.)[A-Za-z-]+(\.[A-Za-z-]+)*(/[A-Za-z]*)*)$"
_PLACEHOLDER = r"(?i)^([<$%{\[(*].*|x+|null|none|nil|true|false|undefined|change_?me|example.*|your.*|os\.environ.*|process\.env.*)$"


def known_label() -> Column:
    """The label of candidates whose form or context tells what they are, else null.

    Secrets: known vendor prefixes and web tokens, private PEM blocks, values assigned to a password, token or secret that are no dictionary words, numbers or
    placeholders. Harmless: numbers, dates, addresses, words of the dictionary and public PEM blocks.
    """
    found, form, word = F.col("found"), F.col("form"), F.col("features")[COVERED] == 1
    open_to_doubt = word | found.rlike(HARMLESS) | found.rlike(_PLACEHOLDER)
    secret = found.rlike(VENDORS) | (form == "private") | ((form == "assigned") & ~open_to_doubt)
    free = form.isin("run", "wide") & (found.rlike(HARMLESS) | (word & found.rlike("^[A-Za-z][a-z]*$")))
    return F.when(secret, 1).when(free | (form == "public"), 0)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's verdict; it learned from labelled findings outside the held-out fold."""
    held = bucket_of(F.col("doc_id"), 2, 4)
    label = F.when(~held, known_label())
    found = scan(documents(spark, sf_dir, "doc_id", "text", "source"), label)
    return found.select("doc_id", held.alias("held_out"), "start", "length", F.sha2("found", 256).alias("found_sha256"), "score", "is_secret")
