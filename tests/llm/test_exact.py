"""Operators with one right answer, held against plain Python or SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitfold.llm import idfile, lines, media, minhash, mixing, packing
from hitfold.llm.common import components
from hitfold.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


# --- tokens ---


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "Σ", "İ", "中", "\xa0", "\x1c", "don't", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ª"]), max_size=20))
def test_cached_ids_equal_the_tokenizer(path, parts):
    text, own = "".join(parts), encoder(path)
    assert np.frombuffer(own.encode(text), own.kind).tolist() == plain(path)(text)


def test_cache_turnover(monkeypatch, texts):
    import hitfold.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE", 7)
    own, ids = tokens.Encoder(WORD), plain(WORD)
    for text in list(texts.values())[:20]:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == ids(text)


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    used = Counter()
    for pattern, times in packing.plan(counts, 64):
        assert sum(pattern) <= 64
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)


def test_exact_fill_finds_sums_under_counts():
    have = np.zeros(11, np.int64)
    have[3] = 1
    assert packing.exact_fill(have, 6) is None  # one piece of 3 only
    have[3] = 2
    assert packing.exact_fill(have, 6) == [3, 3]
    have[1] = 1
    assert sorted(packing.exact_fill(have, 7)) == [1, 3, 3]


def packed_well(got, capacity):
    got = got.sort_values(["sequence_id", "offset"])
    end = got.offset + got.length
    assert (got.offset == end.groupby(got.sequence_id).shift(1).fillna(0)).all()
    assert end.max() <= capacity
    return got.sequence_id.nunique()


def test_packing_of_documents(spark, docs, texts):
    got = packing.pack(docs, WORD).toPandas()
    ids = plain(WORD)
    expected = {}
    for doc_id, text in texts.items():
        own = np.array([*ids(text), 1], "<u4")
        for k in range(0, len(own), 4096):
            expected[doc_id, k // 4096] = (k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    assert packed_well(got, 4096) <= -(-got.length.sum() // 4096) + 1


def test_packing_odd(odd, empty):
    got = packing.pack(odd, WORD, with_ids=True).toPandas()
    packed_well(got, 4096)
    assert got.groupby("doc_id", dropna=False).length.sum().loc[4.0] == 1
    assert len(got[got.doc_id == 8]) == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack(empty, WORD).count() == 0


# --- near duplicates ---


def brute_components(texts: dict[int, str | None], n: int, percent: int = 80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.toPandas().itertuples()}


def test_near_duplicates_of_documents(docs, texts):
    assert as_dict(minhash.grouped(docs, shingle=4)) == brute_components(texts, 4)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """A family whose members are linked to some and not to others; small blocks and stars, so that every step is taken."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        own = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, expected = as_dict(minhash.grouped(df, shingle=4)), brute_components(texts, 4)
    assert len({c for _, c, _ in expected.values()}) > 1
    assert got == expected


def test_near_duplicates_odd(odd, empty):
    got = minhash.grouped(odd).toPandas()
    assert len(got) == odd.count()
    by = got.set_index("doc_id")
    assert by.component_id.loc[8.0].tolist() == [7, 7] and by.n_shingles.loc[4.0] == 0 and by.component_id.loc[5.0] == 5
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= {4, 5, 6, 7, None}
    assert minhash.grouped(empty).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 400).astype(np.uint64)
    errors = []
    for _ in range(30):
        own = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.unique(np.concatenate([shared, own[:100]])), np.unique(np.concatenate([shared, own[100:]]))
        shared = shared + np.uint64(1)
        errors.append((minhash.superminhash(a, 128) == minhash.superminhash(b, 128)).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.03


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


# --- lines ---


def by_sql(df, spark):
    table = df.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", table)
    return {r[0]: r[1:] for r in con.execute(lines.ORACLE["op3_line_dedup"]).fetchall()}


def summed(df):
    df = df.withColumn("kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in df.collect()}


def test_line_dedup_of_documents(spark, docs):
    assert summed(lines.drop_lines(docs)) == by_sql(docs, spark)


def test_line_dedup_odd(spark, odd, empty):
    got = lines.drop_lines(odd)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    found = {r.doc_id: r for r in got.collect()}
    assert (found[1].n_dropped, found[2].n_dropped, found[3].n_dropped, found[None].n_dropped) == (1, 1, 0, 1)
    assert found[1].text == "own words of one text here" and found[4].text is None and found[4].n_lines == 1
    assert lines.drop_lines(empty).count() == 0


def test_line_keys_count_code_points(spark):
    short, long = "é" * 19, "é" * 20
    df = spark.createDataFrame([(i, f"{short}\n {long} ") for i in range(3)], "doc_id long, text string")
    assert summed(lines.drop_lines(df)) == by_sql(df, spark)
    assert [r.n_dropped for r in lines.drop_lines(df).orderBy("doc_id").collect()] == [1, 1, 0]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000))
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    first, second = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    index = lines.PerfectHash.from_bytes(lines.PerfectHash.build(first, second).to_bytes())
    assert sorted(index.slots(first, second).tolist()) == list(range(n))


# --- id files ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    own = np.array(values, np.uint64)
    assert (idfile.unpack(*idfile.pack(own), len(own)) == own).all()


def test_id_files(spark, docs, texts, tmp_path):
    ids, start, expected = plain(BYTE), 0, {}
    for doc_id in sorted(texts):
        own = np.array([*ids(texts[doc_id]), 0], "<u4")
        expected[doc_id] = (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    idfile.write(docs, f"{tmp_path}/ids", BYTE)
    got = idfile.summary(spark, f"{tmp_path}/ids").collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected
    back = idfile.read(spark, f"{tmp_path}/ids").collect()
    assert {r.doc_id: zlib.crc32(r.ids) for r in back} == {k: v[2] for k, v in expected.items()}


def test_id_files_odd(spark, odd, empty, tmp_path):
    idfile.write(odd, f"{tmp_path}/odd", BYTE)
    got = idfile.summary(spark, f"{tmp_path}/odd").orderBy("start").toPandas()
    assert len(got) == odd.count() and np.isnan(got.doc_id.iloc[0]) and (got.start.diff().dropna().values == got.n_tokens.values[:-1]).all()
    idfile.write(empty, f"{tmp_path}/none", BYTE)
    assert idfile.summary(spark, f"{tmp_path}/none").count() == 0


# --- media ---


def test_media(spark, docs, texts, tmp_path):
    stored = media.write(docs, f"{tmp_path}/m")
    got = {r.doc_id: r for r in media.summary(spark, stored).collect()}
    forms = {}
    for doc_id, text in texts.items():
        data, row = media.payload(text.encode()), got[doc_id]
        assert len(data) % 576 == 0
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        forms.setdefault(text, set()).add((row.media_bytes, row.media_sha256, row.feature))
    assert all(len(v) == 1 for v in forms.values())
    assert {r.doc_id: bytes(r.payload) for r in media.read(spark, stored).collect()} == {i: media.payload(t.encode()) for i, t in texts.items()}


def test_media_odd(spark, odd, empty, tmp_path):
    stored = media.write(odd, f"{tmp_path}/odd")
    got = media.summary(spark, stored).toPandas()
    assert len(got) == odd.count() and got.set_index("doc_id").payload_bytes.loc[4.0] == 576
    assert media.summary(spark, media.write(empty, f"{tmp_path}/none")).count() == 0


def test_changed_chunk_is_found():
    data = media.payload(b"some text " * 400)
    parts = media.chunks(data)
    import pyarrow as pa

    held = [pa.compress(b, "zstd", asbytes=True) for _, b in parts]
    row = {"key": 1, "n_bytes": 4000, "digests": b"".join(d for d, _ in parts), "lengths": [len(b) for _, b in parts], "away": [False] * len(parts), "held": held}
    assert media.rebuild(row, {})[0] == data
    row["held"] = [pa.compress(b"y" * len(parts[0][1]), "zstd", asbytes=True), *held[1:]]
    with pytest.raises(ValueError, match="differs"):
        media.rebuild(row, {})


def test_cuts_follow_the_content():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    a, b = ({d for d, _ in media.chunks(x)} for x in (data, b"new words in front" + data))
    assert len(a & b) > 0.9 * len(a) and max(len(c) for _, c in media.chunks(data)) <= media.MOST


# --- mixing ---


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]] if free else []
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_mixing(docs, texts):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(texts)
    sizes = {r.doc_id: len((texts[r.doc_id] or "").encode().split()) for r in got.itertuples()}
    assert got["size"].tolist() == [sizes[i] for i in got.doc_id]
    expected = brute_targets(got.groupby("source")["size"].sum().to_dict())
    for source, own in got.groupby("source"):
        assert own.target.iloc[0] == pytest.approx(expected[source]) and own.source_size.iloc[0] == own["size"].sum()
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert again.to_dict() == got.set_index("doc_id").taken.to_dict()


def test_rates_are_exponentially_tilted(docs):
    got = mixing.mix(docs).filter("rate > 0 AND rate < 2 AND size > 0").toPandas()
    for _, own in got.groupby("source"):
        slope = np.log(own.rate) / own["size"]
        assert slope.max() - slope.min() < 1e-9


def test_mixing_odd(spark, odd, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and (got.taken <= 2 * got["size"]).all() and got.taken[got["size"] == 0].sum() == 0
    expected = brute_targets(got["size"].groupby(got.source.where(got.source.notna(), None), dropna=False).sum().rename(index=lambda x: x if isinstance(x, str) else None).to_dict())
    for r in got.itertuples():
        assert r.target == pytest.approx(expected[r.source if isinstance(r.source, str) else None])
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == got.copies.sum()
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_a_large_cell_is_dealt_evenly(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'a b c' AS text", "IF(id < 4000, 'p', 'q') AS source")
    got = mixing.mix(df).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 3 and own.copies.max() - own.copies.min() <= 1
