"""Archives, tokenizer alignment and manifests, held against plain Python and SQL."""

import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from hitfold.llm import align, merkle, warc

BYTE, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clean(value):
    return None if value is None or value is pd.NA or isinstance(value, float) and np.isnan(value) else value


# --- WARC ---

PAGES = "page_id long, url string, html string, status string, payload string"
LONG = "é漢" * 40_000


@pytest.fixture(scope="module")
def pages(spark):
    twice = "<p>" + "again " * 50
    rows = [
        (5, "http://a/5", twice), (3, "http://a/3", twice), (9, None, twice), (None, "http://a/none", twice), (3, "http://a/3b", twice),
        (1, "http://a/1", None), (2, "http://a/\r\nX-Evil: 1", ""), (4, "http://a/4", "short"), (6, "http://a/6", "short"),
        (7, "http://a/7", LONG), (8, "http://a/8", LONG), (10, "http://a/10", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n" * 900),
        (11, "http://a/11", "\r\n\r\n" * 7000), (12, "http://a/12", "x" * warc.CHUNK), (None, None, "y" * 20_000), (None, None, "y" * 20_000),
    ]
    return spark.createDataFrame([(*r, "s", "p") for r in rows], PAGES)


def expected_pages(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            least[data] = min(page, least.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        again = first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None))
    return Counter(out)


@pytest.mark.parametrize("segment", [warc.SEGMENT, 1000])
def test_pages_come_back(spark, pages, tmp_path, segment):
    warc.write(pages, f"{tmp_path}/w", segment=segment)
    got = warc.read(spark, f"{tmp_path}/w", keep=True).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    assert Counter(tuple(r[c] for c in columns) for r in got) == expected_pages(rows)
    kept = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id}
    assert kept[7] == LONG.encode() and kept[11] == b"\r\n\r\n" * 7000 and kept[1] == b""
    assert {r.target_uri for r in got if r.page_id == 2} == {"http://a/%0D%0AX-Evil: 1"}


def archive(folder, name, records):
    """A file of given (headers, block), each with its length."""
    text = b""
    for headers, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": headers.get("Content-Length", len(block))}.items())
        text += b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    Path(folder, name).write_bytes(gzip.compress(text) if name.endswith(".gz") else text)


def plain_block(payload):
    return b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def split_record(record, payload, sizes, page=1, total=None, skip=()):
    block, at, out = plain_block(payload), 0, []
    for k, size in enumerate(sizes, 1):
        piece = block[at:] if k == len(sizes) else block[at : at + size]
        at += size
        headers = {"WARC-Type": "continuation" if k > 1 else "response", "WARC-Record-ID": record if k == 1 else f"{record}-{k}", "WARC-Segment-Number": k}
        headers |= {"WARC-Segment-Origin-ID": record} if k > 1 else {"Page-ID": page, "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
        headers |= {"WARC-Segment-Total-Length": len(block) if total is None else total} if k == len(sizes) else {}
        if k not in skip:
            out.append((headers, piece))
    return out


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_segments_over_files_and_what_is_broken(spark, tmp_path, suffix):
    payload = bytes(range(256)) * 30
    whole = split_record("<a>", payload, [100, 3000, 50, 0], page=1)
    archive(tmp_path, f"1{suffix}", [whole[2], whole[0]])
    archive(tmp_path, f"2{suffix}", [whole[3], whole[1], *split_record("<b>", payload, [10, 10, 0], page=2, skip=(2,))])
    archive(tmp_path, f"3{suffix}", [*split_record("<c>", payload, [10, 0], page=3, total=5), *split_record("<d>", payload, [10, 10, 0], page=4, skip=(1,))])
    reply = {"WARC-Type": "response", "WARC-Record-ID": "<e>", "Page-ID": 5, "WARC-Payload-Digest": "sha256:00"}
    archive(tmp_path, f"4{suffix}", [(reply, plain_block(b"x")), ({**reply, "WARC-Record-ID": "<f>", "Page-ID": 6}, b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")])
    archive(tmp_path, f"5{suffix}", [({"WARC-Type": "warcinfo"}, b"about"), ({"WARC-Type": "revisit", "WARC-Refers-To": "<none>", "Page-ID": 7}, b""), ({**reply, "Page-ID": 8, "Content-Length": 999}, b"cut")])
    got = warc.read(spark, str(tmp_path), keep=True).collect()
    assert {r.page_id: r.problem for r in got if r.page_id} == {
        1: None, 2: "missing segment", 3: "length differs", 5: "digest differs", 6: "broken chunks", 7: "no such response"
    }
    assert Counter(r.problem for r in got if r.page_id is None) == Counter(["missing segment", "cut off"])
    assert next(bytes(r.payload) for r in got if r.page_id == 1) == payload


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6), st.integers(1, 7))
def test_records_do_not_depend_on_the_pieces(blocks, step):
    text = b"".join(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in blocks)
    reader = warc.Records()
    found = [x for i in range(0, len(text), step) for x in reader.feed(text[i : i + step])]
    assert [b for _, b, _ in found] == blocks and not reader.rest()


def test_junk_between_records():
    reader, record = warc.Records(), b"WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    found = list(reader.feed(b"junk\r\n" + record + b"more\n" + record))
    assert [p for _, _, p in found] == ["not a record", None, "not a record", None]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), max_size=5))
def test_chunks_are_undone(parts):
    body = b"".join(b"%X;x=1\r\n%b\r\n" % (len(p), p) for p in parts)
    assert warc.unchunked(body + b"0\r\n\r\n") == (b"".join(parts), True)
    assert warc.unchunked(body)[1] is False


def test_hot_keys_join_whole(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(600)] + [(None, 600), ("gone", 601)], "k string, i long")
    held = rows.filter("k <> 'gone'").groupBy("k").agg(F.count(F.lit(1)).alias("times"), F.concat(F.lit("v"), "k").alias("v"))
    got = {r.i: r.v for r in warc.join_counted(rows, held, "k", 600).collect()}
    assert got == {i: (f"v{k}" if k and k != "gone" else None) for k, i in rows.collect()}


def test_no_pages(spark, pages, tmp_path):
    warc.write(pages.limit(0), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0


def test_archive_query_is_its_sql(spark):
    got = warc.op11_warc_segments(spark, SF).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = duck.execute(warc.ORACLE["op11_warc_segments"]).fetchdf()
    key = lambda x: sorted(tuple(map(clean, r)) for r in x[sorted(x.columns)].itertuples(index=False))
    assert list(map(str, key(got))) == list(map(str, key(want)))


# --- alignment ---


def brute_alignment(rows):
    """Per row of (doc_id, text): the digest columns, by plain lists of all links."""
    left = Tokenizer.from_file(BYTE)
    left.encode_special_tokens = True
    right, own = SentencePieceProcessor(model_file=PIECE), align.aligner(BYTE, PIECE)
    found, often = [], Counter()
    for doc_id, text in rows:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spelled = [b"".join(table[i] for i in ids) for table, ids in ((own.bytes_a, a), (own.bytes_b, b))]
        if text and spelled != [(" " + text).encode()] * 2:
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((own.bytes_a, a), (own.bytes_b, b)))
        common = sorted(set(ends_a) & set(ends_b))
        sides = defaultdict(lambda: ([], []))
        for k, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, end in zip(ids, ends, strict=True):
                sides[bisect_left(common, end)][k].append(i)
        groups = [sides[k] for k in range(len(common))]
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        often.update(links.keys())
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        found.append((doc_id, len(a), len(b), groups, links, sha(text) if groups else ""))
    top = defaultdict(int)
    for (a, _), n in often.items():
        top[a] = max(top[a], n)
    return [
        (doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if often[p] == top[p[0]]), sum(n * often[p] for p, n in links.items()), digest)
        for doc_id, n_a, n_b, groups, links, digest in found
    ]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("windows", [align.BLOCK_WINDOWS, 500])
def test_alignment_is_that_of_all_links(spark, docs, texts, monkeypatch, windows):
    monkeypatch.setattr(align, "BLOCK_WINDOWS", windows)
    monkeypatch.setattr(align, "MEMO", windows)
    got = align.align(docs, BYTE, PIECE).collect()
    assert sorted(tuple(r[c] for c in ALIGNED) for r in got) == sorted(brute_alignment(texts.items()))


def test_alignment_of_odd_rows(spark, odd, empty):
    more = spark.createDataFrame([(20, "a  b\n\nc <|endoftext|> </s>"), (21, " lead"), (22, "u▁v"), (23, "\n"), (24, "漢字かな交じり文です"), (25, "é́ﬁ\x00"), (26, "end ")], "doc_id long, text string")
    table = odd.unionByName(more, allowMissingColumns=True)
    got = Counter(tuple(r[c] for c in ALIGNED) for r in align.align(table, BYTE, PIECE).collect())
    assert got == Counter(brute_alignment([(r.doc_id, r.text) for r in table.collect()]))
    assert align.align(empty, BYTE, PIECE).count() == 0
    assert {x[0] for x in got if x[1] == 0} >= {4, 5, 22}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "é", " ", "\n", "\t", ".", "'s", "1", "中", "<|endoftext|>", "don't", "x" * 30]), min_size=1, max_size=15))
def test_windows_give_the_groups_of_the_whole(parts):
    text, own = "".join(parts), align.aligner(BYTE, PIECE)
    assert own.a.encode(text) == own.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    left, right = own.tokens([text, None, text])
    ids = lambda x: np.frombuffer(x, "<u4").tolist()
    assert ids(right[0]) in ([], own.b.model.encode(text))
    whole = list(own.groups(left[0], ids(right[0])))
    for i, windows in enumerate(own.windows(left, right)):
        sides = [ids(w) for w in windows]
        cut = [(x[: x.index(align.Windows.MARK)], x[x.index(align.Windows.MARK) + 1 :]) for x in sides]
        assert [g for a, b in cut for g in own.groups(a, b)] == ([] if i == 1 else whole)


def test_groups_as_rows(spark):
    rows = align.alignments(spark.createDataFrame([(1, "Hello unbelievable world"), (2, None)], "doc_id long, text string"), BYTE, PIECE).collect()
    assert rows[0].start == 0 and [r.start for r in rows[1:]] == [r.stop for r in rows[:-1]] and rows[-1].stop == len(" Hello unbelievable world")
    assert {r.doc_id for r in rows} == {1}


# --- manifest ---


def enc(value):
    text = None if value is None else str(value)
    return "-" if text is None else f"{len(text.encode())}:{text}"


def brute_manifest(rows, run):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows by recursion over plain lists."""

    def tree(nodes):
        """The top, and for each leaf its siblings level by level as (left, right)."""
        paths, levels = [[] for _ in nodes], nodes
        at = list(range(len(nodes)))
        while len(levels) > 1:
            for i in range(len(nodes)):
                first = at[i] // run * run
                paths[i].append((levels[first : at[i]], levels[at[i] + 1 : first + run]))
                at[i] //= run
            levels = [sha("".join(levels[k : k + run])) for k in range(0, len(levels), run)]
        return levels[0], paths

    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: sha("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    by = defaultdict(list)
    for r in rows:
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        by[r.source].append((r.doc_id, leaf(r, r.text), leaf(r, lower(r.text)) if bad else leaf(r, r.text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in order}
    root, crown = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (doc_id, own, now), path in zip(by[s], trees[s][1], strict=True):
            seen = ""
            for left, right in [*path, *crown[k]]:
                now = sha("".join(left) + now + "".join(right))
                seen += "".join(left + right)
            out.append((doc_id, own, trees[s][0], root, sha(seen), now, now == root))
    return Counter(out)


PROVED = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("run", [16, 2])
def test_manifest_is_that_of_plain_lists(spark, docs, odd, tmp_path, monkeypatch, run):
    monkeypatch.setattr(merkle, "RUN", run)
    monkeypatch.setattr(merkle, "BLOCK", run**merkle.DEPTH)
    monkeypatch.setattr(merkle, "SPAN", run * merkle.HEX)
    table = docs.unionByName(odd.select(*docs.columns))
    got = Counter(tuple(r[c] for c in PROVED) for r in merkle.verify(table, f"{tmp_path}/m").collect())
    assert got == brute_manifest(table.collect(), run)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, odd, empty, tmp_path):
    one = merkle.verify(odd.filter("doc_id = 1"), f"{tmp_path}/one").collect()
    assert [(r.leaf == r.subroot, r.proof_sha256) for r in one] == [(True, sha(""))]
    assert one[0].root == one[0].leaf
    assert merkle.verify(empty, f"{tmp_path}/none").count() == 0


def test_manifest_query_is_its_sql(spark):
    got = merkle.op13_merkle_manifest(spark, SF).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(merkle.ORACLE["op13_merkle_manifest"]).fetchdf()
    key = lambda x: sorted(map(tuple, x[list(PROVED)].itertuples(index=False)))
    assert key(got) == key(want)
