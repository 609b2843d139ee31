"""Operators whose results are exact: archives, recipes, packing, byte-level BPE, top-k search, near duplicates."""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coterie.llm import exchanges, near, neighbours, packing, recipes, transducer
from coterie.operators import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "alpha beta gamma delta"), (2, "alpha  beta\ngamma delta"), (3, None), (4, ""), (5, " \t\n"), (6, "ab"), (6, "ab"), (7, LONG),
    (8, LONG + " tail"), (9, "日本語 text ümlaut 😀"), (None, "alpha beta gamma delta"), (None, None), (10, "İstanbul a\x1cb \xa0 c"),
]


def narratives(spark, rows=TEXTS):
    """With extra columns whose names the operators use inside."""
    made = spark.createDataFrame(rows, "case_id long, narrative string").repartition(3)
    for name in ("id", "row", "n", "rep", "bucket", "salt", "block", "length", "digest", "key"):
        made = made.withColumn(name, F.lit("other"))
    return made


def empty(frame):
    return frame.where("1 = 0")


# exchanges

BODIES = [
    (1, "u", "<p>a</p>"), (2, "u\r\nv", "<p>a</p>"), (3, None, None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "u", "\r\n"), (7, "u", "é" * 50_000), (7, "u", "é" * 50_000), (None, "u", "<p>b</p>"), (8, "u", "<p>b</p>"),
]


def _archive(spark, path, rows, **options):
    made = spark.createDataFrame(rows, "order_id long, endpoint string, response_body string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(0))
    exchanges.write_archive(made, str(path), **options)
    return exchanges.assemble_captures(exchanges.read_records(spark, str(path), with_payload=True)).collect()


def test_archive_round_trip(spark, tmp_path):
    got = _archive(spark, tmp_path / "a", BODIES)
    assert len(got) == len(BODIES)
    firsts = {}
    for i, _, body in sorted(BODIES, key=lambda r: (r[0] is None, r[0] or 0)):
        firsts.setdefault(body or "", i)
    bodies = defaultdict(list)
    for i, _, body in BODIES:
        bodies[i].append(body or "")
    for r in got:
        i = None if r["order_id"] is None else int(r["order_id"])
        body = bodies[i][0]
        raw = body.encode()
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if firsts[body] == i:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", str(firsts[body]), None)
        assert len(r["requests"]) == len(r["metadata"]) == 1


def test_archive_small_bodies_and_empty_table(spark, tmp_path):
    got = _archive(spark, tmp_path / "b", BODIES, min_revisit_bytes=100)
    assert Counter(r["record_type"] for r in got)["revisit"] == 0  # the only large copies have the smallest id both
    assert _archive(spark, tmp_path / "c", BODIES[:1] * 0) == []


def test_assembly_follows_indirect_and_reverse_links(spark):
    rows = [
        ("m", "response", ["q"], "1"), ("q", "request", [], None), ("t", "metadata", ["q"], None), ("lost", "metadata", ["nowhere"], None),
        (None, "request", [], None), ("m2", "revisit", [], "2"),
    ]
    made = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>, order_id string")
    for name, kind in (("endpoint", "string"), ("refers_to", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary"), ("fields", "map<string,string>")):
        made = made.withColumn(name, F.lit(None).cast(kind))
    got = {r["capture_id"]: r for r in exchanges.assemble_captures(made).collect()}
    assert len(got["m"]["requests"]) == 1 and len(got["m"]["metadata"]) == 1
    assert got["m2"]["record_type"] == "revisit" and got["nowhere"]["record_type"] is None
    assert len(got) == 4


def test_assembly_follows_chains_and_every_identifier(spark):
    """Each of c, b, a, q names the next up to the response; others name a missing record first, or only each other."""
    rows = [("m", "response", [], "1"), ("q", "request", ["m"], None), ("a", "metadata", ["q"], None), ("b", "metadata", ["a"], None), ("c", "request", ["b"], None),
            ("d", "metadata", ["gone", "m"], None), ("e", "metadata", ["gone", "c"], None), ("x", "request", ["y"], None), ("y", "metadata", ["x"], None),
            ("n", "resource", ["z"], "2"), ("z", "metadata", [], None), ("w", "metadata", ["z"], None)]
    made = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>, order_id string")
    for name, kind in (("endpoint", "string"), ("refers_to", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary"), ("fields", "map<string,string>")):
        made = made.withColumn(name, F.lit(None).cast(kind))
    got = {r["capture_id"]: (sorted(x["record_id"] for x in r["requests"]), sorted(x["record_id"] for x in r["metadata"]))
           for r in exchanges.assemble_captures(made).collect()}
    assert got == {"m": (["c", "q"], ["a", "b", "d", "e"]), "n": ([], ["w", "z"]), "x": (["x"], ["y"])}


# recipes


@pytest.mark.parametrize("key_bytes", [16, 1])
def test_exact_duplicates(spark, key_bytes):
    """Short identifiers collide, and still nothing is confused."""
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t in TEXTS:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[plain])[2]
        want[i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()] += 1
    assert Counter(map(tuple, recipes.exact_duplicates(narratives(spark), key_bytes).collect())) == want
    assert recipes.exact_duplicates(empty(narratives(spark)), key_bytes).count() == 0


def test_cut_points_depend_on_content_only():
    random = np.random.default_rng(1)
    data = random.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    ends = recipes.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= 8192 for a, b in zip([0, *ends], ends))
    shifted = {e - 37 for e in recipes.cut_points(b"x" * 37 + data)}
    assert len(shifted & set(ends)) > len(ends) * 0.8


# packing


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    capacity = 64
    got = packing.pack_narratives(narratives(spark), path, capacity, with_ids=True).collect()
    whole = {}
    for i, t in TEXTS:
        whole[i, t] = library.encode(t or "", add_special_tokens=False).ids + [1]
    want = Counter()
    for i, t in TEXTS:
        ids = whole[i, t]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            own = ids[lo:lo + capacity]
            want[i, k, lo, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["case_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    _check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    assert packing.pack_narratives(empty(narratives(spark)), path).count() == 0


def _check_sequences(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_in_few_sequences(seed):
    random = np.random.default_rng(seed)
    lengths = np.minimum(random.lognormal(5 + seed / 2, 1.2, 3_000).astype(int) + 1, 1024)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan, sequences = packing.pack_plan(histogram, 1024)
    rows, used = [], Counter()
    for length, lo, hi, sequence, offset in plan.tolist():
        assert lo == used[length]
        used[length] = hi
        rows += [(sequence + r, offset, length) for r in range(hi - lo)]
    assert used == histogram
    assert _check_sequences(rows, 1024) == sequences
    assert sequences <= 1.01 * max(lengths.sum() / 1024, (lengths > 512).sum()) + 1


# byte-level BPE


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_transducer_equals_the_library(name):
    ranks = transducer.read_ranks(public_tokenizers.path(name))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = transducer.TextEncoder(ranks, public_tokenizers.PATTERN)
    random = np.random.default_rng(7)
    parts = ["a", "aa", "b", "ab", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "日本", "😀", "1", "23", "!", "...", "the", "ing", "'s", "'ll", "\x1c", "\xa0", "\x85",
             "　", "A", "THE", "-", "==", "\0"]
    texts = ["".join(random.choice(parts, random.integers(0, 40))) for _ in range(3_000)] + ["a" * 5_000, "=" * 999, LONG]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_transducer_forgets_and_still_agrees():
    ranks = transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    small, large = transducer.Transducer(ranks, most_states=20), transducer.Transducer(ranks)
    for w in ("internationalisation", "unbelievably", "xxxxxyyyyxxx", "tionationations") * 3:
        assert small.encode(w.encode()) == large.encode(w.encode())


def test_encoding_of_narratives(spark):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    full = transducer.encode_narratives(narratives(spark), *args).collect()
    assert Counter((r["case_id"], r["decoded"]) for r in full) == Counter((i, t or "") for i, t in TEXTS)
    digests = transducer.encoding_digests(narratives(spark), *args).collect()
    want = Counter((r["case_id"], len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in full)
    assert Counter(map(tuple, digests)) == want
    assert transducer.encoding_digests(empty(narratives(spark)), *args).count() == 0


def test_digests_come_through_the_stream_decoder():
    """Pieces of one token each cut characters in the middle; the text is whole all the same."""
    enc = transducer.TextEncoder(transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for text in ("", "naïve 🦊🦊 日本語 \ud7ff\U0010ffff end", "🏴" * 50):
        ids = enc.encode(text)
        for step in (1, 3, 1 << 16):
            pieces = list(enc.decoded(ids, step))
            assert "".join(pieces) == text and len(pieces) == -(-(len(ids) // 4) // step)


def test_stream_decoder_keeps_unfinished_characters():
    decoder = transducer.StreamDecoder({0: b"\xf0\x9f", 1: b"\x98", 2: b"\x80!", 3: b"\xc3"})
    assert [decoder.feed([0]), decoder.feed([1]), decoder.feed([2]), decoder.feed([3], last=True)] == ["", "", "😀!", "�"]


# top-k search


def _brute(rows, queries, k):
    usable = {}
    for i, x in rows:
        if i is not None and x is not None and len(x) == 8 and all(v is not None and np.isfinite(v) for v in x):
            usable[i] = max(usable.get(i, x), x)
    out = set()
    for q in queries:
        if q in usable:
            scored = sorted((-float(np.dot(usable[q], x)), i) for i, x in usable.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block_rows", [16, 4_096])
def test_nearest_orders(spark, block_rows):
    """A third of the rows share one vector, others are in clusters; ties, nulls, other lengths and repeated ids."""
    random = np.random.default_rng(3)
    centres = random.integers(-40, 40, (6, 8))
    rows = [(i, [float(v) for v in (centres[i % 6] + random.integers(-4, 5, 8))]) for i in range(200)]
    rows += [(1_000 + i, [3.0] * 8) for i in range(100)]
    rows += [(2_000, None), (2_001, [1.0, None] + [0.0] * 6), (2_002, [float("nan")] * 8), (2_003, [float("inf")] * 8), (2_004, [1.0]),
             (None, [1.0] * 8), (5, rows[5][1]), (2_005, [])]
    made = spark.createDataFrame(rows, "order_id long, features array<double>").withColumn("block", F.lit(1)).withColumn("x", F.lit(1))
    asked = made.where("order_id % 50 = 0")
    got = neighbours.nearest_orders(made, asked, 5, block_rows=block_rows, most_pivots=8)
    want = _brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_nearest_orders_of_few_and_none(spark):
    made = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "order_id long, features array<double>")
    assert [tuple(r) for r in neighbours.nearest_orders(made, made, 5).orderBy("query_id").collect()] == [(1, 1, 2, 4.0), (2, 1, 1, 4.0)]
    assert neighbours.nearest_orders(made, empty(made), 5).count() == 0
    assert neighbours.nearest_orders(empty(made), empty(made), 5).count() == 0


# near duplicates


def _groups(rows, words, percent):
    sets = defaultdict(set)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] |= {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    ids = sorted(sets, key=lambda i: (i is None, i or 0))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i or 0))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    """A chain of edits, a large group of near copies of one base, exact copies, and pairs around the threshold."""
    random = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(500)]
    base = list(random.choice(vocabulary, 120))
    rows = [r for r in TEXTS if r[0] is not None]
    for i in range(80):
        own = list(base)
        for p in random.integers(0, len(own), random.integers(0, 7)):
            own[p] = random.choice(vocabulary)
        rows.append((100 + i, " ".join(own)))
    chain = list(random.choice(vocabulary, 100))
    for i in range(25):
        chain[(7 * i) % 100] = f"c{i}"
        rows.append((300 - i, " ".join(chain).upper() if i % 2 else " ".join(chain)))
    rows += [(400 + i, rows[-1][1]) for i in range(20)]
    got = near.near_duplicates(narratives(spark, rows), words, percent).collect()
    want = _groups(rows, words, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["case_id"]]
        assert r["kept"] == (r["case_id"] == r["component_id"])
    assert near.near_duplicates(empty(narratives(spark)), words, percent).count() == 0


def test_near_duplicates_null_ids(spark):
    got = near.near_duplicates(narratives(spark, [(None, "a b c d"), (3, "a b c d"), (None, "x y z u"), (None, None)]), 3, 85).collect()
    assert Counter((r["case_id"], r["component_id"], r["kept"]) for r in got) == Counter({(None, 3, False): 1, (3, 3, True): 1, (None, None, True): 2})


def test_near_duplicates_link_rows_by_their_texts(spark):
    """A null id with a near copy, and an id on two texts: links are those of the texts, whatever the ids."""
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(f"o{i}" for i in range(60))
    rows = [(None, text), (2, text + " more"), (5, text + " x"), (5, other), (6, other + " y"), (None, other + " z"), (None, "lone text of a null id"),
            (7, "w" * 100_000), (8, "w" * 100_000 + " v"), (7, "w" * 100_000)]
    got = near.near_duplicates(narratives(spark, rows), 3, 85).collect()
    assert Counter((r["case_id"], r["component_id"], r["kept"]) for r in got) == Counter({
        (None, 2, False): 1, (2, 2, True): 1, (5, 2, False): 1, (5, 5, True): 1, (6, 5, False): 1, (None, 5, False): 1, (None, None, True): 1,
        (7, 7, True): 2, (8, 8, True): 1})


def test_long_words_are_not_remembered():
    shingles = near.Shingler(2)
    first = shingles(b"a " + b"x" * 1_000 + b" b")
    assert (first == shingles(b"A " + b"X" * 1_000 + b" B")).all() and all(len(w) <= near.LONGEST_KEPT for w in shingles.kept)


def test_union_of_a_long_path(spark):
    edges = spark.range(1, 1_000).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(5_000, 6_000)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components.union_groups(edges).collect()}
    assert got == {i: 1 for i in range(1, 1_001)} | {5_000: 5_000, 6_000: 5_000}


def test_signatures_estimate_with_less_variance():
    random = np.random.default_rng(4)
    for size in (24, 400):
        close = []
        for _ in range(80):
            x = random.integers(0, 1 << 63, size, dtype=np.uint64)
            y = x.copy()
            y[:size // 8] = random.integers(0, 1 << 63, size // 8, dtype=np.uint64)
            s = near.super_minhash([x, y], 120)
            close.append((s[0] == s[1]).mean())
        true = (size - size // 8) / (size + size // 8)
        assert abs(np.mean(close) - true) < 0.02
        assert np.std(close) < 1.1 * np.sqrt(true * (1 - true) / 120)
