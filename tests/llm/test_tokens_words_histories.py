"""Prefix tokens against the library, source divergence and history trie against plain Python, and their queries."""
from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coterie.llm import divergence, histories, prefix_tokens, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


# prefix tokens

def _texts():
    rng = random.Random(5)
    letters = "abcdefgh ijthe'sllve  \n\t é日😀0123,. ՘"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3_000)]
    return [*made, "", "<|endoftext|>", "a<|endoftext|> <|endoftext|><|endoftext|>b", "a" * 5_000, "=-" * 2_000, "日本" * 900, " " * 700, LONG,
            "x\x00y\x1c\x85 z", "<|endoftext"]


def test_prefix_tokens_equal_the_library():
    library, mine = Tokenizer.from_file(PATH), prefix_tokens.merge_tokens(PATH)
    for text in _texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids, text[:60]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_prefix_tokens_of_cut_characters_decode_as_the_library_does():
    library, mine = Tokenizer.from_file(PATH), prefix_tokens.merge_tokens(PATH)
    ids = library.encode("日本語 😀", add_special_tokens=False).ids
    for i in range(len(ids)):
        assert mine.decode(ids[i:]) == library.decode(ids[i:], skip_special_tokens=False)


def test_small_vocabulary_with_every_pair_of_merges():
    """All strings of three letters up to length 7 under random merge lists, against merging lowest rank first."""
    rng = random.Random(1)
    for _ in range(12):
        tokens = ["a", "b", "c"]
        merges = []
        while len(merges) < 9:
            pair = rng.choice(tokens), rng.choice(tokens)
            if "".join(pair) not in tokens:
                merges.append(list(pair))
                tokens.append("".join(pair))
        spec = json.load(open(PATH, encoding="utf-8"))
        spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
        spec["added_tokens"] = []
        mine = prefix_tokens.MergeTokens(spec)
        rank = {tuple(m): r for r, m in enumerate(merges)}
        for _ in range(400):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
            parts = list(word)
            while True:
                best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
                if best is None:
                    break
                parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]
            assert np.frombuffer(mine.encode(word), "<u4").tolist() == [tokens.index(p) for p in parts], (merges, word)


def test_prefix_token_table_forgets_and_other_files_are_refused():
    spec = json.load(open(PATH, encoding="utf-8"))
    small, mine = prefix_tokens.MergeTokens(spec, most_bytes=2_000), prefix_tokens.merge_tokens(PATH)
    for text in _texts()[:300]:
        assert small.encode(text) == mine.encode(text)
    assert small.held < 50_000
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"type": "WordPiece"}}):
        with pytest.raises(ValueError, match="byte-level"):
            prefix_tokens.MergeTokens(spec | change)


def test_narrative_tokens_and_query(spark, tmp_path):
    rows = [(1, "the cat"), (2, None), (3, ""), (3, ""), (None, "é<|endoftext|>"), (4, LONG)]
    frame = spark.createDataFrame(rows, "case_id long, narrative string").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    library = Tokenizer.from_file(PATH)
    got = sorted((tuple(r) for r in prefix_tokens.narrative_tokens(frame, PATH).collect()), key=str)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
    assert got == want
    assert prefix_tokens.narrative_tokens(frame.where("1 = 0"), PATH).count() == 0
    frame.select(F.col("case_id").alias("doc_id"), F.col("narrative").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_prefix_bpe(spark, str(tmp_path)).collect():
        text = dict((i, t or "") for i, t in rows)[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# source divergence

def _divergence(rows, top=200, least=3):
    docs = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        cases = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w in cases if cases[w] >= least)
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, words in mine:
            groups[s].update(w for w in words if cases[w] >= least)
        whole = sum(groups.values(), Counter())

        def share(c, w):
            return 1 + 10 ** 9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        def ranked(lang, s, part, values, most):
            order = sorted(values, key=lambda x: (-values[x], x.encode()))[:most]
            out.extend((lang, s, part, x, values[x], i + 1) for i, x in enumerate(order))

        for s, c in groups.items():
            ranked(lang, s, "pair", {o: sum((share(c, w) - share(d, w)) ** 2 // share(d, w) for w in kept) for o, d in groups.items() if o != s}, None)
            ranked(lang, s, "term", {w: (share(c, w) - share(whole, w)) ** 2 // share(whole, w) for w in kept if c[w] and share(c, w) > share(whole, w)}, top)
    return sorted(out)


def _case_texts(n=260):
    rng = random.Random(3)
    words = ["Fee", "fee", "refund", "ÀÉ", "àé", "card", "日本", "x", "chargeback", "dis-pute", "o'clock", "a1b"]
    rows = []
    for i in range(n):
        category = rng.choice(["m1"] * 6 + ["m2", "m3", "m4", "M5", "é", None, ""])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(14))), rng.choice(["en", "en", "de", None]), category))
    return [*rows, (1, None, "en", "empty"), (None, "", "fr", "a"), (3, "lonely words", "fr", "b"), (4, "x", "fr", None), rows[0], rows[0], rows[0],
            (5, LONG, "en", "m1"), (6, LONG, "en", "m2"), (7, LONG, "en", "m2"), (8, "solo solo", "it", "only"), (9, "solo", "it", "only"), (9, "solo", "it", "only")]


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "block_words": 5, "most": 2_000}, {"block": 1, "block_words": 700}])
def test_divergence_equals_plain_python(spark, sizes):
    rows = _case_texts()
    frame = spark.createDataFrame(rows, "case_id long, narrative string, language string, merchant_category string").repartition(5)
    for name in ("word", "n", "part", "item", "value", "rank", "of", "v", "size"):
        frame = frame.withColumn(name, F.lit("other"))
    got = divergence.category_divergence(frame, top=4, **sizes)
    assert got.columns == ["language", "merchant_category", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _divergence(rows, top=4)
    assert divergence.category_divergence(frame.where("1 = 0")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n = np.array([[0, 3, 10 ** 13, 8 * 10 ** 15 - 2]])
    of = np.array([[8 * 10 ** 15 - 1]])
    want = [1 + 10 ** 9 * (int(x) + 1) // int(of[0, 0]) for x in n[0]]
    assert divergence._numpy_shares(n, of)[0].tolist() == want
    frame = spark.createDataFrame([(int(x), int(of[0, 0])) for x in n[0]], "n long, of long")
    assert [r[0] for r in frame.select(divergence._share(F.col("n"), F.col("of"))).collect()] == want


def test_divergence_query_maps_the_table(spark, tmp_path):
    rows = _case_texts(60)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_source_divergence(spark, str(tmp_path))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == _divergence(rows)


# history trie

def _words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def _trie(cases):
    """cases: {case_id: [(actor, reason), ...]}."""
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, steps in cases.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(c)
            if d:
                kids[tuple(steps[:d - 1])].add(tuple(steps[:d]))
        ends[tuple(steps)].append(c)
    worth = {}
    for node in sorted(members, key=len, reverse=True):
        saved, leaves = ((len(members[node]) - 1) * _words(node[-1][1]) if node else 0), int(not kids[node])
        for k in kids[node]:
            saved, leaves = saved + worth[k][0], leaves + worth[k][1]
        worth[node] = saved, leaves
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), worth[node][1], worth[node][0],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def _histories(n=80):
    rng = random.Random(9)
    steps = [("analyst", "checked device"), ("analyst", "called  customer \n twice"), ("", "closed"), ("lead", ""), ("x", "closed"), ("analyst", "checked device x")]
    cases = {}
    for c in range(-5, n):
        kind = rng.randrange(5)
        if kind == 0:
            cases[c] = [steps[0], steps[1], steps[2]]
        elif kind == 1 and c > 0:
            source = cases[rng.choice([k for k in cases])]
            cases[c] = source[:rng.randrange(len(source) + 1)] + [rng.choice(steps) for _ in range(rng.randrange(4))]
        elif kind == 2:
            cases[c] = []
        else:
            cases[c] = [rng.choice(steps[:3]) for _ in range(rng.randrange(23))]
    return cases


def _step_rows(spark, cases):
    rows = [(c, i + 1, a, r) for c, steps in cases.items() for i, (a, r) in enumerate(steps)] + [
        (c, None, None, None) for c, steps in cases.items() if not steps]
    return spark.createDataFrame(rows, "case_id long, position long, actor string, reason string").repartition(6).select(
        "case_id", "position", histories.step_digest(F.col("actor"), F.col("reason")).alias("step"),
        histories.step_words(F.col("reason")).alias("words"), *[F.lit("other").alias(x) for x in ("a", "b", "depth", "n", "segment", "row", "last")])


@pytest.mark.parametrize("sizes", [{}, {"segment": 3, "shard_rows": 10}, {"segment": 1, "shard_rows": 1}, {"segment": 7, "shard_rows": 50}])
def test_trie_equals_plain_python(spark, sizes):
    cases = _histories()
    got = histories.history_trie(_step_rows(spark, cases), **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_trie(cases), key=str)


def test_trie_of_nothing_of_empty_cases_and_of_long_ones(spark):
    none = _step_rows(spark, {1: [("a", "b")]})
    assert histories.history_trie(none.where("1 = 0")).count() == 0
    assert histories.history_trie(none.withColumn("case_id", F.lit(None).cast("long"))).count() == 0
    for cases in ({5: [], 3: []}, {1: [("a", "long " * 5)] * 300, 2: [("a", "long " * 5)] * 299 + [("b", None)], 3: [(None, None)]}):
        got = histories.history_trie(_step_rows(spark, cases), segment=64)
        clean = {c: [(a or "", r or "") for a, r in steps] for c, steps in cases.items()}
        assert sorted(map(tuple, got.collect()), key=str) == sorted(_trie(clean), key=str)


def test_prefixes_with_equal_lanes_end_the_job(spark, monkeypatch):
    monkeypatch.setattr(histories, "NODE", histories.NODE)
    rows = _step_rows(spark, {1: [("a", "b")], 2: [("a", "c")]})
    real = F.xxhash64
    monkeypatch.setattr(histories.F, "xxhash64", lambda *c: real(*c) if c == ("step",) else F.lit(7).cast("long"))
    with pytest.raises(Exception, match="share a digest"):
        histories.history_trie(rows).collect()


def test_node_table_is_minimal_and_knows_foreign_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in "ab")
        depth = rng.integers(1, 9, n)
        table = histories.NodeTable(np.r_[a, a], np.r_[b, b], np.r_[depth, depth])
        assert sorted(table.slots(a, b, depth)) == list(range(n)) == list(range(len(table)))
        assert (table.slots(a, b, depth + 1) == -1).all() and (table.slots(b, a, depth) == -1).all()


@pytest.mark.parametrize("parts", [1, 5, 17])
def test_positions_of_cases_that_cross_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(7, rng.choice([None, *range(50)]), rng.choice("ab")) for _ in range(400)] + [(c, 1, "a") for c in range(12)] + [(3, None, None), (None, 1, "a")]
    frame = spark.createDataFrame(rows, "case_id long, turn long, row string").withColumn("position", F.lit("old")).repartition(4)
    got = histories.number_steps(frame, ["turn", "row"], parts).collect()
    cases = defaultdict(list)
    for c, t, r in rows:
        if c is not None:
            cases[c].append((t is not None, t or 0, r is not None, r or ""))
    want = sorted((c, p + 1, *step) for c, steps in cases.items() for p, step in enumerate(sorted(steps)))
    assert sorted((g["case_id"], g["position"], g["turn"] is not None, g["turn"] or 0, g["row"] is not None, g["row"] or "") for g in got) == want


def test_conversation_query(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 70), 85, 101, 103, 107, -3, -20]:
        for turn in range(rng.randrange(1, 4) if c % 20 == 0 else rng.randrange(1, 7)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, rng.choice(["user", None, "bot"]), rng.choice(["hi", "", None, "a  b c", "hi there"])))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    cases = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = int(c - np.fmod(c, 20))
        cases[c] = turns.get(head, [])[:h] + mine[h:]
    assert any(not steps for steps in cases.values())
    got = queries.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_trie(cases), key=str)
