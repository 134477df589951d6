"""Shared-term search, token pair alignment and the multi-index against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from tablemodels.llm import multi_index, shared_search, token_pairs, tokens

DOCS = "doc_id long, text string, n int, key string, item int, shard int, a int, place int"


def docs(spark, rows):
    """A table with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, 5) for i, t in rows], DOCS).repartition(3)


def clean(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- shared-term search


def plain_terms(text):
    lower = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(items, rows, k):
    held = [(d, Counter(plain_terms(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // length
            score = sum(
                shared_search.term_weight(n_docs, df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def search_rows(seed, n, vocabulary=60, most=30):
    r = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"Wé{i}" for i in range(vocabulary)]
    return [
        (r.choice([i, i, i, None, 7]), r.choice([None, "", " .,- \x1c\x7f"]) if r.random() < 0.1 else
         r.choice([" ", ", ", "\n"]).join(r.choices(words, k=r.randint(1, most))))
        for i in range(n)
    ]


@pytest.mark.parametrize("block_terms", [50_000, 40])
def test_search_gives_the_scores_of_every_pair(spark, block_terms):
    rows = search_rows(1, 150) + [(900, "w1 " * 50_000), (901, "w1 w2"), (901, "w1 w2"), (None, "w1 w2")]
    items = search_rows(2, 25, most=12) + [(5, None), (None, "w1 W2 w1"), (6, "nowhere to be found"), (7, "!?")] * 2
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, terms string")
    got = shared_search.search(table, docs(spark, rows), k=4, block_terms=block_terms)
    assert clean(got.collect()) == clean(plain_search(items, rows, 4))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert shared_search.search(none, docs(spark, [(1, "w1")]), 3).count() == 0
    assert shared_search.search(one, docs(spark, [(1, "w1")]).limit(0), 3).count() == 0
    assert shared_search.search(one, docs(spark, [(1, None), (2, "..")]), 3).count() == 0


def test_graph_shares_sums_and_keeps_them():
    r = random.Random(3)
    common = [[0, 1, 2, 3], [4, 5, 6], [7, 8]]
    sets = {tuple(sorted({t for c in r.sample(common, r.randint(1, 3)) for t in c} | set(r.sample(range(9, 40), 4)))) for _ in range(60)}
    sets = [list(s) for s in sets]
    number = {t: i for i, t in enumerate(sorted({t for s in sets for t in s}))}
    sets = [[number[t] for t in s] for s in sets]
    graph = shared_search.shared_graph(sets)
    parts = np.random.default_rng(0).integers(0, 10**9, (len(number), 50))
    assert (graph.scores(parts) == np.array([parts[s].sum(axis=0) for s in sets])).all()
    assert graph.levels and graph.n_atoms < len(number)
    sums = len(graph.term_order) - graph.n_atoms + (graph.n_nodes - graph.n_atoms) + len(graph.refs) - len(sets)
    assert sums < 0.7 * sum(len(s) - 1 for s in sets)  # additions a document, shared and not


def test_search_query_agrees_with_sql(spark, sf, duck):
    got = entry.queries()["op11_shared_term_search"](spark, sf)
    assert compare.difference(got, duck, entry.oracle_sql()["op11_shared_term_search"]) is None


# ---- token pairs


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))
    printed = {}
    n = 0
    for byte in range(256):  # the usual order: visible bytes stand for themselves
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            printed[chr(byte)] = byte
        else:
            printed[chr(256 + n)] = byte
            n += 1
    spelt = {i: bytes(printed[c] for c in s) if set(s) <= set(printed) else b"" for s, i in a.get_vocab().items()}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def plain(text):
        """(ids a, ids b, groups) from the libraries on the whole text."""
        if not text:
            return [], [], []
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(spelt[i] for i in ids_a) != whole or b"".join(map(b_bytes, ids_b)) != whole:
            return [], [], []
        ends_a = np.cumsum([len(spelt[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(b_bytes(i)) for i in ids_b]).tolist()
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= cut], [i for i, e in zip(ids_b, ends_b) if start < e <= cut]))
            start = cut
        return ids_a, ids_b, groups

    return plain


def plain_alignment(rows, plain):
    each = [(i, *plain(t)) for i, t in rows]
    links = [[(a, b) for ga, gb in groups for a in ga for b in gb] for *_, groups in each]
    count = Counter(p for pairs in links for p in set(pairs))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, a, b, groups), pairs in zip(each, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(pairs), sum(count[p] == most[p[0]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


PARTS = ["a", "the", "house", " ", " ", " ", "  ", "\n", "\t", " \n", "don't", "1", "2024", "é", "ß", "中", "文", "́", "🙂", ".", "...", "(", "</s>",
         "<|endoftext|>", "<0x41>", "▁", "\x00", "\x1c", "\xa0", "　", "ﬁ", "①", "﻿", "\r\n", "InternationalizAtion", "x" * 70]


def random_texts(seed, n, parts=PARTS):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


def printed(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


@pytest.mark.parametrize("wide", [10_000, 2])
def test_slices_are_aligned_as_whole_texts_are(both, monkeypatch, wide):
    monkeypatch.setattr(token_pairs, "WIDE_LINKS", wide)
    aligner = token_pairs.PairAligner(*map(tokens.public_path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    parts = [p for p in PARTS if p not in ("▁",)]
    texts = [t for t in random_texts(1, 1200, parts) + random_texts(2, 400) if t]
    cut = [list(token_pairs.slices(t, 20)) for t in texts]
    found = aligner.align([p for c in cut for p in c])
    at = sound = 0
    for text, c in zip(texts, cut):
        mine = range(at, at + len(c))
        at += len(c)
        a, b, groups = both(text)
        whole = all(found.printed[i] is not None for i in mine)
        assert (";".join(found.printed[i] for i in mine) if whole else "") == printed(groups), repr(text)
        if whole:
            sound += 1
            assert found.sums[mine].sum(axis=0).tolist() == [len(a), len(b), len(groups), sum(len(x) * len(y) for x, y in groups)]
            links = Counter(x << 32 | y for ga, gb in groups for x in ga for y in gb)
            got = Counter()
            for i in np.flatnonzero((found.text >= mine[0]) & (found.text <= mine[-1])):
                got[int(found.keys[i])] += int(found.times[i])
            assert got == links
    assert sound > 1000


def test_merges_by_rank_give_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    direct.encode_special_tokens = True
    fast, r = tokens.RankEncoder(tokens.public_path("byte_bpe_50k.json")), random.Random(4)
    parts = PARTS + ["'s", "'", "'ll", "²", "Ⅷ", "\u0301", "\u200b", "\u2028", "\x85", "ǅ", "_", "İ", "\U00010400", " 's", "x's", "٣"]
    texts = ["", "x" * 300, " " * 50, "a" * 50_000, " " * 50_000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(0x250), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(2000)]
    for text in texts:
        assert fast.ids(text) == direct.encode(text, add_special_tokens=False).ids, repr(text)


def test_bitmaps_and_planes_round_trip():
    rng = np.random.default_rng(0)
    for size in (1, 2, 50, 3000, 65_536):
        places = np.sort(rng.choice(65_536, size, replace=False))
        assert (token_pairs.unpack_places(token_pairs.pack_places(places)) == places).all()
        for top in (1, 2, 9, 10**12):
            times = rng.integers(1, top + 1, size)
            assert (token_pairs.unpack_planes(token_pairs.pack_planes(times), size) == times).all()


@pytest.mark.parametrize("shard_docs, shard_postings", [(4096, 3_000_000), (7, 3_000_000), (4096, 50)])
def test_alignment_counts_over_the_whole_table(spark, both, shard_docs, shard_postings):
    texts = random_texts(5, 120) + [None, "", " ", "  ", "a▁b", "the the the house", "the the the house", "the house " * 3000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, "the house")]
    got = token_pairs.align(docs(spark, rows), "byte_bpe_50k.json", "piece_bpe_32k.model", shard_docs, shard_postings)
    assert clean(got.collect()) == clean(plain_alignment(rows, both))


def test_long_texts_are_aligned_in_slices(spark, both, monkeypatch):
    monkeypatch.setattr(token_pairs, "CHUNK_CHARS", 500)
    rows = [(1, "some words, and 12 more. " * 200), (2, "x" * 3000), (3, "bad ▁ words " * 200), (4, "some words")]
    got = token_pairs.align(docs(spark, rows), "byte_bpe_50k.json", "piece_bpe_32k.model")
    assert clean(got.collect()) == clean(plain_alignment(rows, both))


def test_alignment_of_an_empty_table(spark):
    assert token_pairs.align(docs(spark, [(1, "a")]).limit(0), "byte_bpe_50k.json", "piece_bpe_32k.model").count() == 0


def test_alignment_query_against_the_libraries(spark, sf, both):
    got = entry.queries()["op12_pair_bitmap_alignment"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert clean(got.select(names).collect()) == clean(plain_alignment(rows, both))


# ---- multi-index


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", 2) for i, v in rows], "id long, v array<double>, q int, cells string, part int").repartition(3)


def plain_nearest(queries, rows, k):
    out = []
    for i, q in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in rows if j != i)
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d[:k])]
    return out


def test_walk_meets_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        d1, d2 = rng.integers(0, 6, 7).astype(float), rng.integers(0, 6, 5).astype(float)
        counts = rng.integers(0, 4, 35)
        for target in (1, 10, 10**6):
            met = multi_index.walk(d1, d2, counts, target)
            sums = [d1[c // 5] + d2[c % 5] for c in met]
            assert sums == sorted(sums) and len(set(met)) == len(met) and all(counts[c] for c in met)
            assert counts[met].sum() >= min(target, counts.sum())
            left = [d1[c // 5] + d2[c % 5] for c in range(35) if counts[c] and c not in met]
            assert not left or min(left) >= max(sums, default=0)
            assert not met or counts[met[:-1]].sum() < target


def test_everything_met_gives_the_exact_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 150, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(400)]  # ties, repeated ids and vectors
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(5, [1.0] * 6)] * 120  # a hot vector under a query's own id
    queries = [(i, v) for i, v in rows if i % 25 == 0]
    got = multi_index.nearest(vectors(spark, queries), vectors(spark, rows), 4, centroids=8, group_rows=40)
    assert clean(got.collect()) == clean(plain_nearest(queries, rows, 4))


def test_few_or_no_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 5.0])]
    got = multi_index.nearest(vectors(spark, rows[:1]), vectors(spark, rows), 10)
    assert clean(got.collect()) == [(0, 1, 1, 0.0), (0, 2, 2, float(np.sqrt(10)))]
    assert multi_index.nearest(vectors(spark, rows), vectors(spark, rows).limit(0), 3).count() == 0
    assert multi_index.nearest(vectors(spark, rows).limit(0), vectors(spark, rows), 3).count() == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    kept = vectors(spark, rows).withColumn("v", multi_index.usable(F.col("v"))).filter("v IS NOT NULL")
    assert sorted(r["id"] for r in kept.filter("id IS NOT NULL").collect()) == [0]
    with pytest.raises(Exception, match="differ in length"):
        multi_index.nearest(vectors(spark, rows[:1]), vectors(spark, [(0, [1.0, 2.0]), (1, [1.0])]), 3)


@pytest.mark.parametrize("where", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, where):
    path = f"/root/testdata/{where}"
    got = entry.queries()["op13_inverted_multi_index"](spark, path).collect()
    rows = [(r[0], np.array(r[1], dtype=float)) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    queries = [r for r in rows if r[0] % 100 == 0]
    want = {(i, j) for i, _, j, _ in plain_nearest(queries, rows, 10)}
    assert len(got) == 10 * len(queries)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    at = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(float(np.linalg.norm(at[r["query_id"]] - at[r["vec_id"]])), abs=1e-12)
