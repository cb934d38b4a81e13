"""Leaks: planted passages, whole and edited, against alignment of every pair in Python."""

import random

import numpy as np

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import THRESHOLD, Items, _words, align, find_leaks, without_leaks


def smith_waterman(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[-1] - 1))
        best, last = max(best, *row), row
    return best


def test_alignment_is_the_textbook_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        score, first, last = align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert score == 0 or smith_waterman(a.tolist(), b[first:last].tolist()) == score


def data(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(30)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randrange(5, 300))]
        if d % 3 == 0:
            part = items[d % 30][1].split()
            for _ in range(len(part) * (d % 4) // 16):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["new"], ["new", "words"]])
            body[2:2] = part
        docs.append((d, " ".join(body).capitalize() + "."))
    return items, docs


def test_against_every_pair(spark):
    items, docs = data(spark)
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1].upper().replace(" ", ", ")), (502, items[4][1])]
    benchmark = [*items, (98, None), (99, ""), (3, items[3][1])]
    left = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double")
    right = spark.createDataFrame([(*r, 1) for r in benchmark], "item_id long, text string, gram int")
    got = sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in find_leaks(left, right).collect()), key=repr)
    want = []
    for d, t in docs:
        words = _words((t or "").encode())[0].tolist()
        for i, it in items:
            own = _words(it.encode())[0].tolist()
            score = smith_waterman(own, words) / (2 * len(own))
            if score >= THRESHOLD:
                want.append((d, i, round(score, 9)))
    assert got == sorted(want, key=repr) and len({x[0] for x in got}) >= 40
    clean = without_leaks(left, right)
    assert clean.columns == left.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d is not None and d not in {x[0] for x in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(docs, items).count() == 1 and find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0 and without_leaks(docs, items.limit(0)).count() == 1


def test_a_verbatim_copy_takes_no_seeds_from_edited_ones(spark):
    words = [f"w{k}" for k in range(42)]
    edited = [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for copies in (0, 1, 5):
        docs = spark.createDataFrame([(0, " ".join(edited)), *((k + 1, " ".join(words)) for k in range(copies))], "doc_id long, text string")
        assert {r.doc_id: round(r.score, 2) for r in find_leaks(docs, items).collect()} == {0: 0.64} | {k + 1: 1.0 for k in range(copies)}


def test_edits_in_every_three_words(spark):
    words = [f"w{k}" for k in range(40)]
    docs = [
        (0, [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(words)]), (1, [y for k, w in enumerate(words) for y in ([w, f"x{k}"] if k % 2 else [w])]),
        (2, [y for k, w in enumerate(words) for y in (w, f"x{k}")]), (3, words), (4, words[:19]), (5, words[::-1]), (6, ["pre"] * 200 + words[20:] + ["post"] * 200),
    ]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "one two three"), (3, "w39")], "item_id long, text string")
    left = spark.createDataFrame([*((d, " ".join(w)) for d, w in docs), (7, "two, three"), (8, "three two")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.score, 2)) for r in find_leaks(left, items).collect() if r.item_id != 3)
    assert got == [(0, 1, 0.51), (1, 1, 0.76), (2, 1, 0.51), (3, 1, 1.0), (6, 1, 0.5), (7, 2, 0.67)]
    assert sorted(r.doc_id for r in without_leaks(left, items).collect()) == [4, 8]


def test_no_alignment_is_lost():
    rng = random.Random(8)
    for threshold in (0.3, 0.5, 0.75, 1.0):
        for _ in range(40):
            vocabulary = [f"w{k}" for k in range(rng.choice([6, 30, 300]))]
            items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]) for i in range(4)]
            docs = [[rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(4)]
            for _, words in items * 3:
                copy, share = [], rng.random() * 0.6
                for w in words:
                    copy += [w] if rng.random() > share else rng.choice([[], ["x"], [w, "x"], [w, "x", "x"], ["x", w]])
                docs.append(["y"] * rng.randrange(30) + copy + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])
            texts = [" ".join(d).encode() for d in docs]
            block = Items([(i, " ".join(w).encode()) for i, w in items], threshold)
            counts = {}
            for t in texts:
                for g in set(block.grams[block.hits(_words(t)[0])[1]].view(np.int64).tolist()):
                    counts[g] = counts.get(g, 0) + 1
            block.rare(counts)
            for d, t in zip(docs, texts, strict=True):
                scores = [(i, smith_waterman(w, d) / (2 * len(w))) for i, w in items]
                assert [(i, s) for i, s, _, _ in block.leaks(t)] == [x for x in scores if x[1] >= threshold]


def test_items_in_several_blocks(spark, monkeypatch):
    items, docs = data(spark)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(find_leaks(left, right).collect())
    clean = sorted(without_leaks(left, right).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1500)
    assert len(list(decontaminate._blocks(left, right, THRESHOLD))) > 2
    assert sorted(find_leaks(left, right).collect()) == whole and sorted(without_leaks(left, right).collect()) == clean
    assert Items([(1, b"a b c d")]).rare({}).grams.size == 0


def test_a_phrase_that_all_items_share_makes_no_leaks(spark):
    rng = random.Random(12)
    phrase = "which of the following statements is true about the"
    body = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(i, f"{phrase} {body(14)}") for i in range(40)] + [(100, phrase)]
    docs = [(d, f"{body(30)} {phrase} {body(30)}") for d in range(60)] + [(60 + i, f"{body(9)} {items[i][1]} {body(9)}") for i in range(5)]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items if smith_waterman(x.split(), t.split()) >= THRESHOLD * 2 * len(x.split())}
    assert got == want and {(60 + i, i) for i in range(5)} <= got and {(d, 100) for d in range(60)} <= got


def test_a_very_long_text(spark):
    rng = random.Random(13)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    item = [f"q{k}" for k in range(30)]
    text = words[:11_000] + item[:12] + ["new"] + item[13:] + words[11_000:]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(words))], "doc_id long, text string")
    (r,) = find_leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert (r.doc_id, r.item_id, r.first, r.last, round(r.score * 60)) == (1, 7, 11_000, 11_030, 57)


def test_the_join_gives_what_the_lookup_gives(spark, monkeypatch):
    items, docs = data(spark)
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1]), (502, items[4][1]), (503, "!!"), (504, "w7 w8 solo")]
    benchmark = [*items, (98, None), (99, ""), (3, items[3][1]), (70, items[3][1]), (None, items[5][1]), (71, "??"), (72, "solo"), (73, "w8 solo")]
    left = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(docs)], "doc_id long, text string, key int, gram string")
    right = spark.createDataFrame([(*r, 1) for r in benchmark], "item_id long, text string, item int")
    for threshold in (0.3, THRESHOLD):
        whole, clean = (sorted(f(left, right, threshold).collect(), key=repr) for f in (find_leaks, without_leaks))
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "MOST_BLOCKS", 0)
            m.setattr(decontaminate, "ITEMS_A_ROW", 3)
            assert sorted(find_leaks(left, right, threshold).collect(), key=repr) == whole
            kept = without_leaks(left, right, threshold)
            assert kept.columns == left.columns and sorted(kept.collect(), key=repr) == clean
            m.setattr(decontaminate, "FILTER_WORDS", 1)  # a filter that lets nearly everything through
            assert threshold != THRESHOLD or sorted(find_leaks(left, right, threshold).collect(), key=repr) == whole


def test_the_join_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", 0)
    test_empty_tables(spark)
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, None), (2, "--")], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0 and without_leaks(docs, items).count() == 2


def test_seeds_that_many_items_and_documents_share_are_not_joined(spark, monkeypatch):
    phrase = "which of the following statements is true about the"
    rng = random.Random(12)
    body = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(i, f"{phrase} {body(14)}") for i in range(40)] + [(100 + i, f"{phrase} {body(1)}") for i in range(40)]
    docs = [(d, f"{body(30)} {phrase} {body(30)}") for d in range(60)] + [(60 + i, f"{body(9)} {items[i][1]} {body(9)}") for i in range(5)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(find_leaks(left, right).collect())
    assert len(whole) > 60 * 40
    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", 0)
    monkeypatch.setattr(decontaminate, "MOST_SHARED", 8)
    looked_up, joined = decontaminate._by_seed(left, right, THRESHOLD)
    assert {r.item_id for r in looked_up.collect()} >= {100 + i for i in range(40)}
    assert sorted(find_leaks(left, right).collect()) == whole
    assert sorted(r.doc_id for r in without_leaks(left, right).collect()) == sorted({d for d, _ in docs} - {r.doc_id for r in whole})
