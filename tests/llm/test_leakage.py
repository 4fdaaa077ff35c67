import random

from loomgrid.llm.leakage import LeakIndex, filter_of, leaked_items, leaks_of, normal_words, terms_of

WORDS = [f"w{i}" for i in range(60)]


def brute(text, item, stretch=8):
    """Share of the item's words in maximal common stretches, by comparing all positions."""
    a, b = normal_words(text), normal_words(item)
    marked = set()
    for q in range(len(b)):
        for p in range(len(a)):
            n = 0
            while q + n < len(b) and p + n < len(a) and a[p + n] == b[q + n]:
                n += 1
            if n >= stretch:
                marked.update(range(q, q + n))
    return len(marked) / max(len(b), 1)


def test_index_finds_what_brute_force_finds():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 70)))) for i in range(60)]
    items += [(100, items[0][1]), (101, "a b a b a b a b a b a b a b a b a b"), (102, "too short to be held")]
    own = [(i, normal_words(t)) for i, t in items]
    index, known = LeakIndex.build(own, block=3), filter_of([w for _, w in own])
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(items)[1].split()
            start = rng.randint(0, max(0, len(w) - 4))
            parts.append(" ".join(w[start : start + rng.randint(4, 40)]))
            parts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))))
        texts.append(" ".join(parts))
    texts += ["a b a b a b a b a b", "", None, items[0][1]]
    n = 0
    for t in texts:
        want = {i for i, x in items if len(normal_words(x)) >= 8 and brute(t, x) >= 1 / 3 - 1e-9}
        assert set(leaks_of(t, index, known)) == want
        n += len(want)
    assert n > 60


ITEM = "The chimeric sample Tavel38 shows lineage confusion at dose 349 and paired outliers at dose 556 with anchorage unchanged"


def found_in(text, item):
    words = normal_words(item)
    return list(leaks_of(text, LeakIndex.build([(1, words)]), filter_of([words])))


def held(text):
    return found_in(text, ITEM)


def test_wand_retrieves_what_full_scores_do_and_skips():
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    items = [(i, [rng.choice(common) if rng.random() < 0.9 else f"r{rng.randint(0, 500)}" for _ in range(rng.randint(8, 40))]) for i in range(400)]
    index = LeakIndex.build(items, block=4)
    n = 0
    for _ in range(60):
        w = rng.choice(items)[1]
        query = list(dict.fromkeys(terms_of(w[: rng.randint(8, 20)]) + terms_of([rng.choice(common) for _ in range(40)])))
        scores = {}
        for g in query:
            if g in index.postings:
                for i, x in zip(index.postings[g].items, index.postings[g].impacts):
                    scores[i] = scores.get(i, 0.0) + x
        want = sorted(i for i, s in scores.items() if s >= 1 - 1e-9)
        before = index.scored
        assert sorted(index.retrieve(query)) == want
        assert index.scored - before <= len(scores)
        n += len(scores) - (index.scored - before)
    assert n > 0  # some items were never scored


def test_variants_do_not_matter():
    assert held("xx " + ITEM.upper() + " yy") == [1]
    assert held(ITEM.replace(" ", "\n> ")) == [1]
    assert held(ITEM.replace("lineage", "line­age").replace(" at ", " at ")) == [1]
    assert held(ITEM.replace("sample", "<b>sam</b>ple").replace("dose", "**dose**&nbsp;")) == [1]
    assert held(ITEM.replace("confusion", "con-\nfusion").replace("unchanged", "unchan​ged")) == [1]
    assert held(ITEM.replace("chimeric", "ｃｈｉｍｅｒｉｃ")) == [1]


def test_stretches_must_be_long_and_together_a_third():
    words = ITEM.split()
    assert held(" ".join(words[:7])) == []
    assert held(" ".join(words[:8])) == [1]
    assert held(" x ".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))) == []
    long = " ".join(f"q{i}" for i in range(30))
    assert found_in(" ".join(long.split()[:9]), long) == []
    assert found_in(" ".join(long.split()[:8]) + " zz " + " ".join(long.split()[20:28]), long) == [1]


def test_whole_long_texts_and_blocks_of_items(spark):
    filler = " ".join(f"f{i}" for i in range(40000))
    docs = spark.createDataFrame([(1, filler + " " + ITEM, "x"), (2, filler, "x"), (3, None, "x"), (4, "", "x"), (5, ITEM, "x"), (5, ITEM, "x")], "doc_id long, text string, item_id2 string")
    items = spark.createDataFrame([(i, ITEM if i in (7, 23) else f"other words entirely number {i} " * 4) for i in range(25)] + [(99, None)], "item_id long, text string")
    want = sorted([(d, i) for d in (1, 5, 5) for i in (7, 23)])
    # one block; many blocks; a Bloom filter instead of sets; several tasks a block
    for kw in ({}, {"block_items": 4}, {"most": 3, "bloom_bytes": 1 << 12}, {"block_items": 9, "per_task": 1}):
        assert sorted((r["doc_id"], r["item_id"]) for r in leaked_items(docs, items, **kw).collect()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaked_items(docs, items.limit(0)).count() == 0
    assert leaked_items(docs.limit(0), items).count() == 0
