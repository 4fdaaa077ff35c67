import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm.packing import fill_report, pack, pack_runs, token_counts, tokenizer_file

SCHEMA = "item_id long, size long"


def check(out, items, capacity):
    by_item, boxes = {}, {}
    for r in out:
        by_item.setdefault(r["item_id"], []).append(r)
        boxes.setdefault(r["container"], []).append(r["size"])
    assert all(sum(b) <= capacity for b in boxes.values())
    assert set(by_item) == {i for i, _ in items}
    for i, size in items:
        pieces = sorted(by_item[i], key=lambda r: r["piece"])
        assert sum(p["size"] for p in pieces) == (size or 0)
        assert [p["start"] for p in pieces] == [k * capacity for k in range(len(pieces))]
        assert len(pieces) == max(1, -(-(size or 0) // capacity))  # divided only where it must be
    return boxes


def run(spark, items, capacity, **kw):
    return pack(spark.createDataFrame(items, SCHEMA), capacity, **kw).collect()


def best_fit(sizes, capacity):
    """Fills of boxes, item by item."""
    fills = []
    for s in sizes:
        room = [(capacity - f, i) for i, f in enumerate(fills) if capacity - f >= s]
        if room:
            fills[min(room)[1]] += s
        else:
            fills.append(s)
    return sorted(fills)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_runs_are_packed_as_item_by_item(sizes):
    sizes = sorted(sizes, reverse=True)
    runs = [(s, sizes.count(s)) for s in dict.fromkeys(sizes)]
    moves, boxes = pack_runs(runs, 50)
    fills, taken = {}, {}
    for run, off, n, box, per in moves:
        for i in range(n):
            fills[box + i // per] = fills.get(box + i // per, 0) + runs[run][0]
            taken.setdefault(run, []).append(off + i)
    assert {r: sorted(t) for r, t in taken.items()} == {r: list(range(n)) for r, (_, n) in enumerate(runs)}
    assert sorted(fills.values()) == best_fit(sizes, 50)
    assert {b + i: f for b, n, f in boxes for i in range(n)} == fills


def test_work_does_not_grow_with_items():
    moves, boxes = pack_runs([(6, 10**9), (3, 10**9)], 10)
    assert len(moves) + len(boxes) < 10 and sum(n for _, n, _ in boxes) == 10**9


def test_one_part(spark):
    items = [(1, 10), (2, 0), (3, None), (4, 25), (5, 10), (6, 7), (7, 3), (8, 20)]
    boxes = check(run(spark, items, 10), items, 10)
    assert len(boxes) == 8


def test_tree_of_parts(spark):
    rng = random.Random(4)
    items = [(i, min(3000, int(rng.lognormvariate(5, 1)))) for i in range(3000)]
    boxes = check(run(spark, items, 1000, per_part=100, fan_in=3), items, 1000)
    assert sum(s or 0 for _, s in items) / (len(boxes) * 1000) > 0.99


@pytest.mark.parametrize("fan_in", [2, 8])
def test_tree_of_many_levels_loses_little(spark, fan_in):
    rng = random.Random(5)
    items = [(i, min(900, 1 + int(rng.expovariate(1 / 150)))) for i in range(4000)]
    boxes = check(run(spark, items, 500, per_part=60, fan_in=fan_in), items, 500)  # 67 parts: 7 or 3 levels
    assert len(boxes) <= 1.02 * -(-sum(s for _, s in items) // 500)  # 15 containers a part only


def test_bins_that_never_fit_together_do_not_pile_up(spark):
    items = [(i, 6) for i in range(600)]
    boxes = check(run(spark, items, 10, per_part=50, fan_in=2), items, 10)
    assert len(boxes) == 600


def test_same_result_twice(spark):
    items = [(i, 1 + i * 7 % 40) for i in range(500)]
    a, b = (sorted((r["item_id"], r["piece"], r["container"]) for r in run(spark, items, 64, per_part=60)) for _ in range(2))
    assert a == b


def test_empty_and_wrong_capacity(spark):
    assert run(spark, [], 10) == []
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], 0)


def test_report(spark):
    out = pack(spark.createDataFrame([(1, 10), (2, 5), (3, 5)], SCHEMA), 10)
    r = fill_report(out, 10).first()
    assert (r["n_containers"], r["n_pieces"], r["n_tokens"], r["used_share"], r["least_containers"]) == (2, 3, 20, 1.0, 2)


def test_tokens_of_whole_texts(spark):
    pytest.importorskip("public_tokenizers")
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Loss of BVLZ22 slowed it.", "<|endoftext|>", "é​漢字 " * 3000, "word " * 20000]
    got = {r[0]: r[1] for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i] == len(ids) and encoding.decode(ids) == (t or "")
