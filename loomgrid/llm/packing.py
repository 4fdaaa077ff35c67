"""Filling containers of fixed capacity with items, by hierarchical residual packing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.sources.staging import stage


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; NULL and empty texts have none."""
    path = path or tokenizer_file()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long")


Move = tuple[int, int, int, int, int]  # run, offset in it, items, first box, items a box
Range = tuple[int, int, int]  # first box, boxes, fill


def pack_runs(runs: list[tuple[int, int]], capacity: int) -> tuple[list[Move], list[Range]]:
    """Best fit of runs of equal items: each item, taken in order, goes where the least space remains, else to a new box.

    ``runs``: size and number of items, largest size first.  Equal boxes are
    handled together, so the work depends on the number of different sizes and
    fills, not on that of items: of the boxes with the least sufficient space
    each takes as many items as fit before the next one does, which is what
    best fit does item by item.  Item ``offset + i`` of a move is in box
    ``first + i // items a box``.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: first box, boxes
    mask, opened, moves = 0, 0, []

    def keep(room: int, box: int, n: int) -> None:
        nonlocal mask
        if n:
            own = free[room]
            if own and own[-1][0] + own[-1][1] == box:
                own[-1] = (own[-1][0], own[-1][1] + n)
            else:
                own.append((box, n))
            mask |= 1 << room

    for run, (size, count) in enumerate(runs):
        off = 0
        while off < count:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                box, n = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
                per = room // size if size else count - off
            else:
                room, box = capacity, opened
                per = capacity // size if size else count - off
                n = -(-(count - off) // per)
                opened += n
            whole = min(n, (count - off) // per)
            if whole:
                moves.append((run, off, whole * per, box, per))
                off += whole * per
            rest, n_rest = count - off, n - whole
            if rest and n_rest:  # the last box takes fewer items
                keep(room, box + whole + 1, n_rest - 1)
                moves.append((run, off, rest, box + whole, rest))
                off = count
                keep(room - rest * size, box + whole, 1)
            else:
                keep(room, box + whole, n_rest)
            keep(room - per * size, box, whole)
    return moves, [(box, n, capacity - room) for room, ranges in enumerate(free) for box, n in ranges]


_MOVES = "kind string, part long, child long, start long, off long, n long, box long, per long, fill long"


def _pack_level(runs: DataFrame, capacity: int) -> DataFrame:
    """Moves and boxes of each part; ``runs``: ``part, child, start, n, size``, a run being known by ``child, start``."""

    def pack(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "child", "start"], ascending=[False, True, True])
        child, start = rows["child"].tolist(), rows["start"].tolist()
        moves, boxes = pack_runs(list(zip(rows["size"].astype(int).tolist(), rows["n"].astype(int).tolist())), capacity)
        out = [("move", part[0], child[r], start[r], off, n, box, per, 0) for r, off, n, box, per in moves]
        out += [("box", part[0], 0, 0, 0, n, box, 0, fill) for box, n, fill in boxes]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MOVES.split(", ")])

    return runs.groupBy("part").applyInPandas(pack, _MOVES)


_PLACES = "part long, start long, box long, n long, level int, home long, base long, shift long, per long"


def _followed(moves: DataFrame, places: DataFrame) -> DataFrame:
    """Where the items of moves end: the places of their boxes, a level down.

    ``places``: box ``box + i`` of a part is, for ``i < n``, container ``base +
    (i + shift) // per`` of part ``home`` on ``level``.  Moves of a part are cut
    at the borders of its places; ``start`` tells the run, ``box`` the item in it.
    """

    def follow(_: tuple, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("box")
        begin, out = p["box"].to_numpy(), []
        known = list(zip(*(p[c].tolist() for c in ("box", "n", "level", "home", "base", "shift", "per"))))
        for child, start, off, n, box, per in zip(*(m[c].tolist() for c in ("child", "start", "off", "n", "box", "per"))):
            end = box + -(-n // per)
            for b, many, level, home, base, shift, each in known[begin.searchsorted(box, "right") - 1 : begin.searchsorted(end, "left")]:
                low = (max(b, box) - box) * per
                high = min(n, (min(b + many, end) - box) * per)
                out.append((child, start, off + low, high - low, level, home, base, low + per * (box - b + shift), per * each))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLACES.split(", ")])

    return moves.groupBy("part").cogroup(places.groupBy("part")).applyInPandas(follow, _PLACES)


def _own_places(boxes: DataFrame, level: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    # columns of their own, as a cogroup with the moves of the same table would take them for one
    boxes = boxes.select(*[(F.col(c) + 0).alias(c) for c in ("part", "box", "n")])
    return boxes.select("part", zero.alias("start"), "box", "n", F.lit(level).alias("level"), F.col("part").alias("home"), F.col("box").alias("base"), zero.alias("shift"), F.lit(1).cast("long").alias("per"))


def pack(items: DataFrame, capacity: int, per_part: int = 50_000, fan_in: int = 8, slack: float = 0.01) -> DataFrame:
    """``item_id, piece, start, size, container`` for every item.

    ``items``: ``item_id, size``; ids must differ, sizes of NULL count as 0 and
    an item of size 0 still gets a container.  Only an item larger than
    ``capacity`` is divided: into pieces of exactly the capacity, each a
    container of its own, and a rest that is packed like other items.

    Items are spread by hash over parts of about ``per_part`` and packed there,
    largest first, each where the least space remains.  Containers full but for
    ``slack`` are done.  All others go up a tree as items, ``fan_in`` parts to
    one, and are packed again, until one part is left.  Equal items and equal
    containers are packed as runs, so what a task of any level holds is bounded
    by ``fan_in`` times the number of different sizes, however many items there
    are; no container is held back.  Where they ended is then followed down the
    tree, again as runs, and told to the items of each part.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    pieces = items.select("item_id", size.alias("_all")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_all") == 0, 0).otherwise(F.ceil(F.col("_all") / capacity) - 1))))
    pieces = pieces.select("item_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("piece") * capacity).alias("size"))
    pieces = stage(pieces, "pieces")
    open_items = pieces.filter(F.col("size") < capacity)
    parts = max(1, -(-open_items.count() // per_part))
    open_items = open_items.withColumn("part", F.pmod(F.xxhash64("item_id", "piece"), F.lit(parts)))

    # a run of the lowest level is a size
    zero = F.lit(0).cast("long")
    runs = open_items.groupBy("part", "size").agg(F.count("*").alias("n")).select("part", F.col("part").alias("child"), F.col("size").alias("start"), "n", "size")
    level, levels = 0, [stage(_pack_level(runs, capacity), "packed-0")]
    while parts > 1:
        parts, level = -(-parts // fan_in), level + 1
        under = levels[-1].filter((F.col("kind") == "box") & (F.col("fill") < capacity * (1 - slack)))
        runs = under.select(F.floor(F.col("part") / fan_in).alias("part"), F.col("part").alias("child"), F.col("box").alias("start"), "n", F.col("fill").alias("size"))
        levels.append(stage(_pack_level(runs, capacity), f"packed-{level}"))
    boxes = lambda t: t.filter("kind = 'box'")
    moves = lambda t: t.filter("kind = 'move'")
    places = _own_places(boxes(levels[level]), level)
    for at in range(level - 1, -1, -1):
        closed = boxes(levels[at]).filter(F.col("fill") >= capacity * (1 - slack))
        # a run of boxes starts at the number of its first box, so its items are boxes again
        moved = _followed(moves(levels[at + 1]), places).withColumn("box", F.col("start") + F.col("box")).withColumn("start", zero)
        places = stage(_own_places(closed, at).unionByName(moved), f"places-{at}")
    homes = _followed(moves(levels[0]), places)

    schema = f"item_id {dict(items.dtypes)['item_id']}, piece long, start long, size long, container string"

    def settle(_: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item_id", "piece"]).reset_index(drop=True)
        own = own.sort_values(["start", "box"]).reset_index(drop=True)
        # items in order of size and rank meet the runs' pieces in order of size and first rank
        at = own.index.repeat(own["n"])
        rank = rows.groupby("size").cumcount().to_numpy()
        hit = own.loc[at].reset_index(drop=True)
        number = hit["base"] + (rank - hit["box"] + hit["shift"]) // hit["per"]
        name = hit["level"].astype(str) + "-" + hit["home"].astype(str) + "-" + number.astype(str)
        return rows[["item_id", "piece", "start", "size"]].assign(container=name)

    small = open_items.groupBy("part").cogroup(homes.groupBy("part")).applyInPandas(settle, schema)
    full = pieces.filter(F.col("size") >= capacity)
    own = F.concat(F.lit("f-"), F.concat_ws(":", F.col("item_id").cast("string"), F.col("piece").cast("string")))
    return small.unionByName(full.withColumn("container", own))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens, the share of space used, and the least number of containers possible."""
    boxes = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.count("*").alias("n"))
    return boxes.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("fill").alias("n_tokens"),
        (F.sum("fill") / (F.count("*") * capacity)).alias("used_share"), F.ceil(F.sum("fill") / capacity).alias("least_containers"),
        F.max("fill").alias("fullest"),
    )
