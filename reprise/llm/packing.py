"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised, end with id 0, and are cut into pieces of a sequence's length only if longer (the first piece may
be shorter). Only (piece, length) is packed.

An individual is a grouping of pieces into bins. Crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold a piece twice and puts the displaced pieces back best-fit, largest first; mutation dissolves
ill-filled bins. The fitness prefers few and unevenly filled bins. The pieces are dealt to groups of about
``GROUP`` pieces; every group evolves on ``ISLANDS`` islands that are tasks of their own, start from different orders and,
after an epoch, send their elite to the next island. Then the full bins of the best island stay, and the pieces
of ill-filled bins migrate to a smaller round of groups, so no group's remainder is left behind.

Defined cases: a null text is the empty document, one end mark; a very long text is many pieces; rows that repeat an id
are documents of their own; an empty table gives no rows; other columns are ignored or, on request, kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.common import ids_of, in_small_batches, released
from reprise.session import materialise

LENGTH = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
GROUP = 2000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 8
ROUNDS = 3
#: Texts that one pattern match could run over for long are left to the other library of the same vocabulary.
LONG_TEXT = 200_000


class Tokenizer:
    """Ids of ``byte_bpe_50k.json``. The rank file of the same vocabulary gives the same ids and is read by a faster library.

    With ``added`` the literal of an added token in a text is that token, as with the JSON file's own library and its default
    settings; without, it is plain text.
    """

    def __init__(self, vocabulary: str = VOCABULARY, added: bool = True):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.slow_path, self.added = public_tokenizers.path(f"{vocabulary}.json"), added
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken")) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        with open(self.slow_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known = set(special) if added else set()
        self.slow = None

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, allowed_special=self.known, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer as Slow

            self.slow = Slow.from_file(self.slow_path)
            self.slow.encode_special_tokens = not self.added
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY,
           ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) with the ids of a piece as little-endian unsigned 32-bit numbers."""
    docs = in_small_batches(docs)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(vocabulary)
        for pdf in batches:
            doc_ids = ids_of(pdf["doc_id"])
            for a in range(0, len(pdf), 500):
                rows, owner = [], []
                for i, text in zip(range(a, min(a + 500, len(pdf))), pdf["text"].iloc[a:a + 500]):
                    tokens = np.append(tokenizer.encode(text), np.array([END], "<u4"))
                    first = len(tokens) % length or length
                    edges = [0, *range(first, len(tokens), length), len(tokens)] if len(tokens) > length else [0, len(tokens)]
                    for k, (s, e) in enumerate(zip(edges, edges[1:])):
                        raw = tokens[s:e].tobytes()
                        owner.append(i)
                        rows.append((k, s, e - s, zlib.crc32(raw), raw) if ids else (k, s, e - s, zlib.crc32(raw)))
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "ids"][: 4 + ids])
                out.insert(0, "doc_id", pd.array([doc_ids[i] for i in owner], "Int64"))
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(released(run), schema)


# ---- one island ----


class Grouping:
    """Bins of piece numbers; room[b] is what is left in bin b."""

    __slots__ = ("bins", "room")

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def fitness(self, capacity: int) -> tuple[int, int]:
        """Fewer bins first; then bins as full or as empty as they get."""
        return len(self.bins), -sum((capacity - r) ** 2 for r in self.room)


def best_fit(grouping: Grouping, items: list[int], size: list[int], capacity: int) -> None:
    """Put items where they leave the least room, in the given order."""
    by_room = sorted((r, b) for b, r in enumerate(grouping.room))
    for i in items:
        at = bisect.bisect_left(by_room, (size[i], -1))
        if at < len(by_room):
            room, b = by_room.pop(at)
            grouping.bins[b].append(i)
        else:
            room, b = capacity, len(grouping.bins)
            grouping.bins.append([i])
            grouping.room.append(capacity)
        room -= size[i]
        grouping.room[b] = room
        if room:
            bisect.insort(by_room, (room, b))


def cross(giver: Grouping, taker: Grouping, size: list[int], capacity: int, rng: np.random.Generator) -> Grouping:
    """The taker with a share of the giver's best-filled bins."""
    order = sorted(range(len(giver.bins)), key=giver.room.__getitem__)
    share = max(1, len(order) // 2)
    picked = [order[i] for i in np.flatnonzero(rng.random(share) < rng.uniform(0.2, 0.8)).tolist()] or order[:1]
    taken = {i for b in picked for i in giver.bins[b]}
    bins, room, displaced = [list(giver.bins[b]) for b in picked], [giver.room[b] for b in picked], []
    for b, items in enumerate(taker.bins):
        if taken.isdisjoint(items):
            bins.append(list(items))
            room.append(taker.room[b])
        else:
            displaced.extend(i for i in items if i not in taken)
    out = Grouping(bins, room)
    best_fit(out, sorted(displaced, key=size.__getitem__, reverse=True), size, capacity)
    return out


def mutate(g: Grouping, size: list[int], capacity: int, rng: np.random.Generator) -> Grouping:
    """Dissolve the emptiest bins and a few others."""
    order = sorted(range(len(g.bins)), key=g.room.__getitem__, reverse=True)
    n = max(2, len(order) // 50)
    gone = set(order[:n]) | set(rng.integers(0, len(order), n).tolist())
    out = Grouping([list(b) for k, b in enumerate(g.bins) if k not in gone], [r for k, r in enumerate(g.room) if k not in gone])
    best_fit(out, sorted((i for k in gone for i in g.bins[k]), key=size.__getitem__, reverse=True), size, capacity)
    return out


def evolve(size: list[int], capacity: int, start: list[Grouping], seed: int, population: int = POPULATION,
           generations: int = GENERATIONS) -> Grouping:
    """The best grouping an island finds."""
    rng = np.random.default_rng(seed)
    people = list(start)
    least = -(-sum(size) // capacity)
    order = np.argsort(-np.asarray(size), kind="stable")
    while len(people) < population:
        g = Grouping([], [])
        noise = order if not people else np.argsort(-np.asarray(size) * rng.uniform(0.8, 1.2, len(size)), kind="stable")
        best_fit(g, noise.tolist(), size, capacity)
        people.append(g)
    people.sort(key=lambda g: g.fitness(capacity))
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        a, b = rng.integers(0, len(people), 2).tolist()
        child = cross(people[min(a, b)], people[max(a, b)] if a != b else people[-1], size, capacity, rng)
        for g in (child, mutate(people[0], size, capacity, rng)):
            people.append(g)
        people.sort(key=lambda g: g.fitness(capacity))
        del people[population:]
    return people[0]


def _grouping(bins: np.ndarray, size: list[int], capacity: int) -> Grouping:
    order = np.argsort(bins, kind="stable")
    cut = np.flatnonzero(np.diff(bins[order])) + 1
    groups = [g.tolist() for g in np.split(order, cut)]
    return Grouping(groups, [capacity - sum(size[i] for i in g) for g in groups])


# ---- islands on the cluster ----


def _epoch(rows: DataFrame, capacity: int, epoch: int, seed: int) -> DataFrame:
    """rows: (group, island, item, length, bin, sent). bin and sent are the island's own and the received elite, -1 at first."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        size = pdf["length"].tolist()
        start = [_grouping(pdf[c].to_numpy(), size, capacity) for c in ("bin", "sent") if pdf[c].iloc[0] >= 0]
        island = int(pdf["island"].iloc[0])
        best = evolve(size, capacity, start, hash((seed, epoch, int(pdf["group"].iloc[0]), island)) % (1 << 32))
        number = np.empty(len(pdf), np.int64)
        for b, items in enumerate(best.bins):
            number[items] = b
        room = np.asarray(best.room)[number]
        return pd.DataFrame({"group": pdf["group"], "island": island, "item": pdf["item"], "length": pdf["length"], "bin": number,
                             "room": room, "bins": len(best.bins)})

    return rows.groupBy("group", "island").applyInPandas(
        run, "group long, island int, item long, length long, bin long, room long, bins long")


def _round(items: DataFrame, capacity: int, number: int) -> DataFrame:
    """(item, length, group, bin, room) of the best island of every group."""
    count = items.count()
    groups = max(1, -(-count // GROUP))
    lanes = F.array(*(F.lit(i) for i in range(ISLANDS)))
    rows = (
        items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)))
        .withColumn("island", F.explode(lanes)).withColumn("bin", F.lit(-1).cast("long")).withColumn("sent", F.lit(-1).cast("long"))
    )
    for epoch in range(EPOCHS):
        found = materialise(_epoch(rows, capacity, epoch, number), "packing-islands")
        if epoch + 1 < EPOCHS:
            sent = found.select("group", "item", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("bin").alias("sent"))
            rows = found.select("group", "island", "item", "length", "bin").join(sent, ["group", "island", "item"])
    winner = found.groupBy("group").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return found.join(winner, ["group", "island"]).select("item", "length", "group", "bin", "room")


def assign(items: DataFrame, capacity: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """(item, sequence_id, offset) for (item, length) with lengths of 1 to ``capacity``.

    Full pieces are sequences of their own. After each round but the last the bins that are as full as is usual stay, and
    the pieces of the others migrate on.
    """
    done = [items.where(F.col("length") >= capacity).select("item", "length", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("group"), F.col("item").alias("bin"))]
    rest = items.where(F.col("length") < capacity)
    for number in range(rounds):
        last = number == rounds - 1
        found = materialise(_round(rest, capacity, number), "packing-round")
        keep = F.lit(True) if last else F.col("room") <= F.lit(capacity // 100 if number else 0)
        done.append(found.where(keep).select("item", "length", F.lit(number).alias("round"), "group", "bin"))
        rest = found.where(~keep).select("item", "length")
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    # A group has far fewer than 2^20 bins.
    sequence = F.when(F.col("round") < 0, -F.col("item") - 1).otherwise((F.shiftleft("group", 20) + F.col("bin")) * rounds + F.col("round"))
    order = Window.partitionBy("round", "group", "bin").orderBy(F.col("length").desc(), "item")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("item", sequence.alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = materialise(pieces(docs, id_col, text_col, capacity, vocabulary, ids=False).withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    return cut.join(assign(cut.select("item", "length"), capacity), "item").drop("item")


def sequences(placed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, ids): the sequences themselves as arrays, from rows with sequence_id, offset and the ids of a piece."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("offset")[ids_col])
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [np.frombuffer(raw, "<u4").astype(np.int32)]})

    return placed.select("sequence_id", "offset", ids_col).groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<int>")
