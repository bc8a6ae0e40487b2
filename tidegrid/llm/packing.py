"""Best-fit packing by a grouping genetic algorithm (operator 1).

Documents become token pieces; pieces of full length are sequences of their own, all others are packed.
The items are dealt at random over blocks of bounded size. Each block is evolved on several islands.
A chromosome is a list of bins; crossover injects whole well-filled bins of one parent into the other,
removes the bins in which items then occur twice, and best-fits the displaced items. Between epochs each
island gets the elite of its neighbour. A block stops as soon as it has as few bins as its lengths allow.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import tokens
from tidegrid.llm.shared import drop_caches, materialise

END_ID = (0).to_bytes(4, "little")


def token_pieces(df: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of each piece of at most ``capacity`` ids."""
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", source.schema[0].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def cut(batches):
        drop_caches(tokens.CACHES)
        encoder = tokens.encoder(path, keep_space=False)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, texts in tokens.text_slices(batch, 1):
                rows, own = [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    data = memoryview(ids + END_ID)
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((uid, n, at // 4, len(part) // 4, zlib.crc32(part)))
                        own.append(k)
                        uid += 1
                u, n, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), batch.column(0).slice(first, len(texts)).take(pa.array(own)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=pa.schema([pa.field(f.name, t) for f, t in zip(schema, (pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]))

    return source.mapInArrow(cut, schema)


class Block:
    """The genetic operators on one block of items."""

    def __init__(self, lengths: list[int], capacity: int, rng: random.Random):
        self.lengths, self.capacity, self.rng = lengths, capacity, rng
        self.fewest = -(-sum(lengths) // capacity)

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Put items, longest first, into the bin with the least room that suffices, or a new one."""
        lengths, capacity = self.lengths, self.capacity
        rooms: dict[int, list[int]] = {}
        mask = 0  # bit r is set if some bin has room r
        for b, members in enumerate(bins):
            room = capacity - sum(map(lengths.__getitem__, members))
            if room:
                rooms.setdefault(room, []).append(b)
                mask |= 1 << room
        for i in items:
            n = lengths[i]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                own = rooms[room]
                b = own.pop()
                if not own:
                    mask ^= 1 << room
                bins[b].append(i)
            else:
                room, b = capacity, len(bins)
                bins.append([i])
            if room := room - n:
                if not (own := rooms.setdefault(room, [])):
                    mask |= 1 << room
                own.append(b)
        return bins

    def seed(self, noise: float) -> list[list[int]]:
        key = [n * (1 + noise * self.rng.random()) for n in self.lengths]
        return self.best_fit([], sorted(range(len(key)), key=lambda i: -key[i]))

    def fill(self, members: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, members))

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Bins, then the lower the more unequal their fill."""
        return len(bins), -sum(self.fill(b) ** 2 for b in bins)

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """Inject a run of the better filled half of b's bins into a."""
        best = sorted(b, key=self.fill, reverse=True)[: max(1, len(b) // 2)]
        low = self.rng.randrange(len(best))
        injected = best[low : low + max(1, self.rng.randrange(1, len(best) + 1))]
        taken = {i for members in injected for i in members}
        bins, displaced = [list(m) for m in injected], []
        for members in a:
            if taken.isdisjoint(members):
                bins.append(list(members))
            else:
                displaced += [i for i in members if i not in taken]
        return self.best_fit(bins, sorted(displaced, key=lambda i: -self.lengths[i]))

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Empty some of the least filled bins and a few others, and best-fit their items."""
        order = sorted(bins, key=self.fill)
        loose, rest = order[: max(2, len(order) // 50)], order[max(2, len(order) // 50) :]
        for _ in range(min(len(rest), max(2, len(order) // 50))):
            loose.append(rest.pop(self.rng.randrange(len(rest))))
        items = [i for members in loose for i in members]
        return self.best_fit([list(m) for m in rest], sorted(items, key=lambda i: -self.lengths[i]))

    def evolve(self, population: list[list[list[int]]], generations: int, size: int) -> list[list[list[int]]]:
        """The population, best first, after some generations."""
        while len(population) < size:
            population.append(self.seed(0.02 * len(population)))
            if len(population[-1]) == self.fewest:
                break
        population.sort(key=self.cost)
        for _ in range(generations):
            if len(population[0]) <= self.fewest:
                break
            children = []
            for _ in range(max(1, size // 2)):
                a, b = (self.rng.sample(population, 2) if len(population) > 1 else population * 2)
                children.append(self.mutate(self.cross(a, b)))
            population = sorted([*population, *children], key=self.cost)[:size]
        return population


def pack_items(items: DataFrame, capacity: int, n_blocks: int, islands: int = 2, epochs: int = 2, generations: int = 6, population: int = 4, seed: int = 7) -> DataFrame:
    """``items`` (a row with at least uid and length each) with sequence_id and offset.

    Blocks are chosen by a hash of uid, so they differ in size only by chance whatever the data.
    """
    spark = items.sparkSession
    if n_blocks < 1:
        return items.select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset")).limit(0)
    fields = [c for c in items.columns if c != "uid"]
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    blocks = materialise(items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", *fields))).alias("items")), "blocks")
    genes = "array<array<array<int>>>"
    state = blocks.select("block", F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast(genes).alias("population"))
    schema = f"block bigint, island int, lengths array<bigint>, population {genes}, bins int, done boolean"
    for epoch in range(epochs):

        def evolve(batches, epoch=epoch):
            drop_caches()  # texts are encoded by now; what that took is free for the executor
            for batch in batches:
                for row in batch.to_pylist():
                    own = Block(row["lengths"], capacity, random.Random(f"{seed} {epoch} {row['island']} {row['block']}"))
                    start = list(row["population"] or [own.seed(0.0 if row["island"] == 0 else 0.01 * row["island"])])
                    found = own.evolve(start, generations, population)
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "island": row["island"], "lengths": row["lengths"], "population": found, "bins": len(found[0]), "done": len(found[0]) <= own.fewest}], schema=arrow)

        arrow = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())), ("population", pa.list_(pa.list_(pa.list_(pa.int32())))), ("bins", pa.int32()), ("done", pa.bool_())])
        # by number: these tasks take little memory and much time, so they aren't to be merged
        after = materialise(state.repartition(spread, "block", "island").mapInArrow(evolve, schema), "islands")
        if epoch < epochs - 1:
            # the elite of the next island replaces the last of the population; only unfinished blocks go on
            open_blocks = after.groupBy("block").agg(F.max("done").alias("over")).where(~F.col("over")).select("block")
            left = after.join(open_blocks, "block", "left_semi")
            elite = left.select("block", F.pmod(F.col("island") - 1, F.lit(islands)).cast("int").alias("island"), F.slice("population", 1, 1).alias("elite"))
            state = left.join(elite, ["block", "island"]).select("block", "lengths", "island", F.concat(F.slice("population", 1, population - 1), "elite").alias("population"))
            found = after if epoch == 0 else found.unionByName(after)
    found = after if epochs == 1 else found.unionByName(after)
    best = found.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("bins", "island")).alias("bins"))
    schema = T.StructType([*blocks.schema["items"].dataType.elementType.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            for block, own, members in zip(*batch.columns, strict=True):
                yield placed(block.as_py(), own.values, members.values)

    # a row per block reaches Python: exploding bins natively copies a block's items once for each of its bins
    return blocks.join(best, "block").select("block", "items", "bins").mapInArrow(place, schema).select(*items.columns, "sequence_id", "offset")


def placed(block: int, items: pa.StructArray, bins: pa.ListArray) -> pa.RecordBatch:
    """The items of a block in the order of its bins, with sequence_id and offset (the lengths before an item in its bin)."""
    index, size = bins.flatten(), bins.value_lengths().to_numpy()
    taken = items.take(index)
    length = taken.field("length").to_numpy()
    before = np.cumsum(length) - length
    first = np.cumsum(size) - size  # no bin is empty
    number = (block << 24) + np.arange(len(size), dtype="i8")
    return pa.RecordBatch.from_arrays([*taken.flatten(), pa.array(np.repeat(number, size)), pa.array(before - np.repeat(before[first], size))], names=[*items.type.names, "sequence_id", "offset"])


def pack(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_items: int = 4096, **how) -> DataFrame:
    """Pack all rows of ``df`` into sequences of at most ``capacity`` ids of the tokenizer at ``path``.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset per piece. A document's ids
    end with id 0; a null or empty text is that id alone. Only documents of more than ``capacity`` ids
    are cut. Null ids and repeated rows are packed like any other row; other columns are ignored; an
    empty table gives no rows. Texts are encoded once; the pieces (some 40 bytes each) are kept as a
    table in the shared folder, and all later steps work on these.
    """
    pieces = materialise(token_pieces(df, path, capacity, id_col, text_col), "pieces")
    part = pieces.where(F.col("length") < capacity)
    packed = pack_items(part, capacity, -(-part.count() // block_items), **how)
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole).drop("uid")
