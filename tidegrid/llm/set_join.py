"""N-gram Jaccard join by universe partitioning (operator 6).

A document is its set of word shingles, hashed to 64 bits. Sets x and y with Jaccard similarity of at least
t differ in D <= H(x) elements, H(x) = (1 - t) / (1 + t) * (|x| + |x| / t), and the same holds for H(y). Per
band of sizes the universe is hashed into m > H segments. Each element that differs spoils one segment at
most, so of the m subsets by segment two similar sets share m - D at least (pigeonhole).

Allocation by cost: subsets are put in one global order, the cheapest first: large ones, which unrelated sets
hardly share, before small ones. Two sets that share m - D subsets share one of their first H + 1, so only
these are indexed. Subsets of at most one element are dear, as unrelated sets have them too. A set with only
c < H + 1 cheap subsets indexes these and, in place of dear ones, the one-deletion neighbourhoods of its first
segments, up to the (H + 1 - c)-th cheap one. That loses nothing: if two similar sets share no cheap subset,
all cheap segments of x differ, at least c of them, with D <= H differences in all; so at most H - c differ in
more than one element, and among any H + 1 - c of them one differs in exactly one. The same holds for y, and
the shorter of the two allocations lies within the other. (A set with c < H + 1 - c indexes all of it.)

Verification is exact and comes before any closure. Each set is first compared with one set of each of its entries,
that which shares most of its own (a star, so candidates grow with the entries). Where that joins all sets of an entry, nothing is left to
do there. The sets of other entries are compared with each other in tiles of bounded size, unless they are of one
class already: first by size and by sketches of parities, which bound the elements that differ, then by elements within
the clusters that these bounds leave. No pair is ever a row but one of a star.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import tokens
from tidegrid.llm.components import components
from tidegrid.llm.shared import bit_table, hits, materialise, one_by_one, release, settle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64
#: Bytes of a chunk of an entry's sets, a thirty-second of it where only sketches are compared; a tile compares two chunks.
TILE_BYTES = 4 << 20
#: Sets of a star that one task streams past its centre.
STAR = 512
#: Digests of sets that a task remembers, so that it stores equal ones once.
MET = 100_000
#: Entries that a task sorts at once before they are counted, and about as many that a part of them holds.
PACKED = 1 << 20
#: Bits of the filter of entries: 16 MB whatever the corpus; a filled one lets more pass.
ENTRY_BITS = 1 << 27
#: The bits of a rank that are the number of its set; above them is the share of the set's entries that no other has.
NODE = (1 << 56) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text; with fewer words, of all of them as one."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, "u8")
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


class Bands:
    """Size bands that double, and the number of segments of each, for a threshold."""

    def __init__(self, t: Fraction):
        self.t, self.c = t, (1 - t) / (1 + t)

    def differ(self, size: int) -> int:
        """The most elements in which a set of this size and a similar one differ."""
        return int(self.c * (size + int(size / self.t)))

    def segments(self, b: int) -> int:
        """Segments of the band of sizes from 2**b to 2**(b + 1) - 1: enough spare ones to leave dear ones out."""
        high = 2 ** (b + 1) - 1
        return max(self.differ(int(high / self.t)) + 1, -(-13 * (self.differ(high) + 1) // 10))

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size is indexed: its own, and lower ones that hold similar sets."""
        own = size.bit_length() - 1
        return [b for b in range(own, -1, -1) if 2 ** (b + 1) - 1 >= self.t * size]


def entries(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Index entries (hashes) of one set."""
    need = bands.differ(len(found)) + 1
    if need < 2:  # only an equal set is similar
        return np.zeros(0, "u8")
    out = []
    high, mixed = found >> U(32), mix(found)
    for b in bands.of(len(found)):
        m = bands.segments(b)
        seg = ((high * U(m)) >> U(32)).astype("i8")
        total = np.zeros(m, "u8")
        np.add.at(total, seg, mixed)
        count = np.bincount(seg, minlength=m)
        place = mix(np.arange(m, dtype="u8") + U(b << 32))
        subset = mix(total ^ place)
        cheap = np.flatnonzero(count > 1)
        left = need - len(cheap)
        if left <= 0 or left > len(cheap):
            out.append(subset[np.lexsort((subset, -count))[:need]])
        else:
            out.append(subset[cheap])
        if left > 0:
            first = cheap[left - 1] + 1 if left <= len(cheap) else m
            near = place + U(0x632BE59BD9B4E019)
            out.append(mix(total[:first] ^ near[:first]))
            inside = seg < first
            out.append(mix((total[seg[inside]] - mixed[inside]) ^ near[seg[inside]]))
    return np.unique(np.concatenate(out))


def similar(a: int, size_a: int, size_b: int, t: Fraction) -> bool:
    return a * t.denominator >= t.numerator * (size_a + size_b - a)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def sketch(found: np.ndarray) -> bytes:
    """Parities of the set's elements in n to 2n cells: cells that differ are at most the elements that differ."""
    cells = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((mix(found ^ U(0x5851F42D4C957F2D)) & U(cells - 1)).astype("i8"), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the width of the narrowest."""
    width = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, "u8").reshape(-1, width), axis=0) for s in sketches])


def may_be_similar(rows: np.ndarray, i: int, sizes: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """True for the sets before the i-th that no bound excludes: by size, and by cells that differ."""
    differ = np.bitwise_count(rows[:i] ^ rows[i]).sum(axis=1, dtype="i8")
    total = sizes[:i] + sizes[i]
    return np.maximum(differ, np.abs(sizes[:i] - sizes[i])) <= limit[total]


def difference_limits(most: int, t: Fraction) -> np.ndarray:
    """The most elements in which two similar sets differ, by the sum of their sizes."""
    return np.arange(most + 1, dtype="i8") * (t.denominator - t.numerator) // (t.denominator + t.numerator)


def links_within(sets: list[np.ndarray], t: Fraction, labels: list[int] | None = None, marks: list[bytes] | None = None, ours: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that, with those that equal ``labels`` stand for, span the components of the similar pairs of ``sets``.

    Pairs that are joined already, or that a bound excludes, are not compared. With ``ours`` only pairs of
    sets on different sides of it are.
    """
    label = np.unique(np.arange(len(sets)) if labels is None else labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], "i8")
    rows, limit, out = folded(marks or [sketch(s) for s in sets]), difference_limits(2 * int(sizes.max(initial=0)), t), []
    for i in range(1, len(sets)):
        near = may_be_similar(rows, i, sizes, limit) & (label[:i] != label[i])
        if ours is not None:
            near &= ours[:i] != ours[i]
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i] and similar(common(sets[i], sets[j]), sizes[i], sizes[j], t):
                out.append((i, j))
                label[label == label[i]] = label[j]
    return out


def suspects(marks: list[bytes], sizes: np.ndarray, t: Fraction, labels: list[int], ours: np.ndarray | None = None) -> list[np.ndarray]:
    """Clusters of two sets or more such that sets of different labels that may be similar, as far as sketches tell, are in one."""
    rows, limit, cluster = folded(marks), difference_limits(2 * int(sizes.max(initial=0)), t), np.arange(len(marks))
    label = np.unique(labels, return_inverse=True)[1]
    for i in range(1, len(marks)):
        near = may_be_similar(rows, i, sizes, limit) & (label[:i] != label[i])
        if ours is not None:
            near &= ours[:i] != ours[i]
        if near.any():
            joined = np.unique(cluster[:i][near])
            cluster[np.isin(cluster, joined)] = joined[0]
            cluster[i] = joined[0]
    order = np.argsort(cluster, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1)
    return [p for p in parts if len(p) > 1]


def _binaries(column: pa.Array) -> list[memoryview]:
    """The values of a binary column, without copies."""
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, uid (unique), h1 and h2 (128 bits of the set's digest), and
    elements and sketch where the task has not met the set lately (``first``)."""
    schema = T.StructType([docs.schema[0], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "uid", "h1", "h2")), T.StructField("first", T.BooleanType()), T.StructField("elements", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        met: set[bytes] = set()
        for batch in batches:
            for at, texts in tokens.text_slices(batch, 1):
                size, h1, h2, first, elements, marks = [], [], [], [], [], []
                for text in texts:
                    own = shingles(text, n)
                    size.append(len(own))
                    data = own.tobytes()
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    a, b = struct.unpack("<qq", digest)
                    h1.append(a if len(own) else None)
                    h2.append(b if len(own) else None)
                    new = len(own) > 0 and digest not in met
                    if new:
                        if len(met) >= MET:
                            met.clear()
                        met.add(digest)
                    first.append(new)
                    elements.append(data if new else None)
                    marks.append(sketch(own) if new else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(size, pa.int64()), pa.array(np.arange(uid, uid + len(texts))), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first), pa.array(elements, pa.binary()), pa.array(marks, pa.binary())], names=schema.names)
                uid += len(texts)

    return docs.mapInArrow(run, schema)


def packed(found: np.ndarray, parts: int) -> np.ndarray:
    """Entries as a part in the upper half and 32 bits in the lower: equal entries stay equal, few others become so."""
    return ((found >> U(32)) * U(parts)) & U(0xFFFFFFFF << 32) | found & U(0xFFFFFFFF)


def repeated(found: np.ndarray, most: int) -> np.ndarray:
    """The values, sorted, each ``most`` times at most."""
    found = np.sort(found)
    if len(found) <= most:
        return found
    return np.concatenate([found[:most], found[most:][found[most:] != found[:-most]]])


def _shared_entries(sets: DataFrame, bands: Bands, parts: int) -> DataFrame:
    """``packed`` entries that two stored sets or more may have, as bigint.

    What is shuffled are 32 bits per entry, in sorted runs by part. An entry comes twice at most from each run, so
    one that very many sets have doesn't fill a part.
    """

    def pack(found):
        found = repeated(packed(np.concatenate(found), parts), 2)
        part = (found >> U(32)).astype("i8")
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        low = memoryview(found.astype("u4").tobytes())
        ends = [*cuts[1:].tolist(), len(found)]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([low[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary())], names=["part", "run"])

    def runs(batches):
        found, size = [], 0
        for batch in batches:
            for data in _binaries(batch.column(0)):
                found.append(entries(np.frombuffer(data, "u8"), bands))
                size += len(found[-1])
                if size > PACKED:
                    yield pack(found)
                    found, size = [], 0
        if size:
            yield pack(found)

    def count(batches):
        key, held = None, []
        for batch in batches:
            for part, run in zip(batch.column(0).to_pylist(), _binaries(batch.column(1)), strict=True):
                if part != key and held:
                    yield several(key, held)
                    held = []
                key = part
                held.append(np.array(np.frombuffer(run, "u4")))
        if held:
            yield several(key, held)

    def several(part, held):
        low = np.sort(np.concatenate(held))
        low = np.unique(low[1:][low[1:] == low[:-1]])
        return pa.RecordBatch.from_arrays([pa.array((low.astype("u8") | U(part << 32)).view("i8"))], names=["entry"])

    dealt = sets.select("elements").mapInArrow(runs, "part bigint, run binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(count, "entry bigint")


def _entries_of(sets: DataFrame, bands: Bands, wanted: Broadcast, parts: int) -> DataFrame:
    """(entry, rank) of stored sets, only those whose ``packed`` entries the bit table ``wanted`` may hold.

    The rank is the set's number below a number that is less the more of the set's entries others seem to have.
    """

    def run(batches):
        found, rank, size = [], [], 0
        for batch in batches:
            for uid, data in zip(batch.column(0).to_pylist(), _binaries(batch.column(1)), strict=True):
                own = entries(np.frombuffer(data, "u8"), bands)
                most = len(own)
                own = own[hits(wanted.value, packed(own, parts).view("i8"))].view("i8")
                found.append(own)
                rank.append(np.full(len(own), 127 * (most - len(own)) // max(most, 1) << 56 | uid))
                size += len(own)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(rank))], names=["entry", "rank"])
                    found, rank, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(rank))], names=["entry", "rank"])

    return sets.select("node", "elements").mapInArrow(run, "entry bigint, rank bigint")


def _fetched(nodes: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``nodes`` with columns of the stored sets; what no row asks for is dropped before the shuffle by a bit table."""
    held = sets.sparkSession.sparkContext.broadcast(bit_table(nodes, "node"))
    part = sets.select("node", *columns)
    schema = part.schema

    def run(batches):
        for batch in batches:
            keep = hits(held.value, batch.column(0).to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep))

    return nodes.join(part.mapInArrow(run, schema), "node")


def _along_stars(stars: DataFrame, sets: DataFrame, columns: tuple[str, ...], test) -> DataFrame:
    """Those (a, b) of ``stars`` whose sets pass test(row of a, row of b), a row being the values of ``columns``.

    A centre is held while its rays stream by; a star of many rays is dealt over several tasks.
    """
    many = stars.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("bigint").alias("parts"))
    dealt = materialise(stars.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.col("a").alias("node")), "rays")
    centres = dealt.select("b", "part").distinct().select("b", "part", F.col("b").alias("node"))
    rows = _fetched(dealt.withColumn("ray", F.lit(True)).unionByName(centres.withColumn("ray", F.lit(False))), sets, columns)

    def run(batches):
        key = centre = None
        for batch in batches:
            a, b = [], []
            values = zip(*(_binaries(c) if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns[4:]), strict=True)
            for where, ray, node, own in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), values, strict=True):
                if not ray:
                    key, centre = where, tuple(bytes(x) if isinstance(x, memoryview) else x for x in own)
                elif where != key:
                    raise ValueError("a star has no centre")
                elif test(own, centre):
                    a.append(node)
                    b.append(where[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select("b", "part", "ray", "node", *columns).repartition("b", "part").sortWithinPartitions("b", "part", "ray")
    links = materialise(rows.mapInArrow(run, "a bigint, b bigint"), "links")
    release(dealt)
    return links


def verified_stars(stars: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those (a, b) of ``stars`` whose sets are similar: first by sizes and sketches, then what is left by elements."""
    p, q = t.denominator - t.numerator, t.denominator + t.numerator

    def may(a, b) -> bool:
        rows, total = folded([a[1], b[1]]), a[0] + b[0]
        return max(int(np.bitwise_count(rows[0] ^ rows[1]).sum()), abs(a[0] - b[0])) <= total * p // q

    def exact(a, b) -> bool:
        a, b = np.frombuffer(a[0], "u8"), np.frombuffer(b[0], "u8")
        return similar(common(a, b), len(a), len(b), t)

    near = _along_stars(stars, sets, ("n_shingles", "sketch"), may)
    links = _along_stars(near, sets, ("elements",), exact)
    release(near)
    return links


def _in_tiles(rows: DataFrame, sets: DataFrame, columns: tuple[str, ...], bytes_each: float, most: int, work, schema: str) -> DataFrame:
    """work(ours, columns) of the sets of each entry of ``rows`` (entry, node, label, n_shingles), in chunks of ``most`` bytes.

    A set takes some ``bytes_each`` per shingle. ``work`` gets lists of node, label, n_shingles and ``columns``. An
    entry of one chunk is one call without ``ours``. Of other entries each chunk is packed as one row, and a tile of
    one or two of these is a call; ``ours`` tells the sets of two chunks apart. So no row of a set is repeated.
    """
    chunks = rows.groupBy("entry").agg(F.ceil(F.sum(F.col("n_shingles") * bytes_each + 256) / most).cast("int").alias("chunks"))
    own = rows.join(chunks, "entry").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    own = materialise(own.select("entry", "chunk", "chunks", "node", "label", "n_shingles"), "dealt")

    def dealt(part):
        fetched = _fetched(part, sets, columns).select("entry", "chunk", "chunks", "node", "label", "n_shingles", *columns)
        return fetched.repartition("entry", "chunk").sortWithinPartitions("entry", "chunk")

    def whole(batches):
        for _, held in _by_chunk(batches, len(columns)):
            yield work(None, held)

    def pack(batches):
        for (entry, chunk, n), held in _by_chunk(batches, len(columns)):
            yield pa.RecordBatch.from_arrays([pa.array([entry]), pa.array([chunk], pa.int32()), pa.array([n], pa.int32()), pa.array([pickle.dumps(held)], pa.binary())], names=["entry", "chunk", "chunks", "sets"])

    def tiles(batches):
        key, held = None, []
        for batch in batches:
            for *where, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != key:
                    key, held = where, []
                held.append((chunk, pickle.loads(data)))
                if len(held) == (1 if where[1] == where[2] else 2):
                    ours = None if len(held) == 1 else np.repeat([c == where[1] for c, _ in held], [len(x[0]) for _, x in held])
                    yield work(ours, [[v for part in x for v in part] for x in zip(*(x for _, x in held), strict=True)])

    out = dealt(own.where("chunks = 1")).mapInArrow(whole, schema)
    many = own.where("chunks > 1")
    if not many.isEmpty():
        packs = materialise(dealt(many).mapInArrow(pack, "entry bigint, chunk int, chunks int, sets binary"), "packs")
        pairs = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("entry", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "sets")
        with one_by_one(rows.sparkSession):
            out = out.unionByName(materialise(pairs.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j").mapInArrow(tiles, schema), "tiles"))
    return out


def _by_chunk(batches, columns: int):
    """(key, rows) of each chunk of a partition, rows as lists by column: node, label, n_shingles and what follows."""
    key, held = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        cols = [batch.column(c).to_pylist() for c in range(3, 6 + columns)]
        first = 0
        while first < len(keys):
            last = first + 1
            while last < len(keys) and keys[last] == keys[first]:
                last += 1
            if keys[first] != key:
                if held:
                    yield key, held
                key, held = keys[first], [[] for _ in cols]
            for h, c in zip(held, cols, strict=True):
                h += c[first:last]
            first = last
    if held:
        yield key, held


def jaccard_components(df: DataFrame, threshold: str = "0.9", n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``df``: documents whose sets are similar, transitively.

    component_id is the smallest doc_id of the component. Null and empty texts, and texts without words, have
    no shingles and are linked with nothing: their component is their own id. Texts with equal sets are one
    node, however many they are, so copies are never paired. Null ids take part, but name a component only if
    it has no other. Repeated rows give repeated results; other columns are ignored; an empty table gives none.

    Exact but for collisions of 64-bit hashes of shingles (sets are told apart by 128 bits). Texts are
    hashed once; all later steps read the stored sets. Entries and candidate links grow in proportion to the
    texts. Only what is left of an entry after its star was verified is compared pair by pair, in tiles
    of bounded size; that part grows with the square of the sets of one entry that don't link.
    """
    t = Fraction(threshold)
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    spark, bands = docs.sparkSession, Bands(t)
    rows = materialise(_sets_of(docs, n), "sets")
    sets = rows.where("first").withColumnRenamed("uid", "node")

    # equal sets that several tasks stored are one node, the least
    equal = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.when(F.col("first"), F.col("uid"))).alias("node"), F.min("doc_id").alias("least"))
    equal = materialise(equal, "equal")
    twins = materialise(rows.where("first").select("uid", "h1", "h2").join(equal, ["h1", "h2"]).where("uid <> node").select(F.col("uid").alias("twin"), F.col("node").alias("one")), "twins")

    # entries that several sets have: a set has each of its entries once, so those that come twice tell
    parts = max(256, (sets.agg(F.sum("n_shingles")).first()[0] or 0) // PACKED)
    held = spark.sparkContext.broadcast(bit_table(_shared_entries(sets, bands, parts), "entry", ENTRY_BITS))
    settle(spark)
    # each set against one of its entry, that which shares most of its entries: copies of a text are like the text, if
    # not like each other. Entries of one set alone, which a filled bit table lets pass, end here; rows are dealt once
    met = _entries_of(sets, bands, held, parts).join(twins, F.col("rank").bitwiseAND(NODE) == F.col("twin"), "left")
    met = met.select("entry", F.coalesce(F.col("rank") - F.col("twin") + F.col("one"), "rank").alias("rank")).repartition("entry").distinct()
    entry = Window.partitionBy("entry")
    met = met.withColumn("least", F.min("rank").over(entry)).withColumn("high", F.max("rank").over(entry)).where("least < high")
    shared = materialise(met.select("entry", F.col("rank").bitwiseAND(NODE).alias("node"), F.col("least").bitwiseAND(NODE).alias("b")), "shared")
    held.unpersist()
    release(twins)
    stars = materialise(shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "stars")
    links = verified_stars(stars, sets, t)
    release(stars)
    classes = components(links)

    # entries that this left with several classes; of entries with the same sets one is enough
    labels = classes.withColumnsRenamed({"node": "v", "root": "label"})
    labelled = shared.join(labels, F.col("node") == F.col("v"), "left").select("entry", "node", F.coalesce("label", "node").alias("label"))
    labelled = materialise(labelled, "labelled")
    release(shared)
    several = labelled.groupBy("entry").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("entry")
    open_ = materialise(labelled.join(several, "entry"), "open")
    release(labelled)
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    one = open_.groupBy("entry").agg(*mark).groupBy("n", "x", "y").agg(F.min("entry").alias("entry")).select("entry")
    left = materialise(open_.join(one, "entry").join(sets.select("node", "n_shingles"), "node").select("entry", "node", "label", "n_shingles"), "left")
    release(open_)

    def suspect(ours, rows):
        # a cluster is named after its sets, so one that several entries or tiles give is compared once
        (node, label, size, marks), name, found = rows, [], []
        for cluster in suspects(marks, np.array(size), t, label, ours):
            own = hashlib.blake2b(np.sort(np.array(node)[cluster]).tobytes(), digest_size=8).digest()
            name += [int.from_bytes(own, "little", signed=True)] * len(cluster)
            found += cluster.tolist()
        return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), *(pa.array([x[k] for k in found], pa.int64()) for x in (node, label, size))], names=["entry", "node", "label", "n_shingles"])

    def compare(ours, rows):
        node, label, _, marks, data = rows
        found = links_within([np.frombuffer(x, "u8") for x in data], t, label, marks, ours)
        return pa.RecordBatch.from_arrays([pa.array([node[k] for k, _ in found], pa.int64()), pa.array([node[k] for _, k in found], pa.int64())], names=["a", "b"])

    near = materialise(_in_tiles(left, sets, ("sketch",), 0.25, TILE_BYTES // 32, suspect, "entry bigint, node bigint, label bigint, n_shingles bigint").distinct(), "near")
    release(left)
    more = materialise(_in_tiles(near, sets, ("sketch", "elements"), 8.25, TILE_BYTES, compare, "a bigint, b bigint"), "more")
    release(near)
    classes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # the smallest document of each node, then of each class; what the result doesn't read goes
    keys = materialise(rows.select("doc_id", "n_shingles", "h1", "h2"), "keys")
    classed = equal.join(classes, "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root"))
    first = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(classed.join(first, "root").select("h1", "h2", "component_id"), "named")
    for t in (rows, equal, more, links):
        release(t)
    return keys.join(named, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
