"""Near-duplicate documents: HyperMinHash sketches, banded registers, exact confirmation.

1. One pass takes every text's set of word shingles (hashed to 64 bits), a key of the whole set, and
   HyperMinHash sketches of REGISTERS registers. Hashes fall into buckets by their leading bits; a register
   keeps of its bucket's least hash the number of leading zeros and MANTISSA bits after the first one. A small
   set would leave most buckets empty, so it has fewer buckets under several independent hashes, by its size;
   a set near a bound of sizes is sketched on both sides of it. Bands of ROWS registers are hashed to keys.
2. Equal sets become one class, aggregated before the shuffle. Classes that share a band key are linked to
   the first of them and to the one before, unless one bit of each band's first register tells that they
   are far apart. The components of these links are loose clusters; two classes that are near are in one
   but for a chance of about 1e-8 (see README).
3. Within a loose cluster the signatures of all classes, one bit of each register, meet in blocks; links span those with
   enough bits alike, less what chance makes alike. Their components are the clusters; no text has been read for them.
4. The texts of each cluster meet in tasks. A large cluster is cut into blocks, each of which has the cluster's
   first class as a guest; that links most of a group of near copies at once. Classes that are not linked to
   it then meet all blocks of their cluster. In a task the sketches' Jaccard index, corrected for chance
   collisions of registers, rules out what is far apart (by MARGIN standard errors); what is left is confirmed
   on the full sets. A task returns links that span what is connected, not all pairs. Their components are the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, mix64, powers, shared_folder, splitting_join, staged, text_chunks, word_hashes
from .components import components

WORDS = 5
PERCENT = 85
REGISTERS, ROWS, MANTISSA = 512, 8, 10
BANDS = REGISTERS // ROWS
#: A block holds about so many classes and so many shingles (8 bytes each), or one class.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 21
#: A band that more classes share than this is linked in parts. One class in SAMPLED tells which bands these are, BANDS_APART of them at most;
#: any other band is linked in one task, which changes nothing but the task's size.
BAND_CLASSES, SAMPLED, BANDS_APART = 1 << 14, 64, 1 << 16
#: A block of signatures (REGISTERS bits each) holds about so many classes.
BLOCK_SIGNATURES = 1 << 12
#: A pair is ruled out by the sketches only this many standard errors below the threshold.
MARGIN = 6.0
#: The most that the chance of a miss may be for a pair at the threshold: by sharing no band, and by too few bits alike (of BANDS, and of REGISTERS).
NO_BAND, PRUNED = 1e-5, 3e-8
#: Shingles for each bucket at least, where that is possible.
FILL = 3
_BITS = REGISTERS.bit_length() - 1


def least_alike(percent: int, bits: int = BANDS) -> int:
    """How many of so many bits, each of a register of its own, a link needs alike. The bits are the same in all bands, so what fails here is found nowhere else."""
    cut = percent / 100
    if (1 - cut**ROWS) ** BANDS > NO_BAND:
        raise ValueError(f"{BANDS} bands of {ROWS} registers miss too many pairs at {percent} %")
    p, below = (1 + cut) / 2, 0.0
    for k in range(bits):
        below += comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if below > PRUNED:
            return k
    return bits


def shingle_hashes(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text; with fewer words all of them are one shingle, without words there is none."""
    words, counts = word_hashes(texts)
    up = powers(width, 0xC2B2AE3D27D4EB4F)
    rolled = np.zeros(len(words), np.uint64)
    for j in range(min(width, len(words))):
        rolled[: len(words) - j] += words[j:] * up[j]
    rolled = mix64(rolled)
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            short = (words[start : start + n] * up[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        start += n
    return out


def buckets_for(n: int) -> int:
    """A power of two up to REGISTERS, such that each bucket has FILL hashes or more in the mean."""
    return 1 << min(max(n // FILL, 1).bit_length() - 1, _BITS)


def registers(hashes: np.ndarray, buckets: int = REGISTERS) -> np.ndarray:
    """HyperMinHash of distinct hashes: 0 for an empty bucket, else (leading zeros, mantissa) + 1. REGISTERS / buckets independent hashes have `buckets` each."""
    turns = REGISTERS // buckets
    if turns > 1:
        salts = powers(turns, 0xA24BAED4963EE407)[:, None] - np.uint64(1)
        hashes = mix64(hashes[None, :] ^ salts)
    bits = np.uint64(buckets.bit_length() - 1)
    bucket = hashes >> (np.uint64(64) - bits) if buckets > 1 else np.zeros_like(hashes)
    bucket = bucket + (np.arange(turns, dtype=np.uint64) * np.uint64(buckets))[:, None] if turns > 1 else bucket
    key = np.sort((bucket << np.uint64(64 - _BITS) | (hashes << bits) >> np.uint64(_BITS)).ravel())
    bucket = (key >> np.uint64(64 - _BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so a bucket's first hash is its least
    rest = key[first] << np.uint64(_BITS)
    # The exponent of a double could round up; that of half of the bits cannot.
    high = (rest >> np.uint64(32)).astype(np.float64)
    low = (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 64 - _BITS))
    shifted = np.where(zeros < 63, rest << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    mantissa = (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = (zeros << MANTISSA | mantissa) + 1
    return out


def bands_of(hashes: np.ndarray, percent: int) -> list[dict]:
    """For each number of buckets that a near set may have too: that number, signature (a bit of each register), bits (those of each band's first) and keys (64-bit, of each band with a shingle)."""
    out = []
    for buckets in sorted({buckets_for(len(hashes)), buckets_for(-(-100 * len(hashes) // percent))}):
        bands = registers(hashes, buckets).reshape(BANDS, ROWS).astype(np.uint64)
        keys = mix64((bands * powers(ROWS, 0x9FB21C651E98DF25)).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(buckets))
        ones = (mix64(bands) & np.uint64(1)).astype(np.uint8)
        bits = np.packbits(ones[:, 0]).view(np.int64)[0]
        out.append({"buckets": buckets, "signature": np.packbits(ones.ravel()).tobytes(), "bits": int(bits), "keys": keys.view(np.int64)[bands.any(1)].tolist()})
    return out


def estimates(sketch: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard indices of one sketch with others, less the matches expected by chance, and the number of registers each rests on."""
    same = (others == sketch) & (sketch > 0)
    used = ((others > 0) | (sketch > 0)).sum(1)
    # Two unrelated buckets' least hashes fall into one (zeros, mantissa) cell with about this chance.
    chance = 2.0 ** -(MANTISSA + 1) * 2 * n * sizes / np.maximum(n + sizes, 1) ** 2
    share = same.sum(1) / np.maximum(used, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), used


def near(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_estimate(used: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A pair whose estimate from so many registers is below this is ruled out; few registers rule out nothing."""
    cut, used = percent / 100, np.maximum(used, 1)
    return cut - MARGIN * np.sqrt(cut * (1 - cut) / used) - 1 / used


def spanning_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of near pairs that span what is connected. side: two sides, of which only pairs across are needed (None: all); label: what is connected already.

    For each class, candidates of fitting size that aren't connected to it yet are ruled out by the sketches
    or confirmed on the sets, the most alike first.
    """
    n, out = len(sets), []
    label = np.arange(n) if label is None else label.copy()  # of each class, what it is connected to
    sizes = np.array([len(s) for s in sets])
    sketches = np.array([registers(s) for s in sets])
    quick = np.ascontiguousarray(sketches[:, ::4])
    for i in range(n - 1):
        fits = (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])) & (label[i + 1 :] != label[i])
        if side is not None:
            fits &= side[i + 1 :] != side[i]
        js = np.flatnonzero(fits) + i + 1
        for few in (quick, sketches):
            likely, used = estimates(few[i], few[js], int(sizes[i]), sizes[js])
            stays = likely >= least_estimate(used, percent)
            js, likely = js[stays], likely[stays]
        for j in js[np.argsort(-likely, kind="stable")].tolist():
            if label[j] != label[i] and near(sets[i], sets[j], percent):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def sets_of(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, set_key (null without shingles) and bands of every document."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("buckets", pa.int32()), ("signature", pa.binary()), ("bits", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        for part in text_chunks(batches):
            sets = shingle_hashes([ascii_lower(t) for t in part.column("text").to_pylist()], width)
            keys, bands = [], []
            for s in sets:
                # Two independent sums over the mixed hashes and the count: 128 bits that don't depend on order.
                a, b = s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                keys.append(np.array([a, b], np.uint64).tobytes() if len(s) else None)
                bands.append(bands_of(s, percent) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, kind)],
                ["doc_id", "tie", "n_shingles", "set_key", "bands"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id long, tie long, n_shingles long, set_key binary, bands array<struct<buckets:int,signature:binary,bits:long,keys:array<long>>>")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: names of classes that share a band and are alike by their bits: each is linked to the band's first and to the one before.

    A band of very many classes is cut into parts by their names; then the first ones of the parts are linked in the same way.
    """
    keyed = classes.select(F.xxhash64("set_key").alias("name"), F.explode("bands").alias("b")).select("name", "b.bits", F.explode("b.keys").alias("band"))
    seen = keyed.where(F.pmod(F.xxhash64("name", F.lit(3)), F.lit(SAMPLED)) == 0).groupBy("band").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
    hot = seen.where(F.col("n") > BAND_CLASSES).orderBy(F.desc("n"), "band").limit(BANDS_APART).collect()  # bounded by BANDS_APART
    most = BANDS - least_alike(percent)

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        in_order = Window.partitionBy(*by).orderBy("name")
        head, before = F.first(F.struct("name", "bits")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lag(F.struct("name", "bits")).over(in_order)
        alike = lambda c: F.bit_count(F.col("bits").bitwiseXOR(F.col(c)["bits"])) <= most
        ends = F.array_compact(F.array(F.when(alike("head"), F.col("head.name")), F.when(alike("before"), F.col("before.name"))))
        return rows.withColumn("head", head).withColumn("before", before).where("before is not null").select(F.col("name").alias("a"), F.explode(ends).alias("b"))

    if not hot:
        return linked(keyed, "band")
    parts = classes.sparkSession.createDataFrame([(r.band, -(-r.n // BAND_CLASSES)) for r in hot], "band long, parts long")
    dealt = keyed.join(F.broadcast(parts), "band", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("name", F.lit(4)), F.col("parts"))).otherwise(0))
    heads = dealt.where("parts is not null").groupBy("band", "part").agg(F.min(F.struct("name", "bits")).alias("first")).select("band", "first.*")
    return linked(dealt.repartition("band", "part"), "band", "part").unionByName(linked(heads, "band"))


def alike_links(signatures: np.ndarray, side: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Links that span what has at least so many bits alike. signatures: a row of 64-bit words each; side: two sides, of which only pairs across are needed (None: all)."""
    n, out, most = len(signatures), [], 64 * signatures.shape[1] - least
    label, groups = np.arange(n), n
    for i in range(n - 1):
        if groups == 1:
            break
        open_ = label[i + 1 :] != label[i]
        if side is not None:
            open_ &= side[i + 1 :] != side[i]
        js = np.flatnonzero(open_) + i + 1
        js = js[np.bitwise_count(signatures[js] ^ signatures[i]).sum(1) <= most]
        merged, first = np.unique(label[js], return_index=True)
        if len(merged):
            out.extend((i, j) for j in js[first].tolist())
            label[np.isin(label, merged)] = label[i]
            groups -= len(merged)
    return out


def clusters_of(classes: DataFrame, percent: int) -> DataFrame:
    """node, root: components (roots left out) of names of classes whose signatures are alike, within the loose clusters of candidates.

    Every two signatures of a loose cluster with one number of buckets are compared in some task: a large one is cut into blocks by name, and each pair of
    blocks meets, 64 bytes a class, so that what is sent stays far below the texts however many pages share a template.
    """
    loose = components(candidates(classes, percent))
    loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    signed = classes.select(F.xxhash64("set_key").alias("node"), F.inline("bands")).select("node", "buckets", "signature")
    signed = staged(loose.join(signed, "node"))
    key = ["root", "buckets"]
    blocks = signed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SIGNATURES).cast("int").alias("blocks"))
    rows = splitting_join(signed, blocks, *key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "signature")
    group, least = [*key, "i", "j"], least_alike(percent, REGISTERS)

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, signs = None, [], [], []

        def done() -> pa.RecordBatch:
            across = np.array(sides)
            found = alike_links(np.frombuffer(b"".join(signs), np.uint64).reshape(len(signs), -1), across if now[2] != now[3] else None, least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in group), strict=True)
            for name, side, node, sign in zip(names, *(batch.column(c).to_pylist() for c in ("block", "node", "signature")), strict=True):
                if name != now:
                    if len(nodes) > 1:
                        yield done()
                    now, nodes, sides, signs = name, [], [], []
                nodes.append(node)
                sides.append(side)
                signs.append(sign)
        if len(nodes) > 1:
            yield done()

    return components(rows.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(link, "a long, b long"))


def met(members: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links that span what is near among the classes of each (root, i, j): rows root, i, j, side, set_key, label, text.

    Null sides: all pairs; else those across sides. label: the component that a class is known to be in, or null.
    """
    dealt = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "set_key")

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sides, labels, sets = None, [], [], [], []

        def done() -> pa.RecordBatch:
            number: dict = {}
            label = np.array([number.setdefault((k,) if own is None else own, len(number)) for k, own in zip(keys, labels, strict=True)])
            found = spanning_links(sets, None if sides[0] is None else np.array(sides), percent, label)
            return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], ["a", "b"])

        for part in text_chunks(batches):
            hashed = shingle_hashes([ascii_lower(t) for t in part.column("text").to_pylist()], width)
            names = zip(*(part.column(c).to_pylist() for c in ("root", "i", "j")), strict=True)
            for name, side, key, label, own in zip(names, *(part.column(c).to_pylist() for c in ("side", "set_key", "label")), hashed, strict=True):
                if name != group:
                    if len(keys) > 1:
                        yield done()
                    group, keys, sides, labels, sets = name, [], [], [], []
                if not keys or (keys[-1], sides[-1]) != (key, side):  # a repeated row brings a class twice
                    keys.append(key)
                    sides.append(side)
                    labels.append(label)
                    sets.append(own)
        if len(keys) > 1:
            yield done()

    return dealt.mapInArrow(confirm, "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b: near pairs of set keys that span each component. classes: set_key, doc_id, tie, n_shingles, bands; one row for each set."""
    # Clusters are made of 64-bit names of sets: two sets with one name would only share a cluster.
    clusters = clusters_of(classes, percent)
    sizes = classes.select("set_key", "doc_id", "tie", "n_shingles", F.xxhash64("set_key").alias("node"))
    grouped = staged(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).join(sizes, "node"))
    weight = lambda n: F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    placed = splitting_join(grouped, grouped.groupBy("root").agg(weight(F.count(F.lit(1))).alias("blocks")), "root")
    placed = staged(placed.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")))
    # All texts are shuffled once, at every size (a small side would be broadcast); those of clusters are written, for the second meeting needs some of them again.
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    members = staged(placed.join(texts.hint("merge"), placed["doc_id"].eqNullSafe(texts["d"]) & (placed["tie"] == texts["h"])).select("root", "node", "blocks", "block", "set_key", "n_shingles", "text"))
    every = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = members.select("root", F.explode(every).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("int").alias("side"), "set_key", F.lit(None).cast("binary").alias("label"), "text")
    large = placed.where("blocks > 1").select("root", "node", "blocks", "block", "set_key", "n_shingles")
    if not large.take(1):
        return met(first, width, percent)
    found = staged(met(first, width, percent))
    labels = components(found).withColumnsRenamed({"node": "set_key", "root": "label"})
    large = staged(large.join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key")))
    main = large.where("node = root").groupBy("root").agg(F.min("label").alias("main"))
    left = staged(splitting_join(large, main, "root").where("label <> main").drop("main"))
    if not left.take(1):
        return found
    parts = left.groupBy("root").agg(weight(F.count(F.lit(1))).alias("parts"))
    ones = splitting_join(left, parts, "root").withColumn("i", F.pmod(F.xxhash64("set_key", F.lit(2)), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    others = splitting_join(large, parts, "root").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.col("block")).withColumn("side", F.lit(1))
    names = ["root", "i", "j", "side", "set_key", "label"]
    again = ones.select(*names).unionByName(others.select(*names)).join(members.where("blocks > 1").select("set_key", "text").dropDuplicates(["set_key"]), "set_key")
    return found.unionByName(met(again, width, percent))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document (columns doc_id, text), with tie, the hash of its text, and root, the component's least set.

    Texts without words have no shingles and are their own component. Equal ids with other texts are rows of
    their own; a null id counts as no id: such a row's component has the least id of the others, or null.
    """
    spark = docs.sparkSession
    least_alike(percent)  # refuses thresholds that the bands can't serve, before any work
    found = staged(sets_of(docs, width, percent), f"{shared_folder(spark)}/sets")
    some = found.where("set_key is not null")
    classes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "tie")).alias("one"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = staged(classes.select("set_key", "one.*", "least", "n_shingles", "bands"), f"{shared_folder(spark)}/classes")
    roots = components(links(docs, classes, width, percent))
    named = classes.select("set_key", "least").join(roots, F.col("set_key") == F.col("node"), "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = splitting_join(named, least, "root").select("set_key", "root", "component_id")
    out = found.select("doc_id", "tie", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "tie", "root")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row for each document, as near_duplicates tells them."""
    return near_duplicates(docs).drop("tie", "root")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their component, with their own columns; of rows with the same id one stays.

    A component whose rows all have no id keeps one of them (of the least text hash); rows with neither an id nor words all stay.
    """
    rows = staged(near_duplicates(docs, percent=percent))
    known = rows.where("kept").groupBy("doc_id").agg(F.min("tie").alias("tie"))
    unknown = rows.where("component_id is null and root is not null").groupBy("root").agg(F.min("tie").alias("tie"))
    kept = known.unionByName(unknown.select(F.lit(None).cast("long").alias("doc_id"), "tie").distinct())
    # The join and the dropping of repeated rows have the same keys, without nulls, and so one shuffle of the texts.
    keys = ["__id", "__none", "__tie"]
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), F.col("tie").alias(keys[2]))
    i = F.col("doc_id").cast("long")
    own = docs.withColumns({keys[0]: F.coalesce(i, F.lit(0)), keys[1]: i.isNull(), keys[2]: F.xxhash64(F.col("text").cast("string"))})
    stay = own.join(kept, keys, "left_semi").dropDuplicates(keys)
    wordless = own.where(F.col("__none") & ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return stay.unionByName(wordless).select(*docs.columns)
