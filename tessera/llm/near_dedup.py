"""Near-duplicate groups by BagMinHash bands and exact multiset overlap.

Documents are multisets of five-word shingles. (1) Texts with equal words form classes; one of a class goes on, under
a key of its own (ids may repeat).
(2) Bands of a weighted-Jaccard signature give candidates. All members of a bucket are first compared with one leader only, so a bucket of n
costs n pairs: the one with most company in all its buckets, which is the middle of a cloud of copies;
(3) links are verified on the texts and joined to groups; (4) members in different groups that were both
compared with a leader can only be alike if their differences from that leader share an element (see
Differences), so only such pairs are compared. All members of a bucket have its leader in common.
The pairs of step 4 are left out where lengths rule the threshold out, which is exact, or where the signatures' sketches do, which loses
a pair at the threshold once in ten million (SKETCH); the bands lose one in 140,000.

Differences. Let |x ^ y| be the size of the symmetric difference of two multisets. x and y are linked when
|x ^ y| <= R (|x| + |y|), R = (1 - T) / (1 + T). For a leader c let X = x ^ c and Y = y ^ c; then
|x ^ y| = |X| + |Y| - 2 |X & Y| and |y| <= |c| + |Y|. If x is not linked with c, E = |X| - R (|x| + |c|) > 0, and
a link of x and y needs |X & Y| >= (E + (1 - R) |Y|) / 2, which is more than (1 - R) |Y| / 2, and at least E / (1 + R). So by the prefix
principle X and Y share one of the first |X| - need + 1 elements of X and one of the first |Y| - need + 1 of Y in any common
order. Elements that x adds to c come first, since others rarely add the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bagminhash import mix, signatures
from tessera.llm.common import arrow_rows, chunks, give_back, read, written

WORDS, THRESHOLD = 5, 0.8
RATIO = (1 - THRESHOLD) / (1 + THRESHOLD)
#: Signature: BANDS x WIDTH registers (a pair at 0.8 shares no band once in 140,000), and the PLANES lowest bits of 128 of them as sketches, two 64-bit words a plane.
BANDS, WIDTH = 30, 5
PLANES = 4
SKETCHES = [f"s{i}" for i in range(2 * PLANES)]
#: Registers of the sketches that may differ: of a pair at 0.8 they are 24 of 128 on average; more than this happens once in ten million such pairs.
SKETCH = 51
#: Text of about this many bytes is worked on at once, and rows with texts in a batch at most.
CHUNK, BATCH = 1_000_000, 500
#: The same for rows with one text that is signed.
SIGNED = 2000
#: Pairs that one part of a leader's members has on average at most, and the least number of parts.
PART_PAIRS, PARTS = 20_000, 64


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(doc, shingle, count) sorted by doc, and a digest of each text's words. Words are lower-cased runs of non-space; texts of under five words are one shingle, texts without words have none."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))))
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[code]
    empty = np.fromiter((not w for w in names), bool, len(names))[code]
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))
    word, doc = word[~empty], doc[~empty]
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    position = np.arange(len(word)) - first[doc]
    whole = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        at = np.minimum(np.arange(len(word)) + k, max(len(word) - 1, 0))
        inside = position + k < counts[doc]
        whole = np.where(inside, mix(whole * np.uint64(0x100000001B3) + word[at] + np.uint64(k)), whole)
    is_start = (position == 0) | (position + WORDS <= counts[doc])
    doc, whole = doc[is_start], whole[is_start]
    order = np.lexsort((whole, doc))
    doc, whole = doc[order], whole[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])])) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(doc)))
    raw, edges = word.tobytes(), np.append(first, len(word)) * 8
    digests = [hashlib.blake2b(raw[edges[i] : edges[i + 1]], digest_size=16).digest() for i in range(n)]
    return doc[head], whole[head], count, digests


def described(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, mark (hash of the text), digest of the words, weight (number of shingles), SKETCHES, bands (a hash for each band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, 1, CHUNK)):
            n = batch.num_rows
            doc, shingle, count, digests = shingles(batch.column(1))
            sig = signatures(doc, shingle, count, n, BANDS * WIDTH)
            bits = np.concatenate([(sig[:, :128] >> np.uint64(k)) & np.uint64(1) for k in range(PLANES)], axis=1).astype(np.uint8)
            sketch = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            band = np.zeros((n, BANDS), np.uint64)
            for k in range(WIDTH):
                band = mix(band * np.uint64(31) + sig.reshape(n, BANDS, WIDTH)[:, :, k])
            band += np.arange(BANDS, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band.view(np.int64).ravel()))
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(weight), *(pa.array(x) for x in sketch.T), lists], ["id", "mark", "digest", "weight", *SKETCHES, "bands"])
        give_back()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return own.mapInArrow(sign, f"id long, mark long, digest binary, weight long, {', '.join(f'{s} long' for s in SKETCHES)}, bands array<long>")


def _sketches_near(a: str, b: str) -> Column:
    """Whether at most SKETCH registers differ in some plane; a and b are prefixes of the columns' names."""
    words = [reduce(Column.bitwiseOR, [F.col(a + s).bitwiseXOR(F.col(b + s)) for s in SKETCHES[k::2]]) for k in range(2)]
    return F.bit_count(words[0]) + F.bit_count(words[1]) <= SKETCH


def differences(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each pair of texts (leader, member): similarity, sizes of both, added and missing elements of the member, and these elements' hashes (added ones have the low bit) with their offsets."""
    (d1, s1, c1, _), (d2, s2, c2, _) = shingles(a), shingles(b)
    n = len(a)
    doc, key = np.concatenate([d1, d2]), np.concatenate([s1, s2])
    left, right = np.concatenate([c1, np.zeros_like(c2)]), np.concatenate([np.zeros_like(c1), c2])
    order = np.lexsort((key, doc))
    doc, key, left, right = doc[order], key[order], left[order], right[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    if len(head):
        left, right = np.add.reduceat(left, head), np.add.reduceat(right, head)
    doc, key = doc[head], key[head]
    size_a, size_b = (np.bincount(doc, weights=w, minlength=n).astype(np.int64) for w in (left, right))
    shared = np.bincount(doc, weights=np.minimum(left, right), minlength=n).astype(np.int64)
    more = np.abs(right - left)
    number = np.repeat(np.arange(len(more)), more)
    occurrence = np.minimum(left, right)[number] + np.arange(len(number)) - np.repeat(np.cumsum(more) - more, more)
    added = (right > left)[number]
    element = (mix(key[number] + mix(occurrence.astype(np.uint64))) & ~np.uint64(1)) | added.astype(np.uint64)
    doc = doc[number]
    order = np.lexsort((element, ~added, doc))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)
    similarity = np.where(size_a + size_b > shared, shared / np.maximum(size_a + size_b - shared, 1), 1.0)
    return similarity, size_a, size_b, np.bincount(doc[added], minlength=n), np.bincount(doc[~added], minlength=n), element[order], offsets


def _prefixes(element: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The first keep[i] elements of each list."""
    keep = np.clip(keep, 0, np.diff(offsets))
    ends = np.cumsum(keep)
    at = np.repeat(offsets[:-1] - (ends - keep), keep) + np.arange(int(keep.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(element[at].view(np.int64)))


COMPARED = "a long, b long, similarity double, size_b long, added long, missing long, probe array<long>, lookup array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """COMPARED for pairs (leader a, member b, with its SKETCHES): probe (for members that are not linked) and lookup are the prefixes of the difference from the leader."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, (2, 3), CHUNK)):
            similarity, size_a, size_b, added, missing, element, offsets = differences(batch.column(2), batch.column(3))
            total = added + missing
            excess = total - RATIO * (size_a + size_b)
            probe = _prefixes(element, offsets, np.where(similarity < THRESHOLD, total - np.maximum(1, np.ceil(excess / (1 + RATIO) - 1e-9)).astype(np.int64) + 1, 0))
            lookup = _prefixes(element, offsets, total - np.floor((1 - RATIO) * total / 2 - 1e-9).astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(similarity), pa.array(size_b), pa.array(added), pa.array(missing), probe, lookup, *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COMPARED.split(", ")])
        give_back()

    return _with_texts(pairs, texts).mapInArrow(compare, COMPARED)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, the texts of both and further columns of pairs (a written table); texts has one row per id. A leader's members are dealt to parts by a hash, and its text goes once to each part that has any."""
    parts = max(PARTS, -(-pairs.count() // PART_PAIRS))
    dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    left = dealt.select("a", "_part").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("_tb"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return dealt.join(right, "b").join(left, ["a", "_part"]).select("a", "b", "_ta", "_tb", *rest)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts overlap by THRESHOLD or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, (2, 3), CHUNK)):
            linked = pa.array(differences(batch.column(2), batch.column(3))[0] >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(linked), batch.column(1).filter(linked)], ["a", "b"])
        give_back()

    return _with_texts(pairs, texts).mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): for every linked id the smallest id it is connected with.

    Large-star and small-star steps in turn until nothing changes; an id's neighbours are never gathered, only their minimum
    (with map-side combine), and each step's links are written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", few=True)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large", few=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "small", few=True)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
        before = state


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, mark (xxhash64 of the text), class_id (smallest id with equal words), group_id (smallest id of its near-duplicate group),
    n_links (links verified at its class), kept (whether the row has the group's smallest id and, of that id's texts there, the smallest mark).

    Null texts count as empty; all texts without words are one class. Rows that share an id are judged each by its own text; rows repeated in full
    share their fate. Null ids stay alone (class_id and group_id null, kept). Other columns of docs are not read, so their names don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, SIGNED):
        signed = written(described(docs, id_col, text), "signed")
    first = signed.where("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("m"), F.max("weight").alias("weight"))
    # The key of a class, fixed by being written.
    first = written(first.select("digest", F.col("m.id").alias("class_id"), F.col("m.mark").alias("class_mark"), "weight", F.monotonically_increasing_id().alias("key")), "classes", few=True)
    own = first.where("weight > 0").select("digest", F.col("class_id").alias("id"), F.col("class_mark").alias("mark"), "key")
    reps = signed.join(own, ["digest", "id", "mark"]).dropDuplicates(["key"])
    members = written(reps.select(F.col("key").alias("id"), F.explode("bands").alias("band")), "members", few=True)
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = members.join(sizes, "band")
    company = written(shared.groupBy("id").agg(F.sum("n").alias("company")), "company", few=True)
    known = reps.join(company.withColumnRenamed("id", "key"), "key").select(F.col("key").alias("id"), F.struct(F.col("key").alias("id"), "weight", *SKETCHES).alias("m"), "company")
    shared = written(shared.join(known, "id").select("band", "m", "company"), "shared", few=True)
    leads = shared.groupBy("band").agg(F.min(F.struct(-F.col("company"), "m")).alias("best")).select("band", F.col("best.m.id").alias("a"))
    star = shared.join(leads, "band").where("m.id <> a").select("a", F.col("m.id").alias("b"), *[f"m.{s}" for s in SKETCHES]).distinct()
    star = written(star, "star", few=True)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    texts = _texts_of(texts, own, star)
    with arrow_rows(spark, BATCH):
        seen = written(compared(star, texts), "compared")
    links = written(_both_ways(seen.where(F.col("similarity") >= THRESHOLD)).distinct(), "links", few=True)
    labels = written(components(links), "labels", few=True)
    cross = written(_apart(seen, labels).distinct().join(_both_ways(star), ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        with arrow_rows(spark, BATCH):
            links = written(links.unionByName(verified(cross, texts)), "links2")
        labels = written(components(links), "labels2", few=True)
    counts = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = first.join(labels.withColumnRenamed("id", "key"), "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = rooted.groupBy("root").agg(F.min(F.struct("class_id", "class_mark")).alias("head"))
    known = rooted.join(heads, "root").select("digest", "class_id", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("id", "mark", "digest").join(known, "digest", "left")
    alone = F.col("id").isNull()
    of = lambda c: F.when(~alone, F.col(c))
    kept = alone | ((F.col("id") == F.col("head.class_id")) & (F.col("mark") == F.col("head.class_mark")))
    return out.select("id", "mark", of("class_id").alias("class_id"), of("head.class_id").alias("group_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"), kept.alias("kept"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members of one leader, in different groups, whose differences from it allow a link."""
    rooted = seen.join(labels.withColumnRenamed("id", "_id"), F.col("b") == F.col("_id"), "left").withColumn("root", F.coalesce("root", "b")).drop("_id")
    failed = F.col("similarity") < THRESHOLD
    # Of use are leaders with a member that failed and members of more than one group.
    crowded = rooted.groupBy("a").agg(F.max(failed).alias("_failed"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_failed AND _low < _high").select("a")
    x = rooted.join(crowded, "a", "left_semi").where(failed).select("a", F.col("b").alias("x"), F.col("root").alias("rx"), F.col("size_b").alias("nx"), F.col("added").alias("ax"), F.col("missing").alias("mx"), *[F.col(s).alias(f"x{s}") for s in SKETCHES], F.posexplode("probe").alias("i", "e"))
    y = rooted.join(crowded, "a", "left_semi").select("a", F.col("b").alias("y"), F.col("root").alias("ry"), failed.alias("fy"), F.col("size_b").alias("ny"), F.col("added").alias("ay"), F.col("missing").alias("my"), *[F.col(s).alias(f"y{s}") for s in SKETCHES], F.posexplode("lookup").alias("j", "e"))
    # A cell (a, e) whose other side has members of the same group only holds no pair; that takes a cloud of copies out before it meets itself.
    x, y = _with_others(x, "rx", y, "ry"), _with_others(y, "ry", x, "rx")
    need = (F.col("ax") + F.col("mx") + F.col("ay") + F.col("my") - RATIO * (F.col("nx") + F.col("ny"))) / 2 - 1e-9
    # A pair is judged where its first common element is met: what else it shares comes later in both, added elements before missing ones.
    added = F.col("e").bitwiseAND(F.lit(1)) == 1
    later = F.least(F.col("mx") - (F.col("i") - F.col("ax")), F.col("my") - (F.col("j") - F.col("ay")))
    most = F.when(added, F.least(F.col("ax") - F.col("i"), F.col("ay") - F.col("j")) + F.least("mx", "my")).otherwise(later)
    near = _sketches_near("x", "y") & (F.least("nx", "ny") >= F.ceil(F.greatest("nx", "ny") * THRESHOLD))
    fits = (F.col("rx") != F.col("ry")) & (~F.col("fy") | (F.col("x") < F.col("y"))) & (need <= most) & near
    return x.join(y, ["a", "e"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _with_others(rows: DataFrame, root: str, others: DataFrame, other_root: str) -> DataFrame:
    """The rows whose cell (a, e) has one of `others` in another group."""
    bounds = others.groupBy("a", "e").agg(F.min(other_root).alias("_low"), F.max(other_root).alias("_high"))
    return rows.join(bounds, ["a", "e"]).where((F.col("_low") != F.col(root)) | (F.col("_high") != F.col(root))).drop("_low", "_high")


def _texts_of(texts: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the keys of pairs, one row each, as a written table. own tells the id and mark of the text that stands for a key. Rows repeated in full meet before the one shuffle of the texts."""
    keys = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "key")
    once = texts.where("id IS NOT NULL").groupBy("id", "mark").agg(F.min("text").alias("text"))
    return written(once.join(own.select("key", "id", "mark").join(keys, "key"), ["id", "mark"]).select(F.col("key").alias("id"), "text"), "texts")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "group_id", "n_links", "kept")
