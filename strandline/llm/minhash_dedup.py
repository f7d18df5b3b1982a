"""MinHash near-dedup with odd sketches.

1. Each document has the set of its distinct word shingles, as 64-bit hashes. Documents with one set are one class.
2. MinHash values in bands give candidates. Within a band's group every class is compared with the group's least
   class first: a star instead of all pairs.
3. MinHash samples are also folded into odd sketches, bitmaps in which each sampled shingle flips one bit. The number of
   ones in the XOR of two sketches tells how many samples differ, so pairs below the threshold leave before their sets are
   compared. There are two samples: the least hash of each of BINS bins, and, for pairs of up to WHOLE shingles together, all
   shingles (a bottom-k sample with k above the size), where the ones are never more than the shingles that differ.
4. Pairs that stay are confirmed on full sets.
5. Groups whose classes are not in one component yet are searched for further pairs across components, the
   likeliest first, until all pairs that the sketches let pass are either confirmed or within a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bloom, shared
from strandline.llm import textbytes as tb
from strandline.llm.components import components

#: Bins of the sample, words of 64 bits in each sketch, and most shingles of a pair whose sketches of all shingles are compared.
BINS, SKETCH, WHOLE = 512, 16, 1600
#: Standard deviations by which the estimate from bins may fall short and the pair still passes.
SLACK = 5
#: Pairs of one first document for a task, and rows of either side of one band; larger bands are dealt out as a grid of
#: parts of the asking rows by parts of all rows, so that a task compares ROWS by ROWS at most.
PAIRS, ROWS = 2000, 3000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: MinHash values that there are seeds for.
VALUES = 1024
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, VALUES), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of fewer words, the whole sequence is one shingle."""
    data = _LOWER[data]
    starts, ends, at = tb.words(data, offsets)
    prefix = tb.sums(tb.word_hashes(data, starts, ends))
    full = tb.mix(tb.fixed_spans(prefix, size))
    out = []
    for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if q - p >= size:
            out.append(np.unique(full[p : q - size + 1]))
        elif q > p:
            out.append(tb.mix(tb.spans(prefix, np.array([p]), np.array([q])), q - p))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhashes(values: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 2048):
        x = (values[None, k : k + 2048] ^ _SEEDS[0, :n, None]) * (_SEEDS[1, :n, None] | np.uint64(1))
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _parity(values: np.ndarray) -> np.ndarray:
    hits = (tb.mix(values, 5) >> np.uint64(40)) % np.uint64(64 * SKETCH)
    bits = np.bincount(hits.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Of a sorted set of hashes: the parity of all of them, and of the least of each bin."""
    bins = (values & np.uint64(BINS - 1)).astype(np.int64)
    least = np.zeros(BINS, np.uint64)
    least[bins[::-1]] = values[::-1]  # of values with one bin the first, the least, is written last
    used = np.zeros(BINS, bool)
    used[bins] = True
    return np.concatenate([_parity(values), _parity(least[used])])


def _expected(flips, exp):
    n = 64 * SKETCH
    return (1 - exp(flips * math.log1p(-2 / n))) * (n / 2)


def most_ones_whole(both, similarity: float, exp=np.exp, least=np.minimum):
    """Most ones in the XOR of the sketches of all shingles of two sets this similar, by the sum of their sizes."""
    differ = both * ((1 - similarity) / (1 + similarity)) + 1e-6
    return least(differ, _expected(differ, exp) + differ * (SLACK / math.sqrt(64 * SKETCH)) + 1)


def most_ones_bins(smaller, similarity: float, exp=np.exp, sqrt=np.sqrt):
    """Most ones in the XOR of the sketches of bins of two sets this similar, by the size of the smaller set, but for SLACK deviations."""
    bins = (1 - exp(smaller * (-1 / similarity / BINS))) * BINS + 3
    differ = bins * (1 - similarity) + sqrt(bins * (similarity * (1 - similarity))) * SLACK
    ones = _expected(differ * 2, exp)
    return ones + sqrt(ones) * 2 + 1


def _signatures(size: int, bands: int, rows: int):
    @tb.task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id")
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
                keys, n, band, sketch = [], [], [], []
                for values in shingle_sets(data, offsets, size):
                    keys.append(set_key(values))
                    n.append(len(values))
                    if not len(values):
                        band.append(None)
                        sketch.append(None)
                        continue
                    least = minhashes(values, bands * rows)
                    joined = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        joined = tb.mix(joined ^ least[r::rows], r)
                    band.append(joined.view(np.int64))
                    sketch.append(odd_sketches(values).view(np.int64))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["id", "key", "n", "bands", "sketch"])

    return run


def _keyed(size: int):
    """Rows without doc_id, with the key and the size of their set."""

    @tb.task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("__row")
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
                sets = shingle_sets(data, offsets, size)
                yield pa.record_batch([row.slice(i, j - i), pa.array([set_key(v) for v in sets], pa.binary()), pa.array([len(v) for v in sets], pa.int64())], names=["__row", "key", "n"])

    return run


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values, digest_size=16).digest()


def _named(filter_bytes):
    @tb.task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id")
            ok = bloom.passes(filter_bytes.value, tb.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 9))
            yield pa.record_batch([ids, batch.column("__text")], names=["id", "text"]).filter(pa.array(ok & ids.is_valid().to_numpy(zero_copy_only=False)))

    return run


@tb.task("minhash_dedup")
def _mixed(ids: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ids:
        yield pa.record_batch([tb.long_array(tb.mix(batch.column("id").to_numpy().view(np.uint64), 9))], names=["key"])


def _confirm(size: int, part: int, whole: int):
    """Rows sorted by (a, salt, b): the text of a comes first, with b null."""

    @tb.task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for batch in batches:
            a, salt, b = batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist()
            for i, _, data, offsets in tb.chunks(batch, batch.schema.get_field_index("text")):
                found = []
                for k, values in enumerate(shingle_sets(data, offsets, size), i):
                    if b[k] is None:
                        now, mine = (a[k], salt[k]), values
                        continue
                    assert now == (a[k], salt[k]), "the first document's text is missing"
                    both = len(np.intersect1d(mine, values, assume_unique=True))
                    if whole * both >= part * (len(mine) + len(values) - both):
                        found.append((a[k], b[k]))
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) with whole * |intersection| >= part * |union| of their full sets. A frequent a is dealt out."""
    parts = F.ceil(F.col("n") / PAIRS).cast("int")
    n = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
    firsts = n.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")).join(texts.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "salt", "text")
    others = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "salt", "text")
    dealt = firsts.unionByName(others).repartition(shared.partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_confirm(size, part, whole), "a long, b long")


def _across(similarity: float, most: int):
    """Pairs across components within parts of bands' groups: for each asking row its likeliest ``most``.

    Rows come sorted by (band, part); one part of one group is held at a time.
    """

    def pairs(ids: np.ndarray, comps: np.ndarray, n: np.ndarray, asks: np.ndarray, sketch: np.ndarray) -> tuple[list, list, bool]:
        members = np.flatnonzero(~asks)
        sketch_of, id_of, comp_of, n_of = sketch[members], ids[members], comps[members], n[members]
        a, b, cut = [], [], False
        for k in np.flatnonzero(asks).tolist():
            fit = np.flatnonzero((comp_of != comps[k]) & (np.maximum(n_of, n[k]) * similarity <= np.minimum(n_of, n[k])))
            ones = np.bitwise_count(sketch_of[fit] ^ sketch[k]).reshape(-1, 2, SKETCH).sum(axis=2)
            both, least = n_of[fit] + n[k], np.minimum(n_of[fit], n[k])
            whole = both <= WHOLE
            near = np.where(whole, ones[:, 0] <= most_ones_whole(both, similarity), ones[:, 1] <= most_ones_bins(least, similarity))
            differ, ok = np.where(whole, ones[:, 0], ones[:, 1])[near], fit[near]
            if len(ok) > most:
                cut, ok = True, ok[np.argsort(differ, kind="stable")[:most]]
            a.append(np.minimum(ids[k], id_of[ok]))
            b.append(np.maximum(ids[k], id_of[ok]))
        return a, b, cut

    @tb.task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out_a, out_b, cut_bands = [], [], []

        def take() -> pa.RecordBatch:
            nonlocal out_a, out_b, cut_bands
            both = np.unique(np.column_stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=0) if out_a else np.empty((0, 2), np.int64)
            more = [None] * len(cut_bands)
            batch = pa.record_batch([pa.array([*both[:, 0].tolist(), *more], pa.int64()), pa.array([*both[:, 1].tolist(), *more], pa.int64()), pa.array([None] * len(both) + cut_bands, pa.int64())], names=["a", "b", "cut"])
            out_a, out_b, cut_bands = [], [], []
            return batch

        def close() -> None:
            if held:
                a, b, cut = pairs(*[np.concatenate([h[k] for h in held]) for k in range(5)])
                out_a.extend(a)
                out_b.extend(b)
                if cut:
                    cut_bands.append(now[0])
                held.clear()

        now = None
        for batch in batches:
            key = np.column_stack([batch.column("band").to_numpy(), batch.column("part").to_numpy()])
            ids, comps, n = [batch.column(c).to_numpy() for c in ("id", "comp", "n")]
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            sketch = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, 2 * SKETCH)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if p == q:
                    continue
                if tuple(key[p].tolist()) != now:
                    close()
                    now = tuple(key[p].tolist())
                held.append((ids[p:q], comps[p:q], n[p:q], asks[p:q], sketch[p:q]))
            if sum(map(len, out_a)) > 100_000:
                yield take()
        close()
        yield take()

    return run


def similarity_links(nodes: DataFrame, docs: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """(id, comp) of all nodes (id, n, bands, sketch) that have a link; docs: __id, __text."""
    spark = nodes.sparkSession
    similarity = part / whole
    rows = nodes.select("id", F.explode("bands").alias("band"))
    groups = rows.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = shared.keep(rows.join(groups, "band").select("band", "lead", "id"), "members")
    sketches = nodes.select("id", "n", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = [sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
        ones = [sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(at + 1, at + SKETCH)), F.bit_count(F.col("sa")[at].bitwiseXOR(F.col("sb")[at]))) for at in (0, SKETCH)]
        least, both = F.least("na", "nb").cast("double"), (F.col("na") + F.col("nb")).cast("double")
        alike = F.when(both <= WHOLE, ones[0] <= most_ones_whole(both, similarity, F.exp, F.least)).otherwise(ones[1] <= most_ones_bins(least, similarity, F.exp, F.sqrt))
        return pairs.join(a, "a").join(b, "b").filter((F.greatest("na", "nb") * similarity <= least) & alike).select("a", "b")

    star = members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tested = shared.keep(near(star), "pairs")
    wanted = members.select("id").distinct()
    keys = wanted.mapInArrow(_mixed, "key long")
    n = members.agg(F.approx_count_distinct("id")).first()[0]
    texts = shared.keep(docs.mapInArrow(_named(spark.sparkContext.broadcast(bloom.build(keys, "key", n))), "id long, text string").join(wanted, "id", "left_semi"), "texts")
    links = shared.keep(confirm(tested, texts, size, part, whole), "links")
    most, labels = 1, components(links)
    while True:
        labelled = members.join(labels, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
        open_bands = labelled.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("top"), F.mode("comp").alias("main"), F.count("*").alias("size")).filter("least < top")
        rows_of = shared.keep(labelled.join(open_bands, "band").select("band", "id", "comp", (F.col("comp") != F.col("main")).alias("asking")), "open")
        grid = rows_of.groupBy("band").agg(F.ceil(F.count_if("asking") / ROWS).cast("int").alias("down"), F.ceil(F.count("*") / ROWS).cast("int").alias("across"))
        open_rows = rows_of.join(grid, "band").join(sketches, "id")
        place = lambda side: F.pmod(F.xxhash64("id"), F.col(side)).cast("int")
        each = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
        held = open_rows.withColumn("d", each("down")).select("band", "id", "comp", "n", "sketch", F.lit(False).alias("asks"), (F.col("d") * F.col("across") + place("across")).alias("part"))
        asking = open_rows.filter("asking").withColumn("a", each("across")).select("band", "id", "comp", "n", "sketch", F.lit(True).alias("asks"), (place("down") * F.col("across") + F.col("a")).alias("part"))
        dealt = held.unionByName(asking).repartition(shared.partitions(spark), "band", "part").sortWithinPartitions("band", "part")
        found = shared.keep(dealt.mapInArrow(_across(similarity, most), "a long, b long, cut long"), "across")
        more = shared.keep(found.filter("a IS NOT NULL").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            old = (links, tested)
            links = shared.keep(links.unionByName(confirm(more, texts, size, part, whole)), "links")
            tested = shared.keep(tested.unionByName(more), "pairs")
            shared.drop(spark, *old, more, rows_of)
            labels = components(links)
        cut = found.filter("cut IS NOT NULL").select(F.col("cut").alias("band")).distinct()
        if cut.isEmpty():  # all pairs across components that pass have been compared
            shared.drop(spark, texts, links, tested, found)
            return labels
        members = members.join(cut, "band", "left_semi")
        most *= 64


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, part: int = 80, whole: int = 100, bands: int = 21, rows: int = 3, with_text: bool = True) -> DataFrame:
    """Link documents with whole * |intersection| >= part * |union| of their sets of distinct word shingles.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. ``bands`` of ``rows`` MinHash
    values miss a pair at 0.8 with a chance of (1 - 0.8**3)**21 = 3e-7; links are confirmed on full sets.

    Returns the columns of ``docs`` (without the text if so asked), n_shingles, component_id (least doc_id that links reach, its own included) and kept
    (doc_id = component_id). Columns of these names are replaced. Null and wordless texts have an empty set and are
    linked with nothing. Equal texts are linked. Rows with one doc_id count as one document. A row without doc_id gets
    the component of an equal text that has one, if any, or else null, and is then kept. An empty table gives an empty one.
    """
    if bands * rows > VALUES:
        raise ValueError(f"bands * rows must be {VALUES} at most")
    shared.lean(docs.sparkSession)
    packed = shared.packed(docs, doc_id, text)
    plain = packed.select(F.col(f"__{doc_id}").cast("long").alias("__id"), F.col(f"__{text}").alias("__text"))
    signed = shared.keep(plain.mapInArrow(_signatures(shingle, bands, rows), "id long, key binary, n long, bands array<long>, sketch array<long>"), "signatures")
    classes = shared.keep(signed.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    nodes = signed.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"]).select("id", "n", "bands", "sketch").dropDuplicates(["id"])
    nodes = shared.keep(nodes, "nodes")
    labels = similarity_links(nodes, plain, shingle, part, whole)
    result = classes.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    verdicts = signed.select("id", "key", "n").join(result, "key", "left").select("id", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("component_id"))
    added = ["n_shingles", "component_id", "kept"]
    if not with_text and set(docs.columns) <= {doc_id, text}:  # nothing else to carry
        out = verdicts.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
        return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.col("component_id").isNull()))
    per_id = verdicts.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id")).filter("id IS NOT NULL")
    known = F.col(f"__{doc_id}").cast("long")
    named = packed.filter(known.isNotNull()).join(per_id.withColumnRenamed("id", "__match"), known == F.col("__match"))
    named = named.select("__row", *added[:2], (F.col("__match") == F.col("component_id")).alias("kept"))
    unnamed = packed.filter(known.isNull()).select("__row", F.col(f"__{text}").alias("__text"))
    keyed = unnamed.mapInArrow(_keyed(shingle), f"__row {packed.schema['__row'].dataType.simpleString()}, key binary, n long").join(result, "key", "left")
    unnamed = keyed.select("__row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).alias("component_id"))
    return shared.unpacked(named.unionByName(unnamed.withColumn("kept", F.col("component_id").isNull())), docs.columns, added, () if with_text else (text,))
