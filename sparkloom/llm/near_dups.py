"""MinHash near-duplicates with b-bit signatures.

1. Every text gives its set of word shingles as sorted 64-bit hashes, the minima of ``PERMUTATIONS`` hash functions over
   it, one key for each band of ``ROWS`` minima, and a packed signature of the low ``LOW_BITS`` bits of each minimum.
   With 48 bands of 5, two sets of similarity 0.8 share no band once in 200 million pairs.
2. Equal sets become one class by a digest, so a group of copies of any size is one row from here on.
3. Documents in a band bucket of their own drop out. The rest are linked in ``PASSES`` passes. In a pass the members of each
   bucket are put in a random order and neighbours of different components form candidate pairs; the signatures'
   similarity, corrected for chance collisions and counted with bit operations, and the sets' sizes leave out unlikely
   pairs, and each document keeps its likeliest ``BEST``. These are confirmed on the full sets, and the components they
   join become one. Pairs inside one component need no check, which spares the square of a group's size.
4. Components that likely pairs connect form a cluster. In a cluster, all documents outside its largest component are
   compared with all of it, in squares of bounded size: the full sets of both sides as 0-1 matrices, whose product has
   the exact intersections. Nothing is emitted but the links that join components.
5. What is left are likely pairs of different clusters that share a bucket; all of them are confirmed. So no link that
   shares a band and joins different components is lost.

Large buckets are split by a random salt for the ordering, and joins on bucket keys can be split by adaptive execution.

Cases: null, empty or blank texts have no shingles and link with nothing; a text of fewer words than a shingle is one
shingle; rows with a null key are kept, link with nothing and have a null component; repeated keys are one vertex; ties go
to the smallest key; an empty table gives an empty result. A very long text is hashed in steps, and a square takes as many
texts as have ``TILE_SHINGLES`` together, or one. Only the key and the text are read, so other columns may have any name.
``drop_near_duplicates`` keeps the other columns as they are, and takes rows with a null or repeated key as documents each.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, flat, fresh, materialise, setting, slices, table
from sparkloom.llm.components import components
from sparkloom.llm.words import LOWER, mix, shingle_sets

ROWS, BANDS, LOW_BITS = 5, 48, 4
PERMUTATIONS = ROWS * BANDS
#: Signatures are kept as bit planes: for 64 minima at a time a long for each of the low bits.
GROUPS = -(-PERMUTATIONS // 64)
LONGS = GROUPS * LOW_BITS
#: Deviations of the estimate by which a pair may fall short.
SLACK = 5.5
BEST = 2
SALTED = 1000
PASSES = 2
#: Documents on a side of a square that one task compares, shingles on a side, and shingles it takes at a time.
TILE, TILE_SHINGLES, CHUNK = 96, 1 << 20, 8192

#: Else the optimiser multiplies the terms of the estimate.
CALM = ("spark.sql.constraintPropagation.enabled", "false")

_DRAW = np.random.Generator(np.random.PCG64(77))
MULTIPLY = (_DRAW.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _DRAW.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 256):
        part = found[None, k : k + 256] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, of all bits of its minima; (n, PERMUTATIONS) to (n, BANDS)."""
    rows = least.reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def signatures(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed: (n, PERMUTATIONS) to (n, LONGS).

    The minima are mixed first: the low bits of ``x * a + b`` hang on those of ``x`` alone, so those of small sets' minima
    would not be independent.
    """
    low = np.zeros((len(least), GROUPS * 64), np.uint64)
    low[:, :PERMUTATIONS] = mix(least)
    low = low.reshape(len(least), GROUPS, 1, 64) >> np.arange(LOW_BITS, dtype=np.uint64)[:, None] & np.uint64(1)
    return (low << np.arange(64, dtype=np.uint64)).sum(axis=3, dtype=np.uint64).reshape(len(least), LONGS).view(np.int64)


def features(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, digest, sig0.., bands``; digest, signature and bands are null for an empty set."""
    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, n_shingles long, digest binary, " + "".join(f"sig{i} long, " for i in range(LONGS)) + "bands array<long>"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, at = flat(batch.column(0))
            sets = shingle_sets(LOWER[raw], at, words)
            least = np.array([minima(s) for s in sets]).reshape(len(sets), PERMUTATIONS)
            keys, packed = band_keys(least), signatures(least)
            none = np.array([not len(s) for s in sets])
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            flat_keys = pa.array(keys.ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat_keys, mask=pa.array(none))
            return pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *(pa.array(packed[:, i], mask=none) for i in range(LONGS)), bands],
                ["id", "n_shingles", "digest", *(f"sig{i}" for i in range(LONGS)), "bands"],
            )

        return step

    return arrow_map(docs.select(F.col(text).alias("text"), F.col(key).alias("id")), make, schema)


def estimate(a: str, b: str) -> Column:
    """Similarity by the signatures in the structs ``a`` and ``b``: share of equal minima, less chance collisions."""
    apart = F.lit(0)
    for g in range(GROUPS):
        planes = [F.col(f"{a}.sig{i}").bitwiseXOR(F.col(f"{b}.sig{i}")) for i in range(g * LOW_BITS, (g + 1) * LOW_BITS)]
        apart = apart + F.bit_count(functools.reduce(lambda x, y: x.bitwiseOR(y), planes))
    chance = 2.0**-LOW_BITS
    return ((1 - apart / PERMUTATIONS) - chance) / (1 - chance)


def likely(a: str, b: str, percent: int) -> Column:
    """The pair may reach the similarity: neither the sizes forbid it nor, but for ``SLACK`` deviations, the signatures."""
    least = percent / 100
    share = least + (1 - least) * 2.0**-LOW_BITS
    deviation = (share * (1 - share) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-LOW_BITS)
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (estimate(a, b) >= least - SLACK * deviation)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity. ``texts`` has ``id, text``."""
    first = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("text_a", "text_b", "a", "b")
    kinds = dict(pairs.dtypes)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            one, two = (shingle_sets(LOWER[raw], at, words) for raw, at in (flat(batch.column(0)), flat(batch.column(1))))
            linked = []
            for x, y in zip(one, two, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            keep = pa.array(linked, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(2).filter(keep), batch.column(3).filter(keep)], ["a", "b"])

        return step

    return arrow_map(both, make, f"a {kinds['a']}, b {kinds['b']}")


def crowded_buckets(classes: DataFrame) -> DataFrame:
    """``key, n, id``: the members of band buckets that hold more than one class."""
    rows = classes.select("id", F.explode("bands").alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(crowded, "key").select("key", "n", "id")


def neighbours(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidate pairs of a pass, ``a, b``: each bucket in a random order, of each ``b`` the likeliest."""
    salt = F.pmod(F.xxhash64("id", F.lit(turn + 1000)), F.ceil(F.col("n") / SALTED))
    ordered = members.withColumn("salt", salt).withColumn("order", F.xxhash64("id", "key", F.lit(turn)))
    bucket = Window.partitionBy("key", "salt").orderBy("order", "id")
    pairs = ordered.withColumn("before", F.lag("own").over(bucket)).where("before.component <> own.component").where(likely("before", "own", percent))
    pairs = pairs.groupBy(F.least("before.id", "own.id").alias("a"), F.greatest("before.id", "own.id").alias("b")).agg(F.max(estimate("before", "own")).alias("likeness"))
    best = Window.partitionBy("b").orderBy(F.desc("likeness"), "a")
    return pairs.withColumn("place", F.row_number().over(best)).select("a", "b", (F.col("place") <= BEST).alias("best"))


def pairs_between(members: DataFrame, percent: int) -> DataFrame:
    """Every likely pair of different clusters that shares a bucket."""
    mixed = members.groupBy("key").agg(F.min("own.cluster").alias("low"), F.max("own.cluster").alias("high")).where("low < high").select("key")
    members = members.join(mixed, "key", "left_semi")
    left = members.select("key", F.col("own").alias("before"))
    right = members.select("key", F.col("own"))
    apart = F.col("before.cluster") < F.col("own.cluster")
    return left.join(right, "key").where(apart & likely("before", "own", percent)).select(F.least("before.id", "own.id").alias("a"), F.greatest("before.id", "own.id").alias("b")).distinct()


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``id, component``) with the components that ``links`` (``a, b``) join made one."""
    return labels.join(joined_components(labels, links), "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``component, least``: of each component that ``links`` join with another, the least of them all."""
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("low")), "a").join(labels.select(F.col("id").alias("b"), F.col("component").alias("high")), "b")
    return components(ends.select("low", "high"), "low", "high").select(F.col("id").alias("component"), F.col("component").alias("least"))


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``, by products of 0-1 matrices."""
    found = np.zeros((len(one), len(two)), np.int64)
    if not one or not two:
        return found
    whole, back = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    shared = np.bincount(back, minlength=len(whole)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[back]
    back, owner = place[back[keep]], owner[keep]
    order = np.argsort(back, kind="stable")
    back, owner = back[order], owner[order]
    for low in range(0, int(shared.sum()), CHUNK):
        a, b = np.searchsorted(back, (low, low + CHUNK))
        held = np.zeros((len(one) + len(two), CHUNK), np.float32)
        held[owner[a:b], back[a:b] - low] = 1
        found += np.rint(held[: len(one)] @ held[len(one) :].T).astype(np.int64)
    return found


def compare_clusters(clustered: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join components of a cluster. ``clustered``: ``id, component, cluster, n_shingles``."""
    kinds = dict(clustered.dtypes)
    sizes = clustered.groupBy("cluster", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    largest = F.struct("k", "component", "s")
    sizes = sizes.groupBy("cluster").agg(F.max(largest).alias("top"), F.sum("k").alias("n"), F.sum("s").alias("s")).where("n > top.k")
    parts = lambda n, s: F.greatest(F.ceil(n / TILE), F.ceil(s / TILE_SHINGLES))
    sizes = sizes.select("cluster", F.col("top.component").alias("largest"), parts(F.col("n") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("rows"), parts(F.col("n"), F.col("s")).alias("columns"))
    docs = clustered.join(sizes, "cluster")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = docs.where("component <> largest").withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), "rows")).withColumn("y", every("columns")).withColumn("outside", F.lit(True))
    inside = docs.withColumn("y", F.pmod(F.xxhash64("id", F.lit(2)), "columns")).withColumn("x", every("rows")).withColumn("outside", F.lit(False))
    names = ["id", "component", "cluster", "x", "y", "outside"]
    dealt = outside.select(*names).unionByName(inside.select(*names)).join(texts, "id")

    def compare(group: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for batch in group.select(["text"]).to_batches():
            for part in slices(batch):
                raw, at = flat(part.column(0))
                sets += shingle_sets(LOWER[raw], at, words)
        side = group.column("outside").to_numpy()
        ids, parts = group.column("id").to_pylist(), group.column("component").to_pylist()
        one, two = np.flatnonzero(side).tolist(), np.flatnonzero(~side).tolist()
        common = common_counts([sets[i] for i in one], [sets[i] for i in two])
        size_one, size_two = np.array([len(sets[i]) for i in one]), np.array([len(sets[i]) for i in two])
        linked = (common > 0) & (100 * common >= percent * (size_one[:, None] + size_two[None, :] - common)) if one and two else np.zeros((0, 0), bool)
        up: dict = {}

        def root(c):
            while c in up:
                c = up[c]
            return c

        found = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = one[i], two[j]
            p, q = root(parts[a]), root(parts[b])
            if p != q:
                up[q] = p
                found.append((ids[a], ids[b]))
        kind = group.schema.field("id").type
        return pa.table([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], ["a", "b"])

    # by ranges, which hold about as many rows each; a square is never split
    return dealt.repartitionByRange("cluster", "x", "y").groupBy("cluster", "x", "y").applyInArrow(compare, f"a {kinds['id']}, b {kinds['id']}")


def link_classes(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, component`` of the classes that may be linked with another; ``classes`` has ids, sizes, signatures and bands."""
    spark, kind = classes.sparkSession, dict(classes.dtypes)["id"]
    crowded = materialise(crowded_buckets(classes), "buckets")
    if not crowded.limit(1).count():
        return spark.createDataFrame([], f"id {kind}, component {kind}")
    sigs = [f"sig{i}" for i in range(LONGS)]
    signed = materialise(classes.join(crowded.select("id").distinct(), "id", "left_semi").select("id", "n_shingles", *sigs), "signatures")
    texts = materialise(texts.join(signed.select("id").hint("shuffle_hash"), "id", "left_semi"), "texts")
    labels = signed.select("id", F.col("id").alias("component"))
    tried = spark.createDataFrame([], f"a {kind}, b {kind}")
    for turn in range(PASSES):
        own = signed.join(labels, "id").select("id", F.struct("id", "component", "n_shingles", *sigs).alias("own"))
        with setting(spark, *CALM):
            pairs = materialise(neighbours(crowded.join(own, "id"), turn, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialise(confirm(pairs.where("best"), texts, words, percent), "confirmed")
        labels = materialise(merge_labels(labels, links), "labels")
        tried = tried.unionByName(pairs.select("a", "b"))
    clusters = joined_components(labels, tried).withColumnRenamed("least", "cluster")
    clustered = materialise(labels.join(clusters, "component").join(signed.select("id", "n_shingles"), "id"), "clustered")
    links = materialise(compare_clusters(clustered.select("id", "component", "cluster", "n_shingles"), texts, words, percent), "confirmed")
    labels = materialise(merge_labels(labels, links), "labels")
    of_cluster = labels.join(clustered.select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", "component").alias("cluster"))
    own = signed.join(of_cluster, "id").select("id", F.struct("id", "cluster", "n_shingles", *sigs).alias("own"))
    with setting(spark, *CALM):
        pairs = materialise(pairs_between(crowded.join(own, "id"), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = materialise(confirm(pairs, texts, words, percent), "confirmed")
    return materialise(merge_labels(labels, links), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row; components by a similarity of ``percent`` in 100 or more."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = materialise(features(rows, words, "id"), "features")
    full = found.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    firsts = full.groupBy("digest").agg(F.min("id").alias("id"))
    classes = full.drop("digest").join(firsts.select("id").distinct(), "id", "left_semi")
    labels = link_classes(classes, rows, words, percent)
    # written, so that the join reads plain shuffles: a group of copies of any size is then split by adaptive execution
    named = materialise(firsts.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component")), "named")
    # a repeated key may stand in several classes, which it joins
    own = full.select("id", "digest").join(named, "digest").groupBy("id").agg(F.min("component").alias("component"))
    out = found.select("id", "n_shingles").join(own, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest key, null last; of rows with one key, one of them.

    Where keys are null or repeated, rows are numbered, written, and compared by their numbers.
    """
    n, distinct = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if n == distinct:
        dropped = near_duplicates(docs, words, percent, key, text).where("not kept").select(key)
        return docs.join(dropped.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)
    number = fresh(docs, "number")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, words, percent, number, text).select(F.col(number).alias("own"), "component_id")
    keyed = found.join(numbered.select(F.col(number).alias("own"), F.col(key).alias("key")), "own")
    first = keyed.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "own")).alias("first"))
    return numbered.join(first.select(F.col("first.own").alias(number)), number, "left_semi").select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


#: The same in DuckDB, by counting common shingles; it compares all pairs that share one, so it is for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), labels AS (
  SELECT id, min(other) AS low FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN labels l ON l.id = d.doc_id
"""
