"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, exact confirmation, components."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, small
from .shingles import mix, shingle_set

#: A signature has HASHES values of 16 bits. Split into CHUNKS chunks, two signatures that differ in at most
#: DISTANCE = 2 CHUNKS - 1 values have, by pigeonhole, a chunk with at most one difference. CHUNKS is for 85 %; chunks_for
#: gives the number for others, so that a link at the threshold differs in more values with probability MISS at most.
HASHES, CHUNKS, MISS = 64, 11, 1e-4
DISTANCE = 2 * CHUNKS - 1
#: Members from which a bucket is compared in blocks.
LARGE = 16
_rng = np.random.default_rng(7)
FACTOR = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
PARTS = np.array_split(np.arange(HASHES), CHUNKS)


def chunks_for(percent: int) -> int:
    """The least number of chunks with which sets of that similarity share no bucket with probability MISS at most."""
    p = percent / 100
    for chunks in range(1, HASHES // 2 + 1):
        if sum(math.comb(HASHES, k) * (1 - p) ** k * p ** (HASHES - k) for k in range(2 * chunks, HASHES + 1)) <= MISS:
            return chunks
    raise ValueError(f"signatures of {HASHES} values cannot find links at {percent} %")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit minhash signatures (one row of 16-bit values each) of sets that aren't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = mix(np.minimum.reduceat(flat * FACTOR[k] + OFFSET[k], starts)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """HASHES keys per signature: every chunk with one of its values left out stands for all signatures whose chunk
    differs in that value at most."""
    out = np.empty(sig.shape, np.uint64)
    for part in np.array_split(np.arange(HASHES), chunks):
        for skip in part:
            h = np.full(len(sig), int(skip) + 1, np.uint64)
            for k in part:
                if k != skip:
                    h = mix(h * np.uint64(0xA24BAED4963EE407) + sig[:, k].astype(np.uint64))
            out[:, skip] = h
    return out


def groups_of(sizes: list[int], limit: int):
    """Slices of consecutive items whose sizes sum to about limit, one item at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, print (128-bit hash of the whole set; null if empty), sig (null if empty)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in groups_of([len(t or "") for t in texts], 400_000):
                sets = [shingle_set(t, words) for t in texts[part]]
                full = [k for k, s in enumerate(sets) if len(s)]
                prints, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full])):
                        prints[k], sigs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "print", "sig"]
                )

    return text_of(docs).mapInArrow(run, "doc_id long, n_shingles long, print binary, sig binary")


def text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs with a < b."""
    a, b = a[a < b], b[a < b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return np.stack([a[new], b[new]], 1)


def linear_pairs(nodes: DataFrame, chunks: int) -> DataFrame:
    """Candidate pairs (a < b) of nodes(id, sig): in each bucket of the index, every member with the bucket's smallest
    id and with the member before it. A task first does so with its own members of a bucket and sends on only their
    smallest, so a hot bucket reaches its owner as one row for each batch; pairs stay linear in the members."""

    def send(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            keys = index_keys(matrix_of(batch.column("sig")), chunks)[order]
            who = np.repeat(ids[order], HASHES)
            flat = keys.ravel()
            by = np.argsort(flat, kind="stable")  # members of a bucket by id
            flat, who = flat[by], who[by]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            first = who[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.flatnonzero(~new)
            a = np.concatenate([first[again], who[again - 1]])
            b = np.concatenate([who[again], who[again]])
            pairs = distinct_pairs(a, b)
            key = np.concatenate([flat[new].view(np.int64), mix(pairs[:, 0].astype(np.uint64) * np.uint64(31) + pairs[:, 1].astype(np.uint64)).view(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([who[new], pairs[:, 0]])), pa.array(np.concatenate([np.full(new.sum(), -1), pairs[:, 1]]).astype(np.int64), mask=np.concatenate([np.ones(new.sum(), bool), np.zeros(len(pairs), bool)]))], ["key", "a", "b"])

    def meet(batches):
        last = leader = prior = None
        for batch in batches:
            key, a = batch.column("key").to_numpy(), batch.column("a").to_numpy()
            done = batch.filter(pa.compute.is_valid(batch.column("b"))).select(["a", "b"])
            sent = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            key, a = key[sent], a[sent]
            if len(key):
                new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
                first = np.where(np.cumsum(new) > 0, a[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))], leader if leader is not None else 0)
                before = np.concatenate([[prior if prior is not None else 0], a[:-1]])
                hit = ~new
                pairs = distinct_pairs(np.concatenate([first[hit], before[hit]]), np.concatenate([a[hit], a[hit]]))
                last, leader, prior = key[-1], first[-1], a[-1]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            yield done

    sent = nodes.mapInArrow(send, "key long, a long, b long").repartition("key").sortWithinPartitions("key", "a")
    return sent.mapInArrow(meet, "a long, b long").distinct()


def with_distance(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, distance: values in which the signatures differ) whose set sizes allow a link."""

    def run(batches):
        for batch in batches:
            far = (matrix_of(batch.column("sa")) != matrix_of(batch.column("sb"))).sum(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far.astype(np.int32))], ["a", "b", "distance"])

    left, right = (nodes.select(F.col("id").alias(k), F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, distance int")


def full_sets(ids: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """Whole shingle sets (id, full: sorted 64-bit hashes) of the documents in ids(doc_id)."""

    def full(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "full"])

    ids = ids.distinct()
    wanted = text_of(docs).join(F.broadcast(ids) if small(ids, 1_000_000) else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return scratch.save(wanted.mapInArrow(full, "id long, full binary"), "sets")


def confirmed(spark: SparkSession, pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 |A and B| >= percent |A or B|."""

    def compare(batches):
        for batch in batches:
            link = []
            for x, y in zip(batch.column("fa"), batch.column("fb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                link.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(link, pa.bool_()))

    sets = full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, words, scratch)
    left, right = (sets.select(F.col("id").alias(k), F.col("full").alias(f"f{k}")) for k in "ab")
    out = scratch.save(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"), "links")
    scratch.drop(sets)
    return out


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different components so far; an id without a label is its own component."""
    for k in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    return pairs.where("ca <> cb").drop("ca", "cb")


def groups_in_order(batches, mark: tuple[str, ...]):
    """Tables of whole groups from batches sorted by the columns in mark; the last group of a batch may go on in the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        values = np.stack([table.column(c).to_numpy().astype(np.int64) for c in mark])
        other = np.flatnonzero((values != values[:, -1:]).any(axis=0))
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def open_buckets(nodes: DataFrame, labels: DataFrame, chunks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (id, component, key) of all buckets, and the buckets (key, lead, g) of three members or more that hold
    several components, from nodes and labels(id, component); a node without a label is its own component. A bucket of
    two, counted over all nodes, is a linear pair and was looked at already."""

    def keys(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                key = index_keys(matrix_of(part.column("sig")), chunks).view(np.int64) if part.num_rows else np.zeros((0, HASHES), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(c).to_numpy(), HASHES)) for c in ("id", "component")] + [pa.array(key.ravel())], ["id", "component", "key"])

    member = scratch.save(nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "sig").mapInArrow(keys, "id long, component long, key long"), "members")
    open_ = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("lead"), F.count("*").alias("g"))
    return member, scratch.save(open_.where("lo <> hi and g > 2").select("key", "lead", "g"), "open")


def small_bucket_pairs(member: DataFrame, buckets: DataFrame, nodes: DataFrame, percent: int, chunks: int) -> DataFrame:
    """All pairs (a, b) of different components whose set sizes allow a link, in buckets of at most LARGE members; a pair comes from
    its first common bucket."""

    def within(table: pa.Table) -> pa.RecordBatch:
        """Pairs of whole groups, all groups at a time: each row with the row d places on, for every d that occurs."""
        key, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "id", "component", "n"))
        sig = matrix_of(table.column("sig"))
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        keys = index_keys(sig, chunks)
        place = (keys == key.view(np.uint64)[:, None]).argmax(axis=1)
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, np.bincount(group).max()):
            i = np.flatnonzero(group[:-d] == group[d:])
            j = i + d
            ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            early = (keys[i] == keys[j]) & (np.arange(HASHES)[None, :] < place[i][:, None])
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1)[~early.any(axis=1)])
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        for table in groups_in_order(batches, ("key",)):
            yield within(table)

    rows = member.join(buckets.select("key"), "key").join(nodes.select("id", "sig", "n"), "id")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long").distinct()


def large_bucket_links(spark: SparkSession, member: DataFrame, buckets: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, chunks: int, scratch: Scratch, rows: int = 1024, set_bytes: int = 16_000_000) -> DataFrame:
    """Links (a, b) that join components within large buckets, found on full sets without emitting pairs.

    Documents that large buckets have in common are a cluster. A cluster is cut into blocks of at most so many rows and
    bytes of sets; each pair of blocks is compared in a task of its own, every pair of different components that
    shares a bucket exactly, and gives a spanning forest of what it joins: links in proportion to rows.
    """
    near = member.join(buckets.select("key", "lead"), "key")
    star = near.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    cluster = components(spark, star, scratch).select("id", F.col("component").alias("cluster"))
    who = scratch.save(near.select("id", "component").distinct().join(cluster, "id").join(nodes.select("id", "sig", "n"), "id"), "clustered")
    size = who.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum("n") * 8 / set_bytes)).cast("int").alias("blocks"))
    sets = full_sets(who.select(F.col("id").alias("doc_id")), docs, words, scratch)
    dealt = who.join(size, "cluster").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    dealt = dealt.join(sets, "id").select("cluster", "x", "y", "mine", "id", "component", "n", "sig", "full")

    def forest(table: pa.Table) -> np.ndarray:
        ids, comp, n, mine, x, y = (table.column(c).to_numpy() for c in ("id", "component", "n", "mine", "x", "y"))
        keys, sets_ = index_keys(matrix_of(table.column("sig")), chunks), [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("full")]
        _, comp = np.unique(comp, return_inverse=True)
        root, out = np.arange(comp.max() + 1), []
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids))
            own = root[comp[i]]
            j = j[(root[comp[j]] != own) & ((x[i] == y[i]) | (mine[j] != mine[i]))]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            j = j[(keys[j] == keys[i]).any(axis=1)]
            if not len(j):
                continue
            flat = np.concatenate([sets_[k] for k in j])
            at = np.minimum(np.searchsorted(sets_[i], flat), len(sets_[i]) - 1)
            common = np.add.reduceat((sets_[i][at] == flat).astype(np.int64), np.cumsum([0] + [len(sets_[k]) for k in j[:-1]]))
            for k in j[100 * common >= percent * (n[j] + n[i] - common)]:
                a, b = root[comp[i]], root[comp[k]]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
        return np.array(out, np.int64).reshape(-1, 2)

    def run(batches):
        for table in groups_in_order(batches, ("cluster", "x", "y")):
            mark = np.stack([table.column(c).to_numpy() for c in ("cluster", "x", "y")])
            edge = np.concatenate([[0], np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            for i, j in zip(edge[:-1], edge[1:]):
                links = forest(table.slice(i, j - i).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "id").mapInArrow(run, "a long, b long")


def near_dedup(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, large: int = LARGE, block_rows: int = 1024) -> DataFrame:
    """Groups documents whose sets of word shingles have 100 |A and B| >= percent |A or B|, chains included.

    Words are [^ \\t-\\r]+ of the text with A-Z lower-cased; a set has the distinct runs of so many words, or the whole
    sequence of a shorter text; a text without words, or null, has none and links with nothing. Returns for every row
    doc_id, n_shingles, component_id (smallest id that links reach, its own if none), kept (doc_id is component_id).
    Ids name documents: rows of one id should be repeats of one text. A row without id has the component of equal
    sets that have one, else null. An empty table gives an empty result; other columns are ignored.

    1. Signatures; equal sets become one node. 2. Linear pairs from the buckets of the index. 3. Each node's nearest
    candidate is confirmed on full sets; components; then those other pairs that still lie across components.
    4. In buckets that still hold several components, every pair across them whose set sizes allow a link is confirmed:
    pair by pair in small buckets, in blocks of clusters where buckets are large. So each link whose signatures share a
    bucket is found or lies inside a component already, and hot groups are joined by a number of pairs in proportion to
    their members. The number of chunks follows from percent: a link at the threshold, whose values differ each with
    its distance, shares no bucket with probability MISS at most (11 chunks at 85 %, 14 at 80 %). Shingles' hashes and
    16-bit values that agree by chance only add candidates. A percent that this cannot reach is a ValueError. large: members
    beyond which a bucket is compared in blocks; block_rows: rows of a block, where its sets aren't large. Both change the
    plan and not the result. The comparison of a cluster takes time with the square of its rows, in tasks of two blocks.
    """
    chunks, scratch = chunks_for(percent), Scratch(spark, "near")
    rows = scratch.save(sketch(docs, words), "sketches")
    groups = rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = scratch.save(groups.where("id is not null"), "nodes")
    pairs = scratch.save(with_distance(linear_pairs(nodes.select("id", "sig"), chunks), nodes, percent), "pairs")

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    nearest = both.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    nearest = scratch.save(nearest, "nearest")
    links = confirmed(spark, nearest, docs, words, percent, scratch)
    labels = scratch.save(components(spark, links, scratch), "labels")
    rest = scratch.save(across(pairs.select("a", "b"), labels).join(nearest, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        links = scratch.save(links.unionByName(confirmed(spark, rest, docs, words, percent, scratch)), "links")
        labels = scratch.save(components(spark, links, scratch), "labels")

    tried = nearest.unionByName(rest)
    member, buckets = open_buckets(nodes, labels, chunks, scratch)
    found = small_bucket_pairs(member, buckets.where(F.col("g") <= large), nodes, percent, chunks)
    left, wide = scratch.save(found.join(tried, ["a", "b"], "left_anti"), "left"), buckets.where(F.col("g") > large)
    more = [confirmed(spark, left, docs, words, percent, scratch)] if left.limit(1).count() else []
    if wide.limit(1).count():
        more.append(scratch.save(large_bucket_links(spark, member, wide, nodes, docs, words, percent, chunks, scratch, block_rows), "links"))
    if more:
        for part in more:
            links = links.unionByName(part)
        labels = scratch.save(components(spark, links, scratch), "labels")

    of_print = nodes.select("print", "id").join(labels, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "print").join(of_print, "print", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
