"""Operator 5: near-duplicates by min-max hashing.

A document's set holds its distinct k-word shingles (lower-cased A-Z, words
between ASCII blanks), as 64-bit hashes. Under each permutation both the
minimum and the maximum are retained, two signature values for one hash
evaluation of a shingle. Bands of five values make the candidates: two sets of
similarity 0.8 share one of 40 bands but for about 1 pair in 10^6. Links are
confirmed on the full sets.

Skew: equal sets are one class from the start, with one signature. Within a
bucket nothing is paired all with all: members are compared with one leader,
links merge components, and only members that are still in different components
are compared further, with new leaders while many remain and block by block at
the end. Before that, shingles that no other open set holds are counted: a set with
too many of its own can't reach the similarity with any other, whatever their
number, and is settled without comparisons. So a group of near copies costs
about a comparison a member and band, and no link is left out.

Defined cases: null, empty or blank texts have an empty set, are linked with
nothing and kept; fewer than k words make one shingle of the whole sequence;
repeated rows with the same text are copies like others (with equal ids all are
``kept``); a null doc_id takes part in links but is never a component's id
(unless the component has no other); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, keyed, small
from .components import components
from .pretokens import Memo

PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 2048
#: Pairs still open, per class, up to which they are compared one by one; beyond, leaders go on.
OPEN_PAIRS = 8
LEADER_ROUNDS = 2
#: Members of a block, and code columns counted at once: bounds of a task's memory.
BLOCK, COLUMNS = 192, 8192


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, k: int, memo: Memo) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * MULTIPLIER + h[j : j + len(out)]
    return np.unique(mix(out))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 64, (PERMUTATIONS, 1), dtype=np.uint64)
    return draw(), draw() | np.uint64(1)


def bands(shingles: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set's min-max signature."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        h = (shingles[at : at + CHUNK] ^ flip) * factor
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    rows = np.stack([low, high], 1).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * MULTIPLIER + rows[:, j])
    return key


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """``rid, doc_id, n_shingles, set_key, bands``; key and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo = Memo(word_hash, 300_000)
        flip, factor = permutations()
        for batch in bounded(batches, 2):
            n, keys, all_bands = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, k, memo)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                all_bands.append(bands(s, flip, factor).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(all_bands, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n_shingles", "set_key", "bands"],
            )

    return rows.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """``rid, s``: the full sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash, 300_000)
        for batch in bounded(batches, 1):
            out = [shingle_set(t, k, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rid", "s"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, s binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_all, b_all = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a_all, b_all))
                small_, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small_)
                at[at == len(large)] = 0
                both = int((large[at] == small_).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    one = pairs.hint("merge").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
    two = one.hint("merge").join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, with ``rid`` and ``first`` (the one row of its component to keep)."""
    scratch = Scratch(docs.sparkSession)
    rows, numbered = keyed(docs, scratch)
    sig = scratch.write(signatures(rows, shingle_words), "signatures")
    classes = sig.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("rid", "n_shingles", "bands")).alias("m"))
    classes = scratch.write(classes.select("set_key", F.col("m.rid").alias("rep"), F.col("m.n_shingles").alias("n"), "m.bands"), "classes")
    links = _links(rows, classes, scratch, shingle_words, percent)
    if links is None:
        comp = classes.select("set_key", F.col("rep").alias("comp"))
    else:
        comp = classes.hint("merge").join(links, F.col("id") == F.col("rep"), "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    member = sig.select("rid", "doc_id", "n_shingles", "set_key").hint("merge").join(comp, "set_key", "left")
    member = member.withColumn("comp", F.coalesce("comp", "rid"))
    if numbered:  # rows were numbered: name components by their least doc_id
        names = member.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        member = member.hint("merge").join(names, "comp")
    else:
        member = member.withColumn("component_id", F.col("comp"))
    return member.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "rid", (F.col("rid") == F.col("comp")).alias("first")
    )


def _links(rows: DataFrame, classes: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame | None:
    """``id, comp`` of the classes that have confirmed links, or None without any."""
    keys = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = scratch.write(keys.hint("merge").join(shared, "bucket").select("bucket", "rep", "n"), "members")
    involved = members.select(F.col("rep").alias("rid")).distinct()
    involved = scratch.write(involved, "involved")
    needed = F.broadcast(involved) if small(involved) else involved.hint("merge")
    sets = scratch.write(_sets(rows.join(needed, "rid", "left_semi"), k), "sets")
    n_classes = max(1, sets.count())

    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    # An intersection is at most what either set shares with any other open set: s and t.
    reach = F.expr(f"least(s, t) * {100 + percent} >= {percent} * (n + m)")
    tested = links = state = None
    comp = members.select(F.col("rep").alias("id"), F.col("rep").alias("comp")).distinct()
    turn, last = 0, False
    while not last:
        if turn == 0:
            state = members.withColumns({"comp": F.col("rep"), "s": F.col("n")})
        else:
            # Settled rows stay settled, so a round takes up the open rows of the one before. A table
            # that is read twice is written first: each open row meets its component and its counts once.
            own = ["bucket", "rep", "n"] + ["s"] * (turn > 1)
            state = state.select(own).hint("merge").join(comp, F.col("id") == F.col("rep"), "left").select(*own, F.coalesce("comp", "rep").alias("comp"))
            state = _several(scratch.write(state, f"named-{turn}"))
            if turn == 1:
                state = scratch.write(state, "state")
                shared_counts = scratch.write(_shared_counts(state, sets), "shared")
                state = scratch.write(_within_reach(state, shared_counts.select("rep", "s"), percent), "reach")
                state = _several(state)
            state = scratch.write(state, f"open-{turn}")
            scratch.drop(f"named-{turn}", "state", "reach")
            sizes = state.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
            left = sizes.groupBy("bucket").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open")).agg(F.sum("open")).first()[0]
            if not left:
                break
            last = left <= OPEN_PAIRS * n_classes or turn >= LEADER_ROUNDS
        if last:
            found = _block_links(state, shared_counts.select("rep", "codes"), percent, scratch)
        else:
            # The leader is the member with the fewest shingles of its own; among equals another one in every round.
            first = F.struct((F.col("n") - F.col("s")).alias("own"), F.xxhash64(F.lit(turn), "rep").alias("h"), F.col("rep").alias("lead"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("s").alias("t"))
            lead = state.groupBy("bucket").agg(F.min(first).alias("l")).select("bucket", "l.lead", "l.m", "l.other", "l.t")
            pairs = state.hint("merge").join(lead, "bucket").where((F.col("rep") != F.col("lead")) & (F.col("comp") != F.col("other")) & near & reach)
            pairs = pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.hint("merge").join(tested, ["a", "b"], "left_anti")
            pairs = scratch.write(pairs, f"pairs-{turn}")
            found = scratch.write(_confirm(pairs, sets, percent), f"links-{turn}")
            tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count():
            comp = components(links, scratch, f"comp-{turn}")
        turn += 1
    scratch.drop("sets")
    return comp if links is not None and links.limit(1).count() else None


def _block_links(state: DataFrame, codes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: links of open members of a bucket between different components.

    A bucket's members are dealt to blocks of about ``BLOCK``; a row is a pair
    of blocks, and a task counts common shingles of one such pair at a time by
    matrix products, so neither a bucket nor its pairs become rows. What two
    sets share is among their shared shingles, so the counts are those of the
    full sets. Of a member's links with one component of the other block the
    first is enough for the components.
    """
    many = state.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = state.hint("merge").join(many, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).hint("merge").join(codes, "rep")
    block = dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct("rep", "comp", "n", "codes")).alias("docs"))
    block = scratch.write(block, "blocks")
    other = block.select("bucket", F.col("block").alias("block_b"), F.col("docs").alias("docs_b"))
    both = block.hint("merge").join(other, "bucket").where("block <= block_b").select("docs", "docs_b")

    def parts(cell) -> tuple[np.ndarray, ...]:
        rep, comp, n = (cell.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        lists = cell.field(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return rep, comp, n, flat, np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ra, ca, na, fa, ia), (rb, cb, nb, fb, ib) = (parts(batch.column(c)[i].values) for c in (0, 1))
                if len(np.unique(np.concatenate([ca, cb]))) < 2:
                    continue
                common = np.intersect1d(fa, fb)
                pa_, pb = np.searchsorted(common, fa), np.searchsorted(common, fb)
                in_a = (pa_ < len(common)) & (common[np.minimum(pa_, len(common) - 1)] == fa) if len(common) else np.zeros(len(fa), bool)
                in_b = (pb < len(common)) & (common[np.minimum(pb, len(common) - 1)] == fb) if len(common) else np.zeros(len(fb), bool)
                counts = np.zeros((len(ra), len(rb)), np.float64)
                for at in range(0, len(common), COLUMNS):
                    here_a, here_b = in_a & (pa_ >= at) & (pa_ < at + COLUMNS), in_b & (pb >= at) & (pb < at + COLUMNS)
                    ma, mb = np.zeros((len(ra), COLUMNS), np.float32), np.zeros((len(rb), COLUMNS), np.float32)
                    ma[ia[here_a], pa_[here_a] - at] = 1
                    mb[ib[here_b], pb[here_b] - at] = 1
                    counts += ma @ mb.T
                can = (counts * (100 + percent) >= percent * (na[:, None] + nb[None, :])) & (ca[:, None] != cb[None, :])
                x, y = np.nonzero(can)
                _, first = np.unique(np.stack([x, np.unique(cb, return_inverse=True)[1][y]]), axis=1, return_index=True)
                x, y = x[first], y[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ra[x], rb[y]), pa.int64()), pa.array(np.maximum(ra[x], rb[y]), pa.int64())], names=["a", "b"])

    spark = state.sparkSession
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "16")  # rows are large: two blocks of sets
    try:
        return scratch.write(both.mapInArrow(run, "a long, b long"), "block-links")
    finally:
        spark.conf.set(size, before)


def _several(state: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    several = state.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    return state.hint("merge").join(several, "bucket")


def _shared_counts(state: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, s, codes``: how many shingles of each open set occur in another open set, and which. Only these can be in an intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                values = [np.frombuffer(c.as_buffer(), np.int64) for c in piece.column(1)]
                rid = np.repeat(np.array(piece.column(0).to_pylist(), np.int64), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(values))], names=["rep", "h"])

    open_ = state.select(F.col("rep").alias("rid")).distinct()
    some = sets.join(F.broadcast(open_) if small(open_) else open_.hint("merge"), "rid", "left_semi")
    shingles = some.select("rid", "s").mapInArrow(run, "rep long, h long")
    twice = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    return shingles.hint("merge").join(twice, "h").groupBy("rep").agg(F.count(F.lit(1)).alias("s"), F.collect_list("h").alias("codes"))


def _within_reach(state: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Rows whose shared shingles suffice for a link with the smallest set of the bucket; without loss of links."""
    least = state.groupBy("bucket").agg(F.min("n").alias("least"))
    both = state.hint("merge").join(counts, "rep").hint("merge").join(least, "bucket")
    return both.where(F.expr(f"s * {100 + percent} >= {percent} * (n + greatest(least, ceil(n * {percent} / 100)))")).drop("least")
