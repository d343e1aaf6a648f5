"""Near-duplicate classes by SetSketch registers.

1. Every document gets the set of its word shingles, the set's fingerprint and a SetSketch: register i is the truncated,
   exponentially spaced minimum ``floor(1 - log_b x)`` over the shingles' exponential hash values x.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Bands of register values put representatives in buckets. Shingles that no other representative in a shared bucket
   holds bound each one's best possible similarity; those that can link with nobody go (exact, no pairs needed).
4. Each bucket's most central member is compared with its other members: joint maximum likelihood on the registers first,
   then the full sets. Links give components.
5. Members of a bucket that are still in different components are compared likewise, if they can still link: shingles
   that at most RARE of them hold are joined exactly, and the rest of a set bounds what pairs without those can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import join_on_key, materialize, materialize_counting, sliced, table
from atomloom.llm.components import connected_components
from atomloom.llm.words import BASE, groups, mix, span_hashes, windows

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS_PER_BAND, BANDS = 4, 32
REGISTERS = ROWS_PER_BAND * BANDS
#: Register base and rate: the base is so fine that unlike sets hardly ever agree in a register, whatever the number of
#: documents; values fit in two bytes for any set size.
REGISTER_BASE, RATE, LIMIT = 1.001, 20.0, 65535
REGISTER = np.dtype("<u2")
#: A shingle is rare if at most so many documents of the last step hold it.
RARE = 32
#: Pairs whose likelihood estimate is this many standard errors below the threshold are not verified.
SLACK = 5.0
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, REGISTERS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH_BLOCK = 1 << 16


def shingle_sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Sorted distinct 64-bit shingle hashes of each text, in groups of texts.

    A-Z are lowered. A text of one to SHINGLE - 1 words has its whole word sequence as the only shingle; a null text or
    one without words has none.
    """
    for texts in groups(column, lower=True):
        starts, ends, offsets = texts.words()
        hashes = span_hashes(texts.data, starts, ends)
        runs, place = windows(hashes, offsets, SHINGLE)
        cut = np.searchsorted(place, offsets)
        out = []
        for i in range(texts.hi - texts.lo):
            n = offsets[i + 1] - offsets[i]
            if n >= SHINGLE:
                out.append(np.unique(runs[cut[i] : cut[i + 1]]))
            elif n:
                whole = np.zeros(1, dtype=np.uint64)
                for h in hashes[offsets[i] : offsets[i + 1]]:
                    whole = whole * BASE + h
                out.append(mix(whole + np.uint64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        yield out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers [set, REGISTERS]; an empty set has zeros. Sketches of a union are the registers' maxima."""
    lengths = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    for at in range(0, len(flat), SKETCH_BLOCK):
        part, own = flat[at : at + SKETCH_BLOCK], owner[at : at + SKETCH_BLOCK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows = own[first]
        for r in range(REGISTERS):
            low = np.minimum.reduceat((part ^ _XOR[r]) * _MULTIPLY[r], first)
            least[rows, r] = np.minimum(least[rows, r], low)
    unit = (least >> np.uint64(11)).astype(np.float64) + 0.5
    x = -np.log1p(-np.minimum(unit / float(1 << 53), 1.0 - 2.0**-53)) / RATE
    value = np.floor(1.0 - np.log(x) / np.log(REGISTER_BASE))
    return np.where(lengths[:, None] > 0, np.clip(value, 0, LIMIT), 0).astype(REGISTER)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, fingerprint, registers); equal sets have equal fingerprints of 16 bytes."""
    for batch in sliced(batches):
        n, prints, registers = [], [], []
        for sets in shingle_sets(batch.column("text")):
            for s in sets:
                n.append(len(s))
                with np.errstate(over="ignore"):
                    prints.append(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ BASE))], dtype=np.uint64).tobytes() if len(s) else None)
            registers += [r.tobytes() for r in sketch(sets)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "fingerprint", "registers"])


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [s.astype(np.int64) for group in shingle_sets(batch.column("text")) for s in group]
        yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])


def likelihood_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers [pair, REGISTERS] and exact set sizes.

    With u and v the shares of the union that only one side holds, a register of a is larger with probability
    p(u), that of b with p(v), and they are equal with the rest, p(x) = -log_b(1 - x (b - 1) / b). The sizes leave one
    unknown, the similarity; its log-likelihood is concave and is searched by golden section.
    """
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    log_base = np.log(REGISTER_BASE)
    share = n_a / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (REGISTER_BASE - 1) / REGISTER_BASE) / log_base

    def value(j: np.ndarray) -> np.ndarray:
        pa_, pb_ = p(np.maximum(share - j * (1 - share), 0)), p(np.maximum(1 - share - j * share, 0))
        tiny = 1e-12
        return larger * np.log(np.maximum(pa_, tiny)) + smaller * np.log(np.maximum(pb_, tiny)) + equal * np.log(np.maximum(1 - pa_ - pb_, tiny))

    low, high = np.zeros(len(a)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - golden * (high - low), low + golden * (high - low)
        up = value(left) < value(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


@dataclass(frozen=True)
class Classes:
    """members: (doc_id, n_shingles, component_id); links: verified (a, b) between class representatives."""

    members: DataFrame
    links: DataFrame


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of (a, b), those whose likelihood similarity comes within SLACK standard errors of the threshold."""
    t = PERCENT / 100
    least = t - SLACK * float(np.sqrt(t * (1 - t) / REGISTERS))
    side = reps.select("rep", "n", "registers")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a")
    both = both.join(side.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=REGISTER).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                estimate = likelihood_similarity(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")))
                yield batch.select(["a", "b"]).filter(pa.array(estimate >= least))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(kept, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b), those whose full shingle sets are similar enough."""
    side = sets.select("rep", "shingles")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
    both = both.join(side.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * shared >= PERCENT * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def may_link(shared_a: Column, n_a: Column, shared_b: Column, n_b: Column) -> Column:
    """Whether sets with so many shingles, of which so many are not theirs alone, can reach the threshold."""
    most = F.least(shared_a, shared_b)
    return 100 * most >= PERCENT * (n_a + n_b - most)


def open_pairs(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the (bucket, rep, n, component) rows in different components that can link; no such pair is left out.

    With r rare shingles in common, two sets share at most r plus the smaller number of their other shingles. Pairs with
    a rare shingle in common come from a join on it, of at most RARE rows a shingle; all others have r = 0 and come from
    the buckets, where most are ruled out by the number of their other shingles.
    """
    nodes = named.select("rep", "n", "component").distinct()
    postings = sets.join(nodes, "rep").select("rep", "n", "component", F.explode("shingles").alias("h"))
    postings = materialize(postings, "neardup-postings")
    counts = materialize(postings.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= RARE), "neardup-rare")
    rare = postings.join(counts, "h")
    # An id with several texts has no bound: its rare shingles are not those of the one text that n counts.
    single = sets.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") == 1).select("rep")
    own = rare.groupBy("rep").agg(F.count(F.lit(1)).alias("rare")).join(single, "rep")
    nodes = nodes.join(own, "rep", "left").select("rep", "n", "component", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("other"))
    nodes = materialize(nodes, "neardup-nodes")
    listed = materialize(rare.filter(F.col("k") > 1).select("h", "rep", "component").join(nodes.select("rep", "n", "other"), "rep"), "neardup-listed")
    left, right = listed.alias("l"), listed.alias("r")
    shared = left.join(right, (F.col("l.h") == F.col("r.h")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.component") != F.col("r.component")))
    columns = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("rep", "n", "other")]
    shared = shared.select(*columns).groupBy(*(f"{s}_{c}" for s in "lr" for c in ("rep", "n", "other"))).agg(F.count(F.lit(1)).alias("r"))
    by_rare = shared.filter(may_link(F.col("l_other") + F.col("r"), F.col("l_n"), F.col("r_other") + F.col("r"), F.col("r_n"))).select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"))
    members = materialize(named.select("bucket", "rep").join(nodes.filter(100 * F.col("other") >= PERCENT * F.col("n")), "rep"), "neardup-members-open")
    left, right = members.alias("l"), members.alias("r")
    near = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.component") != F.col("r.component"))
    by_bucket = left.join(right, near & may_link(F.col("l.other"), F.col("l.n"), F.col("r.other"), F.col("r.n"))).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    return by_rare.unionByName(by_bucket).distinct()


def near_duplicates(docs: DataFrame) -> Classes:
    """Classes of near-duplicate documents by (doc_id, text).

    Documents without words, and rows with a null doc_id, are linked with nothing and stand for themselves. A doc_id
    that occurs twice is one node that has the links of both its texts; both rows get its component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = materialize(docs.select("doc_id", "text").mapInArrow(sketched, f"doc_id {kind}, n_shingles long, fingerprint binary, registers binary"), "neardup-sketches")
    total = every.count()
    linked = every.filter(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull())
    classes = linked.groupBy("fingerprint").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "registers")).alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.select("fingerprint", "rows", F.col("first.doc_id").alias("rep"), F.col("first.n").alias("n"), F.col("first.registers").alias("registers")), "neardup-classes")
    width = ROWS_PER_BAND * REGISTER.itemsize
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width))))
    banded = classes.select("rep", "n", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("bucket")
    shared = materialize(shared, "neardup-shared")  # a table on both sides lets Spark split a hot bucket
    members = materialize(banded.join(shared, "bucket"), "neardup-members")
    candidates = materialize(members.select("rep").distinct(), "neardup-candidates")

    texts = docs.select("doc_id", "text").join(candidates, docs["doc_id"] == candidates["rep"]).select("doc_id", "text")
    first = classes.select("rep", "n", "registers")
    sets = materialize(texts.mapInArrow(shingled, f"rep {kind}, shingles array<long>"), "neardup-sets")
    # Shingles that occur once among all candidates: combined before the shuffle, no join back.
    once = sets.select("rep", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).filter(F.col("k") == 1)
    alone = once.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    # An id with several texts has no bound of its own: nothing counts as alone there.
    copies = sets.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    bound = copies.join(first.select("rep", "n"), "rep").join(alone, "rep", "left")
    bound = bound.select("rep", "n", (F.col("n") - F.when(F.col("copies") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)).alias("common"))
    bound = materialize(bound.filter(100 * F.col("common") >= PERCENT * F.col("n")), "neardup-bound")

    close = materialize(members.select("bucket", "rep").join(bound, "rep"), "neardup-close")
    # The most central member of a bucket has the smallest share of shingles of its own.
    center = F.min(F.struct((-F.col("common") / F.col("n")).alias("order"), "rep", "n", "common"))
    centers = close.groupBy("bucket").agg(center.alias("c"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    centers = materialize(centers.select("bucket", F.col("c.rep").alias("center"), F.col("c.n").alias("n_c"), F.col("c.common").alias("common_c")), "neardup-centers")
    star = close.join(centers, "bucket")
    star = star.filter((F.col("rep") != F.col("center")) & may_link(F.col("common"), F.col("n"), F.col("common_c"), F.col("n_c")))
    pairs = star.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    links = materialize(verified(plausible(pairs, first), sets), "neardup-star")
    # Texts of one id are one node, whatever stands for their classes.
    spread = linked.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).filter(F.col("low") != F.col("high")).select("doc_id")
    spread = materialize(spread, "neardup-spread")
    same = linked.select("doc_id", "fingerprint").join(spread, "doc_id").distinct().join(classes.select("fingerprint", "rep"), "fingerprint")
    same = materialize(same.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "neardup-same")
    labels = connected_components(links.unionByName(same), "neardup-first")

    # What is left: members of one bucket in different components that may still link.
    named = close.join(labels, close["rep"] == labels["id"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    span = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_buckets = materialize(span.filter(F.col("low") != F.col("high")).select("bucket"), "neardup-split")
    named = materialize(named.join(open_buckets, "bucket"), "neardup-open")
    cross = open_pairs(named, sets)
    more, n_more = materialize_counting(verified(plausible(cross, first), sets), "neardup-cross", F.lit(True))
    links = links.unionByName(more)
    if n_more:
        labels = connected_components(links.unionByName(same), "neardup-all")

    named_classes = classes.select("fingerprint", "rows", "rep").join(labels, F.col("rep") == F.col("id"), "left")
    named_classes = named_classes.select("fingerprint", "rows", F.coalesce("component", "rep").alias("component"))
    placed = join_on_key(every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint")), named_classes, "fingerprint", "rows", total)
    return Classes(placed.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), links)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document of ``documents``; the smallest id of each is kept."""
    members = near_duplicates(table(spark, sf_dir, "documents")).members
    return members.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
