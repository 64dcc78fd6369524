"""MinHash near-duplicate classes by a signature-coordinate inverted join.

1. Each document's set of distinct 5-word shingles becomes a signature of COORDINATES minima. Equal sets are one class
   from here on (key: a 64-bit hash of two 64-bit sums over the set), so exact copies never meet in a list.
2. Classes are posted under each of POSTED coordinate-value pairs. A pair that occurs once links nothing. A class keeps
   its other pairs in order of rising frequency, and only their prefix: two classes with at least MATCHES common
   coordinates must share one of the first m - MATCHES + 1 of a class's m shared pairs (prefix merging; a class with
   m < MATCHES has none and is skipped). MATCHES and KEEP follow from the similarity by the binomial tail (`bounds`).
3. In every list the most central class (most frequent coordinates) leads; each member meets the leader only, and a pair
   stays if the collisions over all COORDINATES reach KEEP. Collisions are counted 64 at a time on 4-bit slices.
4. The pairs' full shingle sets are compared; links are pairs with 100 * intersection >= similarity * union. Components of the
   links follow by large-star and small-star steps (joins, no collected neighbour lists).
5. Lists that hold more than one component may still hide links between them (`cross_links`). A member is then described
   by its difference to the leader's set. Two members of different components can only be linked if their differences
   overlap by a number that follows from their sizes, so elements that no other difference of the leader has count
   for nothing: members with too few of the others are skipped, the rest meet under the rarest of them only. The edits of
   near copies are mostly their own, so in a group of copies that lie just under the threshold nearly all are skipped and
   the comparisons don't grow with the square of the group.

So a group of m near copies costs about m pairs, not m * m, and no link between components is left out except by the
count's error: a pair at exactly the similarity falls under MATCHES or KEEP with probability below 1e-6.

Defined cases: null or word-less text has an empty set, links to nothing and is its own component; fewer than 5 words are
one shingle; a null doc_id is never linked (its component is null); rows that repeat a doc_id are one document to the links,
whatever their texts: they share its component, and n_shingles is each row's own; equal similarities (ties) all link; texts
of any length are taken whole; an empty table gives an empty result. Only doc_id and text are read, so further columns
may carry any name. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common as C

WORDS = 5
SIMILARITY = 85  # percent, of op10; other callers pass their own
COORDINATES, POSTED = 512, 64
MISSED_MATCHES, MISSED_KEEP = 2e-7, 8e-7  # bounds on the probability that a link at exactly the similarity fails either count
SLICES, LONGS = 4, COORDINATES // 64
HEAD = 64  # elements of a difference that travel with its postings
PLANES = [f"p{i}" for i in range(SLICES * LONGS)]
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def bounds(similarity: int) -> tuple[int, int]:
    """(MATCHES of POSTED, KEEP of COORDINATES): the largest counts that a pair at `similarity` percent hardly ever misses.

    Coordinates agree with the similarity's probability, or by chance in all SLICES bits. At 85: 38 and 400."""

    def most(n: int, p: float, missed: float) -> int:
        if p >= 1:
            return n
        total = 0.0
        for k in range(n + 1):
            total += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
            if total >= missed:
                return max(1, k)
        return n

    if not 0 < similarity <= 100:
        raise ValueError("similarity is a percentage above 0")
    s = similarity / 100
    return most(POSTED, s, MISSED_MATCHES), most(COORDINATES, s + (1 - s) / (1 << SLICES), MISSED_KEEP)


def shingles(col: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each document, sorted; offsets)."""
    data, off = C.text_bytes(col)
    data = C.LOWER[data]
    starts, ends = C.word_bounds(data, off, C.SPACED)
    h = C.span_hashes(data, starts, ends)
    first = np.searchsorted(starts, off)
    grams = C.ngram_hashes(h, n)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(C.mix(C.ngram_hashes(h[a:b], int(b - a)) + _U(b - a)))
        else:
            sets.append(np.zeros(0, _U))
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.concatenate(([0], np.cumsum([s.size for s in sets]))).astype(np.int64)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES) minima; h holds no empty set."""
    out = np.empty((off.size - 1, COORDINATES), _U)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((h ^ _B[k]) * _A[k], off[:-1])
    return C.mix(out)


def keys_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The class key of each set; that of an empty set is 0."""
    n = np.diff(off)
    some = np.flatnonzero(n)
    out = np.zeros(n.size, _U)
    if some.size:
        k1 = np.add.reduceat(C.mix(h ^ _U(0x1234567)), off[:-1][some])
        k2 = np.add.reduceat(C.mix(h + _U(0x89ABCDEF)), off[:-1][some])
        out[some] = C.mix(C.mix(k1 + _U(1)) ^ C.mix(k2 + n[some].astype(_U)))
    return out.astype(np.int64)


def _own_if_empty(rows: DataFrame) -> DataFrame:
    """An empty document is alone in its class."""
    return rows.withColumn("key", F.when(F.col("n") > 0, F.col("key")).otherwise(F.xxhash64(F.lit("empty"), "doc_id")))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and key (of the set): what all rows need; the signatures are made for the classes only."""

    def run(batches):
        for block in C.blocks(batches):
            h, off = shingles(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(off)), pa.array(keys_of(h, off))], ["doc_id", "n", "key"])

    return _own_if_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key long"))


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), key (of the set), the posted coordinate-value pairs and the 4-bit slices."""

    def run(batches):
        for block in C.blocks(batches):
            h, off = shingles(block.column(1))
            n = np.diff(off)
            some = np.flatnonzero(n)
            tokens = np.zeros((n.size, POSTED), np.int64)
            planes = np.zeros((n.size, len(PLANES)), _U)
            if some.size:
                sig = signatures(h, np.append(off[:-1][some], off[-1]))
                tokens[some] = (C.mix(sig[:, :POSTED] ^ np.arange(POSTED, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))).astype(np.int64)
                bit = _U(1) << np.arange(64, dtype=_U)
                for j in range(LONGS):
                    for s in range(SLICES):
                        planes[some, j * SLICES + s] = (((sig[:, j * 64 : j * 64 + 64] >> _U(60 + s)) & _U(1)) * bit[None, :]).sum(axis=1, dtype=_U)
            flat = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(n > 0, POSTED, 0)))).astype(np.int32), pa.array(tokens[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), pa.array(keys_of(h, off)), flat, *[pa.array(planes[:, k].astype(np.int64)) for k in range(len(PLANES))]], ["doc_id", "n", "key", "tokens", *PLANES])

    schema = "doc_id long, n long, key long, tokens array<long>, " + ", ".join(f"{p} long" for p in PLANES)
    return _own_if_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))


def collisions(a: str, b: str):
    """Coordinates that agree in all slices, for two rows of slices under the aliases a and b."""
    parts = []
    for j in range(LONGS):
        apart = None
        for s in range(SLICES):
            p = PLANES[j * SLICES + s]
            x = F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))
            apart = x if apart is None else apart.bitwiseOR(x)
        parts.append(F.bit_count(apart))
    return F.lit(COORDINATES) - sum(parts[1:], parts[0])


def hash_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(id, hs): the full shingle set (sorted hashes) of each class in need (id, rep: a document that has it)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null")
    texts = C.may_be_among(texts, F.col("rep"), need.select("rep"), "__quarry_may").where("__quarry_may").join(need, "rep").select("id", "text")

    def run(batches):
        for block in C.blocks(batches):
            h, off = shingles(block.column(1))
            own = keys_of(h, off) == np.asarray(block.column(0), dtype=np.int64)  # another row of the document may have another text
            sets = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0), sets], ["id", "hs"]).filter(pa.array(own))

    return texts.mapInArrow(run, "id long, hs array<long>").groupBy("id").agg(F.first("hs").alias("hs"))


def confirm(pairs: DataFrame, full: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full shingle sets (hash_sets) are similar enough."""
    both = pairs.select("a", "b").join(full.select(F.col("id").alias("a"), F.col("hs").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("hs").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where((100 + similarity) * same >= similarity * (F.size("x") + F.size("y")).cast("long")).select("a", "b")


def cross_links(rest: DataFrame, full: DataFrame, similarity: int = SIMILARITY, counts: dict | None = None) -> DataFrame:
    """Links (a, b) between members of different components in the groups of rest (leader, id, c, p).

    With the differences Dx, Dy of two members to the leader's set, their own difference has |Dx| + |Dy| - 2 o elements, o being
    the overlap of Dx and Dy. They are linked if and only if 2 (100 + s) o >= qx + qy, q = (100 + s) |D| - (100 - s) n. A pair
    with qx + qy <= 0 is linked to the leader on both sides and so in one component already; any other needs an overlap.
    Its elements belong to two differences at least, and no member has more than its m elements of this kind: a partner of x has
    qy <= 2 (100 + s) mx - qx, its room. The least q of all whose room admits x bounds the overlap that x needs, hence the
    prefix of its elements, rarest first, under which it meets others; a pair is made only if the overlap of the rarest HEAD
    elements leaves room for a link, so the rows made grow with the links. counts, if given, receives the numbers of rows."""
    unit, near = 2 * (100 + similarity), 100 - similarity
    here, there = F.array_except("x", "y"), F.array_except("y", "x")
    rows = rest.select("leader", "id", "c").join(full.select("id", F.col("hs").alias("x")), "id").join(full.select(F.col("id").alias("leader"), F.col("hs").alias("y")), "leader")
    rows = rows.select("leader", "id", "c", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("base"), F.concat(here, there).alias("d"))
    rows = C.cut(rows.withColumn("q", F.lit(100 + similarity) * F.size("d") - F.lit(near) * F.col("n")))
    each = rows.select("leader", "id", F.explode("d").alias("e"))
    often = each.withColumn("f", F.count("*").over(Window.partitionBy("leader", "e"))).where("f > 1")
    own = often.groupBy("leader", "id").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("own"))
    rows = rows.select("leader", "id", "c", "q", "base").join(own, ["leader", "id"]).withColumn("m", F.size("own").cast("long"))
    step = lambda v: F.floor(16 * F.log2(1 + F.greatest(v, F.lit(0)) / (F.lit(near) * F.col("base") + 1))).cast("int")  # noqa: E731  rising in v
    rows = C.cut(rows.withColumn("admits", step(unit * F.col("m") - F.col("q"))))
    room = rows.groupBy("leader", "admits").agg(F.min("q").alias("q")).groupBy("leader").agg(F.collect_list(F.struct("admits", "q")).alias("room"))
    room = C.cut(room)  # some hundred steps a leader at most; written, so that the join with it can split a leader's members
    least = F.array_min(F.transform(F.filter("room", lambda r: r["admits"] >= step(F.col("q"))), lambda r: r["q"]))
    rows = rows.join(room, "leader").withColumn("least", least).where("least is not null")
    rows = rows.withColumn("needs", F.greatest(F.lit(1), F.ceil((F.col("q") + F.col("least")) / unit)).cast("int")).where(F.col("needs") <= F.col("m"))
    rows = C.cut(rows.select("leader", "id", "c", "q", "m", F.slice("own.e", F.lit(1), (F.col("m") - F.col("needs") + 1).cast("int")).alias("prefix"), F.col("own.e").alias("d")))
    several = rows.groupBy("leader").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("leader")
    posts = rows.join(several, "leader", "left_semi").select("leader", "id", "c", "q", "m", F.slice("d", 1, HEAD).alias("head"), F.explode("prefix").alias("e")).join(rest.select("leader", "id", "p"), ["leader", "id"])
    again = posts.select("leader", "e", *[F.col(c).alias(f"{c}2") for c in ("id", "c", "q", "m", "head", "p")])
    fits = (F.col("c") < F.col("c2")) & (F.col("q") + F.col("q2") <= unit * F.least("m", "m2")) & (collisions("p", "p2") >= bounds(similarity)[1])
    # both heads are first in one order, so the overlap is theirs and at most what the longer difference has beyond its head
    beyond = F.greatest(F.greatest("m", "m2") - HEAD, F.lit(0))
    fits = fits & (F.col("q") + F.col("q2") <= unit * (F.size(F.array_intersect("head", "head2")) + beyond))
    met = posts.join(again, ["leader", "e"]).where(fits)
    met = C.cut(met.select("leader", "id", "id2", "q", "q2").distinct())
    if counts is not None:
        counts.update(members=rest.count(), left=rows.count(), pairs=met.count())
    diffs = rows.select("leader", "id", "d")
    met = met.join(diffs, ["leader", "id"]).join(diffs.select("leader", F.col("id").alias("id2"), F.col("d").alias("d2")), ["leader", "id2"])
    sure = met.where(unit * F.size(F.array_intersect("d", "d2")).cast("long") >= F.col("q") + F.col("q2"))
    return sure.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of edges (a, b) reaches, by large-star and small-star steps."""
    now = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = C.cut(small.select("e.u", "e.v").where("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = (seen["n"], seen["h"])


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links.

    Links are pairs of at least `similarity` percent."""
    matches, keep = bounds(similarity)
    sets = C.cut(sizes_of(docs))
    known = sets.where("doc_id is not null")
    # signatures go straight into the classes' shuffle: 800 bytes a row, which a checkpoint of all rows would write once more
    classes = sets_of(docs).where("doc_id is not null and n > 0").groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("rep"), F.first(F.struct("n", "tokens", *PLANES)).alias("s"))
    classes = C.cut(classes.select("id", "rep", "s.*"))
    posts = classes.select("id", F.explode("tokens").alias("token"))
    shared = posts.withColumn("f", F.count("*").over(Window.partitionBy("token"))).where("f > 1")  # one shuffle of the postings, not two
    kept = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"))
    m = F.size("own")
    kept = kept.where(m >= matches).select("id", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["f"]).alias("central"), F.slice("own", F.lit(1), m - (matches - 1)).alias("own"))
    lists = kept.select("id", "central", F.explode("own.token").alias("token"))
    of = Window.partitionBy("token")
    led = lists.select("token", "id", F.max_by("id", F.struct("central", "id")).over(of).alias("leader"), F.count("*").over(of).alias("size"))
    met = C.cut(led.where("size > 1").select("token", "id", "leader"))
    need = classes.select("id", "rep").join(met.select("id").distinct(), "id", "left_semi")
    full = C.cut(hash_sets(docs, need))

    meta = classes.select("id", "n", F.struct(*PLANES).alias("p"))
    other = meta.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("p").alias("p2"))
    alike = (100 * F.least("n", "n2") >= similarity * F.greatest("n", "n2")) & (collisions("p", "p2") >= keep)  # two sets of other sizes can't be similar
    near = met.where("id <> leader").select("id", F.col("leader").alias("id2")).distinct().join(meta, "id").join(other, "id2").where(alike)
    links = C.cut(confirm(near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), full, similarity))
    first = components(links)

    grouped = met.join(first, "id", "left").select("token", "id", "leader", F.coalesce("root", "id").alias("c"))
    mixed = grouped.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rest = grouped.join(mixed, "token", "left_semi").select("leader", "id", "c").distinct()
    rest = C.cut(rest.join(meta.select("id", "p"), "id"))
    extra = C.cut(cross_links(rest, full, similarity))

    ids = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")  # documents of several texts
    ids = known.select("doc_id", F.col("key").alias("b")).join(ids.select("doc_id", "a"), "doc_id").where("a <> b").select("a", "b").distinct()
    last = components(links.unionByName(extra).unionByName(ids))
    last = last.unionByName(last.select(F.col("root").alias("id"), "root").distinct())

    reps = known.groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("rep"))
    roots = reps.join(last, "id").groupBy("root").agg(F.min("rep").alias("component"))
    member = reps.join(last, "id", "left").join(roots, "root", "left").select(F.col("id").alias("key"), F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n", "key").join(member, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs whose document stands for its group (or has no id); columns pass unchanged."""
    gone = C.cut(near_duplicates(docs, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__quarry_id")).distinct())
    marked = C.may_be_among(docs, docs["doc_id"], gone, "__quarry_may")
    unsure = marked.where("__quarry_may").drop("__quarry_may")
    left = unsure.join(gone, unsure["doc_id"].cast("long") == gone["__quarry_id"], "left_anti")
    return marked.where("not __quarry_may").select(*docs.columns).unionByName(left.select(*docs.columns))


def brute(texts: dict, similarity: int = SIMILARITY) -> dict:
    """Reference by plain loops: doc_id -> (n_shingles, component_id). For tests."""
    sets = {}
    for d, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[d] = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}
