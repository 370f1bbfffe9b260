"""Most similar vectors for every vector: inverted lists scanned in blocks of rotated dimensions.

Vectors are collapsed to distinct ones, each with its smallest identifiers. Centroids, as many as the square root of the
vectors, are fitted on a bounded sample; every distinct vector is filed under its nearest centroid and asks the lists of
its nearest few. Lists beside each other form a group that one task scans, and a question goes to a group once, with
the names of its lists. Within a list the
coordinates are rotated at random, so that the distance over the first dimensions estimates the whole one; a
hypothesis test after each block of dimensions abandons candidates that are unlikely to be near enough. Survivors get
their exact cosine. A pair found from one side counts for both, which squares the chance of a miss.

Lists find neighbours of similarity ``SURE`` or more; what is less alike lies in any list. A vector with fewer than the
wanted number of those is therefore compared with all distinct vectors, in pairs of blocks, bound by its best so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.topn import top_n
from scrivener.session import cut

#: Vectors that the centroids are fitted on: so many for each list, at most ``SAMPLE`` in all; all vectors are filed and searched.
SAMPLE_OF_LIST, SAMPLE = 64, 1 << 20
#: Fewest lists; otherwise there are as many as the square root of the vectors, up to a sixteenth of ``SAMPLE``.
FEWEST_LISTS = 4
#: Lists that are fitted at once; more are fitted in two steps.
FITTED_AT_ONCE = 512
#: Rows at most of one list block and one block of questions in a task.
BLOCK, QUESTIONS = 8_192, 16_384
#: Questions at most of a task that scans a group of lists; each names a few of them.
GROUP_QUESTIONS = 131_072
STEP = 16
#: Neighbours of this similarity are found by the lists; a vector with too few of them is compared with all others.
SURE = 0.8
#: Where the first test leaves more than this share of the pairs, abandoning costs more than the whole products.
DENSE = 0.05
#: Width of the hypothesis test: larger abandons fewer true neighbours.
EPSILON = 2.1
_SCHEMA_FILED = "rep long, list int, near array<int>, vec binary"


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty list takes a vector at random."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        empty = np.linalg.norm(sums, axis=1) < 1e-6
        sums[empty] = x[rng.choice(len(x), empty.sum())]
        c = unit(sums)
    return c.astype(np.float32)


def scan(q: np.ndarray, x: np.ndarray, q_id: np.ndarray, x_id: np.ndarray, least: float | None, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each question at most ``keep`` rows of ``x`` of similarity ``least`` or more, if it is given: question, row, cosine.

    Adaptive: the bound of a question rises to its ``keep``-th best so far as the blocks of rows go by.
    """
    least = -2.0 if least is None else least
    dims = q.shape[1]
    turn = rotation(dims)
    qd, xd = unit(q.astype(np.float64)), unit(x.astype(np.float64))
    qr, xr = qd.astype(np.float32) @ turn, xd.astype(np.float32) @ turn
    # partial distances below a dimension are at most the bound times this, but for rare cases
    slack = {d: d / dims * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dims else 1.0 for d in range(STEP, dims + 1, STEP)}
    slack[dims] = 1.0
    bound = np.full(len(q), least - 1e-5)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(q), keep), -2.0)
    whole = False
    for a in range(0, len(x), 1024):
        part = xr[a : a + 1024]
        far = (2 - 2 * bound).astype(np.float32)[:, None]
        if not whole:
            d0 = (qr[:, :STEP] ** 2).sum(1)[:, None] + (part[:, :STEP] ** 2).sum(1)[None] - 2 * (qr[:, :STEP] @ part[:, :STEP].T)
            live = d0 <= far * slack[STEP]
            whole = np.count_nonzero(live) > DENSE * live.size
        if whole:
            dots = qr @ part.T
            live = dots >= (bound - 1e-5).astype(np.float32)[:, None]
            if np.count_nonzero(live) > DENSE * live.size and len(part) > keep + 1:
                # no bound yet: the keep best of this block, and the question itself
                live &= dots >= np.partition(dots, -keep - 1, axis=1)[:, [-keep - 1]] - np.float32(1e-4)
            i, j = np.nonzero(live)
        else:
            i, j = np.nonzero(live)
            dist = d0[i, j]
            for d in range(STEP, dims, STEP):
                e = min(d + STEP, dims)
                dist = dist + ((qr[i, d:e] - part[j, d:e]) ** 2).sum(1)
                near = dist <= far[i, 0] * slack[e] + 1e-5
                i, j, dist = i[near], j[near], dist[near]
        own = q_id[i] != x_id[a + j]
        i, j = i[own], j[own]
        s = np.round(np.einsum("ij,ij->i", qd[i], xd[a + j]), 6)
        good = s >= least
        i, j, s = i[good], j[good], s[good]
        if len(i):
            order = np.lexsort((x_id[a + j], -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            top = place < keep
            i, j, s, place = i[top], j[top], s[top], place[top]
            found.append((i, a + j, s))
            new = np.full((len(q), keep), -2.0)
            new[i, place] = s
            best = -np.sort(-np.hstack([best, new]), axis=1)[:, :keep]
            bound = np.maximum(bound, best[:, -1] - 1e-5)
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((x_id[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    top = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < keep
    return i[top], j[top], s[top]


def valid(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id`` and ``v`` of the vectors with ``dims`` finite numbers that are not all zero, each id once."""
    v = F.transform(F.col(vector).cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    good = f"id is not null and size(v) = {dims} and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))"
    return rows.where(good + " and exists(v, x -> x <> 0)").dropDuplicates(["id"])


def _distinct(rows: DataFrame) -> DataFrame:
    """Each distinct vector: two hashes of it, its smallest id ``rep``, the number of its copies."""
    hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    return hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v"), F.count("*").alias("copies"))


def fit_lists(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``lists`` lists, near ones beside each other; many of them within the parts of a coarser division."""
    coarse = fit_centroids(x, max(1, int(np.sqrt(lists))))
    if lists <= FITTED_AT_ONCE:
        c = fit_centroids(x, lists)
        return c[np.argsort((c @ coarse.T).argmax(1), kind="stable")]
    home = np.concatenate([(x[i : i + 4096] @ coarse.T).argmax(1) for i in range(0, len(x), 4096)])
    sizes = np.bincount(home, minlength=len(coarse))
    share = np.maximum(1, np.round(lists * sizes / len(x)).astype(int))
    return np.concatenate([fit_centroids(x[home == i], n) for i, n in enumerate(share) if sizes[i]])


def _file(reps: DataFrame, dims: int, n: int, probes: int) -> tuple[DataFrame, int]:
    lists = int(np.clip(np.sqrt(n), FEWEST_LISTS, SAMPLE // 16))
    wanted = min(n, SAMPLE, SAMPLE_OF_LIST * lists)
    some = reps.select("rep", "v")
    if wanted < n:
        some = some.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < int(1.2 * wanted / n * (1 << 40)) + 1).orderBy(F.xxhash64("rep")).limit(wanted)
    sample = sorted(some.collect())  # at most SAMPLE rows
    x = unit(np.array([r.v for r in sample], np.float32).reshape(len(sample), dims)) if sample else np.eye(dims, dtype=np.float32)[:1]
    c = fit_lists(x, lists)
    p = min(probes, len(c))

    def file(it):
        for batch in it:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            if not len(v):
                continue
            parts = [unit(v[i : i + 1024]) @ c.T for i in range(0, len(v), 1024)]
            near = np.concatenate([np.argpartition(-s, p - 1, axis=1)[:, :p] for s in parts]).astype(np.int32)
            home = np.concatenate([s.argmax(1) for s in parts]).astype(np.int32)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(home), pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), pa.array([r.tobytes() for r in v], pa.binary())],
                names=["rep", "list", "near", "vec"],
            )

    return reps.select("rep", "v").mapInArrow(file, _SCHEMA_FILED), len(c)


def _spread(rep: np.ndarray) -> np.ndarray:
    """A hash of identifiers."""
    z = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def _groups(rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring lists in groups of at most ``BLOCK`` rows: each list's group, each group's blocks of rows and of questions.

    A list above ``BLOCK`` is a group of several blocks.
    """
    group_of = np.zeros(len(rows), np.int32)
    group, size = 0, 0
    for i, n in enumerate(rows):
        if size and size + n > BLOCK:
            group, size = group + 1, 0
        group_of[i] = group
        size += n
    x = np.maximum(1, -(-np.bincount(group_of, rows) // BLOCK)).astype(np.int64)
    return group_of, x, np.maximum(1, -(-np.bincount(group_of, asked) // GROUP_QUESTIONS)).astype(np.int64)


_SCHEMA_SENT = "node int, x int, q int, asks boolean, rep long, lists array<int>, vec binary"


def _send(filed: DataFrame, group_of: np.ndarray, x_blocks: np.ndarray, q_blocks: np.ndarray) -> DataFrame:
    """Every vector as a row of its list's group, and once as a question to each group that holds lists near it."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            m = len(batch)
            if not m:
                continue
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            home = batch.column(1).to_numpy(zero_copy_only=False)
            near = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
            mixed = _spread(rep)
            # questions: a run of equal groups in the sorted row is one question
            order = np.argsort(group_of[near], axis=1, kind="stable")
            lists = np.take_along_axis(near, order, 1)
            groups = group_of[lists]
            first = np.ones_like(groups, bool)
            first[:, 1:] = groups[:, 1:] != groups[:, :-1]
            q_row, q_at = np.nonzero(first)
            starts = q_row * near.shape[1] + q_at
            q_len = np.diff(np.r_[starts, m * near.shape[1]])
            q_node = groups[q_row, q_at]
            for asks, row, node in ((False, np.arange(m), group_of[home]), (True, q_row, q_node)):
                own, other = (q_blocks, x_blocks) if asks else (x_blocks, q_blocks)
                block = (mixed[row] % own[node].astype(np.uint64)).astype(np.int32)
                times = other[node]
                again = np.repeat(np.arange(len(row)), times)  # to every block of the other side
                each = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                if asks:
                    size = q_len[again]
                    at = np.repeat(starts[again] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    held = lists.ravel()[at]
                else:
                    size, held = np.ones(len(again), np.int64), home[again]
                offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                x, q = (each, block[again]) if asks else (block[again], each)
                taken = pa.array(row[again])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[again].astype(np.int32)), pa.array(x), pa.array(q), pa.array(np.full(len(again), asks)), batch.column(0).take(taken),
                        pa.ListArray.from_arrays(offsets, pa.array(held.astype(np.int32))), batch.column(3).take(taken),
                    ],
                    names=["node", "x", "q", "asks", "rep", "lists", "vec"],
                )

    return filed.mapInArrow(send, _SCHEMA_SENT)


def _search_lists(dims: int, least: float | None, keep: int) -> Callable[[pa.Table], pa.Table]:
    """Scan of the lists of a group, each for the questions that name it."""

    def search(t: pa.Table) -> pa.Table:
        is_q = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = t.column("rep").to_numpy()
        v = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dims)
        lists = t.column("lists").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((is_q[of], flat))
        flat, of = flat[order], of[order]
        ends = np.r_[np.flatnonzero(flat[1:] != flat[:-1]) + 1, len(flat)] if len(flat) else np.zeros(0, int)
        parts = []
        a = 0
        for b in ends:
            own = of[a:b]
            x, q = own[~is_q[own]], own[is_q[own]]
            a = b
            if len(x):
                for c in range(0, len(q), 1024):
                    some = q[c : c + 1024]
                    i, j, s = scan(v[some], v[x], ids[some], ids[x], least, keep)
                    parts.append((ids[some[i]], ids[x[j]], s))
        out = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "s": pa.array(out[2], pa.float64())})

    return search


def _search(dims: int, least: float | None, keep: int) -> Callable[[pa.Table], pa.Table]:
    """Scan of a block of rows for a block of questions."""

    def search(t: pa.Table) -> pa.Table:
        is_q = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = t.column("rep").to_numpy()
        v = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dims)
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if is_q.any() and not is_q.all():
            qi, xi, q, x = ids[is_q], ids[~is_q], v[is_q], v[~is_q]
            parts = []
            for a in range(0, len(qi), 1024):
                i, j, s = scan(q[a : a + 1024], x, qi[a : a + 1024], xi, least, keep)
                parts.append((qi[a + i], xi[j], s))
            out = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "s": pa.array(out[2], pa.float64())})

    return search


def _all_pairs(asking: DataFrame, filed: DataFrame, n: int, dims: int, least: float | None, keep: int) -> DataFrame:
    """``a, b, s``: the ``keep`` best of all ``n`` rows for each of ``asking``, from every pair of blocks."""
    q_blocks, x_blocks = -(-asking.count() // QUESTIONS), -(-n // BLOCK)

    def block(blocks: int) -> F.Column:
        return F.pmod(F.xxhash64("rep"), F.lit(max(1, blocks)).cast("long")).cast("int")

    def all_blocks(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))

    stored = filed.select("rep", "vec", F.lit(False).alias("asks"), block(x_blocks).alias("x"), all_blocks(q_blocks).alias("q"))
    asks = asking.select("rep", "vec", F.lit(True).alias("asks"), all_blocks(x_blocks).alias("x"), block(q_blocks).alias("q"))
    return stored.unionByName(asks).groupBy("x", "q").applyInArrow(_search(dims, least, keep), "a long, b long, s double")


def similar_pairs(reps: DataFrame, dims: int, least: float | None, keep: int, probes: int) -> DataFrame:
    """``a, b, s``: for each distinct vector ``a`` at most ``keep`` others, from questions in either direction."""
    floor = SURE if least is None else max(least, SURE)
    n = reps.count()
    filed, lists = _file(reps, dims, n, probes)
    filed = cut(filed)
    rows, asked = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for counts, of in ((rows, filed.select("list")), (asked, filed.select(F.explode("near").alias("list")))):
        for r in of.groupBy("list").count().collect():  # one row for each list
            counts[r["list"]] = r["count"]
    sent = _send(filed, *_groups(rows, asked))
    found = cut(sent.groupBy("node", "x", "q").applyInArrow(_search_lists(dims, floor, keep), "a long, b long, s double"))
    best = top_n(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")), ["a"], "s", "b", keep).drop("place")
    if least is not None and least >= SURE:
        return best
    best = cut(best)
    settled = best.groupBy("a").count().where(F.col("count") >= keep).select(F.col("a").alias("rep"))
    asking = cut(filed.join(settled, "rep", "left_anti").select("rep", "vec"))
    return top_n(best.unionByName(_all_pairs(asking, filed, n, dims, least, keep)), ["a"], "s", "b", keep).drop("place")


def nearest(df: DataFrame, key: str, vector: str, k: int, least: float | None = None, dims: int = 64, probes: int = 12, salts: int = 8) -> DataFrame:
    """``id, other, similarity, place`` (int): for each vector its ``k`` most similar others, of similarity ``least`` or more if it is given.

    Similarity is the cosine in double precision, rounded to 6 decimals; of equal similarity the smaller id comes
    first. Vectors that are null, of another length, with nulls, NaN or infinite numbers, or all zero, and null ids have
    no row and are in no result; an id given several times counts once. Exact copies are searched once, whatever their
    number, and answer with their smallest ids. An empty table gives no rows. Approximate: recall against brute force
    is measured by the tests.
    """
    rows = valid(df, key, vector, dims)
    reps = cut(_distinct(rows))
    members = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    salted_members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))  # a vector may have any number of copies
    # the k + 1 smallest ids of vectors with copies
    copied = reps.where("copies > 1").select("h1", "h2", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    many = salted_members.join(copied, ["h1", "h2", "salt"]).select("rep", "id", F.lit(1.0).alias("s"))
    first = top_n(many, ["rep"], "s", "id", k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = similar_pairs(reps, dims, least, k + 1, probes)
    answers = pairs.join(first.withColumnRenamed("rep", "b"), "b", "left")
    answers = answers.select("a", "s", F.explode(F.coalesce("ids", F.array("b"))).alias("id"))
    own = first.select(F.col("rep").alias("a"), F.lit(1.0).alias("s"), F.explode("ids").alias("id"))
    best = top_n(answers.unionByName(own), ["a"], "s", "id", k + 1)
    lists = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "id", "s"))).alias("best"))
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    of_rep = reps.select("h1", "h2", F.col("rep").alias("a")).join(salted, "a").drop("a")
    full = salted_members.join(of_rep, ["h1", "h2", "salt"])
    others = F.slice(F.expr("filter(best, x -> x.id <> id)"), 1, k)
    out = full.select("id", F.posexplode(others).alias("at", "x"))
    return out.select("id", F.col("x.id").alias("other"), F.col("x.s").alias("similarity"), (F.col("at") + 1).cast("int").alias("place"))
