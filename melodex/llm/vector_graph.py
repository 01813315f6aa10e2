"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are counted once. The others go to the shards of their nearest centroids (learnt from a bounded sample; from
many vectors on, centroids below centroids), several each, so that shards overlap; the nearest is a vector's home. In each
shard a flat graph is built: of its nearest and of random others a node keeps those that no kept neighbour lies much closer
to (robust pruning). The adjacency lists of all shards are united. Then every vector is searched for in its home: a greedy
search from the shard's medoid, and from the found nodes and its own a walk that expands over everything within a widened
range. The walk goes by single precision; the cosines of what it finds are verified in double precision. A pair that both
homes see counts in the first of them. Recall is audited against brute force on a bounded sample of vectors, over all their
links and as the mean of the vectors, and the overlap grows until both are high enough. A shard too large for one task is
cut into blocks, and each pair of blocks is a task; nothing is left out.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import spread_join, written
from .components import components, with_least

#: Least cosine of a link; how much wider the walk's range is; neighbours that pruning keeps, and that a search sees at
#: most (of both directions); candidates for them; beam of the search.
LEAST, SLACK, DEGREE, SEEN, NEAREST, RANDOM, BEAM = 0.9, 0.15, 12, 24, 24, 8, 3
#: Vectors of a shard that is aimed at, and of a task at most; centroids that are learnt and shared at once, and sampled
#: vectors for each; vectors of a cell that get their centroids below it together.
SHARD, TASK, CENTROIDS, EACH, TOGETHER = 400, 4000, 4096, 8, 50_000
#: Shards of a vector at first and at most; audited vectors; recall asked for, and the least that is accepted.
OVERLAP, MOST_OVERLAP, AUDITED, GOAL, ACCEPTED = 3, 12, 1024, 0.99, 0.9
#: Vectors with many copies that are broadcast at most.
HOT_VECTORS = 1000
_ALPHA, _BLOCK, _SEED, _ROUNDING = 2.0, 256, 5, 1e-4


def unit(vectors) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_centroids(x: np.ndarray, k: int, rounds: int = 3) -> np.ndarray:
    """Spherical k-means over a sample."""
    rng = np.random.default_rng(_SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def robust_prune(near: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Of each row's candidates keep the next nearest until all that is left lies near a kept one.

    ``near`` has the cosines of all nodes; -1 among the candidates stands for none, and among the kept ones too."""
    far = 1 - near[rows[:, None], cand]
    far[(cand == rows[:, None]) | (cand < 0)] = np.inf
    out = np.full((len(rows), degree), -1, dtype=np.int32)
    own = np.arange(len(rows))
    for k in range(min(degree, cand.shape[1])):
        pick = far.argmin(axis=1)
        there = np.isfinite(far[own, pick])
        if not there.any():
            break
        kept = cand[own, pick]
        out[there, k] = kept[there]
        far[(_ALPHA * (1 - near[kept[:, None], cand]) <= far) & there[:, None]] = np.inf
        far[own, pick] = np.inf
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency (n, DEGREE), -1 where there is none, of one task's graph; candidates come from one matrix product."""
    n = len(x)
    rng = np.random.default_rng(_SEED)
    x = x.astype(np.float32)
    near = x @ x.T
    parts = []
    for a in range(0, n, _BLOCK):
        rows = np.arange(a, min(n, a + _BLOCK))
        k = min(NEAREST + 1, n)
        cand = np.argpartition(-near[rows], k - 1, axis=1)[:, :k]
        parts.append(robust_prune(near, rows, np.concatenate([cand, rng.integers(0, n, (len(rows), min(RANDOM, n)))], axis=1)))
    return np.concatenate(parts)


def both_ways(x: np.ndarray, owner: np.ndarray, other: np.ndarray, most: int = SEEN) -> np.ndarray:
    """Adjacency (n, most) over edges in both directions; nodes with more neighbours keep the robust-pruned ones."""
    n = len(x)
    pair = np.unique(np.concatenate([owner * n + other, other * n + owner]))
    owner, other = pair // n, pair % n
    rank = np.arange(len(pair)) - np.searchsorted(owner, owner, side="left")
    size = np.bincount(owner, minlength=n)
    out = np.full((n, most), -1, dtype=np.int64)
    few = size[owner] <= most
    out[owner[few], rank[few]] = other[few]
    for v in np.flatnonzero(size > most):
        cand = other[np.searchsorted(owner, v) : np.searchsorted(owner, v, side="right")]
        local = np.concatenate([[v], cand])
        kept = robust_prune(x[local] @ x[local].T, np.array([0]), np.arange(1, len(local))[None, :], most)[0]
        out[v, : (kept >= 0).sum()] = local[kept[kept >= 0]]
    return out


def search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, least: float = LEAST, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) pairs found with a cosine of ``least`` or more, without the query itself."""
    n = len(x)
    low = np.concatenate([x, np.zeros((1, x.shape[1]))]).astype(np.float32)  # row n stands for no neighbour
    medoid = int((x @ x.mean(axis=0)).argmax())
    adj1 = np.concatenate([np.where(adj < 0, n, adj), np.full((1, adj.shape[1]), n)])
    found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide = least - slack
    for a in range(0, len(queries), _BLOCK):
        q = queries[a : a + _BLOCK]
        own, v = np.arange(len(q)), low[q]
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = seen[:, medoid] = True
        beam = np.full((len(q), BEAM), medoid)
        score = np.full((len(q), BEAM), -np.inf, dtype=np.float32)
        score[:, 0] = v @ low[medoid]
        done = np.full((len(q), BEAM), True)
        done[:, 0] = False
        hits_q, hits_n, hits_s = [own], [np.full(len(q), medoid)], [score[:, 0].copy()]
        while True:
            best = np.where(done, -np.inf, score).argmax(axis=1)
            on = np.flatnonzero(~done[own, best])
            if not len(on):
                break
            done[on, best[on]] = True
            next_ = adj1[beam[on, best[on]]]
            fresh = ~seen[on[:, None], next_]
            s = np.where(fresh, (low[next_] @ v[on][:, :, None])[:, :, 0], -np.inf)
            seen[on[:, None], next_] = True
            r, c = np.nonzero(s >= wide)
            hits_q.append(on[r]), hits_n.append(next_[r, c]), hits_s.append(s[r, c])
            all_n, all_s = np.concatenate([beam[on], next_], axis=1), np.concatenate([score[on], s], axis=1)
            all_d = np.concatenate([done[on], ~fresh], axis=1)
            top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
            beam[on], score[on], done[on] = (np.take_along_axis(z, top, axis=1) for z in (all_n, all_s, all_d))
            done[score == -np.inf] = True
        hq, hn, hs = map(np.concatenate, (hits_q, hits_n, hits_s))
        mine = ~seen[own, q]
        seen[own, q] = True
        fq, fn = np.concatenate([hq[hs >= wide], own[mine]]), np.concatenate([hn[hs >= wide], q[mine]])
        got_q, got_n = [hq[hs >= least - _ROUNDING]], [hn[hs >= least - _ROUNDING]]
        mark = np.zeros(len(q) * (n + 1), dtype=bool)
        while len(fq):
            new = []
            for b in range(0, len(fq), 1 << 15):
                key = (fq[b : b + (1 << 15), None] * (n + 1) + adj1[fn[b : b + (1 << 15)]]).ravel()
                mark[key[~seen.ravel()[key]]] = True
                key = np.flatnonzero(mark)
                mark[key] = False
                cq, cn = key // (n + 1), key % (n + 1)
                seen[cq, cn] = True
                s = np.concatenate([np.zeros(0, np.float32), *[np.einsum("nd,nd->n", v[cq[c : c + (1 << 16)]], low[cn[c : c + (1 << 16)]]) for c in range(0, len(cq), 1 << 16)]])
                new.append((cq[s >= wide], cn[s >= wide], s[s >= wide]))
            fq, fn, fs = (np.concatenate(z) for z in zip(*new))
            got_q.append(fq[fs >= least - _ROUNDING]), got_n.append(fn[fs >= least - _ROUNDING])
        gq, gn = q[np.concatenate(got_q)], np.concatenate(got_n)
        for b in range(0, len(gq), 1 << 16):
            i, j = gq[b : b + (1 << 16)], gn[b : b + (1 << 16)]
            ok = (np.einsum("nd,nd->n", x[i], x[j]) >= least) & (i != j)
            found_q.append(i[ok]), found_n.append(j[ok])
    return np.concatenate(found_q), np.concatenate(found_n)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    return root


_ITEM = "node long, copies long, vec binary, shards array<long>"


def _matrix(rows: pd.DataFrame, kind: str) -> np.ndarray:
    """Rows of length one in double precision, from components of the given kind."""
    return unit(np.frombuffer(b"".join(map(bytes, rows["vec"])), dtype=kind).reshape(len(rows), -1))


def _graph(key: tuple, rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Adjacency lists by node of one task."""
    rows = rows.sort_values("node")
    node = rows["node"].to_numpy()
    adj = build(_matrix(rows, kind))
    return pd.DataFrame({"node": node, "near": [node[r[r >= 0]] for r in adj]})


def _found(key: tuple, rows: pd.DataFrame, near: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Links (weighted by copies) that count in this task, and the smallest node reached here, by node."""
    shard, low, high = key
    rows = rows.sort_values("node")
    node, copies, block = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    x, n = _matrix(rows, kind), len(rows)
    lists = [np.asarray(r) for r in near.sort_values("node")["near"]]  # one for each row
    flat, owner = np.concatenate(lists), np.repeat(np.arange(n), [len(r) for r in lists])
    at = np.minimum(np.searchsorted(node, flat), n - 1)
    here = node[at] == flat  # of the united lists, what lies in this task
    own = np.stack([np.asarray(s) for s in rows["shards"]])
    home = own[:, 0]
    a, b = search(x, both_ways(x, owner[here], at[here]), np.flatnonzero(home == shard))
    if low != high:
        cross = block[a] != block[b]
        a, b = a[cross], b[cross]
    counts = ~((home[b] < shard) & (own[a] == home[b][:, None]).any(axis=1))  # else b's home sees both, and comes first
    pair = np.unique(np.concatenate([a[counts] * n + b[counts], b[counts] * n + a[counts]]))
    links = np.bincount(pair // n, weights=copies[pair % n], minlength=n)
    return pd.DataFrame({"node": node, "links": links.astype(np.int64), "root": node[_roots(n, a, b)]})


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, the nearest first."""
    near = x @ c.T
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)


def _assign(items: DataFrame, centroids, overlap: int, kind: str) -> DataFrame:
    """Items with the shards of their nearest centroids (of their own length), the nearest first."""

    def of(batches):
        for rows in batches:
            size = rows["vec"].map(len).to_numpy() // np.dtype(kind).itemsize
            shards: list = [None] * len(rows)
            for d in np.unique(size):
                first, c = centroids.value[int(d)]
                pick = np.flatnonzero(size == d)
                k = min(overlap, len(c))
                top = _nearest(_matrix(rows.iloc[pick], kind), c, k) + first
                for i, t in zip(pick.tolist(), np.pad(top, ((0, 0), (0, overlap - k)), mode="edge")):
                    shards[i] = t
            yield rows.assign(shards=shards)

    return items.mapInPandas(of, _ITEM)


def _assign_below(cells: DataFrame, overlap: int, shard: int, kind: str) -> DataFrame:
    """Items that came with their nearest ``shards``, as cells that hold too many: cut further by centroids below them.

    Each cell's centroids are learnt in a task from a bounded sample of it. A vector takes the nearest of those below all
    its cells: its parts, dealt over tasks by cell, bring their best, and the best of all are its shards.
    """
    spread = cells.withColumn("cell", F.explode(F.array_distinct("shards")))
    sizes = written(spread.groupBy("cell").agg(F.count("*").alias("n")))
    spin = F.pmod(F.xxhash64("node", F.lit(_SEED)), F.lit(1 << 30)) / float(1 << 30)
    want = F.greatest(F.lit(1), F.least(F.lit(CENTROIDS), F.expr(f"cast(n / {overlap * shard} as int)")))
    sample = spread.join(F.broadcast(sizes), "cell").withColumn("k", want).where(spin * F.col("n") < 2 * EACH * F.col("k")).select("cell", "k", "vec")

    def learnt(rows: pd.DataFrame) -> pd.DataFrame:
        c = learn_centroids(_matrix(rows, kind), int(rows["k"].iloc[0]))
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "c": [c.astype("<f8").tobytes()], "number": [len(c)]})

    below = written(sample.groupBy("cell").applyInPandas(learnt, "cell long, c binary, number long"))
    deals = F.greatest(F.lit(1), F.expr(f"cast(ceil(n / {TOGETHER}) as int)"))
    dealt = spread.join(F.broadcast(sizes), "cell").withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")).select("node", "copies", "vec", "cell", "deal")
    copies = below.join(F.broadcast(sizes), "cell").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).select("cell", "deal", "c")

    def of(rows: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(c):
            return pd.DataFrame({"node": [], "near": [], "shard": []}).astype({"node": "int64", "near": "float64", "shard": "int64"})
        x = _matrix(rows, kind)
        c_ = np.frombuffer(bytes(c["c"].iloc[0]), dtype="<f8").reshape(-1, x.shape[1])
        k = min(overlap, len(c_))
        top = _nearest(x, c_, k)
        near = np.take_along_axis(x @ c_.T, top, axis=1)
        return pd.DataFrame({"node": np.repeat(rows["node"].to_numpy(), k), "near": near.ravel(), "shard": (rows["cell"].to_numpy()[:, None] * CENTROIDS + top).ravel()})

    best = dealt.groupBy("cell", "deal").cogroup(copies.groupBy("cell", "deal")).applyInPandas(of, "node long, near double, shard long")
    ranked = best.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "shard")), asc=False), 1, overlap).alias("s"))  # overlap squared at most
    padded = F.transform(F.sequence(F.lit(0), F.lit(overlap - 1)), lambda i: F.coalesce(F.get("s.shard", i), F.element_at("s.shard", -1)))
    return cells.drop("shards").join(written(ranked.select("node", padded.alias("shards"))).hint("merge"), "node")


def _links(items: DataFrame, centroids, overlap: int, deep: bool, shard: int, kind: str) -> DataFrame:
    """(node, links, root) summed over tasks: links weighted by copies, and component edges."""
    assigned = _assign(items, centroids, overlap, kind)
    if deep:
        assigned = _assign_below(written(assigned), overlap, shard, kind)
    placed = written(assigned.withColumn("shard", F.explode(F.array_distinct("shards"))))
    large = written(placed.groupBy("shard").count().where(F.col("count") > TASK).select("shard", F.expr(f"cast(ceil(count / {TASK // 2}) as int)").alias("blocks")))
    few = large.count() <= 100_000
    tasks = (
        placed.join(F.broadcast(large) if few else large.hint("merge"), "shard", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "copies", "vec", "shards", "shard", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    keys = ["shard", "low", "high"]
    lists = tasks.select(*keys, "node", "vec").groupBy(*keys).applyInPandas(lambda key, rows: _graph(key, rows, kind), "node long, near array<long>")
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    # The lists go to the tasks, so that the vectors needn't be shuffled to the lists.
    near = tasks.select(F.col("node").alias("node"), *[F.col(k).alias(f"to_{k}") for k in keys]).join(united.hint("merge"), "node")
    both = tasks.groupBy(*keys).cogroup(near.groupBy(*[f"to_{k}" for k in keys]))
    return written(both.applyInPandas(lambda key, rows, near: _found(key, rows, near, kind), "node long, links long, root long"))


def _recall(items: DataFrame, found: DataFrame, kind: str) -> float:
    """Recall of a bounded sample of vectors against brute force over all items: the lesser of the share of their true
    links that were found, and the mean share of the vectors that have links other than copies."""
    n = max(1, items.count())
    drawn = items.where(F.pmod(F.xxhash64("node", F.lit(_SEED)), F.lit(1 << 30)) < int(min(1, AUDITED / n) * (1 << 30)) + 1).limit(2 * AUDITED).select("node", "vec").toPandas()
    if not len(drawn):
        return 1.0
    shared = items.sparkSession.sparkContext.broadcast({d: (g["node"].to_numpy(), _matrix(g, kind)) for d, g in drawn.groupby(drawn["vec"].map(len))})

    def count(batches):
        for rows in batches:
            out = []
            for d, g in rows.groupby(rows["vec"].map(len)):
                if d in shared.value:
                    ids, q = shared.value[d]
                    near = (_matrix(g, kind) @ q.T >= LEAST) & (g["node"].to_numpy()[:, None] != ids)
                    out.append(pd.DataFrame({"node": ids, "true": (near * g["copies"].to_numpy()[:, None]).sum(axis=0)}))
            yield pd.concat(out) if out else pd.DataFrame({"node": [], "true": []}).astype("int64")

    true = items.mapInPandas(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = found.groupBy("node").agg(F.sum("links").alias("links"))
    hit = F.least("true", F.coalesce("links", F.lit(0)))
    both = true.where(F.col("true") > 0).join(got.hint("merge"), "node", "left").agg(F.sum("true"), F.sum(hit), F.avg(hit / F.col("true"))).first()
    return min(both[1] / both[0], both[2]) if both[0] else 1.0


def near_duplicates(embeddings: DataFrame, overlap: int = OVERLAP, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (audited share of true links found) of every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id, link with
    nothing and are components of their own; vectors of different lengths don't link. Equal vectors link with each other.
    Rows that repeat an id are rows of their own. ``kept`` is false where the id is null. No rows: none. Other columns
    are not read. An overlap of MOST_OVERLAP is enough where it brings ACCEPTED; otherwise it goes on growing, in the end to
    all shards, and only a recall below ACCEPTED with all vectors in all shards raises.
    """
    spark = embeddings.sparkSession
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.col("embedding")).alias("embedding"))
    groups = written(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))

    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)  # vectors travel as they came, and are scaled in double precision

    @F.pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=kind).tobytes() for v in batch], dtype=object)

    items = written(groups.select("node", "copies", packed("embedding").alias("vec")))
    lengths = {r.n: r["count"] for r in items.groupBy((F.octet_length("vec") / width).cast("int").alias("n")).count().limit(1001).collect()}
    if len(lengths) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    centroids, first = {}, 0
    for d, n in sorted(lengths.items()):
        k = max(1, min(CENTROIDS, n // shard))  # beyond CENTROIDS shards each has centroids of its own below it
        drawn = items.where((F.octet_length("vec") == width * d) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(min(1, 2 * EACH * k / n) * (1 << 30)))).select("vec").limit(2 * EACH * k)
        centroids[d] = (first, learn_centroids(_matrix(drawn.toPandas(), kind), k))
        first += len(centroids[d][1])
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("recall"))
    shared = spark.sparkContext.broadcast(centroids)
    every = max(len(c) for _, c in centroids.values())
    while True:
        found = _links(items, shared, overlap, max(lengths.values()) > 2 * CENTROIDS * shard, shard, kind)
        recall = _recall(items, found, kind)
        if recall >= GOAL or (overlap >= MOST_OVERLAP and recall >= ACCEPTED) or overlap >= max(every, MOST_OVERLAP):
            break
        overlap = 2 * overlap if overlap >= MOST_OVERLAP else min(MOST_OVERLAP, 2 * overlap)
    if recall < ACCEPTED:
        raise RuntimeError(f"recall is {recall:.3f}")
    nodes = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    joined = with_least(written(nodes.join(groups.select("node", "rep").hint("merge"), "node")), "rep").select("node", "component_id")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = written(
        groups.join(counted.hint("merge"), "node", "left")
        .join(joined.hint("merge"), "node", "left")
        .select("embedding", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    total = of.agg(F.sum("n")).first()[0]
    done = spread_join(rows.where("embedding is not null"), of, "embedding", total, "vec_id", keys=HOT_VECTORS).select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("recall"))
