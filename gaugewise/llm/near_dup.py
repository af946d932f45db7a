"""MinHash near-dedup with Order MinHash, verified by banded alignment.

1. Exact copies (MD5 of the text) stand back for one document of theirs, the one of least id.
2. A document's k-mers are its runs of ``K`` words, labelled with their occurrence number, so that
   all are distinct. An order-min-hash sketch takes the ``ELL`` labelled k-mers of least hash and
   hashes them in the order of the text: it is alike for two texts if they share those k-mers and
   keep their order, so it follows edit similarity.
3. ``ROWS`` sketches make the key of a band. The rows of all bands are sorted by band, key and the
   following sketches, and each is paired with the ``NEAR`` rows before it that share its key. That
   is every pair of a key of up to ``NEAR`` + 1 rows; a range partitioning spreads larger keys over tasks.
4. Pairs are verified by aligning the sequences of labelled k-mers in the band of diagonals in which
   a pair of the required similarity must lie: matched / (all - matched) >= ``SIMILARITY``.
5. Classes are the connected components of verified pairs, by large-star and small-star rounds; between
   them each task turns the links it holds into stars, so that few rounds are left.
6. A larger key whose rows fall in more than one class goes on in rounds: its row of most links and a
   share of its rows that grows ``GROWTH``-fold, up to all, are representatives, and every row of
   another class meets them. Rows of the key's home, the class that was its largest at first, are none:
   two of them are in one class, and every other row meets them in its own turn. Sizes and parity bits
   of the labelled k-mers refute most pairs without loss, the others are verified. So in the end each
   pair of a key is in one class, or is refuted.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gaugewise.llm._common import col, drop_written, fresh, trimmed, word_bytes, written

K, ELL, BANDS, ROWS, NEAR, SIMILARITY = 5, 2, 24, 2, 2, 0.8
#: Representatives of a larger key in its first round, and the factor from round to round.
GROWTH = 16
#: Tasks that the rows of one key, or the pairs of one representative, are dealt over.
SALTS = 16
#: Pairs of one key in a round for each of these tasks, at least: some tenths of a second.
SALT_PAIRS = 1 << 18
#: A text of this many copies or more, and of a share of all rows above 1 / HOT_TEXTS, is handed to all tasks.
HOT_COPIES, HOT_TEXTS = 1000, 100_000
#: Ids of texts to verify that are handed to all tasks, 16 MB; for more, texts are joined as they are.
FEW_IDS = 1 << 20
#: Links of a task whose components are found at once.
STRETCH = 1 << 18
#: Words of 64 parity bits of a row's labelled k-mers.
PARITY = 16
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, 4096, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(text: str | None, k: int = K) -> np.ndarray:
    """Hashes of the text's k-mers with their occurrence numbers, in the order of the text; one for a shorter text."""
    words = word_bytes(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    size = min(k, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(n)
    label = np.empty(n, dtype=np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h ^ label * np.uint64(0xD1B54A32D192ED03))


def sketches(kmers: np.ndarray, count: int, ell: int = ELL) -> np.ndarray:
    """``count`` order-min-hash sketches of a non-empty sequence of labelled k-mers."""
    out = np.empty(count, dtype=np.uint64)
    step = max(1, (1 << 18) // len(kmers))
    for a in range(0, count, step):
        b = min(count, a + step)
        x = (kmers[None, :] ^ _XOR[a:b, None]) * _ODD[a:b, None]
        rows = np.arange(b - a)
        chosen = []
        for _ in range(min(ell, len(kmers))):
            least = x.argmin(1)
            chosen.append(least)
            x[rows, least] = np.iinfo(np.uint64).max
        h = np.zeros(b - a, dtype=np.uint64)
        for place in np.sort(np.stack(chosen), axis=0):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + kmers[place])
        out[a:b] = h
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matched / (all - matched) for the best in-order matching of two labelled k-mer sequences, 0 if below ``least``.

    Only matches in the band of diagonals that a pair of that similarity can use count; as labelled
    k-mers are distinct, the best matching there is a longest increasing subsequence.
    """
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    need = least / (1 + least) * total - 1e-9  # matches that the similarity takes
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    inside = (i - j <= len(a) - need) & (j - i <= len(b) - need)
    j = j[inside][np.argsort(i[inside])]
    if len(j) and (np.diff(j) > 0).all():
        matched = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            tails[p : p + 1] = [x]
        matched = len(tails)
    return matched / (total - matched) if matched >= need else 0.0


def parity(kmers: np.ndarray) -> np.ndarray:
    """Parity bits of the k-mers' hashes: two sets differ in as many k-mers at least as their bits."""
    odd = np.bincount((kmers & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(k: int, count: int, ell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digest, size, sketch, bits = [], [], [], []
                for x in part.column(1).to_pylist():
                    kmers = labelled_kmers(x, k)
                    digest.append(None if x is None else hashlib.md5(x.encode("utf-8", "replace")).digest())
                    size.append(len(kmers))
                    sketch.append(sketches(kmers, count, ell).tobytes() if len(kmers) else None)
                    bits.append(parity(kmers) if len(kmers) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                    ["id", "digest", "size", "sketch", "bits"],
                )

    return run


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                s = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint64).reshape(n, bands * rows)
                key = np.zeros((n, bands), dtype=np.uint64)
                for r in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, r::rows])
                ahead = np.roll(s, -rows, axis=1)  # the sketches that follow a band's own
                first, second = ahead[:, ::rows], ahead[:, 1 % rows :: rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(bands, dtype=np.int32), n)),
                        pa.array(key.ravel().view(np.int64)),
                        pa.array((first & np.uint64(0x7FFFFFFF)).astype(np.int32).ravel()),
                        pa.array((second & np.uint64(0x7FFFFFFF)).astype(np.int32).ravel()),
                        pa.array(np.repeat(part.column(0).to_numpy(), bands)),
                        pa.array(np.repeat(part.column(1).to_numpy(), bands)),
                    ],
                    ["band", "key", "first", "second", "id", "size"],
                )

    return run


def _neighbours(near: int, least: float):
    """Pairs of rows of one key at most ``near`` apart (kind 0), and a task's first (1) and last (2) rows.

    Kind 3: all rows of keys of more than ``near`` + 1 rows, and some others at the task's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kept, begun, place = TaskContext.get().partitionId(), None, False, 0

        def rows(kind, a, b, table, place):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.full(n, task, np.int32)), pa.array(place), *(pa.array(table[c]) for c in ("band", "key", "size"))],
                ["kind", "a", "b", "task", "place", "band", "key", "size"],
            )

        def edge(kind, table, part):
            some = {c: table[c][part] for c in ("band", "key", "id", "size")}
            return rows(kind, some["id"], some["id"], some, np.arange(len(some["id"]), dtype=np.int32))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = {c: batch.column(c).to_numpy() for c in ("band", "key", "id", "size")}
            if not begun:
                yield edge(1, table, slice(0, near))
                yield edge(3, table, slice(0, near + 1))
                begun = True
            if kept is not None:
                table = {c: np.concatenate([kept[c], table[c]]) for c in table}
            old = 0 if kept is None else len(kept["id"])
            n = len(table["id"])
            for d in range(1, near + 1):
                at = np.arange(max(d, old), n)
                small, large = np.minimum(table["size"][at], table["size"][at - d]), np.maximum(table["size"][at], table["size"][at - d])
                at = at[(table["band"][at] == table["band"][at - d]) & (table["key"][at] == table["key"][at - d]) & (small >= least * large)]
                if len(at):
                    x, y = table["id"][at], table["id"][at - d]
                    yield rows(0, np.minimum(x, y), np.maximum(x, y), {c: table[c][at] for c in ("band", "key", "size")}, np.zeros(len(at), dtype=np.int32))
            at = np.arange(max(near + 1, old), n)
            at = at[(table["band"][at] == table["band"][at - near - 1]) & (table["key"][at] == table["key"][at - near - 1])]
            if len(at):
                yield edge(3, table, np.unique(np.concatenate([at - d for d in range(near + 2)])))
            kept = {c: table[c][-near - 1 :] for c in table}
        if kept is not None:
            yield edge(2, kept, slice(-near, None))
            yield edge(3, kept, slice(None))

    return run


def candidate_pairs(signed: DataFrame, bands: int = BANDS, rows: int = ROWS, near: int = NEAR, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of ``signed`` (id, size, sketch) that stand close in the order of some band; and the
    rows (band, key, id) of the keys of more than ``near`` + 1 rows, with few of other keys; some repeat."""
    spark = signed.sparkSession
    banded = signed.where("sketch is not null").select("id", "size", "sketch").mapInArrow(
        trimmed(_banded(bands, rows)), "band int, key long, first int, second int, id long, size int"
    )
    order = ["band", "key", "first", "second", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = banded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(trimmed(_neighbours(near, least)), "kind int, a long, b long, task int, place int, band int, key long, size int"), "neighbours")
    pairs = found.where("kind = 0").select("a", "b")
    # the last rows of a task and the first of the next that has rows: a few for each task
    edges = found.where("kind in (1, 2)")
    turn = Window.orderBy("task", "kind", "place")
    joined = []
    for d in range(1, 2 * near):
        before = [F.lag(c, d).over(turn).alias(f"{c}_before") for c in ("kind", "task", "a", "band", "key")]
        joined.append(
            edges.select("*", *before)
            .where("kind = 1 and task_before < task and band = band_before and key = key_before and a <> a_before")
            .select(F.least("a", "a_before").alias("a"), F.greatest("a", "a_before").alias("b"))
        )
    for more in joined:
        pairs = pairs.unionByName(more)
    return written(pairs.where("a <> b").distinct(), "pairs"), found.where("kind = 3").select("band", "key", F.col("a").alias("id"))


def _verified(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, text, kmers = [], None, None
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if kmers is None or x != text:
                        text, kmers = x, labelled_kmers(x, k)
                    values.append(aligned_similarity(kmers, labelled_kmers(y, k), least))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    """id: both rows of each pair (a, b)."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def verify(pairs: DataFrame, texts: DataFrame, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the ``pairs`` whose texts (id, text) align to ``least`` or more.

    ``pairs`` is read more than once.
    """
    if 2 * pairs.count() <= FEW_IDS:  # only texts that are in pairs are shuffled
        texts = texts.join(F.broadcast(_ends(pairs)), "id", "left_semi")
    # a row that is in many pairs is a, so its text is dealt over SALTS tasks
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    many = pairs.select("a", "salt").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    left = pairs.join(many, ["a", "salt"])
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(trimmed(_verified(k, least)), "a long, b long, similarity double").where(F.col("similarity") >= least)


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links u - v that is not the least one of its component, and that least one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    joined = label != np.arange(len(ids))
    return ids[joined], ids[label[joined]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links u, v in stretches of ``STRETCH``, each as the stars of its components; no more links than there were."""

    def found():
        u, v = contracted(*(np.concatenate([x[i] for x in kept]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in kept) >= STRETCH:
            yield found()
            kept = []
    if kept:
        yield found()


def stars(links: DataFrame) -> DataFrame:
    """id, class_id (the least id) for every id of ``links`` (a, b) that is not the least, some more than once; links stay
    distributed in every round."""

    def told(e: DataFrame) -> DataFrame:
        return written(e.mapInArrow(trimmed(_contracted), "u long, v long"), "links")

    edges = told(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        # done when each node is the least of its neighbourhood, or has one neighbour
        n, left = nodes.agg(F.count(F.lit(1)), F.count_if((F.col("low") < F.col("u")) & (F.col("low") < F.col("high")))).first()
        if not left:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
        small = F.broadcast if n <= FEW_IDS else lambda df: df
        # large star: every larger neighbour of a node joins the least of its neighbourhood
        large = edges.join(small(nodes.select(F.col("u").alias("v"), F.least("u", "low").alias("m"))), "v").select("u", F.col("m").alias("v"))
        # small star: a node and its smaller neighbours join the least of them, with one link for each there was
        least = small(large.groupBy("u").agg(F.min("v").alias("m")))
        old = edges
        edges = told(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        drop_written(old)


def components(links: DataFrame) -> DataFrame:
    """id, class_id (the least id), once for every id of ``links`` (a, b) that is not the least."""
    return stars(links).groupBy("id").agg(F.min("class_id").alias("class_id"))


def homes(told: DataFrame) -> DataFrame:
    """band, key, low and high class, n rows, hub (row of most links), home (class of the row anchor) and its n_home rows.

    ``told``: band, key, id, class_id, n_links, anchor. Where anchor is null, a row of the key's largest class becomes it;
    it stays, so that rows which have come home do not leave again.
    """
    by_class = told.groupBy("band", "key", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("n_links", "id")).alias("most"), F.min("id").alias("one"),
        F.max("anchor").alias("anchor"), F.max(F.coalesce(F.col("id") == F.col("anchor"), F.lit(False))).alias("kept"),
    )
    keys = by_class.groupBy("band", "key").agg(
        F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.sum("n").alias("n"), F.max("most")["id"].alias("hub"),
        F.max("anchor").alias("anchor"), F.max(F.struct("kept", "n", "class_id", "one")).alias("home"),
    )
    return keys.select("band", "key", "low", "high", "n", "hub", F.coalesce("anchor", "home.one").alias("anchor"), F.col("home.class_id").alias("home"), F.col("home.n").alias("n_home"))


def crowded_links(crowded: DataFrame, links: DataFrame, classes: DataFrame, signed: DataFrame, texts: DataFrame, k: int = K, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``links`` (a, b) and ``classes`` (id, class_id) with what ``crowded`` (band, key, id) adds: no two rows of one
    key that are in different classes are alike. ``signed``: id, size, bits. Links and classes may repeat."""
    order = F.xxhash64(F.col("id"), F.lit(1))
    share = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    reps, rows = 1, crowded.withColumn("anchor", F.lit(None).cast("long"))
    while True:
        # by id, with its keys, at most as many as bands: classes join ids, not keys
        known = rows.select("id", F.struct("band", "key", "anchor").alias("of"), F.lit(None).cast("long").alias("class_id"), F.lit(0).alias("n_links"))
        known = known.unionByName(classes.select("id", "class_id", F.lit(0).alias("n_links")), allowMissingColumns=True)
        known = known.unionByName(_ends(links).withColumn("n_links", F.lit(1)), allowMissingColumns=True)
        told = known.groupBy("id").agg(F.collect_set("of").alias("keys"), F.max("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
        told, seen = told.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_links", F.inline("keys")), Observation()
        told = written(told.observe(seen, F.count(F.lit(1)).alias("n")), "told")
        drop_written(rows)
        keys = homes(told)
        # all rows of a key of up to ``reps`` rows have been representatives, those at home apart
        keys = keys.where("low < high").where(F.lit(reps == 1) | (F.col("n") > reps))
        old, reps = (0, GROWTH) if reps == 1 else (reps, reps * GROWTH)
        meet = (F.least(F.col("n") - F.col("n_home"), F.lit(reps)) + 1) * F.col("n")
        tasks = F.least(F.lit(SALTS), F.ceil(meet / SALT_PAIRS)).alias("tasks")  # of a key: small ones need one
        keys, rows = keys.select("band", "key", "hub", "n", "home", "anchor", tasks), told.drop("anchor").withColumn("salt", salt)
        if seen.get["n"] <= FEW_IDS:  # few rows, fewer keys
            rows = rows.join(F.broadcast(keys), ["band", "key"])
        else:
            dealt = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = rows.join(dealt, ["band", "key", "salt"])
        rows = rows.join(signed.select("id", "size", "bits"), "id")
        rows = rows.withColumn("salt", F.pmod("salt", "tasks")).withColumn("at_home", F.col("class_id") == F.col("home"))
        rows, seen = rows.select("band", "key", "id", "class_id", "hub", "n", "anchor", "at_home", "tasks", "size", "bits", "salt", order.alias("place"), share.alias("share")), Observation()
        rows = written(rows.observe(seen, F.count(F.lit(1)).alias("n")), "rows")
        drop_written(told)
        if not seen.get["n"]:  # a key that is settled stays so
            return links, classes
        turn = (F.col("share") * F.col("n") >= old) | (F.lit(old == 0))
        turn = turn & ((F.col("share") * F.col("n") < reps) | (F.col("n") <= reps))
        chosen = rows.where((turn & ~F.col("at_home")) | (F.col("id") == F.col("hub"))).select(
            "band", "key", *[F.col(c).alias(f"{c}_") for c in ("id", "class_id", "size", "bits", "place")], (F.col("id") == F.col("hub")).alias("hub_"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"),
        )
        total = F.col("size") + F.col("size_")
        apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_", F.lit(i)))) for i in range(PARITY)), F.lit(0))
        able = (
            (F.col("rows.band") == F.col("chosen.band")) & (F.col("rows.key") == F.col("chosen.key")) & (F.col("rows.salt") == F.col("chosen.salt"))
            & (F.col("class_id") != F.col("class_id_"))
            # other pairs have met, or will: a home only grows, so who waits for a row's turn at home is met from outside
            & (F.col("hub_") | F.col("at_home") | (F.struct("place", "id") > F.struct("place_", "id_")))
            & (F.least("size", "size_") >= least * F.greatest("size", "size_"))
            & (apart <= total * ((1 - least) / (1 + least)) + 1e-6)
        )
        # each pair once; a is the row that meets others
        pairs = rows.alias("rows").join(chosen.alias("chosen"), able).groupBy(F.least("id", "id_").alias("low"), F.greatest("id", "id_").alias("high")).agg(F.min("id_").alias("a"))
        pairs = written(pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "met")
        new = written(verify(pairs, texts, k, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "verified")
        drop_written(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)  # of rows that were in different classes: none of them was a link
            classes = stars(classes.select(F.col("id").alias("a"), F.col("class_id").alias("b")).unionByName(new))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, ell: int = ELL, bands: int = BANDS, rows: int = ROWS, near: int = NEAR, least: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs`` with a key: ``key`` and class_id, the least key of its class.

    Classes are the connected components of the verified pairs of texts. Equal texts are one class,
    empty ones too; texts without words that differ are not alike. A null text is alone. Rows of a
    null key have no row here. Rows that repeat come as often; rows of one key with different texts
    have each the class of its text. Other columns play no part.
    """
    given = docs.where(col(key).isNotNull()).select(col(key).cast("long").alias("id"), col(text).cast("string").alias("text"))
    signed = written(given.mapInArrow(trimmed(_signed(k, bands * rows, ell)), "id long, digest binary, size int, sketch binary, bits array<long>"), "sketches")
    # a null text has no digest, and stands for itself
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = written(copies, "copies")
    stand = signed.join(copies.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    stand = written(stand, "stand")  # every round over crowded keys reads it
    pairs, crowded = candidate_pairs(stand, bands, rows, near, least)
    texts = given.where("text is not null")
    links = written(verify(pairs, texts, k, least).select("a", "b"), "verified")
    links, classes = crowded_links(crowded, links, stars(links), stand, texts, k, least)
    classes = classes.groupBy(F.col("id").alias("rep")).agg(F.min("class_id").alias("class_id"))
    known = copies.join(classes, "rep", "left").select("digest", "n", F.coalesce("class_id", "rep").alias("class_id"))
    known = written(known, "classes")
    ids = signed.select("id", "digest")
    # rows of a text of many copies do not meet in one task: such texts are few, HOT_TEXTS at most
    most = max(HOT_COPIES, -(-(copies.agg(F.sum("n")).first()[0] or 0) // HOT_TEXTS))
    hot = F.broadcast(known.where(F.col("n") >= most).select("digest", "class_id"))
    cold = known.where(F.col("n") < most).select("digest", "class_id")
    out = ids.join(hot, "digest").select("id", "class_id")
    out = out.unionByName(ids.join(hot, "digest", "left_anti").join(cold, "digest").select("id", "class_id"))
    out = out.unionByName(ids.where("digest is null").select("id", F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(key), "class_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row of least key stays, and every row of a null key.

    Of repeated rows of one key one stays. Columns and their values are as they were.
    """
    classes = near_duplicates(docs, text, key, **how)
    (kept,) = fresh(docs, "kept_key")
    best = classes.where(col(key) == F.col("class_id")).select(col(key).alias(kept)).distinct()
    named = docs.where(col(key).isNotNull()).join(best, F.col(f"`{key}`").cast("long") == col(kept), "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(col(key).isNull()))
