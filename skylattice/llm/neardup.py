"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles.  Every shingle scatters the points of a
Poisson process over the registers; a register keeps the smallest point of any shingle,
truncated to an exponentially spaced value.  Sketches merge by a register-wise maximum.
Documents with the same set are one class.  Bands of registers are bucket keys; pairs of
classes from a bucket pass a test of set sizes, a maximum-likelihood estimate from how
many registers are larger, smaller and equal, and at last the exact sets.

Buckets are not expanded into all pairs.  Each bucket's best connected member, its hub, is
compared with every other one; links so confirmed form components.  A member is known by its
difference from the hub, the elements that only one of the two has.  Two members of different
components can be linked only if they share much of their differences (see _beside_hubs), so
they are found by the rarest elements of these and confirmed from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .textbytes import TextSlice, binary_rows, bounded_batches, map_texts, mix

#: Registers of a sketch, in bands of ROWS.  A pair of similarity 0.8 shares a band but for 5e-9.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: The ratio of neighbouring register values, the scale of the points and the largest value.
BASE, SCALE, LARGEST = 1.001, 20.0, 65535
#: How far below the threshold (six standard errors) an estimate may be for the exact test to be made.
MARGIN = 0.16
#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: TextSlice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) of shingles, ordered by text and hash; fewer words than ``words`` are one shingle."""
    starts, ends, first = texts.words()
    h = texts.hashes(starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    size = np.minimum(n, words)[owner]
    place = np.arange(len(h)) - first[:-1][owner]
    opens = place + size <= n[owner]
    at = np.flatnonzero(opens)
    total = np.zeros(len(at), np.uint64)
    for j in range(words):
        inside = size[at] > j
        total += np.where(inside, mix(h[np.minimum(at + j, len(h) - 1)] + np.uint64(j) * _STEP), np.uint64(0)) * np.uint64(2 * j + 1)
    shingle, owner = mix(total + size[at].astype(np.uint64)), owner[at]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new]


def sketch(shingle: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Register values (n x registers, uint16) of n sets.

    Points are drawn in rounds, each as long as all before it; a shingle stops as soon as its points,
    which ascend, lie above every minimum of its set.
    """
    low = np.full(n * registers, np.inf)
    limit = np.full(n, np.inf)
    point = np.zeros(len(shingle))
    drawn, more = 0, 1
    while len(shingle):
        turn = (np.arange(drawn, drawn + more, dtype=np.uint64) + np.uint64(1)) * _STEP
        for at in range(0, len(shingle), max(1, (1 << 18) // more)):
            part = slice(at, at + max(1, (1 << 18) // more))
            r = mix(shingle[part, None] + turn)
            x = point[part, None] + np.cumsum(-np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32), axis=1) / registers
            cell = owner[part, None] * registers + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            use = x < limit[owner[part], None]
            np.minimum.at(low, cell[use], x[use])
            point[part] = x[:, -1]
        drawn, more = drawn + more, max(1, drawn + more)
        live = np.unique(owner)
        limit[live] = low.reshape(n, registers)[live].max(1)
        keep = point < limit[owner]
        shingle, owner, point = shingle[keep], owner[keep], point[keep]
    filled = np.isfinite(low)
    value = np.zeros(n * registers)
    value[filled] = np.floor(1 - np.log(low[filled] / SCALE) / np.log(BASE))
    return np.clip(value, 0, LARGEST).astype(np.uint16).reshape(n, registers)


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    bands = values.shape[1] // rows
    v = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, v.shape[:2]).copy()
    for j in range(rows):
        key = mix(key + v[:, :, j] + np.uint64(1))
    return key


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(a) < likelihood(b)
        lo, hi = np.where(left, a, lo), np.where(left, hi, b)
    return (lo + hi) / 2


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), h1 and h2 (a digest of the set), registers."""

    def make() -> Callable:
        def run(ids: pa.Array, texts: TextSlice):
            shingle, owner = shingle_sets(texts, words)
            n = np.bincount(owner, minlength=len(texts))
            h1, h2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            np.add.at(h1, owner, mix(shingle + np.uint64(11)))
            np.add.at(h2, owner, mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            return ids, n, h1.view(np.int64), h2.view(np.int64), binary_rows(sketch(shingle, owner, len(texts)))

        return run

    return map_texts(docs, id_col, text_col, make, "id long, n long, h1 long, h2 long, registers binary")


def _keys(classes: DataFrame) -> DataFrame:
    """id, n, keys: the band keys of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(batch), -1)
                key = band_keys(values)
                offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * key.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(key.ravel().view(np.int64)))], names=["id", "n", "keys"])

    return classes.select("id", "n", "registers").mapInArrow(run, "id long, n long, keys array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is not clearly below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in (4, 5))
                larger, smaller = (x > y).sum(1), (x < y).sum(1)
                j = estimate(larger, smaller, x.shape[1] - larger - smaller, *(batch.column(c).to_numpy().astype(float) for c in (2, 3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

    side = classes.select("id", "n", "registers")
    both = pairs.select("a", "b").join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, na (size of a's set), lacks and adds (what a has and b has not, and the reverse), linked, differs (these elements), of pairs.

    The sets are made anew from the texts of these documents alone.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def make() -> Callable:
        def run(ids: pa.Array, texts: TextSlice):
            shingle, owner = shingle_sets(texts, words)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            return ids, pa.array([shingle[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())

        return run

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lacks, adds, differs = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                only_a, only_b = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                sizes.append(len(a))
                lacks.append(len(only_a))
                adds.append(len(only_b))
                differs.append(np.concatenate([only_a, only_b]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (sizes, lacks, adds)), pa.array(differs, pa.list_(pa.int64()))], names=["a", "b", "na", "lacks", "adds", "differs"])

    sets = map_texts(docs.join(ids, "id", "left_semi"), "id", "text", make, "id long, shingles binary")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    measured = both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long, na long, lacks long, adds long, differs array<long>")
    common = F.col("na") - F.col("lacks")
    return measured.withColumn("linked", (common > 0) & (100 * common >= percent * (F.col("na") + F.col("adds"))))


def _beside_hubs(tested: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """a, b: linked pairs of members tested with one hub that are in different components.

    Let |h| be the size of the hub's set, and let x lack r(x) of its elements and add a(x) others.  With s
    elements shared by the differences of x and y from the hub, |x and y| = |h| - r(x) - r(y) + s, so they are
    linked if and only if (100 + percent) s >= w(x) + w(y) - (100 - percent) |h| where w = 100 r + percent a.
    Of two members of different components one, x, is not linked with the hub: w(x) > (100 - percent) |h|.
    So (100 + percent) s > w(y): in any order of elements, y has to share one with x while so many are left to
    it, and at the first one that they share both have to have as many left as the pair needs.  The order is
    by how many members outside the hub's component have an element, the rarest first.
    """
    member = tested.join(label.toDF("b", "part"), "b", "left").join(label.toDF("a", "hub_part"), "a", "left")
    member = member.select("a", "b", "na", F.coalesce("part", "b").alias("part"), (F.coalesce("part", "b") != F.coalesce("hub_part", "a")).alias("outside"), (100 * F.col("lacks") + percent * F.col("adds")).alias("w"), "differs")
    open_hubs = member.groupBy("a").agg(F.max("outside").alias("outside"), F.min("part").alias("low"), F.max("part").alias("high")).where("outside AND low < high").select("a")
    member = written(member.join(open_hubs, "a", "left_semi"), "beside")
    flat = member.select("a", "b", "part", "outside", "w", (F.size("differs") * (100 + percent)).alias("n"), F.explode("differs").alias("e"))
    often = flat.where("outside").groupBy("a", "e").agg(F.count("*").alias("often"), F.min("part").alias("low"), F.max("part").alias("high"))
    turn = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("often", F.lit(0)), "e"))
    held = flat.join(often, ["a", "e"], "left").withColumn("left", F.col("n") - (turn - 1) * (100 + percent))
    # an element that no member outside the hub's component has, or only those of one's own component, leads nowhere
    held = written(held.where("often > 0 AND (outside OR left > w) AND (low != part OR high != part)"), "held")
    probe = held.where("outside").select("a", "e", F.col("b").alias("x"), F.col("part").alias("x_part"), F.col("w").alias("wx"), F.col("left").alias("x_left"))
    # at the first element that two share, both have to have enough left
    need = F.col("w") + F.col("wx") - (100 - percent) * F.col("na")
    open_pair = (F.col("part") != F.col("x_part")) & (F.least("left", "x_left") >= need)
    rare = held.where("left > w").join(member.select("a", "na").distinct(), "a")
    met = written(rare.join(probe, ["a", "e"]).where(open_pair).select("a", "b", "x").distinct(), "met")
    side = member.select("a", "b", "na", "w", "differs")
    both = met.join(side, ["a", "b"]).join(side.select("a", F.col("b").alias("x"), F.col("w").alias("wx"), F.col("differs").alias("dx")), ["a", "x"])
    shared = F.size(F.array_intersect("differs", "dx"))
    both = both.where((100 + percent) * shared >= F.col("w") + F.col("wx") - (100 - percent) * F.col("na"))
    return both.select(F.least("b", "x").alias("a"), F.greatest("b", "x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (the id is that one).

    Links join documents with 100 * intersection >= percent * union.  Null and empty texts and those
    without words have an empty set and no links; a null id is never linked.  Rows that share an id
    count as one document with the links of each.  Columns other than the two named are not read.
    Results of inner steps are written to the shared folder.
    """
    bounded_batches(docs.sparkSession)
    threshold = percent / 100
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    made = written(sketches(texts, words, "id", "text"), "sketches")
    classes = made.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    reps = written(made.join(classes.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"]), "classes")
    texts = texts.where("id IS NOT NULL")
    rows = _keys(reps).select(F.explode("keys").alias("key"), "id", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = written(rows.join(shared, "key"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum(F.col("c") - 1).alias("degree"))
    buckets = written(buckets.join(degree, "id"), "members")
    hubs = buckets.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"), "n")).alias("h")).select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    rows = buckets.join(hubs, "key").where("id != hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.max("c").alias("most"), F.max(near).alias("near"))
    rows = written(rows.where("near OR most > 2"), "rows")
    # beside a third member even one unlike the hub is compared with it: its difference leads to the others
    likely = written(_likely(rows.where("most = 2"), reps, threshold).union(rows.where("most > 2").select("a", "b")), "likely")
    tested = written(_compared(likely, texts, words, percent), "tested")
    found = tested.where("linked").select("a", "b")
    label = components(found)
    more = written(_beside_hubs(tested, label, percent), "found")
    if not more.isEmpty():
        label = components(found.union(more))
    named = made.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    again = written(named.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows"), F.min("rep").alias("low")).where("rows > 1").drop("rows"), "again")
    if repeated := not again.isEmpty():  # rows that share an id hold their classes together
        links = found.union(more)
        label = components(links.union(named.join(again, "id").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))))
    rows = named.join(label.toDF("rep", "component"), "rep", "left")
    rows = rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    if repeated:
        whole = rows.join(again.select(F.col("id").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("whole"))
        rows = rows.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose document near_duplicates() does not keep; a null id stays."""
    gone = written(classes.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
