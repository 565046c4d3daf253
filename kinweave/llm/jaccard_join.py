"""N-gram Jaccard join by vertical partitioning.

The order of all n-grams is that of their hashes. It is cut into fragments, the same for all documents
of about the same size, so that a document's set falls into segments.

Candidates. Two sets of n and m n-grams that reach the similarity differ in at most D of them, and each
difference spoils the segment of one fragment. With more than D segments some segment is alike in both.
Of its segments a document states only the digests of the D + 1 largest: segments in the same order of
size, so two similar documents still share one of those. Where a document has too few segments for that
bound (short ones, or by chance), it also states its first D + 1 single n-grams, which is the same
argument with segments of one. So no link is lost, whatever the texts, and an n-gram that very many
documents share hardly ever makes up a segment by itself.

Among the documents that share a digest with another, n-grams are put in the order of their frequency,
rarest first, and a document is compared by the head of its set in that order. Two sets meet only at
an n-gram that leaves room for the overlap they need behind it. Edits make rare n-grams, so of many
versions of one text only those meet that are close.

Counting. For each candidate pair the overlap is counted within each of ``PARTS`` fragments apart and
summed per pair; the exact condition decides. Pairs are between distinct sets. Within a group of sets
that meet at an n-gram each is first compared with one head of the group; components are formed, and only
then pairs of one group that still lie in different components are compared. A group of thousands of
near copies thus costs about as many pairs as it has members.

Candidate documents are found again by an exact join on those rows alone that a filter of bounded size
lets through (``idfilter``); texts are not shuffled.

Defined cases: null or empty texts have no n-grams, size 0 and a component of their own; fewer words
than ``width`` make one n-gram; rows with equal identifier are one node, which has the links of all their
texts; a null identifier gets a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import idfilter
from kinweave.llm import words as W
from kinweave.llm.components import smallest_reachable
from kinweave.session import stage

WIDTH, PERCENT = 4, 85
#: Sets up to this size are compared by single n-grams.
SMALL = 32
#: Fragments for counting overlaps.
PARTS = 8
#: Rounds in which each member of a group is compared with one head, before all open pairs are.
HEADS = 3
#: Segments stated as fragments for each possible difference.
_SLACK = 1.35


class Grid:
    """Fragment counts for classes of set sizes; class c holds sizes from ``low(c)`` up to ``low(c + 1)``."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ratio = min(2.0, 100 / percent * 1.2)

    def low(self, c: int) -> int:
        return int(np.ceil((SMALL + 1) * self.ratio ** c))

    def class_of(self, n: int) -> int:
        c = max(0, int(np.log(n / (SMALL + 1)) / np.log(self.ratio)) - 1)
        while self.low(c + 1) <= n:
            c += 1
        return c

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def difference(self, n: int, partner: int) -> int:
        """Most n-grams in which sets of these sizes may differ."""
        return (100 - self.percent) * (n + partner) // (100 + self.percent)

    def fragments(self, c: int) -> int:
        small = self.low(c + 1) - 1
        return int(_SLACK * self.difference(self.largest_partner(small), small)) + 2

    def classes(self, n: int) -> Iterator[tuple[int, int]]:
        """(class, most differences there) in which a set of n n-grams takes part."""
        if n > SMALL:
            c = self.class_of(n)
            yield c, self.difference(n, self.largest_partner(n))
            if c and (self.low(c) - 1) * 100 >= n * self.percent:
                yield c - 1, self.difference(n, self.low(c) - 1)


def _digests(grams: np.ndarray, mixed: np.ndarray, grid: Grid) -> np.ndarray:
    """Digests a set states; ``grams`` ascending and distinct, ``mixed`` a second hash of each."""
    n = len(grams)
    stated, safe = [], True
    for c, most in grid.classes(n):
        count = grid.fragments(c)
        place = (((grams >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(np.append(start, n))
        safe &= len(start) > most
        chosen = np.argsort(-size, kind="stable")[:most + 1]
        digest = np.add.reduceat(mixed, start)[chosen] + place[start][chosen].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        stated.append(W.mix(digest + np.uint64((c + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
    if not safe or n * grid.percent <= SMALL * 100:
        stated.append(W.mix(grams[:grid.difference(n, grid.largest_partner(n)) + 1] + np.uint64(0x165667B19E3779F9)))
    return np.concatenate(stated)


def _gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for low, high in W.row_groups(offsets):
        part = offsets[low:high + 1] - offsets[low]
        body = data[offsets[low]:offsets[high]]
        starts, ends, bounds = W.find_words(body, part, W.SPACED)
        hashed = W.hash_words(body, starts, ends, W.SPACED)
        for i in range(high - low):
            yield np.unique(W.shingle_hashes(hashed[bounds[i]:bounds[i + 1]], width))


def _signature(grams: np.ndarray) -> tuple[np.ndarray, int, int]:
    """A second hash of each n-gram, and two numbers that stand for the whole set."""
    mixed = W.mix(grams ^ np.uint64(0x27D4EB2F165667C5))
    first = int(W.mix(np.array([mixed.sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])
    return mixed, first, int(W.mix(grams * np.uint64(0xFF51AFD7ED558CCD)).sum().astype(np.uint64).view(np.int64))


def _describe(docs: DataFrame, width: int, grid: Grid) -> DataFrame:
    """(id, n, set_a, set_b, digests) of (id, text) rows; the pair set_a, set_b stands for the set, null if empty."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for grams in _gram_sets(*W.utf8(batch.column(1)), width):
                n.append(len(grams))
                if not len(grams):
                    a.append(None), b.append(None), lists.append(np.zeros(0, np.int64))
                    continue
                mixed, first, second = _signature(grams)
                a.append(first), b.append(second)
                lists.append(W.signed(_digests(grams, mixed, grid)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "n", "set_a", "set_b", "digests"])

    return docs.mapInArrow(run, f"id {kind}, n long, set_a long, set_b long, digests array<long>")


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """(set_a, set_b, part, grams) of (id, text) rows: the set cut at fixed places of the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = (np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS))
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for grams in _gram_sets(*W.utf8(batch.column(1)), width):
                if not len(grams):
                    continue
                _, first, second = _signature(grams)
                for part, piece in enumerate(np.split(grams, np.searchsorted(grams, cuts))):
                    if len(piece):
                        for column, value in zip(out, (first, second, part, W.signed(piece))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))],
                ["set_a", "set_b", "part", "grams"])

    return docs.mapInArrow(run, "set_a long, set_b long, part int, grams array<long>")


def _prefixes(segments: DataFrame, percent: int) -> DataFrame:
    """(rep, n, gram, pos): the rarest n-grams of each set, of which similar sets share one; frequencies among ``segments``.

    N-grams that only one set holds come first in the order; they take up places but are not returned.
    """
    grams = segments.select("rep", "n", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    held = grams.join(shared, "gram").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("held"))
    lone = F.col("n") - F.size("held")
    length = F.floor(F.col("n") * (100 - percent) / 100) + 1
    chosen = held.withColumn("lone", lone).withColumn("take", (length - F.col("lone")).cast("int")).where("take > 0")
    return chosen.select("rep", "n", "lone", F.posexplode(F.slice("held", F.lit(1), F.col("take"))).alias("at", "x")).select(
        "rep", "n", F.col("x.gram").alias("gram"), (F.col("at") + F.col("lone")).alias("pos"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets, each by its name, that reach the similarity."""
    side = lambda c: segments.select(F.col("rep").alias(c), "part", F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}"))
    partial = pairs.join(side("x"), "x").join(side("y"), ["y", "part"]).select(
        "x", "y", "n_x", "n_y", F.size(F.array_intersect("grams_x", "grams_y")).alias("common"))
    total = partial.groupBy("x", "y", "n_x", "n_y").agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * 100 >= (F.col("n_x") + F.col("n_y") - F.col("common")) * percent).select("x", "y")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) per row; links are those found between distinct sets."""
    W.small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = stage(_describe(chosen, width, Grid(percent)), "described")
    ids = described.select("id", "n", "set_a", "set_b")
    sets = ids.where("set_a IS NOT NULL AND id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("id").alias("least"), F.min("n").alias("n"))
    # Names are given once, in a written table, and mean nothing but the set.
    sets = stage(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    own_set = F.xxhash64("set_a", "set_b")
    several = stage(ids.where("id IS NOT NULL").groupBy("id").agg(F.min(own_set).alias("low"), F.max(own_set).alias("high")).where("low < high").select("id"), "several")
    named_rows = ids.join(several, "id").join(sets.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("id", "rep").distinct()
    first_set = named_rows.groupBy("id").agg(F.min("rep").alias("y"))
    same = stage(named_rows.join(first_set, "id").where("rep != y").select(F.col("rep").alias("x"), "y"), "same")

    # Sets that state a digest which another set states too. They are named by set_a here; a name two sets share only adds candidates.
    stated = described.where("set_a IS NOT NULL AND id IS NOT NULL").select(F.explode("digests").alias("digest"), F.col("set_a").alias("s"))
    shared = stated.groupBy("digest").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low < high").select("digest")
    wanted = stage(stated.join(shared, "digest").select(F.col("s").alias("set_a")).distinct().join(sets, "set_a").select(F.col("least").alias("id")), "wanted")
    _, perhaps = idfilter.split(chosen, "id", wanted, "id")
    segments = stage(_segments(perhaps, width).join(sets, ["set_a", "set_b"]).groupBy("rep", "part", "n").agg(F.first("grams").alias("grams")), "segments")
    # Heads are drawn by what a set holds, not by its name, so that they are the same in every run.
    members = stage(_prefixes(segments, percent).join(sets.select("rep", F.col("set_a").alias("seed")), "rep"), "prefixes")

    def labelled(links: DataFrame) -> DataFrame:
        linked = smallest_reachable(links, "x", "y")
        alone = members.select(F.col("rep").alias("node")).distinct().join(linked.select("node"), "node", "left_anti")
        return stage(linked.union(alone.select("node", F.col("node").alias("label"))), "components")

    links = checked = None
    labels = labelled(same) if same.limit(1).count() else members.select(F.col("rep").alias("node"), F.col("rep").alias("label")).distinct()
    for turn in range(HEADS + 1):
        placed = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep")
        # The head is the set with the fewest rare n-grams, in later turns any.
        first = F.struct((F.col("pos") if turn == 0 else F.lit(0)).alias("rank"), F.xxhash64("seed", F.lit(turn)).alias("draw"), "rep", "pos", "n", "label")
        open_ = placed.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(first).alias("head")).where("low < high")
        if turn < HEADS:
            other = open_.select("gram", *[F.col(f"head.{c}").alias(f"{c}_2") for c in ("rep", "pos", "n", "label")])
            order = F.col("rep") != F.col("rep_2")
        else:
            placed = placed.join(open_.select("gram"), "gram")
            other = placed.select("gram", *[F.col(c).alias(f"{c}_2") for c in ("rep", "pos", "n", "label")])
            order = F.col("rep") < F.col("rep_2")
        # A first common n-gram at these places leaves room for so much overlap only.
        room = F.least(F.col("n") - F.col("pos"), F.col("n_2") - F.col("pos_2")) * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent
        pairs = placed.join(other, "gram").where(order & (F.col("label") != F.col("label_2")) & room).select(
            F.least("rep", "rep_2").alias("x"), F.greatest("rep", "rep_2").alias("y")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["x", "y"], "left_anti")
        pairs = stage(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        checked = pairs if checked is None else checked.union(pairs)
        found = stage(_linked(pairs, segments, percent), "links")
        links = found if links is None else links.union(found)
        labels = labelled(links.union(same))

    degree = None if links is None else links.select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = sets.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    named = named.join(degree, "rep", "left") if degree is not None else named.withColumn("n_links", F.lit(None).cast("long"))
    named = named.withColumn("label", F.coalesce("label", "rep"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "label").select("set_a", "set_b", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = ids.join(named, ["set_a", "set_b"], "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # A row without n-grams shares the component of the other rows of its identifier.
    shared_by = rows.join(several, "id").groupBy("id").agg(F.min("component_id").alias("whole"))
    return rows.join(shared_by, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("whole", "component_id").alias("component_id"), "n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest identifier; equal identifiers leave one row.

    Rows without an identifier cannot be told apart and stay.
    """
    found = stage(similar_components(docs, id_col, text_col, width, percent).groupBy(id_col).agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "found")
    touched = found.where(F.col(id_col).isNotNull() & ((F.col("component_id") != F.col(id_col)) | (F.col("rows") > 1)))
    touched = stage(touched.select(F.col(id_col).alias("_touched"), (F.col("component_id") != F.col(id_col)).alias("_dropped")), "touched")
    clear, perhaps = idfilter.split(docs, id_col, touched, "_touched")
    marked = perhaps.join(touched, perhaps[id_col] == touched["_touched"], "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.where("_touched IS NULL").select(*names)
    row = F.struct(*names)
    repeated = marked.where("NOT _dropped").groupBy("_touched").agg(F.min_by(row, F.xxhash64(*names)).alias("_row")).select("_row.*")
    return clear.unionByName(single).unionByName(repeated)
