"""Near-duplicate detection by MinHash with tensored banding; links are confirmed on full shingle sets.

Two collections of ``elements`` band elements are computed, each element two
minhashes wide. A table's key is a pair of one element of either collection, so
``elements`` ** 2 tables of four minhashes cost 4 * ``elements`` minhashes
instead of 4 * ``elements`` ** 2. With 12, a pair of similarity s is found with
probability (1 - (1 - s**2) ** 12) ** 2: 0.9999 at 0.75.

Rows with equal shingle sets are one class from the start. Elements that no
other class shares take no part in any pair of keys and are left out before
keys are formed. The tables are resolved in two turns:

1. The ``elements`` tables of pairs (x_i, y_i). All members of a bucket are
   tried against one pivot, the member whose elements are the most shared (the
   middle of a group of copies), and links are contracted to components.
2. All tables, but only of elements that classes of several components share,
   and only for classes of which enough shingles occur in another component to
   allow a link at all (an exact bound). Elements with the same members are one.
   Pairs that the pivot and exact bounds of their intersection leave open are tried against more pivots,
   ``GROWTH`` times as many each round and only across components, until all
   have been tried.

No bucket is gathered in a task, and none is capped. A bucket that still holds
many components is compared member by member, on counts; only pairs that the
bounds allow are emitted and confirmed.

Defined results: null text, or text without words, has the empty set and is
linked with nothing; fewer words than a shingle make one shingle; a null id
takes no part and is kept (its component is null); rows that share an id share
its node, each with the component of its own text; an empty table gives an empty
table; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import bloom, common
from sparkmill.llm.common import Scratch
from sparkmill.llm.components import components
from sparkmill.llm.textkit import U, mix, per_doc, shingles, slices

WIDTH = 2
GROWTH = 64
#: Groups of shingles, by hash, of which a class has counts: two sets share at most the sum of the smaller counts.
SHARES = 32


def document_sets(s, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, one after another, and their bounds."""
    starts, ends, bounds = s.words()
    flat, at = shingles(s.span_hash(starts, ends, lower=True), bounds, k)
    sets = [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else flat), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]).astype(np.int64)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(75))
    return rng.integers(0, 2**63, n, dtype=U), rng.integers(0, 2**63, n, dtype=U) * U(2) + U(1)


def band_elements(flat: np.ndarray, at: np.ndarray, elements: int) -> np.ndarray:
    """2 * elements keys of each document: even ones of the first collection (lowest bit 0), then the second (1)."""
    flips, factors = _seeds(2 * elements * WIDTH)
    out = np.zeros((len(at) - 1, 2 * elements), U)
    work = np.empty(len(flat), U)
    for e in range(2 * elements):
        key = np.full(len(at) - 1, U(e + 1))
        for w in range(WIDTH):
            np.bitwise_xor(flat, flips[e * WIDTH + w], out=work)
            np.multiply(work, factors[e * WIDTH + w], out=work)
            key = mix(key * U(0x9E3779B97F4A7C15) ^ per_doc(work, at, np.minimum))
        out[:, e] = (key & ~U(1)) | U(e >= elements)
    return out


def signatures(k: int, elements: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, c1, c2, keys); c1 and c2 are a 128-bit digest of the set."""
    for batch in batches:
        for s in slices(batch.column(1)):
            flat, at = document_sets(s, k)
            c1 = per_doc(mix(flat + U(17)), at).view(np.int64)
            c2 = per_doc(mix(flat ^ U(0x5851F42D4C957F2D)), at).view(np.int64)
            keys = band_elements(flat, at, elements).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * (2 * elements)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(np.diff(at)), pa.array(c1), pa.array(c2), lists], ["id", "n", "c1", "c2", "keys"])


def full_sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles): the distinct 64-bit hashes."""
    for batch in batches:
        for s in slices(batch.column(1)):
            flat, at = document_sets(s, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))], ["id", "shingles"])


def _order(c: Column) -> Column:
    """A fixed pseudo-random place of an id in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(c), 11).cast("double") / F.lit(float(1 << 53))


def _of_second(key: Column) -> Column:
    """Whether an element is of the second collection (its lowest bit)."""
    return key.bitwiseAND(F.lit(1)) == 1


class _Linker:
    def __init__(self, docs: DataFrame, k: int, percent: int, elements: int):
        self.k, self.percent, self.elements = k, percent, elements
        self.docs, self.scratch = docs, Scratch(docs.sparkSession, "near")
        self.sets: DataFrame | None = None

    def _close(self, a: str, b: str) -> Column:
        """Set sizes that allow the similarity: exact, as the smaller set bounds the intersection."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def _reach(self, inside: Column, total: Column) -> Column:
        """Whether ``inside`` common shingles can be enough for sets of ``total`` shingles together."""
        return (100 + self.percent) * inside >= self.percent * total

    def sides(self, classes: DataFrame) -> DataFrame:
        """(cls, n, score, elems) of classes that share an element of either collection with another class.

        ``score`` sums how many classes have each element.
        """
        each = classes.select("cls", "n", F.posexplode("keys").alias("pos", "key"))
        shared = self.scratch.put(each.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("held")).where("held > 1"), "shared")
        mine = each.join(shared, F.col("key") == F.col("__key")).groupBy("cls", "n").agg(F.sum("held").alias("score"), F.collect_list(F.struct("pos", "key")).alias("elems"))
        both = F.exists("elems", lambda e: e["pos"] < self.elements) & F.exists("elems", lambda e: e["pos"] >= self.elements)
        return self.scratch.put(mine.where(both), "sides")

    def gather_sets(self, sides: DataFrame) -> DataFrame:
        """(id, shingles) of the given classes. Others' texts do not move."""
        wanted = self.scratch.put(sides.select(F.col("cls").alias("__cls")).distinct(), "wanted")
        k = self.k
        maybe = bloom.keep_possible(self.docs, F.col("id"), wanted, "__cls", self.scratch).select("id", "text")
        sets = common.mapped(maybe, lambda batches: full_sets(k, batches), "id long, shingles array<long>")
        exact = sets.join(wanted, F.col("id") == F.col("__cls"), "left_semi")
        return self.scratch.put(exact.groupBy("id", F.xxhash64("shingles").alias("__h")).agg(F.first("shingles").alias("shingles")).select("id", "shingles"), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """(p, m, u, v, common, linked) of pairs (p, m) in components u and v: the intersection's size, and whether it is enough."""
        right = self.sets.select(F.col("id").alias("__m"), F.col("shingles").alias("right"))
        left = self.sets.select(F.col("id").alias("__p"), F.col("shingles").alias("left"))
        one = pairs.join(right, F.col("m") == F.col("__m")).select("p", "m", "u", "v", "right")
        both = one.join(left, F.col("p") == F.col("__p"))
        total = F.size("left") + F.size("right")
        tried = both.select("p", "m", "u", "v", total.alias("total"), F.size(F.array_intersect("left", "right")).alias("common"))
        return self.scratch.put(tried.select("p", "m", "u", "v", "common", self._reach(F.col("common"), F.col("total")).alias("linked")), "confirmed")

    def contract(self, roots: DataFrame | None, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((node, root) of all links so far, the step of it that ``tried`` adds)."""
        step = components(tried.where("linked").select("u", "v"), self.scratch)
        if roots is None:
            return step, step
        moved = step.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        return self.scratch.put(roots.join(moved, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root")).unionByName(step), "roots"), step

    def first_turn(self, sides: DataFrame) -> DataFrame:
        """(p, m, u, v, common, linked): members of the buckets (x_i, y_i) against the bucket's pivot."""
        first = sides.select("cls", "n", "score", "elems", F.explode(F.filter("elems", lambda e: e["pos"] < self.elements)).alias("one"))
        other = F.get(F.filter("elems", lambda e: e["pos"] == F.col("one.pos") + self.elements), F.lit(0))["key"]
        rows = first.select("cls", "n", "score", F.col("one.key").alias("xk"), other.alias("yk")).where("yk IS NOT NULL")
        rows = self.scratch.put(rows.select(F.xxhash64("xk", "yk").alias("bucket"), "cls", "n", "score"), "diagonal")
        pivot = F.max(F.struct("score", _order(F.col("cls")).alias("spot"), "cls", "n")).alias("pivot")
        made = rows.groupBy(F.col("bucket").alias("__bucket")).agg(F.count("*").alias("size"), pivot).where("size > 1")
        found = rows.join(made, F.col("bucket") == F.col("__bucket")).where(F.col("cls") != F.col("pivot.cls")).where(self._close("n", "pivot.n"))
        pairs = found.select(F.col("pivot.cls").alias("p"), F.col("cls").alias("m")).distinct()
        return self.confirm(pairs.select("p", "m", F.col("p").alias("u"), F.col("m").alias("v")))

    def open_elements(self, rows: DataFrame, merge: bool = False) -> DataFrame:
        """``rows`` with ``x`` and ``y``: the elements of either collection that classes of several components have.

        With ``merge`` elements of the same classes are one. Classes without an x or y are left out.
        """
        each = rows.select(*[c for c in rows.columns if c != "keys"], F.explode("keys").alias("key"))
        facts = [F.min("root").alias("low"), F.max("root").alias("high")]
        if merge:
            facts += [F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("f1"), F.sum(F.shiftrightunsigned(F.xxhash64("cls", F.lit(1)), 40)).alias("f2")]
        mixed = each.groupBy(F.col("key").alias("__key")).agg(*facts).where("low <> high")
        kept = "key"
        if merge:
            mixed = self.scratch.put(mixed, "mixed")
            same = ["size", "f1", "f2", "side"]
            named = mixed.withColumn("side", _of_second(F.col("__key")))
            least = self.scratch.put(named.groupBy(*same).agg(F.min("__key").alias("__key")).select("__key"), "named")
            mixed, kept = least, "__key"
        mixed = self.scratch.put(mixed.select("__key"), "open")
        held = each.join(mixed, F.col("key") == F.col("__key")).drop("__key")
        others = [c for c in rows.columns if c != "keys"]
        made = held.groupBy(*others).agg(F.collect_set("key").alias("keys"))
        made = made.withColumn("x", F.filter("keys", lambda e: ~_of_second(e))).withColumn("y", F.filter("keys", _of_second))
        return self.scratch.put(made.where("size(x) > 0 AND size(y) > 0"), "open-classes")

    def bounded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``c``, the number of their shingles that another component has too, and ``shares``, these by groups of shingles.

        A link needs ``percent`` of the larger set in common, so of either set: classes with fewer are left out.
        """
        each = rows.select("cls", "root").join(self.sets, F.col("cls") == F.col("id")).select("cls", "root", F.explode("shingles").alias("shingle"))
        mixed = each.groupBy(F.col("shingle").alias("__shingle")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("__shingle")
        counted = each.join(mixed, F.col("shingle") == F.col("__shingle")).groupBy(F.col("cls").alias("__cls"), F.col("shingle").bitwiseAND(F.lit(SHARES - 1)).cast("int").alias("share")).agg(F.count("*").cast("int").alias("held"))
        counted = counted.groupBy("__cls").agg(F.sum("held").alias("c"), F.map_from_entries(F.collect_list(F.struct("share", "held"))).alias("held"))
        able = rows.join(counted, F.col("cls") == F.col("__cls")).where(100 * F.col("c") >= self.percent * F.col("n"))
        shares = F.transform(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0)))
        return self.scratch.put(able.withColumn("shares", shares).drop("__cls", "held", "x", "y"), "bounded")

    def link(self, sides: DataFrame) -> DataFrame:
        """(node, root) of all classes that are linked."""
        put = self.scratch.put
        roots, _ = self.contract(None, self.first_turn(sides))
        state = sides.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "n", "score", F.coalesce("root", "cls").alias("root"), F.transform("elems", lambda e: e["key"]).alias("keys"))
        able = self.bounded(self.open_elements(put(state, "state")))
        able = self.open_elements(able, merge=True)
        # A pair meets in several tables; it is tried in that of the first x and the first y it shares.
        rows = able.select("cls", "n", "score", "root", "c", "shares", "x", "y", F.explode("x").alias("xk")).select("*", F.explode("y").alias("yk"))
        rows = put(rows.select(F.xxhash64("xk", "yk").alias("bucket"), "xk", "yk", "cls", "n", "score", "root", "c", "shares", "x", "y", _order(F.col("cls")).alias("spot")), "tables")
        made = rows.groupBy(F.col("bucket").alias("__bucket")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("score", "spot", "cls", "n", "root")).alias("pivot")).where("low <> high").select("__bucket", "pivot")
        rows = put(rows.join(made, F.col("bucket") == F.col("__bucket")).select("bucket", "xk", "yk", "cls", "n", "root", "c", "shares", "x", "y", "spot", F.col("pivot.cls").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.root").alias("pivot_root")), "members")
        pairs = rows.where("cls <> pivot").where(self._close("n", "pivot_n")).select(F.col("pivot").alias("p"), F.col("cls").alias("m"), F.col("pivot_root").alias("u"), F.col("root").alias("v")).distinct()
        tried = self.confirm(pairs)
        roots, step = self.contract(roots, tried)
        # With the bucket's pivot P, two members share at most min(|X & P|, |Y & P|) plus min(x, y), where x and y
        # count shingles outside P that another component may have too: what X shares with a P of its own component
        # need not be among the c. Without |X & P| (sizes too far apart) c bounds both parts.
        known = tried.select(F.col("p").alias("__p"), F.col("m").alias("__m"), "common").distinct()
        rest = rows.where("cls <> pivot").join(known, (F.col("pivot") == F.col("__p")) & (F.col("cls") == F.col("__m")), "left")
        outside = F.when(F.col("root") == F.col("pivot_root"), F.least("c", F.col("n") - F.col("common"))).otherwise(F.col("c") - F.col("common"))
        rest = rest.select("bucket", "xk", "yk", "cls", "n", "root", "c", "shares", "x", "y", "spot", F.coalesce("common", "c").alias("near"), F.coalesce(outside, "c").alias("far"))
        reach = GROWTH
        while True:
            rest = self.undecided(rest, step)
            most = rest.agg(F.max("size")).first()[0]
            if most is None:
                return roots
            place = F.col("spot") * F.col("size")
            pivots = rest.where((place >= (0 if reach == GROWTH else reach // GROWTH)) & (place < reach))
            pivots = pivots.select(F.col("bucket").alias("__b"), F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("near").alias("pnear"), F.col("far").alias("pfar"), F.col("spot").alias("pspot"), F.col("root").alias("proot"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("shares").alias("pshares"))
            later = (F.col("spot") > F.col("pspot")) | ((F.col("spot") == F.col("pspot")) & (F.col("cls") > F.col("p")))
            inside = F.least(F.least("c", "pc"), F.least("near", "pnear") + F.least("far", "pfar"))
            able = self._close("n", "pn") & self._reach(inside, F.col("n") + F.col("pn"))
            here = (F.array_min(F.array_intersect("x", "px")) == F.col("xk")) & (F.array_min(F.array_intersect("y", "py")) == F.col("yk"))
            shared = F.aggregate(F.zip_with("shares", "pshares", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
            open_pairs = rest.join(pivots, (F.col("bucket") == F.col("__b")) & (F.col("root") != F.col("proot")) & later & able & here & self._reach(shared, F.col("n") + F.col("pn")))
            pairs = put(open_pairs.select("p", F.col("cls").alias("m"), F.col("proot").alias("u"), F.col("root").alias("v")), "round")
            roots, step = self.contract(roots, self.confirm(pairs))
            if most <= reach:
                return roots
            rest = rest.drop("size")
            reach *= GROWTH

    def undecided(self, rows: DataFrame, step: DataFrame) -> DataFrame:
        """The rows of buckets with several components, their root brought up to date, and the bucket's size."""
        moved = step.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        state = rows.join(moved, F.col("root") == F.col("__n"), "left").withColumn("root", F.coalesce("__r", "root"))
        state = self.scratch.put(state.drop("__n", "__r"), "state")
        mixed = state.groupBy(F.col("bucket").alias("__bucket")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high").select("__bucket", "size")
        return self.scratch.put(state.join(mixed, F.col("bucket") == F.col("__bucket")).drop("__bucket"), "rest")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, elements: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    linker = _Linker(rows, k, percent, elements)
    put = linker.scratch.put
    signed = put(common.mapped(rows, lambda batches: signatures(k, elements, batches), "id long, n long, c1 long, c2 long, keys array<long>"), "signatures")
    live = signed.where("n > 0 AND id IS NOT NULL")
    classes = put(live.groupBy("c1", "c2").agg(F.min("id").alias("cls"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    sides = linker.sides(classes)
    linker.sets = linker.gather_sets(sides)
    roots = linker.link(sides)
    named = put(classes.join(roots, F.col("cls") == F.col("node"), "left").select(F.col("c1").alias("__c1"), F.col("c2").alias("__c2"), F.coalesce("root", "cls").alias("component")), "named")
    linker.scratch.keep_only(signed, named)  # each written when those it reads were
    out = signed.join(named, (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
