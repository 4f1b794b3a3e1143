"""Near-duplicate documents by HyperMinHash sketches.

**Sketch.** Each of ``REGISTERS`` buckets has a hash function of its own and keeps of the smallest hash
of the document's shingles only its number of leading zeros (6 bits) and the ``MANTISSA`` bits behind
the first one: 16 bits instead of 64. A function for each bucket, rather than a share of the
shingles, fills every bucket of the smallest set and keeps buckets independent, so the error
is the same at every size.

**Bands.** ``ROWS`` registers are a key; ``BANDS`` of them come from three orders of the registers. Documents
of similarity s share none of the keys with probability (1 - s^6)^63: 5e-9 at 0.8, less above.
Documents with equal sets are one representative from the start.

**Candidates.** A key has one centre, the member that shares most keys with others, and each
document is compared with the centre that most of its keys have. What that connects is settled. Keys whose members remain in several
component are open: their members outside the key's largest component have their registers
compared with all members, in blocks of bounded size, and only pairs between components whose
estimate suffices leave the block, each from one of its common keys only. Of keys for which
that would be more than ``COMPARED`` comparisons, the members too few of whose shingles are in
another component are left out first: they can have no partner (exact). Then all open keys are compared.

**Estimate.** Equal registers are counted and corrected for accidental ones: registers of unrelated sets
of n and m shingles agree with a probability that follows from n and m (``accidental``). Pairs whose
corrected estimate lies five standard deviations under the threshold are rejected. In open keys,
the ``LOWEST`` smallest shingles of both sets then decide: exactly for sets that have no more, else by an
estimate of twice the precision, with the same slack. What is left is verified on the full
shingle sets of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.frames import mapped, stored
from spectrafold.llm.graphs import components
from spectrafold.llm.ngram_join import verified
from spectrafold.llm.words import LOWER, batches, mix, shingles, signed, split

REGISTERS = 128
MANTISSA = 10
ROWS = 6
COMPARED = 4_000_000  # comparisons of registers in an open key, before members are left out
BLOCK = 2_000  # members whose registers one task holds for each side
LOWEST = 512  # smallest shingles of a set that are compared
GROUP = 4_000  # rows of small keys that are compared together, about
SLACK = 5.0  # standard deviations
_CHUNK = 4096  # shingles hashed at a time
_TILE = 32  # rows compared at a time
_SMALL = 1024  # comparisons made in one expression

_SEED = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_FACTOR = (mix(_SEED + np.uint64(77)) | np.uint64(1)).reshape(-1, 1)
_ORDERS = [np.argsort(mix(_SEED.ravel() + np.uint64(k))) for k in range(3)]
_BAND = np.concatenate([o[: REGISTERS // ROWS * ROWS].reshape(-1, ROWS) for o in _ORDERS])  # its registers
BANDS = len(_BAND)


def compressed(smallest: np.ndarray) -> np.ndarray:
    """64-bit minima as registers: leading zeros, then the bits behind the first one."""
    value = smallest >> np.uint64(11)  # 53 bits, exact as doubles
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = length - 1 - MANTISSA
    down = value >> np.maximum(shift, 0).astype(np.uint64)
    bits = (down << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((53 - length).astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)


def sketch(own: np.ndarray) -> np.ndarray:
    """Registers of a set of shingle hashes that is not empty."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for lo in range(0, len(own), _CHUNK):
        part = own[None, lo : lo + _CHUNK]
        np.minimum(least, ((part ^ _SEED) * _FACTOR).min(1), out=least)
    return compressed(least)


def _equal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many registers agree, for every row of ``one`` with every row of ``two``."""
    if len(one) * len(two) <= _SMALL:
        return (one[:, None, :] == two[None, :, :]).sum(2).astype(np.uint8)
    equal = np.zeros((len(one), len(two)), np.uint8)
    columns = np.ascontiguousarray(two.T)
    for lo in range(0, len(one), _TILE):  # a tile stays in the processor's cache
        tile, rows = equal[lo : lo + _TILE], one[lo : lo + _TILE]
        same = np.empty(tile.shape, bool)
        for t in range(REGISTERS):
            np.equal(rows[:, t, None], columns[t], out=same)
            tile += same.view(np.uint8)
    return equal


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of ``n`` and ``m`` shingles agree.

    The minima have densities n e^-nx and m e^-mx; in the octave [2^-k, 2^(1-k)) registers are
    2^(-k - MANTISSA) wide, so the chance is the integral of both densities times that width.
    """
    n, m = np.asarray(n, float), np.asarray(m, float)
    total = n + m
    chance = np.zeros(np.broadcast(n, m).shape)
    for k in range(1, 54):
        share = np.exp(-total * 2.0**-k) - np.exp(-total * 2.0 ** (1 - k))
        chance += 2.0 ** (-k - MANTISSA) * n * m / total * share
    return np.minimum(chance, 0.5)


def similarity(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the number of equal registers, corrected for accidental ones."""
    by_chance = accidental(n, m)
    return (equal / REGISTERS - by_chance) / (1 - by_chance)


def floor_of(num: int, den: int) -> float:
    """Estimates below are not similar pairs."""
    s = num / den
    return s - SLACK * (s * (1 - s) / REGISTERS) ** 0.5


def lowest(own: np.ndarray) -> np.ndarray:
    """The smallest hashes of a sorted set, without their lower halves."""
    return (own[:LOWEST] >> np.uint64(32)).astype(np.uint32)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def possible(one: np.ndarray, two: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    """If sets of ``n`` and ``m`` shingles with these ``lowest`` may be similar.

    Decided exactly where both are whole; shingles of a set that look alike count as common.
    """
    whole = n == len(one) and m == len(two)
    if not whole:  # what both know completely
        top = min(x[-1] for x, size in ((one, n), (two, m)) if size > len(x))
        one, two = one[one <= top], two[two <= top]
    first, second = _distinct(one), _distinct(two)
    at = np.minimum(np.searchsorted(first, second), len(first) - 1) if len(first) else 0
    both = int((first[at] == second).sum()) if len(first) else 0
    both += min(len(one) - len(first), len(two) - len(second))
    union = len(one) + len(two) - both
    if whole:
        return den * both >= num * union
    s = num / den
    return both >= union * (s - SLACK * (s * (1 - s) / max(union, 1)) ** 0.5)


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, version (of the text), n_shingles, set (id of equal sets, null without shingles), registers."""

    def one(own: np.ndarray) -> tuple:
        if not len(own):
            return 0, None, None
        whole = xxhash.xxh3_64_intdigest(own.tobytes())
        return len(own), whole - (1 << 64) if whole >> 63 else whole, sketch(own).tobytes()

    def compute(texts):
        rows = []
        for part in batches(texts):
            rows += [one(own) for own in shingles(split(texts[part], LOWER), words)]
        return {name: [r[k] for r in rows] for k, name in enumerate(("n_shingles", "set", "registers"))}

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return mapped(text, "n_shingles long, set long, registers binary", lambda: compute, ["text"], drop=["text"])


def _representatives(facts: DataFrame) -> DataFrame:
    """One row per set: set, doc_id (the smallest), version, n_shingles, registers."""
    known = facts.filter(F.col("set").isNotNull() & F.col("doc_id").isNotNull())
    least = known.groupBy("set").agg(F.min(F.struct("doc_id", "version")).alias("r"))
    least = stored(least.select("set", "r.doc_id", "r.version"), "hyper-least")
    return known.join(least, ["set", "doc_id", "version"], "left_semi").dropDuplicates(["set", "doc_id", "version"])


def _registers(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def promising(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow them to be similar."""
    size = reps.select("set", F.col("n_shingles").alias("n"))
    fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    sized = (
        pairs.join(size.withColumnsRenamed({"set": "a", "n": "na"}), "a")
        .join(size.withColumnsRenamed({"set": "b", "n": "nb"}), "b")
        .filter(fits)
    )
    own = reps.select("set", "registers")
    both = sized.join(own.withColumnsRenamed({"set": "a", "registers": "ra"}), "a")
    both = both.join(own.withColumnsRenamed({"set": "b", "registers": "rb"}), "b")
    least = floor_of(num, den)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            equal = (_registers(frame["ra"]) == _registers(frame["rb"])).sum(1)
            yield frame.loc[similarity(equal, frame["na"].to_numpy(), frame["nb"].to_numpy()) >= least, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


class _Search:
    """Links found so far among the representatives, and the components they make."""

    def __init__(self, reps: DataFrame, docs: DataFrame, words: int, num: int, den: int):
        self.reps, self.docs, self.limits = reps, docs, (words, num, den)
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def _texts(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        chosen = self.reps.select("set", "doc_id", "version").join(ids, "set")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
        found = texts.join(chosen, ["doc_id", "version"]).dropDuplicates(["set"])
        return stored(found.select(F.col("set").alias("doc_id"), "text"), "hyper-texts")

    def add(self, pairs: DataFrame, estimated: bool = False) -> None:
        """Verify candidate pairs (a, b) and connect the similar ones."""
        words, num, den = self.limits
        likely = pairs if estimated else promising(pairs, self.reps, num, den)
        likely = stored(likely, "hyper-likely")
        if likely.isEmpty():
            return
        found = stored(verified(likely, self._texts(likely), words, num, den), "hyper-links")
        self.links = found if self.links is None else self.links.union(found)
        self.comps = components(self.links)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``comp``: the component of ``set``, its own where nothing links to it."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("set"))
        comps = self.comps.withColumnRenamed("doc_id", "set")
        return rows.join(comps, "set", "left").withColumn("comp", F.coalesce("comp", "set"))

    def round(self, keys: DataFrame) -> DataFrame:
        """Centres of the keys (key, bits, set). Returns the rows of open keys.

        key, bits, set, comp, and of the key: n members, ``others`` of which are not in its
        largest component ``top``.
        """
        sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # Stored first: a join of two plain inputs is one whose hot keys Spark can split.
        rows = stored(keys.join(stored(sizes, "hyper-sizes"), "key"), "hyper-rows")
        degree = rows.groupBy("set").agg(F.sum("n").alias("degree"))
        top = rows.join(degree, "set").groupBy("key").agg(F.max(F.struct("degree", "set")).alias("top"))
        centres = stored(top.select("key", F.col("top.set").alias("a")), "hyper-centres")
        # One comparison a member: with the centre that most of its keys have.
        stars = rows.join(centres, "key").groupBy("set", "a").agg(F.count(F.lit(1)).alias("shared"))
        best = stars.filter("a != set").groupBy("set").agg(F.max(F.struct("shared", "a")).alias("best"))
        self.add(self._between(best.select(F.col("best.a").alias("a"), F.col("set").alias("b"))))
        placed = stored(self.placed(rows), "hyper-placed")
        spans = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        spans = spans.groupBy("key").agg(F.first("n").alias("n"), F.max(F.struct("c", "comp")).alias("t"))
        spans = spans.select("key", (F.col("n") - F.col("t.c")).alias("others"), F.col("t.comp").alias("top"))
        return stored(placed.join(stored(spans.filter("others > 0"), "hyper-spans"), "key"), "hyper-open")

    def _between(self, pairs: DataFrame) -> DataFrame:
        """The pairs between components."""
        if self.comps is None:
            return pairs.distinct()
        one = self.comps.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca"))
        two = self.comps.select(F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
        placed = pairs.distinct().join(one, "a", "left").join(two, "b", "left")
        return placed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def _lowest(self, ids: DataFrame) -> DataFrame:
        """set, low: the ``lowest`` shingles of the sets in ``ids``."""
        words = self.limits[0]

        def compute(texts):
            found = []
            for part in batches(texts):
                found += [lowest(own).tobytes() for own in shingles(split(texts[part], LOWER), words)]
            return {"low": found}

        texts = self._texts(ids.select(F.col("set").alias("a"), F.col("set").alias("b")))
        return mapped(texts, "low binary", lambda: compute, ["text"], drop=["text"]).withColumnRenamed("doc_id", "set")

    def supported(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of open keys) without the sets that cannot have a partner in another component.

        A similar set holds num of den of the shingles at least, so as many are in another
        component's sets among ``rows``.
        """
        words, num, den = self.limits
        own = stored(rows.select("set", "comp").distinct(), "hyper-own")

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                texts, ids = frame.column("text").to_pylist(), frame.column("doc_id").to_numpy()
                for part in batches(texts):
                    sets = list(shingles(split(texts[part], LOWER), words))
                    names = np.repeat(ids[part], [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(signed(np.concatenate(sets)))], ["set", "h"])

        texts = self._texts(own.select(F.col("set").alias("a"), F.col("set").alias("b")))
        held = texts.mapInArrow(run, "set long, h long").join(own, "set")
        several = held.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        shared = held.join(stored(several.select("h"), "hyper-several"), "h").groupBy("set").agg(F.count(F.lit(1)).alias("c"))
        enough = shared.join(self.reps.select("set", "n_shingles"), "set").filter(f"{den} * c >= {num} * n_shingles")
        return stored(rows.join(enough.select("set"), "set", "left_semi"), "hyper-supported")

    def compare(self, rows: DataFrame) -> None:
        """Finish open keys: registers are compared block by block, small keys many at a time.

        A pair leaves only the key of the lowest band it has in common among the keys that
        are compared (``mask``); a key that is not, because it is settled, needs no comparison.
        """
        _, num, den = self.limits
        least = floor_of(num, den)
        groups = -(-rows.count() // GROUP)
        if not groups:
            return
        masks = rows.groupBy("set").agg(F.expr("bit_or(bits)").alias("mask"))
        low = stored(self._lowest(rows.select("set").distinct()), "hyper-lowest")
        own = self.reps.select("set", "n_shingles", "registers").join(masks, "set").join(low, "set")
        own = rows.join(own, "set").withColumn("other", F.col("comp") != F.col("top"))
        # Every block of all members meets every block of the others.
        deal = lambda column: F.pmod(F.xxhash64("set", F.lit(column)), F.col(column)).cast("int")
        spread = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
        own = own.withColumns({"nb": F.ceil(F.col("n") / BLOCK).cast("int"), "no": F.ceil(F.col("others") / BLOCK).cast("int")})
        own = own.withColumn("grp", F.when(F.col("nb") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
        every = own.withColumns({"x": deal("nb"), "y": spread("no"), "asks": F.lit(False)})
        others = own.filter("other").withColumns({"y": deal("no"), "x": spread("nb"), "asks": F.lit(True)})

        def within(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of one key."""
            asks = rows["asks"]
            first, second = {c: v[asks] for c, v in rows.items()}, {c: v[~asks] for c, v in rows.items()}
            one, two = first["registers"], second["registers"]
            equal = _equal(one, two)
            enough = equal >= np.uint8(max(0, int(least * REGISTERS)))
            enough &= first["comp"][:, None] != second["comp"][None, :]
            i, j = np.nonzero(enough)
            keep = (first["set"][i] < second["set"][j]) | ~second["other"][j]  # two others meet twice
            i, j = i[keep], j[keep]
            for k in range(int(rows["bits"][0]).bit_length() - 1):  # lower bands
                if not len(i):
                    break
                met = (first["keys"][i, k] == second["keys"][j, k]) & (first["mask"][i] >> k & 1 == 1)
                i, j = i[~met], j[~met]
            na, nb = first["n_shingles"][i], second["n_shingles"][j]
            keep = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
            i, j, na, nb = i[keep], j[keep], na[keep], nb[keep]
            keep = similarity(equal[i, j], na, nb) >= least
            i, j = i[keep], j[keep]
            own = {k: np.frombuffer(first["low"][k], np.uint32) for k in np.unique(i).tolist()}
            its = {k: np.frombuffer(second["low"][k], np.uint32) for k in np.unique(j).tolist()}
            sizes = zip(i.tolist(), j.tolist(), first["n_shingles"][i].tolist(), second["n_shingles"][j].tolist())
            may = np.array([possible(own[p], its[q], n, m, num, den) for p, q, n, m in sizes], bool)
            a, b = first["set"][i[may]], second["set"][j[may]]
            return np.minimum(a, b), np.maximum(a, b)

        def pairs(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("key")
            whole = {c: frame[c].to_numpy() for c in frame.columns if c != "registers"}
            registers = whole["registers"] = _registers(frame["registers"])
            whole["keys"] = np.stack([_key(registers, k, band) for k, band in enumerate(_BAND)], 1)
            start = np.flatnonzero(np.diff(whole["key"]) != 0) + 1
            found = [
                within({c: v[lo:hi] for c, v in whole.items()})
                for lo, hi in zip([0, *start.tolist()], [*start.tolist(), len(frame)])
            ]
            return pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

        columns = ["grp", "key", "bits", "x", "y", "asks", "other", "set", "comp", "mask", "n_shingles", "registers", "low"]
        meeting = every.select(columns).unionByName(others.select(columns))
        found = meeting.groupBy("grp", "x", "y").applyInPandas(pairs, "a long, b long")
        self.add(found.distinct(), estimated=True)


def _key(own: np.ndarray, k: int, band: np.ndarray) -> np.ndarray:
    """Key of band ``k`` for rows of registers."""
    key = np.full(len(own), k + 1, np.uint64)
    for register in band:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, register].astype(np.uint64))
    return key


def _band_keys(reps: DataFrame) -> DataFrame:
    """key, bits (the band's), set: the bands of compressed registers."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            own = _registers(frame.column("registers").to_pylist())
            sets = frame.column("set").to_numpy()
            for k, band in enumerate(_BAND):
                key = _key(own, k, band)
                bits = np.full(len(own), 1 << k, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(bits), pa.array(sets)], ["key", "bits", "set"])

    return reps.select("set", "registers").mapInArrow(run, "key long, bits long, set long")


def links(reps: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame | None:
    """Components (doc_id holds the set, comp) of the sets that have a link; None if there is no link."""
    search = _Search(reps, docs, words, num, den)
    rows = search.round(_band_keys(reps))
    few = F.col("n") * F.col("others") <= COMPARED
    large = rows.filter(~few)
    if not large.isEmpty():
        rows = rows.filter(few).unionByName(search.supported(large))
    search.compare(rows)
    return search.comps


def report(docs: DataFrame, words: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``.

    A document's set are its distinct shingles of ``words`` lower-case words (fewer words: all of
    them as one). Documents link when den * intersection >= num * union, confirmed on the full
    sets; a component is what links connect, named by its smallest id, which is the one kept. Texts
    that are null, empty or without words have no set, link with nothing and are kept. Different
    texts of one id are judged each on its own; equal rows are alike. A row without an id has the
    component of an equal set, and is kept if there is none. Shingles and sets are
    identified by 64-bit hashes. Extra columns of ``docs`` are not used; an empty table gives no rows.
    """
    facts = stored(described(docs, words), "hyper-facts")
    reps = stored(_representatives(facts), "hyper-reps")
    comps = links(reps, docs, words, num, den)
    names = reps.select("set", "doc_id")
    if comps is not None:
        placed = names.join(comps.withColumnRenamed("doc_id", "set"), "set", "left")
        placed = placed.withColumn("comp", F.coalesce("comp", "set"))
        least = stored(placed.groupBy("comp").agg(F.min("doc_id").alias("doc_id")), "hyper-names")
        names = placed.select("set", "comp").join(least, "comp")
    names = stored(names.select("set", F.col("doc_id").alias("name")), "hyper-sets")
    rows = facts.select("doc_id", "n_shingles", "set").join(names, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
