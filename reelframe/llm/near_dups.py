"""MinHash near-dedup with HyperMinHash sketches.

A document's set are its distinct ``SHINGLE``-word shingles.  Their 64-bit hashes fall
by the leading bits into ``2 ** P`` buckets; a bucket keeps its smallest hash as a
register of 16 bits: the number of leading zeros of the remaining bits and ``R`` bits
of mantissa.  For banding, empty registers borrow from full ones at places fixed in
advance (densification), so that a band is as selective for short texts as for long
ones.  ``BAND`` registers form a band; documents that agree in a band are candidates.
From two sketches the similarity is estimated, less the matches expected by chance,
and candidates clearly below the threshold go.  What stays is confirmed on the full
shingle sets of the whole texts.

The work follows the number of different texts, not of pairs:

* equal word sequences are one class, held by the smallest id;
* of the classes that share a band's bucket, the one with most company over all its
  buckets is the hub; every other class is compared with its hubs, and verified links
  are merged into components;
* classes with a common hub are a group.  Only groups that still hold several
  components are looked at again.  In a small one (``SMALL`` classes at most) pairs of
  different components are candidates like those above.  A larger one is cut into
  blocks of about ``BLOCK`` classes (fewer if they are long); the classes outside its
  largest component are held against every block, ``ASKED`` or so at a time, first by their sketches.  Texts
  follow only for those that may be linked with another component there, and a
  block returns no more links than join components.  No pairs are formed there.

Links inside a component change nothing, so no link between components is lost.

Nulls and odd input: a null or empty text, or one of white space, has an empty set
(0 shingles), is linked with nothing and kept; a text with fewer words than a shingle
has its whole sequence as its one shingle; a row with a null id is linked with nothing,
has a null component and is kept; repeated rows are copies of each other (rows with one
id and one text share the fate of their id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, against, read, small_batches
from reelframe.llm.components import components

SHINGLE, PERCENT = 2, 80
P, R, BAND = 8, 10, 6
SMALL, BLOCK, ASKED = 24, 512, 2048
LONG = 1 << 20  # shingles that a block holds, about
ROWS = 1000  # of a batch in Python
BITS = 22  # of the map that keeps rows out of a shuffle
SLACK = 4.5  # standard errors by which an estimate must miss the threshold to drop a pair


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than blank, tab, newline and their like; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _codes(ws: list[bytes], k: int) -> tuple[np.ndarray, list[bytes]]:
    """Each position's shingle as a row of word numbers; the words by number."""
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64)
    if len(at) < k:
        return at[None, :], list(ids)
    return np.lib.stride_tricks.sliding_window_view(at, k), list(ids)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each distinct shingle, sorted; distinctness is decided exactly."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    rows, names = _codes(ws, k)
    h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    if rows.shape[1] * np.log2(len(names) + 1) < 62:
        code = np.zeros(len(rows), np.int64)
        for j in range(rows.shape[1]):
            code = code * len(names) + rows[:, j]
        rows = rows[np.unique(code, return_index=True)[1]]
    else:
        rows = np.unique(rows, axis=0)
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out + h[rows[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.sort(out)


def sketch(hashes: np.ndarray, p: int = P, r: int = R) -> np.ndarray:
    """Registers (uint16) of sorted hashes; 0 for an empty bucket."""
    out = np.zeros(1 << p, np.uint16)
    bucket = (hashes >> np.uint64(64 - p)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] & np.uint64((1 << (64 - p)) - 1)
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.clip(64 - p - exponent, 0, 62).astype(np.uint16)
    out[bucket[first]] = ((zeros + 1) << r) | np.clip((mantissa * 2 - 1) * (1 << r), 0, (1 << r) - 1).astype(np.uint16)
    return out


_rng = np.random.default_rng(3)
_PROBES = np.stack([_rng.permutation(1 << P) for _ in range(24)])


def densify(regs: np.ndarray) -> np.ndarray:
    """Empty registers of the rows filled from full ones; rows that are all empty stay."""
    out = regs.copy()
    for probe in _PROBES:
        empty = out == 0
        if not empty.any():
            return out
        out = np.where(empty, regs[:, probe], out)
    for _ in range(out.shape[1]):
        if not (out == 0).any():
            break
        out = np.where(out == 0, np.roll(out, -1, axis=1), out)
    return out


def word_shingles(text: str | None, k: int = SHINGLE) -> set:
    """The full set, as bytes: words joined by a blank, which no word contains."""
    ws = words(text)
    if not ws:
        return set()
    return {b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, key, sketch) for each row; key: a digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, regs = [], [], []
            for t in b.column(1):
                h = shingle_hashes(t := t.as_py(), k)
                n.append(len(h))
                key.append(md5(b" ".join(words(t))).digest() if len(h) else None)
                regs.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "key", "sketch"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, key binary, sketch binary")


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, rep, n): a bucket for each band of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                regs = densify(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(b.num_rows, -1))
                many = regs.shape[1] // BAND
                parts = regs[:, : many * BAND].reshape(b.num_rows, many, BAND).astype(np.uint64)
                key = np.broadcast_to(np.arange(many, dtype=np.uint64), (b.num_rows, many)).copy()
                for j in range(BAND):
                    key = (key + parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                own = pa.array(np.repeat(np.arange(b.num_rows), many))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column("rep").take(own), b.column("n").take(own)], names=["bucket", "rep", "n"])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "bucket long, rep long, n long")


@functools.cache
def _collisions(a: int, b: int) -> float:
    """Registers that agree by chance in sketches of sets of 2 ** (a / 4) and 2 ** (b / 4) elements."""
    zeros, mantissa = np.arange(1, 64 - P)[:, None], np.arange(1 << R)[None, :]
    low, high = (((1 << R) + mantissa + more) / 2.0 ** (P + R + zeros) for more in (0, 1))
    at = [np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-high)) for n in (2 ** (a / 4), 2 ** (b / 4))]
    return float((1 << P) * (at[0] * at[1]).sum())


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected matches by chance for sets of n and of m elements; sizes are rounded to quarters of a power of two."""
    a, b = (np.rint(4 * np.log2(np.maximum(x, 1))).astype(np.int64) for x in (np.minimum(n, m), np.maximum(n, m)))
    pairs, at = np.unique(a * 1024 + b, return_inverse=True)
    return np.array([_collisions(int(p) // 1024, int(p) % 1024) for p in pairs])[at]


def may_link(x: np.ndarray, y: np.ndarray, by_chance: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (rows) of two sides may be of linked sets."""
    t = percent / 100
    used = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1) - by_chance
    return same >= used * t - SLACK * np.sqrt(used * t * (1 - t)) - 1


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose estimated similarity may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = [b.column(c).to_numpy() for c in ("na", "nb")]
                ok = may_link(registers(b.column("sa")), registers(b.column("sb")), chance(*n), percent)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    sides = [classes.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            ok = []
            for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
                x = x.as_py()
                if x != last:
                    last, held = x, word_shingles(x, k)
                ok.append(linked(held, word_shingles(y.as_py(), k), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def outlook(held: pa.Table, percent: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Answers asked classes (block, rep, c, n, sketch) with those, and the held ones, that may be linked."""
    c, n, reps = (held.column(x).to_numpy() for x in ("c", "n", "rep"))
    regs = registers(held.column("sketch"))
    told = np.zeros(len(c), bool)

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, mine, new = registers(b.column("sketch")), np.zeros(b.num_rows, bool), [np.empty(0, np.int64)]
        for i, (own, size) in enumerate(zip(b.column("c").to_numpy(), b.column("n").to_numpy(), strict=True)):
            at = np.flatnonzero((c != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
            if len(at):
                ok = at[may_link(regs[at], asked[i], chance(n[at], np.full(len(at), size)), percent)]
                mine[i] = len(ok) > 0
                new.append(ok[~told[ok]])
                told[ok] = True
        found, other = np.flatnonzero(mine), np.concatenate(new)
        block, sides = b.column("block")[0].as_py(), [True] * len(found) + [False] * len(other)
        both = [np.concatenate([b.column(x).to_numpy()[found], y[other]]) for x, y in (("rep", reps), ("c", c))]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(sides), pa.int64()), pa.array(sides, pa.bool_()), *map(pa.array, both)], names=["block", "asked", "rep", "c"])

    return answer


def joining(held: pa.Table, k: int, percent: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Answers asked classes (rep, c, text) with the links (a, b) that join components, no more than needed."""
    reps, c, texts = held.column("rep").to_pylist(), held.column("c").to_pylist(), held.column("text")
    own = [shingle_hashes(t.as_py(), k) for t in texts]
    n = np.array([len(x) for x in own])
    vocab, at = np.unique(np.concatenate(own), return_inverse=True)
    holders = np.repeat(np.arange(len(own)), n)[np.argsort(at, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vocab)))])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for rep, comp, text in zip(b.column("rep").to_pylist(), b.column("c").to_pylist(), b.column("text").to_pylist(), strict=True):
            h, words_ = shingle_hashes(text, k), None
            i = np.searchsorted(vocab, h)
            i = i[vocab[np.minimum(i, len(vocab) - 1)] == h]
            if not len(i):
                continue
            many = start[i + 1] - start[i]
            places = np.repeat(start[i] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(holders[places], minlength=len(n))
            for j in np.flatnonzero(100 * both >= percent * (n + len(h) - both)):
                x, y = find(comp), find(c[j])
                if x != y:
                    words_ = words_ or word_shingles(text, k)
                    if linked(words_, word_shingles(texts[int(j)].as_py(), k), percent):
                        root[max(x, y)] = min(x, y)
                        out.append((rep, reps[j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return answer


def among(rows: DataFrame, needed: DataFrame, key: str = "rep") -> DataFrame:
    """Of ``rows``, those whose ``key`` may be in ``needed``.

    A bitmap of 2 ** BITS hashed keys, 2 ** (BITS - 6) words at most whatever the
    input, is broadcast and keeps most other rows out of the shuffle of the join that
    follows; that join decides.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << BITS))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    words = needed.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("mask"))
    near = rows.withColumn("p", place).withColumn("word", F.floor(F.col("p") / 64)).join(F.broadcast(words), "word")
    return near.where(F.col("mask").bitwiseAND(bit) != 0).drop("p", "word", "mask")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: id, n_shingles, component_id, kept."""
    with small_batches(documents.sparkSession, ROWS):
        base, classes, merged = linked_classes(documents.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")), shingle, percent)
    of_class = classes.select("key", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    out = base.select("id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    whole = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))


def linked_classes(texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (rep, text): rows with their class's key, the classes, and (node, root) of those with links."""
    scratch = Scratch(texts.sparkSession, "near-dups")
    base = scratch.keep(sketches(texts, "rep", "text", shingle), "base")
    able = base.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    # copies fold before the shuffle; the smallest id holds the class
    classes = scratch.keep(able.groupBy("key").agg(F.min(F.struct(F.col("id").alias("rep"), "n", "sketch")).alias("c")).select("key", "c.*"), "classes")
    repeated = not able.groupBy("id").count().where("count > 1").isEmpty()

    # what is known of a bucket is aggregated, written and joined back, so that a hot one is split
    buckets = scratch.keep(bands(classes).groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    shared = scratch.keep(among(bands(classes), buckets, "bucket").join(buckets, "bucket"), "shared")
    company = scratch.keep(shared.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("company")), "company")
    known = scratch.keep(shared.join(company, "rep").select("bucket", "rep", "n", "company"), "known")
    best = F.max(F.struct("company", (-F.col("rep")).alias("id"), "n")).alias("h")
    hubs = scratch.keep(known.groupBy("bucket").agg(best).select("bucket", (-F.col("h.id")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    groups = scratch.keep(known.join(hubs, "bucket").select("hub", "hub_n", "rep", "n").distinct(), "groups")
    scratch.drop("shared", "buckets", "company", "known", "hubs")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def texts_of(needed: DataFrame) -> DataFrame:
        own = among(texts, needed)
        return own.dropDuplicates(["rep", "text"]) if repeated else own

    def links(pairs: DataFrame, name: str) -> DataFrame:
        found = scratch.keep(likely(pairs, classes, percent), f"{name}-likely")
        needed = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep")))
        return scratch.keep(confirmed(found, texts_of(needed), shingle, percent), name)

    stars = groups.where((F.col("hub") != F.col("rep")) & fits(F.col("hub_n"), F.col("n"))).select(*pair("hub", "rep")).distinct()
    first = links(stars, "first")
    roots = scratch.keep(components(first, scratch, "one"), "roots")

    # groups that still hold several components
    placed = groups.select("hub", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", "n", F.coalesce("root", "rep").alias("c"))
    of_group = placed.groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1 and size > 2").select("hub", "size", "shingles")
    # written first: a join of two plain exchanges, so that a large group is split
    mixed = scratch.keep(placed.join(scratch.keep(of_group, "mixed-groups"), "hub"), "mixed")
    few, many = mixed.where(F.col("size") <= SMALL), mixed.where(F.col("size") > SMALL)
    x = few.select("hub", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    y = few.select("hub", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"))
    cross = x.join(y, "hub").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (F.col("hub") != F.col("x")) & (F.col("hub") != F.col("y")) & fits(F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    second = links(cross, "second")

    # a large group in blocks; what is outside its largest component is held against each of them
    parts = scratch.keep(many.groupBy("hub", "c").agg(F.count("*").alias("m")), "parts")
    largest = scratch.keep(parts.groupBy("hub").agg(F.max(F.struct("m", "c")).alias("x"), F.ceil((F.sum("m") - F.max("m")) / ASKED).alias("turns")).select("hub", F.col("x.c").alias("most"), "turns"), "largest")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / LONG))
    cut = scratch.keep(many.join(largest, "hub").withColumn("blocks", blocks).join(classes.select("rep", "sketch"), "rep"), "cut")
    rows = ["rep", "c", "n", "sketch"]
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = F.xxhash64("hub", "nth", "turn").alias("block")
    held = cut.select("hub", *rows, F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("nth"), upto("turns").alias("turn")).select(place, F.lit(False).alias("asked"), *rows)
    asked = cut.where("c <> most").select("hub", *rows, F.pmod(F.xxhash64("rep", F.lit("asked")), F.col("turns")).alias("turn"), upto("blocks").alias("nth")).select(place, F.lit(True).alias("asked"), *rows)
    met = scratch.keep(against(held.unionByName(asked), "block", lambda t: outlook(t, percent), "block long, asked boolean, rep long, c long"), "met")
    whole = met.join(texts_of(met), "rep").select("block", "asked", "rep", "c", "text")
    third = scratch.keep(against(whole, "block", lambda t: joining(t, shingle, percent), "a long, b long"), "third")
    merged = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second).unionByName(third), scratch, "two")
    return base, classes, scratch.keep(merged, "merged")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (
  WITH RECURSIVE r(a, b) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.a, r.b FROM r JOIN g ON g.b = r.a WHERE r.b < g.a)
  SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(least(c.root, s.doc_id), s.doc_id) AS component_id,
       coalesce(c.root, s.doc_id) >= s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a
"""
