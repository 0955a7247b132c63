"""Exact Jaccard join of word-shingle sets, and the groups its links make.

Two documents link when 100 * |A & B| >= 80 * |A | B| over their distinct 5-word shingles (64-bit hashes of words with
A-Z lowered; a shorter text is one shingle). No link between different sets is lost:

1. Equal sets fall together by two 64-bit sums of their hashes; one representative of each goes on.
2. Shingles found in many documents of a slice of the table are put last in a common order (a bounded list; it only
   sets the order, so it cannot lose anything). Sets that link must share one of their first n - ceil(0.8 n) + 1
   shingles; these are the keys of the tiles.
3. First round: every member of a tile is compared with its tile's smallest member only. Pairs pass by size band, then
   by bitmap: |A & B| <= n_A - bits in A and not in B, and the same for B. What passes is verified on sorted arrays of
   both whole sets, and components of the links are found.
4. Second round: in tiles that still hold more than one component, all pairs of different components not yet compared
   are tested by size and bitmap. The largest component of a tile is never compared with itself, and both it and the rest
   are dealt to blocks of BLOCK rows, so that no task holds a whole hot tile. A pair that met in a smaller key is left to
   that key's tile, as far as the LEAST smallest keys of both rows tell. What passes leaves no row a pair: the documents
   that have a pair are cut into parts of PART, and a pair of parts with their texts is one task's group, which compares
   the whole sets and returns no more links than join the components.

Null and empty texts, and texts without words, have n_shingles 0 and are their own component. A null doc_id is linked
with nothing and has a null component. Rows that repeat a doc_id are one document: their links add up; each row is
returned. Ties cannot arise. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, table, tidy
from .components import components
from .hashing import mix, sets_of

SIZE = 5
PERCENT = 80
BLOCK = 1024
PART = 64
LEAST = 8
FLIP = -(1 << 63)  # turns the order of signed numbers into that of unsigned ones, in which prefixes are chosen
HOT_ROWS = 1 << 17
SLICE = 512
MIN_BITS, MAX_BITS = 256, 65_536


def need(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any partner: ceil(PERCENT * n / 100)."""
    return (PERCENT * n + 99) // 100


def need_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap that sets of a and b must have: 100 * x >= PERCENT * (a + b - x)."""
    return -(-(PERCENT * (a + b)) // (100 + PERCENT))


def _rows(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, k1, k2 (the set's sums) of every row; kind 1: shingle k1 found in n rows of a slice."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                values, off = sets_of(part.column(1), SIZE)
                ends = np.r_[np.zeros(1, np.uint64), np.cumsum(values)]
                again = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
                n = np.diff(off)
                k1, k2 = ((s[off[1:]] - s[off[:-1]]).view(np.int64) for s in (ends, again))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n)), pa.int32()), part.column(0), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2)], ["kind", "doc_id", "n", "k1", "k2"])
                v, c = np.unique(values, return_counts=True)
                v, c = v[c >= 8], c[c >= 8]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(v)), pa.int32()), pa.nulls(len(v), pa.int64()), pa.array(c, pa.int64()), pa.array(v.view(np.int64)), pa.array(np.zeros(len(v)), pa.int64())], ["kind", "doc_id", "n", "k1", "k2"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "kind int, doc_id long, n long, k1 long, k2 long")


def bits_for(n: np.ndarray) -> np.ndarray:
    """Bitmap width of a set: the power of two from 2 * n on, within limits."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), MIN_BITS, MAX_BITS)


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, n, the set's prefix in the common order, and its bitmap, of every row with shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_ROWS numbers, ascending

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                values, off = sets_of(part.column(1), SIZE)
                n, row = np.diff(off), _rows(values, off)
                last = np.isin(values, hot) if len(hot) else np.zeros(len(values), bool)
                order = np.lexsort((values, last, row))
                place = np.arange(len(values)) - off[row]
                ordered = values[order]
                take = place < (n - need(n) + 1)[row]
                picked, count = ordered[take].view(np.int64), np.bincount(row[take], minlength=len(n))
                width = bits_for(n)
                bit = (values >> np.uint64(40)).astype(np.int64) & (width - 1)[row]
                base = np.r_[0, np.cumsum(width // 8)]
                bytes_ = np.zeros(base[-1], dtype=np.uint8)
                np.bitwise_or.at(bytes_, base[row] + bit // 8, (1 << (bit % 8)).astype(np.uint8))
                bitmaps = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(bytes_)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(picked))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists, bitmaps], ["doc_id", "n", "prefix", "bitmap"])
                yield out.filter(pa.array((n > 0) & ~np.asarray(part.column(0).is_null())))

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, prefix array<long>, bitmap binary")


def folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words of one width; wider ones are folded by OR."""
    out = np.zeros((len(bitmaps), width // 64), dtype=np.uint64)
    for i, b in enumerate(bitmaps):
        w = np.frombuffer(b, dtype=np.uint64)
        out[i] = np.bitwise_or.reduce(w.reshape(-1, width // 64), axis=0)
    return out


def may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether size and bit counts allow a link; a and b are bitmap words of one width, last axis the words."""
    least = need_both(na, nb)
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return (np.minimum(na, nb) >= least) & (na - only_a >= least) & (nb - only_b >= least)


def _filter_pairs(batches: Iterator) -> Iterator:
    """Pairs with both sizes and bitmaps in, pairs that may link out."""
    import pyarrow as pa

    for batch in batches:
        na, nb = (np.asarray(batch.column(k)) for k in (2, 4))
        ba, bb = (batch.column(k).to_pylist() for k in (3, 5))
        keep = np.zeros(batch.num_rows, dtype=bool)
        width = np.minimum(bits_for(na), bits_for(nb))
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            keep[at] = may_link(na[at], folded([ba[i] for i in at], w), nb[at], folded([bb[i] for i in at], w))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _verify(batches: Iterator) -> Iterator:
    """Links among pairs that come with both texts."""
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            (va, oa), (vb, ob) = sets_of(part.column(2), SIZE), sets_of(part.column(3), SIZE)
            na, nb = np.diff(oa), np.diff(ob)
            both, at = np.r_[va, vb], np.r_[_rows(va, oa), _rows(vb, ob)]
            order = np.lexsort((both, at))
            both, at = both[order], at[order]
            twice = np.flatnonzero((both[1:] == both[:-1]) & (at[1:] == at[:-1])) if len(both) else np.zeros(0, np.int64)
            shared = np.bincount(at[twice], minlength=part.num_rows)
            keep = (shared > 0) & (100 * shared >= PERCENT * (na + nb - shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))


def near_pairs(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b) that size and bit counts allow."""
    side = lambda x: signs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ma", "nb", "mb").mapInArrow(tidy(_filter_pairs), "a long, b long")


def verified(near: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a, b), by both whole sets."""
    near = materialise(docs.sparkSession, near, "near-pairs")
    text = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(tidy(_verify), "a long, b long").distinct()


def _first_met(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no key below this one is among both rows' least keys; if one is, the pair meets in that key's tile too."""
    met = np.zeros(len(a), dtype=bool)
    for k in range(a.shape[1]):
        met |= (a[:, k] < key) & (a[:, k, None] == b).any(axis=1)
    return ~met


def _tile_parts(batches: Iterator) -> Iterator:
    """Documents to compare by whole sets, from tiles that arrive sorted by (key, x, y): of each tile those with a pair of
    different components that may link and met in no smaller key, cut into parts p of PART; each pair of parts (p, q)
    with such a pair gets the documents that have one."""
    import pandas as pd
    import pyarrow as pa

    names = ["key", "x", "y", "p", "q", "part", "doc", "component"]

    def pairs(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        key, x, y = (int(tile[c].iloc[0]) for c in ("key", "x", "y"))
        n, comp, block = (tile[c].to_numpy() for c in ("n", "component", "block"))
        a = np.flatnonzero(block == x)
        b = a if x == y else np.flatnonzero(block == y)
        maps, least = tile["bitmap"].tolist(), None
        out_a, out_b = [], []
        # size bands: by width of bitmap, rows against the rows of their own and the next width
        width = bits_for(n)
        for w in np.unique(width):
            for v in (w, 2 * w):
                for p, q, wp, wq in ((a, b, w, v), (a, b, v, w)) if v != w else ((a, b, w, w),):
                    p, q = p[width[p] == wp], q[width[q] == wq]
                    if not len(p) or not len(q):
                        continue
                    mp, mq = folded([maps[i] for i in p], w), folded([maps[i] for i in q], w)
                    step = max(1, (1 << 22) // (len(q) * int(w) // 64))  # 32 MB of words at once
                    for k in range(0, len(p), step):
                        ok = may_link(n[p[k : k + step], None], mp[k : k + step, None], n[None, q], mq[None]) & (comp[p[k : k + step], None] != comp[None, q])
                        i, j = np.nonzero(ok)
                        if not len(i):
                            continue
                        if least is None:
                            least = np.full((len(tile), LEAST), np.iinfo(np.int64).max)  # no key is above it
                            for row, keys in zip(least, tile["least"], strict=True):
                                row[: len(keys)] = keys
                        i, j = p[k + i], q[j]
                        for c in range(0, len(i), 1 << 16):
                            ic, jc = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                            first = _first_met(key ^ FLIP, least[ic], least[jc])
                            out_a.append(ic[first])
                            out_b.append(jc[first])
        z = np.zeros(0, dtype=np.int64)
        return np.concatenate([z, *out_a]), np.concatenate([z, *out_b])

    def parts(tile: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        doc, x, y = tile["doc"].to_numpy(), int(tile["x"].iloc[0]), int(tile["y"].iloc[0])
        docs_a, at = np.unique(doc[np.r_[a, b] if x == y else a], return_index=True)
        docs_b, bt = (docs_a[:0], at[:0]) if x == y else np.unique(doc[b], return_index=True)
        ids, row = np.r_[docs_a, docs_b], np.r_[(np.r_[a, b] if x == y else a)[at], b[bt]]
        part = np.r_[np.arange(len(docs_a)) // PART, -(-len(docs_a) // PART) + np.arange(len(docs_b)) // PART]
        i = np.searchsorted(docs_a, doc[a])
        j = np.searchsorted(docs_a, doc[b]) if x == y else len(docs_a) + np.searchsorted(docs_b, doc[b])
        pq = np.minimum(part[i], part[j]) * (part[-1] + 1) + np.maximum(part[i], part[j])
        cells = np.unique(np.r_[pq * len(ids) + i, pq * len(ids) + j])
        pq, at = cells // len(ids), cells % len(ids)
        fixed = [np.full(len(cells), tile[c].iloc[0]) for c in ("key", "x", "y")]
        return [*fixed, *(c.astype(np.int32) for c in (pq // (part[-1] + 1), pq % (part[-1] + 1), part[at])), ids[at], tile["component"].to_numpy()[row[at]]]

    held: list[pd.DataFrame] = []

    def flush(tiles: pd.DataFrame):
        for _, tile in tiles.groupby(["key", "x", "y"], sort=False):
            if tile["component"].nunique() > 1:
                a, b = pairs(tile)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts(tile, a, b)], names)

    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        whole = pd.concat(held) if len(held) > 1 else frame
        last = whole.iloc[-1]
        open_ = ((whole["key"] == last["key"]) & (whole["x"] == last["x"]) & (whole["y"] == last["y"])).to_numpy()
        yield from flush(whole[~open_])
        held = [whole[open_]]
    if held:
        yield from flush(pd.concat(held))


def spanning_links(values: list[np.ndarray], doc: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of rows left with rows right (ascending values, whole sets) that join different components, no more than it
    takes to join them."""
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    if len(left) > len(right):
        left, right = right, left
    n = np.array([len(v) for v in values])
    off = np.r_[0, np.cumsum(n[right])]
    every, code = np.unique(np.concatenate([values[j] for j in right]), return_inverse=True)
    out = []
    for i in left:
        at = np.searchsorted(every, values[i])
        at = at[every[np.minimum(at, len(every) - 1)] == values[i]] if len(every) else at[:0]
        found = np.zeros(len(every), dtype=bool)
        found[at] = True
        ends = np.r_[0, np.cumsum(found[code])]
        shared = ends[off[1:]] - ends[off[:-1]]
        for j in right[(shared > 0) & (100 * shared >= PERCENT * (n[i] + n[right] - shared))]:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j]))))
    return out


def _part_links(batches: Iterator) -> Iterator:
    """Links that join components, from pairs of parts with texts that arrive sorted by (key, x, y, p, q)."""
    import pyarrow as pa

    held: list[tuple] = []  # of the pair of parts that is open: p, q, part, doc, component, set
    found: list[tuple[int, int]] = []
    name = None

    def close() -> None:
        p, q, part, doc, comp = (np.array(c) for c in list(zip(*held, strict=True))[:5])
        found.extend(spanning_links([h[5] for h in held], doc, comp, np.flatnonzero(part == p[0]), np.flatnonzero(part == q[0])))
        held.clear()

    def links() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found.clear()
        return out

    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            cut = batch.slice(lo, SLICE)
            values, off = sets_of(cut.column(8), SIZE)
            for k, row in enumerate(zip(*(cut.column(c).to_pylist() for c in range(8)), strict=True)):
                if held and row[:5] != name:
                    close()
                name = row[:5]
                held.append((*row[3:], values[off[k] : off[k + 1]].copy()))
        yield links()
    if held:
        close()
        yield links()


def residual_parts(keys: DataFrame, signs: DataFrame, comps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of tiles, the tile's smallest member left out, that hold pairs of different components that may link."""
    named = keys.filter(F.col("doc") != F.col("pivot")).join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    named = materialise(keys.sparkSession, named, "tile-rows")
    per = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    tiles = per.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("rows"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("main_rows")).filter("kinds > 1")
    n_minor, n_main = F.expr(f"cast(ceil((rows - main_rows) / {block}) as int)"), F.expr(f"cast(ceil(main_rows / {block}) as int)")
    tiles = tiles.select("key", "main", n_minor.alias("n_minor"), n_main.alias("n_main"))
    rows = named.join(tiles, "key").withColumn("is_main", F.col("component") == F.col("main"))
    spot = F.when(F.col("is_main"), F.col("n_minor") + F.pmod(F.xxhash64("doc"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("n_minor"))).cast("int")
    told = signs.select(F.col("doc_id").alias("doc"), "n", "bitmap", F.slice(F.sort_array(F.transform("prefix", lambda k: k.bitwiseXOR(F.lit(FLIP)))), 1, LEAST).alias("least"))
    rows = rows.withColumn("block", spot).join(told, "doc")
    others = F.expr("explode(transform(sequence(0, if(is_main, n_minor - 1, n_minor + n_main - 1)), o -> struct(least(o, block) as x, greatest(o, block) as y)))")
    dealt = rows.select("key", "doc", "n", "component", "block", "bitmap", "least", others.alias("t")).select("key", "t.x", "t.y", "doc", "n", "component", "block", "bitmap", "least")
    tiles = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return tiles.mapInArrow(tidy(_tile_parts), "key long, x int, y int, p int, q int, part int, doc long, component long")


def part_links(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """The links that join components within pairs of parts, by whole sets."""
    parts = materialise(docs.sparkSession, parts, "tile-parts")
    unit = ["key", "x", "y", "p", "q"]
    rows = parts.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").select(*unit, "part", "doc", "component", "text")
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(tidy(_part_links), "a long, b long").distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    told = materialise(spark, describe(docs), "shingle-sums")
    sets, seen = told.filter("kind = 0"), told.filter("kind = 1")
    hot_rows = seen.groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(HOT_ROWS).toPandas()  # HOT_ROWS numbers
    hot = np.sort(hot_rows["k1"].to_numpy(dtype=np.int64).view(np.uint64))
    live = sets.filter("n > 0 and doc_id is not null")
    same = materialise(spark, live.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "set-classes")
    reps = same.select(F.col("rep").alias("doc_id")).distinct()
    signs = materialise(spark, prefixes(docs, hot).join(reps, "doc_id", "left_semi"), "set-signs")

    each = signs.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("doc"))
    tiles = each.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top")).filter("pivot <> top").drop("top")
    keys = materialise(spark, each.join(tiles, "key").select("key", "doc", "pivot"), "tile-keys")
    stars = keys.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    first = materialise(spark, verified(near_pairs(stars, signs), docs), "links")
    comps = components(first, "a", "b")
    second = part_links(residual_parts(keys, signs, comps), docs)
    # a row's set class may stand for another doc_id (equal sets), and a doc_id may have several sets
    members = live.join(same, ["k1", "k2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = first.unionByName(second).unionByName(members.filter("a <> b"))
    final = components(links, "a", "b")
    out = sets.join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, all columns kept; null ids stay."""
    groups = similar_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone__")).distinct()
    return docs.join(groups, F.col("doc_id") == F.col("gone__"), "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(list_slice(words, i + 1, i + 5), ' ')) END) AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, hash(unnest(grams)) AS gram FROM s),
rare AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared
      FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id WHERE a.gram IN (SELECT gram FROM rare)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n),
link AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (total - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.grams
"""
