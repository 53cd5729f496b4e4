"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, quoted, ship, stored, without

#: Words in a shingle, the least Jaccard similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8, 0.999999 at 0.86,
#: and 0.02 at 0.3, so passages that many documents share cost little.
BANDS, ROWS = 26, 6
#: A bucket is split into blocks of an eighth of its members, but of no fewer than the first and no more than the second
#: number; a task holds two blocks. Large blocks send a text to fewer tasks, small ones spread a bucket over more.
BLOCKS = (256, 2048)
#: Up to this many fingerprints (16 bytes each) of texts with a pair to verify are broadcast to find the texts; more are shuffled.
BROADCAST_TEXTS = 500_000


class Shingler:
    """Hashes of the shingles of a text: words are separated by ASCII white space; fewer than WORDS words are one shingle."""

    MEMO = 1_000_000

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str):
        import numpy as np
        import xxhash

        memo, w = self.memo, text.encode().split()
        if not w:
            return None
        if len(memo) > self.MEMO:
            memo.clear()
        for x in set(w).difference(memo):
            memo[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        k = min(self.words, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return out


def multipliers(n: int):
    """n odd multipliers and n offsets of 32 bits, always the same."""
    import numpy as np

    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(shingles, a, b, bands: int = BANDS):
    """One 64-bit hash for each band, of the band's number and its minima."""
    import numpy as np

    s = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    buf = np.empty((len(a), min(len(s), 1024)), np.uint32)
    for i in range(0, len(s), 1024):
        part = s[i : i + 1024]
        x = buf[:, : len(part)]
        np.multiply(a[:, None], part[None, :], out=x)
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    rows = low.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows.shape[1]):
        out = (out ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Rows of sorted batches, grouped by the first columns; a list of rows (tuples) for each group."""
    now, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for r in zip(*cols, strict=True):
            if r[:keys] != now:
                if rows:
                    yield rows
                now, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield rows


def _first_matches(rows: list, bands_at: int, own_at: int):
    """Of a bucket's rows, the boolean matrix of pairs (i < j) that meet in no earlier band and, in a pair of blocks, are of different blocks."""
    import numpy as np

    key, lo, hi = rows[0][:3]
    m = np.array([r[bands_at] for r in rows], np.int64)
    t = int(np.flatnonzero(m[0] == key)[0])
    fresh = np.triu(np.ones((len(rows), len(rows)), bool), 1)
    if lo != hi:
        own = np.array([r[own_at] for r in rows])
        fresh &= own[:, None] != own[None, :]
    for e in range(t):
        fresh &= m[:, e][:, None] != m[:, e][None, :]
    return fresh


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, own, fp, n, bands) of members that have a pair to verify here."""
    out, schema = [], None

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=True)], ["key", "lo", "hi", "own", "fp", "n", "bands"])

    schema = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    for rows in _groups(batches, 3):
        if len(rows) == 2:
            x, y = rows
            key, a, b = x[0], x[6], y[6]
            if next(v for v, w in zip(a, b, strict=True) if v == w) == key and (x[1] == x[2] or x[3] != y[3]):
                out += rows
        elif len(rows) > 2:
            f = _first_matches(rows, 6, 3)
            out += [r for r, keep in zip(rows, f.any(0) | f.any(1), strict=True) if keep]
        if len(out) > 5000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _verify(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, links, texts, root): what each member of a bucket is linked to here, and the least member of its linked set."""
        import numpy as np

        shingler, out = Shingler(words), []

        def flush():
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["fp", "links", "texts", "root"])

        for rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            fresh = _first_matches(rows, 6, 3)
            sets = [np.unique(shingler(r[7])) for r in rows]
            sizes = np.array([len(s) for s in sets])
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            links, texts, up = [0] * len(rows), [0] * len(rows), list(range(len(rows)))

            def top(i, up=up):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for i in range(len(rows)):
                js = np.flatnonzero(fresh[i])
                if not len(js):
                    continue
                # A pair whose sizes alone rule the similarity out needs no look at its sets.
                js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-9]
                if not len(js):
                    continue
                own = ids[cuts[i] : cuts[i + 1]]
                mark[own] = 1
                if len(js) == 1:
                    inter = np.array([mark[ids[cuts[js[0]] : cuts[js[0] + 1]]].sum()])
                else:
                    inter = np.array([int(mark[ids[cuts[j] : cuts[j + 1]]].sum()) for j in js])
                mark[own] = 0
                good = js[inter >= similarity * (sizes[js] + sizes[i] - inter) - 1e-9]
                for j in good.tolist():
                    links[i] += rows[j][5]
                    links[j] += rows[i][5]
                    texts[i] += 1
                    texts[j] += 1
                    a, b = top(i), top(j)
                    if a != b:
                        a, b = (a, b) if rows[a][4] < rows[b][4] else (b, a)
                        up[b] = a
            out += [(rows[i][4], links[i], texts[i], rows[top(i)][4]) for i in range(len(rows)) if texts[i]]
            if len(out) > 5000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return run


#: A key of more than this share of all rows is heavy; there are no more such keys than one over it.
HEAVY = 0.001


def by_key(rows: DataFrame, key: str, counted: DataFrame, total: int) -> DataFrame:
    """rows joined on `key` to counted (x, c, ...), where c is the number of rows with key x and total of all rows.

    Heavy keys, 1 / HEAVY of them at most, are broadcast and their rows stay where they are; so no task gets all rows of a hot key.
    """
    heavy = F.col("c") > F.lit(HEAVY * total)
    hot = F.broadcast(counted.where(heavy))
    cold = rows.join(hot.select("x"), F.col(key) == F.col("x"), "left_anti").join(counted.where(~heavy), F.col(key) == F.col("x"))
    return rows.join(hot, F.col(key) == F.col("x")).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node of its component.

    Large-star and small-star rounds, each of sums by node and joins in which heavy nodes are broadcast, until the rows no longer change.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "links")
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        least = stored(least.select(F.col("u").alias("x"), F.least("m", "u").alias("m"), "c"), "least")
        large = by_key(both, "u", least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count("*").alias("c")), "least")
        small = by_key(large, "u", least, large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint(text: Column) -> Column:
    """128 bits that equal texts share; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """A row for each different text: fp, rep (least id), n_rep (rows of that id), n (rows), class_id, first (the text that stands for its class), links, texts."""
    import numpy as np  # noqa: F401

    ship(df.sparkSession)
    t = df.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"), fingerprint(col(text_col)).alias("fp"))
    a, b = multipliers(BANDS * ROWS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                x = whole.slice(start, 512)
                sh = [shingler(v.as_py()) for v in x.column("text")]
                bands = [None if s is None else band_hashes(s, a, b).tolist() for s in sh]
                yield pa.RecordBatch.from_arrays([x.column("id"), x.column("fp"), pa.array(bands, pa.list_(pa.int64()))], ["id", "fp", "bands"])

    signed = t.select(F.col("id").cast("long"), "fp", "text").mapInArrow(sign, "id long, fp binary, bands array<long>")
    by_id = signed.groupBy("fp", "id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    texts = by_id.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("rep"), F.sum("n").alias("n"), F.first("bands").alias("bands"))
    texts = stored(texts.select("fp", F.col("rep.id").alias("rep"), F.col("rep.n").alias("n_rep"), "n", "bands"), "texts")

    keys = texts.where(F.col("bands").isNotNull()).select("fp", F.explode("bands").alias("key"))
    full = stored(keys.groupBy(F.col("key").alias("x")).agg(F.count("*").alias("c")).where("c > 1"), "full")
    members = F.least(F.greatest(F.col("c") / 8, F.lit(BLOCKS[0])), F.lit(BLOCKS[1]))
    blocks = F.ceil(F.col("c") / members).cast("int")
    met = by_key(keys, "key", full, BANDS * texts.count()).select("key", "fp", blocks.alias("nb"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "own", "fp")
    met = met.join(texts.select("fp", "n", "bands"), "fp").select("key", "lo", "hi", "own", "fp", "n", "bands")
    shape = "key long, lo int, hi int, own int, fp binary, n long, bands array<long>"
    need = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_needed, shape)
    need = stored(need, "needed")

    # Texts without a pair to verify stay where they are.
    wanted = stored(need.select("fp").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_TEXTS
    bodies = t.join(F.broadcast(wanted) if few else wanted, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    pairs = need.join(bodies, "fp").select("key", "lo", "hi", "own", "fp", "n", "bands", "text")
    linked = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_verify(words, similarity), "fp binary, links long, texts long, root binary")
    linked = stored(linked, "linked")
    sums = linked.groupBy("fp").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    comp = components(linked.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    out = texts.drop("bands").join(comp.withColumnRenamed("node", "fp"), "fp", "left").join(sums, "fp", "left")
    worded = texts.select("fp", F.col("bands").isNotNull().alias("worded"))
    out = stored(out.join(worded, "fp").withColumn("root", F.coalesce("root", "fp")), "classes")
    heads = out.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "fp")).alias("h"))
    heads = heads.select(F.col("root").alias("r"), F.col("h.rep").alias("class_id"), F.col("h.fp").alias("head"))
    return out.join(heads, F.col("root") == F.col("r")).select(
        "fp", "rep", "n_rep", "n", "worded", "class_id", (F.col("fp") == F.col("head")).alias("first"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")
    )


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """df with class_id, n_links and n_linked_texts added (columns of these names are replaced).

    Two rows are linked if their texts are equal or the Jaccard similarity of their sets of shingles is at least
    `similarity`. class_id: the least id among the rows that chains of links reach; n_links: rows linked to this row;
    n_linked_texts: different other texts linked. Rows with null text or without words stand alone, class_id their own
    id. Repeated ids and rows are allowed; null ids come last and may give a null class_id. An empty table gives an empty
    one; other columns stay, whatever their names.

    Equal texts are one node from the start. Bands of equal hash are buckets; a bucket of many texts is split into
    pairs of blocks; a pair is verified only in the first band that it shares, and counted there, so pairs never become
    rows and nothing needs to be made distinct. Texts travel only to the buckets where they have a pair to verify.
    """
    added = ["class_id", "n_links", "n_linked_texts"]
    base = without(df, added)
    fp, cfp, cid, n, links, texts, worded = fresh([*df.columns, *added], "fp", "own_fp", "cid", "n", "links", "texts", "worded")
    c = text_classes(df, id_col, text_col, words, similarity)
    c = c.select(F.col("fp").alias(cfp), F.col("class_id").alias(cid), F.col("n").alias(n), F.col("links").alias(links), F.col("texts").alias(texts), F.col("worded").alias(worded))
    d = df.select(*[col(x) for x in base.columns], col(id_col).cast("long").alias(added[0]), fingerprint(col(text_col)).alias(fp)).join(c, F.col(fp) == F.col(cfp), "left")
    ok = F.coalesce(F.col(worded), F.lit(False))
    return d.select(
        *[col(x) for x in base.columns], F.when(ok, F.col(cid)).otherwise(F.col("class_id")).alias("class_id"),
        F.when(ok, F.col(links) + F.col(n) - 1).otherwise(0).cast("long").alias("n_links"), F.when(ok, F.col(texts)).otherwise(0).cast("long").alias("n_linked_texts"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """df with one row of each class of near copies: that of the least id (of its rows, one); rows without words all stay.

    Columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    fp, cfp, rep, n_rep, first, worded, row = fresh(df.columns, "fp", "own_fp", "rep", "n_rep", "first", "worded", "row")
    c = text_classes(df, id_col, text_col, words, similarity)
    c = c.select(F.col("fp").alias(cfp), F.col("rep").alias(rep), F.col("n_rep").alias(n_rep), F.col("first").alias(first), F.col("worded").alias(worded))
    d = df.withColumn(fp, fingerprint(col(text_col))).join(c, F.col(fp) == F.col(cfp), "left")
    own = [col(x) for x in df.columns]
    alone = ~F.coalesce(F.col(worded), F.lit(False))
    head = F.col(first) & col(id_col).cast("long").eqNullSafe(F.col(rep))
    single = d.where(alone | (head & (F.col(n_rep) == 1))).select(*own)
    many = d.where(~alone & head & (F.col(n_rep) > 1)).groupBy(fp).agg(F.first(F.struct(*own)).alias(row))
    return single.unionByName(many.select(*[F.col(f"{row}.{quoted(x)}").alias(x) for x in df.columns]))
