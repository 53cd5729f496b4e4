"""Token counts that follow edits: a kept tree of pre-token counts for each document, re-encoded only where an edit reaches."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import col, fresh, ship, stored

#: Pre-tokens in a leaf; a leaf that grows to twice as many becomes a tree of its own.
LEAF = 128
#: What the production query inserts.
INSERTS = ("", " token", "\n\n", "42", "'s own ", "  ")
#: Binary columns of a kept tree, by the names of CountTree's parts.
PARTS = ("shape", "sums", "ends", "lens", "counts")


class Counter:
    """Token counts of pre-tokens under a byte-level BPE rank file."""

    MEMO = 500_000

    def __init__(self, path: str):
        import base64

        import public_tokenizers as P
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(P.PATTERN)
        self.memo: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        for p in set(pieces).difference(memo):
            memo[p] = len(self.enc._encode_single_piece(p)) if len(p.encode()) > 1 else 1
        return list(map(memo.__getitem__, pieces))

    def full(self, text: str) -> int:
        return len(self.enc.encode_ordinary(text))


def _pack(numbers: list[int]) -> bytes:
    """Numbers in the fewest bytes each that hold the largest; the first byte tells how many."""
    top = max(numbers, default=0)
    kind, size = ("B", 1) if top < 1 << 8 else ("H", 2) if top < 1 << 16 else ("I", 4)
    return bytes([size]) + array(kind, numbers).tobytes()


def _unpack(raw: bytes, first: int = 0, last: int | None = None) -> list[int]:
    size = raw[0]
    return memoryview(raw)[1 + first * size : None if last is None else 1 + last * size].cast({1: "B", 2: "H", 4: "I"}[size]).tolist()


class CountTree:
    """Leaves of pre-tokens (their lengths and token counts) below nodes that hold sums of characters and tokens.

    Node i has four numbers in shape: parent, left, right, leaf (-1 for none), and two in sums: characters, tokens. An edit
    changes the leaves that it reaches and the sums on the paths above them; a leaf that grows too long gets nodes of its
    own below it. Only when such growth has doubled the nodes is the tree laid out anew. Leaves are unpacked when they are
    reached. ends: where each leaf's pre-tokens end in the packed lens and counts.
    """

    def __init__(self, lens: list[int], counts: list[int]):
        self.encoded = self.touched = 0
        self._lay([(lens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lens), LEAF)] or [([], [])])

    @classmethod
    def of(cls, counter: Counter, text: str) -> CountTree:
        p = counter.pieces(text)
        return cls([len(x) for x in p], counter.counts(p))

    @classmethod
    def load(cls, shape: bytes, sums: bytes, ends: bytes, lens: bytes, counts: bytes) -> CountTree:
        t = cls.__new__(cls)
        t.encoded = t.touched = 0
        t.shape, t.sums = array("i", shape), array("q", sums)
        t.packed = (_unpack(ends), lens, counts)
        t.leaves = [None] * len(t.packed[0])
        t.laid = len(t.sums) // 2
        return t

    def dump(self) -> tuple[bytes, ...]:
        """The parts that load takes; leaves are numbered anew in order of the text."""
        lens, counts, ends, shape = [], [], [], array("i", self.shape)
        for n, node in enumerate(self._in_order()):
            a, b = self._leaf(node)
            lens += a
            counts += b
            ends.append(len(lens))
            shape[4 * node + 3] = n
        return shape.tobytes(), self.sums.tobytes(), _pack(ends), _pack(lens), _pack(counts)

    def _lay(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.shape, self.sums, self.leaves, self.packed = array("i"), array("q"), leaves, None
        self._grow(-1, 0, len(leaves))
        self.laid = len(self.sums) // 2

    def _grow(self, parent: int, first: int, last: int, at: int | None = None) -> int:
        """A balanced tree over leaves first to last below parent, its top in place of node `at` if given; its number."""
        node = at
        if node is None:
            node = len(self.sums) // 2
            self.shape.extend((parent, -1, -1, -1))
            self.sums.extend((0, 0))
        if last - first == 1:
            lens, counts = self.leaves[first]
            self.shape[4 * node + 3] = first
            self.sums[2 * node], self.sums[2 * node + 1] = sum(lens), sum(counts)
            return node
        middle = (first + last) // 2
        a, b = self._grow(node, first, middle), self._grow(node, middle, last)
        self.shape[4 * node + 1], self.shape[4 * node + 2], self.shape[4 * node + 3] = a, b, -1
        for k in (0, 1):
            self.sums[2 * node + k] = self.sums[2 * a + k] + self.sums[2 * b + k]
        return node

    def _in_order(self) -> Iterator[int]:
        todo = [0]
        while todo:
            i = todo.pop()
            if self.shape[4 * i + 3] >= 0:
                yield i
            else:
                todo += (self.shape[4 * i + 2], self.shape[4 * i + 1])

    def _leaf(self, node: int) -> tuple[list[int], list[int]]:
        i = self.shape[4 * node + 3]
        if self.leaves[i] is None:
            ends, lens, counts = self.packed
            first = ends[i - 1] if i else 0
            self.leaves[i] = (_unpack(lens, first, ends[i]), _unpack(counts, first, ends[i]))
            self.touched += 1
        return self.leaves[i]

    def _put(self, node: int, lens: list[int], counts: list[int]) -> None:
        """New contents of a leaf; the sums above follow."""
        before = self.sums[2 * node], self.sums[2 * node + 1]
        if len(lens) <= 2 * LEAF:
            self.leaves[self.shape[4 * node + 3]] = (lens, counts)
            self.sums[2 * node], self.sums[2 * node + 1] = sum(lens), sum(counts)
        else:
            self._leaf(node)
            first = len(self.leaves)
            self.leaves += [(lens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lens), LEAF)]
            self._grow(self.shape[4 * node], first, len(self.leaves), node)
        more = self.sums[2 * node] - before[0], self.sums[2 * node + 1] - before[1]
        node = self.shape[4 * node]
        while node >= 0:
            self.sums[2 * node] += more[0]
            self.sums[2 * node + 1] += more[1]
            node = self.shape[4 * node]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def chars(self) -> int:
        return self.sums[0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf node that holds character `at` (the last one, beyond the end), and where the leaf begins."""
        i, start = 0, 0
        while self.shape[4 * i + 3] < 0:
            left, right = self.shape[4 * i + 1], self.shape[4 * i + 2]
            if at < start + self.sums[2 * left]:
                i = left
            else:
                start += self.sums[2 * left]
                i = right
        return i, start

    def _beside(self, node: int, right: bool) -> int:
        """The next leaf node to the right or left, or -1."""
        near, far = (2, 1) if right else (1, 2)
        up = self.shape[4 * node]
        while up >= 0 and self.shape[4 * up + near] == node:
            node, up = up, self.shape[4 * up]
        if up < 0:
            return -1
        node = self.shape[4 * up + near]
        while self.shape[4 * node + 3] < 0:
            node = self.shape[4 * node + far]
        return node

    def edit(self, c: Counter, text: str, start: int, end: int, new: str) -> str:
        """Replace characters [start, end) of text, the tree's, by new; gives the text afterwards.

        Boundaries before the edit hold up to one pre-token before the one it touches, as the pattern looks one character
        ahead; reading goes on behind the edit until a boundary falls where there was one before: from there on all hold.
        """
        old = len(text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        shift = len(new) - (end - start)
        text = text[:start] + new + text[end:]
        node, at = self.find(max(start - 1, 0))
        k, lens = 0, self._leaf(node)[0]
        while k < len(lens) and at + lens[k] < start:
            at += lens[k]
            k += 1
        for _ in range(2):  # boundary context: two pre-tokens more
            while not k and (left := self._beside(node, False)) >= 0:
                node = left
                k = len(self._leaf(node)[0])
            if k:
                k -= 1
                at -= self._leaf(node)[0][k]
        first, first_k = node, k
        new_lens, new_pieces, gone = [], [], []
        last, last_k, edge = first, first_k, at  # the next old pre-token not yet replaced, and where it begins in the old text
        pos, synced = at, False
        for m in c.pattern.finditer(text, at):
            new_pieces.append(m.group())
            new_lens.append(m.end() - m.start())
            pos = m.end()
            while edge < old and (edge < end or edge + shift < pos):
                while last_k >= len(self._leaf(last)[0]):
                    last, last_k = self._beside(last, True), 0
                    gone.append(last)
                edge += self._leaf(last)[0][last_k]
                last_k += 1
            if edge + shift == pos and edge >= end and pos > start + len(new):
                synced = True
                break
        while not synced and (beside := self._beside(last, True)) >= 0:  # read to the end: nothing old is left behind the edit
            last, last_k = beside, 0
            gone.append(last)
        tail = self._leaf(last) if synced else ([], [])
        counts = c.counts(new_pieces)
        self.encoded += len(new_pieces)
        head, rest = self._leaf(first), last_k if synced else 0
        merged = (head[0][:first_k] + new_lens + tail[0][rest:], head[1][:first_k] + counts + tail[1][rest:])
        for g in gone:
            self._put(g, [], [])
        self._put(first, *merged)
        if len(self.sums) // 2 > 2 * self.laid + 64:
            leaves = [self._leaf(i) for i in self._in_order()]
            full = CountTree([x for a, _ in leaves for x in a], [x for _, b in leaves for x in b])
            self.shape, self.sums, self.leaves, self.packed, self.laid = full.shape, full.sums, full.leaves, None, full.laid
        return text


def sample_edits(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3) -> DataFrame:
    """df with edits array<struct<start, end, new>>: n edits a row at places that a hash of the id gives."""
    length = F.length(F.coalesce(col(text_col), F.lit("")))

    def one(i: int) -> Column:
        h = F.xxhash64(col(id_col), F.lit(i))
        start = F.pmod(h, length + 1).cast("int")
        end = F.least(start + F.pmod(F.shiftright(h, 20), F.lit(24)).cast("int"), length)
        new = F.element_at(F.array(*[F.lit(x) for x in INSERTS]), (F.pmod(F.shiftright(h, 40), F.lit(len(INSERTS))) + 1).cast("int"))
        return F.struct(start.alias("start"), end.alias("end"), new.alias("new"))

    return df.withColumn("edits", F.array(*[one(i) for i in range(n)]))


def build_trees(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, n_tokens, shape, sums, ends, lens, counts): each row's text and its tree, stored. Null text is empty.

    This is the only time that whole texts are encoded. A pre-token takes two bytes in most trees.
    """
    ship(df.sparkSession)
    d = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(path)
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                trees = [CountTree.of(c, t.as_py()) for t in b.column(1)]
                parts = list(zip(*[t.dump() for t in trees], strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.total for t in trees], pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], ["id", "text", "n_tokens", *PARTS])

    schema = StructType([d.schema["id"], StructField("text", StringType()), StructField("n_tokens", LongType()), *[StructField(p, BinaryType()) for p in PARTS]])
    return stored(d.mapInArrow(run, schema), "token-trees")


def apply_edits(trees: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """Rows of build_trees with a column edits: n_edits, n_tokens_edited, n_pieces_encoded, n_leaves_read added; edits gone.

    text, n_tokens and the tree are those after the edits (keep) or left out but for n_tokens, the count before. Edits apply
    one after another, each to the text that the one before left; places beyond a text's end are moved to it; null places
    are 0, a null text to insert is empty, null edits are none. Only the leaves that edits reach are unpacked, and only
    the pre-tokens there are encoded: a few for each edit, however long the text.
    """
    ship(trees.sparkSession)
    d = trees.select("id", "text", "n_tokens", *PARTS, "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(path)
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                texts, edited, facts = [], [], []
                for text, edits, *parts in zip(b.column(1).to_pylist(), b.column(8).to_pylist(), *[b.column(i).to_pylist() for i in range(3, 8)], strict=True):
                    tree = CountTree.load(*parts)
                    for e in edits or []:
                        text = tree.edit(c, text, e["start"] or 0, e["end"] or 0, e["new"] or "")
                    facts.append((len(edits or []), tree.total, tree.encoded, tree.touched))
                    if keep:
                        texts.append(text)
                        edited.append(tree.dump())
                more = [pa.array(x, pa.int64()) for x in zip(*facts, strict=True)]
                if keep:
                    more = [pa.array(texts, pa.string()), more[1], *[pa.array(p, pa.binary()) for p in zip(*edited, strict=True)], *more]
                    names = ["id", "text", "n_tokens", *PARTS, *FACTS]
                else:
                    more, names = [b.column(2), *more], ["id", "n_tokens", *FACTS]
                yield pa.RecordBatch.from_arrays([b.column(0), *more], names)

    facts = [StructField(f, LongType()) for f in FACTS]
    own = [f for f in d.schema.fields if f.name != "edits" and (keep or f.name in ("id", "n_tokens"))]
    return d.mapInArrow(run, StructType([*own, *facts]))


FACTS = ("n_edits", "n_tokens_edited", "n_pieces_encoded", "n_leaves_read")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits (id, place, start, end, new) of their ids, in order of place; trees without any keep null edits."""
    by_id = edits.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "new"))).alias("e"))
    by_id = by_id.select("of", F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["new"].alias("new"))).alias("edits"))
    return trees.join(by_id, F.col("id").eqNullSafe(F.col("of")), "left").drop("of")


def count_edited(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_edited, n_pieces_encoded, n_leaves_read) for each row of df and its edits.

    The trees are built and stored with the edits beside them, then the edits are applied to the kept trees. Null text is
    empty; null edits are none; repeated rows are each counted; an empty table gives an empty one; other columns do not matter.
    """
    edits, names = col(edits_col), fresh([id_col], *FACTS, "n_tokens")
    both = F.struct(col(id_col).alias("id"), edits.alias("edits")).alias("both")
    trees = build_trees(df.select(both, col(text_col).alias("text")), path, "text", "both")
    out = apply_edits(trees.select(F.col("id.id").alias("id"), "text", "n_tokens", *PARTS, F.col("id.edits").alias("edits")), path, keep=False)
    return out.select(F.col("id").alias(id_col), F.col("n_tokens").alias(names[-1]), *[F.col(f).alias(n) for f, n in zip(FACTS, names, strict=False)])
