"""BPE encoding and decoding through a table of distinct words, joined back by position."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, shared_dir, ship, stored, without

#: Characters of the texts of a chunk; a longer text is a chunk by itself.
CHUNK_CHARS = 16_000_000
#: The ids of up to this many parts (letters, digits, marks) of words that a task remembers.
PART_WORDS = 1 << 16


class WordCodec:
    """The vocabulary of a word-level BPE tokenizer file, applied to one word at a time."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split, regex.V1).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        # Byte-level letters: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.letters = dict(zip(own, map(chr, own), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.pieces = {i: s for s, i in self.tok.get_vocab(with_added_tokens=True).items()}
        if [s.get("pattern", s["type"]) for s in spec["normalizer"]["normalizers"]] != ["NFC", {"Regex": r"\s+"}, "Lowercase"]:
            raise ValueError(f"{path}: another normalizer than composition, single spaces and lower case")
        # Below U+0300 nothing composes, str.lower agrees with the file's lower-casing, and str.split with its white space but for U+001C-1F.
        self.far = regex.compile("[^\0-\x1b\x20-\u02ff]", regex.V1).search
        self.parts = Memo(self._part, PART_WORDS)

    def words(self, text: str) -> list[str]:
        """The normalized text's runs without white space, in order, and its special tokens, marked by a line feed before them.

        The file's split pattern matches no white space, so each run is split and encoded by itself.
        """
        if "<|" not in text:
            return self._runs(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            out += ["\n" + part] if i % 2 else self._runs(part)
        return out

    def _runs(self, text: str) -> list[str]:
        return self.tok.normalizer.normalize_str(text).split(" ") if self.far(text) else text.lower().split()

    def _part(self, part: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))]

    def ids(self, word: str) -> list[int]:
        if word[:1] == "\n":
            return [self.special[word[1:]]]
        return [i for part in self.find(word) for i in self.parts[part]]


@cache
def codec_of(path: str) -> WordCodec:
    """The codec, read once in a process: a Python worker runs many tasks."""
    return WordCodec(path)


class Memo(dict):
    """What make gives for a key, remembered for up to `most` keys before it starts anew."""

    def __init__(self, make: Callable[[str], list[int]], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Numbers(dict):
    """Word to its number, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def split_words(d: DataFrame, path: str, text_col: str, where: str, chunk_chars: int, buckets: int) -> DataFrame:
    """(chunk, bucket, words): the distinct words of each chunk of texts by hash bucket, packed, stored. A chunk without words has one row, of bucket -1.

    A chunk's other columns, the numbers of each text's words in order, and the bucket of each word, all compressed, go into the
    file `where`/chunk. Words are numbered as they appear; in a bucket they keep that order, so no number travels with
    them. Chunks are named by task attempt, so only files of attempts whose rows were stored are ever read.
    """
    at = d.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np
        import zstandard as z
        from pyspark import TaskContext

        codec, seq, pack = codec_of(path), 0, z.ZstdCompressor(level=3).compress
        fs, top = _fs(where)
        fs.create_dir(top, recursive=True)
        numbers, places, held, chars = Numbers(), [], [], 0

        def rows() -> pa.RecordBatch:
            nonlocal seq, numbers, places, held, chars
            chunk = TaskContext.get().taskAttemptId() << 20 | seq
            seq += 1
            bucket = np.fromiter((crc32(w.encode()) % buckets for w in numbers), "<u4", len(numbers))
            table = pa.Table.from_batches(held).append_column("places", pa.array(places, pa.large_binary()))
            out = io.BytesIO()
            for part in (table, pa.table({"bucket": pa.array([_planes(bucket)], pa.large_binary())})):
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(part)
            with fs.open_output_stream(f"{top}/{chunk}", compression=None) as f:
                f.write(out.getvalue())
            words, order = list(numbers), np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:].tolist(), len(words)]
            packed = [pack(" ".join([words[i] for i in order[a:b].tolist()]).encode()) for a, b in zip(starts.tolist(), ends, strict=True)] if words else [b""]
            made = [pa.array([chunk] * len(packed), pa.int64()), pa.array(found.tolist() if words else [-1], pa.int32()), pa.array(packed, pa.binary())]
            numbers, places, held, chars = Numbers(), [], [], 0
            return pa.RecordBatch.from_arrays(made, ["chunk", "bucket", "words"])

        for whole in batches:
            start = 0
            for i, t in enumerate(whole.column(at)):
                text = t.as_py() or ""
                words = codec.words(text)
                places.append(_planes(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words))))
                chars += len(text)
                if chars >= chunk_chars:
                    held.append(_rest(whole.slice(start, i + 1 - start), at))
                    start = i + 1
                    yield rows()
            if start < whole.num_rows:
                held.append(_rest(whole.slice(start), at))
        if held:
            yield rows()

    plain = d.toDF(*[f"c{i}" for i in range(len(d.columns))])  # mapInArrow itself stumbles over dots in names
    return stored(plain.mapInArrow(run, "chunk long, bucket int, words binary"), "bpe-words")


def _planes(numbers) -> bytes:
    """Numbers of four bytes, these apart: the high ones are nearly all 0 and compress away."""
    import numpy as np

    return np.ascontiguousarray(numbers.view("u1").reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _rest(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """A batch without the text column, under names by place, and with the texts' own place kept by the row order."""
    cols = [c for i, c in enumerate(batch.columns) if i != at]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(batch.num_rows)], [*map(str, range(len(cols))), "end"])


def encode_words(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """(chunk, bucket, ids, used, made) of words (chunk, bucket, words): each distinct word of all chunks is encoded once.

    ids: packed, how many each word has and then all in a row. used: the distinct ids. made: words encoded for this row. The
    rows of a bucket, one for each chunk, stream through one task, which remembers that bucket's distinct words alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard as z

        codec, pack, unpack = codec_of(path), z.ZstdCompressor(level=3).compress, z.ZstdDecompressor().decompress
        now, known = None, Memo(codec.ids, 1 << 62)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part, out = b.slice(start, 64), []
                for bucket, packed in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if bucket != now:
                        now = bucket
                        known.clear()
                    before = len(known)
                    ids = list(map(known.__getitem__, unpack(packed).decode().split(" "))) if packed else []
                    flat = np.array([i for x in ids for i in x], "<u4")
                    sizes = np.array([len(x) for x in ids], "<u4")
                    head = len(sizes).to_bytes(4, "little")
                    out.append((head + pack(_planes(sizes) + _planes(flat)), np.unique(flat).astype(np.int32), len(known) - before))
                done = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.list_(pa.int32()), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *done], ["chunk", "bucket", "ids", "used", "made"])

    return words.repartition(-(-buckets // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, ids binary, used array<int>, made int")


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) of the tokenizer's vocabulary: as many rows as it has ids, whatever the corpus."""
    return spark.createDataFrame(sorted(codec_of(path).pieces.items()), "id int, piece string")


def bpe(df: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """df without text_col, with n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, decoded string if keep_ids), which replace columns of these names.

    Texts are split into words at white space and stored as numbers of the distinct words of their chunk. The distinct
    words of all chunks meet by hash bucket, packed, and each is encoded once; the ids go back to the chunks, where each
    text's are put together by position. Decoding joins the distinct ids of a chunk to their pieces and puts these
    together by position, with spaces between, as the file names no decoder.

    Null and empty texts have no ids and an empty decoded text; an empty table gives an empty one; repeated rows each have
    a result; other columns pass through, whatever their names. Whole texts of any length. Memory goes by the chunk (its
    distinct words, and the positions of its texts) and by the bucket (its distinct words): there are four buckets for each
    shuffle partition that the session asks for.
    """
    spark = df.sparkSession
    ship(spark)
    d = without(df, [c for c in ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids if c != text_col.lower()])
    passed = [f for f in d.schema.fields if f.name != text_col]
    where = f"{shared_dir(spark)}/bpe-places-{uuid.uuid4().hex}"
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = split_words(d, path, text_col, where, chunk_chars, buckets)
    encoded = encode_words(words, path, buckets).drop("made").repartition("chunk")
    # All columns are named here, so that both readers have the same shuffle in common and words are not encoded for each.
    whole = F.when(F.col("ids").isNotNull() & (F.col("bucket") >= -1), F.col("used"))
    used = encoded.select(F.col("chunk").alias("of"), F.explode(whole).alias("id")).distinct()
    named = used.join(F.broadcast(pieces(spark, path)), "id").select("of", "id", "piece")

    def join(words: pa.Table, named: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard as z

        unpack = z.ZstdDecompressor().decompress
        chunk = words["chunk"][0].as_py()
        fs, top = _fs(where)
        with fs.open_input_stream(f"{top}/{chunk}", compression=None) as f:
            file = pa.BufferReader(f.read())
        texts = pa.ipc.open_stream(file).read_all()
        bucket = _numbers(pa.ipc.open_stream(file).read_all()["bucket"][0].as_py())
        flat, sizes = [], []
        for packed in words.sort_by("bucket")["ids"].to_pylist():
            n = int.from_bytes(packed[:4], "little")
            raw = unpack(packed[4:])
            sizes.append(_numbers(raw[: 4 * n]))
            flat.append(_numbers(raw[4 * n :]))
        # Words come by bucket, and by number within; back to the order of their numbers.
        order, by_bucket = np.argsort(bucket, kind="stable"), np.concatenate(sizes)
        flat, sizes, begins = np.concatenate(flat), np.empty_like(by_bucket), np.empty_like(by_bucket)
        sizes[order], begins[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
        piece = dict(zip(named["id"].to_pylist(), named["piece"].to_pylist(), strict=True))
        spelled = [piece[i] for i in flat.tolist()]
        # A word's pieces as one string; a word of no ids would leave no trace.
        by_word = [" ".join(spelled[a : a + n]) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        n_tokens, enc, dec, own, decoded = [], [], [], [], []
        for raw in texts["places"]:
            at = _numbers(raw.as_py())
            at = at[sizes[at] > 0]
            n = sizes[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            got = flat[np.repeat(begins[at] - (ends - n), n) + np.arange(total)]
            text = " ".join([by_word[i] for i in at.tolist()])
            n_tokens.append(total)
            enc.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
            dec.append(hashlib.sha256(text.encode()).hexdigest())
            if keep_ids:
                own.append(got.astype(np.int32))
                decoded.append(text)
        more = [pa.array(n_tokens, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
        if keep_ids:
            more += [pa.array(own, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        kept = [texts[str(i)] for i in range(len(passed))]
        return pa.table([*kept, *more], names=names)

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>"), ("decoded", "string")] * keep_ids
    inner = fresh([a for a, _ in added], *[f"c{i}" for i in range(len(passed))])  # names that any caller's columns may have are given back at the end
    names = [*inner, *[a for a, _ in added]]
    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(inner, passed, strict=True)], *[StructField(a, _parse_datatype_string(t)) for a, t in added]])
    out = encoded.groupBy("chunk").cogroup(named.groupBy("of")).applyInArrow(join, schema)
    return out.select(*[col(n).alias(f.name) for n, f in zip(inner, passed, strict=True)], *[a for a, _ in added])
