"""Token ids as binary files: one shared zstandard dictionary, each document compressed on its own.

A shard file has, one after the other:

* ``MAGIC`` (8 bytes), then the documents' zstandard frames in ascending id
  order. A frame holds the ids as little-endian unsigned integers of ``width``
  bytes and is compressed with the shared dictionary;
* the index: for each document its id (int64), whether it has one (uint8), the
  frame's offset (uint64) and its number of ids (uint64), as four columns;
* the footer ``FOOTER``: documents, ids, offset of the index, width, crc32 of
  the index, SHA-256 of the dictionary, ``MAGIC`` again.

So any one document is read with two small reads and its own frame. The
dictionary is the file ``dictionary`` beside the shards; a reader checks its hash.

Documents are dealt out by ranges of ids (equal ids by the text's begin and hash), a
shard for each range of about ``FILE_BYTES`` of text. A task writes
a file under a name of its own, and only files named in the manifest (written
once, as a table) count, so attempts that were lost or repeated leave no trace
in the result. Storage is reached through pyarrow's file systems, which know
local and shared folders as well as object stores.
"""

from __future__ import annotations

import hashlib
import os
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrocline.llm.common import give_back, text_bytes
from pyrocline.storage import free, fresh_path, settle

MAGIC = b"PYRTOK01"
FOOTER = "<QQQII32s8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
LEVEL = 3
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
DICTIONARY_BYTES = 64 << 10
#: Fewer samples than this, or fewer bytes, make a dictionary of their own content instead of a trained one.
LEAST_SAMPLES, LEAST_SAMPLE_BYTES = 16, 16 << 10
#: Text for each file, about.
FILE_BYTES = 64 << 20
#: The dictionary is trained on about this many documents, chosen by a hash of the text, and this many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 16 << 10
#: Encoded pieces between white space, other than plain words, that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Words or new pieces that are encoded in one string.
_TOGETHER = 256
#: Text that is encoded at once; bounds the arrays that a task holds.
_TOGETHER_BYTES = 8 << 20
#: Ids that are laid out at once.
_TOGETHER_IDS = 1 << 20
#: Ids that a task reads back, about, where there are more small files than tasks are needed.
IDS_READ = 4 << 20
#: Plain words are of these letters. They stay as they are in lower case and in composed normal forms; beyond ASCII
#: their second byte in UTF-8 is one of 0x9f to 0xbf.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_MARKS = string.punctuation
_READ = 8 << 20


def _laid(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``store`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return store[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _lowered(text: bytes) -> bytes:
    """The same pieces in lower case, but for those that may hold the name of a special token. (Arrow 23's ascii_lower garbles slices that were cast.)"""
    return b" ".join(p if b"<|" in p else p.lower() for p in text.split()) if b"<|" in text else text.lower()


def _plain(pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Whether each piece is a plain word, a run of marks or such a word before such a run; the word; the run."""
    marks = pc.utf8_ltrim(pieces, characters=_LETTERS)
    return pc.equal(pc.utf8_ltrim(marks, characters=_MARKS), pa.scalar("", pieces.type)), pc.utf8_rtrim(pieces, characters=_MARKS), marks


class Encoder:
    """Encodes texts with a tokenizers vocabulary, each distinct piece between ASCII white space once for many texts.

    Valid for vocabularies whose tokens never span white space; for any other,
    whole texts are encoded. If the vocabulary also lower-cases, pieces are told
    apart in lower case; if it cuts words off runs of marks and marks the ends of both,
    plain words and runs of marks go straight to its model, in byte-level characters, without normalizer and regex.
    Other pieces are remembered; new ones are encoded
    together, with a NUL between them, whose id no other character has. What a
    vocabulary allows is tried out on probes when it is loaded.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_piece = one("ab  cd\n\tef") == one("ab") + one("cd") + one("ef") and one(" \n") == [] and len(one("\0")) == 1
        self.by_piece = self.by_piece and one("ab \0 cd") == one("ab") + one("\0") + one("cd")
        self.lower = self.by_piece and one("ABcd,\nXY") == one("abcd,\nxy")
        self.between = (one("\0") or [0])[0]
        self.known: dict[str, bytes] = {}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.by_word = self.lower and bool(suffix) and self._cuts_words(one)

    def _cuts_words(self, one: Callable[[str], list[int]]) -> bool:
        """Whether the model alone gives the vocabulary's ids of words and of runs of marks, and shows where each ends."""
        names = pa.array([t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()], pa.large_string())
        if pc.any(_plain(names)[0]).as_py():  # a word with an id of its own
            return False
        words = [*_LETTERS, *_MARKS, _LETTERS, _MARKS, *(x + "a" for x in _LETTERS), "the", "abcdxq", "zzyzx", "lowercase", "größe", "ciónmente"]
        pairs = [(w, m) for w in ("the", "zzyzx", "größe") for m in (*_MARKS, ",***", "!!", _MARKS)]
        found, each = self._words(pa.array(words, pa.large_string())), [one(w) for w in words]
        if found is None or found[1].tolist() != list(map(len, each)) or found[0].tolist() != sum(each, []):
            return False
        return all(one(w + m) == one(w) + one(m) for w, m in pairs)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space and NUL."""
        out: list[bytes] = []
        joined = [" \0 ".join(pieces[i:i + _TOGETHER]) for i in range(0, len(pieces), _TOGETHER)]
        for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(x.ids, "<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.between) * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        for some, encode in (([p for p in new if "\0" in p], self._whole), ([p for p in new if "\0" not in p], self._pieces)):
            self.known.update(zip(some, encode(some), strict=True))
        return list(map(self.known.__getitem__, pieces))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """The model's ids of plain words and runs of marks, one after the other, and how many each has; None if it doesn't show each end."""
        cuts = pa.array([*range(0, len(words), _TOGETHER), len(words)], pa.int32())
        ids = [np.zeros(0, "<u4")]
        for text in pc.binary_join(pa.ListArray.from_arrays(cuts, words.cast(pa.string())), " ").to_pylist():
            # Byte-level characters are those of Latin-1, but for the bytes that have no sign there.
            text = text.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")
            ids += [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast([text], add_special_tokens=False)]
        store = np.concatenate(ids)
        ends = np.flatnonzero(self.last[store]) + 1
        there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        if len(ends) != there.sum():
            return None
        sizes = np.zeros(len(words), np.int64)
        sizes[there] = np.diff(ends, prepend=0)
        return store, sizes

    def _remembered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces, one after the other, and how many each has."""
        known = self._known(pieces.to_pylist())
        return np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        if not self.by_word:
            return self._remembered(pieces)
        plain, words, marks = _plain(pieces)
        parts = pa.concat_arrays([words.filter(plain), marks.filter(plain)]).dictionary_encode()
        found, other = self._words(parts.dictionary) or self._remembered(parts.dictionary), self._remembered(pieces.filter(pc.invert(plain)))
        store, sizes = np.concatenate((found[0], other[0])), np.concatenate((found[1], other[1], [0]))
        # Each piece is two stretches of the store: word and marks, or another piece and the last, empty one.
        which, of = np.full((len(pieces), 2), len(sizes) - 1), plain.to_numpy(zero_copy_only=False)
        which[of] = parts.indices.to_numpy().reshape(2, -1).T
        which[~of, 0] = len(parts.dictionary) + np.arange(len(other[1]))
        return _laid(store, (np.cumsum(sizes) - sizes)[which.ravel()], sizes[which.ravel()]), sizes[which].sum(1)

    def ids(self, bodies: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each UTF-8 text (binary, no nulls) as unsigned 32-bit integers, without an end id."""
        raw = [b.as_buffer().to_pybytes() for b in bodies]
        if not self.by_piece:
            yield from (np.frombuffer(x, "<u4") for x in self._whole([b.decode("utf-8", "replace") for b in raw]))
            return
        if self.lower:
            raw = list(map(_lowered, raw))
        split = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).cast(pa.large_string()))
        del raw
        coded = split.flatten().dictionary_encode()
        upto = np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))
        del split
        store, sizes = self._distinct(coded.dictionary)
        starts, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[which])))[upto]
        at = 0
        while at < len(bodies):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + _TOGETHER_IDS, "right")) - 1)
            here = which[upto[at]:upto[end]]
            stream, cuts = _laid(store, starts[here], sizes[here]), (ends[at:end + 1] - ends[at]).tolist()
            yield from (stream[i:j] for i, j in zip(cuts, cuts[1:], strict=False))
            at = end


@cache
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _parts_of(bodies: pa.Array) -> Iterator[pa.Array]:
    """Slices of ``bodies`` with about _TOGETHER_BYTES each, whole texts."""
    upto = np.cumsum(pc.binary_length(bodies).to_numpy())
    at = 0
    while at < len(bodies):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _TOGETHER_BYTES, "right")))
        yield bodies[at:end]
        at = end


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary trained on serialized ids of a bounded sample.

    Too small a sample for training is itself the dictionary (raw content);
    without any text the dictionary is empty.
    """
    rows = docs.where("text IS NOT NULL AND text <> ''")
    total = docs.count()
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < max(1, min(1 << 30, (SAMPLE_ROWS << 30) // max(total, 1))))
    # Copies share a hash, so of equal texts one is taken: a common text doesn't fill the sample.
    sample = sample.select(text_bytes().alias("body")).groupBy(F.xxhash64("body")).agg(F.first("body").alias("body")).select("body")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocabulary)
        for batch in batches:
            for part in _parts_of(batch.column("body")):
                out = [x.astype(f"<u{own.width}").tobytes()[:SAMPLE_BYTES] for x in own.ids(part)]
                yield pa.record_batch([pa.array(out, pa.binary())], names=["ids"])

    samples = sorted(r.ids for r in sample.mapInArrow(each, "ids binary").collect())
    size = sum(map(len, samples))
    if len(samples) >= LEAST_SAMPLES and size >= LEAST_SAMPLE_BYTES:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples).as_bytes()
        except zstandard.ZstdError:  # nothing in the sample repeats
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """Write the ids of all texts under ``path`` and return the stored manifest: part, file, docs, ids, base.

    ``base`` is the number of ids in all files before. Documents are ordered by
    id, null ids first, equal ids by the first 64 characters of the text, then by its hash.
    """
    rows = docs.select(F.col(columns[0]).cast("long").alias("doc_id"), F.col(columns[1]).alias("text"))
    dictionary = train_dictionary(rows, vocabulary, end_id)
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    mark = hashlib.sha256(dictionary).digest()
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = _encoder(vocabulary), _compressor(shared.value)
        end = end_id.to_bytes(own.width, "little")
        context = TaskContext.get()
        name = f"tokens-{context.partitionId():06d}-{uuid.uuid4().hex}.bin"
        target, folder = _open(path)
        ids, has, offsets, counts = [], [], [], []
        stream, at = None, len(MAGIC)
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                stream = target.open_output_stream(f"{folder}/{name}")
                stream.write(MAGIC)
            listed = batch.column("doc_id").to_pylist()
            ids += [x or 0 for x in listed]
            has += [x is not None for x in listed]
            for part in _parts_of(batch.column("body")):
                frames = []
                for numbers in own.ids(part):
                    frames.append(press.compress(numbers.astype(f"<u{own.width}").tobytes() + end))
                    offsets.append(at)
                    counts.append(len(numbers) + 1)
                    at += len(frames[-1])
                stream.write(b"".join(frames))
        if stream is not None:
            index = np.array(ids, "<i8").tobytes() + np.array(has, "u1").tobytes() + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes()
            stream.write(index + struct.pack(FOOTER, len(ids), sum(counts), at, own.width, zlib.crc32(index), mark, MAGIC))
            stream.close()
            yield pa.record_batch([pa.array([x]) for x in (context.partitionId(), name, len(ids), sum(counts))], names=["part", "file", "docs", "ids"])
        give_back()

    # As many files as the text's bytes ask for, and as many tasks as the session has partitions for.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("begin"), F.col("hash")]
    keyed = rows.select("doc_id", text_bytes().alias("body"), F.substring(F.coalesce("text", F.lit("")), 1, 64).alias("begin"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    dealt = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "body")
    # The window gathers the few rows in one task, which writes the only stored file: on a local file system each file that a
    # task creates makes Hadoop start programs (chmod), and none should start beside the workers that encode.
    free(docs.sparkSession)  # the workers that encode are large
    manifest = dealt.mapInArrow(each, "part long, file string, docs long, ids long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return settle(manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "manifest")


class Shard:
    """Reads one shard file: its index, then documents in any order."""

    def __init__(self, path: str, file: str, dictionary: bytes) -> None:
        fs, root = _open(path)
        self.file = fs.open_input_file(f"{root}/{file}")
        size = self.file.size()
        self.docs, self.ids, self.index_at, self.width, crc, mark, magic = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC or mark != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file}: not a shard of this dictionary")
        index = self.file.read_at(size - FOOTER_BYTES - self.index_at, self.index_at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{file}: the index is damaged")
        n = self.docs
        self.doc_ids, self.has = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.offsets, self.counts = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.ends = np.concatenate((self.offsets[1:], [self.index_at])).astype(np.int64)
        self.press = _decompressor(dictionary)

    def _numbers(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.press.decompress(frame), f"<u{self.width}")

    def read(self, nth: int) -> np.ndarray:
        """Ids of the nth document, the end id included."""
        return self._numbers(self.file.read_at(int(self.ends[nth] - self.offsets[nth]), int(self.offsets[nth])))

    def __iter__(self) -> Iterator[np.ndarray]:
        at = 0
        while at < self.docs:
            upto = max(at + 1, int(np.searchsorted(self.ends, self.offsets[at] + _READ, "right")))
            first = int(self.offsets[at])
            part = self.file.read_at(int(self.ends[upto - 1]) - first, first)
            for n in range(at, upto):
                yield self._numbers(part[self.offsets[n] - first:self.ends[n] - first])
            at = upto


def _dictionary(path: str) -> bytes:
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/dictionary") as source:
        return source.read()


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files that ``manifest`` names, read back from them."""
    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = min(files, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-ids // IDS_READ)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                dictionary = _dictionary(path) if dictionary is None else dictionary
                shard = Shard(path, file, dictionary)
                crcs, counts = [], []
                for numbers in shard:
                    crcs.append(zlib.crc32(numbers.astype("<u4").tobytes()))
                    counts.append(len(numbers))
                if counts != shard.counts.tolist():
                    raise ValueError(f"{file}: documents differ from the index")
                starts = base + np.cumsum(shard.counts) - shard.counts
                ids = pa.array(shard.doc_ids, mask=shard.has == 0)
                yield pa.record_batch([ids, pa.array(starts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "base").repartition(max(tasks, 1)).mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_table(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (below a fresh shared folder unless ``path`` is given) and return what they hold.

    One row for each row of ``docs``. Null and empty texts have the end id
    alone; null ids come first; equal ids are ordered by the text's begin and hash; an empty table
    gives no file and an empty result. Only ``doc_id`` and ``text`` are read.
    """
    path = path or fresh_path(spark, "tokens")
    manifest = write_tokens(docs, path, vocabulary or vocabulary_path(), end_id)
    return read_tokens(manifest, path)
