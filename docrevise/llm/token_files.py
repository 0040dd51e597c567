"""Token-ID output (operator 6): flat unsigned-integer files with 64-bit
document offsets, written in document order and read back memory-mapped.

A shard is three files: ``<name>.ids`` (token ids of all its documents, one
after another, little-endian, 16 bits when every id fits, else 32),
``<name>.off`` (n + 1 unsigned 64-bit offsets, in ids, from 0) and
``<name>.doc`` (n signed 64-bit document ids).  Documents are range-partitioned
by (id, text hash), so shards follow each other in ascending id order, null
ids last.  The manifest (Parquet, beside the shards) has one row per shard;
the base of a shard is the prefix sum of the ids before it.

Tasks write under names of their own attempt through the file system named by
the folder's URL; only names that reach the manifest count, so a lost
executor, a retried or a speculative task leaves no trace in the result.

Encoding.  The pre-tokenizer of a byte-level BPE file cuts at every single
space or line feed that stands between two visible characters, whatever
surrounds it.  So a batch is cut there, each distinct piece is encoded by the
tokenizers library once, and the ids are put together by array indexing.
Pieces of U+0021 to U+024F are split by the pre-tokenizer's own pattern here
and go to the library's BPE model directly; others go through its whole chain.
Other white space (double spaces, tabs, spaces at line ends) stays inside its
piece, which is encoded alone.  A text that holds a special token's string, and
every text where the file is not a plain byte-level BPE, goes to the library
whole.

Defined cases: null and empty texts are just the end id; equal ids are ordered
by text hash (equal texts have equal ids, so ties change nothing); null ids
come last and read back as null; an empty table gives no shard.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrevise.llm.common import col, folder, text_or_empty

END_ID = 0
#: Encoded text bytes per shard, about, and pieces remembered by a task.
SHARD_BYTES = 64 << 20
CACHE_PIECES = 300_000
#: Text bytes encoded together, about.
SLICE_BYTES = 10 << 20


#: White space of any engine involved, and what the fast way splits by itself.
_WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD = rf"^$|^[{_WHITE}]|[{_WHITE}]$"
#: A piece that may stand between line feeds without changing its tokens.
_JOINS = rf"^ ?[^{_WHITE}](?:[^\n]*[^{_WHITE}])?$"
_PLAIN = r"^ ?[\x{21}-\x{7E}\x{A1}-\x{24F}]+$"
#: A single space or line feed between visible characters starts a piece.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The byte-level pre-tokenizer's pattern, its classes written out for U+0021-U+024F.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100; 0 (our delimiter) is a space."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)} | {0: " "}


class Encoder:
    """Encodes batches of texts with a tokenizers file (its JSON text);
    remembers the ids of the pieces seen first (frequent ones come early), up
    to a bound.  ``end`` is appended to every text."""

    def __init__(self, spec: str, cache: int = CACHE_PIECES, end: int = END_ID):
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.tok = Tokenizer.from_str(spec)
        self.kind = np.dtype("<u4" if self.tok.get_vocab_size() > 1 << 16 else "<u2")
        self.limit, self.known = cache, {}
        self.end = np.array([end], self.kind)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        j = json.loads(spec)
        pre, model = j.get("pre_tokenizer") or {}, j["model"]
        #: cutting is only known to be right for a plain byte-level BPE
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and j.get("normalizer") is None
                     and model.get("type") == "BPE" and not any(model.get(x) for x in (
                         "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if self.cuts:
            self.feed = self.whole("\n")[0]
            # the same model behind a plain delimiter, without its cache: most pieces that come here come once
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.letters = _byte_letters()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _model(self, text: str) -> np.ndarray:
        """Ids of a text of plain characters, spaces and line feeds."""
        cut = "\0".join(_TOKENS.findall(text)).encode().decode("latin-1").translate(self.letters)
        return np.array(self.bare.encode_batch_fast([cut], add_special_tokens=False)[0].ids, self.kind)

    def _encode(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces``, and their number per piece.  Line feeds
        between pieces are pre-tokens of their own, so one call does many; a
        piece with white space at an end or a line feed inside goes alone."""
        if not pieces:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        white = ~plain
        if white.any():
            white &= ~pc.match_substring_regex(pa.array(pieces, pa.large_string()), _JOINS).to_numpy(zero_copy_only=False)
        parts, lens = [], np.zeros(len(pieces), np.int64)
        order = []
        for which, run in ((np.nonzero(plain)[0], self._model), (np.nonzero(~plain & ~white)[0], self.whole)):
            for lo in range(0, len(which), 2048):
                some = which[lo:lo + 2048]
                ids = run("\n".join([pieces[i] for i in some.tolist()]) + "\n")
                feeds = ids == self.feed
                lens[some] = np.diff(np.nonzero(feeds)[0], prepend=-1) - 1
                parts.append(ids[~feeds])
                order.append(some)
        for i in np.nonzero(white)[0].tolist():
            parts.append(self.whole(pieces[i]))
            lens[i] = len(parts[-1])
            order.append(np.array([i]))
        flat, order = np.concatenate(parts), np.concatenate(order)
        if (order[1:] > order[:-1]).all():
            return flat, lens
        at = np.zeros(len(pieces), np.int64)
        at[order] = np.cumsum(lens[order]) - lens[order]
        return flat[np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(len(flat))], lens

    def _pieces(self, pieces: list[str], plain: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and each piece's first position and number of ids.
        ``times``: how often a piece occurs; single ones are not remembered."""
        found = list(map(self.known.get, pieces))
        new = np.array([i for i, x in enumerate(found) if x is None], np.int64)
        is_new = np.zeros(len(pieces), bool)
        is_new[new] = True
        ids, lens = self._encode([pieces[i] for i in new.tolist()], plain[new])
        old = [x for x in found if x is not None]
        size = np.zeros(len(pieces), np.int32)
        size[new] = lens
        size[~is_new] = np.fromiter(map(len, old), np.int64, len(old)) // self.kind.itemsize
        flat = np.concatenate([np.frombuffer(b"".join(old), self.kind), ids])
        order = np.concatenate([np.nonzero(~is_new)[0], new])
        first = np.zeros(len(pieces), np.int32)
        first[order] = np.cumsum(size[order]) - size[order]
        again = np.nonzero(times[new] > 1)[0][:max(0, self.limit - len(self.known))]
        for i, e, n in zip(new[again].tolist(), np.cumsum(lens)[again].tolist(), lens[again].tolist()):
            self.known[pieces[i]] = ids[e - n:e].tobytes()
        return flat, first, size

    def _cut_texts(self, pieces: pa.Array, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids per text, of texts given as pieces (a text's first at its
        ``starts``); also, per text, whether a piece has white space at an end
        or inside, so that the cut does not hold.  A piece that follows a line
        feed (or starts a text) carries that line feed; before every other one
        stood a space."""
        codes = pieces.dictionary_encode()
        distinct, codes = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        lead = pc.starts_with(distinct, "\n")
        bare = pc.if_else(lead, pc.utf8_slice_codeunits(distinct, 1), distinct)
        odd = pc.match_substring_regex(bare, _ODD)
        key = pc.if_else(lead, bare, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct, pa.scalar(" ", pa.large_string())))
        key = pc.if_else(odd, pa.scalar("x", pa.large_string()), key)  # not used
        plain = pc.match_substring_regex(key, _PLAIN).to_numpy(zero_copy_only=False)
        odd = odd.to_numpy(zero_copy_only=False)
        return self._assemble(codes, key.to_numpy(zero_copy_only=False).tolist(), lead.to_numpy(zero_copy_only=False), plain, starts), np.add.reduceat(odd[codes], starts) > 0

    def _assemble(self, codes: np.ndarray, keys: list[str], lead: np.ndarray, plain: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        flat, first, size = self._pieces(keys, plain, np.bincount(codes, minlength=len(keys)))
        # a piece after a line feed is led by the feed's id: one more id
        own = size[codes]
        n = own + lead[codes]
        total = int(n.sum())
        ends = np.cumsum(n, dtype=np.int32)  # a slice is far below 2**31 ids
        where = np.repeat(first[codes] - (ends - own), own)
        keep = np.ones(total, bool)
        keep[(ends - n)[lead[codes]]] = False
        stream = np.full(total, self.feed, self.kind)
        where += np.nonzero(keep)[0].astype(np.int32)
        stream[keep] = flat[where]
        last = ends[np.append(starts[1:], len(codes)) - 1]
        begin = np.append(0, last[:-1])
        # the line feed put before a text is not its own
        return [stream[a + 1:e] for a, e in zip(begin.tolist(), last.tolist())]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, and the number of ids per text."""
        out: list = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if self.cuts and not any(s in t for s in self.special)]
        if easy:
            marked = pc.replace_substring(pa.array(["\n" + texts[i] for i in easy], pa.large_string()), "\n", " \n")
            parts = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), " ")
            ids, irregular = self._cut_texts(parts.flatten(), parts.offsets.to_numpy()[:-1])
            for i, x in zip(easy, ids):
                out[i] = x
            irregular = [easy[k] for k in np.nonzero(irregular)[0].tolist()]
            if irregular:
                for i, x in zip(irregular, self._irregular([texts[i] for i in irregular])):
                    out[i] = x
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.whole(t)
        sizes = np.fromiter((len(x) + 1 for x in out), np.int64, len(out))
        return np.concatenate([y for x in out for y in (x, self.end)] or [np.zeros(0, self.kind)]), sizes

    def _irregular(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text; cut only where one space or line feed stands between
        visible characters, so other white space stays inside its piece."""
        cut = [_CUT.split("\n" + t) if t[:1].isspace() or not t else ["\n" + x if not i else x for i, x in enumerate(_CUT.split(t))] for t in texts]
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        codes: dict[str, int] = {}
        at = np.fromiter((codes.setdefault(p, len(codes)) for c in cut for p in c), np.int64)
        lead = np.fromiter((p[0] == "\n" for p in codes), bool, len(codes))
        keys = [p[1:] if f else p for p, f in zip(codes, lead.tolist())]
        plain = pc.match_substring_regex(pa.array(keys, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        return self._assemble(at, keys, lead, plain, starts)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes: (first, number)."""
    lo = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield lo, i + 1 - lo
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes) - lo


def vocabulary(spark: SparkSession, tokenizer: str):
    """The tokenizers file's JSON text, read once on the driver and shipped
    (a few MB), so executors need no copy of the file."""
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system where it
    names none, so that Spark and the tasks' own writers mean one place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _store(url: str):
    """(file system, path) of a qualified URL."""
    from pyarrow import fs
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text",
                      n_shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards below ``path`` and return the manifest."""
    spark = docs.sparkSession
    path, spec = qualified(spark, path), vocabulary(spark, tokenizer)
    # long -> 64-bit ids; other columns are not read
    src = docs.select(col(id_col).cast("long").alias("doc_id"), text_or_empty(col(text)).alias("text"))
    if n_shards is None:
        size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES), 1)
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    src = src.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, store = None, None
        n_docs = n_ids = n_null = 0
        for b in batches:
            if not b.num_rows:
                continue
            if store is None:
                enc = Encoder(spec.value)
                store, root = _store(path)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                store.create_dir(root, recursive=True)
                files = {x: store.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "off", "doc")}
                files["off"].write(np.zeros(1, "<u8").tobytes())
            keys = b.column(0)
            n_null += keys.null_count
            files["doc"].write(pc.fill_null(keys, 0).to_numpy().astype("<i8").tobytes())
            for lo, n in _slices(pc.binary_length(b.column(1)).to_pylist(), SLICE_BYTES):
                ids, sizes = enc.batch(b.column(1).slice(lo, n).to_pylist())
                files["ids"].write(ids.tobytes())
                files["off"].write((n_ids + np.cumsum(sizes)).astype("<u8").tobytes())
                n_ids += len(ids)
            n_docs += b.num_rows
        if store is not None:
            for f in files.values():
                f.close()
            row = {"part": [TaskContext.get().partitionId()], "name": [name], "width": [enc.kind.itemsize],
                   "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()),
                                                                    ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))
    manifest = f"{path.rstrip('/')}/manifest.parquet"
    src.mapInArrow(run, "part int, name string, width int, n_docs bigint, n_null bigint, n_ids bigint").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole collection),
    n_tokens and ids_crc32 (of its ids as little-endian 32-bit integers) per
    document, from the mapped files."""
    path = qualified(spark, path)
    m = spark.read.parquet(f"{path.rstrip('/')}/manifest.parquet")
    # one narrow row per shard
    m = m.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    m = m.repartition(max(1, min(m.count(), 4 * spark.sparkContext.defaultParallelism)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        local = type(store).__name__ == "LocalFileSystem"

        def mapped(file: str, kind: str, n: int) -> np.ndarray:
            if not n:
                return np.zeros(0, kind)
            f = f"{root}/{file}"
            return np.memmap(f, kind, "r") if local else np.frombuffer(store.open_input_file(f).read_buffer(), kind)
        for b in batches:
            for r in b.to_pylist():
                n = r["n_docs"]
                off = mapped(f"{r['name']}.off", "<u8", n + 1).astype(np.int64)
                doc = mapped(f"{r['name']}.doc", "<i8", n)
                ids = mapped(f"{r['name']}.ids", f"<u{r['width']}", r["n_ids"])
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(off[lo:hi].tolist(), off[lo + 1:hi + 1].tolist())]
                    null = np.arange(lo, hi) >= n - r["n_null"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(doc[lo:hi]), mask=null), pa.array(r["base"] + off[lo:hi]),
                        pa.array(np.diff(off[lo:hi + 1])), pa.array(np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return m.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of ints, end id included) per document."""
    path = qualified(spark, path)
    m = spark.read.parquet(f"{path.rstrip('/')}/manifest.parquet").repartition("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for b in batches:
            for r in b.to_pylist():
                read = lambda x, kind: np.frombuffer(store.open_input_file(f"{root}/{r['name']}.{x}").read_buffer(), kind)  # noqa: B023,E731
                off, doc, ids = read("off", "<u8").astype(np.int64), read("doc", "<i8"), read("ids", f"<u{r['width']}")
                for i in range(r["n_docs"]):
                    null = i >= r["n_docs"] - r["n_null"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if null else int(doc[i])], pa.int64()),
                        pa.array([ids[off[i]:off[i + 1]].astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return m.mapInArrow(run, "doc_id bigint, ids array<int>")


def token_files(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write ``docs`` to a new folder below the shared one and read it back."""
    path = folder(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, **kw)
    return read_token_files(docs.sparkSession, path)
