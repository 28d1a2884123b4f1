"""Alignment of two tokenizers' tokens over whole texts.

Both tokenizers' tokens tile the same bytes, a space and the text. The texts of an Arrow batch are laid end to end with their byte
offsets; the ends of both tokenizers' tokens are counted once into an array a byte, and where both have one, a group of tokens
ends. Where either has one, exactly one token of each ends or goes on, so these places are the overlapping pairs. Prefix sums
over the ends tell which tokens those are, and prefix sums at the documents' offsets give each document's figures.

How many documents hold a pair of ids linked is counted over the corpus: a chunk of documents sends each of its pairs once,
with the number of its documents that hold it, and gets each of them back once, with the corpus's number.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import letters
from .common import cut, exact, holding, shipped

#: Bytes of text that are laid end to end at once, bytes that make a chunk, and runs of a text that a worker remembers.
BATCH_BYTES, CHUNK_BYTES, MEMO_RUNS = 2 << 20, 8 << 20, 300_000
#: Bits of a pair's number that the second tokenizer's id takes.
B_BITS = 20

RUN = re.compile(" +[^ ]*")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones of Latin-1 as they are, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids and bytes of a byte-level BPE in a file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, data: bytes, pattern: str, doubtful: str):
        """doubtful: a character class of what the two libraries class differently; texts with one go to the library itself."""
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data.decode())
        self.tok.encode_special_tokens = True
        self.doubtful = re.compile(doubtful)
        alphabet = byte_alphabet()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            self.bytes_of[k] = bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode()
        self.len_of = np.array([len(t) for t in self.bytes_of], np.int64)
        self.quick = self._ranked(json.loads(data), pattern)

    def _ranked(self, spec: dict, pattern: str):
        """tiktoken's encoder, which is quicker, where merges by rank are the file's merges in order and the pieces are those of the pattern."""
        import tiktoken

        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        pre = spec.get("pre_tokenizer") or {}
        alike = (
            ids == sorted(ids) and len(set(ids)) == len(ids) and (not ids or ids[0] >= 256) and not spec.get("normalizer")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("ignore_merges")
        )
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {self.bytes_of[k]: k for t, k in vocab.items() if t not in special}
        if not alike or len(ranks) != 256 + len(ids):
            return None
        return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, raw: bytes) -> np.ndarray | None:
        """The text's ids; None where their bytes aren't the text's."""
        if self.quick is None or self.doubtful.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return np.array(ids, np.int32) if b"".join(map(self.bytes_of.__getitem__, ids)) == raw else None
        # Merged bytes are the bytes of a piece; what no piece holds would be missing.
        ids = np.array(self.quick.encode_ordinary(text), np.int32)
        return ids if self.len_of[ids].sum() == len(raw) else None


class Pieces:
    """Ids and bytes of a sentencepiece model, which puts a space before the text."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(t)) else t.replace("▁", " ").encode() for t in names]
        # Without a piece that goes on past a space, no merge joins what stands on both sides of one: runs are encoded for themselves.
        self.by_run = not any("▁" in t.lstrip("▁") for t in names)
        self.runs: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_all(self, spaced: list[str], raw: list[bytes]) -> list[np.ndarray | None]:
        """The ids of texts, each with the space before it; None where their bytes aren't the text's."""
        if not self.by_run:
            found = self.sp.encode([t[1:] for t in spaced], num_threads=1)
            return [np.array(ids, np.int32) if self.bytes(ids) == r else None for ids, r in zip(found, raw)]
        runs = [RUN.findall(t) for t in spaced]
        need = set().union(*runs)
        new = list(need.difference(self.runs))
        if len(self.runs) + len(new) > MEMO_RUNS:
            self.runs.clear()
            self.lossy.clear()
            new = list(need)
        found = self.sp.encode([r[1:] for r in new], num_threads=1)
        if " " in new:  # a space that ends a text; an empty text would get none before it
            found[new.index(" ")] = self.sp.encode("a ")[len(self.sp.encode("a")) :]
        self.runs.update(zip(new, (array("i", ids).tobytes() for ids in found)))
        if self.bytes([k for ids in found for k in ids]) != "".join(new).encode():
            self.lossy.update(r for r, ids in zip(new, found) if self.bytes(ids) != r.encode())
        out = []
        for parts, r in zip(runs, raw):
            ids = np.frombuffer(b"".join(map(self.runs.__getitem__, parts)), np.int32)
            sound = self.lossy.isdisjoint(parts) if self.lossy else True
            out.append(ids if sound or self.bytes(ids.tolist()) == r else None)
        return out


@dataclass
class Block:
    """What a batch of texts laid end to end gives. By document: n_a, n_b, n_groups, n_links and texts of the groups or their hashes;
    by document and distinct pair, in the order of documents (n_pairs a document) and pairs: its place in codes, and how often it is linked."""

    n: np.ndarray
    digests: list
    groups: list | None
    n_pairs: np.ndarray
    place: np.ndarray
    times: np.ndarray
    codes: np.ndarray
    held: np.ndarray


class Aligner:
    def __init__(self, a: bytes, b: bytes, pattern: str, doubtful: str):
        self.a, self.b = ByteLevel(a, pattern, doubtful), Pieces(b)
        self.a_len, self.b_len = self.a.len_of, np.array([len(t) for t in self.b.bytes_of], np.int64)
        if len(self.b.bytes_of) >> B_BITS:
            raise ValueError(f"more than {1 << B_BITS} pieces")
        # A token's number and what follows it: a comma, or the end of its half of a group.
        self.names = [f"{k}{s}" for x, seps in ((self.a, ",|"), (self.b, ",;")) for k in range(len(x.bytes_of)) for s in seps]
        self.b_name = 2 * len(self.a.bytes_of)

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(ids of A, ids of B, bytes) of a space and each text; nothing where their bytes aren't those."""
        spaced = [f" {t}" for t in texts if t]
        raw = [t.encode() for t in spaced]
        none, out = np.zeros(0, np.int32), []
        found = zip(spaced, raw, self.b.encode_all(spaced, raw))
        for t in texts:
            text, r, b = next(found) if t else ("", b"", None)
            a = self.a.encode(text, r) if b is not None else None
            out.append((none, none, 0) if a is None else (a, b, len(r)))
        return out

    def block(self, texts: list[str | None], with_groups: bool = False) -> Block:
        found = self.tokens(texts)
        n_a, n_b, size = (np.array([len(x[0]) for x in found], np.int64), np.array([len(x[1]) for x in found], np.int64), np.array([x[2] for x in found], np.int64))
        a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        del found
        total = int(size.sum())
        edge = np.concatenate([[0], np.cumsum(size)])
        # Ends by byte: at index e, of the token that ends before byte e.
        is_a = np.bincount(np.cumsum(self.a_len[a]), minlength=total + 1).astype(bool)
        is_b = np.bincount(np.cumsum(self.b_len[b]), minlength=total + 1).astype(bool)
        is_a[0] = is_b[0] = False
        both = is_a & is_b
        sum_a, sum_b, sum_both, sum_any = (np.cumsum(x, dtype=np.int32) for x in (is_a, is_b, both, is_a | is_b))
        n_groups, n_links = np.diff(sum_both[edge]), np.diff(sum_any[edge])
        end = np.flatnonzero(is_a | is_b)
        # The token over the byte before each end: as many ended before it as tokens stand before it.
        pair = (a[sum_a[end - 1]].astype(np.int64) << B_BITS) | b[sum_b[end - 1]]
        codes, code_of = np.unique(pair, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), n_links)
        seen, times = np.unique(doc * max(len(codes), 1) + code_of, return_counts=True)
        place = (seen % max(len(codes), 1)).astype(np.int32)
        n_pairs = np.bincount(seen // max(len(codes), 1), minlength=len(texts))[: len(texts)]
        texts_of = self._groups(a, b, both, np.flatnonzero(is_a), np.flatnonzero(is_b), sum_both, n_a, n_b)
        digests, groups = [], [] if with_groups else None
        for t in texts_of:
            digests.append(hashlib.sha256(t.encode()).hexdigest() if t else "")
            if groups is not None:
                groups.append(t)
        return Block(np.stack([n_a, n_b, n_groups, n_links]), digests, groups, n_pairs, place, times.astype(np.int32), codes, np.bincount(place, minlength=len(codes)))

    def _groups(self, a, b, both, ends_a, ends_b, sum_both, n_a, n_b) -> Iterator[str]:
        """Each document's groups as text: A's ids, a bar, B's ids; groups apart by semicolons."""
        closes_a, closes_b = both[ends_a], both[ends_b]
        group_a, group_b = sum_both[ends_a] - closes_a, sum_both[ends_b] - closes_b
        many = int(sum_both[-1])
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=many + 1)), np.cumsum(np.bincount(group_b, minlength=many + 1))
        # In a group A's tokens come first: before one of A stand B's of earlier groups, before one of B also A's of its own.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = 2 * a.astype(np.int64) + closes_a
        order[np.arange(len(b)) + upto_a[group_b]] = self.b_name + 2 * b.astype(np.int64) + closes_b
        at = 0
        for n in (n_a + n_b).tolist():
            yield "".join(map(self.names.__getitem__, order[at : at + n].tolist()))[:-1]
            at += n


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(a, b, pattern: str, doubtful: str) -> Aligner:
    key = (hashlib.sha256(a.value).digest(), hashlib.sha256(b.value).digest(), pattern, doubtful)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a.value, b.value, pattern, doubtful)
    return _ALIGNERS[key]


def _packed(x: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _rises(place: np.ndarray, n_pairs: np.ndarray) -> np.ndarray:
    """Differences of each document's rising places, which are small; and back by _places."""
    out = np.diff(place, prepend=0)
    first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
    out[first] = place[first]
    return out


def _places(rises: np.ndarray, n_pairs: np.ndarray) -> np.ndarray:
    upto = np.cumsum(rises, dtype=np.int64)
    start = np.cumsum(n_pairs) - n_pairs
    before = np.where(start > 0, upto[np.maximum(start - 1, 0)], 0) if len(upto) else np.zeros(len(n_pairs), np.int64)
    return upto - np.repeat(before, n_pairs)


class _Chunk:
    """Blocks of a partition's documents until they make a row."""

    def __init__(self):
        self.ids, self.blocks, self.size = [], [], 0

    def add(self, ids: pa.Array, block: Block, size: int) -> None:
        self.ids.append(ids)
        self.blocks.append(block)
        self.size += size

    def row(self, chunk: int, id_type: pa.DataType, with_groups: bool) -> pa.RecordBatch:
        bs = self.blocks
        codes, to = np.unique(np.concatenate([x.codes for x in bs]), return_inverse=True)
        held = np.zeros(len(codes), np.int64)
        np.add.at(held, to, np.concatenate([x.held for x in bs]))
        starts = np.cumsum([0, *(len(x.codes) for x in bs)])
        place = np.concatenate([to[s + x.place] for s, x in zip(starts, bs)])
        n_pairs = np.concatenate([x.n_pairs for x in bs])
        n = np.concatenate([x.n for x in bs], axis=1)
        ids = pa.concat_arrays(self.ids)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        cols = [
            pa.array([chunk], pa.int64()), one(ids.cast(id_type)), *(one(pa.array(x, pa.int64())) for x in n),
            one(pa.array([t for x in bs for t in x.digests], pa.string())), one(pa.array(n_pairs, pa.int64())),
            pa.array([_packed(_rises(place, n_pairs), np.int32)], pa.binary()), pa.array([_packed(np.concatenate([x.times for x in bs]), np.int32)], pa.binary()),
            one(pa.array(codes, pa.int64())), one(pa.array(held, pa.int64())),
        ]
        names = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "n_pairs", "rises", "times", "codes", "held"]
        if with_groups:
            cols.append(one(pa.array([t for x in bs for t in x.groups], pa.string())))
            names.append("groups")
        self.__init__()
        return pa.RecordBatch.from_arrays(cols, names)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, list, int]]:
    """(ids, texts, characters) of runs of rows with about `most` characters; one row at least."""
    texts = batch.column(1).to_pylist()
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most or k == len(texts) - 1:
            yield batch.column(0).slice(start, k + 1 - start), texts[start : k + 1], size
            start, size = k + 1, 0


def chunks(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row a chunk of documents of one partition, each with its figures, and the chunk's distinct pairs of ids in order (codes, held)."""
    spark = docs.sparkSession
    a, b = shipped(spark, a_path), shipped(spark, b_path)
    doubtful = letters.differing(letters.by_tiktoken(), letters.by_tokenizers())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        aligner, chunk, n = _aligner(a, b, pattern, doubtful), _Chunk(), 0
        part, id_type = TaskContext.get().partitionId(), None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for ids, texts, size in _slices(whole, batch_bytes):
                chunk.add(ids, aligner.block(texts, with_groups), size)
                if chunk.size >= chunk_bytes:
                    yield chunk.row((part << 32) + n, id_type, with_groups)
                    n += 1
        if chunk.ids:
            yield chunk.row((part << 32) + n, id_type, with_groups)

    lists = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"chunk long, ids array<{kind}>, {lists}, digests array<string>, n_pairs array<long>, rises binary, times binary, codes array<long>, held array<long>" + ", groups array<string>" * with_groups
    return docs.select(exact(id_col).alias("id"), exact(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(code, n, best): how many documents hold each pair linked, and whether none of its first id's pairs is held by more.

    A first id has at most as many pairs as the second vocabulary has ids, so its window is bounded.
    """
    each = chunked.select(F.explode(F.arrays_zip("codes", "held")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.held").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("code", B_BITS)))
    return each.withColumn("best", F.col("n") == most)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, **sizes) -> DataFrame:
    """Aligns the tokens of a byte-level BPE (a tokenizers file) with those of a sentencepiece model over every whole text.

    Returns id_col, n_a and n_b (tokens), n_groups (stretches at whose ends tokens of both end), n_links (pairs of tokens
    whose bytes overlap), n_best (links whose pair of ids is held by as many documents as any pair of its first id), count_sum
    (over the links, the documents that hold their pair) and groups_sha256; with with_groups also groups, the text that was
    hashed: `a1,a2|b1;a3|b2,b3`. A text that is null or empty, or whose tokens' bytes aren't a space and the text (as with U+2581),
    has no tokens: zeros, '' for the hash and for groups. Repeated rows are documents of their own, and each gives a row; a null
    id stays null, other columns are left out, and an empty table gives an empty one. Beside its texts a task holds a chunk's
    pairs, so memory follows the chunk and not the corpus. The result reads a table that released() deletes.
    """
    made = cut(chunks(docs, a_path, b_path, pattern, id_col, text_col, with_groups, **sizes))
    counts = pair_counts(made)
    posts = made.select("chunk", F.explode("codes").alias("code")).join(counts, "code")
    # In the order of codes, which is the chunk's: its pairs' numbers, those of best pairs below zero.
    back = posts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("code", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")))).alias("p")).select("chunk", F.col("p.n").alias("found"))
    own = [f.name for f in made.schema if f.name not in ("codes", "held")]
    met = made.select(*own).join(back, "chunk", "left").drop("chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    out_names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {f.name: batch.column(i).slice(k, 1) for i, f in enumerate(batch.schema)}
                flat = lambda c: row[c].flatten()  # noqa: B023, E731
                n_pairs = flat("n_pairs").to_numpy(zero_copy_only=False)
                n = np.zeros(0, np.int64) if row["found"].null_count else flat("found").to_numpy(zero_copy_only=False)
                place = _places(_unpacked(row["rises"][0].as_py(), np.int32), n_pairs)
                times = _unpacked(row["times"][0].as_py(), np.int32).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(n_pairs)])
                of_doc = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edge]), pa.int64())  # noqa: B023, E731
                best, total = of_doc(times * (n[place] < 0)), of_doc(times * np.abs(n[place]))
                cols = [flat("ids"), *map(flat, ("n_a", "n_b", "n_groups", "n_links")), best, total, flat("digests"), *([flat("groups")] if with_groups else [])]
                yield pa.RecordBatch.from_arrays(cols, out_names)

    quoted = "`" + id_col.replace("`", "``") + "`"
    longs = ", ".join(f"{c} long" for c in out_names[1:7])
    out = met.mapInArrow(finish, f"{quoted} {kind}, {longs}, groups_sha256 string" + ", groups string" * with_groups)
    return holding(out, made)
