"""Best-fit packing of token pieces by minimum bin slack."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, gapless_rank, slices

SEQUENCE = 1024
SEPARATOR = 2
#: Encoded words that a worker keeps at most.
CACHE = 200_000
#: White space that a space doesn't end or begin alone: such texts are encoded whole.
ODD = re.compile(r"\s (?:\s|\Z)")
ODD_SPECIAL = "<|"
#: Fixed: the word splitter of byte-level vocabularies.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable
    Latin-1 stands for itself, the other bytes for the characters from 256 on, in order."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(other)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens by rank, if the file is a plain byte-level BPE whose ids are in merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model.get("type") != "BPE":
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    of, vocabulary = byte_alphabet(), {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocabulary.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocabulary) != 256 + len(merged):
        return None
    return {bytes(map(of.__getitem__, t)): i for t, i in vocabulary.items()}


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's splitter never joins characters across a space that follows
    non-space, so a text's ids are those of its pieces, cut before each space; the
    ids of pieces seen before are kept.  Texts with white space runs around a space,
    or that may hold a special token's string, are encoded whole.

    New pieces without white space inside are encoded as one text, a line each: a single
    line end is a word of its own there, so its id tells the pieces apart.
    """

    def __init__(self, path: str) -> None:
        self.path, self.known = path, {}
        ranks = merge_ranks(path)
        self.fast = tiktoken.Encoding("pieces", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.line_end = ranks[b"\n"] if ranks else None

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def learn(self, new: list[str]) -> None:
        if not self.fast:
            self.known.update(zip(new, self.whole(new)))
            return
        plain = [x for x in new if len(x) > 1 and not INNER.search(x, 1) and x[0] not in NO_START]
        self.known.update((x, array("I", self.fast.encode_ordinary(x)).tobytes()) for x in set(new).difference(plain))
        for a in range(0, len(plain), 4096):
            part = plain[a : a + 4096]
            ids = self.fast.encode_to_numpy("\n".join(part), disallowed_special=())
            cut = np.flatnonzero(ids == self.line_end)
            assert len(cut) == len(part) - 1
            blob, lo, hi = ids.astype("<u4").tobytes(), [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), 4 * len(ids)]
            self.known.update(zip(part, [blob[i:j] for i, j in zip(lo, hi)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        cuts: list[list[str] | None] = []
        for text in texts:
            whole = "\0" in text or ODD_SPECIAL in text or ODD.search(text)
            cuts.append(None if whole else text.replace(" ", "\0 ").split("\0"))
        new = set().union(*[c for c in cuts if c]).difference(known)
        self.learn(list(new))
        of = known.__getitem__
        return [b"".join(map(of, c)) if c is not None else self.whole([text])[0] for c, text in zip(cuts, texts)]


INNER = re.compile(r"\s")
NO_START = frozenset("\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def piece_bounds(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: full ones, after a shorter first."""
    first = n % sequence or min(n, sequence)
    return [(0, first), *[(s, s + sequence) for s in range(first, n, sequence)]]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves
    (little-endian unsigned 32-bit) with ``with_ids``."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)
    end = int(separator).to_bytes(4, "little")

    def pieces(batches):
        encode = Encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for part in slices(batch, 128):
                ids = part.column(0).to_pylist()
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, tokens in zip(ids, encode(texts)):
                    tokens += end
                    for k, (a, b) in enumerate(piece_bounds(len(tokens) // 4, sequence)):
                        own = tokens[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own)[: len(fields)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, out)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with at most ``counts`` of each, whose sum is the largest up to ``room``.

    Subset-sum dynamic programming on bitsets: bit t of ``reach`` after some lengths
    says whether t can be made of them; a count is taken in binary parts.  Lengths are
    tried in decreasing order and the search ends once ``room`` itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: list[int] = []
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            chosen += [length] * part
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until no length is left.

    Each bin starts with the longest length left and gets the fullest feasible
    combination of the rest; the combination is used as often as the counts allow,
    as a search for the next bin would find it again.
    """
    counts = {k: v for k, v in histogram.items() if v}
    plan = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        lengths = [longest, *fullest({k: v for k, v in rest.items() if v}, capacity - longest)]
        used: dict[int, int] = {}
        for x in lengths:
            used[x] = used.get(x, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        plan.append((sorted(lengths, reverse=True), times))
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def plan_runs(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of its runs, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(pieces: DataFrame, order: list[str], sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (with a column ``length``, 1 to
    ``sequence``).

    The driver gets one count for each length, at most ``sequence`` of them, and packs
    that histogram; pieces of one length are interchangeable, so a piece's rank among
    them says which run of the plan it is in.  ``pieces`` is read twice: cut it first.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = plan_runs(minimum_bin_slack(histogram, sequence))

    def place(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__rank")
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(at).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                first, start, offset = runs[x]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own] = start[k] + rank[own] - first[k]
                off[own] = offset[k]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], "sequence_id long, offset long"])
    return gapless_rank(pieces, ["length"], order, "__rank").select(*pieces.columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack all documents into sequences of at most SEQUENCE tokens.

    Null and empty texts are the separator alone.  Rows with equal ids are packed
    each; a null id stays null.  Extra columns are ignored; an empty table gives none.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, id_col, text_col, with_ids=with_ids))
    return pack(pieces, ["doc_id", "piece"]).withColumnRenamed("doc_id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
