"""BPE encoding and decoding with a public byte-level vocabulary, by tree concatenation.

A text is cut where the pre-tokenizer is certain to cut: before the last character of a run of white space that more
text follows. What is left holds no case for the pre-tokenizer's look-ahead, so a pattern without one, which needs no
backtracking, splits it alike. A stretch of more than LEAF characters is halved, wherever that falls, down to leaves,
which are encoded as one parallel batch, and neighbours are joined level by level: a window around the join is encoded
again, pre-tokenizer included, and doubled until its first token is the left side's and its last the right side's. Its
edges lie before a space that follows another character and leads a word, where every pre-tokenizer of this kind cuts
whatever stands around, so what lies outside is as it is in the whole text.

Text between spaces that stays long is split by the library's own pre-tokenizer, and a piece that even that leaves long
is halved and joined in the same way without splitting, with windows that end between any two tokens: every two
neighbouring tokens are then as BPE would leave them, which makes the sequence what BPE gives for the whole piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from .common import col, plain_names, raw, slices, table, without

#: Characters of a leaf at most; what is longer is halved.
LEAF = 1024
#: Leaves from which a batch is worth threads.
BATCH = 32
#: Tokens of either side in the first window around a join.
WINDOW = 4
#: Below this character all Unicode versions agree on letters and digits, and the faster encoder is used.
EXOTIC = re.compile("[\u0500-\U0010ffff]")
#: White space as the pre-tokenizer's pattern has it (fixed values).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLE = re.compile(f"[{BLANK}][{BLANK}]")
CUT = re.compile(f"(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])")
UNIT = re.compile(f"(?= [^{BLANK}])")
#: The pre-tokenizer's pattern (fixed value) but for its look-ahead.
PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with this file, without adding special tokens."""

    def __init__(self, path: str | None = None):
        import tiktoken

        path = path or default_path()
        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, byte = spec["model"]["vocab"], _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_id = special
        self.strings = {i: s for s, i in vocab.items()}
        plain = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        singles = sorted((i, b) for b, i in plain.items() if len(b) == 1)
        order = [b for _, b in singles] + [bytes(byte[c] for c in m.replace(" ", "")) for m in merges]
        self.ids_of_rank = np.array([plain[b] for b in order], np.uint32)
        self.direct = bool((self.ids_of_rank == np.arange(len(order))).all())
        self.names = order
        self.lead = [len(b) > 1 and b[0] == 32 and b[1] > 32 and not 127 <= b[1] < 0xC3 for b in order]
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: r for r, b in enumerate(order)}, special_tokens={})
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for b, i in plain.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.joins = 0

    def _library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_padding()
        t.no_truncation()
        return t

    @cached_property
    def lib(self):
        """The library's tokenizer; most texts never need it."""
        return self._library()

    @cached_property
    def raw(self):
        """The same without splitting."""
        from tokenizers import pre_tokenizers

        t = self._library()
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return t

    def _piece(self, s: str) -> list[int]:
        """BPE of a string of the vocabulary's characters."""
        return [t.id for t in self.raw.model.tokenize(s)]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring halves of one piece as one sequence."""
        k, name = WINDOW, self.strings
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self._piece("".join(map(name.__getitem__, left[i:] + right[:j])))
            self.joins += 1
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def _halves(self, text: str) -> list[str]:
        n = 1
        while len(text) / n > LEAF:
            n *= 2
        cut = [len(text) * i // n for i in range(n + 1)]
        return [text[a:b] for a, b in zip(cut, cut[1:])]

    def tree(self, piece: str) -> list[int]:
        """The ids of a piece that the pre-tokenizer does not split."""
        level = [e.ids for e in self.raw.encode_batch_fast(self._halves(piece), add_special_tokens=False)]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        return level[0]

    def _joined_words(self, left: list[int], right: list[int]) -> list[int]:
        """The ranks of two neighbouring halves of one text as one sequence."""
        k, name, lead = WINDOW, self.names, self.lead
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            while i and not lead[left[i]]:
                i -= 1
            while j < len(right) and not lead[right[j]]:
                j += 1
            window = self.fast.encode_ordinary(b"".join([name[r] for r in left[i:] + right[:j]]).decode())
            self.joins += 1
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def tree_words(self, text: str) -> list[int]:
        """The ranks of a text without white space side by side but at its end."""
        leaves = self._halves(text)
        if len(leaves) >= BATCH:
            level = self.fast.encode_ordinary_batch(leaves, num_threads=2)
        else:
            level = [self.fast.encode_ordinary(x) for x in leaves]
        while len(level) > 1:
            level = [self._joined_words(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        return level[0]

    def _unit(self, unit: str) -> bytes:
        """Text between two certain cuts that is long or has characters on which Unicode versions may differ."""
        if len(unit) <= LEAF:
            return array("I", self.lib.encode(unit, add_special_tokens=False).ids).tobytes()
        ids: list[int] = []
        for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(unit):
            ids += self.tree(unit[a:b]) if b - a > LEAF else self.lib.encode(unit[a:b], add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _easy(self, text: str) -> bytes:
        ids = self.tree_words(text) if len(text) > LEAF else self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if self.direct else self.ids_of_rank[ids].tobytes()

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not text:
            return b""
        if DOUBLE.search(text):
            return b"".join([self._piece_ids(p) for p in CUT.split(text)])
        return self._piece_ids(text)

    def _piece_ids(self, text: str) -> bytes:
        half = LEAF // 2
        long = any(text.find(" ", k, k + half) < 0 for k in range(0, len(text) - half + 1, half))
        if not long and (text.isascii() or not EXOTIC.search(text)):
            return self._easy(text)
        out, run = [], []
        for u in UNIT.split(text):
            if len(u) <= LEAF and (u.isascii() or not EXOTIC.search(u)):
                run.append(u)
            else:
                out += [self._easy("".join(run)), self._unit(u)]
                run = []
        return b"".join([*out, self._easy("".join(run))])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special_id[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, special tokens kept, in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, array("I", ids)))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec a process and file."""
    path = path or default_path()
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _digest_schema(dtype: str) -> str:
    return f"doc_id {dtype}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id (as doc_id), n_tokens, the SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them, and n_joins (windows encoded again).

    Null and empty texts have no ids. Rows stay where they are: no shuffle. Repeated rows give repeated results.
    """

    def run(batches):
        c = codec(path)
        for b in slices(batches, "text"):
            n, ids_hex, text_hex, joins = [], [], [], []
            for text in col(b, "text").to_pylist():
                before = c.joins
                ids = c.encode(text)
                n.append(len(ids) // 4)
                joins.append(c.joins - before)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), pa.array(joins, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, _digest_schema(src.schema["doc_id"].dataType.simpleString()))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """docs with their ids as array<int> (a column of that name is replaced); null and empty texts give an empty array."""
    src, named = plain_names(without(docs, out_col))
    schema = StructType([*src.schema.fields]).add(out_col, ArrayType(IntegerType()))

    def run(batches):
        c = codec(path)
        for b in slices(batches, text_col):
            parts = c.encode_batch(col(b, text_col).to_pylist())
            ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out_col])

    return named(src.mapInArrow(run, schema))


def decode(docs: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text of their ids (a column of that name is replaced); null ids give an empty text."""
    src, named = plain_names(without(docs, out_col))
    schema = StructType([*src.schema.fields]).add(out_col, StringType())

    def run(batches):
        c = codec(path)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                text = [c.decode(x.values.to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()).decode() if x.is_valid else "" for x in col(part, ids_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*b.schema.names, out_col])

    return named(src.mapInArrow(run, schema))


def round_trip(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", exact_col: str = "exact", path: str | None = None) -> DataFrame:
    """encode(), and whether decoding the ids gives the text again (null counts as empty), in one pass over the texts."""
    src, named = plain_names(without(docs, out_col, exact_col))
    schema = StructType([*src.schema.fields]).add(out_col, ArrayType(IntegerType())).add(exact_col, BooleanType())

    def run(batches):
        c = codec(path)
        for b in slices(batches, text_col, 1 << 20):
            parts = c.encode_batch(col(b, text_col).to_pylist())
            same = [c.decode(p) == t for p, t in zip(parts, raw(col(b, text_col)))]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(same)], [*b.schema.names, out_col, exact_col])

    return named(src.mapInArrow(run, schema))


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir))
