"""Packing token sequences: first-fit decreasing on a tournament tree, in random groups of documents.

`tokenize` cuts each document's ids into pieces of `capacity` ids and a rest, and numbers the documents'
rows. `pack` deals the rows at random into groups of about `group_size` documents and, in each group on
its own, puts the pieces by falling length into the first sequence that has room. A tournament tree over
the sequences' free room finds that sequence in logarithmic time. Groups share nothing, so tasks are small,
equal and independent; they are dealt by row, so that rows that share an id, or have none, spread as well.

Edge cases: a null or empty text has no ids but the end id, so one piece; a very long text is cut whole;
equal lengths go by document id, nulls first, row and start; rows with equal or null ids are packed like any
other; an empty table gives no rows; further columns pass through `pack` untouched, of any name and type,
but for `sequence_id` and `offset`, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from lineshed.llm.textops import fresh, map_texts

CAPACITY = 4096
GROUP_SIZE = 8192
END_ID = 2
CACHE = 200_000
LONGEST_HELD = 64  # characters; a cache so holds a bounded number of bytes
# The pattern of the word tokenizer for these characters, and the characters that its
# vocabulary has for bytes: the visible ones of Latin-1 as they are, the others from U+0100 on.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+")
_PLAIN = re.compile("[\\t-\\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_VISIBLE = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ODD = re.compile("[\x1c-\x1f]")  # str.split parts at these, the tokenizer doesn't
_held: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Little-endian ids of texts, in `kind`, by the parts that the tokenizer cuts them into before merging.

    A text, or else a white-space free run of it, of ASCII and Latin-1 letters, digits and signs is cut as
    the tokenizer's own pattern cuts it, and each part goes to the tokenizer's merges once; other runs go to
    the whole tokenizer, which never joins ids across white space. The first `CACHE` parts and runs that a
    worker meets are kept, the others for a batch; this changes speed only.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.batch: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def __missing__(self, part: str) -> bytes:
        got = self.batch.get(part)
        if got is None:
            got = np.array([t.id for t in self.merge(part.encode().decode("latin-1").translate(_VISIBLE))], dtype=self.kind).tobytes()
            if len(self) < CACHE and len(part) <= LONGEST_HELD:
                self[part] = got
            else:
                self.batch[part] = got
        return got

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))

    def run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            got = self.plain(run) if _PLAIN.fullmatch(run) and "<|" not in run else self.whole(run)
            if len(self.runs) < CACHE and len(run) <= LONGEST_HELD:
                self.runs[run] = got
        return got

    def text(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain(text)
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.run, text.split()))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = [np.frombuffer(self.text(t), dtype=self.kind).astype("<u4").tobytes() for t in texts]
        self.batch.clear()
        return out


def tokenize(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, row, start, length, doc_tokens, ids): ids as little-endian 32-bit numbers, row a number of the row."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(texts: list) -> tuple:
        words = _held.get(tokenizer_path)
        if words is None:
            words = _held[tokenizer_path] = WordIds(tokenizer_path)
        rows: list[tuple] = []
        for row, ids in enumerate(words.ids([t or "" for t in texts])):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                rows.append((row, start, len(piece) // 4, total, piece))
        number, *columns = zip(*rows)
        return number, columns

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return map_texts(named, "text", ["doc_id", "row"], "start long, length long, doc_tokens long, ids binary", cut)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths must already fall. Items over the capacity are an error."""
    n = len(lengths)
    bins = np.zeros(n, dtype=np.int64)
    offsets = np.zeros(n, dtype=np.int64)
    if not n:
        return bins, offsets
    if lengths[0] > capacity:
        raise ValueError("an item is longer than a bin")
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)  # room[1] is the winner's; a node holds the most room below it
    for item, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:  # the left half has no room, so the right has
                node += 1
        bins[item] = node - leaves
        offsets[item] = capacity - room[node]
        room[node] -= length
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row, start, length). documents: how many there are, for the number of groups."""
    groups = max(1, -(-documents // group_size))
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    group = fresh("__group", own)

    def run(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        number = rows[group][0].as_py()
        return rows.drop_columns([group]).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.select(*own, F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).alias(group))
    schema = StructType([*pieces.select(*own).schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy(group).applyInArrow(run, schema)
