r"""Best-fit packing of tokenised documents by swap-based local search.

Every document is encoded with the vocabulary of a tokenizer file and ends with id 0. Longer ones than
``CAPACITY`` are cut so that all pieces but the first are full. Full pieces are sequences of their own.

The others are dealt out at random into groups of about ``GROUP`` pieces. In a group, pieces are placed
best fit, longest first; then underfull sequences (more than ``ROOM`` tokens free) exchange one piece
for one, one for two or two for one, or move a piece, always so that the sum of squared fills grows,
until no exchange of any two of them gains. What stays underfull in any group is dealt out again and
packed anew, until one group holds it or no sequence is saved. No piece is ever left out or cut again.

Ids come from tiktoken over the very vocabulary in the tokenizer file, which is several times faster
and gives the ids of ``tokenizers``. Texts with the file's special token, texts that tiktoken's regular
expressions give up on (a million blanks in a row), and all texts of a file with another pre-tokenizer
go through ``tokenizers``.

Defined results: null and empty texts are one piece of the single id 0; very long texts are encoded whole (about 3 bytes
a byte of text); pieces of one length are placed in the order in which their group holds them; repeated rows are packed each;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END = 2048, 0
GROUP = 4096
#: A sequence with more room than this is underfull.
ROOM = 16
#: The pre-tokenizer for which tiktoken stands in, and how it splits a text (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def _byte_level(spec: dict) -> bool:
    """Whether a tokenizer file splits texts by ``PATTERN`` and merges bytes by rank, and does nothing else to them."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("dropout")
    return plain and {k: before.get(k, v) for k, v in BYTE_LEVEL.items()} == BYTE_LEVEL and before.get("type") == "ByteLevel"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids (uint32) without the end id."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def exact(text: str) -> np.ndarray:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)

    if not _byte_level(spec):
        return exact
    special = [x["content"] for x in spec.get("added_tokens", ())]
    symbols = _byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return exact(text)
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except ValueError:  # its regular expressions have a stack of limited size
            return exact(text)

    return encode


def _pieces(path: str, capacity: int) -> Callable:
    def run(batches):
        encode = encoder(path)
        for part in (part for batch in batches for part in common.slices(batch)):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that has room."""
    bins, free, by_room, rooms = [], [], {}, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = rooms >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[b] = room - lengths[i]
        if free[b]:
            by_room.setdefault(free[b], []).append(b)
            rooms |= 1 << free[b]
    return bins


def _gives(items: list[int], lengths: list[int]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """What a bin can give: nothing, one item, or two; of items of equal length one stands for all. With sizes and numbers of items."""
    by: dict[int, list[int]] = {}
    for i in items:
        by.setdefault(lengths[i], []).append(i)
    ones = [own[0] for own in by.values()]
    twins = [tuple(own[:2]) for own in by.values() if len(own) > 1]
    gives = [(), *((i,) for i in ones), *combinations(ones, 2), *twins]
    return gives, np.array([sum(lengths[i] for i in p) for p in gives]), np.array([len(p) for p in gives])


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins so that the sum of squared fills grows, until no exchange gains; empty bins go.

    The emptiest bin gives first, each time by the exchange that gains most. A bin's lengths differ by at
    least one token, so it has at most about sqrt(2 * capacity) different ones to give.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [b for b in range(len(bins)) if capacity - fill[b] > ROOM]
    give = {b: _gives(bins[b], lengths) for b in open_}
    stuck: set[int] = set()
    gained = False
    while len(open_) > 1:
        source = min((b for b in open_ if b not in stuck), key=fill.__getitem__, default=None)
        if source is None:
            if not gained:
                break
            stuck, gained = set(), False  # what a bin lacked may have come up since
            continue
        others = [b for b in open_ if b != source]
        size, count = (np.concatenate([give[b][k] for b in others]) for k in (1, 2))
        ends = np.cumsum([len(give[b][0]) for b in others])
        load = np.repeat([fill[b] for b in others], np.diff(ends, prepend=0))
        best = None
        for p, mine, n in zip(*give[source]):
            if not n:
                continue
            more = mine - size
            # both grow in squares: the receiver ends fuller than the source was
            ok = (more > 0) & (more <= capacity - load) & (load + more > fill[source]) & ((count + n < 4) if n == 2 else True) & ((count > 0) | (n == 1))
            if ok.any():
                gain = np.where(ok, 2 * more * (load - fill[source] + more), -1)
                k = int(gain.argmax())
                if gain[k] > 0 and (best is None or gain[k] > best[0]):
                    best = (int(gain[k]), p, k)
        if best is None:
            stuck.add(source)
            continue
        _, p, k = best
        at = int(np.searchsorted(ends, k, "right"))
        to = others[at]
        back = give[to][0][k - (int(ends[at - 1]) if at else 0)]
        bins[source] = [i for i in bins[source] if i not in p] + list(back)
        bins[to] = [i for i in bins[to] if i not in back] + list(p)
        for b in (source, to):
            fill[b] = sum(lengths[i] for i in bins[b])
            give[b] = _gives(bins[b], lengths)
        open_ = [b for b in open_ if bins[b] and (b not in (source, to) or capacity - fill[b] > ROOM)]
        stuck.discard(to)
        gained = True
    return [b for b in bins if b]


def _packed(capacity: int, round_: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, items in enumerate(bins):
            size = np.array([lengths[i] for i in items])
            sequence[items] = (round_ << 56) | (key[0].as_py() << 20) | k
            offset[items] = np.cumsum(size) - size
            fill[items] = size.sum()
        cols = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.Table.from_arrays([*cols, pa.array(sequence), pa.array(offset), pa.array(fill)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for each piece.

    docs needs doc_id and text; ``tokenizer`` is the path of a byte-level tokenizer file that every
    executor has.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), _PIECE)
    pieces = common.written(pieces.withColumn("_p", F.monotonically_increasing_id()), "pieces", docs.count())
    full = pieces.where(F.col("length") == capacity)
    done = [full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_p") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, least = pieces.where(F.col("length") < capacity), None
    for round_ in count():  # each but the last saves a sequence
        n = left.count()
        groups = max(1, -(-n // GROUP))
        dealt = left.groupBy(F.pmod(F.xxhash64("_p", F.lit(round_)), F.lit(groups)).alias("g"))
        rows = common.written(dealt.applyInArrow(_packed(capacity, round_), f"{_PIECE}, sequence_id long, offset long, fill long"), "packed", n)
        under = F.col("fill") < capacity - ROOM
        spare = rows.where(under).agg(F.count_distinct("sequence_id")).first()[0]
        last = groups == 1 or not spare or (least is not None and spare >= least)
        done.append((rows if last else rows.where(~under)).drop("fill"))
        if last:
            break
        least, left = spare, common.written(rows.where(under).drop("sequence_id", "offset", "fill").withColumn("_p", F.monotonically_increasing_id()), "underfull", n)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
