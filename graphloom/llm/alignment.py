r"""Cross-tokenizer alignment by a dangling-suffix transducer.

Every text is encoded by two tokenizers: A, a byte-level vocabulary, over a space and the text, and B, a
piece model, over the text (it adds that space itself). The transducer reads both token sequences once.
Its state is the side that leads and the bytes that the other side has not matched yet - a suffix of one
token. The side that trails gives the next token: it eats a part of the suffix, or all of it, or all of it
and leads with what is left of its own bytes. An empty suffix closes a group: there A and B tokens both
end. Each step but the first of a group is a link, a pair of tokens whose byte ranges overlap. Steps are
memoised by suffix and next token; a machine with more than ``MEMO`` of them is begun anew.

No token of either side goes over the place between a word and the blank after it (B's pieces are checked
for it), so a text is aligned word by word: the machine runs over the words that a worker has not met lately, and the
others have their groups and pairs from the run before. Texts are read in chunks of about ``CHUNK`` characters.

The corpus: each document holds a pair of ids once or not at all. Documents are counted by pair in
Spark, partial counts first; a pair is best if its A id has no other pair in more documents. Documents
then meet the counts of their pairs: by a broadcast if the pairs fit ``common.BROADCAST_BYTES``, else the
``HOT_PAIRS`` (at most) that the most documents hold are broadcast and the others are shuffled, so no key has
more than a 250,000th of the rows.

Defined results: texts that are null or empty, hold U+2581 or are changed by a tokenizer (joined bytes
differ from space and text) have no tokens: zeros, and '' as groups_sha256. Special tokens' strings in
texts are plain text. Very long texts are read in chunks (a run without blanks is one word, held whole). Ties:
all pairs with the highest count of an A id are best. Every row is a document of its own, repeated rows
and rows without an id too; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing

CHUNK = 1 << 19
#: Steps that a machine keeps, and words whose alignment is kept (twice so many at most); longer words are aligned each time.
MEMO, WORDS, WORD_CHARS = 300_000, 150_000, 64
HOT_PAIRS = 250_000
PAIR_BYTES = 24
#: U+2581 stands for a blank in B's pieces.
BLANK = "▁"
#: Before a blank that follows something else: neither side has tokens over such a place.
_CUT = re.compile(r"(?<=\S)(?= )")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class State(dict):
    """Next state by next token of the side that trails. lead: 1 for A, 2 for B, 0 if nothing dangles, -1 after a mismatch."""

    __slots__ = ("lead", "rest", "machine")

    def __init__(self, machine: Machine, lead: int, rest: bytes):
        self.machine, self.lead, self.rest = machine, lead, rest

    def __missing__(self, token: int) -> State:
        self[token] = after = self.machine.step(self, token)
        return after


class Machine:
    """The transducer over the bytes of two vocabularies, by id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.steps = 0
        self.closed = self.state(0, b"")
        self.failed = self.state(-1, b"")

    def state(self, lead: int, rest: bytes) -> State:
        key = (lead, rest) if rest else (min(lead, 0), b"")
        if key not in self.states:
            self.states[key] = State(self, *key)
        return self.states[key]

    def step(self, state: State, token: int) -> State:
        self.steps += 1
        if state.lead < 1:
            return self.state(1, self.bytes[0][token]) if state is self.closed else self.failed
        own, rest = self.bytes[state.lead % 2][token], state.rest
        if rest.startswith(own):
            return self.state(state.lead, rest[len(own) :])
        return self.state(3 - state.lead, own[len(rest) :]) if own.startswith(rest) else self.failed

    def align(self, a: list[int], b: list[int]) -> np.ndarray | None:
        """Who led before each step (0: a new group begins; 1: B gave the token, else A), or None if the bytes differ."""
        if self.steps > MEMO:
            self.clear()
        leads: list[int] = []
        push, state, next_a, next_b = leads.append, self.closed, iter(a).__next__, iter(b).__next__
        try:
            while True:
                lead = state.lead
                push(lead)
                state = state[next_b() if lead == 1 else next_a()]
        except StopIteration:
            leads.pop()
        if state is not self.closed or len(leads) != len(a) + len(b):
            return None
        return np.array(leads, np.int8)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A: ids of a text whose special strings are plain text, and each id's bytes."""
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not packing._byte_level(spec):
        raise ValueError(f"not a byte-level vocabulary: {path}")
    special, symbols = {x["content"] for x in spec.get("added_tokens", ())}, packing._byte_symbols()
    tokens = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
    slow = tokenizers.Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except ValueError:  # its regular expressions have a stack of limited size
            return slow.encode(text, add_special_tokens=False).ids

    return encode, [tokens.get(i, b"") for i in range(max(tokens) + 1)]


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """B: ids of a text that begins with the blank which the model adds itself, and each id's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in x.lstrip(BLANK) for x in names):
        raise ValueError(f"pieces go over blanks: {path}")

    blank = [model.piece_to_id(BLANK)]

    def encode(text: str) -> list[int]:
        return model.encode(text[1:], num_threads=1) if text != " " else blank  # the model adds no blank to nothing

    def own(i: int) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", names[i])
        return bytes([int(byte[1], 16)]) if byte else names[i].replace(BLANK, " ").encode()

    return encode, [own(i) for i in range(len(names))]


def chunks(text: str, size: int) -> Iterator[str]:
    """A blank and ``text``, cut before blanks that follow something else; ``size`` characters or up to the next such blank."""
    text, at = f" {text}", 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _digits(n: int) -> np.ndarray:
    """A row of decimal digits for each number below ``n``, zero bytes behind them."""
    return np.array([str(i) for i in range(n)], "S").view(np.uint8).reshape(n, -1)


def grouped(a: np.ndarray, b: np.ndarray, leads: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """``;a1,a2|b1;a3|b2,b3``: all groups, each after a semicolon; a row of bytes for each token, with zeros behind."""
    mine = leads != 1
    group = np.cumsum(leads == 0)
    of_a, of_b = group[mine], group[~mine]
    first_a, first_b = np.diff(of_a, prepend=0) > 0, np.diff(of_b, prepend=0) > 0
    at_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
    out = np.empty((len(a) + len(b), 1 + digits.shape[1]), np.uint8)
    out[at_a, 0], out[at_b, 0] = np.where(first_a, ord(";"), ord(",")), np.where(first_b, ord("|"), ord(","))
    out[at_a, 1:], out[at_b, 1:] = digits[a], digits[b]
    return out


class Sums:
    """What is known of a document: numbers, its groups' hash, distinct pairs and how often each is linked."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.groups = self.links = 0
        self.sha, self.codes, self.times, self.ok = hashlib.sha256(), [], [], False

    def add(self, n_a: int, text: bytes, pairs: np.ndarray) -> None:
        self.sha.update(text if self.groups else text[1:])
        code, count = np.unique(pairs, return_counts=True)
        self.codes.append(code)
        self.times.append(count)
        if len(self.codes) > 8:  # of long texts
            self.codes, self.times = ([x] for x in _summed(self.codes, self.times))
        groups = text.count(b";")
        self.n_a, self.n_b, self.groups, self.links = self.n_a + n_a, self.n_b + len(pairs) + groups - n_a, self.groups + groups, self.links + len(pairs)

    def row(self) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * width + b), times."""
        if not self.ok:
            return (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        return (self.n_a, self.n_b, self.groups, self.links, self.sha.hexdigest(), *_summed(self.codes, self.times))


class Aligner:
    """Both tokenizers, their machine and the words it has aligned; one in each worker."""

    def __init__(self, tokenizer: str, pieces: str):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = _vocabulary(tokenizer), _pieces(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.machine = Machine(self.bytes_a, self.bytes_b)
        self.width = len(self.bytes_b)
        self.digits = _digits(max(len(self.bytes_a), self.width))
        #: Words that were met lately and before that, with their number of A tokens, groups as text, and pairs.
        self.kept: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}

    def learn(self, words: list[str]) -> bool:
        """Align words, each of which but the last ends in no white space, in one run; whether their bytes match."""
        joined = "".join(words)
        a, b = self.encode_a(joined), self.encode_b(joined)
        if b"".join(map(self.bytes_a.__getitem__, a)) != joined.encode():
            return False
        leads = self.machine.align(a, b)
        if leads is None:
            return False
        a, b, mine, linked = np.array(a, np.int64), np.array(b, np.int64), leads != 1, leads != 0
        ends, ends_a, ends_b = np.cumsum([len(x.encode()) for x in words]), np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        upto_a, upto_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")
        if (ends_a[upto_a - 1] != ends).any() or (ends_b[upto_b - 1] != ends).any():
            return False
        pairs = a[np.cumsum(mine)[linked] - 1] * self.width + b[np.cumsum(~mine)[linked] - 1]
        out = grouped(a, b, leads, self.digits)
        last, used = upto_a + upto_b - 1, out != 0
        text, of_pairs = out[used].tobytes(), pairs.tobytes()
        at_text = np.cumsum(used.sum(axis=1))[last].tolist()
        at_pairs = (8 * np.cumsum(linked)[last]).tolist()
        for word, n, t0, t1, p0, p1 in zip(words, np.diff(upto_a, prepend=0).tolist(), [0, *at_text], at_text, [0, *at_pairs], at_pairs):
            self.kept[word] = (n, text[t0:t1], of_pairs[p0:p1])
        return True

    def block(self, parts: list[tuple[Sums, list[str]]]) -> None:
        """Add words to their documents."""
        if len(self.kept) > WORDS:
            self.kept, self.older = {}, self.kept
        words = [x for x in dict.fromkeys(chain.from_iterable(own for _, own in parts)) if x not in self.kept]
        self.kept.update((x, self.older[x]) for x in words if x in self.older)
        new = [x for x in words if x not in self.kept]
        plain = [x for x in new if not x[-1].isspace()]
        alone = [x for x in new if x[-1].isspace()] + (plain if plain and not self.learn(plain) else [])
        bad = {x for x in alone if not self.learn([x])}
        for sums, own in parts:
            if bad and not bad.isdisjoint(own):
                sums.ok = False
            if sums.ok:
                n_a, text, pairs = zip(*map(self.kept.__getitem__, own))
                sums.add(sum(n_a), b"".join(text), np.frombuffer(b"".join(pairs), np.int64))
        for x in new:
            if len(x) > WORD_CHARS:
                self.kept.pop(x, None)

    def documents(self, texts: list[str | None]) -> list[Sums]:
        out, block, size = [Sums() for _ in texts], [], 0
        for sums, text in zip(out, texts):
            sums.ok = bool(text) and BLANK not in text
            for part in chunks(text, CHUNK) if sums.ok else ():
                block.append((sums, _CUT.split(part)))
                size += len(part)
                if size >= CHUNK:
                    self.block(block)
                    block, size = [], 0
        self.block(block)
        return out


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], times[0]
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(times)).astype(np.int64)


_SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(tokenizer: str, pieces: str) -> Callable:
    def run(batches):
        aligner = Aligner(tokenizer, pieces)
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        for part in (part for batch in batches for part in common.slices(batch)):
            rows = [x.row() for x in aligner.documents(part.column("text").to_pylist())]
            cols = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:4]]
            ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]))) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, pa.array([r[4] for r in rows]), *lists], schema=schema)

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n (its documents) and best (whether no other pair of its A id has more), of rows (pair, a), one for each document and pair."""
    counts = pairs.groupBy("pair", "a").agg(F.count("*").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each row of ``docs`` (doc_id, text).

    ``tokenizer`` and ``pieces`` are paths of a byte-level tokenizer file and a piece model that every executor has.
    """
    tokenizer, pieces = tokenizer or packing.default_tokenizer(), pieces or default_pieces()
    width = len(_pieces(pieces)[1])
    rows = docs.select("doc_id", "text").mapInArrow(_aligned(tokenizer, pieces), f"{_SUMS}, pairs array<long>, times array<long>")
    rows = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned", None)
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = pair_counts(rows.select(F.explode("pairs").alias("pair")).withColumn("a", F.expr(f"pair div {width}")))
    counts = common.written(counts, "pairs")
    n = counts.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if n.pairs * PAIR_BYTES <= common.BROADCAST_BYTES:
        met = held.join(F.broadcast(counts), "pair")
    else:
        hot = F.col("n") * HOT_PAIRS > n.rows  # fewer than HOT_PAIRS can have that many
        common_ones = F.broadcast(counts.where(hot))
        met = held.join(common_ones, "pair").unionByName(held.join(F.broadcast(counts.where(hot).select("pair")), "pair", "left_anti").join(counts.where(~hot), "pair"))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.documents(spark, sf_dir))
