"""BPE encoding and decoding with the merges of a public word-end vocabulary.

A word keeps one contiguous array of part boundaries and one of the ranks of adjacent parts. The lowest
rank is found by a scan, its inner boundary deleted and the ranks on both sides refreshed. Words above
LONG symbols, where repeated scans would be quadratic, use a heap over the same boundaries.

Null and empty texts give no ids. Repeated rows are encoded alike; other columns pass through unless
their names clash with `ids` or `decoded`, which the new ones replace. A worker holds the ids of a slice of about 1 MB of
text at a time, two caches of two generations (about CACHED bytes each, and a third of it) and the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, share, sliced

LONG, CACHED = 400, 48_000_000
NONE = 1 << 60
#: The pieces that the vocabulary's pre-tokenizer keeps; white space is Unicode's White_Space.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{space}{letter}{number}]+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+"
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def piece_pattern() -> str:
    """PIECES with letters and numbers as the interpreter's Unicode tables have them: newer characters that
    the regex library already knows count as neither."""
    import regex

    known = regex.compile(r"[\p{L}\p{N}]")
    spots = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    runs, start = [], None
    for a, b in zip(spots, [*spots[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    new = "".join(runs) or "\\U0010ffff"
    return "(?V1)" + PIECES.format(letter=rf"[\p{{L}}--[{new}]]", number=rf"[\p{{N}}--[{new}]]", space=SPACE)


class WordBpe:
    """Encodes and decodes whole texts. raw: the JSON file's bytes; cached: bytes of a generation of the cache of runs; that of words has a third."""

    def __init__(self, raw: bytes, cached: int = CACHED):
        import regex

        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError("this vocabulary is of another kind")
        self.ids = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.symbols = byte_symbols()
        self.pieces = regex.compile(piece_pattern()).findall
        self.ascii = re.compile(ASCII_PIECES).findall
        order = sorted(self.special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, order)) + ")").split
        self.marks = tuple(order)
        self.runs = regex.compile(rf"[^{SPACE}]+").findall
        self.words, self.cache = _Kept(self.word, cached // 3), _Kept(self.chunk, cached)

    def word(self, word: str) -> bytes:
        """The ids of one piece, packed."""
        text = "".join([self.symbols[b] for b in word.encode("utf-8", "replace")])
        bounds = [*range(len(text)), len(text) + len(END)]
        text += END
        (self.scan if len(bounds) <= LONG else self.heap)(text, bounds)
        get = self.ids.get
        ids = [get(text[a:b]) for a, b in zip(bounds, bounds[1:])]
        return pack([i for i in ids if i is not None])

    def scan(self, text: str, bounds: list[int]) -> None:
        get = self.ranks.get
        one = [*text[: len(bounds) - 2], text[len(bounds) - 2 :]]
        near = [get(pair, NONE) for pair in zip(one, one[1:])]
        while near and (low := min(near)) < NONE:
            i = near.index(low)
            del bounds[i + 1], near[i]
            a, b = bounds[i], bounds[i + 1]
            if i:
                near[i - 1] = get((text[bounds[i - 1] : a], text[a:b]), NONE)
            if i < len(near):
                near[i] = get((text[a:b], text[b : bounds[i + 2]]), NONE)

    def heap(self, text: str, bounds: list[int]) -> None:
        n = len(bounds) - 1
        after, back, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        get, at = self.ranks.get, bounds + [bounds[-1]]
        piece = lambda i: text[at[i] : at[after[i]]]
        todo: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := get((a := piece(i), b := piece(j)))) is not None:
                heapq.heappush(todo, (r, i, a, b))

        for i in range(n):
            offer(i)
        while todo:
            _, i, a, b = heapq.heappop(todo)
            if not alive[i] or after[i] >= n or piece(i) != a or piece(after[i]) != b:
                continue
            j = after[i]
            alive[j], after[i] = False, after[j]
            if after[i] < n:
                back[after[i]] = i
            offer(back[i])
            offer(i)
        bounds[:] = [at[i] for i in range(n) if alive[i]] + [bounds[-1]]

    def chunk(self, chunk: str) -> bytes:
        """The ids of a lower-case run without white space."""
        return b"".join(map(self.words.__getitem__, (self.ascii if chunk.isascii() else self.pieces)(chunk)))

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens. Runs between white space are cached: no piece crosses it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also splits at the four separators below, which are no white space here
        runs = self.runs(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.cache.__getitem__, runs))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not any(m in text for m in self.marks):
            return self.plain(text)
        out = []
        for k, part in enumerate(self.parts(text)):
            out.append(pack([self.special[part]]) if k % 2 else self.plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder: its tokens, with their word ends, joined by spaces."""
        got = array("I")
        got.frombytes(ids)
        if BIG:
            got.byteswap()
        return " ".join(map(self.tokens.__getitem__, got))


class _Kept(dict):
    """Runs and their ids; long runs are worked out each time. A full table becomes the old one, from which what is asked again returns."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.make(run)
        if len(run) < 64:
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[run] = ids
            self.held += 200 + 2 * len(run) + len(ids)  # two objects and a place in the table
        return ids


SEPARATORS = re.compile("[\x1c-\x1f]")
BIG = array("I", [1]).tobytes()[0] == 0
assert array("I").itemsize == 4


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if BIG:
        out.byteswap()
    return out.tobytes()


_LOADED: dict[tuple[bytes, int], WordBpe] = {}


def _coder(raw: bytes, cached: int) -> WordBpe:
    """This worker's coder, kept for its next task; one vocabulary at a time."""
    key = (hashlib.sha256(raw).digest(), cached)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(raw, cached)
    return _LOADED[key]


def encode(df: DataFrame, vocabulary: str, text: str = "text", cached: int = CACHED) -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit integers) and decoded (string) to each row.

    The vocabulary file is read by the driver and broadcast: its size (under 2 MB) doesn't depend on the data."""
    import pyarrow as pa

    with open(vocabulary, "rb") as file:
        raw = share(df.sparkSession, file.read())
    kept = [c for c in df.columns if c not in ("ids", "decoded")]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]

    def run(batches):
        coder = _coder(raw.value, cached)
        for batch in sliced(batches, text):
            ids = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array([coder.decode(i) for i in ids], pa.string())],
                [*batch.schema.names, "ids", "decoded"],
            )

    return df.select(*kept).mapInArrow(lean(run), ", ".join([*schema, "ids binary", "decoded string"]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode()'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
