"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as an incremental state machine.

``lookahead(merges)`` computes from the merge list alone how many bytes beyond a token boundary can still move that
boundary. The encoder buffers a pretoken only until its first tokens are that far from the end of what it has
seen, emits them, and goes on: memory is bounded by the lookahead, not by the text or by the longest pretoken.

Why the bound holds: in a proper merge list (every part of a merge is a byte or the product of an earlier merge),
merges happen in rank order, equal ranks from left to right. What lies right of a boundary acts on what lies left
of it only through a chain of merges of rising rank, each of which consumes, as its right part, the left part or the
product of the one before. The longest such chain, in bytes, is found by one dynamic program over the list.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from collections import defaultdict

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices

#: White space as Unicode's White_Space property.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: The split pattern of byte-level vocabularies of this family.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPLIT = regex.compile(PATTERN)
RUNS = {k: regex.compile(v) for k, v in {"L": r"\p{L}*", "N": r"\p{N}*", "O": rf"[^{SPACE}\p{{L}}\p{{N}}]*", "S": rf"[{SPACE}]*"}.items()}
FEED = 1 << 16  # characters fed at a time
LONG = 1024  # a pretoken of more characters is streamed
CACHE = 200_000  # pretokens remembered, at most twice as many


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that suffice beyond a boundary to make it final. Raises ValueError for an improper list."""
    known = {bytes([b]) for b in range(256)}
    reach: dict[bytes, int] = defaultdict(int)  # a token -> the most bytes from its start over which it can be acted on
    longest = 1
    for left, right in merges:
        if left not in known or right not in known:
            raise ValueError(f"improper merge list: {left!r} {right!r} has a part that no earlier merge makes")
        known.add(left + right)
        extent = len(left) + max(len(right), reach[right])
        for token in (left, left + right):
            reach[token] = max(reach[token], extent)
        longest = max(longest, extent)
    return longest


class Vocabulary:
    """Merges, ids and added tokens of a byte-level BPE file (JSON, as the tokenizers library writes it)."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], added: dict[str, int] | None = None):
        self.rank = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in reversed(list(enumerate(merges)))}
        self.ids, self.added = ids, added or {}
        self.first = [ids.get(bytes([b]), -1) for b in range(256)]
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.lookahead = lookahead(merges)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, split = data["model"], data["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or data["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or match words are not supported")
        alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls([(bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)) for a, b in pairs], ids, added)


def merge(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """Ids of one pretoken, whole: the lowest-ranked pair is merged first, the leftmost of equal ones."""
    rank = vocabulary.rank
    ids = [vocabulary.first[b] for b in data]
    if len(ids) < 48:
        none = 1 << 60
        ranks = [rank.get(p, (none, 0))[0] for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), (none, 0))[0]
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), (none, 0))[0]
        return ids
    n = len(ids)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(rank[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]  # noqa: B905
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k] if alive[k] else n
        if j >= n or ids[k] != a or ids[j] != b:
            continue
        ids[k], alive[j], after[k] = rank[a, b][1], False, after[j]
        if after[k] < n:
            before[after[k]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y < n and (p := (ids[x], ids[y])) in rank:
                heapq.heappush(heap, (rank[p][0], x, *p))
    return [i for i, live in zip(ids, alive, strict=True) if live]


class MergeStream:
    """Ids of one pretoken fed in pieces; a token leaves once ``lookahead`` bytes have been seen beyond its end."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""
        self.window = 4 * vocabulary.lookahead + 1024

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) >= self.window:
                done, safe = 0, len(self.held) - self.v.lookahead
                for i in merge(self.v, self.held):
                    end = done + len(self.v.bytes_of[i])
                    if end > safe:
                        break
                    out.append(i)
                    done = end
                self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        out, self.held = merge(self.v, self.held), b""
        return out


class _Cache(dict):
    """Packed ids of short pretokens, two generations of at most CACHE each."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = pack(merge(self.v, piece.encode()))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Encoder:
    """Feed characters, get ids as little-endian 32-bit integers. ``finish`` ends the text and starts anew."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cache, self.core = vocabulary, _Cache(vocabulary), MergeStream(vocabulary)
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.hold = max(map(len, vocabulary.added), default=1) - 1
        self.text = self.tail = ""
        self.run = ""

    def feed(self, piece: str) -> bytes:
        return self._split(piece, False)

    def finish(self) -> bytes:
        return self._split("", True)

    def encode(self, text: str) -> bytes:
        self.text = self.tail = self.run = ""
        self.core.held = b""
        cut = max(0, (len(text) - 1) // FEED * FEED)
        return b"".join([*(self.feed(text[at : at + FEED]) for at in range(0, cut, FEED)), self._split(text[cut:], True)])

    def _split(self, piece: str, last: bool) -> bytes:
        """Cut at added tokens; what may be the start of one is held back."""
        text, out, at = self.text + piece, [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += [self._words(text[at : m.start()], True), pack([self.v.added[m[0]]])]
            at = m.end()
        cut = len(text) if last else max(at, len(text) - self.hold)
        self.text = text[cut:]
        out.append(self._words(text[at:cut], last))
        return b"".join(out)

    def _words(self, piece: str, last: bool) -> bytes:
        """Cut into pretokens. One that ends two characters before the end of what is known is final."""
        out: list[bytes] = []
        if self.run:
            end = RUNS[self.run].match(piece).end()
            if end == len(piece) and not last:
                if self.run == "S":  # a run of white space leaves its last character to what follows
                    piece = self.tail + piece
                    self.tail, piece = piece[-1:], piece[:-1]
                return pack(self.core.feed(piece.encode()))
            kept = ""
            if self.run == "S":
                whole = self.tail + piece[:end]
                kept, whole = ("", whole) if end == len(piece) else (whole[-1:], whole[:-1])
                out.append(pack(self.core.feed(whole.encode())))
            else:
                out.append(pack(self.core.feed(piece[:end].encode())))
            out.append(pack(self.core.finish()))
            self.run, self.tail, piece = "", kept, piece[end:]
        text, self.tail = self.tail + piece, ""
        if last and len(text) <= FEED:
            pieces = SPLIT.findall(text)
        else:
            pieces, cut = [], 0
            for m in SPLIT.finditer(text):
                if m.end() > len(text) - 2 and not last:
                    break
                pieces.append(m[0])
                cut = m.end()
            self.tail = text[cut:]
        out += map(self._long, pieces) if len(text) > LONG and max(map(len, pieces), default=0) > LONG else map(self.cache.__getitem__, pieces)
        if len(self.tail) > LONG:
            skip = int(self.tail[0] == " " and self.tail[1] != " ")
            self.run = next((k for k in "LNOS" if RUNS[k].fullmatch(self.tail, skip)), "")
        if self.run:
            rest, self.tail = (self.tail[:-1], self.tail[-1:]) if self.run == "S" else (self.tail, "")
            out.append(pack(self.core.feed(rest.encode())))
        return b"".join(out)

    def _long(self, piece: str) -> bytes:
        return self.cache[piece] if len(piece) <= LONG else pack(self.core.feed(piece.encode()) + self.core.finish())


class Decoder:
    """Feed packed ids, get the text that is certain; bytes of an unfinished character wait. ``finish`` ends the text:
    each maximal invalid piece becomes U+FFFD. Unknown ids give nothing."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of, default=-1) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I").tolist()
        try:
            data = b"".join(map(self.table.__getitem__, ids))
        except IndexError:
            data = b"".join(self.table[i] for i in ids if i < len(self.table))
        return self.state.decode(data)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, packed: bytes, step: int = 1 << 18) -> str:
        return "".join([*(self.feed(packed[at : at + step]) for at in range(0, len(packed), step)), self.finish()])


@functools.lru_cache(maxsize=1)
def coders(path: str) -> tuple[Encoder, Decoder]:
    """The coders of a file; a worker keeps those of the last one across its tasks."""
    vocabulary = Vocabulary.load(path)
    return Encoder(vocabulary), Decoder(vocabulary)


def _stepwise(docs: DataFrame, id_col: str, in_col, in_type: str, build, fields: str) -> DataFrame:
    """Rows (id, in) through build() -> function(value) -> tuple, in Arrow batches of about 8 MB."""
    rows = docs.select(F.col(id_col).alias("id"), in_col.cast(in_type).alias("value"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        step, schema = build(), None
        for b in slices(batches):
            start, out, size = 0, [], 0
            for k, value in enumerate(b.column(1)):
                out.append(step(value.as_py()))
                size += sum(len(x) for x in out[-1])
                if size > 8e6 or k == b.num_rows - 1:
                    columns = [b.column(0).slice(start, len(out)), *map(pa.array, zip(*out, strict=True))]
                    schema = schema or ["id", *(x.split()[0] for x in fields.split(", "))]
                    yield pa.RecordBatch.from_arrays(columns, schema)
                    start, out, size = k + 1, [], 0

    return rows.mapInArrow(run, f"id {kind}, {fields}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as binary, little-endian unsigned 32-bit integers. Strings of added tokens in a text become
    their ids. Null and empty texts give no ids; one row for each row of ``docs``, repeated ones too."""

    def build():
        encoder, _ = coders(path)
        return lambda text: (encoder.encode(text or ""),)

    return _stepwise(docs, id_col, F.col(text_col), "string", build, "ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the inverse of ``encode``. Null ids give an empty text."""

    def build():
        _, decoder = coders(path)
        return lambda ids: (decoder.decode(ids or b""),)

    return _stepwise(encoded, id_col, F.col(ids_col), "binary", build, "text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): ``encode`` and ``decode`` in one pass over the rows."""

    def build():
        encoder, decoder = coders(path)

        def step(text):
            ids = encoder.encode(text or "")
            return ids, decoder.decode(ids)

        return step

    return _stepwise(docs, id_col, F.col(text_col), "string", build, "ids binary, text string")
