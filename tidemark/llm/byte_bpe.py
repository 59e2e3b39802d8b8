"""Byte-level BPE encoding and decoding.

The merges are compiled into a transducer from bytes to token ids. Two facts carry it: a row of tokens is the
encoding of its bytes exactly if the encoding of each neighbouring pair's bytes is that pair, so that "which token came
last" is all that an encoding has to remember; and every prefix of a text has one encoding. A state of the
nondeterministic transducer is (last token, place in the trie of tokens); the deterministic one has sets of those, each
with the ids that it has yet to put out. What all members of a set agree on is put out, and a member dies
once no token continues it, so no output waits for more bytes than the longest token has. Sets are made when a
text first reaches them, and kept, up to a bound after which the memory is begun anew.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"
#: Ids that a decoder takes at once.
CHUNK = 4096
#: Bytes of a piece's begin that the transducer reads by one arc from its start.
BEGIN = 5


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read on the driver; they travel to the executors (a vocabulary: below 10 MB)."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 10_000_000:
        raise ValueError(f"{path}: {len(raw)} bytes are too many for a vocabulary")
    return raw


class _Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; a piece that isn't there is looked for in the older half, or run."""

    def __init__(self, run, most: int):
        super().__init__()
        self.run, self.most, self.older = run, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = np.array(self.run(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:  # the older half goes; what is used again comes back
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Transducer:
    """Encodes by byte-pair ranks. most_states bounds the sets kept, most_pieces the pieces whose ids are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = 250_000, most_pieces: int = 300_000, most_pairs: int = 300_000):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.most_states, self.most_pairs = most_states, most_pairs
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._compatible: dict[int, bool] = {}
        self.pieces = _Pieces(self._run, most_pieces)
        # The trie: a node's children by byte, and the id of the token that ends there. Tokens that merges don't reach stay out.
        leaf: dict[int, int] = {}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        # The two tokens that the last merge of a token joins; a single byte is its own.
        self.left, self.right = dict(zip(self.token, self.token, strict=True)), dict(zip(self.token, self.token, strict=True))
        for t, i in ranks.items():
            if len(t) > 1:
                halves = self.by_merges(t, 2)
                if len(halves) != 2:
                    continue
                self.left[i], self.right[i] = halves
            at = 0
            for b in t:
                if b not in self.child[at]:
                    if self.child[at] is leaf:
                        self.child[at] = {}
                    self.child[at][b] = len(self.child)
                    self.child.append(leaf)
                    self.ends.append(None)
                at = self.child[at][b]
            self.ends[at] = i
        self._forget()

    @classmethod
    def from_file(cls, raw: bytes, pattern: str, **bounds) -> Transducer:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}, pattern, **bounds)

    def _forget(self) -> None:
        # States are numbered; their members are packed. An arc's key is its state and byte.
        self.states: dict[bytes, int] = {}
        self.members: list[bytes] = []
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.begins: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.newest: tuple[int, tuple] = (-1, ())
        self.start = self._state(((-1, 0, ()),))

    def by_merges(self, piece: bytes, least: int = 1) -> list[int]:
        """The definition: the pair of lowest rank, leftmost first, is merged until no pair has a rank, or least parts are left."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        pair = a << 32 | b
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) > self.most_pairs:
                self._compatible.clear()
            known = self._compatible[pair] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge reaches over the border of two tokens: the merges that made them are undone, the latest first.

        What stands at the border before a merge of rank bound could itself have merged there if its rank were lower.
        """
        token, ranks, bound = self.token, self.ranks, len(self.token) + 1
        while True:
            over = ranks.get(token[a] + token[b])
            if over is not None and over < bound:
                return False
            inner, outer = self.right[a], self.left[b]
            if a > b and inner != a or outer == b:
                if inner == a:
                    return True
                bound, a = a, inner
            else:
                bound, b = b + 1, outer


    def _state(self, members: Iterable[tuple]) -> int:
        """The number of a set of members: for each the last token, the place in the trie, and the ids to put out with their number."""
        packed = array("i", [x for last, node, late in members for x in (last, node, len(late), *late)]).tobytes()
        at = self.states.get(packed)
        if at is None:
            at = self.states[packed] = len(self.members)
            self.members.append(packed)
            self.newest = at, tuple(members)
        return at

    def _unpacked(self, packed: bytes) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        x, k = array("i", packed), 0
        while k < len(x):
            yield x[k], x[k + 1], tuple(x[k + 3 : k + 3 + x[k + 2]])
            k += 3 + x[k + 2]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the arc: members that the byte continues, and the one that ends a token here."""
        after = []
        for last, node, late in self.newest[1] if self.newest[0] == state else self._unpacked(self.members[state]):
            to = self.child[node].get(byte)
            if to is None:
                continue
            after.append((last, to, late))
            token = self.ends[to]
            if token is not None and self.compatible(last, token):
                after.append((token, 0, (*late, token)))
        # Exactly one member ends here; members that only wait come first, in order of their first byte.
        if len(after) == 1:
            last, node, out = after[0]
            arc = self.arcs[state << 8 | byte] = (self._state([(last, node, ())]), out)
            return arc
        shortest = min(len(late) for _, _, late in after)
        same = 0
        while same < shortest and len({late[same] for _, _, late in after}) == 1:
            same += 1
        out = after[0][2][:same]
        members = sorted({(last, node, late[same:]) for last, node, late in after if node == 0 or self.child[node]})
        arc = self.arcs[state << 8 | byte] = (self._state(members), out)
        return arc

    def _run(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(self.members) > self.most_states:
            self._forget()
        begin = self.begins.get(raw[:BEGIN]) if len(raw) > BEGIN else None
        if begin is None and len(raw) > BEGIN:
            state, out = self.start, []
            for b in raw[:BEGIN]:
                state, more = self.arcs.get(state << 8 | b) or self._step(state, b)
                out.extend(more)
            if len(self.begins) < self.most_states:
                self.begins[raw[:BEGIN]] = state, tuple(out)
            rest = raw[BEGIN:]
        elif begin is None:
            state, out, rest = self.start, [], raw
        else:
            state, out, rest = begin[0], list(begin[1]), raw[BEGIN:]
        known = self.arcs.get
        for b in rest:
            arc = known(state << 8 | b) or self._step(state, b)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
            if len(self.members) > 2 * self.most_states:  # a piece that alone fills the memory
                kept = self.members[state]
                self._forget()
                known = self.arcs.get
                state = self._state(self._unpacked(kept))
        out.extend(next(late for _, node, late in self._unpacked(self.members[state]) if node == 0) if raw else ())
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split.findall(text))), "<u4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


class Utf8Stream:
    """An incremental UTF-8 machine: takes bytes as they come and gives text as soon as whole characters are there.

    Its state is the begun character: its bytes so far. Ill-formed bytes become U+FFFD, as a decoder with
    replacement gives them for the whole.
    """

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.begun + data
        cut = len(data) if last else self._whole(data)
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _whole(data: bytes) -> int:
        """The place before a character that the last bytes begin and do not end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                break
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                second = data[len(data) - back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                fits = second is None or low <= second <= high
                return len(data) - back if back < need and fits else len(data)
            if b >= 0xC0:
                break
        return len(data)


def decode_stream(transducer: Transducer, ids: Iterable[int], chunk: int = CHUNK) -> Iterator[str]:
    """The text of a stream of ids, some ids at a time."""
    machine, held = Utf8Stream(), []
    for i in ids:
        held.append(i)
        if len(held) >= chunk:
            yield machine.feed(transducer.decode_bytes(held))
            held = []
    yield machine.feed(transducer.decode_bytes(held), last=True)


_MADE: dict[tuple, Transducer] = common.KEPT.setdefault("byte_bpe", {})


def transducer(raw: bytes, pattern: str, **bounds: int) -> Transducer:
    """One for each worker process and vocabulary."""
    key = (hashlib.sha256(raw).hexdigest(), pattern, *sorted(bounds.items()))
    if key not in _MADE:
        _MADE.clear()
        gc.set_threshold(500_000, 50, 1000)  # the tables hold many containers and no cycles
        _MADE[key] = Transducer.from_file(raw, pattern, **bounds)
    return _MADE[key]


def back(transducer: Transducer, ids: np.ndarray) -> tuple[str, int]:
    """The digest of the bytes that ids decode to, and the characters that a stream of them gives."""
    digest, machine, chars = hashlib.sha256(), Utf8Stream(), 0
    for k in range(0, len(ids), CHUNK):
        data = transducer.decode_bytes(ids[k : k + CHUNK])
        digest.update(data)
        chars += len(machine.feed(data))
    return digest.hexdigest(), chars + len(machine.feed(b"", last=True))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: tuple[str, ...] | None = None, **bounds: int) -> DataFrame:
    """docs with a column of token ids (array of int) and no other change; a null text is empty. Columns named ids are replaced.

    decoded: a further column, with the digest of the bytes that the ids decode to. keep: the columns that stay, all if None.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    more = [ids, *([decoded] if decoded else [])]
    rest = docs.drop(*more)
    rest = rest if keep is None else rest.select(*keep, text)
    n = len(rest.columns) if keep is None else len(keep)
    schema = rest.select(*rest.columns[:n]).withColumns({c: _ints() if c == ids else _text() for c in more}).schema

    def run(batches):
        common.release("byte_bpe")
        made = transducer(raw.value, pattern, **bounds)
        for batch in batches:
            got = [made.encode(x or "") for x in batch.column(batch.schema.get_field_index(text) if keep is None else n).to_pylist()]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(got) if got else np.zeros(0)).astype(np.int32)))]
            if decoded:
                out.append(pa.array([back(made, x)[0] for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], [*batch.schema.names[:n], *more])

    return rest.mapInArrow(run, schema)


def _ints():
    from pyspark.sql import functions as F

    return F.array().cast("array<int>")


def _text():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """tokens with the text of its ids in a column; null ids give a null text."""
    from pyspark.sql import functions as F

    raw = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rest = tokens.drop(text)

    def run(batches):
        common.release("byte_bpe")
        made = transducer(raw.value, pattern)
        for batch in batches:
            got = [None if x is None else "".join(decode_stream(made, x)) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, text])

    return rest.mapInArrow(run, rest.withColumn(text, F.lit("")).schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row the columns of keep, then the number of tokens, digests of the ids and of the decoded bytes, and the decoded characters.

    A null or empty text has no tokens and the digests of nothing. Rows come back one for one, repeated ones too.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + f", {ENCODED}"

    def run(batches):
        common.release("byte_bpe")
        made = transducer(raw.value, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(len(keep)).to_pylist():
                got = made.encode(x or "")
                n.append(len(got))
                a.append(hashlib.sha256(got.tobytes()).hexdigest())
                b.append(back(made, got))
            out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array([x for x, _ in b], pa.string()), pa.array([x for _, x in b], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], [*keep, *(x.split()[0] for x in ENCODED.split(", "))])

    return docs.select(*keep, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
