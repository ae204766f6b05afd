"""SentencePiece encoding and decoding over batches by suffix-array matching.

The distinct white-space units of a batch are concatenated and indexed with a suffix array, sorted
to the length of the longest piece. Every piece of the vocabulary is found by binary search, all
pieces at once, as a range of suffixes; the ranges become edges (position, length, piece), dealt to
their positions by a counting sort. A place that no edge covers is never merged over, so units fall
into segments that are independent. Relaxation then works on the edges of all segments at once: for a
BPE model, which orders merges by score, each round joins in every segment the adjacent symbols whose
edge has the best score (leftmost of equals), until no edge joins two symbols; the same edges of a
long segment are relaxed through a priority queue. Characters without a piece fall back to byte pieces.

The model file is read on the driver; pieces go to the tasks, and no tokenizer is trained.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release
from .kernels import multi_range, text_bytes

SPACE = "\u2581"
#: Text gathered before units are made distinct, characters indexed at once, units remembered by a worker.
GATHER, INDEX, KNOWN = 4 << 20, 200_000, 250_000
#: Segments longer than this are relaxed through a priority queue: rounds would be as many as their merges.
LONG = 64
# every byte that is no part of a character is one replacement character
codecs.register_error("each_byte_seqsieve", lambda e: ("\ufffd" * (e.end - e.start), e.end))
NONE = np.iinfo(np.int64).max


def _check(model) -> None:
    """Only what encode() computes: BPE over text as it is, with one space put before it."""
    rules, training = model.normalizer_spec, model.trainer_spec
    wrong = []
    if training.model_type != training.BPE:
        wrong.append("its type is not BPE")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        wrong.append("it normalises texts")
    if not rules.add_dummy_prefix or not rules.escape_whitespaces or training.treat_whitespace_as_suffix:
        wrong.append("it treats spaces in another way")
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        wrong.append("it has symbols of the user")
    if wrong:
        raise ValueError(f"this model cannot be encoded: {', '.join(wrong)}")


class Pieces:
    """What encoding needs of a model; plain arrays, so it travels to the tasks."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        _check(proto)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)])
        special = np.array([model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        self.unknown = model.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.texts[i][3:5], 16)] = i
        levels = np.unique(-score)
        self.rank = np.searchsorted(levels, -score).astype(np.int64)
        normal = np.flatnonzero(~special)
        self.single = {self.texts[i]: int(i) for i in normal.tolist() if len(self.texts[i]) == 1}
        self.multi = np.array([i for i in normal.tolist() if len(self.texts[i]) > 1], np.int64)
        self.longest = max([len(self.texts[i]) for i in self.multi.tolist()], default=1)
        self.codes = np.zeros((len(self.multi), self.longest), np.uint32)
        for row, i in enumerate(self.multi.tolist()):
            self.codes[row, : len(self.texts[i])] = [ord(c) for c in self.texts[i]]
        self.lengths = (self.codes > 0).sum(1)
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in normal.tolist()):
            raise ValueError("a piece holds a space after other characters, so units would not be independent")
        out = []
        for i in range(n):
            if model.is_byte(i):
                out.append(bytes([int(self.texts[i][3:5], 16)]))
            elif model.is_control(i):
                out.append(b"")
            elif model.is_unknown(i):
                out.append(" \u2047 ".encode())
            else:
                out.append(self.texts[i].replace(SPACE, " ").encode())
        #: Of each id: 0 says nothing, 1 starts with the space that may have been put before a text, 2 neither.
        self.opens = np.array([0 if model.is_control(i) else 1 if not special[i] and self.texts[i].startswith(SPACE) else 2 for i in range(n)], np.int8)
        self.bytes_at = np.append(0, np.cumsum([len(x) for x in out]))
        self.bytes = np.frombuffer(b"".join(out), np.uint8)


def _packed(chars: np.ndarray, bits: int, words: int) -> np.ndarray:
    """Row i: chars[i:i+words*64//bits] packed, first character highest; zeros behind the end."""
    per = 64 // bits
    n = len(chars)
    padded = np.concatenate([chars.astype(np.uint64), np.zeros(per * words, np.uint64)])
    one = np.zeros(n + per * (words - 1), np.uint64)
    for k in range(per):
        one = (one << np.uint64(bits)) | padded[k : k + len(one)]
    return np.stack([one[w * per : w * per + n] for w in range(words)])


def _bound(keys: np.ndarray, probe: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all probes (words x probes) in the sorted keys (words x suffixes) at once."""
    low, high = np.zeros(probe.shape[1], np.int64), np.full(probe.shape[1], keys.shape[1], np.int64)
    for _ in range(max(1, keys.shape[1]).bit_length()):
        mid = (low + high) // 2
        at = np.minimum(mid, keys.shape[1] - 1)
        less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, p in zip(keys, probe):
            less |= equal & (k[at] < p)
            equal &= k[at] == p
        go = (less | (equal & right)) & (low < high)
        low, high = np.where(go, mid + 1, low), np.where(~go & (low < high), mid, high)
    return low


def edges(chars: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Table of piece ids by position and length (-1: none) for pieces of two characters and more, and where segments start.

    chars: code points of concatenated units; ends: for each character, where its unit ends.
    """
    longest = pieces.longest
    table = np.full((len(chars), longest + 1), -1, np.int32)
    known = np.unique(pieces.codes)
    known = known[(known > 0) & np.isin(known, chars)]
    bits = 8 if len(known) < 255 else 16
    words = -(-longest * bits // 64)

    def dense(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
        return np.where(known[at] == x, at + 1, 0) if len(known) else np.zeros(x.shape, np.int64)

    text = dense(chars)
    keys = _packed(text, bits, words)
    suffixes = np.lexsort(keys[::-1])
    keys = keys[:, suffixes]
    codes = dense(pieces.codes)
    use = np.flatnonzero((codes > 0).sum(1) == pieces.lengths)
    codes, length = codes[use], pieces.lengths[use]
    wide = words * 64 // bits
    low = np.zeros((len(use), wide), np.uint64)
    low[:, :longest] = codes
    high = np.where(np.arange(wide)[None, :] < length[:, None], low, np.uint64(2**bits - 1))

    def pack(x: np.ndarray) -> np.ndarray:
        per, out = 64 // bits, np.zeros((words, len(x)), np.uint64)
        for k in range(wide):
            out[k // per] = (out[k // per] << np.uint64(bits)) | x[:, k]
        return out

    first, last = _bound(keys, pack(low), False), _bound(keys, pack(high), True)
    count = last - first
    which = np.repeat(np.arange(len(use)), count)
    position = suffixes[np.repeat(first, count) + multi_range(count)]
    inside = position + length[which] <= ends[position]
    position, which = position[inside], which[inside]
    table[position, length[which]] = pieces.multi[use][which]
    over = np.bincount(position + 1, minlength=len(chars) + 1) - np.bincount(position + length[which], minlength=len(chars) + 1)
    return table, np.cumsum(over)[: len(chars)] == 0


def _queue(table: np.ndarray, pieces: Pieces) -> list[tuple[int, int]]:
    """(start, length) of the symbols of one long segment, whose edges are table."""
    n = len(table)
    size, after, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if 0 <= a and b < n and size[a] + size[b] <= pieces.longest:
            i = table[a, size[a] + size[b]]
            if i >= 0:
                heapq.heappush(heap, (int(pieces.rank[i]), a, size[a], size[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, x, y = heapq.heappop(heap)
        b = after[a]
        if size[a] != x or b >= n or size[b] != y:
            continue
        size[a], size[b] = x + y, 0
        after[a] = after[b]
        if after[b] < n:
            prev[after[b]] = a
        if prev[a] >= 0:
            offer(prev[a])
        offer(a)
    return [(a, size[a]) for a in range(n) if size[a]]


def relax(start_of: np.ndarray, table: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of all symbols once no edge joins two of them. start_of: first character of each segment, and the end."""
    n = len(table)
    size = np.ones(n, np.int64)
    alive = np.ones(n, bool)
    unit = np.repeat(np.arange(len(start_of) - 1), np.diff(start_of))
    sym = np.arange(n)
    while len(sym) > 1:
        a, b = sym[:-1], sym[1:]
        total = size[a] + size[b]
        piece = np.where((unit[a] == unit[b]) & (total <= pieces.longest), table[a, np.minimum(total, pieces.longest)], -1)
        key = np.where(piece >= 0, pieces.rank[piece] * n + np.arange(len(a)), NONE)
        u = unit[sym]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        best = np.minimum.reduceat(np.append(key, NONE), first)
        done = best == NONE
        at = best[~done] % n
        if not len(at):
            break
        size[sym[at]] += size[sym[at + 1]]
        alive[sym[at + 1]] = False
        open_ = np.repeat(~done, np.diff(np.append(first, len(sym))))
        sym = sym[open_ & alive[sym]]
    start = np.flatnonzero(alive)
    return start, size[start]


def encode_long(unit: str, pieces: Pieces) -> np.ndarray:
    """Token ids of a unit of any length, window by window: each ends at the last place in it that no edge covers."""
    out, at, size = [], 0, INDEX
    while at < len(unit):
        part = unit[at : at + size + pieces.longest]
        if at + len(part) < len(unit):
            chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            cut = np.flatnonzero(edges(chars, np.full(len(chars), len(chars)), pieces)[1][1 : size + 1])
            if not len(cut):
                size *= 2
                continue
            part = part[: int(cut[-1]) + 1]
        out.append(encode_units([part], pieces)[0])
        at, size = at + len(part), INDEX
    return np.concatenate(out)


def encode_units(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all units, and their n+1 offsets."""
    joined = "".join(units)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.append(0, np.cumsum([len(u) for u in units]))
    ends = np.repeat(at[1:], np.diff(at))
    table, opens = edges(chars, ends, pieces)
    opens[at[:-1]] = True
    segments = np.append(np.flatnonzero(opens), len(chars))
    long_ = np.flatnonzero(np.diff(segments) > LONG).tolist()
    held = [(a, table[a:b].copy()) for a, b in ((int(segments[i]), int(segments[i + 1])) for i in long_)]
    for a, own in held:  # settled apart: without edges they take no part in the rounds
        table[a : a + len(own)] = -1
    start, size = relax(segments, table, pieces)
    if held:
        keep = np.ones(len(start), bool)
        more: list[tuple[int, int]] = []
        for a, own in held:
            table[a : a + len(own)] = own
            keep[np.searchsorted(start, a) : np.searchsorted(start, a + len(own))] = False
            more += [(a + s, n) for s, n in _queue(own, pieces)]
        start, size = np.append(start[keep], [s for s, _ in more]).astype(np.int64), np.append(size[keep], [n for _, n in more]).astype(np.int64)
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
    token = table[start, np.minimum(size, pieces.longest)].astype(np.int64)
    one = np.flatnonzero(size == 1)
    code, which = np.unique(chars[start[one]], return_inverse=True)
    count = np.ones(len(start), np.int64)
    ids, spelled = np.zeros(len(code), np.int64), {}
    for k, c in enumerate(code.tolist()):
        i = pieces.single.get(chr(c))
        if i is None:
            i = -1 - k
            spelled[k] = pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]
        ids[k] = i
    token[one] = ids[which]
    for k, x in spelled.items():
        count[token == -1 - k] = len(x)
    out = np.repeat(token, count)
    if spelled:
        nth = multi_range(count)
        for k, x in spelled.items():
            own = np.flatnonzero(out == -1 - k)
            out[own] = x[nth[own]]
    offsets = np.append(0, np.cumsum(count))[np.searchsorted(start, at)]
    return out.astype(np.int32), offsets


def _whole(coded: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and where those of each unit end."""
    return coded[0], coded[1][1:]


class _Memory:
    """Units this worker has encoded; emptied when full."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def tokens(self, units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """First token and token count of each unit in self.flat."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.__init__()
            new = units
        flats, ats, chunk, size = [self.flat], [self.at], [], 0

        def add(flat: np.ndarray, ends: np.ndarray) -> None:
            flats.append(flat)
            ats.append(ends + sum(map(len, flats[:-1])))

        for k, u in enumerate(new):
            if len(u) > INDEX and chunk:
                add(*_whole(encode_units(chunk, pieces)))
                chunk, size = [], 0
            if len(u) > INDEX:
                flat = encode_long(u, pieces)
                add(flat, np.array([len(flat)]))
                continue
            chunk.append(u)
            size += len(u)
            if size >= INDEX:
                add(*_whole(encode_units(chunk, pieces)))
                chunk, size = [], 0
        if chunk:
            add(*_whole(encode_units(chunk, pieces)))
        for u in new:
            self.known[u] = len(self.known)
        self.flat, self.at = np.concatenate(flats), np.concatenate(ats)
        which = np.array([self.known[u] for u in units], np.int64)
        return self.at[which], self.at[which + 1] - self.at[which]


def encode_texts(texts: pa.Array, pieces: Pieces, memory: _Memory) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian int32 token ids of all texts, and their n+1 bounds; null and empty texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    coded = parts.flatten().dictionary_encode()
    unit = coded.indices.to_numpy()
    units = [SPACE + u for u in coded.dictionary.to_pylist()]
    count = parts.value_lengths().to_numpy().astype(np.int64)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False) | odd
    keep = np.repeat(~empty, count)
    unit, count = unit[keep], np.where(empty, 0, count)
    if odd.any():  # runs of spaces stay with the word behind them
        extra = {u: k for k, u in enumerate(units)}
        blocks, bounds = [], np.append(0, np.cumsum(count))
        for i in np.flatnonzero(odd).tolist():
            found = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + texts[i].as_py().replace(" ", SPACE))
            blocks.append((i, np.array([extra.setdefault(u, len(extra)) for u in found], np.int64)))
        units = list(extra)
        pieces_of, last = [], 0
        for i, ids in blocks:
            pieces_of += [unit[last : bounds[i]], ids]
            last = bounds[i]
            count[i] = len(ids)
        unit = np.concatenate([*pieces_of, unit[last:]])
    first, size = memory.tokens(units, pieces)
    n = size[unit]
    flat = memory.flat[np.repeat(first[unit], n) + multi_range(n)]
    return flat.astype("<i4"), np.append(0, np.cumsum(n))[np.append(0, np.cumsum(count))]


def packed(flat: np.ndarray, bounds: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Binary array of flat[bounds[i]:bounds[i+1]]."""
    part = np.ascontiguousarray(flat[bounds[0] : bounds[-1]])
    offsets = ((bounds - bounds[0]) * part.itemsize).astype(np.int32)
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.BinaryArray.from_buffers(pa.binary(), len(valid), [bits, pa.py_buffer(offsets), pa.py_buffer(part)])


_memory: dict[str, _Memory] = {}


def encode(documents: DataFrame, model_file: str, column: str = "text", decoded: str | None = None) -> DataFrame:
    """documents with n_tokens (long) and tokens: packed little-endian int32 ids of the whole text.

    With `decoded`, a column of that name holds what the ids decode to, made in the same pass.

    A null or empty text has no tokens (a null text has null tokens). Rows are independent, so
    repeated rows agree; an empty table gives an empty table. Long texts are encoded whole, long runs
    without a space in windows. Of equal scores the leftmost merge comes first, so no tie is left
    open. Other columns stay, but for ones named n_tokens or tokens, which are replaced. Models that
    are not BPE over unchanged text are an error.
    """
    prepare(documents.sparkSession)
    added = ["n_tokens", "tokens", *[decoded] * bool(decoded)]
    documents = documents.drop(*added)
    pieces = Pieces(model_file)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in documents.schema)}, n_tokens long, tokens binary" + f", `{decoded}` string" * bool(decoded)
    names = [*documents.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory.setdefault(model_file, _Memory())

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays([b.column(column).cast(pa.large_string()) for b in held])
            flat, bounds = encode_texts(texts, pieces, memory)
            at = 0
            for b in held:
                own = bounds[at : at + b.num_rows + 1]
                at += b.num_rows
                valid = b.column(column).is_valid().to_numpy(zero_copy_only=False)
                out = [*b.columns, pa.array(np.diff(own), pa.int64()), packed(flat, own, valid)]
                if decoded:
                    out.append(decode_texts(flat[own[0] : own[-1]], own - own[0], valid, pieces))
                yield pa.RecordBatch.from_arrays(out, names=names)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(column).nbytes
            if size >= GATHER:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        release()

    return documents.mapInArrow(run, schema)


def decode_texts(ids: np.ndarray, bounds: np.ndarray, valid: np.ndarray, pieces: Pieces) -> pa.Array:
    """Text of ids[bounds[i]:bounds[i+1]], whatever ids they are; null where not valid.

    A space at the start of the first piece that says anything is the one put before a text, and goes.
    """
    ids = ids.astype(np.int64)
    first, size = pieces.bytes_at[ids], pieces.bytes_at[ids + 1] - pieces.bytes_at[ids]
    flat = pieces.bytes[np.repeat(first, size) + multi_range(size)]
    ends = np.append(0, np.cumsum(size))[bounds]
    at, stop = bounds[:-1].copy(), bounds[1:]
    while len(row := np.flatnonzero((at < stop) & (pieces.opens[ids[np.minimum(at, max(len(ids) - 1, 0))]] == 0) if len(ids) else np.zeros(0, bool))):
        at[row] += 1
    skip = np.zeros(len(at), np.int64)
    some = np.flatnonzero(at < stop)
    skip[some] = pieces.opens[ids[at[some]]] == 1
    spell = lambda a, b: flat[a:b].tobytes().decode("utf-8", "each_byte_seqsieve")
    texts = [spell(a + s, b) for a, b, s in zip(ends[:-1].tolist(), ends[1:].tolist(), skip.tolist())]
    silent = np.flatnonzero(pieces.opens[ids] == 0)
    after = np.append(0, np.cumsum(size))
    for i in np.unique(np.searchsorted(bounds, silent, "right") - 1).tolist():  # no character goes over an id that says nothing
        begin = int(ends[i] + skip[i])
        stops = np.maximum(begin, after[silent[(silent >= bounds[i]) & (silent < bounds[i + 1])]]).tolist()
        cut = [begin, *stops, int(ends[i + 1])]
        texts[i] = "".join(spell(a, b) for a, b in zip(cut, cut[1:]))
    return pa.array(texts, pa.string(), mask=~valid)


def decode(documents: DataFrame, model_file: str, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """documents with the text of packed token ids; null tokens give null, none give the empty text."""
    prepare(documents.sparkSession)
    pieces = Pieces(model_file)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in documents.schema)}, `{into}` string"
    names = [*documents.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(tokens))
            valid = batch.column(tokens).is_valid().to_numpy(zero_copy_only=False)
            out = decode_texts(np.frombuffer(data.tobytes(), "<i4"), off // 4, valid, pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    return documents.mapInArrow(run, schema)


def ids(tokens: str = "tokens"):
    """Column of array<int> from packed ids."""
    hexed = F.hex(tokens)
    at = F.sequence(F.lit(1), F.length(hexed) - 7, F.lit(8))
    swap = lambda i: F.concat(*(hexed.substr(i + F.lit(k), F.lit(2)) for k in (6, 4, 2, 0)))
    return F.when(F.length(hexed) > 0, F.transform(at, lambda i: F.conv(swap(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
