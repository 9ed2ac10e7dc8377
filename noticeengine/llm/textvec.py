"""Vectorised text work on Arrow string columns: bytes, words and hashes as numpy arrays.

Every function works on one block of whole documents at a time. Blocks hold about BLOCK_BYTES of
text (a longer document is a block of its own), so memory follows the block and never the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Stands for a null id.
LEAST_ID = -(1 << 63)
_tables: dict[int, np.ndarray] = {}


def table_of(members: bytes | range | list) -> np.ndarray:
    """256 booleans: which bytes are members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_WORD = ~table_of([0x20, *range(0x09, 0x0E)])
#: Bytes of the words of the decontamination contract: digits, letters and all that is not ASCII.
IS_ALNUM = table_of([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def as_string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of large strings; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets into them."""
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most about limit bytes."""
    data, offs = buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask inside each row, and the n + 1 offsets of the rows' runs."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = np.zeros(n, bool)
    first[1:] = mask[:-1]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    first[edge] = False
    starts = np.flatnonzero(mask & ~first)
    last = np.zeros(n, bool)
    last[:-1] = mask[1:]
    last[edge[1:] - 1] = False
    ends = np.flatnonzero(mask & ~last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get(0, ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            out = np.empty(size, np.uint64)
            out[0], done = 1, 1
            while done < size:  # doubling: base**(done + i) = base**done * base**i
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _tables[k] = out
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Longer spans are hashed one by one: of two long ones a polynomial modulo a power of two can be equal by their pattern alone.
_SHORT = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, the same wherever those bytes stand."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > _SHORT)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(view[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return out


def ids(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit integers; the least one stands for null, and ids of other types go by a hash of their text."""
    if pa.types.is_integer(column.type) or pa.types.is_null(column.type):
        return column.cast(pa.int64()).fill_null(LEAST_ID).to_numpy()
    text = column.cast(pa.string()).to_pylist()
    return np.array([LEAST_ID if x is None else xxhash.xxh3_64_intdigest(x) >> 1 for x in text], np.int64)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))))


def row_of(counts_at: np.ndarray) -> np.ndarray:
    """For n + 1 offsets, the row number of each item."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each row, zero for an empty one."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.float64 if values.dtype.kind == "f" else np.int64))
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


_LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of h[at[i]:at[i+1]] have each of the 64 bits set, for each row i.

    Eight bits are counted at once in the bytes of one word; sums of up to 255 items can't overflow a byte.
    """
    n = len(at) - 1
    out = np.zeros((n, 64), np.int64)
    size = np.diff(at)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    parts = -(-size[some] // 255)
    first = np.concatenate([[0], np.cumsum(parts)])
    starts = np.repeat(at[:-1][some], parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        out[some, j::8] = np.add.reduceat(lanes, first[:-1], axis=0, dtype=np.int64)
    return out


def rows(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[list[pa.Array]]:
    """The named columns of each non-empty Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(f)) for f in fields]
